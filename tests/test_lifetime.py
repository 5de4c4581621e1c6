"""Staged tables live as long as their owner says, and nothing of them is left afterwards."""

from __future__ import annotations

import os
import subprocess
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from conftest import ROOT
from helpers import line, lines

from tillwise.sources import Tables, current, of_application, release, shared_folder, shared_path, stage, staged


def kept(spark):
    folder = Path(shared_folder(spark))
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_tables_end_with_their_owner(spark):
    before = kept(spark)
    with Tables(spark) as tables:
        frame = stage(lines(spark, line("1")), "x")
        assert current(spark) is tables and len(kept(spark) - before) == 1
        with Tables(spark):
            stage(frame, "inner")
            assert len(kept(spark) - before) == 2
        assert frame.count() == 1 and len(kept(spark) - before) == 1
        with staged(frame, "brief") as brief:
            assert brief.count() == 1 and len(kept(spark) - before) == 2
        assert len(kept(spark) - before) == 1
    assert kept(spark) == before and current(spark) is of_application(spark)


def test_tables_go_when_the_work_fails(spark):
    before = kept(spark)
    with pytest.raises(ZeroDivisionError), Tables(spark):
        stage(lines(spark, line("1")), "x")
        raise ZeroDivisionError
    with pytest.raises(ZeroDivisionError), staged(lines(spark, line("1")), "x"):
        raise ZeroDivisionError
    assert kept(spark) == before


def test_a_table_under_a_key_is_staged_once(spark):
    built = []

    def build():
        built.append(1)
        return lines(spark, line("1"), line("2"))

    with Tables(spark) as tables:
        before = kept(spark)
        with ThreadPoolExecutor(4) as pool:
            frames = list(pool.map(lambda _: tables.once("key", "shared", build), range(4)))
        assert [f.count() for f in frames] == [2] * 4 and len(built) == 1 and len(kept(spark) - before) == 1
        tables.drop("key")
        tables.drop("key")
        assert kept(spark) == before
        assert tables.once("key", "shared", build).count() == 2 and len(built) == 2


def test_the_last_reader_deletes(spark):
    with Tables(spark) as tables:
        before = kept(spark)
        ask = lambda: tables.reader("key", "read", lambda: lines(spark, line("1")))
        with ask() as first:
            with ask() as second:
                assert second is first
            assert first.count() == 1 and len(kept(spark) - before) == 1
        assert kept(spark) == before
        with pytest.raises(ZeroDivisionError), ask():
            raise ZeroDivisionError
        assert kept(spark) == before


def test_release_deletes_what_queries_have_staged(spark):
    stage(lines(spark, line("1")), "left")
    Path(shared_path(spark, "never_written"))
    assert kept(spark)
    release(spark)
    release(spark)
    assert kept(spark) == set()
    assert stage(lines(spark, line("1")), "after").count() == 1
    release(spark)


def test_the_folder_goes_with_the_application(tmp_path):
    """A driver that ends without releasing anything leaves nothing behind."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from tillwise.sources import shared_folder, stage
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate())
print(stage(spark.range(3), "x").count(), shared_folder(spark))
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 512m pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env, check=True)
    count, folder = done.stdout.split()
    assert count == "3" and folder.startswith(f"file://{tmp_path}")
    for _ in range(100):
        if not list(tmp_path.glob("tillwise-*")):
            break
        time.sleep(0.1)
    assert list(tmp_path.glob("tillwise-*")) == []
