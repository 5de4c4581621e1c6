"""Intermediate tables in the folder shared by all executors, and how long they live.

Every application writes below one folder of its own, ``tillwise-<application id>``. A table ends with the
first of these: its ``staged`` block, the last ``reader`` of a table that was staged ``once``, the ``Tables``
that own it, ``release(spark)``, or the application, whose driver removes the whole folder as it ends. Only a
driver that is killed leaves its folder behind; it is named after the application and can be deleted as a whole.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below the one that the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    return f"{base.rstrip('/')}/tillwise-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's folder. What is written there goes with the open ``Tables``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    current(spark).add(path)
    return path


def file_of(spark: SparkSession, path: str):
    """The path and its file system, whichever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    target, store = file_of(spark, path)
    store.delete(target, True)


def fingerprint(spark: SparkSession, *paths: str) -> tuple:
    """Name, size and time of every file of some tables: what a table that is staged for later askers derives from."""
    found = []
    for path in paths:
        target, store = file_of(spark, path)
        for status in store.listStatus(target):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


class Tables:
    """Staged tables with one lifetime: all that are staged while it is open go when it closes.

    >>> with Tables(spark):
    ...     queries()["some_query"](spark, sf_dir).write.parquet(out)   # nothing of the query is left

    A table that is staged ``once`` under a key is shared by all who ask for the key. Those who read it in
    a ``reader`` block count, and the last one's end deletes it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._paths: set[str] = set()
        self._once: dict[Hashable, tuple[str, Any]] = {}
        self._ends: dict[str, Callable[[], None]] = {}
        self._readers: dict[Hashable, int] = {}
        self._lock = threading.RLock()
        self._opened: list = []
        self._outer: Tables | None = None

    def add(self, path: str) -> None:
        with self._lock:
            if not self._paths:
                # The driver removes the folder when it ends, so that an owner nobody closes leaves nothing either.
                target, store = file_of(self.spark, shared_folder(self.spark))
                store.mkdirs(target)
                store.deleteOnExit(target)
            self._paths.add(path)

    def made(self, key: Hashable, name: str, make: Callable[[str], T], end: Callable[[str], None] | None = None) -> T:
        """What ``make`` writes at a path and returns; for the first who asks for the key, and again after its deletion.

        ``end`` is called with the path before it is deleted.
        """
        with self._lock:
            if key not in self._once:
                path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
                self.add(path)
                if end is not None:
                    self._ends[path] = lambda: end(path)
                self._once[key] = (path, make(path))
            return self._once[key][1]

    def once(self, key: Hashable, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table under a key, built and staged once."""
        return self.made(key, name, lambda path: written(build(), path))

    @contextmanager
    def reader(self, key: Hashable, name: str, build: Callable[[], DataFrame]) -> Iterator[DataFrame]:
        """The table under a key for results that are computed in this block; the last reader deletes it."""
        with self._lock:
            self._readers[key] = self._readers.get(key, 0) + 1
        try:
            yield self.once(key, name, build)
        finally:
            with self._lock:
                self._readers[key] -= 1
                if not self._readers[key]:
                    del self._readers[key]
                    self.drop(key)

    def drop(self, key: Hashable) -> None:
        """Deletes the table under a key, if there is one."""
        with self._lock:
            if key in self._once:
                self.remove(self._once.pop(key)[0])

    def remove(self, path: str) -> None:
        with self._lock:
            self._paths.discard(path)
            self._ends.pop(path, lambda: None)()
            delete(self.spark, path)

    def release(self) -> None:
        """Deletes every table; whoever still holds a frame on one cannot read it any more."""
        with self._lock:
            self._once.clear()
            while self._paths:
                self.remove(self._paths.pop())

    def hand_over(self, frame: DataFrame, name: str) -> DataFrame:
        """The result of the work in this block, written for the owner around it; all else goes as the block ends."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        (self._outer or of_application(self.spark)).add(path)
        return written(frame, path)

    def __enter__(self) -> Tables:
        self._outer = current(self.spark)
        self._opened.append(_open_tables.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _open_tables.reset(self._opened.pop())
        self.release()


_open_tables: ContextVar[Tables | None] = ContextVar("open_tables", default=None)
_of_application: dict[str, Tables] = {}


def of_application(spark: SparkSession) -> Tables:
    """The tables that live until ``release`` or the end of the application."""
    return _of_application.setdefault(spark.sparkContext.applicationId, Tables(spark))


def current(spark: SparkSession) -> Tables:
    """The innermost open ``Tables``, or else those of the application."""
    return _open_tables.get() or of_application(spark)


def release(spark: SparkSession) -> None:
    """Deletes all tables that the application's queries have staged. Call it once their results are consumed."""
    owner = _of_application.pop(spark.sparkContext.applicationId, None)
    if owner is not None:
        owner.release()


def written(frame: DataFrame, path: str) -> DataFrame:
    """A frame written to a path and read back from there."""
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back, so that several results share its computation.

    Unlike a cached frame the table outlives lost executors, and every reader scans only the
    columns it needs.
    """
    return written(frame, shared_path(frame.sparkSession, name))


@contextmanager
def staged(frame: DataFrame, name: str) -> Iterator[DataFrame]:
    """A staged table that is deleted at the end, for results that are computed until then."""
    spark = frame.sparkSession
    owner, path = current(spark), shared_path(spark, name)
    try:
        yield written(frame, path)
    finally:
        with suppress(KeyError):
            owner.remove(path)
