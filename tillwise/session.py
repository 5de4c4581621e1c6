"""Session settings that follow the size of the input."""

from __future__ import annotations

from pyspark.sql import SparkSession

MB = 1024 * 1024
#: Bytes of one piece of a shuffle and of one scan task, whatever the size of the input.
PIECE_BYTES = 128 * MB
#: Share of the lines' bytes that the widest shuffles carry.
SHUFFLED_SHARE = 0.25


def settings_for(input_bytes: int, cores: int, piece_bytes: int = PIECE_BYTES) -> dict[str, str]:
    """Scan and shuffle sizes for an input of this many bytes on this many cores.

    Shuffles are cut into pieces of ``piece_bytes``, at least four per core. Adaptive execution joins the
    small pieces again and splits those of hot keys, so erring on the high side costs little.
    """
    pieces = max(4 * cores, int(input_bytes * SHUFFLED_SHARE) // piece_bytes)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(piece_bytes // 2),
        "spark.sql.shuffle.partitions": str(pieces),
        "spark.sql.files.maxPartitionBytes": str(piece_bytes),
    }


def apply_settings(spark: SparkSession, input_bytes: int) -> SparkSession:
    for key, value in settings_for(input_bytes, spark.sparkContext.defaultParallelism).items():
        spark.conf.set(key, value)
    return spark
