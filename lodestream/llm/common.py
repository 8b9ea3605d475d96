"""Helpers that the training-data operators share: shared storage, splits, joins on hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, delete, scratch, shared_dir, table, work_dir

__all__ = ["FEW", "cut", "delete", "few", "give_back", "give_back_heaps", "join_groups", "remainder", "scratch", "shared_dir", "shuffle_width", "slices", "table", "tidy", "work_dir"]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


#: Rows of a written table of a few numbers each that may be broadcast.
FEW = 1_000_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, a written table of short rows, marked for broadcast where it has at most ``most`` rows; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row per key, safe for keys that hold most rows.

    ``rows`` must be cheap to read twice (a written table). Keys with over a
    thousandth of the rows, of which there can be a thousand at most, are
    broadcast, so their rows never meet in one task; all others are shuffled.
    """
    floor = max(1000, rows.count() // 1000)
    hot, rest = groups.filter(F.col(size) > floor), groups.filter(F.col(size) <= floor)
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that of long texts only few are held twice."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Hand freed memory back to the machine: a worker outlives its task, and what it keeps counts against the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """Have the executors collect their garbage and hand the free heap back to the machine.

    A heap that has grown keeps its size, and Spark collects none by itself, so the garbage of one stage counts against the workers of the next.
    As many tasks as there are cores start at once, so each executor gets some.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, that gives memory back at the end of its task."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
