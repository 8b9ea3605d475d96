"""Samples that repeat: rows are drawn by the MD5 of a seed and their key, so the draw doesn't depend on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def draw(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def fraction(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Each row on its own with probability ``share``, without a shuffle."""
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    return df.filter(F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") < int(share * 2**32))


def exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows (all, where there are fewer), each task keeping its ``n`` first; ties in the draw go by key."""
    return df.withColumn("__draw", draw(key, seed)).orderBy("__draw", key).limit(n).drop("__draw")


def split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Column part: test for a drawn ``share`` of rows, else train."""
    return df.withColumn("part", F.when(F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long") < int(share * 2**32), "test").otherwise("train"))
