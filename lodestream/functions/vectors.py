"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column, floor: float = 1e-12) -> Column:
    """Length one; vectors shorter than ``floor`` are divided by it."""
    n = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.transform(v, lambda x: x.cast("double") / n)


def mean_vectors(df: DataFrame, key: str, vector: str, wide: int = 128) -> DataFrame:
    """Element-wise mean of ``vector`` per ``key``: partial sums per position, no list of vectors is gathered.

    Up to ``wide`` places are sums of one row per key; longer vectors get a row per place.
    """
    places = df.agg(F.max(F.size(vector))).first()[0] or 0
    if 0 < places <= wide:
        means = F.array(*[F.avg(F.get(F.col(vector), F.lit(i)).cast("double")) for i in range(places)])
        rows = df.filter(F.size(vector) > 0).groupBy(key).agg(means.alias("profile"), F.max(F.size(vector)).alias("__size"))
        return rows.select(key, F.slice("profile", F.lit(1), F.col("__size")).alias("profile"))
    long = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("profile"))
