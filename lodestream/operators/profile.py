"""Column profiles, distributions and transformations."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import quantiles


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, quartiles (interpolated, exact), max."""
    cells = []
    for c in columns:
        x = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")))
    moments = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("x")).select("x.*")
    q = quantiles(long, "x", [0.25, 0.5, 0.75], ["column"])
    out = moments.join(F.broadcast(q), "column", "left")
    return out.select("column", "n", "mean", "std", "min", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "max")


def profile(df: DataFrame, columns: list[str], continuous: int = 100) -> DataFrame:
    """Missing per cent, distinct values and kind of each column."""
    cells = [F.struct(F.lit(c).alias("column"), (F.avg(F.col(c).isNull().cast("double")) * 100).alias("missing_percent"), F.count_distinct(c).alias("unique_val")) for c in columns]
    x = df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return x.withColumn("var_type", F.when(F.col("unique_val") >= continuous, "Continuous").otherwise("Categorical"))


def null_scan(df: DataFrame) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count("*").alias("n")) for c in df.columns]
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over rows where both are present. One pass."""
    cells = []
    for a in columns:
        for b in columns:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both, x), F.when(both, y)).alias("r")))
    return df.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins between min and max; the last one is closed."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return df.filter(x.isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def trim_outliers(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two quantiles, both included."""
    ends = quantiles(df, column, [low, high]).select(F.col("q")[0].alias("__lo"), F.col("q")[1].alias("__hi"))
    return df.join(F.broadcast(ends), F.col(column).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def quartile_bins(df: DataFrame, column: str, labels: tuple[str, ...] = ("SMALL", "MEDIUM", "LARGE", "XLARGE"), out: str = "size_bin") -> DataFrame:
    """Bins closed on the right at the quartiles."""
    q = quantiles(df, column, [0.25, 0.5, 0.75]).withColumnRenamed("q", "__q")
    c = F.col(column)
    bins = F.when(c <= F.col("__q")[0], labels[0]).when(c <= F.col("__q")[1], labels[1]).when(c <= F.col("__q")[2], labels[2]).when(c.isNotNull(), labels[3])
    return df.join(F.broadcast(q), F.lit(True)).withColumn(out, bins).drop("__q")


def boxcox(c: Column, lam: float) -> Column:
    """Positive values only, others null."""
    return F.when(c > 0, F.log(c) if lam == 0 else (F.pow(c, F.lit(lam)) - 1) / lam)


def boxcox_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, rounds: int = 4) -> float:
    """The maximum-likelihood exponent: grids of 17 values, each round narrower, one pass a round."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        grid = [low + (high - low) * i / 16 for i in range(17)]
        row = df.filter(x > 0).agg(F.count("*"), F.sum(F.log(x)), *[F.var_pop(boxcox(x, g)) for g in grid]).first()
        if not row[0]:
            raise ValueError("no positive values")
        llf = [-row[0] / 2 * math.log(v) + (g - 1) * row[1] if v and v > 0 else -math.inf for g, v in zip(grid, row[2:])]
        best, step = grid[llf.index(max(llf))], (high - low) / 16
        low, high = best - step, best + step
    return best


def normality(df: DataFrame, column: str) -> DataFrame:
    """n, skewness, excess kurtosis, and the K-squared test of both with its p-value; null where it is undefined (n < 8, no spread)."""
    x = F.col(column).cast("double")
    m = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    n, one = F.col("n").cast("double"), F.lit(1.0)
    y = F.col("skew") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    t = y / F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(t) / F.sqrt(F.log(F.sqrt(w2)))
    u = (F.col("kurt") + 6 / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    d = 1 + u * F.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - F.signum(d) * F.cbrt((one - 2 / a) / F.abs(d))) / F.sqrt(2 / (9 * a))
    k2 = F.when((n >= 8) & F.col("skew").isNotNull() & ~F.isnan("skew"), F.when(d != 0, z1 * z1 + z2 * z2))
    return m.withColumn("k2", k2).withColumn("p", F.exp(-F.col("k2") / 2))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def relu(c: Column) -> Column:
    """Not below zero; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def shift_nonpositive(c: Column) -> Column:
    """Values of zero or less plus one."""
    return F.when(c <= 0, c + 1).otherwise(c)


def all_present(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def min_max(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Columns mapped linearly to ``low`` .. ``high``; a constant column becomes ``low``."""
    ends = df.agg(*[F.min(F.col(c).cast("double")).alias(f"__a_{c}") for c in columns], *[F.max(F.col(c).cast("double")).alias(f"__b_{c}") for c in columns])
    out = df.join(F.broadcast(ends), F.lit(True))
    scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"__a_{c}"), F.col(f"__b_{c}") - F.col(f"__a_{c}")), F.lit(0.0)) * (high - low) + low) for c in columns}
    return out.withColumns(scaled).drop(*[f"__{e}_{c}" for e in "ab" for c in columns])


def robust(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their median, over the distance of their quartiles (1 where that is 0)."""
    for c in columns:
        q = quantiles(df, c, [0.25, 0.5, 0.75]).withColumnRenamed("q", "__q")
        width = F.col("__q")[2] - F.col("__q")[0]
        df = df.join(F.broadcast(q), F.lit(True)).withColumn(c, (F.col(c).cast("double") - F.col("__q")[1]) / F.when(width == 0, 1.0).otherwise(width)).drop("__q")
    return df


def yeo_johnson(c: Column, lam: float) -> Column:
    """The power transformation that takes values of either sign."""
    up = F.log1p(c) if lam == 0 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if lam == 2 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).when(c < 0, down)


def yeo_johnson_lambda(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, rounds: int = 4) -> float:
    """The maximum-likelihood exponent: grids of 17 values, each round narrower, one pass a round."""
    x = F.col(column).cast("double")
    for _ in range(rounds):
        grid = [low + (high - low) * i / 16 for i in range(17)]
        row = df.agg(F.count(x), F.sum(F.signum(x) * F.log1p(F.abs(x))), *[F.var_pop(yeo_johnson(x, g)) for g in grid]).first()
        if not row[0]:
            raise ValueError("no values")
        llf = [-row[0] / 2 * math.log(v) + (g - 1) * row[1] if v and v > 0 else -math.inf for g, v in zip(grid, row[2:])]
        best, step = grid[llf.index(max(llf))], (high - low) / 16
        low, high = best - step, best + step
    return best
