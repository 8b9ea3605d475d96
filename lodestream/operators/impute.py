"""Imputation and its scoring on masked cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import quantiles

RANGE = 200_000


def hash_mask(key: Column, per_mille: int) -> Column:
    """True for about ``per_mille`` of a thousand keys, the same on every run and engine."""
    return F.pmod(key * F.lit(2654435761), F.lit(1000)) < per_mille


def constant(df: DataFrame, column: str, value) -> DataFrame:
    return df.na.fill(value, [column])


def statistic(df: DataFrame, column: str, how: str = "median") -> DataFrame:
    """Fill with the column's exact median or mean."""
    x = F.col(column).cast("double")
    s = quantiles(df, column, [0.5]).select(F.col("q")[0].alias("__s")) if how == "median" else df.agg(F.avg(x).alias("__s"))
    return df.join(F.broadcast(s), F.lit(True)).withColumn(column, F.coalesce(x, "__s")).drop("__s")


def group_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """Fill with the median of the group's positive values."""
    x = F.col(column).cast("double")
    m = quantiles(df.filter(x > 0), column, [0.5], [group]).select(F.col(group).alias("__g"), F.col("q")[0].alias("__m"))
    return df.join(m, F.col(group) == F.col("__g"), "left").withColumn(column, F.coalesce(x, "__m")).drop("__g", "__m")


def rules(df: DataFrame, column: str, cases: list[tuple[Column, object]]) -> DataFrame:
    """The first case that holds gives the value; none leaves it."""
    c = F.col(column)
    for test, value in reversed(cases):
        c = F.when(test, F.lit(value)).otherwise(c)
    return df.withColumn(column, c)


def rmse(df: DataFrame, truth: str, guess: str, where: Column) -> DataFrame:
    e = F.col(truth).cast("double") - F.col(guess)
    return df.filter(where).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def nearest(df: DataFrame, key: str, column: str, by: list[str], k: int) -> DataFrame:
    """Fill with the mean of the ``k`` nearest donors (Euclidean over ``by``, missing coordinates left out and scaled up).

    Every row with a value is a donor; among equally near ones the smallest hashed key goes first. Only ``k`` donors of equal
    coordinates can count, so these are kept; blocks of them meet blocks of the distinct places to fill, and the best ``k`` are merged.
    """
    at = {f"__{i}": F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for i, c in enumerate(by)}
    names = list(at)
    x = df.withColumn(column, F.col(column).cast("double")).withColumns(at)
    have = _first(x.filter(F.col(column).isNotNull()).select(*names, F.xxhash64(key).alias("h"), F.col(column).alias("v")), names, k)
    blank = x.filter(F.col(column).isNull())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": [b[names].to_numpy(float).tobytes()], "h": [b["h"].to_numpy(np.int64).tobytes()], "v": [b["v"].to_numpy(float).tobytes()]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q, xs, h, v in zip(b["q"], b["x"], b["h"], b["v"]):
                q, xs = (np.frombuffer(y, float).reshape(-1, len(names)) for y in (q, xs))
                h, v = np.frombuffer(h, np.int64), np.frombuffer(v, float)
                order = np.lexsort((v, h))
                xs, h, v = xs[order], h[order], v[order]
                for i in range(0, len(q), 256):
                    d = q[i : i + 256, None, :] - xs[None]
                    ok = ~np.isnan(d)
                    dist = np.where(ok.any(2), np.nansum(d * d, 2) * len(names) / np.maximum(1, ok.sum(2)), np.inf)
                    near = np.argsort(dist, 1, kind="stable")[:, :k]
                    n = np.repeat(np.arange(i, i + len(d)), near.shape[1])
                    yield pd.DataFrame({c: q[n, j] for j, c in enumerate(names)} | {"d": np.take_along_axis(dist, near, 1).ravel(), "h": h[near.ravel()], "v": v[near.ravel()]})

    places = blank.select(*names).distinct().withColumns({"h": F.lit(0).cast("long"), "v": F.lit(0.0)})
    blocks = "x binary, h binary, v binary"
    both = have.mapInPandas(pack, blocks).crossJoin(places.mapInPandas(pack, blocks).select(F.col("x").alias("q")))
    cells = ", ".join(f"{c} double" for c in names)
    best = _first(both.mapInPandas(meet, f"{cells}, d double, h long, v double"), names, k, "d")
    means = best.groupBy(*names).agg(F.avg("v").alias("__fill"))
    filled = blank.join(means, names, "left").withColumn(column, F.col("__fill"))
    return x.filter(F.col(column).isNotNull()).select(*df.columns).unionByName(filled.select(*df.columns))


def _first(rows: DataFrame, group: list[str], k: int, *before: str) -> DataFrame:
    """The first ``k`` rows of each group by ``before``, hash and value."""
    w = Window.partitionBy(*group).orderBy(*before, "h", "v")
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def chained(df: DataFrame, key: str, columns: list[str], rounds: int = 3, candidates: int = 0) -> DataFrame:
    """Chained equations: start from means, then predict each column from the others by least squares, in turn.

    Normal equations are one aggregation of fixed size a column and round. With ``candidates`` the last round takes observed values
    (predictive mean matching): of the donors whose predictions are the ``candidates`` nearest, one is chosen by the hash of ``key``.
    Every observed row is a donor; among equally near ones the smallest hashed key goes first.
    """
    means = df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()
    out = df.withColumns({f"__m_{c}": F.col(c).isNull() for c in columns})
    out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m if m is not None else 0.0)) for c, m in zip(columns, means)})
    for step in range(rounds):
        for c in columns:
            xs = [F.lit(1.0)] + [F.col(x) for x in columns if x != c]
            cells = [F.sum(a * b) for a in xs for b in xs] + [F.sum(a * F.col(c)) for a in xs]
            row = out.filter(~F.col(f"__m_{c}")).agg(*cells).first()
            if row[0] is None:
                continue
            n = len(xs)
            beta = np.linalg.lstsq(np.array(row[: n * n], float).reshape(n, n), np.array(row[n * n :], float), rcond=None)[0]
            guess = sum((F.lit(float(b)) * x for b, x in zip(beta, xs)), F.lit(0.0))
            if candidates and step == rounds - 1:
                out = _matched(out.withColumn("__g", guess), key, c, candidates)
                continue
            out = out.withColumn(c, F.when(F.col(f"__m_{c}"), guess).otherwise(F.col(c)))
    return out.drop(*[f"__m_{c}" for c in columns])


def _matched(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """``column`` where ``__m_column`` holds: the value of one of the ``k`` donors whose predictions ``__g`` are nearest.

    Donors are dealt out by ranges of predictions (approximate quantiles set the balance only). A range also gets the ``k`` nearest
    donors below and above it, so no donor is missed at a border.
    """
    df = cut(df.withColumn("__h", F.xxhash64(key)), "predicted")
    have = cut(_first(df.filter(~F.col(f"__m_{column}")).select(F.col("__g").alias("x"), F.col("__h").alias("h"), F.col(column).alias("v")), ["x"], k), "donors")
    n = have.count()
    if not n:
        return df.drop("__g", "__h")
    parts = n // RANGE + 1
    bounds = np.unique(have.approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts)) if parts > 1 else np.zeros(0)

    @F.pandas_udf("int")
    def part(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(float), side="right").astype(np.int32))

    have = cut(have.withColumn("p", part("x")), "donors")
    low = _first(have.withColumn("up", F.col("x")), ["p"], k, "up").select("p", "x", "h", "v").toPandas()
    high = _first(have.withColumn("up", -F.col("x")), ["p"], k, "up").select("p", "x", "h", "v").toPandas()

    def near(group: tuple, own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        p = (own if len(own) else asked)["p"].iloc[0]
        below = high[high["p"] < p].assign(up=lambda y: -y["x"]).sort_values(["up", "h", "v"]).head(k)
        above = low[low["p"] > p].sort_values(["x", "h", "v"]).head(k)
        own = pd.concat([own, below, above])
        x, h, v = own["x"].to_numpy(float), own["h"].to_numpy(np.int64), own["v"].to_numpy(float)
        rise, fall = np.lexsort((v, h, x)), np.lexsort((v, h, -x))
        q, m = asked["x"].to_numpy(float), len(x)
        at = np.searchsorted(x[rise], q)
        step = np.arange(k)
        up, down = at[:, None] + step, m - at[:, None] + step
        pick = np.concatenate([rise[np.minimum(up, m - 1)], fall[np.minimum(down, m - 1)]], 1)
        off = np.where(np.concatenate([up, down], 1) < m, np.abs(x[pick] - q[:, None]), np.inf)
        best = np.take_along_axis(pick, np.lexsort((v[pick], h[pick], off), axis=-1)[:, : min(k, m)], 1)
        # a range where nothing is asked for would have its empty lists taken for numbers
        return pd.DataFrame({"__g": q, "__v": pd.Series(list(v[best]), dtype=object)})

    miss = df.filter(f"__m_{column}")
    asked = miss.select(F.col("__g").alias("x")).distinct().withColumn("p", part("x"))
    found = have.groupBy("p").cogroup(asked.groupBy("p")).applyInPandas(near, "__g double, __v array<double>")
    chosen = F.element_at("__v", (F.pmod(F.pmod("__h", F.lit(1 << 20)), F.size("__v")) + 1).cast("int"))
    filled = miss.join(found, "__g").withColumn(column, chosen).drop("__v")
    return cut(df.filter(~F.col(f"__m_{column}")).unionByName(filled).drop("__g", "__h"), "matched")
