"""Exact quantiles and running sums over whole tables, without a task or a buffer that grows with the data.

Both rest on a grid of approximate quantiles (a sketch of fixed size, merged before the shuffle) that only decides
where to look: the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

ENOUGH = 200_000  # distinct values of a group that one task may hold
CELLS = 1000
ACCURACY = 10_000
STEPS = 100


def _grid(cells: int) -> Column:
    return F.expr("array(" + ", ".join(f"{i / cells!r}D" for i in range(cells + 1)) + ")")


def quantiles(df: DataFrame, value: str, probs: list[float], keys: list[str] | None = None, enough: int = ENOUGH) -> DataFrame:
    """Linearly interpolated quantiles of ``value`` per group: ``keys`` and the array ``q`` in the order of ``probs``.

    Groups of at most ``enough`` distinct values (estimated) are counted by value in one buffer. In larger ones each wanted
    rank is narrowed down: its neighbourhood in the grid holds a few thousandths of the rows, and only these are looked at next.
    Null and NaN are left out; a group without values has no row (without ``keys``: one row whose ``q`` is null).
    """
    keys = list(keys or [])
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull() & ~F.isnan(x)).select(*[F.col(k) for k in keys], x.alias("__x"))
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    exact = F.percentile("__x", wanted).alias("q")
    size = rows.groupBy(*keys).agg(F.approx_count_distinct("__x", 0.02).alias("__d"))
    if not keys:
        if size.first()[0] <= enough:
            return rows.agg(exact)
        return _narrowed(rows.withColumn("__g", F.lit(0)), ["__g"], wanted, enough).select("q")
    size = cut(size.select("__d", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]), "sizes")
    large = size.filter(F.col("__d") > enough).drop("__d")
    if large.isEmpty():
        return rows.groupBy(*keys).agg(exact)
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    small = rows.join(large, same, "left_anti").groupBy(*keys).agg(exact)
    return small.unionByName(_narrowed(rows.join(large, same, "left_semi"), keys, wanted, enough))


def _narrowed(rows: DataFrame, keys: list[str], wanted, enough: int) -> DataFrame:
    """The quantiles of groups of any size."""
    named = {k: f"__k{i}" for i, k in enumerate(keys)}
    rows = rows.select(*[F.col(k).alias(a) for k, a in named.items()], "__x")
    on = group = list(named.values())
    todo, found = None, []
    x, lo, hi = F.col("__x"), F.col("__lo"), F.col("__hi")
    while True:
        grid = rows.groupBy(*on).agg(F.count("*").alias("__n"), F.percentile_approx("__x", _grid(CELLS), F.lit(ACCURACY)).alias("__grid"))
        if todo is None:
            # each quantile lies between two ranks; __j numbers both
            at = grid.select("*", F.posexplode(wanted).alias("__p", "__prob")).withColumn("__at", F.col("__prob") * (F.col("__n") - 1))
            at = at.withColumn("__part", F.col("__at") - F.floor("__at"))
            goal = at.select("*", F.posexplode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__side", "__rank")).withColumn("__j", F.col("__p") * 2 + F.col("__side"))
        else:
            goal = _same(todo, grid, on)
        cell = F.col("__rank") / F.col("__n") * CELLS
        low, high = F.greatest(F.floor(cell).cast("int") - 1, F.lit(0)), F.least(F.ceil(cell).cast("int") + 1, F.lit(CELLS))
        near = cut(goal.select(*group, "__j", "__rank", F.get("__grid", low).alias("__lo"), F.get("__grid", high).alias("__hi"), *(["__part"] if todo is None else [])), "brackets")
        if todo is None:
            part = near.filter("__j % 2 = 0").select(*group, F.floor(F.col("__j") / 2).cast("int").alias("__p"), "__part")
            near = near.drop("__part")
        met = _same(rows, near, on)
        seen = met.groupBy(*group, "__j", "__rank", "__lo", "__hi").agg(
            F.count_if(x < lo).alias("__below"), F.count_if(x == lo).alias("__low"), F.count_if((x > lo) & (x < hi)).alias("__in"), F.count_if(x == hi).alias("__high")
        )
        seen = cut(seen.withColumn("__rest", F.col("__rank") - F.col("__below") - F.col("__low")), "counted")
        held = (F.col("__rank") >= F.col("__below")) & (F.col("__rest") < F.col("__in") + F.when(lo < hi, F.col("__high")).otherwise(0))
        edge = F.when(~held, F.raise_error(F.lit("a rank lies outside its bracket"))).when(F.col("__rest") < 0, lo).otherwise(hi)
        found.append(seen.filter("__rest < 0 or __rest >= __in").select(*group, "__j", edge.alias("__v")))
        left = seen.filter("__rest >= 0 and __rest < __in")
        most = left.agg(F.max("__in")).first()[0]
        if most is None:
            break
        on = [*group, "__j"]
        todo = left.select(*on, F.col("__rest").alias("__rank"))
        inner = met.filter((x > lo) & (x < hi)).select(*on, "__x")
        if most <= enough:
            up_to = Window.partitionBy(*on).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
            sums = inner.groupBy(*on, "__x").agg(F.count("*").alias("__n")).withColumn("__sum", F.sum("__n").over(up_to))
            found.append(_same(sums, todo, on).filter("__sum > __rank").groupBy(*on).agg(F.min("__x").alias("__v")))
            break
        rows = cut(_same(inner, todo.drop("__rank"), on), "inside")
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = values.withColumn("__p", F.floor(F.col("__j") / 2).cast("int")).withColumn("__side", F.col("__j") % 2)
    pair = values.groupBy(*group, "__p").agg(F.max(F.when(F.col("__side") == 0, F.col("__v"))).alias("__a"), F.max(F.when(F.col("__side") == 1, F.col("__v"))).alias("__b"))
    q = _same(pair, part, [*group, "__p"]).withColumn("__q", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part"))
    q = q.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__q"))), lambda s: s["__q"]).alias("q"))
    return q.select(*[F.col(a).alias(k) for k, a in named.items()], "q")


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns of one name, null keys included."""
    other = right.select(*[F.col(c).alias(f"{c}_r") if c in on else F.col(c) for c in right.columns])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on]).drop(*[f"{c}_r" for c in on])


def running(df: DataFrame, value: str, tie: str, sums: dict[str, str], enough: int = ENOUGH) -> DataFrame:
    """Running sums over all rows by ``value``, then ``tie`` (both numbers, ascending): ``sums`` maps new columns to summed expressions.

    At most ``enough`` rows are summed in one window. More are dealt out by the grid of ``value``; a value that is itself on the grid (a frequent one) has a place of its own,
    dealt out further by the grid of ``tie``. Each place is summed by itself and starts from the sums of all places before it, of which
    there are some ten thousand at most. Nulls come first, as a frequent value.
    """
    by = [F.col(value).asc_nulls_first(), F.col(tie).asc_nulls_first()]
    if df.count() <= enough:
        return df.withColumns({c: F.sum(F.expr(e)).over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) for c, e in sums.items()})
    v, t = F.col(value).cast("double"), F.col(tie).cast("double")
    probs = _grid(STEPS)
    grid = F.array(*[F.lit(g) for g in sorted(set(df.agg(F.percentile_approx(v, probs, F.lit(ACCURACY))).first()[0] or []))]).cast("array<double>")
    place = F.when(v.isNull(), -1).otherwise(2 * F.size(F.filter(grid, lambda g: g < v)) + F.array_contains(grid, v).cast("int"))
    df = df.withColumn("__place", place)
    ties = df.filter("__place % 2 <> 0").groupBy("__place").agg(F.percentile_approx(t, probs, F.lit(ACCURACY)).alias("__ties"))
    df = df.join(F.broadcast(cut(ties, "ties")), "__place", "left")
    df = df.withColumn("__sub", F.when(F.col("__ties").isNull() | t.isNull(), 0).otherwise(F.size(F.filter("__ties", lambda g: g < t)))).drop("__ties")
    before = Window.orderBy("__place", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("__place", "__sub").agg(*[F.sum(F.expr(e)).alias(f"__s_{c}") for c, e in sums.items()])
    starts = parts.select(F.col("__place").alias("__pl"), F.col("__sub").alias("__su"), *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__s_{c}") for c in sums])
    within = Window.partitionBy("__place", "__sub").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(F.broadcast(starts), (F.col("__place") == F.col("__pl")) & (F.col("__sub") == F.col("__su")))
    out = out.withColumns({c: F.sum(F.expr(e)).over(within) + F.col(f"__s_{c}") for c, e in sums.items()})
    return out.drop("__place", "__sub", "__pl", "__su", *[f"__s_{c}" for c in sums])


def indexed(df: DataFrame, key: str, name: str = "idx", enough: int = ENOUGH) -> DataFrame:
    """``df`` with the position of its distinct ``key`` in ascending order, from 0, without ordering all rows in one task."""
    rows = cut(df.withColumn("__at", F.col(key).cast("double")), "keys")
    return running(rows, "__at", key, {name: "1L"}, enough).withColumn(name, F.col(name) - 1).drop("__at")
