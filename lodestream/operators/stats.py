"""Daily facts and rolling statistics per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of a written table of a few numbers each that may be broadcast.
FEW = 1_000_000


def daily_counts(rows: DataFrame, keys: list[str], count: str = "listen_count") -> DataFrame:
    """Rows per key combination: partial counts before the shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias(count))


def collapse(facts: DataFrame, keys: list[str], count: str = "listen_count") -> DataFrame:
    """Sum over provenance."""
    return facts.groupBy(*keys).agg(F.sum(count).alias(count))


def growth(today: Column, before: Column) -> Column:
    """Today's count over the total before it; null unless that is positive."""
    return F.when(before > 0, today / before)


def rolling(daily: DataFrame, entity: str, seed: Column | None = None) -> DataFrame:
    """Cumulative, 7-row and 30-row sums and growth; frames are rows, not days."""
    w = Window.partitionBy(entity).orderBy("day")
    n = F.col("listen_count")
    total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)) + (F.lit(0) if seed is None else F.coalesce(seed, F.lit(0)))
    return (
        daily.withColumn("cumulative_listen_count", total)
        .withColumn("listen_count_past_7_days", F.sum(n).over(w.rowsBetween(-6, 0)))
        .withColumn("listen_count_past_30_days", F.sum(n).over(w.rowsBetween(-29, 0)))
        .withColumn("growth", growth(n, F.col("cumulative_listen_count") - n))
    )


def with_percentiles(df: DataFrame) -> DataFrame:
    """Percent rank of growth (null first), 7-row and 30-row sums within each day.

    A day's rank is found from the counts of its distinct values, so the ranking window holds values rather
    than entities and no day of many entities has to fit into one sorted task. One aggregate over the written rows ranks
    all three. Few ranks are broadcast; many are joined by shuffle, but for values that over a thousandth of all rows have, which are
    broadcast and whose rows are spread out.
    """
    df = cut(df, "rolled")
    named = {"growth_percentile": "growth", "listen_pctl_past_7_days": "listen_count_past_7_days", "listen_pctl_past_30_days": "listen_count_past_30_days"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")) for k, c in named.items()]))
    counts = df.select("day", each.alias("x")).groupBy("day", "x.kind", "x.value").agg(F.count("*").alias("n"))
    group = Window.partitionBy("day", "kind")
    below = F.coalesce(F.sum("n").over(group.orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("n").over(group)
    ranked = cut(counts.select("day", "kind", "value", "n", F.when(whole > 1, below / (whole - 1)).otherwise(F.lit(0.0)).alias("pctl")), "ranked")
    small, floor = ranked.count() <= FEW, max(1000, df.count() // 1000)
    for name, col in named.items():
        own = ranked.filter(F.col("kind") == name).select(F.col("day").alias("__d"), F.col("value").alias("__v"), F.col("pctl").alias(name), "n")
        same = (F.col("day") == F.col("__d")) & F.col(col).cast("double").eqNullSafe(F.col("__v"))
        if small:
            df = df.join(F.broadcast(own.drop("n")), same).drop("__d", "__v")
            continue
        df = df.join(F.broadcast(own.filter(F.col("n") > floor).withColumnRenamed(name, "__hot").drop("n")), same, "left").drop("__d", "__v")
        df = df.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.floor(F.rand(7) * 4096)))
        df = df.join(own.filter(F.col("n") <= floor).drop("n"), same & (F.col("__salt") == 0), "left").drop("__d", "__v", "__salt")
        df = df.withColumn(name, F.coalesce(name, "__hot")).drop("__hot")
    return df


def _columns(entity: str) -> list[str]:
    return ["day", entity, "growth_percentile", "cumulative_listen_count", "listen_count_past_7_days", "listen_pctl_past_7_days", "listen_count_past_30_days", "listen_pctl_past_30_days"]


def daily_stats(daily: DataFrame, entity: str) -> DataFrame:
    """The full statistics table from one row per (day, entity)."""
    return with_percentiles(rolling(daily, entity)).select(*_columns(entity))


_TAIL = 29  # rows before a row that its longest frame needs


def state_of(daily: DataFrame, entity: str) -> DataFrame:
    """What a later refresh needs of the rows so far: entity, total and tail (its last rows, newest first)."""
    number = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("day")))
    kept = F.when(F.col("__rn") <= _TAIL, F.struct("day", "listen_count"))
    out = daily.select(entity, "day", "listen_count").withColumn("__rn", number).groupBy(entity)
    return out.agg(F.sum("listen_count").alias("total"), F.sort_array(F.collect_list(kept), False).alias("tail"))


def advance(state: DataFrame, new: DataFrame, entity: str) -> DataFrame:
    """The state after the rows ``new``, which follow those of ``state``: reads no history."""
    both = state.select(entity, "total", "tail").unionByName(state_of(new, entity))
    return both.groupBy(entity).agg(F.sum("total").alias("total"), F.slice(F.sort_array(F.flatten(F.collect_list("tail")), False), 1, _TAIL).alias("tail"))


def refresh(new: DataFrame, entity: str, state: DataFrame) -> DataFrame:
    """Statistics of the rows ``new`` (day, entity, listen_count), which follow those of ``state``; equal to the full table's rows for their days.

    Reads no history: the tail fills the row frames, and what the total holds beyond the tail is the seed. A recompute of the last days
    passes the state as it was before them.
    """
    rest = F.col("total") - F.aggregate("tail", F.lit(0).cast("long"), lambda s, x: s + x["listen_count"])
    old = state.select(entity, rest.alias("__seed"), F.explode("tail").alias("t")).select("t.day", entity, "t.listen_count", "__seed", F.lit(False).alias("__new"))
    rows = new.select("day", entity, "listen_count", F.lit(None).cast("long").alias("__seed"), F.lit(True).alias("__new")).unionByName(old)
    fresh = rolling(rows, entity, F.max("__seed").over(Window.partitionBy(entity))).filter("__new")
    return with_percentiles(fresh).select(*_columns(entity))


# Names of the feature columns and the rows that each looks back.
_CHANGES = {"momentum_7d": ("listen_count_past_7_days", 7), "momentum_30d": ("listen_count_past_30_days", 30)}
_EARLIER = {"listen_count_lag_1d": 1, "listen_count_lag_7d": 7}
_FRAMES = {"ma_7": (F.avg, 7), "ma_30": (F.avg, 30), "std_7": (F.stddev_pop, 7)}


def features(stats: DataFrame, daily: DataFrame, entity: str) -> DataFrame:
    """Momentum, velocity, lags, moving averages, spread and calendar features, all over one ordering of each entity's rows."""
    rows = stats.join(daily, ["day", entity])
    order = Window.partitionBy(entity).orderBy("day")
    made = {name: F.col(c) - F.lag(c, k).over(order) for name, (c, k) in _CHANGES.items()}
    made |= {name: F.lag("listen_count", k).over(order) for name, k in _EARLIER.items()}
    made |= {name: f("listen_count").over(order.rowsBetween(1 - k, Window.currentRow)) for name, (f, k) in _FRAMES.items()}
    made["days_since_first_listen"] = F.datediff("day", F.first("day").over(order))
    made["velocity_ratio"] = F.try_divide("listen_count_past_7_days", F.greatest("listen_count_past_30_days", F.lit(0)))
    made["day_of_week"] = F.weekday("day")
    made["is_weekend"] = (F.weekday("day") >= 5).cast("int")
    made["log_listens"] = F.log1p("listen_count")
    return rows.withColumns(made).withColumn("momentum_ratio", F.expr("momentum_7d / (1 + abs(momentum_30d))"))


def targets(stats: DataFrame, entity: str, threshold: float = 0.95, least: int = 30) -> DataFrame:
    """Labels from the following 7 and 30 rows; rows with fewer than ``least`` following values go."""
    order = Window.partitionBy(entity).orderBy("day")
    made = {}
    for k in (7, 30):
        ahead = order.rowsBetween(1, k)
        made[f"is_popular_{k}d"] = F.coalesce((F.max("growth_percentile").over(ahead) >= threshold).cast("int"), F.lit(0))
        made[f"future_growth_pctl_{k}d"] = F.avg("growth_percentile").over(ahead)
    known = F.count("growth_percentile").over(order.rowsBetween(1, 30))
    return stats.withColumns(made | {"__known": known}).filter(F.col("__known") >= least).drop("__known")


def min_observations(df: DataFrame, entity: str, least: int) -> DataFrame:
    """Rows of entities with at least ``least`` rows."""
    enough = df.groupBy(entity).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(entity)
    return df.join(enough, entity, "left_semi")


def temporal_split(df: DataFrame, days: int) -> DataFrame:
    """Column part: train up to ``days`` before the last day, test after."""
    last = df.agg(F.date_sub(F.max("day"), days).alias("__cut"))
    return df.join(F.broadcast(last), F.lit(True)).withColumn("part", F.when(F.col("day") <= F.col("__cut"), "train").otherwise("test")).drop("__cut")


def cutoff_search(per_day: DataFrame, least_train: int, least_test: int, least_pos: int) -> DataFrame:
    """Candidate cutoffs by day from ``per_day`` (day, n, pos): counts on both sides, and whether each limit holds.

    One row per day, so one window over all days is bounded by the calendar.
    """
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    return (
        per_day.withColumn("train_n", F.sum("n").over(w))
        .withColumn("train_pos", F.sum("pos").over(w))
        .withColumn("test_n", F.sum("n").over(everything) - F.col("train_n"))
        .withColumn("test_pos", F.sum("pos").over(everything) - F.col("train_pos"))
        .withColumn("ok", (F.col("train_n") >= least_train) & (F.col("test_n") >= least_test) & (F.col("train_pos") >= least_pos) & (F.col("test_pos") >= least_pos))
        .select("day", "train_n", "test_n", "train_pos", "test_pos", "ok")
    )


def choose_cutoff(per_day: DataFrame, least_train: int, least_test: int, least_pos: int) -> DataFrame:
    """The latest cutoff of ``cutoff_search`` that holds all limits; where none does, the one that comes nearest by shares of the limits reached, then the latest."""
    limits = {"train_n": least_train, "test_n": least_test, "train_pos": least_pos, "test_pos": least_pos}
    near = sum((F.least(F.col(c) / F.lit(float(least)), F.lit(1.0)) for c, least in limits.items()), F.lit(0.0))
    found = cutoff_search(per_day, least_train, least_test, least_pos).withColumn("__near", F.when(F.col("ok"), 5.0).otherwise(F.round(near, 9)))
    return found.orderBy(F.desc("__near"), F.desc("day")).limit(1).drop("__near")


def sequences(df: DataFrame, entity: str, columns: list[str], target: str, length: int) -> DataFrame:
    """For each row with ``length`` rows before it, these rows' features in order, and the row's target."""
    w = Window.partitionBy(entity).orderBy("day").rowsBetween(-length, -1)
    out = df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    return out.filter(F.size("sequence") == length).select(entity, "day", "sequence", F.col(target).alias("target"))
