"""Recommendation from ratings and item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, mean_vectors, unit
from ..session import cut, shared_dir
from .factors import ITEMS_HELD, PER_BLOCK, train
from .order import quantiles
from .search import BLOCKS, packed, search


def positives(ratings: DataFrame, least: int = 4) -> DataFrame:
    return ratings.filter(F.col("rating") >= least)


def holdout_last(ratings: DataFrame) -> DataFrame:
    """Column held: the user's most recent row (ties: largest item)."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"))
    return ratings.withColumn("held", F.row_number().over(w) == 1)


def last_n(ratings: DataFrame, n: int) -> DataFrame:
    """Each user's last ``n`` rows by time; ties: largest item, then best rating."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("item_id"), F.desc("rating"))
    return ratings.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent_positives(ratings: DataFrame, n: int, least: int = 4) -> DataFrame:
    """The good ones among each user's last ``n`` ratings: fewer than ``n`` for users whose last ratings are poor."""
    return positives(last_n(ratings, n), least)


def popular(ratings: DataFrame, k: int, least: int = 4) -> DataFrame:
    """The ``k`` items with most good ratings; ties: smaller id."""
    return positives(ratings, least).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(k)


def top_users(ratings: DataFrame, share: float = 0.95) -> DataFrame:
    """Users whose number of ratings reaches the quantile."""
    n = ratings.groupBy("user_id").agg(F.count("*").alias("n"))
    q = quantiles(n, "n", [share]).select(F.col("q")[0].alias("__q"))
    return n.join(F.broadcast(q), F.col("n") >= F.col("__q")).drop("__q")


def cold_user(users: DataFrame, ratings: DataFrame) -> DataFrame:
    """The smallest user without ratings."""
    return users.join(ratings.select("user_id"), "user_id", "left_anti").agg(F.min("user_id").alias("user_id"))


def vector_topk(queries: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None, block: int = 8192, at_once: int = 8192) -> DataFrame:
    """For each query (query_id, vector) the ``k`` items (item_id, vector) of largest inner product; ties: smaller id.

    Items in ``seen`` (query_id, item_id) are left out for that query. Blocks of ``block`` queries meet blocks of ``at_once`` items in
    the executors (``search``). The driver gets neither.
    """
    import numpy as np

    qs = queries.select("query_id", "vector")
    if seen is None:
        qs = qs.withColumn("seen", F.lit(None).cast("array<long>"))
    else:
        lists = seen.groupBy("query_id").agg(F.collect_set(F.col("item_id").cast("long")).alias("seen"))
        qs = qs.join(lists, "query_id", "left")
    single = all(dict(f.dtypes)["vector"] == "array<float>" for f in (queries, items))
    dtype = np.float32 if single else np.float64
    left = cut(qs.select(F.col("query_id").cast("long").alias("id"), "vector", "seen").mapInArrow(packed(block, dtype), BLOCKS), "queries")
    none = F.lit(None).cast("array<long>").alias("seen")
    right = cut(items.select(F.col("item_id").cast("long").alias("id"), "vector", none).mapInArrow(packed(at_once, dtype), BLOCKS), "items")
    return search(left, right, k, dtype, at_once)


def profiles(history: DataFrame, items: DataFrame) -> DataFrame:
    """Mean unit vector of the items in each user's history."""
    units = cut(items.select("item_id", unit(F.col("vector")).alias("u")), "units")
    return mean_vectors(history.select("user_id", "item_id").join(units, "item_id"), "user_id", "u")


def content_recommend(users: DataFrame, history: DataFrame, items: DataFrame, seen: DataFrame, ratings: DataFrame, k: int = 5) -> DataFrame:
    """``k`` unseen items per user by cosine to the profile; users without history get the popular items."""
    prof = cut(profiles(history.join(users.select("user_id"), "user_id", "left_semi"), items), "profiles")
    unit_items = items.select("item_id", unit(F.col("vector")).alias("vector"))
    asked = prof.select(F.col("user_id").alias("query_id"), F.col("profile").alias("vector"))
    fresh = vector_topk(asked, unit_items, k, seen.select(F.col("user_id").alias("query_id"), "item_id")).withColumnRenamed("query_id", "user_id")
    cold = users.select("user_id").join(prof.select("user_id"), "user_id", "left_anti")
    top = popular(ratings, k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))
    return fresh.withColumn("source", F.lit("content")).unionByName(cold.join(F.broadcast(top), F.lit(True)).select("user_id", "item_id", F.col("n").cast("double").alias("score"), "rank", F.lit("popular").alias("source")))


def als_recommend(ratings: DataFrame, k: int, factors: int = 64, reg: float = 0.01, iterations: int = 20, seed: int = 42) -> DataFrame:
    """Implicit matrix factorisation; ``k`` unseen items per user.

    Spark's ALS gives the start, ``factors.train`` its iterations, block by block; each is a written table, and the one before it goes.
    The factors are then searched like any vectors, without what the user has rated well.
    """
    import numpy as np
    from pyspark.ml.recommendation import ALS

    spark = ratings.sparkSession
    pos = cut(positives(ratings).select(F.col("user_id").cast("int"), F.col("item_id").cast("int")), "positives")
    blocks = max(4, -(-pos.count() // PER_BLOCK))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    als = ALS(rank=factors, regParam=reg, maxIter=iterations, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="value", seed=seed, coldStartStrategy="drop", numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=1)
    asked, items = train(als, pos)
    recs = search(asked, items, k, np.float32, ITEMS_HELD)
    return recs.select(F.col("query_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), F.col("score").cast("float").alias("score"), "rank")


def titles(lists: DataFrame, items: DataFrame) -> DataFrame:
    """``lists`` (user_id, pos, item_id) to one line per user; unknown items read ``Unknown (id)``."""
    named = lists.join(items.select("item_id", "title"), "item_id", "left").withColumn("t", F.coalesce("title", F.format_string("Unknown (%d)", "item_id")))
    return named.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), " | ").alias("titles"))


__all__ = [n for n in dir() if not n.startswith("_") and n != "dot"]
