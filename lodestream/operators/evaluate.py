"""Ranking and classification measures as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order import running


def recall_ndcg(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One held-out item per user: share found in the first ``k``, and mean of 1/log2(rank + 1) with rank from 1."""
    hit = truth.select("user_id", "item_id").join(recs.filter(F.col("rank") <= k).select("user_id", "item_id", "rank"), ["user_id", "item_id"], "left")
    return hit.agg(F.count("*").alias("users"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))).alias("ndcg"))


def _counts(guess, truth):
    g, t = guess == 1, truth == 1
    return [F.count_if(g & t).alias("tp"), F.count_if(g & ~t).alias("fp"), F.count_if(~g & t).alias("fn"), F.count_if(~g & ~t).alias("tn")]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, false positive and negative rate; null where undefined."""
    return df.withColumns(
        {
            "precision": F.try_divide("tp", F.col("tp") + F.col("fp")),
            "recall": F.try_divide("tp", F.col("tp") + F.col("fn")),
            "fpr": F.try_divide("fp", F.col("fp") + F.col("tn")),
            "fnr": F.try_divide("fn", F.col("fn") + F.col("tp")),
        }
    )


def confusion(df: DataFrame, guess: str = "guess", truth: str = "truth") -> DataFrame:
    return rates(df.agg(*_counts(F.col(guess), F.col(truth))))


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """Counts and rates at each threshold in one pass: rows are counted by how many thresholds they reach."""
    ts = sorted(thresholds)
    steps = F.array(*[F.lit(float(t)) for t in ts])
    reach = F.size(F.filter(steps, lambda t: F.col(score) >= t))
    by = df.groupBy(reach.alias("reach")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == 1).alias("pos"))
    grid = by.select(F.explode(F.sequence(F.lit(1), F.lit(len(ts)))).alias("i"), "reach", "n", "pos")
    at = F.col("reach") >= F.col("i")
    out = grid.groupBy("i").agg(
        F.coalesce(F.sum(F.when(at, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(at, F.col("n") - F.col("pos"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~at, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~at, F.col("n") - F.col("pos"))), F.lit(0)).alias("tn"),
    )
    return rates(out.withColumn("threshold", F.element_at(steps, F.col("i"))).drop("i"))


def best_f1(df: DataFrame, thresholds: list[float], score: str = "score", truth: str = "truth") -> DataFrame:
    """The threshold of largest F1; ties: the lowest."""
    s = threshold_sweep(df, thresholds, score, truth).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))
    return s.select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


def value_ranks(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Per distinct score: rows and positives, and both at or above it."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == 1).alias("pos"))
    by = cut(by.withColumn("__down", -F.col("s").cast("double")), "scores")
    return running(by, "__down", "__down", {"n_above": "n", "pos_above": "pos"}).drop("__down")


def roc_auc(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Area under ROC; equal scores count half."""
    v = value_ranks(df, score, truth)
    neg = F.col("n") - F.col("pos")
    won = F.sum(neg * (F.col("pos_above") - F.col("pos") + F.col("pos") / 2))
    return v.agg(F.try_divide(won, F.sum("pos") * F.sum(neg)).alias("auc"), F.sum("pos").alias("n_pos"), F.sum(neg).alias("n_neg"))


def average_precision(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    v = value_ranks(df, score, truth)
    return v.agg(F.try_divide(F.sum(F.col("pos") * F.col("pos_above") / F.col("n_above")), F.sum("pos")).alias("ap"))


def curve_at_k(df: DataFrame, order: list, truth: str, ks: list[int]) -> DataFrame:
    """Precision, recall and lift among the first k by ``order``; only the largest k rows are ranked."""
    total = df.agg(F.count("*").alias("__n"), F.count_if(F.col(truth) == 1).alias("__p"))
    top = df.orderBy(*order).limit(max(ks)).withColumn("k", F.row_number().over(Window.orderBy(*order)))
    hits = F.sum((F.col(truth) == 1).cast("int")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    x = top.withColumn("hits", hits).filter(F.col("k").isin(ks)).join(F.broadcast(total), F.lit(True))
    return x.select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide("hits", "__p").alias("recall"), F.try_divide(F.col("hits") / F.col("k"), F.col("__p") / F.col("__n")).alias("lift"))


def curve_points(df: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Points of the ROC and precision-recall curves: one row per distinct score (tpr is also recall)."""
    v = value_ranks(df, score, truth)
    whole = v.agg(F.sum("pos").alias("__p"), F.sum("n").alias("__t"))
    x = v.join(F.broadcast(whole), F.lit(True))
    false, neg = F.col("n_above") - F.col("pos_above"), F.col("__t") - F.col("__p")
    return x.select(F.col("s").alias("score"), F.try_divide("pos_above", "__p").alias("tpr"), F.try_divide(false, neg).alias("fpr"), (F.col("pos_above") / F.col("n_above")).alias("precision"))


def curve_at_every_k(df: DataFrame, score: str, key: str, truth: str) -> DataFrame:
    """Hits, precision, recall and lift among the first k rows for every k; largest score first, ties by ``key``. No task ranks all rows."""
    rows = cut(df.select((-F.col(score)).alias("__down"), F.col(key).alias("__key"), (F.col(truth) == 1).cast("int").alias("hit")), "hits")
    whole = rows.agg(F.count("*").alias("__n"), F.sum("hit").alias("__p"))
    x = running(rows, "__down", "__key", {"k": "1L", "hits": "hit"}).join(F.broadcast(whole), F.lit(True))
    share = F.col("hits") / F.col("k")
    return x.select("k", "hits", share.alias("precision"), F.try_divide("hits", "__p").alias("recall"), F.try_divide(share, F.col("__p") / F.col("__n")).alias("lift"))


def regression(df: DataFrame, truth: str, guess: str) -> DataFrame:
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    return df.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.avg(F.abs(y - p)).alias("mae"), (1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(y))).alias("r2"))


def gate(df: DataFrame, least: int = 10) -> DataFrame:
    """``df`` (model, n_pos, n_neg, auc, ap, baseline): reliable, beats_baseline, verdict."""
    ok = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    beats = F.col("ap") > F.col("baseline")
    return df.withColumn("reliable", ok).withColumn("beats_baseline", beats).withColumn("verdict", F.when(ok & beats & (F.col("auc") > 0.5), "PASS").otherwise("NEEDS_WORK"))
