"""Recommendation over orders as ratings, vectors, evaluation, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot, unit
from ..operators import evaluate, models, order, recommend
from ..operators import stats as st
from ..session import cut, table
from .daily import daily
from .registry import query, shared


def ratings(spark, d):
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (1 + F.col("l_quantity").cast("int") % 5).alias("rating"), F.col("o_orderdate").alias("ts"), F.col("l_orderkey"), F.col("l_linenumber")
    )


_R = "r AS (SELECT o_custkey AS user_id, l_partkey AS item_id, 1 + CAST(l_quantity AS INT) % 5 AS rating, o_orderdate AS ts FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"WITH {_R} SELECT user_id, count(*) AS n FROM r WHERE rating >= 4 GROUP BY 1")
def positive_interactions(spark, d):
    return recommend.positives(ratings(spark, d)).groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {_R} SELECT user_id, item_id FROM r WHERE rating >= 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) = 1")
def last_positive_holdout(spark, d):
    return recommend.holdout_last(recommend.positives(ratings(spark, d))).filter("held").select("user_id", "item_id")


@query(f"WITH {_R} SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS INT) AS rn FROM r QUALIFY rn <= 10")
def last_n_per_user(spark, d):
    return recommend.last_n(ratings(spark, d), 10).select("user_id", "item_id", "rn")


@query(f"WITH {_R} SELECT item_id, count(*) AS n FROM r WHERE rating >= 4 GROUP BY 1 ORDER BY n DESC, item_id LIMIT 20")
def popular_items(spark, d):
    return recommend.popular(ratings(spark, d), 20)


@query("SELECT min(c_custkey) AS user_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)")
def cold_user(spark, d):
    return recommend.cold_user(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), ratings(spark, d))


@query(f"WITH {_R}, n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1) SELECT * FROM n WHERE n >= (SELECT quantile_cont(n, 0.95) FROM n)")
def top5pct_users(spark, d):
    return recommend.top_users(ratings(spark, d))


def _items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


@query("""SELECT query_id, item_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE rank <= 10""")
def similar_items(spark, d):
    items = _items(spark, d)
    q = items.filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vector")
    return recommend.vector_topk(q, items, 10).select("query_id", "item_id", F.round("score", 4).alias("score"), "rank")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def vector_norms(spark, d):
    u = unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(dot(u, u)), 4).alias("norm"))


_PROF = "p AS (SELECT label, i, avg(embedding[i]) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY 1, 2)"


@query(f"WITH {_PROF} SELECT label, round(sqrt(sum(x * x)), 4) AS length FROM p GROUP BY 1")
def mean_profiles(spark, d):
    from ..functions.vectors import mean_vectors

    m = mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", F.round(F.sqrt(dot(F.col("profile"), F.col("profile"))), 4).alias("length"))


def _history(spark, d):
    """All positives of items that have a vector."""
    return recommend.positives(ratings(spark, d)).select("user_id", "item_id", "ts").join(_items(spark, d).select("item_id"), "item_id", "left_semi")


@query()
def content_recommend(spark, d):
    h = cut(_history(spark, d), "history")
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return recommend.content_recommend(users, h, _items(spark, d), h, ratings(spark, d), 5)


@query()
def recall_ndcg(spark, d):
    held = cut(recommend.holdout_last(_history(spark, d)), "held")
    train, truth = held.filter("not held"), held.filter("held")
    recs = recommend.content_recommend(train.select("user_id").distinct(), train, _items(spark, d), train, ratings(spark, d), 10)
    return evaluate.recall_ndcg(recs, truth, 10)


@query()
def als_recommend(spark, d):
    return recommend.als_recommend(ratings(spark, d), 5)


@query(f"WITH {_R} SELECT c_custkey AS user_id, c_mktsegment, count(rating) AS n, round(avg(rating), 4) AS mean_rating FROM customer LEFT JOIN r ON c_custkey = user_id GROUP BY 1, 2")
def user_summary(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return c.join(ratings(spark, d), "user_id", "left").groupBy("user_id", "c_mktsegment").agg(F.count("rating").alias("n"), F.round(F.avg("rating"), 4).alias("mean_rating"))


@query(f"WITH {_R}, t AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS pos FROM r QUALIFY pos <= 3) SELECT user_id, string_agg(coalesce(p_name, 'Unknown (' || item_id || ')'), ' | ' ORDER BY pos, p_name) AS titles FROM t LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 > 0) ON p_partkey = item_id GROUP BY 1")
def title_lists(spark, d):
    lists = recommend.last_n(ratings(spark, d), 3).select("user_id", F.col("rn").alias("pos"), "item_id")
    items = table(spark, d, "part").filter("p_partkey % 4 > 0").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"))
    return recommend.titles(lists, items)


def _scored(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("toxic").alias("truth"), (F.col("n_chars") % 1000 / 1000.0).alias("score"))


_S = "s AS (SELECT doc_id, toxic AS truth, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_T = [round(0.5 + 0.02 * i, 2) for i in range(25)] + [0.99]
_RATES = "round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS fpr, round(fn / nullif(fn + tp, 0)::DOUBLE, 6) AS fnr"
_CONF = "count(*) FILTER (score >= {t} AND truth = 1) AS tp, count(*) FILTER (score >= {t} AND truth = 0) AS fp, count(*) FILTER (score < {t} AND truth = 1) AS fn, count(*) FILTER (score < {t} AND truth = 0) AS tn"


def _r(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {_S}, c AS (SELECT {_CONF.format(t=0.7)} FROM s) SELECT *, {_RATES} FROM c")
def confusion(spark, d):
    return _r(evaluate.confusion(_scored(spark, d).withColumn("guess", (F.col("score") >= 0.7).cast("int"))))


@query(f"WITH {_S}, t AS (SELECT unnest({_T})::DOUBLE AS threshold), c AS (SELECT threshold, {_CONF.format(t='threshold')} FROM s, t GROUP BY 1) SELECT *, {_RATES} FROM c")
def threshold_sweep(spark, d):
    return _r(evaluate.threshold_sweep(_scored(spark, d), _T))


@query(f"WITH {_S}, t AS (SELECT unnest({_T})::DOUBLE AS threshold), c AS (SELECT threshold, {_CONF.format(t='threshold')} FROM s, t GROUP BY 1) SELECT threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1(spark, d):
    return _r(evaluate.best_f1(_scored(spark, d), _T))


@query(f"WITH {_S}, p AS (SELECT score, truth FROM s WHERE truth = 1), n AS (SELECT score FROM s WHERE truth = 0) SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc, (SELECT count(*) FROM p) AS n_pos, (SELECT count(*) FROM n) AS n_neg FROM p, n")
def roc_auc(spark, d):
    return _r(evaluate.roc_auc(_scored(spark, d)))


@query(f"WITH {_S}, v AS (SELECT score, sum(truth) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS pa, sum(n) OVER w AS na FROM v WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT round(sum(pos * pa / na::DOUBLE) / sum(pos), 6) AS ap FROM c")
def avg_precision(spark, d):
    return _r(evaluate.average_precision(_scored(spark, d)))


@query(f"""WITH {_S}, k AS (SELECT truth, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM s), h AS (SELECT k, sum(truth) OVER (ORDER BY k) AS hits FROM k)
SELECT CAST(k AS INT) AS k, CAST(hits AS BIGINT) AS hits, round(hits / k::DOUBLE, 6) AS precision, round(hits / (SELECT sum(truth) FROM s)::DOUBLE, 6) AS recall, round(hits / k::DOUBLE / (SELECT avg(truth) FROM s), 6) AS lift FROM h WHERE k IN (5, 10, 20, 50)""")
def precision_lift_at_k(spark, d):
    return _r(evaluate.curve_at_k(_scored(spark, d), [F.desc("score"), F.col("doc_id")], "truth", [5, 10, 20, 50]))


shared("entity_eval", """SELECT source, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count(*) AS n, max(truth) AS any_true FROM
 (SELECT d.source, (d.n_chars % 1000) / CAST(1000.0 AS DOUBLE) AS score, l.toxic AS truth FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id) GROUP BY 1""")


@query("SELECT user_id, n, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS BIGINT) AS rk, row_number() OVER (ORDER BY n DESC, user_id) <= ceil(0.05 * count(*) OVER ()) AS top5 FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def top_share_flag(spark, d):
    n = cut(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (-F.count("*")).alias("down")), "user-counts")
    whole = n.agg(F.ceil(F.count("*") * 0.05).alias("most"))
    return order.running(n, "down", "user_id", {"rk": "1L"}).join(F.broadcast(whole), F.lit(True)).select("user_id", "n", "rk", (F.col("rk") <= F.col("most")).alias("top5"))


shared("daily_pred_vs_actual", "SELECT day, round(avg(pred), 6) AS pred, round(avg(act), 6) AS act FROM (SELECT CAST(ts AS DATE) AS day, value AS act, avg(value) OVER (PARTITION BY user_id) AS pred FROM {events}) GROUP BY 1")
shared("regression_errors", "SELECT round(sqrt(avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity))), 4) AS rmse, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae FROM {lineitem}")


@query(f"""WITH {_S}, c AS (SELECT 'length' AS model, sum(truth) AS n_pos, count(*) - sum(truth) AS n_neg, avg(truth) AS baseline FROM s),
v AS (SELECT score, sum(truth) AS pos, count(*) AS n FROM s GROUP BY 1), w AS (SELECT pos, n, sum(pos) OVER x AS pa, sum(n) OVER x AS na FROM v WINDOW x AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
m AS (SELECT sum(pos * pa / na::DOUBLE) / sum(pos) AS ap, sum((n - pos) * (pa - pos + pos / 2.0)) / (sum(pos) * sum(n - pos))::DOUBLE AS auc FROM w)
SELECT model, n_pos >= 10 AND n_neg >= 10 AS reliable, ap > baseline AS beats_baseline, CASE WHEN n_pos >= 10 AND n_neg >= 10 AND ap > baseline AND auc > 0.5 THEN 'PASS' ELSE 'NEEDS_WORK' END AS verdict FROM c, m""")
def model_gate(spark, d):
    s = _scored(spark, d)
    x = evaluate.roc_auc(s).join(F.broadcast(evaluate.average_precision(s)), F.lit(True)).join(F.broadcast(s.agg(F.avg("truth").alias("baseline"))), F.lit(True))
    return evaluate.gate(x.withColumn("model", F.lit("length"))).select("model", "reliable", "beats_baseline", "verdict")


@query()
def gbt_classifier(spark, d):
    x = daily(spark, d)
    s = st.daily_stats(x, "user_id")
    f = st.features(s, x, "user_id").join(st.targets(s, "user_id", 0.95, 10).select("day", "user_id", "is_popular_7d"), ["day", "user_id"])
    cols = ["momentum_7d", "velocity_ratio", "ma_7", "std_7", "log_listens"]
    m = models.gbt_classifier(f, cols, "is_popular_7d", depth=3, rounds=5)
    return m.transform(f.na.fill(0.0, cols).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})).select("day", "user_id", "prediction")


_TREE = ["momentum_7d", "velocity_ratio", "ma_7", "std_7", "log_listens"]


def _labelled(spark, d):
    x = daily(spark, d)
    s = st.daily_stats(x, "user_id")
    f = st.features(s, x, "user_id").join(st.targets(s, "user_id", 0.95, 10).select("day", "user_id", "future_growth_pctl_7d"), ["day", "user_id"])
    return f.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _TREE})


@query()
def gbt_regressor(spark, d):
    x = _labelled(spark, d)
    m = models.gbt_regressor(x, _TREE, "future_growth_pctl_7d", depth=3, rounds=5)
    return m.transform(x).select("day", "user_id", "prediction")


@query()
def feature_importance(spark, d):
    m = models.gbt_regressor(_labelled(spark, d), _TREE, "future_growth_pctl_7d", depth=3, rounds=5)
    return spark.createDataFrame(models.importances(m, _TREE), "feature string, importance double")


@query("""WITH x AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), s AS (SELECT day, n, least(CAST(floor((row_number() OVER (ORDER BY day) - 1) * 5 / CAST(count(*) OVER () AS DOUBLE)) AS INT), 4) AS s FROM x)
SELECT CAST(f AS INT) AS fold, CASE WHEN s < f THEN 'train' ELSE 'test' END AS part, CAST(sum(n) AS BIGINT) AS n FROM s, (SELECT unnest(range(1, 5)) AS f) WHERE s <= f GROUP BY 1, 2""")
def time_folds(spark, d):
    x = table(spark, d, "events").select(F.to_date("ts").alias("day"))
    return models.expanding_folds(x, "day", 4).groupBy("fold", "part").agg(F.count("*").alias("n"))


@query()
def ridge_forecast(spark, d):
    return models.forecast(daily(spark, d), "day", "listen_count", 7, 5, "user_id")


@query()
def exponential_smoothing(spark, d):
    return models.smooth(daily(spark, d), "day", "listen_count", "user_id", 0.3).select("user_id", "day", F.round("level", 6).alias("level"))
