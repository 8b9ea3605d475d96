"""Samples, chosen cutoffs, curves, index maps and records as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, order, recommend, sample, stats
from ..session import cut, table
from .daily import events
from .ranking import _R, _S, _r, _scored, ratings
from .registry import query

_U = "CAST('0x' || substr(md5('{seed}|' || {key}), 1, 8) AS BIGINT)"


@query(f"SELECT c_custkey FROM customer WHERE {_U.format(seed=42, key='c_custkey')} < 42949672")
def sample_fraction(spark, d):
    return sample.fraction(table(spark, d, "customer"), "c_custkey", 0.01).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('1|' || o_orderkey), o_orderkey LIMIT 500")
def sample_exact(spark, d):
    return sample.exact(table(spark, d, "orders"), "o_orderkey", 500, 1).select("o_orderkey", "o_custkey")


@query(f"SELECT o_orderkey, CASE WHEN {_U.format(seed=42, key='o_orderkey')} < 1073741824 THEN 'test' ELSE 'train' END AS part FROM orders")
def random_split(spark, d):
    return sample.split(table(spark, d, "orders"), "o_orderkey", 0.25).select("o_orderkey", "part")


@query(f"WITH {_R}, n AS (SELECT user_id, count(*) AS n FROM r GROUP BY 1) SELECT user_id, n FROM n WHERE n >= (SELECT quantile_cont(n, 0.95) FROM n) ORDER BY md5('42|' || user_id), user_id LIMIT 1")
def top_user_drawn(spark, d):
    return sample.exact(recommend.top_users(ratings(spark, d)), "user_id", 1)


@query(f"WITH {_R} SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC, rating DESC) AS rn FROM r) WHERE rn <= 10 AND rating >= 4")
def recent_positives(spark, d):
    return recommend.recent_positives(ratings(spark, d), 10).select("user_id", "item_id")


_CUT = """p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS pos FROM events GROUP BY 1),
c AS (SELECT day, CAST(sum(n) OVER w AS BIGINT) AS train_n, CAST(sum(n) OVER () - sum(n) OVER w AS BIGINT) AS test_n,
 CAST(sum(pos) OVER w AS BIGINT) AS train_pos, CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS test_pos FROM p WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))"""


def _per_day(spark, d):
    return events(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("pos"))


def _chosen(train: int, test: int, pos: int) -> str:
    ok = f"(train_n >= {train} AND test_n >= {test} AND train_pos >= {pos} AND test_pos >= {pos})"
    near = f"least(train_n / {train}::DOUBLE, 1) + least(test_n / {test}::DOUBLE, 1) + least(train_pos / {pos}::DOUBLE, 1) + least(test_pos / {pos}::DOUBLE, 1)"
    return f"WITH {_CUT} SELECT *, {ok} AS ok FROM c ORDER BY {ok} DESC, CASE WHEN {ok} THEN 0 ELSE -round({near}, 9) END, day DESC LIMIT 1"


@query(_chosen(500, 200, 20))
def cutoff_chosen(spark, d):
    return stats.choose_cutoff(_per_day(spark, d), 500, 200, 20)


@query(_chosen(10**9, 200, 20))
def cutoff_nearest(spark, d):
    return stats.choose_cutoff(_per_day(spark, d), 10**9, 200, 20)


@query(f"""WITH {_S}, v AS (SELECT score, CAST(sum(truth) AS BIGINT) AS pos, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT score, sum(pos) OVER w AS pa, sum(n) OVER w AS na, sum(pos) OVER () AS p, sum(n) OVER () AS t FROM v WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score, round(pa / p::DOUBLE, 6) AS tpr, round((na - pa) / (t - p)::DOUBLE, 6) AS fpr, round(pa / na::DOUBLE, 6) AS precision FROM c""")
def curve_points(spark, d):
    return _r(evaluate.curve_points(_scored(spark, d)))


@query(f"""WITH {_S}, k AS (SELECT truth, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM s), h AS (SELECT k, sum(truth) OVER (ORDER BY k) AS hits FROM k)
SELECT CAST(k AS BIGINT) AS k, CAST(hits AS BIGINT) AS hits, round(hits / k::DOUBLE, 6) AS precision, round(hits / (SELECT sum(truth) FROM s)::DOUBLE, 6) AS recall, round(hits / k::DOUBLE / (SELECT avg(truth) FROM s), 6) AS lift FROM h""")
def hits_at_every_k(spark, d):
    return _r(evaluate.curve_at_every_k(_scored(spark, d), "score", "doc_id", "truth"))


@query(f"WITH {_R}, i AS (SELECT DISTINCT item_id FROM r) SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, round(coalesce(list_sum(embedding::DOUBLE[]), 0), 3) AS total FROM i LEFT JOIN embeddings ON vec_id = item_id")
def item_index_vectors(spark, d):
    items = ratings(spark, d).select("item_id").distinct()
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    out = order.indexed(items, "item_id").join(vectors, "item_id", "left")
    return out.select("item_id", "idx", F.round(F.coalesce(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(0.0)), 3).alias("total"))


@query("SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown FROM orders")
def epoch_and_format(spark, d):
    text = F.date_format("o_orderdate", "MM/dd/yyyy")
    return table(spark, d, "orders").select("o_orderkey", F.unix_timestamp(text, "MM/dd/yyyy").alias("seconds"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("""SELECT c_custkey, '{"id":' || c_custkey || ',"segment":"' || c_mktsegment || '"}' AS record FROM customer""")
def json_records(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("record"))


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_rows(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).filter("n > 1")
