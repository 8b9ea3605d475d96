"""Joins, sets, projections, filters, sorting and DML as relations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import store
from ..session import table
from .registry import query, shared

shared("full_outer_days", """SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS events FROM
 (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {orders} GROUP BY 1) a FULL OUTER JOIN
 (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1) b ON a.day = b.day""")
shared("inner_composite", """SELECT a.day, a.user_id, a.n AS views, b.n AS clicks FROM
 (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM {events} WHERE event_type = 'view' GROUP BY 1, 2) a JOIN
 (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY 1, 2) b ON a.day = b.day AND a.user_id = b.user_id""")
shared("inner_dim", "SELECT c_name, n_name, round(sum(o_totalprice), 2) AS spent FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2")
shared("left_default", "SELECT c_custkey, coalesce(n, 0) AS orders FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) x ON c_custkey = o_custkey")
shared("semi_exists_or", """SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') OR
 EXISTS (SELECT 1 FROM {events} WHERE user_id = c_custkey AND event_type = 'purchase') AS has_refs FROM {customer}""")
shared("anti_not_in", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM {orders} WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
shared("scalar_max_day", "SELECT user_id, count(*) AS n FROM {events} WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM {events}) GROUP BY 1")
shared("remap_reaggregate", "SELECT m.new_id, count(*) AS n FROM {events} e JOIN (SELECT DISTINCT user_id, user_id % 10 AS new_id FROM {events} UNION ALL SELECT DISTINCT user_id, 100 + user_id % 7 FROM {events}) m ON e.user_id = m.user_id GROUP BY 1")
shared(
    "unnest_ordinality",
    "SELECT p_partkey, CAST(i AS BIGINT) AS ord, string_split(p_name, ' ')[i] AS word FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM {part})",
    "SELECT p_partkey, CAST(pos + 1 AS BIGINT) AS ord, word FROM {part} LATERAL VIEW posexplode(split(p_name, ' ', -1)) x AS pos, word",
)
shared("index_lookup_ordered", "SELECT u.pos, u.id, p.p_name FROM (VALUES (0, 5), (1, 3), (2, 99999999), (3, 8)) AS u(pos, id) JOIN {part} p ON u.id = p.p_partkey")
shared("cte_chain", """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM {orders} GROUP BY 1), b AS (SELECT *, rank() OVER (ORDER BY s DESC, o_custkey) AS r FROM a)
SELECT o_custkey, n, round(s, 2) AS s FROM b WHERE r <= 100""")
shared("alias_lookup", "SELECT e.event_type, m.id FROM (SELECT DISTINCT lower(trim(event_type)) AS event_type FROM {events}) e LEFT JOIN (VALUES ('view', 1), ('click', 2)) AS m(name, id) ON e.event_type = m.name")
shared("first_seen_dim", "SELECT o_custkey, min(o_orderkey) AS first_order, min_by(o_orderpriority, o_orderkey) AS priority FROM {orders} GROUP BY 1")
shared(
    "ordered_array_agg",
    "SELECT o_custkey, array_to_string(list(o_orderpriority ORDER BY f, o_orderpriority), '|') AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM {orders} GROUP BY 1, 2) GROUP BY 1",
    "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(f, o_orderpriority))), s -> s.o_orderpriority), '|') AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f FROM {orders} GROUP BY 1, 2) GROUP BY 1",
)
shared("min_nonempty", "SELECT c_nationkey, min(nullif(trim(c_name), '')) AS name FROM {customer} GROUP BY 1")
shared("min_key_missing", "SELECT min(c_custkey) AS cold FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders})")
shared("union_partitions", "SELECT i, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, 0 AS i FROM {orders} WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_totalprice, 1 FROM {orders} WHERE o_orderkey % 3 <= 1 UNION ALL SELECT o_totalprice, 2 FROM {orders}) GROUP BY 1")
shared("set_union_ids", "SELECT o_custkey AS id FROM {orders} UNION SELECT user_id FROM {events}")
shared("set_difference", "SELECT c_custkey AS id FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
shared("intersect_ids", "SELECT o_custkey AS id FROM {orders} INTERSECT SELECT user_id FROM {events}")
shared(
    "ordered_dedup",
    "SELECT p_partkey, array_to_string(list(w ORDER BY i), ' ') AS words FROM (SELECT p_partkey, w, min(i) AS i FROM (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS w FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM {part})) GROUP BY 1, 2) GROUP BY 1",
    "SELECT p_partkey, array_join(array_distinct(split(p_name, ' ', -1)), ' ') AS words FROM {part}",
)
shared("project_rename_cast", "SELECT l_orderkey AS order_id, CAST(l_quantity AS INT) AS quantity, l_extendedprice * (1 - l_discount) > 10000 AS large, 1.0 AS weight FROM {lineitem}".replace("1.0 AS", "CAST(1 AS DOUBLE) AS"))
shared("try_cast_numbers", "SELECT p_partkey, TRY_CAST(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR(9)) END AS INT) AS n FROM {part}")
shared("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM {orders}")
shared("half_open_range", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
shared("ilike_contains", "SELECT p_partkey FROM {part} WHERE p_name ILIKE '%A%' AND coalesce(contains(upper(p_type), 'E'), false)")
shared("not_equal_keeps_null", "SELECT o_orderstatus, count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS o_orderstatus FROM {orders}) WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1")
shared("hash_sample", "SELECT c_custkey FROM {customer} WHERE (c_custkey * 2654435761) % 1000 < 300")
shared("multi_key_sort_topk", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM {orders} ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey LIMIT 50")
shared("topk_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS BIGINT) AS rn FROM {orders}) WHERE rn <= 3")
shared("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}")
shared(
    "json_first_key",
    "SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS v FROM {events}",
    "SELECT event_id, coalesce(get_json_object(props, '$.missing'), get_json_object(props, '$.k')) AS v FROM {events}",
)
shared("document_find", "SELECT c_custkey, c_name FROM {customer} WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")


def _facts(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).groupBy("day", "user_id", F.col("event_type").alias("dump_id")).agg(F.count("*").alias("n"))


_F = "SELECT CAST(ts AS DATE) AS day, user_id, event_type AS dump_id, count(*) AS n FROM events GROUP BY ALL"


def _customers(spark, d):
    c = table(spark, d, "customer")
    old = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.lit(True).alias("synthetic"))
    new = c.filter("c_custkey % 3 <> 1").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit("*"))).alias("name"), F.lit(False).alias("synthetic"))
    return old, new


_OLD = "old AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, true AS synthetic FROM customer WHERE c_custkey % 3 <> 0)"
_NEW = "new AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_name || '*' END AS name, false AS synthetic FROM customer WHERE c_custkey % 3 <> 1)"


@query(f"WITH {_OLD}, {_NEW} SELECT c_custkey, coalesce(n.name, o.name) AS name, coalesce(n.synthetic, o.synthetic) AS synthetic FROM old o FULL JOIN new n USING (c_custkey)")
def upsert_prefer_new(spark, d):
    return store.merge(*_customers(spark, d), ["c_custkey"], "new", ("synthetic",))


@query(f"WITH {_OLD}, {_NEW} SELECT c_custkey, coalesce(o.name, n.name) AS name, coalesce(o.synthetic, n.synthetic) AS synthetic FROM old o FULL JOIN new n USING (c_custkey)")
def upsert_keep_old(spark, d):
    return store.merge(*_customers(spark, d), ["c_custkey"], "old")


@query(f"WITH f AS ({_F}) SELECT day, user_id, dump_id, CASE WHEN dump_id = 'view' THEN n * 2 ELSE n END AS n FROM f")
def fact_upsert_replace(spark, d):
    f = _facts(spark, d)
    return store.merge(f, f.filter("dump_id = 'view'").withColumn("n", F.col("n") * 2), ["day", "user_id", "dump_id"])


@query(f"WITH f AS ({_F}) SELECT * FROM f WHERE day >= DATE '2024-01-20'")
def prune_before(spark, d):
    return store.prune(_facts(spark, d), datetime.date(2024, 1, 20))


@query(f"WITH f AS ({_F}) SELECT day, user_id, dump_id, CASE WHEN day >= DATE '2024-01-20' THEN n + 1 ELSE n END AS n FROM f")
def window_replace(spark, d):
    f = _facts(spark, d)
    return store.replace_window(f, f.withColumn("n", F.col("n") + 1), datetime.date(2024, 1, 20))


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
def insert_on_conflict_nothing(spark, d):
    return store.insert_missing(*_customers(spark, d), ["c_custkey"])


@query(f"WITH {_OLD}, {_NEW} SELECT c_custkey, coalesce(n.name, o.name) AS name, o.synthetic FROM old o LEFT JOIN new n USING (c_custkey)")
def update_from(spark, d):
    return store.update_from(*_customers(spark, d), ["c_custkey"], ["name"])


@query("SELECT c_custkey, c_nationkey AS name_key, CAST(rn AS BIGINT) AS rn FROM (SELECT c_custkey, c_nationkey, c_acctbal > 0 AS has_refs, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0 DESC, c_custkey) AS rn FROM customer) WHERE rn > 1 AND NOT has_refs")
def delete_using(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).alias("has_refs"))
    s = store.survivors(c, F.col("c_nationkey"), "has_refs", "c_custkey").filter("rn > 1 and not has_refs")
    return s.select("c_custkey", "name_key", F.col("rn").cast("long").alias("rn"))


@query("SELECT c_nationkey, min_by(c_custkey, (CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END) * 1000000000 + c_custkey) AS c_custkey FROM customer GROUP BY 1")
def dedup_survivor(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") > 0).alias("has_refs"))
    return store.survivors(c, F.col("c_nationkey"), "has_refs", "c_custkey").filter("rn = 1").select("c_nationkey", "c_custkey")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name LIKE 'A%') THEN 'X' ELSE r_name END AS r_name FROM region")
def update_one(spark, d):
    return store.update_one(table(spark, d, "region").select("r_regionkey", "r_name"), F.col("r_name").like("A%"), ["r_regionkey"], {"r_name": "X"})


@query("SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> (SELECT min(r_regionkey) FROM region WHERE r_name LIKE 'A%')")
def delete_one(spark, d):
    return store.delete_one(table(spark, d, "region").select("r_regionkey", "r_name"), F.col("r_name").like("A%"), ["r_regionkey"])
