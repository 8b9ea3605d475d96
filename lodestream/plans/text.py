"""Text, identity, date and source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import identity
from ..sources import readers
from ..session import table
from .registry import query, shared


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


@query("SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS token FROM documents")
def norm_token(spark, d):
    return _docs(spark, d).select("doc_id", t.norm_token(F.col("text")).alias("token"))


@query()
def norm_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(t.norm_text(F.col("text"))).alias("digest"))


_CREDIT = "concat_ws('', p_name, CASE p_partkey % 4 WHEN 0 THEN ' feat. ' WHEN 1 THEN ' & ' WHEN 2 THEN ', ' ELSE ' with ' END, p_brand)"


@query()
def credit_split(spark, d):
    c = F.expr(_CREDIT)
    return table(spark, d, "part").select("p_partkey", F.posexplode(t.split_credit(c)).alias("pos", "name"))


@query("SELECT p_partkey, p_partkey % 3 > 0 AND NOT (regexp_full_match(replace(a, ' ', ''), '[A-Z0-9]+') AND regexp_full_match(replace(b, ' ', ''), '[A-Z0-9]+')) AND NOT regexp_matches(a || b, '[^A-Za-z0-9 ]') AS split FROM (SELECT p_partkey, p_name AS a, replace(p_brand, '#', '') AS b FROM part)")
def slash_split(spark, d):
    pair = F.concat("p_name", F.when(F.col("p_partkey") % 3 > 0, F.lit("/")).otherwise(F.lit("//")), F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, d, "part").select("p_partkey", (F.size(t.split_slash(pair)) == 2).alias("split"))


@query()
def collab_flags(spark, d):
    flags = t.name_flags(F.expr(_CREDIT))
    return table(spark, d, "part").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT n_nationkey, sha1(unhex('4f7f8d9c9f4f4f078fa6a1f6ef8f9f3a') || encode(lower(trim(n_name)))) AS h FROM nation)
SELECT n_nationkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5(spark, d):
    return table(spark, d, "nation").select("n_nationkey", t.uuid5(F.col("n_name")).alias("id"))


_UUID = "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
_SHA = "sha1(unhex('4f7f8d9c9f4f4f078fa6a1f6ef8f9f3a') || encode(lower(trim({c}))))"


@query(f"""WITH h AS (SELECT c_custkey, c_name, c_mktsegment, {_SHA.format(c="c_name")} AS a, {_SHA.format(c="c_mktsegment")} AS b FROM customer)
SELECT c_custkey, CAST(0 AS INT) AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'id-' || c_custkey ELSE {_UUID.format(h="a")} END AS entity_id, c_name AS entity_name, c_custkey % 3 > 0 AS derived FROM h
UNION ALL SELECT c_custkey, CAST(1 AS INT), CASE WHEN c_mktsegment = 'BUILDING' THEN 'seg-1' ELSE {_UUID.format(h="b")} END, c_mktsegment, c_mktsegment <> 'BUILDING' FROM h""")
def credit_entities(spark, d):
    c = table(spark, d, "customer")
    x = c.select("c_custkey", F.concat("c_name", F.lit(" feat. "), "c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit("id-"), F.col("c_custkey").cast("string")))).alias("ids"))
    return identity.entities(x, "c_custkey", "name", "ids", spark.createDataFrame([("building", "seg-1")], "token string, entity_id string"))


@query()
def identity_remap(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit("Group "), (F.col("s_suppkey") % 50).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" & Group "), (F.col("s_suppkey") % 77).cast("string"))).otherwise(F.lit("")))
    return identity.remap(s.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("entity_id"), name.alias("name")))


@query("SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN p_brand END), ''), CASE WHEN p_partkey % 3 > 0 THEN 'fallback::' || p_name || '||' || p_type || '||' || p_brand END) AS id FROM part")
def recording_key(spark, d):
    even, third = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", t.recording_key(even, third, F.col("p_type"), F.col("p_brand")).alias("id"))


_FORMS = [("%Y-%m-%d", "yyyy-MM-dd"), ("%Y/%-m/%-d", "yyyy/M/d"), ("%Y-%m", "yyyy-MM"), ("%Y", "yyyy")]


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(date_trunc('year', o_orderdate) AS DATE) END AS day FROM orders")
def release_date_parse(spark, d):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).when(k == 1, F.date_format("o_orderdate", "yyyy/M/d")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return table(spark, d, "orders").select("o_orderkey", t.release_date(text).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS dump_id FROM orders")
def dump_id_extract(spark, d):
    name = F.concat(F.lit("incremental"), F.when(F.col("o_orderkey") % 5 > 0, F.concat(F.lit("-dump-"), F.col("o_custkey"), F.lit("-20260211"))).otherwise(F.lit("-dump-x-")), F.lit(".tar.zst"))
    return table(spark, d, "orders").select("o_orderkey", t.dump_id(name).alias("dump_id"))


@query("SELECT w AS word, count(*) AS n FROM (SELECT regexp_extract(unnest(string_split(lower(text), ' ')), '[a-z]+') AS w FROM documents) WHERE w <> '' GROUP BY 1")
def word_count(spark, d):
    words = _docs(spark, d).select(F.explode(F.split(F.lower("text"), " ", -1)).alias("x")).select(F.regexp_extract("x", "[a-z]+", 0).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("""SELECT page_id, CAST(count(*) AS BIGINT) AS links, min(h) AS first_href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) GROUP BY 1""")
def html_links(spark, d):
    return readers.links(table(spark, d, "pages")).groupBy("page_id").agg(F.count("*").alias("links"), F.min("href").alias("first_href"))


@query("SELECT p_partkey, CASE WHEN contains(x, 'STEEL') THEN 'STEEL' WHEN contains(x, 'BRASS') THEN 'BRASSWARE' ELSE x END AS name FROM (SELECT p_partkey, upper(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) AS x FROM part)")
def standardise_names(spark, d):
    return table(spark, d, "part").select("p_partkey", t.standardise(F.col("p_type"), [("BRASS", "BRASSWARE"), ("STEEL", "STEEL")]).alias("name"))


@query("SELECT doc_id, CASE WHEN length(text) > 45 THEN left(text, 42) || '...' ELSE text END AS shown FROM documents")
def truncate_display(spark, d):
    return _docs(spark, d).select("doc_id", t.truncate(F.col("text")).alias("shown"))


shared("concat_null_safe", "SELECT p_partkey, concat(coalesce(p_name, ''), ' [SEP] ', coalesce(p_type, '')) AS text FROM {part}")
shared("date_parts", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - INTERVAL 7 DAY AS week_before FROM {events}", "SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_sub(CAST(ts AS DATE), 7) AS TIMESTAMP_NTZ) AS week_before FROM {events}")
shared("epoch_day", "SELECT event_id, CAST(make_timestamp(CAST(1767225600 + event_id * 3600 AS BIGINT) * 1000000) AS DATE) AS day FROM {events}", "SELECT event_id, to_date(timestamp_seconds(1767225600 + event_id * 3600)) AS day FROM {events}")


@query("SELECT 'orders' AS name, 6 AS columns, count(*) AS n FROM orders UNION ALL SELECT 'events', 6, count(*) FROM events")
def table_metadata(spark, d):
    return readers.row_counts(spark, {n: table(spark, d, n) for n in ("orders", "events")})
