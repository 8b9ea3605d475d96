"""Profiles, distributions, imputation and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute, models, order, profile
from ..session import table
from .registry import query, shared

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _round(df, *keep):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem" for c in _COLS))
def describe_cols(spark, d):
    return _round(profile.describe(table(spark, d, "lineitem"), _COLS))


_P = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100.0 * avg(CAST({c} IS NULL AS INT)), 6) AS missing_percent, count(DISTINCT {c}) AS unique_val, CASE WHEN count(DISTINCT {c}) >= 100 THEN 'Continuous' ELSE 'Categorical' END AS var_type FROM customer" for c in _P))
def profile_cols(spark, d):
    return _round(profile.profile(table(spark, d, "customer"), _P))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS n FROM orders" for c in ["o_orderkey", "o_custkey", "o_orderstatus"]))
def null_scan(spark, d):
    return profile.null_scan(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _COLS for b in _COLS))
def corr_matrix(spark, d):
    return _round(profile.correlations(table(spark, d, "lineitem"), _COLS))


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def histogram(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice", 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN (SELECT quantile_cont(o_totalprice, 0.05) FROM orders) AND (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)")
def outlier_trim(spark, d):
    return profile.trim_outliers(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05, 0.95)


_BINS = "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer), x AS (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal <= a THEN 'SMALL' WHEN c_acctbal <= b THEN 'MEDIUM' WHEN c_acctbal <= c THEN 'LARGE' ELSE 'XLARGE' END AS size_bin FROM customer, q)"


@query(f"{_BINS} SELECT c_custkey, size_bin FROM x")
def quartile_bins(spark, d):
    return profile.quartile_bins(table(spark, d, "customer"), "c_acctbal").select("c_custkey", "size_bin")


@query(f"{_BINS} SELECT size_bin, round(avg(CASE WHEN c_acctbal > 5000 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM x GROUP BY 1")
def rate_by_group(spark, d):
    x = profile.quartile_bins(table(spark, d, "customer"), "c_acctbal")
    return x.groupBy("size_bin").agg(F.round(F.avg((F.col("c_acctbal") > 5000).cast("double")), 6).alias("rate"))


_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_STATUS = ["F", "O", "P"]


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in _STATUS) + " FROM orders GROUP BY 1")
def pivot_counts(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", _STATUS).count().na.fill(0)


shared("row_proportions", "SELECT o_orderpriority, o_orderstatus, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY o_orderpriority) AS DOUBLE), 6) AS share FROM {orders} GROUP BY 1, 2")
shared("freq_table", "SELECT p_brand, count(*) AS n FROM {part} WHERE p_brand IS NOT NULL GROUP BY 1")
shared("group_size_with_null", "SELECT nullif(o_orderstatus, 'P') AS status, o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1, 2")
shared("log_histogram", "SELECT CAST(floor(log10(o_totalprice) * 4) AS BIGINT) AS bin, count(*) AS n FROM {orders} WHERE o_totalprice > 0 GROUP BY 1")
shared("group_mean_median", "SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median FROM {part} WHERE p_retailprice > 0 GROUP BY 1")
shared("correlation_difference", "SELECT round(corr(l_quantity, l_extendedprice) - corr(CASE WHEN l_tax > 0.02 THEN l_quantity END, CASE WHEN l_tax > 0.02 THEN l_extendedprice END), 6) AS diff FROM {lineitem}")


@query("SELECT c_custkey, round(row_number() OVER (ORDER BY c_acctbal, c_custkey) / CAST(count(*) OVER () AS DOUBLE), 6) AS cdf FROM customer")
def cdf(spark, d):
    x = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    n = x.agg(F.count("*").alias("n"))
    return order.running(x, "c_acctbal", "c_custkey", {"i": "1"}).join(F.broadcast(n), F.lit(True)).select("c_custkey", F.round(F.col("i") / F.col("n"), 6).alias("cdf"))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicates(spark, d):
    return profile.duplicates(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


_M = "(l_orderkey * 2654435761) % 1000 < 200"


def _masked(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", F.col("l_extendedprice").alias("truth"))
    return x.withColumn("m", impute.hash_mask(F.col("l_orderkey"), 200)).withColumn("v", F.when(~F.col("m"), F.col("truth")))


_MASKED = f"x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, l_extendedprice AS truth, {_M} AS m, CASE WHEN NOT ({_M}) THEN l_extendedprice END AS v FROM lineitem)"


@query(f"WITH {_MASKED} SELECT l_orderkey, l_linenumber, coalesce(v, 0) AS v FROM x")
def impute_constant(spark, d):
    return impute.constant(_masked(spark, d), "v", 0.0).select("l_orderkey", "l_linenumber", "v")


@query(f"WITH {_MASKED} SELECT l_orderkey, l_linenumber, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM x)), 6) AS v FROM x")
def impute_median(spark, d):
    return impute.statistic(_masked(spark, d), "v").select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query(f"WITH {_MASKED} SELECT l_orderkey, l_linenumber, round(coalesce(v, (SELECT avg(v) FROM x)), 4) AS v FROM x")
def impute_mean(spark, d):
    return impute.statistic(_masked(spark, d), "v", "mean").select("l_orderkey", "l_linenumber", F.round("v", 4).alias("v"))


_GM = f"WITH {_MASKED}, g AS (SELECT l_suppkey, quantile_cont(v, 0.5) AS md FROM x WHERE v > 0 GROUP BY 1), f AS (SELECT x.*, coalesce(v, md) AS f FROM x LEFT JOIN g USING (l_suppkey))"


@query(f"{_GM} SELECT l_orderkey, l_linenumber, round(f, 6) AS v FROM f")
def impute_group_median(spark, d):
    return impute.group_median(_masked(spark, d), "v", "l_suppkey").select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"))


@query(f"WITH {_MASKED} SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL AND l_returnflag = 'R' THEN 0 WHEN v IS NULL AND l_quantity > 25 THEN 50000 ELSE v END AS v FROM x")
def impute_rules(spark, d):
    miss = F.col("v").isNull()
    x = impute.rules(_masked(spark, d), "v", [(miss & (F.col("l_returnflag") == "R"), 0.0), (miss & (F.col("l_quantity") > 25), 50000.0)])
    return x.select("l_orderkey", "l_linenumber", "v")


@query(f"{_GM} SELECT count(*) AS n, round(sqrt(avg((truth - f) * (truth - f))), 4) AS rmse, round(avg(abs(truth - f)), 4) AS mae FROM f WHERE m AND f IS NOT NULL")
def impute_score(spark, d):
    x = impute.group_median(_masked(spark, d), "v", "l_suppkey")
    return impute.rmse(x, "truth", "v", F.col("m") & F.col("v").isNotNull()).select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query()
def impute_knn(spark, d):
    x = _masked(spark, d).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return impute.nearest(x, "key", "v", ["l_quantity"], 10).select("l_orderkey", "l_linenumber", "v")


@query()
def impute_chained(spark, d):
    x = _masked(spark, d).withColumn("q", F.when(F.pmod("l_suppkey", F.lit(7)) > 0, F.col("l_quantity")))
    return impute.chained(x, "l_orderkey", ["v", "q"]).select("l_orderkey", "l_linenumber", "v", "q")


@query()
def impute_matched(spark, d):
    x = _masked(spark, d).withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("q", F.when(F.pmod("l_suppkey", F.lit(7)) > 0, F.col("l_quantity")))
    return impute.chained(x, "key", ["v", "q"], candidates=5).select("l_orderkey", "l_linenumber", "v", "q")


shared("boxcox_fixed_lambda", "SELECT o_orderkey, round((pow(o_totalprice, 0.5) - 1) / 0.5, 4) AS y FROM {orders} WHERE o_totalprice > 0")
shared("log1p_clamp", "SELECT c_custkey, round(ln(1 + CASE WHEN c_acctbal IS NOT NULL THEN greatest(c_acctbal, 0) END), 6) AS y FROM {customer}")
shared("guarded_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS ratio, round(CASE WHEN l_tax > 0 THEN l_discount / l_tax END, 6) AS rel FROM {lineitem}")


@query()
def boxcox_lambda(spark, d):
    lam = profile.boxcox_lambda(table(spark, d, "orders"), "o_totalprice")
    return spark.createDataFrame([(lam,)], "lambda double")


@query("""WITH m AS (SELECT avg(c_acctbal) AS mu FROM customer), c AS (SELECT count(*) AS n, avg(pow(c_acctbal - mu, 2)) AS m2, avg(pow(c_acctbal - mu, 3)) AS m3, avg(pow(c_acctbal - mu, 4)) AS m4 FROM customer, m)
SELECT n, round(m3 / pow(m2, 1.5), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurt FROM c""")
def normality_moments(spark, d):
    return _round(profile.normality(table(spark, d, "customer"), "c_acctbal")).select("n", "skew", "kurt")


@query("""WITH m AS (SELECT avg(o_totalprice) AS mu FROM orders), c AS (SELECT count(*)::DOUBLE AS n, avg(pow(o_totalprice - mu, 2)) AS m2, avg(pow(o_totalprice - mu, 3)) AS m3, avg(pow(o_totalprice - mu, 4)) AS m4 FROM orders, m),
s AS (SELECT n, m3 / pow(m2, 1.5) * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
 (m4 / (m2 * m2) - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS u,
 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS g FROM c),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / g * (2 / g + sqrt(1 + 4 / (g * g))) AS a FROM s),
z AS (SELECT asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + u * sqrt(2 / (a - 4)) AS d, a FROM w)
SELECT round(z1 * z1 + pow((1 - 2 / (9 * a) - sign(d) * cbrt((1 - 2 / a) / abs(d))) / sqrt(2 / (9 * a)), 2), 3) AS k2 FROM z""")
def normality_test(spark, d):
    return profile.normality(table(spark, d, "orders"), "o_totalprice").select(F.round("k2", 3).alias("k2"))


@query("SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 9 + 1, 6) AS y FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def min_max_scale(spark, d):
    return profile.min_max(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y")), ["y"], 1, 10).select("o_orderkey", F.round("y", 6).alias("y"))


@query("SELECT o_orderkey, round((o_totalprice - m) / (b - a), 6) AS y FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM orders)")
def robust_scale(spark, d):
    return profile.robust(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("y")), ["y"]).select("o_orderkey", F.round("y", 6).alias("y"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 4) AS y FROM customer")
def yeo_johnson_fixed_lambda(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(profile.yeo_johnson(F.col("c_acctbal"), 0.5), 4).alias("y"))


@query()
def yeo_johnson_lambda(spark, d):
    return spark.createDataFrame([(profile.yeo_johnson_lambda(table(spark, d, "customer"), "c_acctbal"),)], "lambda double")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem")
def linear_fit(spark, d):
    x = models.linear_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return x.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")
