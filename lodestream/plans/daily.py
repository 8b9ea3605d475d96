"""Daily facts, rolling statistics, features, labels and splits over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..session import table
from .registry import query, shared

_DAILY = "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS listen_count FROM events GROUP BY ALL"
_ROLL = f"""WITH daily AS ({_DAILY}), base AS (SELECT *,
  CAST(sum(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
  CAST(sum(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING) AS BIGINT) AS s7,
  CAST(sum(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS 29 PRECEDING) AS BIGINT) AS s30 FROM daily),
grown AS (SELECT *, CASE WHEN lag(cum) OVER w > 0 THEN listen_count / CAST(lag(cum) OVER w AS DOUBLE) END AS growth
  FROM base WINDOW w AS (PARTITION BY user_id ORDER BY day)),
stats AS (SELECT day, user_id, percent_rank() OVER (PARTITION BY day ORDER BY growth NULLS FIRST) AS growth_percentile,
  cum AS cumulative_listen_count, s7 AS listen_count_past_7_days, percent_rank() OVER (PARTITION BY day ORDER BY s7) AS listen_pctl_past_7_days,
  s30 AS listen_count_past_30_days, percent_rank() OVER (PARTITION BY day ORDER BY s30) AS listen_pctl_past_30_days FROM grown)"""


def events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts"))


def daily(spark, d):
    return stats.daily_counts(events(spark, d).select("day", "user_id"), ["day", "user_id"])


@query(_DAILY)
def daily_counts(spark, d):
    return daily(spark, d)


@query("SELECT day, user_id, CAST(sum(n) AS BIGINT) AS listen_count FROM (SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL")
def collapse_provenance(spark, d):
    facts = stats.daily_counts(events(spark, d).select("day", "user_id", "event_type"), ["day", "user_id", "event_type"])
    return stats.collapse(facts, ["day", "user_id"])


@query(f"{_ROLL} SELECT * FROM stats")
def daily_stats_full(spark, d):
    return stats.daily_stats(daily(spark, d), "user_id")


@query(f"{_ROLL} SELECT * FROM stats WHERE day >= (SELECT max(day) FROM stats) - INTERVAL 14 DAY")
def daily_stats_window14(spark, d):
    from ..session import cut

    x = cut(daily(spark, d), "daily")
    start = F.lit(x.agg(F.date_sub(F.max("day"), 14)).first()[0])
    return stats.refresh(x.filter(F.col("day") >= start), "user_id", stats.state_of(x.filter(F.col("day") < start), "user_id"))


@query(f"{_ROLL} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS rn FROM stats WHERE day < DATE '2024-01-15') WHERE rn = 1")
def latest_before(spark, d):
    from pyspark.sql import Window

    s = stats.daily_stats(daily(spark, d), "user_id").filter("day < DATE '2024-01-15'")
    return s.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).filter("rn = 1").withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH daily AS ({_DAILY}), seed AS (SELECT user_id, sum(listen_count) AS s FROM daily WHERE day < DATE '2024-01-15' GROUP BY 1)
SELECT day, user_id, listen_count, CAST(coalesce(s, 0) + sum(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative
FROM daily LEFT JOIN seed USING (user_id) WHERE day >= DATE '2024-01-15'""")
def seeded_cumulative(spark, d):
    x = daily(spark, d)
    seed = x.filter("day < DATE '2024-01-15'").groupBy("user_id").agg(F.sum("listen_count").alias("s"))
    new = x.filter("day >= DATE '2024-01-15'").join(seed, "user_id", "left")
    return stats.rolling(new, "user_id", F.col("s")).select("day", "user_id", "listen_count", F.col("cumulative_listen_count").alias("cumulative"))


shared("rolling_mean_std", f"""WITH daily AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM {{events}} GROUP BY 1, 2)
SELECT day, user_id, round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS ma_7,
 round(avg(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 6) AS ma_30,
 round(stddev_pop(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS std_7 FROM daily""")


@query(f"""{_ROLL}, f AS (SELECT s.*, d.listen_count, s7.l7, s7.l30, s7.lc1, s7.lc7, s7.first_day, s7.ma_7, s7.std_7 FROM stats s JOIN daily d USING (day, user_id) JOIN (
  SELECT day, user_id, lag(listen_count_past_7_days, 7) OVER w AS l7, lag(listen_count_past_30_days, 30) OVER w AS l30,
   lag(listen_count, 1) OVER w AS lc1, lag(listen_count, 7) OVER w AS lc7, min(day) OVER (PARTITION BY user_id) AS first_day,
   avg(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING) AS ma_7, stddev_pop(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS 6 PRECEDING) AS std_7
  FROM stats JOIN daily USING (day, user_id) WINDOW w AS (PARTITION BY user_id ORDER BY day)) s7 USING (day, user_id))
SELECT day, user_id, listen_count_past_7_days - l7 AS momentum_7d, listen_count_past_30_days - l30 AS momentum_30d,
 round(CASE WHEN listen_count_past_30_days > 0 THEN listen_count_past_7_days / CAST(listen_count_past_30_days AS DOUBLE) END, 6) AS velocity_ratio,
 CAST(day - first_day AS BIGINT) AS days_since_first_listen, lc1 AS listen_count_lag_1d, lc7 AS listen_count_lag_7d,
 CAST((dayofweek(day) + 6) % 7 AS BIGINT) AS day_of_week, CAST(dayofweek(day) IN (0, 6) AS BIGINT) AS is_weekend, round(ma_7, 6) AS ma_7, round(std_7, 6) AS std_7, round(ln(1 + listen_count), 6) AS log_listens,
 round((listen_count_past_7_days - l7) / CAST(abs(listen_count_past_30_days - l30) + 1 AS DOUBLE), 6) AS momentum_ratio FROM f""")
def features(spark, d):
    x = daily(spark, d)
    f = stats.features(stats.daily_stats(x, "user_id"), x, "user_id")
    r = lambda c: F.round(c, 6).alias(c)
    i = lambda c: F.col(c).cast("long").alias(c)
    return f.select("day", "user_id", "momentum_7d", "momentum_30d", r("velocity_ratio"), i("days_since_first_listen"), "listen_count_lag_1d", "listen_count_lag_7d", i("day_of_week"), i("is_weekend"), r("ma_7"), r("std_7"), r("log_listens"), r("momentum_ratio"))


@query(f"""{_ROLL}, t AS (SELECT day, user_id, count(growth_percentile) OVER b AS n, max(growth_percentile) OVER a AS m7, max(growth_percentile) OVER b AS m30,
 avg(growth_percentile) OVER a AS a7, avg(growth_percentile) OVER b AS a30 FROM stats
 WINDOW a AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), b AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING))
SELECT day, user_id, CAST(coalesce(m7 >= 0.95, false) AS BIGINT) AS is_popular_7d, CAST(coalesce(m30 >= 0.95, false) AS BIGINT) AS is_popular_30d,
 round(a7, 6) AS future_growth_pctl_7d, round(a30, 6) AS future_growth_pctl_30d FROM t WHERE n >= 10""")
def targets_forward(spark, d):
    t = stats.targets(stats.daily_stats(daily(spark, d), "user_id"), "user_id", 0.95, 10)
    return t.select("day", "user_id", F.col("is_popular_7d").cast("long").alias("is_popular_7d"), F.col("is_popular_30d").cast("long").alias("is_popular_30d"), F.round("future_growth_pctl_7d", 6).alias("future_growth_pctl_7d"), F.round("future_growth_pctl_30d", 6).alias("future_growth_pctl_30d"))


@query(f"WITH daily AS ({_DAILY}) SELECT * FROM daily QUALIFY count(*) OVER (PARTITION BY user_id) >= 28")
def min_observations(spark, d):
    return stats.min_observations(daily(spark, d), "user_id", 28)


@query(f"WITH daily AS ({_DAILY}) SELECT *, CASE WHEN day <= (SELECT max(day) FROM daily) - INTERVAL 7 DAY THEN 'train' ELSE 'test' END AS part FROM daily")
def temporal_split(spark, d):
    return stats.temporal_split(daily(spark, d), 7)


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS pos FROM events GROUP BY 1),
c AS (SELECT day, CAST(sum(n) OVER w AS BIGINT) AS train_n, CAST(sum(n) OVER () - sum(n) OVER w AS BIGINT) AS test_n,
 CAST(sum(pos) OVER w AS BIGINT) AS train_pos, CAST(sum(pos) OVER () - sum(pos) OVER w AS BIGINT) AS test_pos FROM p WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT *, train_n >= 500 AND test_n >= 200 AND train_pos >= 20 AND test_pos >= 20 AS ok FROM c""")
def cutoff_search(spark, d):
    per = events(spark, d).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("pos"))
    return stats.cutoff_search(per, 500, 200, 20)


shared("split_80_percent_days", """WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1),
r AS (SELECT day, n, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS days FROM p)
SELECT day, n, CASE WHEN i <= floor(days * 0.8) THEN 'train' ELSE 'test' END AS part FROM r""")


@query(f"""WITH daily AS ({_DAILY}), s AS (SELECT user_id, day, listen_count AS target, list(listen_count) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM daily)
SELECT user_id, day, target, array_to_string(l, ',') AS sequence FROM s WHERE len(l) = 5""")
def sequences(spark, d):
    s = stats.sequences(daily(spark, d), "user_id", ["listen_count"], "listen_count", 5)
    return s.select("user_id", "day", "target", F.array_join(F.transform("sequence", lambda a: a[0].cast("long").cast("string")), ",").alias("sequence"))


@query(f"WITH daily AS ({_DAILY}), c AS (SELECT user_id, sum(listen_count) OVER (PARTITION BY user_id ORDER BY day) AS x, day FROM daily) SELECT user_id, CAST(count(*) FILTER (x < p) AS BIGINT) AS drops FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY day) AS p FROM c) GROUP BY 1")
def monotone_check(spark, d):
    from pyspark.sql import Window

    x = stats.rolling(daily(spark, d), "user_id")
    before = F.lag("cumulative_listen_count").over(Window.partitionBy("user_id").orderBy("day"))
    return x.withColumn("p", before).groupBy("user_id").agg(F.count_if(F.col("cumulative_listen_count") < F.col("p")).alias("drops"))


shared("daily_totals", "SELECT CAST(ts AS DATE) AS day, count(*) AS total FROM {events} GROUP BY 1")
shared("distinct_per_day", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS users FROM {events} GROUP BY 1")
shared("entity_totals", "SELECT user_id, count(*) AS entries, count(DISTINCT CAST(ts AS DATE)) AS active_days, round(sum(value), 4) AS total FROM {events} GROUP BY 1")
shared("global_stats", "SELECT min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS users, count(*) AS n FROM {events}")
shared("dump_record_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM {events} WHERE event_type <= 'purchase' GROUP BY 1, 2")
shared("top_entities", "SELECT user_id, count(*) AS n FROM {events} GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
shared("top_provenance_series", "SELECT e.event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM {events} e JOIN (SELECT event_type FROM {events} GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 2) t ON e.event_type = t.event_type GROUP BY 1, 2")
shared("cutoff_facts_only", "SELECT user_id, min(CAST(ts AS DATE)) AS first_seen, count(CASE WHEN CAST(ts AS DATE) >= DATE '2024-01-15' THEN 1 END) AS listens FROM {events} GROUP BY 1")
shared("null_scan_events", "SELECT count(*) AS n, count(CASE WHEN user_id IS NULL THEN 1 END) AS user_nulls, count(CASE WHEN value IS NULL THEN 1 END) AS value_nulls FROM {events}")
