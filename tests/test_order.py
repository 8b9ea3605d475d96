"""Exact quantiles, running sums, scalers and imputation from donors against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream.operators import evaluate, impute, models, order, profile, store

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]


def _values(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.round(rng.lognormal(0, 3, n), 4)
    x[: n // 3] = 1.5  # a third of all rows share a value
    return x


@pytest.mark.parametrize("enough", [2, 300])
def test_quantiles_narrowed(spark, enough):
    x = _values(6000, 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x})).unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double"))
    got = order.quantiles(df, "x", PROBS, enough=enough).collect()
    assert len(got) == 1 and np.allclose(got[0].q, np.quantile(x, PROBS), rtol=1e-12)


def test_quantiles_by_group(spark):
    parts = {"big": _values(4000, 2), "small": np.array([1.0, 2.0, 4.0]), None: _values(1000, 3), "one": np.full(500, 7.0)}
    df = spark.createDataFrame([(k, float(v)) for k, own in parts.items() for v in own], "k string, x double")
    got = {r.k: r.q for r in order.quantiles(df, "x", PROBS, ["k"], enough=50).collect()}
    assert set(got) == set(parts)
    for k, own in parts.items():
        assert np.allclose(got[k], np.quantile(own, PROBS), rtol=1e-12), k


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert [r.q for r in order.quantiles(none, "x", [0.5]).collect()] == [None] and order.quantiles(none, "x", [0.5], ["k"]).count() == 0
    assert [r.q for r in order.quantiles(spark.createDataFrame([(3,)], "x int"), "x", [0.1, 0.9]).collect()] == [[3.0, 3.0]]


def test_running(spark):
    x = _values(3000, 4)
    pdf = pd.DataFrame({"x": x, "i": np.random.default_rng(5).permutation(3000), "n": np.arange(3000) % 7})
    got = order.running(spark.createDataFrame(pdf), "x", "i", {"rank": "1", "s": "n"}, enough=10).toPandas().sort_values(["x", "i"])
    assert len(got) == 3000 and (got["rank"].to_numpy() == np.arange(1, 3001)).all() and (got["s"].to_numpy() == got["n"].cumsum().to_numpy()).all()
    some = spark.createDataFrame([(None, 2), (None, 1), (5.0, 3)], "x double, i int")
    for n in (1, 10):
        assert sorted((r.i, r.r) for r in order.running(some, "x", "i", {"r": "1"}, enough=n).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert order.running(some.limit(0), "x", "i", {"r": "1"}).count() == 0


def test_indexed_beyond_one_window(spark):
    keys = np.random.default_rng(8).permutation(5000) * 3
    df = spark.createDataFrame(pd.DataFrame({"item_id": keys, "place": keys % 5}))
    got = order.indexed(df, "item_id", enough=100).toPandas().sort_values("item_id")
    assert list(got.columns) == ["item_id", "place", "idx"] and (got["idx"].to_numpy() == np.arange(5000)).all() and (got["item_id"].to_numpy() == np.arange(5000) * 3).all()


def test_value_ranks_and_first_row(spark):
    s = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "score double, truth int")
    assert {r.s: (r.n_above, r.pos_above) for r in evaluate.value_ranks(s, "score", "truth").collect()} == {0.9: (2, 1), 0.5: (3, 2), 0.1: (4, 2)}
    d = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, v string")
    assert sorted(map(tuple, store.update_one(d, F.col("v") == "b", ["k"], {"v": "x"}).collect()), key=str) == [(1, "a"), (2, "b"), (2, "x"), (3, None)]
    assert store.delete_one(d, F.col("v") == "b", ["k"]).count() == 3 and store.delete_one(d, F.col("v") == "z", ["k"]).count() == 4


def test_scalers_and_normality(spark):
    x = np.random.default_rng(6).normal(5, 2, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": np.exp(x / 2), "c": 3.0}))
    got = profile.robust(df, ["x", "c"]).toPandas()
    assert np.isclose(got["x"].median(), 0) and np.isclose(got["x"].quantile(0.75) - got["x"].quantile(0.25), 1) and (got["c"] == 0).all()
    got = profile.min_max(df, ["x", "c"], 1, 10).toPandas()
    assert got["x"].min() == 1 and np.isclose(got["x"].max(), 10) and (got["c"] == 1).all()
    assert profile.normality(df, "x").first().p > 0.01 and profile.normality(df, "y").first().p < 1e-6
    assert profile.normality(df.limit(3), "x").first().k2 is None and profile.normality(df, "c").first().k2 is None
    assert abs(profile.yeo_johnson_lambda(df, "x") - 1) < 0.3
    v = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "v double")
    assert [r[0] for r in v.select(profile.yeo_johnson(F.col("v"), 1.0)).collect()] == [-2.0, 0.0, 3.0, None]


def test_matched_values_are_observed(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50, 400).astype(float)
    pdf = pd.DataFrame({"k": range(400), "a": a, "b": 2 * a + rng.integers(0, 3, 400)})
    df = spark.createDataFrame(pdf).withColumn("b", F.when(F.col("k") % 4 > 0, F.col("b")))
    got = impute.chained(df, "k", ["a", "b"], candidates=5).toPandas().sort_values("k")
    seen = set(pdf["b"][pdf["k"] % 4 > 0])
    assert set(got["b"]) <= seen and np.abs(got["b"].to_numpy() - pdf["b"].to_numpy()).max() < 12
    assert (got["b"].to_numpy() == pdf["b"].to_numpy())[pdf["k"] % 4 > 0].all()


def test_every_donor_counts(spark, monkeypatch):
    n = 12_000  # the nearest donors of a row are the two beside it
    df = spark.range(n).select(F.col("id").alias("k"), F.col("id").cast("double").alias("a")).withColumn("v", F.when(F.col("k") % 3 > 0, F.col("a") * 2))
    got = impute.nearest(df, "k", "v", ["a"], 2).filter("k % 3 = 0 AND k > 0").select("k", "v").collect()
    assert len(got) == n // 3 - 1 and all(r.v == 2 * r.k for r in got)
    monkeypatch.setattr(impute, "RANGE", 1000)
    pred = df.withColumns({"__m_v": F.col("v").isNull(), "__g": F.col("a")})
    got = {r.k: r.v for r in impute._matched(pred, "k", "v", 2).collect()}
    assert len(got) == n and all(abs(v - 2 * k) == 2 for k, v in got.items() if k % 3 == 0 and k)


def test_matched_with_ranges_that_nothing_asks_for(spark, monkeypatch):
    monkeypatch.setattr(impute, "RANGE", 500)
    df = spark.range(4000).select(F.col("id").alias("k"), F.when((F.col("id") % 3 > 0) | (F.col("id") > 1000), F.col("id") * 2.0).alias("v"))
    pred = df.withColumns({"__m_v": F.col("v").isNull(), "__g": F.col("k").cast("double")})
    got = {r.k: r.v for r in impute._matched(pred, "k", "v", 2).collect()}
    assert len(got) == 4000 and all(abs(v - 2 * k) == (2 if k % 3 == 0 and 0 < k <= 1000 else 0) for k, v in got.items() if k)


def test_als_query_trains_whole_model(monkeypatch):
    import inspect

    from lodestream import catalog
    from lodestream.plans import ranking

    whole, used = inspect.signature(ranking.recommend.als_recommend), []
    monkeypatch.setattr(ranking, "ratings", lambda spark, d: None)
    monkeypatch.setattr(ranking.recommend, "als_recommend", lambda *a, **b: used.append(whole.bind(*a, **b)))
    catalog.QUERIES["als_recommend"](None, "")
    used[0].apply_defaults()
    assert (used[0].arguments["factors"], used[0].arguments["iterations"]) == (64, 20)


def test_als_checkpoints_and_lists_only_unseen(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS, ALSModel

    from lodestream.operators import recommend

    rng = np.random.default_rng(10)
    rows = {(int(u), int(i)) for u, i in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900)) if u % 3 == i % 3}
    ratings = spark.createDataFrame([(u, i, 5) for u, i in sorted(rows)], "user_id long, item_id long, rating int")
    fit, used = ALS.fit, []
    monkeypatch.setattr(ALS, "fit", lambda self, df: used.append(self) or fit(self, df))
    monkeypatch.setattr(ALSModel, "recommendForAllUsers", lambda *a: pytest.fail("lists that grow with the longest history"))
    got = recommend.als_recommend(ratings, 3, factors=4, iterations=5).collect()
    assert used[0].getCheckpointInterval() == 1 and spark.sparkContext.getCheckpointDir()
    assert len(got) == 180 and {r["rank"] for r in got} == {1, 2, 3} and not {(r.user_id, r.item_id) for r in got} & rows
    assert sum(r.user_id % 3 == r.item_id % 3 for r in got) > 150


def test_als_blocks_train_as_sparks_own(spark, monkeypatch):
    from pyspark.ml.recommendation import ALS

    from lodestream.operators import recommend

    rng = np.random.default_rng(11)
    rows = sorted({(int(u), int(i) - 60) for u, i in zip(rng.integers(0, 90, 1500), rng.integers(0, 120, 1500))} | {(7, i) for i in range(-60, 60)})
    ratings = spark.createDataFrame([(u, i, 5) for u, i in rows + rows[:50]], "user_id long, item_id long, rating int")
    asked, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, df: asked.append((self.getMaxIter(), df.count())) or fit(self, df))
    got = recommend.als_recommend(ratings, 130, factors=6, iterations=4).collect()
    assert asked == [(0, 90)]  # Spark gives the start only, from one rating of each user
    pairs = spark.createDataFrame([(u, i, 1.0) for u, i in rows], "user_id int, item_id int, value double")
    m = fit(ALS(rank=6, regParam=0.01, maxIter=4, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="value", seed=42, numUserBlocks=4, numItemBlocks=4), pairs)
    u, v = ({r.id: np.array(r.features) for r in f.collect()} for f in (m.userFactors, m.itemFactors))
    want = {(a, b): u[a] @ v[b] for a in u for b in v}
    want = {p: s for p, s in want.items() if p not in set(rows)}
    assert {(r.user_id, r.item_id) for r in got} == set(want) and max(abs(want[r.user_id, r.item_id] - r.score) for r in got) < 1e-5


def test_search_leaves_out_only_what_cannot_win(spark, monkeypatch):
    from lodestream.operators import recommend, search

    met, leaf = [], search.Queries._leaf
    rng = np.random.default_rng(12)
    base = np.eye(8)[rng.integers(0, 8, 700)] * rng.uniform(0.2, 3, (700, 1)) + rng.normal(0, 0.01, (700, 8))
    x, q, ids = base[:500].astype(np.float32), base[500:].astype(np.float32), np.arange(500)
    x[100:140] = x[100]  # equal scores: smaller ids win
    row = {"no": 0, "id": np.arange(200).tobytes(), "x": q.tobytes(), "who": np.zeros(1, np.int32).tobytes(), "saw": np.array([int(np.argmax(q[0] @ x.T))]).tobytes()}
    monkeypatch.setattr(search, "LEAF", 25)
    monkeypatch.setattr(search.Queries, "_leaf", lambda self, a, b, i, *r: met.append((b - a) * len(i)) or leaf(self, a, b, i, *r))
    monkeypatch.setattr(search.leaves, "__defaults__", (25,))
    first = search.Queries(row, 5, np.float32)
    for at in range(0, 500, 100):
        first.meet(ids[at : at + 100], x[at : at + 100], True)
    second = search.Queries(row | {"tops": [first.tops().column(1)[0].as_py()]}, 5, np.float32)
    met.clear()
    for at in range(0, 500, 100):
        second.meet(ids[at : at + 100], x[at : at + 100], False)
    assert sum(met) < 200 * 500 / 2
    score = q.astype(float) @ x.astype(float).T
    score[0, np.argmax(score[0])] = -np.inf
    want = {(a, int(i)) for a in range(200) for i in np.lexsort((ids, -np.round(score[a], 12)))[:5]}
    assert {(r["query_id"], r["item_id"]) for r in second.found().to_pylist()} == want
    items = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "item_id long, vector array<float>")
    asked = spark.createDataFrame([(a, v.tolist()) for a, v in enumerate(q)], "query_id long, vector array<float>")
    seen = spark.createDataFrame([(0, int(np.argmax(q[0] @ x.T)))], "query_id long, item_id long")
    assert {(r.query_id, r.item_id) for r in recommend.vector_topk(asked, items, 5, seen, block=64, at_once=20).collect()} == want


def test_folds(spark):
    df = spark.createDataFrame([(d,) for d in range(10)], "day int")
    got = {(r.fold, r.part): sorted(r.d) for r in models.expanding_folds(df, "day", 4).groupBy("fold", "part").agg(F.collect_list("day").alias("d")).collect()}
    assert got[(1, "train")] == [0, 1] and got[(1, "test")] == [2, 3] and got[(4, "train")] == list(range(8)) and got[(4, "test")] == [8, 9]
