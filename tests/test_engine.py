"""Operators of the engine on small tables with known results."""

import datetime as dt
import io
import json
import tarfile
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as t
from lodestream.operators import evaluate, identity, impute, profile, recommend, sample, stats, store
from lodestream.sources import readers, sinks
from lodestream.streaming import ingest


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("credit", "names"),
    [
        ("Mira feat. Tove; Ode & Nils", ["Mira", "Tove", "Ode", "Nils"]),
        ("Mira ft.Tove", ["Mira", "Tove"]),
        ("Mira feat Tove", ["Mira", "Tove"]),
        ("Mira Featured  By Tove", ["Mira", "Tove"]),
        ("Mira [featuring Tove]", ["Mira", "Tove"]),
        ("Lefty featureless", ["Lefty featureless"]),
        ("Mira vs. Tove versus Ode", ["Mira", "Tove", "Ode"]),
        ("Withers", ["Withers"]),
        ("Smithwith Jonas", ["Smithwith Jonas"]),
        ("mira/tove", ["mira", "tove"]),
        ("mira ／ tove 2", ["mira", "tove 2"]),
        ("mira//tove", ["mira//tove"]),
        ("a/b/c", ["a/b/c"]),
        ("XY/Z2", ["XY/Z2"]),
        ("mira/!", ["mira/!"]),
        ("Mira × Tove (ft. Ode)", ["Mira", "Tove", "Ode"]),
        ("Maxx Tove", ["Maxx Tove"]),
        ("「Mira」、'Tove'", ["Mira", "Tove"]),
        (None, []),
        ("", []),
        (" ; ", []),
    ],
)
def test_credit(spark, credit, names):
    assert one(spark, t.split_credit, credit) == names


@pytest.mark.parametrize(("text", "day"), [("2024-05-06T10:00", "2024-05-06"), ("2024/5/6", "2024-05-06"), ("2024-05", "2024-05-01"), ("1999", "1999-01-01"), ("05/06/2024", None), ("2024-13-01", None), ("", None), (None, None)])
def test_release_date(spark, text, day):
    assert str(one(spark, t.release_date, text)) == str(day)


def test_text(spark):
    assert one(spark, t.norm_token, "  Foo   BAR ") == "foo bar" and one(spark, t.norm_token, None) == ""
    assert one(spark, t.norm_text, "Ｆｕｌｌ a||b") == "full a b" and one(spark, t.norm_text, "  ") is None
    assert one(spark, t.uuid5, "Ünder  Score") == str(uuid.uuid5(uuid.UUID(t.NAMESPACE), "ünder score"))
    assert one(spark, t.dump_id, "x-dump-2426-20260211-.tar.zst") == 2426 and one(spark, t.dump_id, "none") is None
    assert one(spark, t.name_flags, "a; b (c") == ["semicolon", "missing_closing_parenthesis"]
    assert [str(one(spark, t.day_from_unix, x, "long")) for x in (1767225599, 1767225600)] == ["2025-12-31", "2026-01-01"]
    assert one(spark, t.json_list, '["a", " ", "b"]') == ["a", "b"] and one(spark, t.json_list, "x") == ["x"] and one(spark, t.json_list, None) == []


DAYS = [dt.date(2026, 1, d) for d in (1, 2, 5)]


def test_daily_stats(spark):
    df = spark.createDataFrame([(DAYS[0], "A", 2), (DAYS[1], "A", 3), (DAYS[2], "A", 1), (DAYS[1], "B", 4)], "day date, id string, listen_count long")
    got = {(r.day, r.id): tuple(r)[2:] for r in stats.daily_stats(df, "id").collect()}
    assert got[(DAYS[1], "A")] == (1.0, 5, 5, 1.0, 5, 1.0) and got[(DAYS[1], "B")] == (0.0, 4, 4, 0.0, 4, 0.0) and got[(DAYS[2], "A")][1] == 6


def test_refresh_equals_full(spark):
    rows = [(dt.date(2026, 1, 1) + dt.timedelta(days=d * (1 + e % 3)), e, 1 + d * e % 7) for e in range(6) for d in range(60)]
    df = spark.createDataFrame(rows, "day date, id int, listen_count long")
    last = max(r[0] for r in rows) - dt.timedelta(days=20)
    full = [tuple(r) for r in stats.daily_stats(df, "id").filter(F.col("day") >= F.lit(last)).collect()]
    old, new = df.filter(F.col("day") < F.lit(last)), df.filter(F.col("day") >= F.lit(last))
    assert sorted(tuple(r) for r in stats.refresh(new, "id", stats.state_of(old, "id")).collect()) == sorted(full) != []
    half = last - dt.timedelta(days=9)  # a state that was carried on by rows equals one made from all of them
    carried = stats.advance(stats.state_of(df.filter(F.col("day") < F.lit(half)), "id"), old.filter(F.col("day") >= F.lit(half)), "id")
    assert sorted(tuple(r) for r in carried.collect()) == sorted(tuple(r) for r in stats.state_of(old, "id").collect())


def test_percentiles_of_hot_values(spark, monkeypatch):
    rows = [(DAYS[i % 2], i, 1 if i % 3 else i) for i in range(4000)] + [(DAYS[2], i, 2) for i in range(0, 4000, 2)]
    df = spark.createDataFrame(rows, "day date, id int, listen_count long")
    want = sorted(tuple(r) for r in stats.daily_stats(df, "id").collect())
    monkeypatch.setattr(stats, "FEW", 0)
    assert sorted(tuple(r) for r in stats.daily_stats(df, "id").collect()) == want


def test_merge(spark):
    old = spark.createDataFrame([("a", "x", True), ("b", None, False)], "id string, v string, s boolean")
    new = spark.createDataFrame([("a", None, False), ("c", "z", True)], "id string, v string, s boolean")
    once = store.merge(old, new, ["id"], "new", ("s",))
    want = {("a", "x", False), ("b", None, False), ("c", "z", True)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in store.merge(once, new, ["id"], "new", ("s",)).collect()}


def test_facts_replace_partitions(spark, tmp_path):
    df = spark.createDataFrame([("d", 1, 5)], "id string, dump_id long, n long")
    for n in (5, 7):
        store.write_facts(df.withColumn("n", F.lit(n).cast("long")), str(tmp_path / "f"))
    store.write_facts(df.withColumn("dump_id", F.lit(2)), str(tmp_path / "f"))
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "f")).collect()) == [5, 7]


def _archive(path, lines):
    import zstandard

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in (("x/listens/1.listens", lines), ("x/other/1.listens", ["{}"]), ("x/listens/readme", ["{}"])):
            data = "\n".join(body).encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    path.write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))


def _listen(ts, artist, track, release, mbids=None, rec=None):
    add = {k: v for k, v in (("artist_mbids", mbids), ("recording_mbid", rec)) if v is not None}
    return json.dumps({k: v for k, v in {"timestamp": ts, "track_metadata": {"artist_name": artist, "track_name": track, "release_name": release, "additional_info": add}}.items() if v is not None})


def test_archive_to_facts(spark, tmp_path):
    lines = [_listen(1767225600, "Ann", "Song A", "R1", ["m1"], "r1"), _listen(1767225610, "Ann", "Song A", "R1", ["m1"], "r1"), _listen(1767312000, "Ann feat. Bob", "Song B", "R2"), "{broken", ""]
    lines += [_listen(None, "Ann", "Song A", "R1", ["m1"], "r1"), _listen(1767225700, None, "Song C", "R3", [], "r9"), _listen(1767139200, "Ann", "Song A", "R1", ["m1"], "r1"), _listen(1767225800, "Cat", "Song D", None)]
    _archive(tmp_path / "a.tar.zst", lines)
    parsed = readers.parse_lines(readers.archive_lines(spark, str(tmp_path / "*.tar.zst")))
    rows = identity.identified(parsed)
    keyed = identity.artists(rows, identity.aliases(rows))
    track, artist = identity.facts(rows, keyed, dt.date(2026, 1, 1))
    assert {tuple(r) for r in track.collect()} == {(dt.date(2026, 1, 1), "r1", 2), (dt.date(2026, 1, 2), "fallback::ann feat. bob||song b||r2", 1)}
    assert {(r.artist_id, r.listen_count) for r in artist.collect()} >= {("m1", 2), ("m1", 1), ("fallback_artist::bob", 1)}
    c = identity.counters(parsed, rows).first()
    assert (c.lines_parsed, c.bad_json, c.missing_timestamp, c.usable_rows, c.artist_mbids_empty_list, c.artist_name_missing, c.used_recording_mbid, c.used_fallback_key, c.dropped_missing_identity) == (8, 1, 1, 6, 1, 1, 3, 1, 1)
    assert readers.archive_lines(spark, str(tmp_path / "*.tar.zst"), most=3).count() == 3


def test_delimited_and_zip(spark, tmp_path):
    (tmp_path / "m.dat").write_bytes("1::Amélie::Comedy|Romance\n2::X::\n".encode("latin-1"))
    got = readers.delimited(spark, str(tmp_path / "m.dat"), "movie_id int, title string, genres string").collect()
    assert (got[0].title, got[1].genres) == ("Amélie", None)
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.csv", "CARRIER,YEAR\nNA,2001\nAA,x\n")
    assert [tuple(r) for r in readers.zipped_csv(spark, str(tmp_path / "c.zip"), "CARRIER string, YEAR int").collect()] == [(None, 2001), ("AA", None)]


def test_quality(spark):
    df = spark.createDataFrame([(i, float(i) if i % 4 else None, i % 2) for i in range(1, 13)], "k long, v double, g int")
    assert {r.v for r in impute.statistic(df, "v").filter("k % 4 = 0").collect()} == {6.0}
    assert impute.nearest(df, "k", "v", ["k"], 2).filter("k = 4").first().v == 4.0
    assert impute.chained(df.withColumn("w", F.col("k") * 2.0), "k", ["v", "w"]).filter("k = 8").first().v == pytest.approx(8, abs=1e-6)
    bins = {r.k: r.size_bin for r in profile.quartile_bins(spark.createDataFrame([(i, float(i)) for i in range(1, 6)], "k long, v double"), "v").collect()}
    assert bins == {1: "SMALL", 2: "SMALL", 3: "MEDIUM", 4: "LARGE", 5: "XLARGE"}


def test_evaluation(spark):
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, truth int")
    assert evaluate.roc_auc(s).first().auc == 0.875
    assert evaluate.best_f1(s, [0.5, 0.85]).first().threshold == 0.5
    empty = evaluate.confusion(s.limit(0).withColumn("guess", F.lit(1))).first()
    assert empty.tp == 0 and empty.precision is None
    recs = spark.createDataFrame([(1, 5, 1), (2, 6, 3)], "user_id long, item_id long, rank int")
    truth = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "user_id long, item_id long")
    r = evaluate.recall_ndcg(recs, truth, 10).first()
    assert (round(r.recall, 4), r.ndcg) == (0.6667, 0.5)


def test_topk(spark):
    items = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(10)], "item_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.item_id for r in recommend.vector_topk(q, items, 4).orderBy("rank").collect()] == [2, 5, 8, 1]


def test_search_leaves_queries_in_executors(spark, monkeypatch):
    import numpy as np
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(9)
    x, q = rng.integers(-3, 4, (300, 8)).astype(float), rng.integers(-3, 4, (70, 8)).astype(float)
    seen = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 70, 900), rng.integers(0, 300, 900))} | {(3, i) for i in range(298)})
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    table = spark.createDataFrame(seen, "query_id long, item_id long")
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "collect", lambda self: pytest.fail("rows went to the driver"))
        got = recommend.vector_topk(queries, items, 5, table, block=16, at_once=40)
    score = q @ x.T
    score[tuple(zip(*seen))] = -np.inf
    want = {(a, r + 1): int(i) for a in range(70) for r, i in enumerate(np.lexsort((np.arange(300), -score[a]))[:5]) if score[a, i] > -np.inf}
    assert {(r.query_id, r["rank"]): r.item_id for r in got.collect()} == want and sum(a == 3 for a, _ in want) == 2


def test_mean_vectors_of_any_length(spark):
    from lodestream.functions.vectors import mean_vectors

    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (2, [5.0, None, 7.0]), (3, []), (4, None)], "k int, v array<double>")
    for wide in (128, 1):
        assert {r.k: r.profile for r in mean_vectors(df, "k", "v", wide).collect()} == {1: [2.0, 2.0], 2: [5.0, None, 7.0]}


def test_streaming_is_idempotent(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 5), 1, "view"), (dt.datetime(2026, 1, 1, 6), 1, "view"), (dt.datetime(2026, 1, 1, 6), None, "view")], "ts timestamp, user_id long, event_type string")
    df.write.parquet(src)
    for _ in range(2):
        ingest.ingest_counts(spark, src, df.schema, out, mark, ["day", "user_id"], "event_type", 100)
    assert [(r.user_id, r.listen_count) for r in spark.read.parquet(out).collect()] == [(1, 2)]
    assert spark.read.parquet(f"{out}-rejected").count() == 1


def test_streaming_keeps_dumps_apart(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    schema = "ts timestamp, user_id long, event_type string"

    def put(name, users):
        rows = [(dt.datetime(2026, 1, 1, 5), u, "view") for u in users]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"tmp-{name}"))
        next((tmp_path / f"tmp-{name}").glob("*.parquet")).rename(src / f"{name}.parquet")

    def facts():
        return sorted((r.dump_id, r.user_id, r.listen_count) for r in spark.read.parquet(out).collect())

    put("x-dump-7-1", [1, 1])
    put("x-dump-8-1", [1])
    ingest.ingest_counts(spark, str(src), schema, out, str(tmp_path / "mark"), ["day", "user_id"], "event_type", 100)
    assert facts() == [(7, 1, 2), (8, 1, 1)]
    put("x-dump-9-1", [2])
    for files in (1, 100):  # a lost checkpoint: all files again, in batches of another size
        ingest.ingest_counts(spark, str(src), schema, out, str(tmp_path / f"mark{files}"), ["day", "user_id"], "event_type", files)
        assert facts() == [(7, 1, 2), (8, 1, 1), (9, 2, 1)]


def test_samples_and_cutoffs(spark):
    df = spark.range(5000)
    drawn = [r.id for r in sample.exact(df, "id", 50).collect()]
    assert len(set(drawn)) == 50 and {r.id for r in sample.exact(df.repartition(7), "id", 50).collect()} == set(drawn)
    assert 400 < sample.fraction(df, "id", 0.1).count() < 600 and sample.exact(df.limit(3), "id", 50).count() == 3
    with pytest.raises(ValueError, match="share"):
        sample.fraction(df, "id", 0.0)
    days = spark.createDataFrame([(i, 10, 2) for i in range(10)], "day int, n long, pos long")
    assert stats.choose_cutoff(days, 30, 30, 2).first()[0] == 6 and not stats.choose_cutoff(days, 30, 300, 2).first()["ok"]
    rated = spark.createDataFrame([(1, i, 5 if i < 3 else 1, i) for i in range(12)], "user_id long, item_id long, rating int, ts long")
    assert [r.item_id for r in recommend.recent_positives(rated, 10).collect()] == [2]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 140


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    own = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = [(i, f"n{i}" if i % 3 else None) for i in range(20)]
    sinks.jdbc_overwrite(spark.createDataFrame(rows, "id int, name string"), url, "things", own, rows=7, keep=False)
    assert sorted(tuple(r) for r in sinks.jdbc(spark, url, "things", own, key="id", parts=4).collect()) == rows
    assert sinks.jdbc(spark, url, '(SELECT * FROM things WHERE "id" < 5) q', own).count() == 5
    sinks.jdbc_overwrite(spark.createDataFrame([], "id int, name string"), url, "things", own)
    assert sinks.jdbc(spark, url, "things", own, key="id").count() == 0


def test_results_documents_and_lines(spark, tmp_path):
    df = spark.createDataFrame([("Ann, B.", 1), (None, 2)], "name string, age int")
    path = sinks.numbered(df, str(tmp_path), "recs", 3, "2026-01-02")
    assert path.endswith("recs_0003_2026-01-02")
    assert sorted(r.age for r in spark.read.csv(path, header=True, schema="name string, age int").collect()) == [1, 2]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.numbered(df, str(tmp_path), "recs", 3, "2026-01-02")
    sinks.metrics(spark, {"auc": 0.5, "f1": float("nan"), "lift": None}, str(tmp_path / "m"))
    assert [tuple(r) for r in spark.read.schema("auc double, f1 double, lift double").json(str(tmp_path / "m")).collect()] == [(0.5, None, None)]
    (tmp_path / "d.json").write_text('[{"name": "A", "age": 3},\n {"name": "B"}]')
    assert sorted((r.name, r.age) for r in sinks.documents(spark, str(tmp_path / "d.json"), "name string, age int").collect()) == [("A", 3), ("B", None)]
    (tmp_path / "t.txt").write_text("one\n\ntwo, three\n")
    assert [r.value for r in sinks.text_lines(spark, str(tmp_path / "t.txt")).collect()] == ["one", "", "two, three"]
