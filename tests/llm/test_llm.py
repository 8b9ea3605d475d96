"""Each operator against brute force on a small table with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat, decontam, dedup, idfile, langid, lm, similar, simhash, tokencount, toxicity

WORDS = "the of and to in that it was for on are as with his they at be this have from".split()
ITEM = "Quick brown foxes jump over seventeen lazy dogs while the moon shines on a quiet harbour town."


def _texts():
    r = random.Random(3)
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(3000))
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(3, 60))) for _ in range(30)]
    near = " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(400))
    texts += [None, "", "   \n", "x", "A b", "Ünïcode ß tëxt 😀", long, near, near + " end", near.upper(), "\\ <turn </turn> \\e", f"so {ITEM} yes", f"so {ITEM.replace('foxes', 'foxs').upper()} yes"]
    return texts + texts[:5] + ["", " x "]


ROWS = [(i, t, ["en", "fr", None][i % 3], "s", i, i * 2) for i, t in enumerate(_texts())] + [(7, "seven again", "en", "s", 0, 0), (None, "no id", "fr", "s", 0, 0)]
SCHEMA = "doc_id long, text string, lang string, source string, fp long, score long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_template_is_reversible():
    turns = [("user", "\\### Assistant: </turn> ok"), ("a>b\nc", "<turn x>\\e\\\\"), ("assistant", ""), ("assistant", "end\n</turn>\n<turn ")]
    text, mask = chat.render(turns)
    assert chat.parse(text) == turns
    assert chat.masked_text(text, mask) == "end\n</turn>\n<turn "


def test_trees(spark):
    m = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", None, 0.0), ("t", 4, 3, "user", None, 0.0)]
    m += [(None, 1, None, None, "lone", None), ("c", 1, 2, "user", "cycle", 0.0), ("c", 2, 1, "user", "cycle", 0.0), ("c", 3, 2, "user", "below", 0.0), ("d", 9, 8, "user", "orphan", 0.0)]
    m += [("deep", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(21)]
    df = spark.createDataFrame(m, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.leaf): [x for _, x in chat.parse(r.formatted)] for r in chat.format_trees(df).collect()}
    assert got == {("t", 2): ["hi", "a"], ("t", 4): ["hi", "b", ""], (None, 1): ["lone"], ("d", 9): ["orphan"], ("deep", 20): [str(i) for i in range(21)]}
    best = chat.format_trees(df, best=1).filter("tree = 't'").collect()
    assert [(r.leaf, r.rank, r.path_score) for r in best] == [(4, 1, 2.0)]
    assert chat.format_trees(df.limit(0)).count() == 0


def test_language(spark, docs, none):
    de, en = "der die und das ist nicht ein ich", "the of and to in that it was"
    data = spark.createDataFrame([(f"{de} {i}", "de") for i in range(5)] + [(f"{en} {i}", "en") for i in range(5)] + [(None, "en"), ("x", None)], "text string, lang string")
    p = langid.train(data)
    assert p.predict("und das ist nicht")[0] == "de" and p.predict("that it was in the")[0] == "en"
    assert p.predict(None) == p.predict("12 !") == ("und", 0.0)
    got = langid.predict(docs, p, ["doc_id"]).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert langid.accept(docs, p).count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t, *_ in ROWS)
    assert langid.train(none).predict("abc") == ("und", 0.0) and langid.accept(none, p).count() == 0
    assert langid.accept(docs, langid.train(none)).count() == len(ROWS)


def test_letters():
    p = langid.Profiles({"en": [ord("a"), ord("é")]})
    for text in ("½", "²", "Ⅷ", "１２", "_-", "\u0301", "😀", " \x1c "):
        assert p.predict(text) == ("und", 0.0), text
    assert all(p.predict(x)[0] == "en" for x in ("a", "É", "ª", "½a", "語", "e\u0301"))
    assert langid.words("De\u0301ja\u0300-vu ½ x") == "de\u0301ja\u0300 vu x" and langid.words("A1b_c") == "a b c"


def test_language_by_brute_force(spark):
    r, data = random.Random(2), []
    for lang, abc in (("x", "abcde "), ("y", "cdefgé ")):
        data += [("".join(r.choice(abc) for _ in range(80)), lang) for _ in range(20)]
    p = langid.train(spark.createDataFrame(data, "text string, lang string"), 50)

    def ranked(texts):
        n = Counter()
        for t in texts:
            s = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
            # a blank is no n-gram by itself, and none has a blank in its middle
            n.update(g for k in (1, 2, 3) for i in range(len(s) - k + 1) if (g := s[i : i + k]) != " " and g[1:-1] != " ")
        order = sorted(n, key=lambda g: (-n[g], sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))))
        return order[:50]

    lists = {k: ranked([t for t, y in data if y == k]) for k in "xy"}
    for t, _ in data[:4] + data[-4:] + [("dec ad", ""), ("g", "")]:
        own = ranked([t])
        d = {k: sum(abs(v.index(g) - i) if g in v else 50 for i, g in enumerate(own)) / (50 * len(own)) for k, v in lists.items()}
        best = min(sorted(d), key=d.get)
        assert p.predict(t) == (best, pytest.approx((max(d.values()) - d[best]) / max(d.values()))), t


def test_ngrams_in_blocks(monkeypatch):
    text = "eins zwei drei " * 20
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    part = langid.ngrams(text)
    assert all((a == b).all() for a, b in zip(whole, part))


def test_histogram(docs, none, monkeypatch):
    monkeypatch.setattr(tokencount, "SPAN", 16)
    enc = tokencount.encoder(None)
    n = [len(enc.encode_ordinary(t or "")) for _, t, *_ in ROWS]
    h = tokencount.histogram(docs)
    for r in h.collect():
        assert (r.n_docs, r.docs_ge, r.tokens_ge) == (n.count(r.n_tokens), sum(x >= r.n_tokens for x in n), sum(x for x in n if x >= r.n_tokens))
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n)
    assert tokencount.truncated_totals(h, [0, 7, 10**6]) == {k: sum(min(x, k) for x in n) for k in (0, 7, 10**6)}
    assert tokencount.quantiles(h, [0.5, 1.0]) == {0.5: sorted(n)[math.ceil(len(n) / 2) - 1], 1.0: max(n)}
    assert tokencount.histogram(none).count() == 0


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(5)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(lo, 70))) for lo in (1, 0))
        assert decontam.myers(p, t)[0] == _distance(p, t)


def test_decontamination(spark, docs, none, monkeypatch):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "the"), (4, None), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(docs, bench).collect()}
    hits = [i for i, t, *_ in ROWS if t and t.startswith("so ")]
    the = {(i, 3) for i, t, *_ in ROWS if "the" in re.split(r"[\W_]+", (t or "").lower())}
    assert got == {(hits[0], 1): 0, (hits[0], 2): 0, (hits[1], 1): 1, (hits[1], 2): 1} | {x: 0 for x in the}
    assert decontam.clean(docs, bench.filter("item_id <> 3")).count() == len(ROWS) - 2
    n = decontam.matches(docs, bench).count()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert decontam.matches(docs, bench).count() == n
    assert decontam.matches(none, bench).count() == 0 and decontam.matches(docs, bench.limit(0)).count() == 0


def test_short_items_and_odd_ids(spark):
    docs = spark.createDataFrame([("a", "A cat, sat"), (None, "concatenate"), ("b", "x" * 300 + " cat " + "y" * 300), ("c", None)], "doc_id string, text string")
    for kind in ("smallint", "decimal(5,1)", "string", "date"):
        value = "date'2020-01-01'" if kind == "date" else f"cast(1 as {kind})"
        bench = spark.sql(f"select {value} as item_id, 'Cat' as text union all select null, 'cat' union all select {value}, ' -- '")
        got = decontam.matches(docs, bench)
        assert got.schema["item_id"].dataType.simpleString() == kind
        assert sorted((r.doc_id, r.item_id is None, r.distance) for r in got.collect()) == [("a", False, 0), ("a", True, 0), ("b", False, 0), ("b", True, 0)]


def test_no_edited_passage_is_lost():
    r = random.Random(9)
    item = decontam.normalise(ITEM * 3)
    m, k = decontam.Matcher([(1, item)]), len(item) // decontam.CHARS_PER_EDIT
    for _ in range(200):
        t = list(item)
        for _ in range(k):
            t[r.randrange(len(t))] = r.choice(["", "q", "ab"])[:1]
        text = f"zz zz {''.join(t)} zz"
        # deleting next to a blank lets normalisation take one more character
        assert bool(m.find(text)) == (_distance(item, decontam.normalise(text)) <= k)


def _fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(fps):
    up = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps[:i]):
                if (a ^ b).bit_count() <= 3:
                    up[i] = up[j] = min(up[i], up[j])
    return up


def test_simhash(docs, none):
    fps = [_fingerprint(t) for _, t, *_ in ROWS]
    comp = _components(fps)
    least = {c: min(ROWS[i][0] for i, x in enumerate(comp) if x == c and ROWS[i][0] is not None) if any(ROWS[i][0] is not None for i, x in enumerate(comp) if x == c) else None for c in comp}
    want = sorted(((r[0], f"{f:016x}", least[c]) for r, f, c in zip(ROWS, fps, comp)), key=repr)
    assert rows(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(none).count() == 0


def test_shards_lose_no_pair(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**64, 90, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in base], np.uint64)
    fps = np.unique(np.concatenate((base, base ^ flips, base ^ flips ^ (flips >> np.uint64(9)))))
    for name, value in (("SHARD", 60), ("LEAF", 16)):
        monkeypatch.setattr(simhash, name, value)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.u: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = _components([int(x) for x in fps])
    signed = fps.view(np.int64).tolist()
    mine = [got.get(x, x) for x in signed]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_similar(spark, docs, none):
    r, texts = random.Random(8), []
    for _ in range(40):
        own = [f"{r.choice(WORDS)}{r.randint(0, 99)}" for _ in range(r.randint(60, 300))]
        texts.append(" ".join(own))
        for _ in range(r.randint(0, 6)):  # edits spread over the text, from similarity 1 to about 0.6
            texts.append(" ".join("new" + w if r.random() < 0.03 else w for w in own))
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, None)], "doc_id long, text string")
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    up = list(range(len(own)))
    links = [(i, j) for j in range(len(own)) for i in range(j) if len(own[i] & own[j]) * 5 >= 4 * len(own[i] | own[j])]
    for i, j in links * 2:
        up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    got = {d: c for d, c in similar.near_duplicates(df).collect() if d}
    assert len(links) > 40 and got == {i: x for i, x in enumerate(up) if i}
    assert simhash.near_duplicates(df).select("component_id").distinct().count() > len(set(up))
    assert similar.near_duplicates(none).count() == 0 and similar.near_duplicates(docs).count() == len(ROWS)


def test_similar_cells(spark, monkeypatch):
    """A group that shares buckets through a passage, most of it unlike, with nodes that leaders don't reach: cells of two small blocks lose no link."""
    for name, value in (("CHUNK", 3), ("LEADS", 1)):
        monkeypatch.setattr(similar, name, value)
    r = random.Random(3)
    passage = [f"{r.choice(WORDS)}{r.randint(0, 99)}" for _ in range(150)]
    texts = [" ".join([*passage, *(f"t{i}x{k}" for k in range(r.randint(10, 60)))]) for i in range(40)]
    chain = [f"c{k}" for k in range(150)]
    for i in range(30):  # each a few words off the one before: only neighbours are similar
        chain = chain[:]
        chain[r.randrange(150)] = f"d{i}"
        texts.append(" ".join(chain))
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    up = list(range(len(own)))
    alike = [(i, j) for j in range(len(own)) for i in range(j) if len(own[i] & own[j]) * 5 >= 4 * len(own[i] | own[j])]
    for i, j in alike * 3:
        up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(similar.near_duplicates(df).collect()) == dict(enumerate(up)) and len(set(up)) > 2


def test_similar_cells_name_a_block_once(spark, tmp_path):
    """Nodes that share four buckets: one row each with the blocks they meet, not one for each bucket and block."""
    block, out = {1: 10, 2: 10, 3: 20, 4: 30}, {3, 4}
    at = [(key, node, b, node in out, 4) for key in range(4) for node, b in block.items()] + [(9, 4, 30, True, 2), (9, 5, 40, True, 2)]
    spark.createDataFrame(at, "key long, node long, block long, outside boolean, size long").write.parquet(str(tmp_path / "rows"))
    got = [(r.node, r.block, sorted(r.others)) for r in similar.facing(spark.read.parquet(str(tmp_path / "rows"))).collect()]
    assert sorted(got) == [(1, 10, [20, 30]), (2, 10, [20, 30]), (3, 20, [10, 20, 30]), (4, 30, [10, 20, 30, 40]), (5, 40, [30, 40])]


def test_sketch():
    """Sketches differ in as many places as four bits of two sets' minima."""
    r = np.random.default_rng(4)
    a = np.unique(r.integers(0, 2**64, 400, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:300], r.integers(0, 2**64, 100, dtype=np.uint64))))
    x, y = (np.array([(int(v) * 0x9E3779B97F4A7C15 % 2**64) >> 60 for v in similar.minima(s)]) for s in (a, b))
    p, q = (similar.sketch(similar.minima(s)) for s in (a, b))
    got = [int(p[i // 16] >> np.uint64(i % 16 * 4)) & 15 for i in range(96)], [int(q[i // 16] >> np.uint64(i % 16 * 4)) & 15 for i in range(96)]
    assert got[0] == x.tolist() and got[1] == y.tolist() and 10 < (x != y).sum() < 60


def test_bpe(docs, none):
    enc = tokencount.encoder(None)
    want = [[r[0], (ids := enc.encode_ordinary(r[1] or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] for r in ROWS]
    got = [[r.doc_id, r.ids, r.ids_sha256, r.decoded_sha256] for r in bpe.encode(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and bpe.encode(none).count() == 0


def test_bpe_odd_texts():
    enc, c, r = tokencount.encoder(None), bpe.codec(), random.Random(1)
    texts = ["".join(r.choice("ab  c\n\t the'sé1²😀\x1c\x85　̈,.") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for t, ids in zip(texts + ["a" * 999, " " * 50 + "x", "the" * 500], c.encode(texts + ["a" * 999, " " * 50 + "x", "the" * 500])):
        assert ids.tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_toxicity(spark, docs, none):
    r = random.Random(4)
    bad = ["idiot", "moron", "worthless"]
    data = [(i, " ".join([r.choice(WORDS) for _ in range(30)] + [r.choice(bad)] * (i % 3 == 0) * 2)) for i in range(300)]
    train = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in data] + [(5, None), (1000, 1)], "doc_id long, toxic int")
    m = toxicity.train(train, labels)
    assert m.score("you are an idiott and a moronn they was") > 0.5 > m.score("they was on the with his at be this have from it")
    got = toxicity.score(docs, m).collect()
    assert len(got) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert toxicity.train(train, labels.limit(0)).score("x") < 1e-9 and toxicity.score(none, m).count() == 0


def test_lm(docs, none):
    tok = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""] for _, t, *_ in ROWS]
    learn = [i is not None and i % 2 == 0 for i, *_ in ROWS]
    c = Counter(w for t, y in zip(tok, learn) if y for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for r, t in zip(ROWS, tok))
    got = lm.score(docs, F.col("doc_id") % 2 == 0).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert all(r.score == pytest.approx(-math.log10(2) * r.n_tokens, abs=1e-6) for r in lm.score(docs, F.lit(False)).collect())
    assert lm.score(none, F.lit(True)).count() == 0


def test_lm_words_and_ids(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5)
    long = "y" * 5000
    data = [("a\nb", f"x {long} {long}"), ("", "X x " + "y" * 4999), (None, None), ("c", "x\x1cx é É")]
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(spark.createDataFrame(data, "doc_id string, text string"), F.col("doc_id") == "a\nb").collect()}
    assert got == {"a\nb": (4, 4, 4), "": (4, 3, 4), None: (1, 1, 4), "c": (4, 1, 4)}


def test_lm_words():
    r = random.Random(8)
    texts = [None, "", " ", "A\x1cB \x85 İI K", " x\t", "\x0b\x0cÉ é\x00E", None] + ["".join(r.choice("aB \t\n\x0b\r\x1c\x85é😀") for _ in range(r.randint(0, 30))) for _ in range(300)]
    for skip in (0, 3):
        words, sizes = lm.words_of(pa.array(texts, pa.string()).slice(skip))
        want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts[skip:]]
        assert [w.encode() for w in words.to_pylist()] == [w for t in want for w in t] and sizes.tolist() == list(map(len, want))
    chunk = lm._Chunk()
    for at in range(0, len(texts), 50):
        words, sizes = lm.words_of(pa.array(texts[at : at + 50], pa.string()))
        chunk.add(texts[at : at + 50], [True] * len(sizes), words, sizes + 1)
    docs, own = chunk.rows(9)
    names, codes = own.column("word").to_pylist(), lm._open(docs.column("codes")[0].as_py(), "<i4")
    assert [names[x] for x in codes] == [w for t in texts for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""]]
    assert len(set(names)) == len(names) and own.column("n").to_pylist() == np.bincount(codes).tolist()


def test_lm_vocabulary(spark):
    words = [(f"w{i}".encode(), n) for i, n in enumerate([900, 50, 50, 9, 9, 9, 5, 4, 4])] + [(b"", 1000)]
    df = spark.createDataFrame([(w, n, True) for w, n in words] + [(b"w0", 900, False)], "word binary, c long, first boolean")
    for most, want in ((100, 7), (9, 7), (8, 6), (7, 3), (4, 1), (2, 0)):
        got = sorted((r.number, bytes(r.word)) for r in lm.vocabulary_of(df, most, 5).collect())
        assert got == [(i + 1, f"w{i}".encode()) for i in range(want)], most


def test_lm_contexts():
    sizes, r = [1, 3, 1, 1, 5, 2], np.random.default_rng(0)
    docs = [r.integers(1, 9, n) for n in sizes]
    starts = np.cumsum(sizes) - sizes
    for place in (1, 2):
        want = [d[i - place] if i >= place else 0 for d in docs for i in range(len(d))]
        assert lm.contexts(np.concatenate(docs), starts, place).tolist() == want


def test_lm_forward_pass():
    r, k = np.random.default_rng(1), 37
    m = lm.Model(np.full(k, 1 / k))
    for p in m.places:
        p.context += r.standard_normal(p.context.shape).astype(np.float32)
        p.word += r.standard_normal(p.word.shape).astype(np.float32)
    m.norm = [p.norms(0, k) for p in m.places]
    each = [np.exp(p.context[:, : lm.DIM].astype(float) @ p.word[:, : lm.DIM].T.astype(float) + p.word[:, lm.DIM]) for p in m.places]
    each = [x / x.sum(1, keepdims=True) for x in each]
    w, starts = r.integers(0, k, 300).astype(np.uint16), np.array([0, 1, 5, 250])
    c = [lm.contexts(w, starts, p) for p in lm.PLACES]
    assert np.allclose(m.log10(w, starts), np.log10((each[0][c[0], w] + each[1][c[1], w]) / 2), atol=1e-4)
    for a, b in ((3, 5), (0, 0)):  # over all words that could come next the probabilities sum to one
        total = sum(10.0 ** m.log10(np.array([a, b, x], np.uint16), np.array([0]))[2] for x in range(k))
        assert total == pytest.approx(1, abs=1e-4)


def test_lm_gradient():
    r = np.random.default_rng(2)
    h, seen, noise = (r.standard_normal((n, 4)) for n in (6, 6, 3))
    bias, floor = [tuple(r.standard_normal(n) for n in (6, 3)) for _ in range(2)]

    def loss():
        up = (h * seen).sum(1) + bias[0] - floor[0]
        down = h @ noise.T + bias[1] - floor[1]
        return np.log1p(np.exp(-up)).sum() + np.log1p(np.exp(down)).sum()

    for x, g in zip((h, seen, noise, *bias), lm.gradient(h, seen, noise, bias, floor)):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            up = loss()
            x[i] -= 2e-6
            down = loss()
            x[i] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[i], abs=1e-5)


def test_lm_gradient_of_repeated_contexts():
    r = np.random.default_rng(5)
    own, seen, noise = (r.standard_normal((n, 4)) for n in (5, 40, 3))
    at = r.integers(0, 4, 40)  # the last context occurs nowhere
    bias, floor = [tuple(r.standard_normal(n) for n in (40, 3)) for _ in range(2)]
    want = lm.gradient(own[at], seen, noise, bias, floor)
    got = lm.gradient(own, seen, noise, bias, floor, at)
    sums = np.zeros_like(own)
    np.add.at(sums, at, want[0])
    assert all(np.allclose(x, y) for x, y in zip(got, (sums, *want[1:])))


def test_lm_step(monkeypatch):
    r, k, d = np.random.default_rng(6), 50, lm.DIM
    m = lm.Place(np.full(k, 1 / k), 0)
    for x, sums in ((m.context, 1), (m.word, 2)):
        x[:, -sums:] = r.random((k, sums))
    c, w, drawn = (r.integers(0, high, n).astype(np.uint16) for high, n in ((9, 300), (k, 300), (k, 20)))
    floor, touched = r.standard_normal(k).astype(np.float32), (np.zeros(k, np.int64), np.zeros(k, np.int64))
    context, word = m.context.astype(float), m.word.astype(float)
    gh, gr = np.zeros((k, d)), np.zeros((k, d + 1))
    for i, j in zip(c, w):  # one seen word after the other, the noise anew for each
        h = context[i, :d]
        up = -1 / (1 + np.exp(h @ word[j, :d] + word[j, d] - floor[j]))
        gh[i] += up * word[j, :d]
        gr[j] += up * np.append(h, 1)
        for x in drawn:
            down = 1 / (1 + np.exp(floor[x] - h @ word[x, :d] - word[x, d]))
            gh[i] += down * word[x, :d]
            gr[x] += down * np.append(h, 1)
    uc, uw = np.unique(c), np.unique(np.append(w, drawn))
    context[uc, d] += (gh[uc] ** 2).mean(1)
    word[uw, d + 1] += (gr[uw, :d] ** 2).mean(1)
    word[uw, d + 2] += gr[uw, d] ** 2
    context[uc, :d] -= lm.RATE * gh[uc] / np.sqrt(context[uc, d:] + 1e-3)
    word[uw, :d] -= lm.RATE * gr[uw, :d] / np.sqrt(word[uw, d + 1 : d + 2] + 1e-3)
    word[uw, d] -= 0.1 * lm.RATE * gr[uw, d] / np.sqrt(word[uw, d + 2] + 1e-3)
    met, plain = [], lm.gradient
    monkeypatch.setattr(lm, "gradient", lambda h, *more: met.append(len(h)) or plain(h, *more))
    m.descend(c, w, drawn, floor, touched)
    assert met == [len(uc)]  # the noise meets each distinct context once, not each token
    assert np.allclose(m.context, context, rtol=1e-4, atol=1e-5) and np.allclose(m.word, word, rtol=1e-4, atol=1e-5)
    assert touched[0].tolist() == np.bincount(c, minlength=k).tolist() and touched[1].tolist() == np.bincount(np.append(w, drawn), minlength=k).tolist()


def test_lm_learns(spark):
    r = random.Random(3)
    pairs = [("salt", "pepper"), ("king", "queen"), ("left", "right"), ("day", "night")]
    texts = [" ".join(x for _ in range(100) for x in r.choice(pairs)) for _ in range(400)]
    got = lm.score(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2), F.col("doc_id") % 4 != 0).filter("doc_id % 4 = 0").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_toxicity_gradient_and_forward_pass():
    r = np.random.default_rng(3)
    bags = [(np.unique(r.integers(0, 64, 9)), None) for _ in range(60)]
    bags = [(i, r.integers(1, 4, len(i))) for i, _ in bags]
    y = r.integers(0, 2, 60)
    m = toxicity.fit(bags, y, float(y.mean()), 64, 1)
    text = "some text of a few words"
    own = np.concatenate(list(toxicity.blocks(text, 64)))
    assert m.score(text) == pytest.approx(1 / (1 + math.exp(-(m.weights[own].astype(float).mean() + m.bias))))
    e, w, b, y = r.standard_normal((7, 3)), r.standard_normal((3, 2)), r.standard_normal(2), np.array([0, 1, 1, 0])
    doc, row, val, weight = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 1, 3, 5, 6]), r.random(6), np.array([1.0, 3.0])

    def loss():
        h = np.zeros((4, 3))
        np.add.at(h, doc, val[:, None] * e[row])
        z = h @ w + b
        return float((weight[y] * (np.log(np.exp(z).sum(1)) - z[np.arange(4), y])).sum() / 4)

    for x, g in zip((e, w, b), toxicity.gradient(e, w, b, doc, row, val, y, weight)):
        for i in np.ndindex(x.shape):
            x[i] += 1e-6
            up = loss()
            x[i] -= 2e-6
            down = loss()
            x[i] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[i], abs=1e-5)


def test_files(spark, docs, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for r in order:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(idfile.write_and_read(docs)) == sorted(want, key=repr)
    assert idfile.write_and_read(none).count() == 0


def test_file_format(monkeypatch):
    monkeypatch.setattr(idfile, "FRAME_IDS", 10)
    f, r = io.BytesIO(), random.Random(1)
    ids = [np.array([r.randrange(50000) for _ in range(r.choice([0, 1, 9, 35]))], "<u4") for _ in range(40)]
    w = idfile.Writer(f)
    for i, x in enumerate(ids):
        w.add(i, x)
    w.close()
    got = idfile.Reader(f)
    assert all(got.ids(i).tolist() == x.tolist() == got.find(i)[0].tolist() for i, x in enumerate(ids))
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.getvalue()), read_across_frames=True).read()
    assert whole == np.concatenate(ids).tobytes()
    raw = bytearray(f.getvalue())
    raw[-9 - 4] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        idfile.Reader(io.BytesIO(bytes(raw))).ids(39 if len(ids[39]) else 38)


def test_file_encoder_matches_library():
    from tokenizers import Tokenizer
    import public_tokenizers

    t, e, r = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), idfile.encoder(None), random.Random(1)
    texts = ["".join(r.choice("ab  c\n\t the'sé1²😀\x1c\x85ΣΑς̈,.<|>E") for _ in range(r.randint(0, 40))) for _ in range(500)] + ["a<|endoftext|>\nB", "<|ENDOFTEXT|> İß ª", "don't we're 's"]
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_file_encoder_keeps_pieces_met_again():
    import public_tokenizers

    e, learned = idfile.Encoder(public_tokenizers.path("word_bpe_49k.json"), 4), []
    learn = e._learn
    e._learn = lambda new: (learned.extend(new), learn(new))
    whole = idfile.encoder(None).encode(["one two three", "one two four five"])
    got = e.encode(["one two three"]) + e.encode(["one two four five"])
    assert [x.tolist() for x in got] == [x.tolist() for x in whole] and sorted(learned) == ["five", "four", "one", "three", "two"]


def test_file_encoder_learns_words_once():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    e, learned = idfile.Encoder(path), []
    learn = e._learn
    e._learn = lambda new: (learned.extend(new), learn(new))
    texts = ["Word word, word. été7 ÉTÉ, word7!", "(word) It's it's été... 77 «ЖАР» жар,"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts[:1]) + e.encode(texts[1:])] == want
    assert sorted(learned) == sorted(["word", ",", ".", "été", "7", "!", "(", ")", "It's", "it's", "...", "«", "»", "жар"])


def test_file_encoder_keeps_words_met_often():
    import public_tokenizers

    e, learned = idfile.Encoder(public_tokenizers.path("word_bpe_49k.json"), 8), []
    learn, whole = e._learn, idfile.encoder(None)
    e._learn = lambda new: (learned.extend(new), learn(new))
    for text in ["the and", "the and", "a b c", "d e f", "g h i", "the and", "j k l"]:
        assert [x.tolist() for x in e.encode([text])] == [x.tolist() for x in whole.encode([text])]
        assert len(e.known) <= 8 and len(e.known) == len(e.ends) - 1 == len(e.met)
    assert learned.count("the") == learned.count("and") == 1


def test_file_encoder_composes_before_it_folds():
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    t, e = Tokenizer.from_file(path), idfile.Encoder(path, 300)
    # J and a caron stay two characters when folded, j and a caron are composed
    texts = ["J\u030c", "a H\u0331 T\u0308 W\u030a Y\u030a", "É\u0323 <\u0338 \u0331h"]
    texts += ["".join(r.choice("abJjHh  \n\x0b\x00\x7f\xa0'09²½.,<|>&éÉ×÷ßÿÞÃ\u030c\u0331\u0338İıſ\u212aΣςӁ漢😀¿’ęŁЖЙאب«»ǰŉ") for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(400)]
    for at in range(0, len(texts), 50):
        assert [x.tolist() for x in e.encode(texts[at : at + 50])] == [t.encode(x, add_special_tokens=False).ids for x in texts[at : at + 50]]


def test_cuckoo_index():
    index, live, r = dedup.CuckooIndex(4), {}, random.Random(6)
    for i in range(6000):
        d = hashlib.sha256(str(r.randrange(3000)).encode()).digest()
        if r.random() < 0.3:
            assert index.delete(d) == (live.pop(d, None) is not None)
        else:
            index.put(d, i)
            live[d] = i
        assert len(index) == len(live)
    assert dict(index.items()) == live and all(index.get(d) == x for d, x in live.items())
    assert index.get(b"x" * 32) is None


def test_exact_dedup(docs, none, monkeypatch):
    key = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in ROWS]
    best = {}
    for (i, t, *_), k in zip(ROWS, key):
        best.setdefault(k, []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((r[0], min(best[k])[3], len(best[k]), r[0] == min(best[k])[3], hashlib.sha256(k.encode()).hexdigest()) for r, k in zip(ROWS, key)), key=repr)
    assert rows(dedup.exact_duplicates(docs)) == want
    monkeypatch.setattr(dedup, "MOST", 3)
    assert rows(dedup.exact_duplicates(docs)) == want and dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_keeps_ids(spark):
    big = 2**60
    data = [(big + 3, "a b"), (big + 1, "ab "), (None, "ab"), (None, "x"), (None, "x "), (big + 5, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "doc_id long, text string, row long").coalesce(1)
    got = [(r.doc_id, r.keep_id, r.kept) for r in dedup.exact_duplicates(df).orderBy("text_sha256", "doc_id").collect()]
    assert sorted(got, key=repr) == sorted([(big + 3, big + 1, False), (big + 1, big + 1, True), (None, big + 1, False), (None, None, True), (None, None, True), (big + 5, big + 5, True)], key=repr)
    assert {r.row for r in dedup.exact_duplicates(df, row="row").filter("kept").collect()} == {1, 4, 5}
    text = dedup.exact_duplicates(df.select(F.col("doc_id").cast("string"), "text")).filter("kept").select("doc_id")
    assert sorted((r.doc_id for r in text.collect()), key=repr) == sorted([str(big + 1), None, None, str(big + 5)], key=repr)


def test_long_texts_in_small_blocks(spark, monkeypatch):
    r = random.Random(12)
    long = " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(2000))
    df = spark.createDataFrame([(1, long), (2, None), (3, "a b")], "doc_id long, text string")
    bag, fp, bands, ids = toxicity.bag(long), simhash.fingerprint(long), similar.bands(similar.minima(similar.shingles(long))), bpe.codec().encode([long])[0].tolist()
    files = rows(idfile.write_and_read(df))
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    monkeypatch.setattr(simhash, "_PART", 7)
    monkeypatch.setattr(similar, "_PART", 7)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    monkeypatch.setattr(idfile, "BLOCK_CHARS", 50)
    assert all((a == b).all() for a, b in zip(bag, toxicity.bag(long))) and fp == simhash.fingerprint(long)
    assert (bands == similar.bands(similar.minima(similar.shingles(long)))).all() and ids == bpe.codec().encode([long])[0].tolist()
    assert rows(idfile.write_and_read(df)) == files


def test_nothing_is_left_behind(spark, docs):
    from pathlib import Path

    from lodestream.session import scratch, shared_dir

    def left():
        return {p.name for p in Path(shared_dir(spark).removeprefix("file://")).iterdir()}

    Path(shared_dir(spark).removeprefix("file://")).mkdir(exist_ok=True)
    before = left()
    with scratch(spark):
        n = [f(docs).count() for f in (dedup.exact_duplicates, simhash.near_duplicates, similar.near_duplicates, idfile.write_and_read)]
        assert n == [len(ROWS)] * 4 and left() > before
    assert left() == before


def _alike(a, b):
    own = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.findall(rb"[^\x20\x09-\x0D]+", x.encode().lower()) for x in (a, b))]
    return len(own[0] & own[1]) * 5 >= 4 * len(own[0] | own[1])


def _piped(docs):
    """(doc_id, text) of the documents that the first four stages keep, by brute force."""
    left = [r for r in docs if re.search(r"[^\W\d_]", r[1] or "")]
    groups = {}
    for n, r in enumerate(left):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append((-len(r[1]), r[0] is None, r[0] or 0, n))
    left = [left[min(g)[3]] for g in groups.values()]
    up = list(range(len(left)))
    for _ in left:
        for i, a in enumerate(left):
            for j, b in enumerate(left[:i]):
                if up[i] != up[j] and _alike(a[1], b[1]):
                    up[i] = up[j] = min(up[i], up[j])
    first = {c: min((left[i][0] is None, left[i][0] or 0, i) for i, x in enumerate(up) if x == c)[2] for c in up}
    return sorted(((left[i][0], left[i][1]) for i in first.values() if not left[i][1].startswith("so ")), key=repr)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    # repeated rows of one id, rows without id, and a further column whose name the stages use
    data = [(i, t, lang, s, len(t or ""), "x") for i, t, lang, s, *_ in ROWS + ROWS[3:6] + [ROWS[-1]] * 2 + [(7, "same text", "en", "s")] * 2]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, ROW string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == docs.columns, name
    want = _piped(data)
    assert rows(df.select("doc_id", "text")) == want
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted((i for i, _ in want), key=repr)
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_workers_keep_no_chunks(spark, docs):
    import pandas as pd

    bpe.encode(docs.repartition(4)).collect()

    def kept(batches):
        for b in batches:
            yield pd.DataFrame({"n": [len(bpe.codec(None, None).raw)] * len(b)})

    assert {r.n for r in spark.range(0, 16, 1, 8).mapInPandas(kept, "n long").collect()} == {0}


def test_similar_gives_heaps_back_between_steps(spark, docs, monkeypatch):
    calls = []
    monkeypatch.setattr(similar, "give_back_heaps", calls.append)
    similar.near_duplicates(docs, radius=simhash.RADIUS)
    assert calls == [spark] * 4


def test_pipeline_stages_begin_with_heaps_given_back(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([("b", "no such item")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    # the driver is the executor here; only whole collections, which shrink a heap, count as the old generation's
    whole = next(x for x in beans if "Old" in x.getName() or "MarkSweep" in x.getName())
    for name, stage in corpus_pipeline.STAGES:
        before = whole.getCollectionCount()
        stage(spark, docs, str(tmp_path))
        assert whole.getCollectionCount() > before, name


def test_pipeline_near_links_by_fingerprints(spark):
    """What operator 5 links is one group, also where shingle sets differ; what sets link stays one group, and both are closed together."""
    import corpus_pipeline

    base, words = "one two three four five " * 100, " ".join(f"w{i}" for i in range(200))
    texts = [base + "alpha beta gamma delta", base + "red green blue black", words, words + " x1", "quite another text of some words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: r.component_id for r in similar.near_duplicates(df).collect()}
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert sets[1] == 1 and prints[1] == 0 and sets[3] == 2
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()) == [0, 2, 4]


def test_pipeline_shuffles_where_many_rows_go(spark, docs, monkeypatch):
    import corpus_pipeline

    few = rows(corpus_pipeline.exact(spark, docs, ""))
    monkeypatch.setattr(corpus_pipeline, "FEW", 0)
    assert rows(corpus_pipeline.exact(spark, docs, "")) == few
