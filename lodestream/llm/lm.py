"""Language-model scores from log-bilinear models trained by noise-contrastive estimation.

Tokens: A-Z lower-cased, words of ``[^\\x20\\x09-\\x0D]+``, then one end token. The vocabulary is every training word with a count of
at least ``least``, as long as these are at most ``vocabulary`` (else the most frequent ones, cut between two counts); it grows
with the corpus up to that bound, which keeps the model small enough to broadcast. Classes are the end, the vocabulary and
"any other word".

For each of the two places before a token a log-bilinear model gives class w after class c the logit
q[c] . r[w] + b[w]. Batched matrix products of all q with all r give every context's normaliser, so each model is a distribution
over all classes; the score mixes both evenly. Another word has the class's probability times its share of the smoothed counts of
all other words. The score of a text is the sum of log10 over its tokens.

Training reads every training token once, in ``ROUNDS`` rounds over as many parts of the batches. In a round each task starts
from the model of the round before and descends, in numpy, on its own tokens against noise words drawn from the smoothed unigram;
the tasks' rows are averaged by how often each was touched. So what is counted and trained on grows with the input, and to the driver
comes one model a round, of bounded size.

Word counts are exact, by the word itself (words of over 64 bytes by their BLAKE2b), and never collected. Each task cuts its
documents into chunks of about ``CHUNK`` tokens and numbers a chunk's distinct words; one row a chunk and distinct word is dealt
out by word, so a word crosses the network once a chunk, not once a token, and no word has more rows than there are chunks.

Defined cases: null and empty texts are one end token; without any training token every count is 0 and the model
uniform; repeated rows count and are scored each; ids may be of any type, null or empty; texts of any length are read whole (a text
longer than a chunk is a chunk of its own); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch, slices, tidy, work_dir

VOCABULARY, LEAST = 32_768, 5
CHUNK = 1_000_000
DIM, RATE, NOISE, BATCH, ROUNDS = 16, 0.15, 64, 2048, 2
SHARE = 8_000_000  # tokens a training task
BLOCK = 1024
PLACES = (1, 2)
_LONG = 64
_END = 0
_STEPS = 64  # count classes an octave, for the cut


def _pack(x: np.ndarray) -> bytes:
    """Compressed, byte planes apart: of small numbers the high ones are empty."""
    import zstandard

    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _open(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    width = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def name(word: bytes) -> bytes:
    """The word, or a digest no word can be equal to (it begins with a blank) where the word is long."""
    return word if len(word) <= _LONG else b" " + hashlib.blake2b(word, digest_size=32).digest()


def words_of(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    flat, edges = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)  # blanks at an end of a text leave empty parts
    at = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64))
    return flat.filter(full), np.diff(at[edges - edges[0]])


_CHUNKS = "chunk long, place int, word binary, n long, ids array<string>, sizes binary, learn binary, codes binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.string())), *((k, pa.binary()) for k in ("sizes", "learn", "codes"))])


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of ``_CHUNKS``; columns that aren't given are null."""
    n = len(columns["chunk"])
    return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


class _Chunk:
    """Documents as numbers of the chunk's own words."""

    def __init__(self):
        self.ids, self.learn, self.sizes, self.words, self.tokens = [], [], [], [], 0

    def add(self, ids: list[str | None], learn: list[bool], words: pa.Array, sizes: np.ndarray) -> None:
        """Documents of ``sizes`` tokens, ends counted; ``words`` has no ends."""
        self.ids += ids
        self.learn += learn
        self.sizes.append(sizes)
        self.words.append(words)
        self.tokens += int(sizes.sum())

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        own, learn, sizes = pa.chunked_array(self.words).dictionary_encode().combine_chunks(), np.array(self.learn, bool), np.concatenate(self.sizes)
        codes, word = np.ones(self.tokens, np.bool_), own.dictionary.cast(pa.binary())
        codes[np.cumsum(sizes) - 1] = False
        at, codes = np.flatnonzero(codes), np.zeros(self.tokens, "<i4")  # the end is number 0
        codes[at] = own.indices.to_numpy() + 1
        n = np.bincount(codes[np.repeat(learn, sizes)], minlength=len(word) + 1)
        long = pc.greater(pc.binary_length(word), _LONG)
        word = pc.replace_with_mask(word, long, pa.array(map(name, word.filter(long).to_pylist()), pa.binary()))
        yield _rows(chunk=pa.array([chunk]), place=pa.array([-1], pa.int32()), n=pa.array([0]), ids=pa.array([self.ids], pa.list_(pa.string())), **{k: pa.array([_pack(x)], pa.binary()) for k, x in (("sizes", sizes), ("learn", learn), ("codes", codes))})
        yield _rows(chunk=pa.array(np.full(len(n), chunk)), place=pa.array(np.arange(len(n), dtype=np.int32)), word=pa.concat_arrays([pa.array([b""]), word]), n=pa.array(n))


def chunked(docs: DataFrame, learn: Column, doc_id: str, text: str) -> DataFrame:
    """Per chunk its documents (place -1) and one row a distinct word, with its number and its count among training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for b in slices(batches):
            ids, own = b.column(0).to_pylist(), b.column(1).to_pylist()
            words, sizes = words_of(b.column(2))
            edges, tokens = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(sizes + 1))
            k = 0
            while k < len(ids):
                to = min(len(ids), int(np.searchsorted(tokens, tokens[k] + CHUNK - chunk.tokens)))
                chunk.add(ids[k:to], own[k:to], words[edges[k] : edges[to]], sizes[k:to] + 1)
                k = to
                if chunk.tokens >= CHUNK:
                    yield from chunk.rows(at)
                    at, chunk = at + 1, _Chunk()
        if chunk.ids:
            yield from chunk.rows(at)

    return docs.select(F.col(doc_id).cast("string").alias("id"), learn.alias("learn"), F.col(text).alias("text")).mapInArrow(tidy(run), _CHUNKS)


def vocabulary_of(counted: DataFrame, most: int, least: int) -> DataFrame:
    """word, c and number (1 is the most frequent) of the vocabulary: at most ``most`` - 2 words."""
    words = counted.filter(F.col("first") & (F.length("word") > 0) & (F.col("c") >= least)).select("word", "c", F.floor(F.log2("c") * _STEPS).alias("size"))
    taken, floor = 0, 1 << 30
    for r in sorted(words.groupBy("size").count().collect(), reverse=True):
        if taken + r["count"] > most - 2:
            break
        taken, floor = taken + r["count"], r["size"]
    return words.filter(F.col("size") >= floor).select("word", "c", F.row_number().over(Window.orderBy(F.desc("c"), "word")).alias("number"))


def contexts(w: np.ndarray, starts: np.ndarray, place: int) -> np.ndarray:
    """The class ``place`` tokens before each token; before a document stands the end."""
    out = np.full(len(w), _END, w.dtype)
    out[place:] = w[:-place]
    for k in range(place):
        at = starts + k
        out[at[at < np.append(starts[1:], len(w))]] = _END
    return out


def _numbered(classes: int, n: int, v: int, rest: int, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """A chunk's documents as classes, with the parts of the scores that need counts."""
    if not len(docs):
        return pd.DataFrame({k: [] for k in ("ids", "sizes", "learn", "w", "sums")})
    row = docs.iloc[0]
    sizes, learn, codes = _open(row["sizes"], "<i8"), row["learn"], _open(row["codes"], "<i4")
    place = words["place"].to_numpy()
    c, number = np.zeros(len(place), np.int64), np.zeros(len(place), "<u2")
    c[place], number[place] = words["c"].to_numpy(), words["number"].to_numpy()
    number[0] = _END
    starts = np.cumsum(sizes) - sizes
    log = np.log10(c + 1.0)
    w = number[codes]
    base = np.add.reduceat(log[codes], starts) - sizes * np.log10(n + v + 1.0)
    tail = np.add.reduceat(np.where(w == classes - 1, log[codes] - np.log10(max(1, rest)), 0.0), starts)
    known = np.add.reduceat((c > 0)[codes], starts, dtype=np.int64)
    return pd.DataFrame({"ids": [row["ids"]], "sizes": [row["sizes"]], "learn": [learn], "w": [_pack(w)], "sums": [_pack(np.stack([base, tail, known.astype(float)]).reshape(-1))]})


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def distinct(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``x``, all below ``k``, in order, and for each of ``x`` which of them it is."""
    met = np.zeros(k, bool)
    met[x] = True
    own = np.flatnonzero(met)
    number = np.empty(k, np.intp)
    number[own] = np.arange(len(own))
    return own, number[x]


def totals(at: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of ``x`` by their numbers ``at``, all below ``k``."""
    places = np.arange(k * x.shape[1]).reshape(k, -1)
    return np.bincount(places.take(at, 0).reshape(-1), x.reshape(-1), places.size).reshape(places.shape).astype(x.dtype)


def gradient(h: np.ndarray, seen: np.ndarray, noise: np.ndarray, bias: tuple[np.ndarray, np.ndarray], floor: tuple[np.ndarray, np.ndarray], at: np.ndarray | None = None) -> tuple:
    """Noise-contrastive gradients of a batch: for contexts ``h``, the vectors of the seen words and of the noise, and both biases.

    ``floor`` is the log of (noise words a seen word * their probability), for both; ``at`` is the row of ``h`` that each seen word
    follows (without it, its own), so a context that occurs often meets the noise once and counts as often. The loss is the sum of
    -log s(x) over seen words and -log(1 - s(x)) over every seen word's context and noise word, with x a logit less its floor.
    """
    at = np.arange(len(h)) if at is None else at
    own, times = h.take(at, 0), np.bincount(at, minlength=len(h)).astype(h.dtype)
    up = -sigmoid(floor[0] - bias[0] - np.einsum("ij,ij->i", own, seen))
    down = h @ noise.T
    down += bias[1] - floor[1]
    sigmoid(down)
    return totals(at, up[:, None] * seen, len(h)) + times[:, None] * (down @ noise), up[:, None] * own, down.T @ (times[:, None] * h), up, times @ down


class Place:
    """One place's model: context rows (DIM values and their step sum) and word rows (DIM values, bias and both step sums)."""

    def __init__(self, noise: np.ndarray, seed: int):
        r = np.random.default_rng(seed)
        k = len(noise)
        self.context = np.concatenate((r.standard_normal((k, DIM)) * 0.1, np.zeros((k, 1))), 1).astype(np.float32)
        self.word = np.concatenate((r.standard_normal((k, DIM)) * 0.1, np.log(noise)[:, None], np.zeros((k, 2))), 1).astype(np.float32)

    def descend(self, c: np.ndarray, w: np.ndarray, drawn: np.ndarray, floor: np.ndarray, touched: tuple[np.ndarray, np.ndarray]) -> None:
        """One step on contexts ``c``, their words ``w`` and the noise ``drawn``."""
        k, n = len(floor), len(w)
        (uc, ic), (uw, iw) = distinct(c, k), distinct(np.concatenate((w, drawn)), k)
        own, words, f = self.context.take(uc, 0), self.word.take(uw, 0), floor[uw]
        h, r, b = (np.ascontiguousarray(x) for x in (own[:, :DIM], words[:, :DIM], words[:, DIM]))
        seen, noise = iw[:n], iw[n:]
        gc_, up, down, bu, bd = gradient(h, r.take(seen, 0), r.take(noise, 0), (b[seen], b[noise]), (f[seen], f[noise]), ic)
        gr, gb = totals(iw, np.concatenate((up, down)), len(uw)), np.bincount(iw, np.concatenate((bu, bd)), len(uw)).astype(np.float32)
        own[:, DIM] += np.einsum("ij,ij->i", gc_, gc_) / DIM
        words[:, DIM + 1] += np.einsum("ij,ij->i", gr, gr) / DIM
        words[:, DIM + 2] += gb * gb
        own[:, :DIM] = h - gc_ * (RATE / np.sqrt(own[:, DIM:] + 1e-3))
        words[:, :DIM] = r - gr * (RATE / np.sqrt(words[:, DIM + 1 : DIM + 2] + 1e-3))
        words[:, DIM] -= 0.1 * RATE * gb / np.sqrt(words[:, DIM + 2] + 1e-3)
        self.context[uc], self.word[uw] = own, words
        touched[0][uc] += np.bincount(ic)
        touched[1][uw] += np.bincount(iw)

    def norms(self, a: int, b: int) -> np.ndarray:
        """Log normalisers of the contexts from ``a`` up to ``b``."""
        r, bias = self.word[:, :DIM].T.copy(), self.word[:, DIM]
        out = []
        for k in range(a, b, 16):  # as many as a core's cache holds
            x = self.context[k : min(b, k + 16), :DIM] @ r
            x += bias
            top = x.max(1)
            x -= top[:, None]
            out.append(top + np.log(np.exp(x, out=x).sum(1, dtype=np.float64)))
        return np.concatenate(out)

    def log(self, c: np.ndarray, w: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Natural log of the probability of class ``w`` after ``c``."""
        h, r, bias = (np.ascontiguousarray(x) for x in (self.context[:, :DIM], self.word[:, :DIM], self.word[:, DIM]))
        out = bias.take(w) - norm.take(c)
        for k in range(0, len(w), 4096):
            out[k : k + 4096] += np.einsum("ij,ij->i", h.take(c[k : k + 4096], 0), r.take(w[k : k + 4096], 0))
        return out


class Model:
    """Both places' models over classes of the smoothed unigram ``noise``."""

    def __init__(self, noise: np.ndarray, trained: bool = True):
        self.noise, self.places = noise, [Place(noise, p) for p in PLACES]
        if not trained:
            for p in self.places:
                p.context[:], p.word[:] = 0, 0
        self.norm: list[np.ndarray] = []

    def log10(self, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's class."""
        own = [m.log(contexts(w, starts, p), w, z) for p, m, z in zip(PLACES, self.places, self.norm)]
        return (np.logaddexp.reduce(own) - np.log(len(own))) / np.log(10)


def train_round(model: Model, rows: Iterator[pd.DataFrame], turn: int, seed: int) -> Iterator[pd.DataFrame]:
    """Descend on this task's training tokens; returns blocks of the rows it touched, with how often."""
    r = np.random.default_rng((seed, turn))
    edges, floor = np.cumsum(model.noise), np.log(NOISE * model.noise).astype(np.float32)
    k = len(floor)
    touched = [(np.zeros(k, np.int64), np.zeros(k, np.int64)) for _ in PLACES]
    for b in rows:
        for sizes, learn, w in zip(b["sizes"], b["learn"], b["w"]):
            sizes, learn, w = _open(sizes, "<i8"), _open(learn, "?"), _open(w, "<u2")
            starts, use = np.cumsum(sizes) - sizes, np.repeat(learn, sizes)
            before, own = [contexts(w, starts, p)[use] for p in PLACES], w[use]
            for at in r.permutation(np.arange(turn * BATCH, len(own), ROUNDS * BATCH)):
                drawn = np.minimum(np.searchsorted(edges, r.random(NOISE)), k - 1).astype(own.dtype)
                for m, c, t in zip(model.places, before, touched):
                    m.descend(c[at : at + BATCH], own[at : at + BATCH], drawn, floor, t)
    for p, (m, t) in enumerate(zip(model.places, touched)):
        for kind, (x, n) in enumerate(((m.context, t[0]), (m.word, t[1]))):
            for at in range(0, k, BLOCK):
                if n[at : at + BLOCK].any():
                    own = x[at : at + BLOCK].copy()
                    own[:, DIM + kind :] **= 0.5  # step sums outgrow two bytes, their roots don't
                    yield pd.DataFrame({"key": [f"{p} {kind} {at}"], "n": [n[at : at + BLOCK].astype("<i8").tobytes()], "x": [own.astype("<f2").tobytes()]})


def _average(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of all tasks to one a key: sums of touches and of rows weighted by them."""
    held: dict[str, list] = {}
    for b in rows:
        for key, n, x in zip(b["key"], b["n"], b["x"]):
            n = np.frombuffer(n, "<i8").astype(np.float64)
            x = n[:, None] * np.frombuffer(x, "<f2").reshape(len(n), -1)
            own = held.setdefault(key, [np.zeros_like(n), np.zeros_like(x)])
            own[0] += n
            own[1] += x
    for key, (n, x) in held.items():
        yield pd.DataFrame({"key": [key], "n": [n.tobytes()], "x": [x.tobytes()]})


_BLOCKS = "key string, n binary, x binary"


def train(numbered: DataFrame, noise: np.ndarray, tokens: int) -> Model:
    """A model of the classes with smoothed unigram ``noise``, trained on the chunks of ``numbered``."""
    spark, model = numbered.sparkSession, Model(noise, tokens > 0)
    rows = numbered.select("sizes", "learn", "w").coalesce(max(1, -(-tokens // SHARE)))
    for turn in range(ROUNDS if tokens else 0):
        held = spark.sparkContext.broadcast(model)

        def run(b: Iterator[pd.DataFrame], turn=turn, held=held) -> Iterator[pd.DataFrame]:
            own = Model(held.value.noise)
            for m, x in zip(own.places, held.value.places):
                m.context, m.word = x.context.copy(), x.word.copy()
            return train_round(own, b, turn, TaskContext.get().partitionId())

        for r in rows.mapInPandas(tidy(run), _BLOCKS).repartition("key").mapInPandas(_average, _BLOCKS).toLocalIterator():
            p, kind, at = map(int, r.key.split())
            n = np.frombuffer(r.n, np.float64)
            x = np.frombuffer(r.x, np.float64).reshape(len(n), -1)
            to = (model.places[p].context, model.places[p].word)[kind][at : at + len(n)]
            new = x[n > 0] / n[n > 0, None]
            new[:, DIM + kind :] **= 2
            to[n > 0] = new
    held = spark.sparkContext.broadcast(model)

    def norms(b: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in b:
            for at in x["id"]:
                z = [m.norms(at, min(len(noise), at + BLOCK)) for m in held.value.places]
                yield pd.DataFrame({"at": [at], "z": [np.concatenate(z).tobytes()]})

    blocks = -(-len(noise) // BLOCK)
    got = sorted(spark.range(0, blocks * BLOCK, BLOCK, blocks).mapInPandas(norms, "at long, z binary").collect())
    model.norm = [np.concatenate(x) for x in zip(*(np.frombuffer(r.z, np.float64).reshape(len(PLACES), -1) for r in got))]
    return model


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", vocabulary: int = VOCABULARY, least: int = LEAST) -> DataFrame:
    """Train on the rows where ``learn`` is true and score all; ``vocabulary`` is at most 65,536.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the model), both log10.
    """
    spark, home = docs.sparkSession, work_dir(docs.sparkSession)
    with scratch(spark):
        chunks = cut(chunked(docs, F.coalesce(learn, F.lit(False)), doc_id, text), "lm-chunks")
        every = Window.partitionBy("word")
        words = chunks.filter("place >= 0").select("chunk", "place", "word", F.sum("n").over(every).alias("c"), F.min("chunk").over(every).alias("met"))
        kept = F.when((F.col("c") >= least) | (F.length("word") == 0), F.col("word"))  # of other words only the counts are needed
        counted = cut(words.select("chunk", "place", kept.alias("word"), (F.col("chunk") == F.col("met")).alias("first"), "c"), "lm-counted")
        n, v, end = counted.filter("first").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.max(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
        known = cut(vocabulary_of(counted, vocabulary, least), "lm-vocabulary")
        top = np.array([r.c for r in known.select("c", "number").orderBy("number").collect()], np.int64)
        classes = len(top) + 2
        taken = int((top + 1).sum()) + (end + 1 if end else 0)
        rest = n + v + 1 - taken  # smoothed counts of all other words, the unseen one included
        uni = np.concatenate(([end], top, [n - end - top.sum()])).astype(np.float64)

        def number(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _numbered(classes, n, v, rest, a, b)

        named = counted.join(F.broadcast(known.select("word", "number")), "word", "left").select("chunk", "place", "c", F.coalesce("number", F.lit(classes - 1)).alias("number"))
        left = chunks.filter("place < 0").select("chunk", "ids", "sizes", "learn", "codes").groupBy("chunk")
        numbered = left.cogroup(named.groupBy("chunk")).applyInPandas(number, "ids array<string>, sizes binary, learn binary, w binary, sums binary")
        numbered = cut(numbered, "lm-numbered", home)
    model = spark.sparkContext.broadcast(train(numbered, (uni + 1) / (uni.sum() + classes), n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, sizes, w, s in zip(b["ids"], b["sizes"], b["w"], b["sums"]):
                sizes, w = _open(sizes, "<i8"), _open(w, "<u2")
                base, tail, seen = _open(s, "<f8").reshape(3, -1)
                starts = np.cumsum(sizes) - sizes
                own = np.add.reduceat(model.value.log10(w, starts), starts)
                yield pd.DataFrame({"id": ids, "n_tokens": sizes, "n_known": seen.astype(np.int64), "train_tokens": n, "base_score": base, "score": own + tail})

    kind = docs.schema[doc_id].dataType.simpleString()
    got = numbered.select("ids", "sizes", "w", "sums").mapInPandas(tidy(run), "id string, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return got.select(F.col("id").cast(kind).alias(doc_id), *got.columns[1:])
