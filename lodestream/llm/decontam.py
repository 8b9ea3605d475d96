"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised (lower case, runs of other than letters and digits become one blank). An item of
m characters may be found with up to k = m // ``CHARS_PER_EDIT`` edits. It is split into k + 1 pieces; k edits
can't touch all of them, so every occurrence holds one piece exactly. An Aho-Corasick automaton over all pieces finds
the hits in one scan of each document, and Myers' bit-parallel distance verifies the stretch
around each hit. Documents aren't shuffled.

An item too short for an edit must be found whole, between word borders: inside longer words a short item is no evidence.

The benchmark is sent to the executors in blocks of at most ``BLOCK_CHARS`` characters, each with a scan
of its own, however large it is; an item longer than that is a block by itself.

Defined cases: null and empty texts match nothing, nor do items without letters and digits; one-word items match every text
that has the word, so a caller who doesn't want that leaves them out of the benchmark; repeated items and repeated documents give a
row each (equal items are searched once); ids of documents and items may be null and of any type; an empty benchmark or no
documents give no rows; texts of any length are scanned whole; further columns are ignored by matches() and pass unchanged through clean().
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices

CHARS_PER_EDIT = 25
BLOCK_CHARS = 1_000_000
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def pieces(pattern: str, k: int) -> list[tuple[int, str]]:
    """``k`` + 1 pieces of nearly equal length, with their offsets."""
    ends = [i * len(pattern) // (k + 1) for i in range(k + 2)]
    return [(a, pattern[a:b]) for a, b in zip(ends, ends[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The smallest edit distance of ``pattern`` to any substring of ``text``, and the first end of one."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """An automaton over the pieces of one block of items (id, text)."""

    def __init__(self, items: list[tuple[object, str]], chars_per_edit: int = CHARS_PER_EDIT):
        import ahocorasick

        same: dict[str, list] = {}
        for i, t in items:
            if p := normalise(t):
                same.setdefault(p, []).append(i)
        self.items = [(ids, p, len(p) // chars_per_edit) for p, ids in same.items()]
        at = defaultdict(list)
        for n, (_, p, k) in enumerate(self.items):
            for off, piece in pieces(p, k):
                at[piece].append((n, off + len(piece)))
        self.auto = ahocorasick.Automaton()
        for piece, places in at.items():
            self.auto.add_word(piece, places)
        if at:
            self.auto.make_automaton()
        self.empty = not at

    def find(self, text: str | None, first: bool = False) -> list[tuple[object, int, int, int]]:
        """(item id, distance, budget, end in the normalised text) of each item that occurs, best place only; with ``first`` at most one."""
        t = normalise(text)
        if self.empty or not t:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, places in self.auto.iter(t):
            for n, off in places:
                starts[n].add(end + 1 - off)
        found = []
        for n in sorted(starts):
            ids, p, k = self.items[n]
            if not k:
                ends = [s + len(p) for s in starts[n] if (not s or t[s - 1] == " ") and t[s + len(p) : s + len(p) + 1] in ("", " ")]
                found += [(i, 0, 0, min(ends)) for i in ids if ends]
                if first and found:
                    break
                continue
            spans: list[list[int]] = []
            for s in sorted(starts[n]):
                a, b = max(0, s - k), min(len(t), s + len(p) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            d, e = min((d, a + e) for a, b in spans for d, e in [myers(p, t[a:b])])
            if d <= k:
                found += [(i, d, k, e) for i in ids]
                if first:
                    break
        return found


_MATCHERS: dict[str, Matcher] = {}


def blocks(bench: DataFrame, item: str, text: str) -> list[tuple[str, object]]:
    """Broadcasts of the benchmark's items, at most BLOCK_CHARS characters each."""
    spark = bench.sparkSession
    rows = bench.select(F.col(item).alias("i"), F.col(text).alias("t")).filter("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = total // (BLOCK_CHARS // 2) + 1
    out: list[tuple[str, object]] = []

    def send(part: list) -> None:
        if part:
            out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(part)))

    for b in range(n):
        part, size = [], 0
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        for i, t in own.toLocalIterator():
            if size + len(t) > BLOCK_CHARS:
                send(part)
                part, size = [], 0
            part.append((i, t))
            size += len(t)
        send(part)
    return out


def _matcher(name: str, held) -> Matcher:
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(held.value)
    return _MATCHERS[name]


def matches(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, budget, end_char."""
    doc_type, item_type = docs.schema[doc_id].dataType.simpleString(), bench.schema[item].dataType.simpleString()
    schema = f"`{doc_id}` {doc_type}, `{item}` {item_type}, distance int, budget int, end_char long"
    rows = docs.select(F.col(doc_id), F.col(text).alias("__text"))

    def scan(name: str, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                m = _matcher(name, held)
                at, got = [], []
                for n, t in enumerate(b["__text"].to_pylist()):
                    for x in m.find(t):
                        at.append(n)
                        got.append(x)
                cols = list(zip(*got)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [b[doc_id].take(pa.array(at, pa.int64())), pa.array(cols[0], item_arrow), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                    names=[doc_id, item, "distance", "budget", "end_char"],
                )

        return rows.mapInArrow(run, schema)

    item_arrow = to_arrow_type(bench.schema[item].dataType)
    scans = [scan(*x) for x in blocks(bench, item, text)]
    return reduce(DataFrame.unionByName, scans) if scans else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, bench: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The documents in which no item occurs, all columns unchanged."""

    def scan(df: DataFrame, name: str, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                m = _matcher(name, held)
                yield b.filter(pa.array([not m.find(t, first=True) for t in b[text].to_pylist()], pa.bool_()))

        return df.mapInArrow(run, df.schema)

    for name, held in blocks(bench, item, text):
        docs = scan(docs, name, held)
    return docs
