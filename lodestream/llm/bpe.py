"""Byte-level BPE by corpus-level merge replay.

A block of documents is cut into chunks at blanks between two non-space characters (no match of the
pre-tokenising pattern crosses one), the distinct chunks that are new are cut by the pattern, and
the distinct words among these are laid out in one array of symbols with links to neighbours. An inverted
index holds, for every rank, the positions whose pair merges to it. Ranks are taken in order,
smallest first; all positions of a rank are merged at once, and only the two neighbours of each
are looked up and entered anew. A merge that opens a pair of smaller rank is taken up next; for tokens of
which the vocabulary allows that, each word merges its leftmost place only before the index is asked again, so the
result is that of merging every word on its own, lowest rank and leftmost first.

Blocks, chunks held from earlier blocks and words are bounded (``BLOCK_CHARS``, ``HELD``); one document may be of any length.

Defined cases: null text counts as empty (no ids, empty bytes); repeated rows are encoded each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

BLOCK_CHARS = 2_000_000
HELD = 400_000
_BLANK = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|^\s|\s$")
_NONE = np.iinfo(np.int32).max


def chunks(text: str) -> list[str]:
    """Pieces whose tokens don't depend on one another; all but the first have lost a leading blank."""
    odd = "  " in text or text[:1].isspace() or text[-1:].isspace() or any(f" {c}" in text or f"{c} " in text for c in _SPACES(text))
    return _BLANK.split(text) if odd else text.split(" ")


def _SPACES(text: str) -> list[str]:
    """White space other than the blank that occurs in the text."""
    return [c for c in _OTHER_SPACES if c in text]


_OTHER_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


class Vocabulary:
    """Ranks of byte strings, which are also their ids, and the table of pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.bytes[r] = t
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs] + [2**62], np.int64)
        self.ranks = np.array([p[1] for p in pairs] + [_NONE], np.int32)
        # tokens that are part of one with a smaller rank
        self.early = {x for k, r in pairs for x in (k >> 32, k & 0xFFFFFFFF) if x > r}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's ids begin (one more than there are words)."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        n = len(flat)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        # symbols sit at 1..n; 0 and n + 1 are outside, and neighbours across words are cut by owner
        sym = np.zeros(n + 2, np.int32)
        sym[1:-1] = self.single[flat]
        owner = np.full(n + 2, -1, np.int32)
        owner[1:-1] = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
        nxt, prv = np.arange(1, n + 3, dtype=np.int32), np.arange(-1, n + 1, dtype=np.int32)
        nxt[n + 1], prv[0] = n + 1, 0
        live = np.ones(n + 2, bool)
        live[[0, n + 1]] = False
        pair = np.full(n + 2, _NONE, np.int32)  # rank of the pair that begins here
        if n:
            pair[1:n] = np.where(owner[1:n] == owner[2 : n + 1], self.rank(sym[1:n], sym[2 : n + 1]), _NONE)
        index: dict[int, list[np.ndarray]] = {}

        def enter(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for r, a, b in zip(ranks[[0, *cuts]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        heap: list[int] = []
        first = np.flatnonzero(pair != _NONE)
        if len(first):
            enter(first, pair[first])
        while heap:
            r = heapq.heappop(heap)
            held = index.pop(r)
            p = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            p = p[live[p] & (pair[p] == r)]
            if not len(p):
                continue
            if len(p) > 1:
                if r in self.early:
                    p, rest = self._leftmost(p, owner)
                    if len(rest):
                        index[r] = [rest]
                        heapq.heappush(heap, r)
                else:
                    p = self._apart(p, nxt)
            q = nxt[p]
            after = nxt[q]
            sym[p] = r
            live[q] = False
            nxt[p] = after
            prv[after] = p
            before = prv[p]
            same = owner[after] == owner[p]
            pair[p] = _NONE
            if same.any():
                pair[p[same]] = self.rank(sym[p[same]], sym[after[same]])
            left = before[owner[before] == owner[p]]
            if len(left):
                pair[left] = self.rank(sym[left], sym[nxt[left]])
            at = np.concatenate((p[same], left))
            at = at[pair[at] != _NONE]
            if len(at):
                enter(at, pair[at])
        keep = np.flatnonzero(live)
        begins = np.searchsorted(owner[keep], np.arange(len(words) + 1))
        return sym[keep], begins

    @staticmethod
    def _leftmost(p: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = owner[p]
        first = np.r_[True, w[1:] != w[:-1]]
        return p[first], p[~first]

    @staticmethod
    def _apart(p: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """Of places that overlap in a row, every other one from the left."""
        touch = nxt[p[:-1]] == p[1:]
        if not touch.any():
            return p
        start = np.r_[True, ~touch]
        run = np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))
        return p[(np.arange(len(p)) - run) % 2 == 0]


class Codec:
    """Encoder and decoder with a bounded store of chunks already encoded."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, held: int = HELD):
        import regex

        self.v, self.words, self.held = vocabulary, regex.compile(pattern).findall, held
        # by chunk: its ids as little-endian 4 bytes each; a document's first chunk, without a blank before it, is a tuple
        self.raw: dict[str | tuple, bytes] = {}
        # by id: a blank and its decimals, filled up with zero bytes
        self.decimals = np.array([f" {i}".encode() for i in range(len(vocabulary.bytes))], "S12" if len(vocabulary.bytes) > 10**7 else "S8")
        self.flat = np.frombuffer(b"".join(vocabulary.bytes), np.uint8)
        self.size = np.array([len(x) for x in vocabulary.bytes], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def learn(self, new: list) -> None:
        # a blank and letters are one word in any case
        found = [[f" {c}"] if c.__class__ is str and c.isalpha() else self.words(f" {c}" if c.__class__ is str else c[0]) for c in new]
        distinct = list(dict.fromkeys(itertools.chain.from_iterable(found)))
        ids, begins = self.v.replay([w.encode() for w in distinct])
        raw, at = ids.astype("<u4").tobytes(), (begins * 4).tolist()
        of = {w: raw[a:b] for w, a, b in zip(distinct, at, at[1:])}
        self.raw.update(zip(new, [of[f[0]] if len(f) == 1 else b"".join([of[w] for w in f]) for f in found]))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut: list[list] = []
        for t in texts:
            parts = chunks(t) if t else []
            if parts:
                parts[0] = (parts[0],)
            cut.append(parts)
        todo = set().union(*cut)
        new = list(todo.difference(self.raw))
        if len(self.raw) + len(new) > self.held:
            self.raw.clear()
            new = list(todo)
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join(map(self.raw.__getitem__, c)), "<u4") for c in cut]

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimals with a blank between."""
        x = self.decimals[ids].view(np.uint8)
        return x[x != 0].tobytes()[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 20):
            part = ids[at : at + (1 << 20)]
            size = self.size[part]
            shift = self.start[part] - (np.cumsum(size) - size)
            out.append(self.flat[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)


@lru_cache(2)
def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    import public_tokenizers

    return Codec(Vocabulary.read(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless ``ids`` is False, ids (array of int)."""

    names = ["__id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + ids]

    def block(c: Codec, keys: list, texts: list[str | None]) -> pa.RecordBatch:
        got = c.encode(texts)
        digests = [[hashlib.sha256(x).hexdigest() for x in (c.decimal(own), c.decode(own))] for own in got]
        columns = [pa.array(keys, pa.string()), pa.array([len(x) for x in got], pa.int64()), *(pa.array(x, pa.string()) for x in zip(*digests))]
        if ids:
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.concatenate(got).astype(np.int32)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        gc.disable()  # millions of small objects without cycles
        try:
            keys, texts, size = [], [], 0
            for b in slices(batches):
                for i, t in zip(b["__id"].to_pylist(), b["__text"].to_pylist()):
                    keys.append(i)
                    texts.append(t)
                    size += len(t or "")
                    if size >= BLOCK_CHARS:
                        yield block(c, keys, texts)
                        keys, texts, size = [], [], 0
            if keys:
                yield block(c, keys, texts)
        finally:
            c.raw.clear()  # tasks share few chunks that are dear, and a worker that waits would keep them
            gc.enable()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = "__id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    got = docs.select(F.col(doc_id).cast("string").alias("__id"), F.col(text).alias("__text")).mapInArrow(tidy(run), schema)
    return got.select(F.col("__id").cast(kind).alias(doc_id), *got.columns[1:])
