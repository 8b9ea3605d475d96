"""SimHash near-dedup over vantage-point trees.

Fingerprint: A-Z are lower-cased, words are runs of ``[^\\x20\\x09-\\x0D]``, shingles are ``width`` words
joined by a blank (fewer words: the whole sequence; none: fingerprint zero), repeats included; a bit is 1 where it
is set in over half of the shingles' XXH64 (UTF-8, seed 42).

Link: fingerprints that differ in at most ``radius`` bits. Only distinct fingerprints are compared.
A vantage-point tree, drawn up from a bounded sample (it sets the balance of the shards, never the
result), deals them out: at a node with vantage v and bound u, those with d(x, v) <= u + radius
go inside, those with d(x, v) > u outside. By the triangle inequality two linked fingerprints
that lie on either side of u are both inside, so every linked pair meets in some shard. A shard splits
further by the same rule and compares what is left block by block. A shard sends on a
spanning forest, at most one link per fingerprint, never all pairs of a group. Components of these
links are found by alternating star contraction over tables in the shared folder.

Defined cases: null text counts as text without words; repeated rows (also of one id) each get a row; null ids are
ignored when a component is named, unless it has no other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

WIDTH, RADIUS = 3, 3
SAMPLE = 65_536
SHARD = 100_000
LEAF = 1024
_PART = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n < 2:
        return xxhash.xxh64_intdigest(joined, seed=42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[width - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _PART):
        part = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at : min(n, at + _PART)].tolist(), ends[at : at + _PART].tolist())])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__id": b["__id"], "fp": np.array([fingerprint(x, width) for x in b["__text"]], np.uint64).view(np.int64)})

    kind = docs.schema[doc_id].dataType.simpleString()
    # the id travels as text: a null among long values would turn them into floats
    got = docs.select(F.col(doc_id).cast("string").alias("__id"), F.col(text).alias("__text")).mapInPandas(run, "__id string, fp long")
    return got.select(F.col("__id").cast(kind).alias(doc_id), "fp")


def split(fps: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """Vantage and bound that leave the fewest pairs to compare; None where no split helps."""
    n, best = len(fps), None
    for v in fps[:: max(1, n // 8)][:8]:
        upto = np.cumsum(np.bincount(np.bitwise_count(fps ^ v), minlength=65 + radius)[: 65 + radius]).astype(float)
        cost = upto[radius:65] ** 2 + (n - upto[: 65 - radius]) ** 2
        u = int(np.argmin(cost))
        if cost[u] < 0.95 * n * n and (best is None or cost[u] < best[0]):
            best = (cost[u], v, u)
    return None if best is None else (best[1], best[2])


def build(sample: np.ndarray, total: int, shard: int, radius: int) -> tuple | None:
    """The tree that deals ``total`` fingerprints like ``sample`` into shards: (vantage, bound, inside, outside), None for a shard."""
    per = total / max(1, len(sample))
    if len(sample) * per <= shard or len(sample) < 64 or not (s := split(sample, radius)):
        return None
    d = np.bitwise_count(sample ^ s[0])
    return (*s, build(sample[d <= s[1] + radius], len(sample[d <= s[1] + radius]) * per, shard, radius), build(sample[d > s[1]], len(sample[d > s[1]]) * per, shard, radius))


def route(tree: tuple | None, fps: np.ndarray, radius: int, name: int = 1) -> Iterator[tuple[str, np.ndarray]]:
    """Shards (names) and the fingerprints that go there."""
    if tree is None or not len(fps):
        if len(fps):
            yield f"{name:x}", fps
        return
    v, u, inside, outside = tree
    d = np.bitwise_count(fps ^ v)
    yield from route(inside, fps[d <= u + radius], radius, 2 * name)
    yield from route(outside, fps[d > u], radius, 2 * name + 1)


class Forest:
    """Union-find over positions, smallest position as the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        r = self.up[at]
        while (r != (x := self.up[r])).any():
            r = x
        self.up[at] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        open_ = a != b
        while open_.any():
            a, b = a[open_], b[open_]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.up, hi, lo)
            a, b = self.roots(hi), self.roots(lo)
            open_ = a != b


def link(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct ``fps`` the position of its component's first member."""
    forest = Forest(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        x = fps[at]
        if len(at) > LEAF and (s := split(x, radius)):
            d = np.bitwise_count(x ^ s[0])
            todo += [at[d <= s[1] + radius], at[d > s[1]]]
            continue
        for k in range(0, len(at), 256):
            i, j = np.nonzero(np.bitwise_count(x[k : k + 256, None] ^ x[None, k:]) <= radius)
            later = j > i
            if later.any():
                forest.join(at[k + i[later]], at[k + j[later]])
    return forest.roots(np.arange(len(fps)))


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``distinct`` (fp) to a forest of links u, v with the same components."""
    spark, total = distinct.sparkSession, distinct.count()
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(build(sample, total, SHARD, radius))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, fps in route(tree.value, b["fp"].to_numpy(np.int64).view(np.uint64), radius):
                yield pd.DataFrame({"shard": name, "fp": fps.view(np.int64)})

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        fps = part["fp"].to_numpy(np.int64).view(np.uint64)
        to = link(fps, radius)
        moved = np.flatnonzero(to != np.arange(len(fps)))
        return pd.DataFrame({"u": fps[moved].view(np.int64), "v": fps[to[moved]].view(np.int64)})

    return distinct.select("fp").mapInPandas(deal, "shard string, fp long").groupBy("shard").applyInPandas(meet, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) to u, root for every node but the roots: alternating large-star and small-star steps."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    old = mark(edges)
    while old[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        big = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct(), "links")
        new = mark(edges)
        if new == old:
            break
        old = new
    return edges.select("u", F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    rows = cut(fingerprints(docs, doc_id, text, width), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("size")), "distinct")
    roots = cut(components(links(distinct, radius)), "roots")
    named = distinct.join(roots, distinct["fp"] == roots["u"], "left").select("fp", "least", "size", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = cut(named.join(ids, "root").select("fp", "size", "component_id"), "groups")
    return join_groups(rows, groups, "fp", "size").select(doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
