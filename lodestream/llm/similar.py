"""Near-dedup by the similarity of word shingles: candidates by MinHash, each verified on the whole shingle sets.

Words are those of SimHash (A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``); a text is the set of the XXH64 values (seed 42) of its ``WIDTH``
words joined by a blank (fewer words: the whole sequence; none: the empty set). Two texts are linked where their
sets' Jaccard similarity is at least ``ALIKE``, a fraction held in whole numbers; groups are components of links.

Equal sets are one node. A node goes to ``BANDS`` buckets, each named by ``ROWS`` minima: two nodes of similarity 0.8 miss each
other in every bucket with a probability of (1 - 0.8**4)**24 = 3e-6, more similar ones with less. Nodes of a bucket
are compared with two leaders first, then in ``TURNS`` turns those outside the bucket's main component with ``LEADS`` more of its nodes; what
is then in different components of one bucket is compared pair by pair, so a large group of copies never forms all its pairs. Texts that share no more than a passage meet in a bucket too: such pairs are
told by their sketches (four bits of each minimum) and never reach the sets. At similarity 0.8 a minimum's bits differ with a probability
of 3/16, in 18 of 96 places on average; over ``UNLIKE`` of them differ with a probability of 1e-6. Nodes
of a large bucket are dealt out in blocks, of which a task compares two, so that no task holds a whole bucket and no pair is written.

Defined cases: as in SimHash; a text of any length is one set of its distinct shingles; with a row column exactly one row of each
group is kept, that with the smallest id (null last), then the smallest row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FEW, cut, few, give_back_heaps, join_groups, slices, tidy
from .simhash import components, fingerprint
from .simhash import links as by_prints

WIDTH, ALIKE = 5, (4, 5)
BANDS, ROWS = 24, 4
UNLIKE = 37
LEADS, TURNS = 4, 1
CHUNK, VALUES = 1000, 1_000_000
_BITS = 26
_SKETCH = BANDS * ROWS // 16
_PART = 4096
_ODD = np.random.default_rng(5).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's shingle values."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends)))


def minima(own: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the hash functions."""
    least = np.full(len(_ODD), 2**64 - 1, np.uint64)
    for at in range(0, len(own), _PART):
        np.minimum(least, (own[at : at + _PART] * _ODD[:, None]).min(1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """Names of the buckets of a set with these minima."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, mixed from all of its bits (the top ones of a least value are all nought), sixteen minima in a number."""
    bits = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
    return np.bitwise_or.reduce(bits.reshape(_SKETCH, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def unlike(p: str, q: str) -> Column:
    """In how many places two sketch columns differ."""
    out = F.lit(0)
    for i in range(_SKETCH):
        out = out + F.expr(f"bit_count((({p}[{i}] ^ {q}[{i}]) | shiftrightunsigned({p}[{i}] ^ {q}[{i}], 1) | shiftrightunsigned({p}[{i}] ^ {q}[{i}], 2) | shiftrightunsigned({p}[{i}] ^ {q}[{i}], 3)) & {0x1111111111111111}L)")
    return out


def nodes(docs: DataFrame, doc_id: str, text: str, row: str | None = None, prints: bool = False) -> DataFrame:
    """id, row (0 without such a column), node (name of the shingle set), n (its size), h (hash of the text), the buckets, the sketch and, where ``prints``, the SimHash fingerprint (else 0) of each row."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [shingles(x.as_py()) for x in b["text"]]
            name = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            least = [minima(x) for x in own]
            ends = np.arange(len(own) + 1, dtype=np.int32)
            keys, marks = (np.array([of(x).view(np.int64) for x in least]).reshape(-1) for of in (bands, sketch))
            lists = [pa.ListArray.from_arrays(ends * BANDS, keys), pa.ListArray.from_arrays(ends * _SKETCH, marks)]
            fps = np.array([fingerprint(x.as_py()) if prints else 0 for x in b["text"]], np.uint64).view(np.int64)
            columns = [b["id"], b["row"], pa.array(name), pa.array([len(x) for x in own], pa.int64()), b["h"], *lists, pa.array(fps)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "node", "n", "h", "bands", "sketch", "fp"])

    number = F.col(row).cast("long") if row else F.lit(0).cast("long")
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), number.alias("row"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(tidy(run), f"id {kind}, row long, node long, n long, h long, bands array<long>, sketch array<long>, fp long")


def sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """node and its set for the texts whose hash (h) is in ``wanted``; a few more come along, as the filter holds ``_BITS`` bits of it."""
    import xxhash

    low = wanted.select(F.expr(f"h & {(1 << _BITS) - 1}").alias("h"))
    # bitmaps of 4096 bytes: however many texts are wanted, the driver gets 8 MB at most
    maps = low.groupBy(F.expr("shiftright(h, 15)").alias("at")).agg(F.bitmap_construct_agg(F.expr("h & 32767")).alias("bits"))
    seen = np.zeros(1 << _BITS - 3, np.uint8)
    for r in maps.collect():
        seen[r["at"] << 12 : (r["at"] + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    seen = docs.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            h = b["h"].to_numpy()
            at = h & ((1 << _BITS) - 1)
            use = np.flatnonzero(seen.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            own = [shingles(b["text"][int(i)].as_py()) for i in use]
            name = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(h[use]), pa.ListArray.from_arrays(ends, values)], names=["node", "h", "own"])

    return docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(tidy(run), "node long, h long, own array<long>")


def verified(pairs: DataFrame, have: DataFrame) -> DataFrame:
    """The links u, v among the written ``pairs`` (a, b); ``a`` may be in most of them.

    Sets of an ``a`` with over a thousandth of the pairs (a thousand of them at most) are broadcast, so those pairs carry no set through a shuffle.
    """
    floor = max(50, pairs.count() // 1000)
    often = F.broadcast(pairs.groupBy("a").agg(F.count("*").alias("size")).filter(F.col("size") > floor).select("a"))
    left, right = have.select(F.col("node").alias("a"), F.col("own").alias("p")), have.select(F.col("node").alias("b"), F.col("own").alias("q"))
    led = pairs.join(often, "a", "left_semi").join(right, "b").join(F.broadcast(left.join(often, "a", "left_semi")), "a")
    both = led.select("a", "b", "p", "q").unionByName(pairs.join(often, "a", "left_anti").join(left, "a").join(right, "b").select("a", "b", "p", "q"))
    both = both.select("a", "b", (F.size("p") + F.size("q")).alias("all"), F.size(F.array_intersect("p", "q")).alias("same"))
    return both.filter(F.col("same") * ALIKE[1] >= (F.col("all") - F.col("same")) * ALIKE[0]).select(F.col("a").alias("u"), F.col("b").alias("v"))


def apart(members: DataFrame, marks: DataFrame, found: DataFrame) -> DataFrame:
    """The ``members`` (key, node, n, size) of buckets whose nodes the links ``found`` leave in several components.

    Written with root (of the node), main (the root of most of the bucket's nodes), size (of the bucket) and sketch.
    """
    roots = cut(components(found), "roots")
    named = cut(members.filter("size > 2").join(roots.withColumnRenamed("u", "node"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), "named")
    per = named.groupBy("key", "root").agg(F.count("*").alias("k"))
    main = per.groupBy("key").agg(F.sum("k").alias("size"), F.max_by("root", F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    return cut(join_groups(named, main.drop("roots"), "key", "size").join(marks, "node"), "apart")


def tries(left: DataFrame, turn: int) -> DataFrame:
    """Pairs a, b of ``LEADS`` nodes of each bucket's main component, others at each ``turn``, and its nodes outside, where sketches and sizes allow a link."""
    of = F.struct("node", "n", "sketch")
    some = [F.min_by(of, F.xxhash64("node", F.lit(turn * LEADS + i))) for i in range(LEADS)]
    leads = left.filter("root = main").groupBy("key").agg(F.any_value("size").alias("size"), F.array_distinct(F.array(*some)).alias("leads"))
    got = join_groups(left.filter("root <> main").drop("size"), leads, "key", "size").select(F.explode("leads").alias("lead"), F.col("node").alias("b"), "n", F.col("sketch").alias("q"))
    got = got.select(F.col("lead.node").alias("a"), F.col("lead.n").alias("m"), F.col("lead.sketch").alias("p"), "b", "n", "q")
    return got.filter(fits() & (unlike("p", "q") <= UNLIKE)).select("a", "b").distinct()


def fits() -> Column:
    """Whether sets of n and m values can be similar enough."""
    return F.least("n", "m") * ALIKE[1] >= F.greatest("n", "m") * ALIKE[0]


def meet(part: pd.DataFrame) -> pd.DataFrame:
    """The links between the two blocks (up, down) of a cell, at most one from a node to each component."""
    part = part[part["n"] > 0]
    up, down = part[part["block"] == part["up"]], part[part["block"] == part["down"]]
    if not len(up) or not len(down):
        return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
    marks = [np.stack(x["sketch"].to_numpy()).astype(np.int64).view(np.uint8) for x in (up, down)]
    n, node, root = (down[c].to_numpy(np.int64) for c in ("n", "node", "root"))
    known, codes = np.unique(np.concatenate(down["own"].to_numpy()), return_inverse=True)
    ends, out = np.cumsum(n), []
    for mark, m, a, r, own in zip(marks[0], up["n"], up["node"], up["root"], up["own"]):
        apart = marks[1] ^ mark
        unlike = ((apart & 15) > 0).sum(1) + (apart > 15).sum(1)
        at = np.flatnonzero((root != r) & (unlike <= UNLIKE) & (np.minimum(n, m) * ALIKE[1] >= np.maximum(n, m) * ALIKE[0]))
        if len(at):
            seen = np.zeros(len(known) + 1, bool)
            seen[np.searchsorted(known, own)[np.isin(own, known, assume_unique=True)]] = True
            same = np.array([np.count_nonzero(seen[codes[ends[k] - n[k] : ends[k]]]) for k in at])
            at = at[same * ALIKE[1] >= (m + n[at] - same) * ALIKE[0]]
            out += [(a, node[k]) for k in at[np.unique(root[at], return_index=True)[1]]]
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def facing(rows: DataFrame) -> DataFrame:
    """node, block (its own) and the distinct blocks (others) that it is compared with, over all buckets of the written ``rows`` (key, node, block, outside, size); one row a node, however many buckets name a block."""
    blocks = [F.sort_array(F.collect_set(F.when(F.col("outside") == x, F.col("block")))).alias(name) for x, name in ((True, "others"), (False, "inner"))]
    blocks = rows.groupBy("key").agg(F.any_value("size").alias("size"), *blocks)
    own = F.when(F.col("outside"), F.concat("others", "inner")).otherwise(F.col("others"))
    return join_groups(rows.select("key", "node", "block", "outside"), blocks, "key", "size").groupBy("node", "block").agg(F.array_distinct(F.flatten(F.collect_set(own))).alias("others"))


def met(left: DataFrame, have: DataFrame) -> DataFrame:
    """All links between different components of a bucket of ``left``.

    Each node has a block, by the largest of its buckets and whether it is outside of some bucket's main component. A node goes to a cell for each
    block in its buckets, but never two blocks inside to one; a cell compares two blocks, of ``CHUNK`` nodes and ``VALUES`` values each on average, or one with itself.
    """
    home = left.groupBy("node").agg(F.max_by("key", F.struct("size", "key")).alias("home"), F.max(F.col("root") != F.col("main")).alias("outside"), F.any_value("n").alias("n"))
    home = cut(home, "home")
    whole = home.groupBy("home", "outside").agg(F.count("*").alias("k"), F.greatest(F.count("*") / CHUNK, F.sum("n") / VALUES).alias("blocks"))
    whole = whole.select(F.xxhash64("home", "outside").alias("block"), "k", F.ceil("blocks").alias("blocks"))
    home = cut(home.select("node", "outside", F.xxhash64("home", "outside").alias("block")), "home")
    home = join_groups(home, whole, "block", "k").select("node", "outside", F.xxhash64("block", F.pmod(F.xxhash64("node", F.lit(1)), "blocks")).alias("block"))
    rows = cut(left.select("key", "node", "root", "n", "sketch", "size").join(home, "node"), "blocks")
    cells = facing(rows).select("node", "block", F.explode("others").alias("other"))
    cells = cells.select("node", "block", F.least("block", "other").alias("up"), F.greatest("block", "other").alias("down"))
    facts = rows.groupBy("node").agg(F.any_value("root").alias("root"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch"))
    cells = cells.join(facts.join(have.select("node", "own"), "node"), "node")
    return cells.groupBy("up", "down").applyInPandas(meet, "u long, v long")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def links(docs: DataFrame, distinct: DataFrame, text: str) -> DataFrame:
    """Links u, v between the nodes of ``distinct`` (node, n, h, bands, sketch)."""
    own = cut(distinct.select("node", F.explode("bands").alias("key")), "buckets")
    shared = cut(own.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "shared")
    n = distinct.select("node", "n", "h")
    most = own.join(few(shared), "key") if shared.count() <= FEW else join_groups(own, shared, "key", "size")
    full = cut(most.join(n, "node"), "full")
    # the same two of a group lead in all its buckets, so that few pairs differ
    lead, order = F.struct("node", "n"), F.xxhash64("node")
    leads = full.groupBy("key").agg(F.any_value("size").alias("size"), F.array(F.min_by(lead, order), F.max_by(lead, order)).alias("leads"))
    members = cut(join_groups(full.drop("size"), leads, "key", "size"), "members")
    have = sets(docs, text, members)
    have = cut(have.join(members.groupBy("node").agg(F.min("h").alias("h")), ["node", "h"], "left_semi").dropDuplicates(["node"]), "sets")
    give_back_heaps(docs.sparkSession)

    first = members.select(F.explode("leads").alias("lead"), F.col("node").alias("b"), "n").select(F.col("lead.node").alias("a"), F.col("lead.n").alias("m"), "b", "n")
    first = cut(first.filter((F.col("a") != F.col("b")) & fits()).select("a", "b").distinct(), "pairs")
    marks = distinct.select("node", "sketch")
    leading = marks.withColumnsRenamed({"node": "a", "sketch": "p"}).join(first.groupBy("a").agg(F.count("*").alias("size")), "a")
    tried = join_groups(first, leading, "a", "size").join(marks.withColumnsRenamed({"node": "b", "sketch": "q"}), "b")
    first = cut(tried.filter(unlike("p", "q") <= UNLIKE).select("a", "b"), "pairs")
    found = cut(verified(first, have), "verified")
    done = first
    left = apart(members, marks, found)
    give_back_heaps(docs.sparkSession)
    for turn in range(TURNS):
        more = cut(tries(left, turn).join(both_ways(done), ["a", "b"], "left_anti"), "pairs")
        new = cut(verified(more, have), "verified")
        if not new.head(1):
            break
        done, found = done.unionByName(more), found.unionByName(new)
        left = apart(members, marks, found)
    return found.unionByName(met(left, have))


def printed(rows: DataFrame, radius: int) -> DataFrame:
    """Links u, v that put nodes of ``rows`` (node, fp) in one group where SimHash's vantage-point trees link their fingerprints (operator 5)."""
    pairs = cut(rows.select("node", "fp").distinct(), "prints")
    roots = cut(components(by_prints(cut(pairs.select("fp").distinct(), "fps"), radius)), "roots")
    named = cut(pairs.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root")).distinct(), "named")
    hubs = named.groupBy("root").agg(F.count("*").alias("size"), F.min("node").alias("v")).filter("size > 1")
    return join_groups(named, hubs, "root", "size").select(F.col("node").alias("u"), "v").filter("u <> v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None, radius: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (smallest id reachable); with ``row``, a column of distinct whole numbers, also that and kept.

    With ``radius``, texts whose SimHash fingerprints differ in that many bits at most are linked too, and groups are closed over both kinds of links.
    """
    rows = cut(nodes(docs, doc_id, text, row, radius is not None), "nodes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    distinct = cut(rows.groupBy("node").agg(first, F.count("*").alias("size"), F.min("h").alias("h"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")), "distinct")
    give_back_heaps(docs.sparkSession)  # here and between the steps below: each fills the heaps anew
    found = links(docs, distinct, text)
    if radius is not None:
        found = found.unionByName(printed(rows, radius))
    found = cut(found, "found")
    give_back_heaps(docs.sparkSession)
    roots = cut(components(found), "roots")
    named = distinct.join(roots, distinct["node"] == roots["u"], "left").select("node", "first", "size", F.coalesce("root", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("first"))
    groups = cut(named.select("node", "size", "root").join(ids, "root").select("node", "size", "first"), "groups")
    out = join_groups(rows.select("id", "row", "node"), groups, "node", "size")
    extra = [F.col("row").alias(row), (F.col("row") == F.col("first.row")).alias("kept")] if row else []
    return out.select(F.col("id").alias(doc_id), F.col("first.id").alias("component_id"), *extra)
