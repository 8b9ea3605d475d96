"""Implicit alternating least squares over blocks of ids.

Users and items are cut into ranges of ids with about as many ratings each. A task solves one block; between the half-steps only
those factors travel that a block has ratings of, once each. With G the sum of the outer products of the other side's factors, an id with n ratings
is solved in G's eigenvectors, where G and the ridge are diagonal: what remains is a system of n unknowns, or of as many as there are factors if n is more.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, delete, work_dir
from .search import BLOCKS, block_row, give_back

#: Ratings of a block; a single id may have more.
PER_BLOCK = 400_000
#: Rows of factors that are gathered at once.
AT_ONCE = 8192
#: A block's own ratings; ids that a block of the other side asks for; factors sent to a block; the start.
OWN, ASK, SENT, START = range(4)
_ROW = "to int, kind int, source int, a binary, b binary, c binary, d binary"
_ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.binary()) for x in _ROW.split(", ")])
#: Users and items of a block for the search.
USERS_HELD, ITEMS_HELD = 32768, 65536


def _rows(rows: list[tuple], schema: pa.Schema = _ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


def _block(key: str, splits: list[int], lo: int = 0, hi: int | None = None) -> Column:
    """The number of ``splits`` that ``key`` reaches, by halving."""
    hi = len(splits) if hi is None else hi
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col(key) < splits[mid], _block(key, splits, lo, mid)).otherwise(_block(key, splits, mid + 1, hi))


def _layout(pairs: DataFrame, key: str, other: str, splits: list[int], others: list[int]) -> DataFrame:
    """A row OWN for each block of ``key`` and a row ASK to each block of ``other``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0)[0].as_py(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        here = parts[0][0]
        both = np.unique(np.concatenate([x[1].astype(np.int64) << 32 | x[2].astype(np.int64) & 0xFFFFFFFF for x in parts]))
        ids, n = np.unique((both >> 32).astype(np.int32), return_counts=True)
        need, at = np.unique(both.astype(np.int32), return_inverse=True)
        yield _rows([(here, OWN, here, ids.tobytes(), n.astype(np.int32).tobytes(), need.tobytes(), at.astype(np.int32).tobytes())])
        edges = [0, *np.searchsorted(need, others), len(need)]
        for to in range(len(others) + 1):
            yield _rows([(to, ASK, here, need[edges[to] : edges[to + 1]].tobytes(), None, None, None)])

    dealt = pairs.select(_block(key, splits).alias("to"), key, other).repartitionById(len(splits) + 1, F.col("to"))
    return dealt.mapInArrow(run, _ROW)


def solve(n: np.ndarray, at: np.ndarray, y: np.ndarray, gram: np.ndarray, reg: float) -> np.ndarray:
    """Factors of ids with ``n`` ratings each, of the rows ``at`` of ``y``, all of value one and confidence two; the ridge grows with n as in Spark's ALS."""
    values, q = np.linalg.eigh(gram)
    values, rank = np.maximum(values, 0), len(gram)
    turned = np.empty(y.shape, np.float32)
    for i in range(0, len(y), AT_ONCE):
        turned[i : i + AT_ONCE] = y[i : i + AT_ONCE].astype(np.float64) @ q
    first, out = np.cumsum(n) - n, np.empty((len(n), rank))
    order = np.argsort(n, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(n[order])) + 1), len(n)]
    for lo, hi in zip(edges, edges[1:]):
        m = int(n[order[lo]])
        half = np.maximum(values + reg * m, 1e-30) ** -0.5
        step = max(1, AT_ONCE // max(m, rank))
        for i in range(lo, hi, step):
            who = order[i : min(i + step, hi)]
            if m <= rank:
                w = turned.take(at[first[who][:, None] + np.arange(m)], axis=0) * half
                z = np.linalg.solve(w @ w.transpose(0, 2, 1) + np.eye(m), np.ones((len(who), m, 1)))
                x = (w.transpose(0, 2, 1) @ z)[:, :, 0]
            else:
                a, b = np.tile(np.eye(rank), (len(who), 1, 1)), np.zeros((len(who), rank))
                for j in range(0, m, AT_ONCE):
                    w = turned.take(at[first[who][:, None] + np.arange(j, min(j + AT_ONCE, m))], axis=0) * half
                    a += w.transpose(0, 2, 1) @ w
                    b += w.sum(1)
                x = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            out[who] = (2 * x * half) @ q.T
    return out.astype(np.float32)


def _step(rows: DataFrame, blocks: int, rank: int, reg: float, last: str) -> DataFrame:
    """One block's factors, solved or from the start, to those that asked; of the ``last`` steps (i: items, u: users) the factors themselves as blocks for the search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked, sent, start = None, [], {}, None
        for b in batches:
            for x in b.to_pylist():
                if x["kind"] == OWN:
                    own = x
                elif x["kind"] == ASK:
                    asked.append((x["source"], np.frombuffer(x["a"], np.int32)))
                elif x["kind"] == SENT:
                    sent[x["source"]] = np.frombuffer(x["a"], np.float32).reshape(-1, rank), np.frombuffer(x["b"]).reshape(rank, rank)
                else:
                    start = x
        if own is None:
            return
        ids, n, need, at = (np.frombuffer(own[c], np.int32) for c in "abcd")
        if start is None:
            inward = [sent[s] for s in sorted(sent)]
            y, gram = np.concatenate([f for f, _ in inward]), np.sum([g for _, g in inward], 0)
            sent.clear()
            inward.clear()
            f = solve(n, at, y, gram, reg)
        else:
            order = np.argsort(np.frombuffer(start["a"], np.int32))
            f = np.frombuffer(start["b"], np.float32).reshape(-1, rank)[order]
        if last:
            saw, ends, held = need[at], np.cumsum(n), ITEMS_HELD if last == "i" else USERS_HELD
            for j, i in enumerate(range(0, len(ids), held)):
                part = slice(i, i + held)
                mine = (np.repeat(np.arange(len(ids[part])), n[part]), saw[ends[i] - n[i] : ends[part][-1]]) if last == "u" else (ids[:0], ids[:0])
                yield block_row(j, ids[part], f[part], *mine)
        else:
            wide = f.astype(np.float64)
            gram = (wide.T @ wide).tobytes()
            for to, what in asked:
                yield _rows([(to, SENT, own["to"], f[np.searchsorted(ids, what)].tobytes(), gram, None, None)])
        del own, sent, start, f
        give_back()

    return rows.repartitionById(blocks, F.col("to")).mapInArrow(run, BLOCKS if last else _ROW)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        ids = np.concatenate([b.column(1).to_numpy() for b in parts]).astype(np.int32)
        f = np.concatenate([b.column(2).flatten().to_numpy() for b in parts]).astype(np.float32)
        yield _rows([(parts[0].column(0)[0].as_py(), START, 0, ids.tobytes(), f.tobytes(), None, None)])


def train(als, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The factors of ``als`` (implicit, alpha and all ratings one) after all its iterations, users' and items', in blocks for the search.

    The start is Spark's own. It depends on the users alone, so Spark sees one rating of each; ``pairs`` is a written table.
    """
    spark, rank, reg = pairs.sparkSession, als.getRank(), als.getRegParam()
    side = {"u": als.getUserCol(), "i": als.getItemCol()}
    blocks = als.getNumUserBlocks()
    found = pairs.approxQuantile(list(side.values()), [j / blocks for j in range(1, blocks)], 0.1 / blocks)
    splits = {s: sorted({int(x) for x in xs}) for s, xs in zip(side, found)}
    size = {s: len(splits[s]) + 1 for s in side}
    base = f"{work_dir(spark)}/als-{uuid.uuid4().hex}"
    lay = {s: cut(_layout(pairs, side[s], side[o], splits[s], splits[o]), "layout", base) for s, o in (("u", "i"), ("i", "u"))}
    own = {s: lay[s].filter(F.col("kind") == OWN) for s in side}
    fixed = {s: own[s].unionByName(lay[o].filter(F.col("kind") == ASK)) for s, o in (("u", "i"), ("i", "u"))}

    one = pairs.groupBy(side["u"]).agg(F.min(side["i"]).alias(side["i"]), F.lit(1.0).alias(als.getRatingCol()))
    start = als.copy({als.maxIter: 0}).fit(one).userFactors
    dealt = start.select(_block("id", splits["u"]).alias("to"), "id", "features").repartitionById(size["u"], F.col("to"))
    sent = cut(_step(fixed["u"].unionByName(dealt.mapInArrow(_packed, _ROW)), size["u"], rank, reg, ""), "sent", f"{base}/0")
    done, most = {}, als.getMaxIter()
    for i in range(1, 2 * most + 1):
        s = "ui"[i % 2]
        if i >= 2 * most - 1:
            done[s] = cut(_step(own[s].unionByName(sent), size[s], rank, reg, s), "factors")
        if i < 2 * most:
            sent = cut(_step(fixed[s].unionByName(sent), size[s], rank, reg, ""), "sent", f"{base}/{i}")
            delete(spark, f"{base}/{i - 1}")
    delete(spark, base)
    return done["u"], done["i"]
