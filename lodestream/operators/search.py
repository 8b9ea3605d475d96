"""Exact search for largest inner products, block by block.

Queries are halved along their main direction into leaves of like direction. For unit vectors in a leaf with centre c and radius r no inner product with v
exceeds c.v + r|v|, so items below every query's ``k`` best so far are left out unseen. Products are in single precision, with room for its error; what
may be among the ``k`` best is scored in double. Where vectors have no common directions nothing is left out, and all meet all.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

LEAF = 512
#: Items of a leaf's first look, and items that meet a leaf at once.
LOOK, AT_ONCE = 64, 4096
#: Item blocks beyond which a first look at all items comes before the search; items that a task holds.
FEW_BLOCKS = 16
HELD = 1 << 19
NONE = np.iinfo(np.int64).max
BLOCK = pa.schema([("no", pa.int64()), *((name, pa.binary()) for name in ("id", "x", "who", "saw"))])
BLOCKS = "no long, id binary, x binary, who binary, saw binary"


def give_back() -> None:
    """Hand freed memory back to the machine: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def give_back_heaps(spark: SparkSession) -> None:
    """The executors collect garbage and shrink their heaps, which else count beside the workers of what follows."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def block_row(j: int, ids: np.ndarray, x: np.ndarray, who: np.ndarray, saw: np.ndarray) -> pa.RecordBatch:
    """The ``j``-th block of this task: ids, vectors, and the ids that are left out with the places of those they are left out for."""
    no = (TaskContext.get().partitionId() << 20) + j
    return pa.RecordBatch.from_arrays([pa.array([no]), *(pa.array([v.tobytes()], pa.binary()) for v in (ids.astype(np.int64), x, who.astype(np.int32), saw.astype(np.int64)))], schema=BLOCK)


def packed(size: int, dtype: type) -> Callable[[Iterator], Iterator]:
    """Rows (id, vector, seen) to blocks of ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j, held = 0, []
        for b in batches:
            for at in range(0, b.num_rows, size):
                held.append(b.slice(at, size))
                while (n := sum(x.num_rows for x in held)) >= size:
                    whole = pa.Table.from_batches(held)
                    yield block(j, whole.slice(0, size))
                    j, held = j + 1, whole.slice(size).to_batches() if n > size else []
        if held:
            yield block(j, pa.Table.from_batches(held))

    def block(j: int, t: pa.Table) -> pa.RecordBatch:
        lists, vectors = t.column("seen").combine_chunks(), t.column("vector").combine_chunks()
        n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64) if lists.null_count < len(lists) else np.zeros(len(lists), np.int64)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(t.num_rows, -1)
        return block_row(j, t.column("id").to_numpy(), x, np.repeat(np.arange(t.num_rows), n), lists.flatten().to_numpy(zero_copy_only=False))

    return run


def leaves(x: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Places of the rows of ``x``, halved along the main direction until at most ``most`` are together."""
    out, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= most:
            out.append(at)
            continue
        y = x[at] - x[at].mean(0)
        along = y @ np.linalg.eigh((y.T @ y).astype(np.float64))[1][:, -1]
        order = np.argsort(along, kind="stable")
        open_ += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return out


class Queries:
    """A block of queries and the ``k`` best items of each so far."""

    def __init__(self, row: dict, k: int, dtype: type):
        ids, who, saw = np.frombuffer(row["id"], np.int64), np.frombuffer(row["who"], np.int32), np.frombuffer(row["saw"], np.int64)
        x = np.frombuffer(row["x"], dtype).reshape(len(ids), -1)
        self.no, self.k, self.dtype = row["no"], k, dtype
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
        norm[norm == 0] = 1
        unit = (x / norm[:, None]).astype(np.float32)
        parts = leaves(unit)
        self.order = np.concatenate(parts)
        self.edges = np.cumsum([0, *map(len, parts)])
        self.ids, self.x, self.norm, self.unit = ids[self.order], x[self.order], norm[self.order], unit[self.order]
        self.centre = np.stack([unit[p].mean(0) for p in parts])
        self.radius = np.array([np.linalg.norm(unit[p] - c, axis=1).max() for p, c in zip(parts, self.centre)], np.float32)
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        place = place[who]
        by = np.argsort(place, kind="stable")
        self.who, self.saw = place[by], saw[by]
        self.best, self.names = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NONE)
        self.floor = np.full(len(ids), -np.inf)
        if tops := row.get("tops"):
            all_ = np.concatenate([np.frombuffer(t).reshape(len(ids), k) for t in tops], 1)
            self.floor = np.partition(all_, -k, axis=1)[:, -k][self.order]
        # twice what a product of unit vectors can be off in single precision
        self.room = np.float32(2 * (x.shape[1] + 8) * 2.0**-23)

    def meet(self, ids: np.ndarray, v: np.ndarray, look: bool) -> None:
        by = np.argsort(ids, kind="stable")
        ids, v = ids[by], v[by]
        size = np.sqrt(np.einsum("ij,ij->i", v, v, dtype=np.float64))
        most = size.max() or 1.0
        small, size = (v / most).astype(np.float32), (size / most).astype(np.float32)
        near = self.centre @ small.T
        for leaf, (a, b) in enumerate(zip(self.edges, self.edges[1:])):
            bound = near[leaf] + self.radius[leaf] * size + self.room
            at = np.flatnonzero(bound >= self.least(a, b, most).min())
            if look and len(at) > LOOK:
                at = np.sort(at[np.argpartition(near[leaf][at], -LOOK)[-LOOK:]])
            for i in range(0, len(at), AT_ONCE):
                part = at[i : i + AT_ONCE]
                if i:
                    part = part[bound[part] >= self.least(a, b, most).min()]
                if len(part):
                    self._leaf(a, b, ids[part], v[part], small[part], most)

    def least(self, a: int, b: int, most: float) -> np.ndarray:
        """What a unit query's product must reach, of items over ``most``."""
        return np.maximum(self.floor[a:b], self.best[a:b, -1]) / self.norm[a:b] / most

    def _leaf(self, a: int, b: int, ids: np.ndarray, v: np.ndarray, small: np.ndarray, most: float) -> None:
        s, least = self.unit[a:b] @ small.T, (self.least(a, b, most) - self.room).astype(np.float32)
        hot = np.flatnonzero(s.max(1) >= least)
        if not len(hot):
            return
        lo, hi = np.searchsorted(self.who, [a, b])
        who, saw = self.who[lo:hi] - a, self.saw[lo:hi]
        lo, hi = np.searchsorted(ids, saw), np.searchsorted(ids, saw, side="right")
        for off in range(int((hi - lo).max(initial=0))):
            hit = lo + off < hi
            s[who[hit], lo[hit] + off] = -np.inf
        s, least = s[hot], least[hot]
        if self.k < len(ids):
            least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * self.room) if (least == -np.inf).any() else least
        hits = (s >= least[:, None]) & (s > -np.inf)
        if self.k < len(ids) and hits.sum() > 4 * self.k * len(hot):
            hits &= s >= (np.partition(s, -self.k, axis=1)[:, -self.k] - 2 * self.room)[:, None]
        step = max(1, (1 << 14) // len(ids))
        for i in range(0, len(hot), step):
            q, j = np.nonzero(hits[i : i + step])
            if len(q):
                q = hot[i + q] + a
                self._add(q, ids[j], np.einsum("ij,ij->i", self.x[q].astype(np.float64), v[j].astype(np.float64)))

    def _add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(q)
        q, ids, score = np.concatenate([q, np.repeat(rows, self.k)]), np.concatenate([ids, self.names[rows].ravel()]), np.concatenate([score, self.best[rows].ravel()])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.names[rows], self.best[rows] = ids[first].reshape(-1, self.k), score[first].reshape(-1, self.k)

    def tops(self) -> pa.RecordBatch:
        out = np.empty_like(self.best)
        out[self.order] = self.best
        return pa.RecordBatch.from_arrays([pa.array([self.no]), pa.array([out.tobytes()], pa.binary())], names=["no", "tops"])

    def found(self) -> pa.RecordBatch:
        q, j = np.nonzero((self.best > -np.inf) & (self.best >= self.floor[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[q], self.names[q, j], self.best[q, j])], names=["query_id", "item_id", "score"])


def _met(k: int, dtype: type, look: bool) -> Callable[[Iterator], Iterator]:
    """A query block comes in the first row of its items, and not again with each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            cell = dict(zip(b.schema.names, b.columns))
            for j in range(b.num_rows):
                if cell["x"][j].is_valid:
                    if now is not None:
                        yield now.tops() if look else now.found()
                    now = Queries({name: x[j].as_py() for name, x in cell.items()}, k, dtype)
                if now is None or now.no != cell["no"][j].as_py():
                    raise ValueError("items before their queries")
                ids = np.frombuffer(cell["item"][j].as_buffer(), np.int64)
                now.meet(ids, np.frombuffer(cell["v"][j].as_buffer(), dtype).reshape(len(ids), -1), look)
            b = cell = ids = None  # else it stays while the next one comes
        if now is not None:
            yield now.tops() if look else now.found()
        now = None
        give_back()

    return run


def search(queries: DataFrame, items: DataFrame, k: int, dtype: type, held: int) -> DataFrame:
    """query_id, item_id, score, rank of the ``k`` best items of each query; ties: smaller id. Both are written tables of blocks, items' of ``held`` rows at most."""
    n, cores = items.count(), items.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(n, max(-(-n * held // HELD), -(-2 * cores // max(1, queries.count())))))
    to = (F.col("no") % (1 << 20) + F.shiftright("no", 20)) % parts
    right = items.select(to.cast("int").alias("to"), F.col("id").alias("item"), F.col("x").alias("v")).repartitionById(parts, F.col("to"))
    right = right.select("item", "v", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")).hint("shuffle_replicate_nl")

    def met(schema: str, look: bool) -> DataFrame:
        both = queries.crossJoin(right)
        rows = both.select("no", "item", "v", *(F.when(F.col("at") == 0, F.col(c)).alias(c) for c in queries.columns if c != "no"))
        return rows.mapInArrow(_met(k, dtype, look), schema)

    if n > FEW_BLOCKS:
        # the first look finds what each query's items must reach
        give_back_heaps(items.sparkSession)
        tops = cut(met("no long, tops binary", True), "tops")
        queries = cut(queries.join(tops.groupBy("no").agg(F.collect_list("tops").alias("tops")), "no", "left"), "queries")
        give_back_heaps(items.sparkSession)
    out = met("query_id long, item_id long, score double", False)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
