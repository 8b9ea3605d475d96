"""Exact dedup over a cuckoo-filter index.

Texts are equal when their SHA-256 agrees after all white space of ``[\\x20\\x09-\\x0D]`` is deleted. Of
equal texts the longest original (code points) stays, then the smallest id.

:class:`CuckooIndex` keeps live digests: a cuckoo filter (buckets of four 16-bit tags, two
possible buckets a digest) answers most lookups of absent digests, hits are verified against the full digests
stored in buckets by their first two bytes, digests can be deleted, and when an
insertion finds no place the filter doubles and is filled again from the stored digests.

Each task of the scan keeps an index of the digests it has seen and sends one row per digest, so a text that
holds a third of all rows is a few rows after the scan. These are dealt out by digest, sorted, and merged in an index
per task, which is emptied between digests when it holds ``MOST``. Texts aren't shuffled.

Defined cases: null counts as empty, empty and blank texts are equal to each other; repeated rows of one id
form a group as others do (each is kept where the id is kept, unless a row column tells them apart); ids may be of any
type that has an order; null ids come after all others; an empty table gives no rows; further columns are ignored; texts of any
length are hashed whole in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups

MOST = 200_000
_SLOTS = 4
_KICKS = 200


class CuckooIndex:
    """Digests (bytes of at least 12) with a record each."""

    def __init__(self, buckets: int = 1024):
        self.store: dict[bytes, dict[bytes, object]] = {}
        self.count = 0
        self._empty(buckets)

    def __len__(self) -> int:
        return self.count

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[2:4], "big") or 1
        first = int.from_bytes(digest[4:12], "big") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, at: int, tag: int) -> int:
        return at ^ (tag * 0x5BD1E995 & self.mask)

    def _enter(self, digest: bytes) -> bool:
        tag, a, b = self._places(digest)
        for at in (a, b):
            if len(self.slots[at]) < _SLOTS:
                self.slots[at].append(tag)
                return True
        at = a
        for k in range(_KICKS):
            own = self.slots[at]
            i = k % _SLOTS
            own[i], tag = tag, own[i]
            at = self._other(at, tag)
            if len(self.slots[at]) < _SLOTS:
                self.slots[at].append(tag)
                return True
        return False

    def _grow(self) -> None:
        buckets = 2 * (self.mask + 1)
        while True:
            self._empty(buckets)
            if all(self._enter(d) for own in self.store.values() for d in own):
                return
            buckets *= 2

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer: False only for digests that aren't there."""
        tag, a, b = self._places(digest)
        return tag in self.slots[a] or tag in self.slots[b]

    def get(self, digest: bytes) -> object | None:
        return self.store.get(digest[:2], {}).get(digest) if self.maybe(digest) else None

    def put(self, digest: bytes, record: object) -> None:
        own = self.store.setdefault(digest[:2], {})
        new = not (self.maybe(digest) and digest in own)
        own[digest] = record
        if new:
            self.count += 1
            if not self._enter(digest):
                self._grow()

    def delete(self, digest: bytes) -> bool:
        """Forget a digest; False where it isn't there."""
        if not self.maybe(digest) or digest not in (own := self.store.get(digest[:2], {})):
            return False
        del own[digest]
        self.count -= 1
        tag, a, b = self._places(digest)
        self.slots[a if tag in self.slots[a] else b].remove(tag)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for own in self.store.values():
            yield from own.items()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, chars, id, row, size) to one per digest: most chars, then smallest id (null last), then smallest row; sizes added.

    Values stay Arrow's, so an id beside a null is never rounded.
    """
    schema = None

    def out(index: CuckooIndex) -> pa.RecordBatch:
        got = [(d, -less, i, row, size) for d, (less, _, i, row, size) in index.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got), schema)], schema=schema)

    index = CuckooIndex()
    for b in batches:
        schema = b.schema
        for d, chars, i, row, size in zip(*(b[k].to_pylist() for k in ("digest", "chars", "id", "row", "size"))):
            old = index.get(d)
            if old is None:
                if len(index) >= MOST:
                    yield out(index)
                    index = CuckooIndex()
                index.put(d, (-chars, i is None, i, row, size))
            else:
                # an id that is null on both sides is never compared
                new = (-chars, i is None, i, row)
                index.put(d, (*(new if _ahead(new, old) else old[:4]), old[4] + size))
    if len(index):
        yield out(index)


def _ahead(a: tuple, b: tuple) -> bool:
    if a[:2] != b[:2]:
        return a[:2] < b[:2]
    return a[2:4] < b[2:4] if a[2] is not None else a[3] < b[3]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """id, row (0 without such a column), digest (of the text without white space) and chars (of the whole text) of each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("id"),
        (F.col(row).cast("long") if row else F.lit(0).cast("long")).alias("row"),
        F.unhex(F.sha2(F.translate(t, " \t\n\x0b\x0c\r", "").cast("binary"), 256)).alias("digest"),
        F.length(t).cast("long").alias("chars"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """``rows`` (id, row, digest, chars) to one row per digest: digest, keep_id, keep_row, group_size."""
    best = f"digest binary, chars long, id {rows.schema['id'].dataType.simpleString()}, row long, size long"
    parts = rows.select("digest", "chars", "id", "row", F.lit(1).cast("long").alias("size")).mapInArrow(_merge, best)
    merged = parts.repartition("digest").sortWithinPartitions("digest").mapInArrow(_merge, best)
    return merged.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``row`` names a column of distinct whole numbers; with it exactly one row of each group is kept, and the column is returned.
    """
    rows = cut(digests(docs, doc_id, text, row), "digests")
    found = cut(groups(rows), "groups")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    out = join_groups(rows, found, "digest", "group_size")
    return out.select(F.col("id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *([F.col("row").alias(row)] if row else []))
