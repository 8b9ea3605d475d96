"""Token ids in seekable binary files.

A file is a series of independent zstandard frames of ``FRAME_IDS`` little-endian unsigned 32-bit
ids each (the last may be shorter), then a skippable frame that holds the list of documents (id, number of ids; itself a zstandard
frame), then a skippable frame with the seek table of the public "zstd seekable
format": compressed size, size and checksum (low 32 bits of XXH64) of each frame, number of frames, descriptor byte,
magic number. Any zstandard tool can decompress a file. A reader takes the table from the end and
decompresses only the frames that the wanted documents lie in, checking each.

Documents are dealt out by ranges of their id; one task sorts its range, encodes, and writes one file under a
temporary name which it then renames, so a repeated task replaces its own file. The driver gets one row per file.

Encoding goes through the tokenizers library. White space is dropped by that vocabulary's rules and no
token crosses it, nor the border of two words, so each worker encodes a word once and keeps up to ``HELD`` of them, those met most often.

Defined cases: null text counts as empty (its end id alone); documents of equal id follow one another in order of text, null ids come
first; an empty table gives no rows; further columns are ignored. Ids are integers.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, tidy, work_dir

FRAME_IDS = 1 << 16
END = 2
HELD = 500_000
BLOCK_CHARS = 8_000_000
_SKIP_DOCS, _SKIP_TABLE, _SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_NONE = -(2**63)


class Writer:
    """Write documents to a binary file object."""

    def __init__(self, f):
        import zstandard

        self.f, self.z = f, zstandard.ZstdCompressor(level=1)
        self.open, self.size, self.table, self.docs, self.total = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs += [_NONE if doc_id is None else doc_id, len(ids)]
        self.total += len(ids)
        self.open.append(ids)
        self.size += len(ids)
        if self.size >= FRAME_IDS:
            self._frames(False)

    def _frames(self, last: bool) -> None:
        import xxhash

        x = np.concatenate(self.open).astype("<u4") if self.open else np.zeros(0, "<u4")
        at = 0
        while len(x) - at >= FRAME_IDS or last and at < len(x):
            raw = x[at : at + FRAME_IDS].tobytes()
            done = self.z.compress(raw)
            self.f.write(done)
            self.table.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            at += FRAME_IDS
        self.open, self.size = [x[at:]], max(0, len(x) - at)

    def close(self) -> None:
        self._frames(True)
        docs = self.z.compress(np.array(self.docs, "<i8").tobytes())
        self.f.write(struct.pack("<II", _SKIP_DOCS, len(docs)) + docs)
        table = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, _SEEKABLE)
        self.f.write(struct.pack("<II", _SKIP_TABLE, len(table)) + table)


class Reader:
    """Read documents from a seekable binary file object."""

    def __init__(self, f):
        import zstandard

        self.f, self.z = f, zstandard.ZstdDecompressor()
        f.seek(0, os.SEEK_END)
        end = f.tell()
        f.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", f.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        f.seek(end - 9 - 12 * n)
        table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.sums = table[:, 0], table[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        f.seek(int(self.sizes.sum()))
        magic, size = struct.unpack("<II", f.read(8))
        if magic != _SKIP_DOCS:
            raise ValueError("no list of documents")
        docs = np.frombuffer(self.z.decompress(f.read(size)), "<i8").reshape(-1, 2)
        self.doc_ids, self.lengths = docs[:, 0], docs[:, 1]
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def frame(self, k: int) -> np.ndarray:
        import xxhash

        if self.held[0] != k:
            self.f.seek(int(self.starts[k]))
            raw = self.z.decompress(self.f.read(int(self.sizes[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(raw, "<u4"))
        return self.held[1]

    def ids(self, n: int) -> np.ndarray:
        """Ids of the n-th document of the file."""
        a, b = int(self.begins[n]), int(self.begins[n] + self.lengths[n])
        if a == b:
            return np.zeros(0, "<u4")
        parts = [self.frame(k)[max(0, a - k * FRAME_IDS) : b - k * FRAME_IDS] for k in range(a // FRAME_IDS, (b - 1) // FRAME_IDS + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """Ids of all documents of that id; the file is in ascending order of ids."""
        a, b = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.ids(i) for i in range(a, b)]


# kinds of bytes in UTF-8 once A-Z and white space are folded; ODD ones, and the pieces they stand in, are left to the library's whole chain
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = bytes(_SPACE if x == 32 else _LETTER if 97 <= x <= 122 else _DIGIT if 48 <= x <= 57 else _OTHER if 32 < x < 127 and x != 39 else _ODD for x in range(256))
_WHITE = bytes.maketrans(b"\t\n\r", b"   ")
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\r", bytes(range(97, 123)) + b"   ")


def _two_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Kind and small letter of the characters of two bytes; letters and signs that NFC changes, or whose small letter is no such character, are ODD."""
    kind, small = np.full(0x800, _ODD, "u1"), np.arange(0x800, dtype="<u2")
    for x in range(0xA0, 0x800):
        c = chr(x)
        if unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1 and ord(c.lower()) in range(0xA0, 0x800) and not unicodedata.combining(c):
            kind[x] = {"L": _LETTER, "P": _OTHER, "S": _OTHER}.get(unicodedata.category(c)[0], _ODD)
            small[x] = ord(c.lower())
    return kind, small


_KIND2, _SMALL2 = _two_bytes()


class Encoder:
    """The tokenizers library behind a bounded store of words.

    In pieces between white space of ASCII (without apostrophes and names of special tokens) and the letters and signs of two bytes, no marks, the
    vocabulary's normaliser only folds case, and its split pattern gives runs of letters, single digits and runs of others: these words are cut for
    many texts at once, by bytes, and go straight to the library's BPE model, each distinct one once; a word's last id is the one with the end-of-word
    mark. Any other piece goes, unfolded, through the library's whole chain.
    """

    def __init__(self, path: str, held: int = HELD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.t, self.held = Tokenizer.from_file(path), held
        # a word's place in known is its number in ends (of its ids in pool) and met (blocks that it was met in)
        self.known: dict[str, int] = {}
        self.pool, self.ends, self.met = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)
        with open(path) as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.model = Tokenizer.from_file(path)
        self.model.normalizer, self.model.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.last[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        # the model sees bytes as characters: printable Latin-1 as it is, the others from U+0100 on
        kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = {x: 256 + n for n, x in enumerate(x for x in range(256) if x not in kept) if x != 32}
        self.odd = re.compile(f"['\x00-\x20\x7f]|<\\||[^\x00-\x7f{''.join(map(chr, np.flatnonzero(_KIND2 != _ODD)))}]").search

    def _learn(self, new: list[str]) -> None:
        """Put words that aren't known behind those that are."""
        plain, accented, rest = [], [], []
        for w in new:
            (plain if w.isascii() and w.isalpha() else rest if self.odd(w) else plain if w.isascii() else accented).append(w)
        ids, counts = [], []
        for words in (plain, accented):
            for at in range(0, len(words), 200):
                part = " ".join(words[at : at + 200])
                shown = part if words is plain else part.encode().decode("latin-1").translate(self.shown)
                ids.append(np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4"))
                counts.append(np.diff(np.flatnonzero(self.last[ids[-1]]), prepend=-1))
                if len(counts[-1]) != len(words[at : at + 200]):
                    raise ValueError("a word's ids don't end with the end-of-word mark")
        for at in range(0, len(rest), 20_000):
            found = [e.ids for e in self.t.encode_batch_fast(rest[at : at + 20_000], add_special_tokens=False)]
            ids.append(np.array(list(itertools.chain.from_iterable(found)), "<u4"))
            counts.append(np.array([len(x) for x in found], np.int64))
        self.known.update(zip(itertools.chain(plain, accented, rest), range(len(self.known), len(self.known) + len(new))))
        self.pool = np.concatenate([self.pool, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int32)])

    def _ids(self) -> pa.LargeBinaryArray:
        """Ids of all known words, as bytes."""
        return pa.Array.from_buffers(pa.large_binary(), len(self.known), [None, pa.py_buffer(4 * self.ends), pa.py_buffer(self.pool)])

    def _forget(self, now: list[int], new: int) -> None:
        """Make room for ``new`` words: the words ``now`` stay, and the most often met of the others, up to half of what may be held."""
        rank = self.met.copy()
        rank[now] = np.iinfo(np.int32).max
        keep = np.sort(np.argsort(-rank, kind="stable")[: max(len(now), min(self.held // 2, self.held - new))])
        names, left = list(self.known), self._ids().take(pa.array(keep))
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.ends = np.frombuffer(left.buffers()[1], np.int64)[: len(keep) + 1] // 4
        self.pool = np.frombuffer(left.buffers()[2] or b"", "<u4")[: self.ends[-1]].copy()
        self.met = self.met[keep] // 2

    @staticmethod
    def _cut(raw: bytes) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where each word of ``raw`` begins, and the words."""
        plain = raw.translate(_FOLD)
        folded, kind = np.frombuffer(bytearray(plain), "u1"), np.frombuffer(bytearray(plain.translate(_KIND)), "u1")
        lead = np.flatnonzero(folded & 0xE0 == 0xC0)
        code = (folded[lead] & 31).astype("<u2") << 6 | folded[lead + 1] & 63
        kind[lead] = kind[lead + 1] = _KIND2[code]
        code = _SMALL2[code]
        folded[lead], folded[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 63
        del lead, code
        bars = np.flatnonzero(folded == ord("|"))
        kind[bars[(bars > 0) & (folded[bars - 1] == ord("<"))]] = _ODD
        odd = kind == _ODD
        odd[1:] &= kind[:-1] != _ODD
        odd = np.flatnonzero(odd)
        if len(odd):
            gaps = np.concatenate([[-1], np.flatnonzero(kind == _SPACE), [len(kind)]])
            at = np.searchsorted(gaps, odd)
            at = at[np.flatnonzero(np.diff(at, prepend=-1))]
            step = np.zeros(len(kind) + 1, np.int8)
            step[gaps[at - 1] + 1] = 1
            step[gaps[at]] -= 1
            whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            kind[whole] = _ODD
            folded[whole] = np.frombuffer(raw.translate(_WHITE), "u1")[whole]
        new = kind == _DIGIT
        new[1:] |= kind[1:] != kind[:-1]
        new[:1] = True
        real = kind != _SPACE
        new &= real
        begins = np.flatnonzero(new)
        # without the white space, each word ends where the next begins
        data = folded[real]
        offsets = np.append(np.flatnonzero(new[real]), len(data))
        del plain, folded, kind, new, real
        words = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return begins, words.dictionary_encode()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        raws = [(t or "").encode() for t in texts]
        bounds = np.cumsum([0, *(len(x) + 1 for x in raws)])
        raw = b" ".join(raws)
        del raws
        begins, words = self._cut(raw)
        bounds = np.searchsorted(begins, bounds)
        del raw, begins
        listed = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        names = pc.binary_join(listed, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(words) else []  # other white space may stand in a piece
        places = list(map(self.known.get, names))
        new = [w for w, n in zip(names, places) if n is None]
        if len(self.known) + len(new) > self.held:
            # the words that are met again stay
            self._forget([n for n in places if n is not None], len(new))
        if new:
            self._learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.met[numbers] += 1
        got = self._ids().take(pa.array(numbers)).take(words.indices)
        ends = np.frombuffer(got.buffers()[1], np.int64)[: len(got) + 1] // 4
        ids = np.frombuffer(got.buffers()[2] or b"", "<u4")
        return [ids[a:b] for a, b in itertools.pairwise(ends[bounds].tolist())]


@lru_cache(2)
def encoder(path: str | None) -> Encoder:
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("word_bpe_49k.json"))


def _local(uri: str) -> tuple[object, str]:
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, files: int | None = None, end: int | None = END) -> list[tuple[str, int, int]]:
    """Encode and write all documents in ascending order of id. Returns file, documents and ids of each file, in order."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(files or shuffle_width(spark), "id").sortWithinPartitions("id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        where, base = _local(folder)
        where.create_dir(base, recursive=True)
        name = f"ids-{part:06d}.zst"
        own = f"{base}/.{name}.{uuid.uuid4().hex}"
        tail = np.array([] if end is None else [end], "<u4")
        gc.disable()  # millions of small objects without cycles
        try:
            with where.open_output_stream(own) as f:
                w = Writer(f)

                def block(ids: list, texts: list) -> None:
                    for i, x in zip(ids, enc.encode(texts)):
                        w.add(None if i is None or i != i else int(i), np.concatenate((x, tail)))

                for b in batches:
                    ids, texts, size = [], [], 0
                    for i, t in zip(b["id"].astype("Int64").astype(object).where(b["id"].notna(), None), b["text"]):
                        ids.append(i)
                        texts.append(t)
                        size += len(t)
                        if size >= BLOCK_CHARS:
                            block(ids, texts)
                            ids, texts, size = [], [], 0
                    block(ids, texts)
                w.close()
            where.move(own, f"{base}/{name}")
        finally:
            gc.enable()
        yield pd.DataFrame({"part": [part], "file": [f"{folder}/{name}"], "docs": [len(w.docs) // 2], "ids": [w.total]})

    return [(r.file, r.docs, r.ids) for r in sorted(rows.mapInPandas(tidy(run), "part int, file string, docs long, ids long").collect())]


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    base, todo = 0, []
    for name, docs, ids in files:
        if docs:
            todo.append((len(todo), name, base))
        base += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not todo:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, start in zip(b["file"], b["base"]):
                where, path = _local(name)
                with where.open_input_file(path) as f:
                    r = Reader(f)
                    sums = [zlib.crc32(r.ids(n).tobytes()) for n in range(len(r.lengths))]
                    frame = pd.DataFrame({"doc_id": r.doc_ids, "start": start + r.begins, "n_tokens": r.lengths, "ids_crc32": np.array(sums, np.int64)})
                    frame["doc_id"] = frame["doc_id"].astype("Int64").mask(frame["doc_id"] == _NONE)
                    yield frame

    listed = spark.createDataFrame(todo, "n int, file string, base long")
    return listed.repartitionByRange(len(todo), "n").select("file", "base").mapInPandas(run, schema)


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to a new folder in the shared folder and return what read() finds there."""
    folder = f"{work_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read(docs.sparkSession, write(docs, folder, **options))
