"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three
characters; words are lower-cased runs of letters (category L) and their marks (M), padded with blanks), most frequent first. A
document's own list is compared with each profile: an n-gram costs the difference of its two
places, one that the profile lacks costs the profile's length. The language with the smallest
sum wins (ties: the first in alphabetical order).

N-gram counts of all labelled training rows are summed by Spark; each task sends
only its distinct n-grams, in groups of at most ``FLUSH``.

Defined cases: null text, text without letters (digits and number signs such as ``½`` are none) and an untrained model give ``und`` with score 0;
rows without a language don't train; repeated rows count as often as they occur; long texts are
counted in blocks of ``BLOCK`` characters; an empty table trains nothing and gives no rows; further columns are ignored by
predict() and pass unchanged through accept(), which lets everything through when no profile could be learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy

UNDETERMINED = "und"
PLACES = 400
BLOCK = 1 << 20
FLUSH = 400_000
_ASCII = re.compile(r"[^a-z]+")


@cache
def _patterns():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def words(text: str | None) -> str:
    """The lower-cased words of a text with one blank between; empty where it has no letter."""
    if not text:
        return ""
    if text.isascii():
        return _ASCII.sub(" ", text.lower()).strip()
    other, letter = _patterns()
    got = other.sub(" ", text.lower()).strip()
    return got if letter.search(got) else ""


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed as 21 bits a character, in ascending order, and their counts."""
    letters = words(text)
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    parts = []
    for at in range(0, len(c), BLOCK):
        b = c[at : at + BLOCK + 2]
        own = min(BLOCK, len(b))
        two = (b[:-1] << 21 | b[1:])[:own]
        three = (b[:-2] << 42 | b[1:-1] << 21 | b[2:])[b[1:-1] != 32][:own] if len(b) > 2 else b[:0]
        one = b[:own]
        codes = np.sort(np.concatenate((one[one != 32], two, three)))
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        parts.append((codes[first], np.diff(np.r_[first, len(codes)])))
    return parts[0] if len(parts) == 1 else _merge(*(np.concatenate(x) for x in zip(*parts)))


def places(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` frequent of the codes (ascending), most frequent first; ties: smaller code."""
    key = (counts.max() - counts) << 32 | np.arange(len(codes))
    if len(key) > 4 * most:
        key = np.partition(key, most)[:most]
    return codes[np.sort(key)[:most] & 0xFFFFFFFF]


class Profiles:
    """Profiles of all languages; ``lists`` maps a language to its n-grams, most frequent first."""

    def __init__(self, lists: dict[str, list[int]], size: int = PLACES):
        self.langs, self.size = sorted(lists), size
        self.known = np.unique(np.array([x for k in self.langs for x in lists[k]], np.int64))
        self.rank = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.known, np.array(lists[k], np.int64))] = np.arange(len(lists[k]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language, as a share of the largest; None where there is nothing to compare."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return None
        own = places(codes, counts, self.size)
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        r = self.rank[:, at]
        return np.where(r < 0, self.size, np.abs(r - np.arange(len(own)))).sum(1) / (self.size * len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how far (0 to 1) the second best is behind."""
        d = self.distances(text)
        if d is None:
            return UNDETERMINED, 0.0
        best = int(np.argmin(d))
        rest = np.delete(d, best)
        second = float(rest.min()) if len(rest) else 1.0
        return self.langs[best], float((second - d[best]) / second) if second > 0 else 0.0


def train(rows: DataFrame, size: int = PLACES) -> Profiles:
    """Profiles from all ``rows`` (text, lang) with a language. To the driver go ``size`` n-grams a language."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def drain(lang: str) -> pd.DataFrame:
            codes, counts = _merge(*(np.concatenate(x) for x in zip(*held.pop(lang))))
            return pd.DataFrame({"lang": lang, "code": codes, "n": counts})

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                own = held.setdefault(lang, [])
                own.append(ngrams(text))
                if len(own) >= 512:
                    own[:] = [_merge(*(np.concatenate(x) for x in zip(*own)))]
                    if len(own[0][0]) > FLUSH:
                        yield drain(lang)
        for lang in list(held):
            yield drain(lang)

    top = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = (
        rows.select("lang", "text")
        .filter("lang is not null and text is not null")
        .mapInPandas(tidy(count), "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(top))
        .filter(F.col("place") <= size)
    )
    lists: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "place", "code").collect()):
        lists.setdefault(r.lang, []).append(r.code)
    return Profiles(lists, size)


def predict(rows: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows`` plus lang_pred and score, from column text."""
    held = rows.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [held.value.predict(x) for x in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b[k] for k in keep] + [pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep)
    return rows.select(*keep, "text").mapInArrow(tidy(run), f"{schema}, lang_pred string, score double")


def accept(rows: DataFrame, profiles: Profiles, languages: set[str] | None = None, most: float = 1.0) -> DataFrame:
    """The rows whose language can be determined and is one of ``languages`` (any where None), columns unchanged.

    ``most`` also rejects texts farther than that share of the largest distance from every profile. Without any profile all rows pass.
    """
    if not profiles.langs:
        return rows
    held = rows.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [held.value.distances(x) for x in b["text"].to_pylist()]
            fits = [d is not None and d.min() <= most and (languages is None or held.value.langs[int(np.argmin(d))] in languages) for d in got]
            yield b.filter(pa.array(fits, pa.bool_()))

    return rows.mapInArrow(tidy(run), rows.schema)
