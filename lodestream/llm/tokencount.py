"""Token counts: an exact histogram of encoded lengths with suffix sums.

Documents are encoded, counted by length, and the histogram (as many rows as there are different
lengths) gets suffix sums: documents and tokens at or beyond each length. Any
context limit L is then answered without the documents: tokens kept when
every document is cut at L are all tokens, minus those of documents of at least L, plus L for each of
these. Suffix sums are taken in two levels, inside buckets of lengths and over bucket totals, so no
task holds the histogram.

Defined cases: null text counts as empty (length 0); repeated rows count each; an empty
table gives an empty histogram, totals of 0 and null quantiles; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPAN = 1024


@lru_cache(2)
def encoder(path: str | None):
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Column n_tokens: the encoded length of each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"n_tokens": [len(enc.encode_ordinary(x)) if x else 0 for x in b["text"]]})

    return docs.select("text").mapInPandas(run, "n_tokens long")


def histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per encoded length: n_tokens, n_docs, docs_ge, tokens_ge, docs_total, tokens_total, truncated_total, share_le."""
    h = cut(lengths(docs, path).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    return suffix_sums(h)


def suffix_sums(h: DataFrame) -> DataFrame:
    h = h.withColumn("bucket", F.floor(F.col("n_tokens") / SPAN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = h.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0)
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("d").over(later), zero).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), zero).alias("tokens_after"),
        F.sum("d").over(whole).alias("docs_total"),
        F.sum("t").over(whole).alias("tokens_total"),
    )
    within = Window.partitionBy("bucket").orderBy("n_tokens").rowsBetween(0, Window.unboundedFollowing)
    h = h.withColumn("docs_in", F.sum("n_docs").over(within)).withColumn("tokens_in", F.sum("tokens").over(within)).join(totals, "bucket")
    ge, tge = F.col("docs_in") + F.col("docs_after"), F.col("tokens_in") + F.col("tokens_after")
    return h.select(
        "n_tokens",
        "n_docs",
        ge.alias("docs_ge"),
        tge.alias("tokens_ge"),
        "docs_total",
        "tokens_total",
        (F.col("tokens_total") - tge + F.col("n_tokens") * ge).alias("truncated_total"),
        ((F.col("docs_total") - ge + F.col("n_docs")) / F.col("docs_total")).alias("share_le"),
    )


def truncated_totals(hist: DataFrame, limits: list[int]) -> dict[int, int]:
    """Tokens kept at each context limit, observed length or not, in one pass over the histogram."""
    cells = [F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias(f"l{i}") for i, x in enumerate(limits)]
    row = hist.agg(*cells).first()
    return {x: row[i] for i, x in enumerate(limits)}


def quantiles(hist: DataFrame, shares: list[float]) -> dict[float, int | None]:
    """The smallest length that at least the given share of documents doesn't exceed."""
    row = hist.agg(*[F.min(F.when(F.col("share_le") >= q, F.col("n_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    return {q: row[i] for i, q in enumerate(shares)}
