"""Corpus pipeline: five stages from documents to encoded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
shared folder and gives it, read again, to the next stage. All stages but the last return the columns of documents, further
columns included.

Both dedup stages write their documents once with a row number, so that what stays is a row and not an id: of rows that share an id,
null or not, one of each group stays. Where few rows go (``FEW``), their numbers are broadcast and no text is
shuffled; beyond that, texts and numbers are joined by shuffle.

Every stage begins by having the executors give their free heap back, for the near stage fills it and the workers of later ones need the memory.

Defined cases: null and blank texts have no letters and go in the first stage; rows without an id pass like others; repeated
rows are exact copies; an empty table stays empty through all stages; an empty benchmark drops nothing; texts of any length
are read whole by every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, decontam, dedup, langid, similar, simhash
from lodestream.llm.common import cut, give_back_heaps, scratch, work_dir

FEW = 1_000_000


def rested(stage: Callable) -> Callable:
    """``stage``, begun once the executors have given back what earlier stages left in their heaps."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be determined (no letters; null and empty texts); profiles are learned from the stage's own input.

    Where no row has a language there is no profile, and every document stays.
    """
    return langid.accept(docs, langid.train(docs))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written with a row number, and that column's name (one that ``docs`` hasn't)."""
    name = "row"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _kept(docs: DataFrame, number: str, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` (number, kept) keeps, without the number."""
    gone = cut(found.filter(~F.col("kept")).select(number), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, number, "left_anti").drop(number)


@rested
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest original, then the smallest doc_id (null last), then the first row."""
    docs, number = _numbered(docs)
    return _kept(docs, number, dedup.exact_duplicates(docs, row=number))


@rested
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id (null last), of each group of near duplicates.

    Texts are linked by operator 5 (SimHash fingerprints of three bits' difference at most, found by vantage-point trees); as that misses most edited
    copies, texts with a Jaccard similarity of 0.8 or more of their five-word shingles are linked as well.
    """
    docs, number = _numbered(docs)
    return _kept(docs, number, similar.near_duplicates(docs, row=number, radius=simhash.RADIUS))


@rested
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs; null texts match nothing and stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@rested
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document (null: none), with the digests of ids and decoded bytes."""
    return bpe.encode(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("encoded", encoded)]

#: A rank-order profile, a closure over similar shingle sets and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; a stage's own intermediate tables are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        home = work_dir(spark)
        with scratch(spark):
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}", home)
    return STAGES[-1][1](spark, docs, sf_dir)
