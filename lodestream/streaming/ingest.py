"""Incremental ingest with Structured Streaming: next files, idempotent facts, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dump_id
from ..operators.store import write_facts


def ingest_counts(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], provenance: str, files_per_trigger: int = 1) -> None:
    """Process all files that are new since the last call, ``files_per_trigger`` at a time, then stop.

    Counts are kept by dump (the number in the file's name, null without one) and file in ``target``-files and replace what was there of that file;
    the dumps of the batch are then summed anew into ``target``. So a repeated batch, a lost checkpoint and several dumps in one batch, or a
    dump in several, all give the same facts; the checkpoint moves on only after the write. Rows without a key go to ``target``-rejected.
    """

    def write(batch: DataFrame, number: int) -> None:
        ok = F.lit(True)
        for k in keys:
            ok = ok & F.col(k).isNotNull()
        good = batch.filter(ok).groupBy(*keys, F.col(provenance).alias("provenance"), "dump_id", "file").agg(F.count("*").alias("listen_count"))
        write_facts(good, f"{target}-files", "dump_id", "file")
        dumps = [r.dump_id for r in batch.select("dump_id").distinct().collect()]  # no more than the batch has files
        touched = F.col("dump_id").isin([x for x in dumps if x is not None]) | (F.col("dump_id").isNull() & F.lit(None in dumps))
        whole = spark.read.schema(good.schema).parquet(f"{target}-files").filter(touched)
        write_facts(whole.groupBy(*keys, "provenance", "dump_id").agg(F.sum("listen_count").alias("listen_count")), target)
        write_facts(batch.filter(~ok), f"{target}-rejected", "dump_id", "file")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    day = stream.withColumns({"day": F.to_date("ts"), "file": F.col("_metadata.file_name"), "dump_id": dump_id(F.col("_metadata.file_name"))})
    day.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts per key and time window of a stream; rows later than ``late`` behind are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
