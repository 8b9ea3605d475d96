"""Sources: archives of JSON lines, delimited files, zipped CSV, link lists, catalogue."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTEN = (
    "timestamp long, track_metadata struct<track_name:string, artist_name:string, release_name:string, release_date:string, first_release_date:string, date:string, "
    "additional_info:struct<artist_mbids:string, artist_names:string, release_artist_names:string, recording_mbid:string, release_name:string, "
    "release_date:string, first_release_date:string, date:string, year:string, release_year:string, original_release_date:string>>"
)


def archive_lines(spark: SparkSession, path: str, inside: str = "/listens/", suffix: str = ".listens", most: int = 0) -> DataFrame:
    """Non-empty lines of the members of ``.tar.zst`` archives: archive, member, line_no, line.

    One task streams one archive straight from its path, so an archive may be larger than memory;
    at most ``most`` lines an archive where that isn't 0.
    """
    import zstandard
    from pyarrow import fs

    files = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["path"]:
                out, n = [], 0
                store, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_stream(at, compression=None) as f, zstandard.ZstdDecompressor().stream_reader(f) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    for member in tar:
                        if not member.isfile() or inside not in f"/{member.name}" or not member.name.endswith(suffix):
                            continue
                        for k, line in enumerate(tar.extractfile(member)):
                            text = line.decode("utf-8", "replace").strip()
                            if not text:
                                continue
                            n += 1
                            if most and n > most:
                                break
                            out.append((name, member.name, k, text))
                            if len(out) >= 10_000:
                                yield pd.DataFrame(out, columns=["archive", "member", "line_no", "line"])
                                out = []
                if out:
                    yield pd.DataFrame(out, columns=["archive", "member", "line_no", "line"])

    return files.mapInPandas(run, "archive string, member string, line_no long, line string")


def parse_lines(lines: DataFrame, schema: str = LISTEN, column: str = "line") -> DataFrame:
    """Column rec, and bad: the line is no JSON object."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rec = F.from_json(column, f"{schema}, _corrupt string", opts)
    return lines.withColumn("rec", rec).withColumn("bad", F.col("rec").isNull() | F.col("rec._corrupt").isNotNull())


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "::", encoding: str = "ISO-8859-1") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, encoding=encoding)


def csv(spark: SparkSession, path: str, schema: str | None = None, columns: list[str] | None = None, null: str = "") -> DataFrame:
    df = spark.read.csv(path, header=True, schema=schema, nullValue=null) if schema else spark.read.csv(path, header=True, nullValue=null)
    return df.select(*columns) if columns else df


def zipped_csv(spark: SparkSession, path: str, schema: str, na: tuple[str, ...] = ("", "NA")) -> DataFrame:
    """CSV members of zip archives, with ``na`` cells null; unreadable numbers are null."""
    fields = spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.lower().endswith(".csv"):
                            with z.open(name) as f:
                                for part in pd.read_csv(f, dtype=str, chunksize=10_000, keep_default_na=False, na_values=list(na)):
                                    yield part.reindex(columns=fields.names).astype(object).where(lambda x: x.notna(), None)

    text = ", ".join(f"`{n}` string" for n in fields.names)
    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    return raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in fields])


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per anchor target of each page, with its position."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1)).alias("pos", "href"))


def newer_dumps(names: DataFrame, after: int, n: int, column: str = "path") -> DataFrame:
    """The next ``n`` dumps whose number is beyond ``after``."""
    number = F.regexp_extract(column, r"dump-(\d+)-", 1)
    return names.withColumn("dump_id", F.when(number != "", number.cast("long"))).filter(F.col("dump_id") > after).orderBy("dump_id", column).limit(n)


def row_counts(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Name, columns and rows of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.lit(len(df.columns)).alias("columns"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
