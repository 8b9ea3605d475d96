"""Spark session with the settings that the engine's results rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; ``conf`` (dots written as __) overrides."""
    b = SparkSession.builder.appName("lodestream")
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Where that is unset and Spark runs inside
    one machine, a temporary folder takes its place; on a cluster that is an error,
    because no executor could read what another wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId  # the setting itself can't be changed in a running session
        base = _OWN.get(app) or _OWN.setdefault(app, f"file://{tempfile.mkdtemp(prefix='lodestream-')}")
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """What is written to the shared folder inside lands in a folder of its own, deleted at the end.

    Results that were made inside must have been collected or written elsewhere by then.
    """
    path = f"{work_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(token)
        delete(spark, path)


def work_dir(spark: SparkSession) -> str:
    """Where intermediate tables go: the innermost scratch folder, or the shared folder itself."""
    return _FOLDER.get() or shared_dir(spark)


def cut(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to the work folder (or ``folder``) and read it back: what follows survives lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
