"""How queries are declared: a DataFrame function with SQL for DuckDB, or one SQL text for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL where that can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def shared(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register SQL with ``{table}`` places that both engines read; ``spark_sql`` where the dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_sql or sql
        names = set(re.findall(r"\{(\w+)\}", text))
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = re.sub(r"\{(\w+)\}", r"\1", sql)
