"""Sinks and table exchange: JDBC, delimited results, metric records, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str], key: str | None = None, parts: int = 64) -> DataFrame:
    """A database table or, in brackets with an alias, a query; read in ``parts`` ranges of the whole-number ``key`` where that is given.

    Filters and columns are pushed to the database. A null key is read with the first range; an empty table has one.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if key is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", table).load().agg(F.min(key), F.max(key)).first()
    if low is None:
        return reader.option("dbtable", table).load()
    ranges = {"dbtable": table, "partitionColumn": key, "lowerBound": str(low), "upperBound": str(high + 1), "numPartitions": str(parts)}
    return reader.options(**ranges).load()


def jdbc_overwrite(df: DataFrame, url: str, table: str, options: dict[str, str], rows: int = 50_000, keep: bool = True) -> None:
    """Replace the rows of a database table, ``rows`` at a time; with ``keep`` the table's own definition stays."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).option("batchsize", rows).option("truncate", str(keep).lower()).mode("overwrite").save()


def numbered(df: DataFrame, base: str, name: str, iteration: int, day: str) -> str:
    """Write CSV parts with a header to a folder of this iteration and day, and return it; one that exists already is an error."""
    path = f"{base.rstrip('/')}/{name}_{iteration:04d}_{day}"
    df.write.option("header", True).mode("errorifexists").csv(path)
    return path


def metrics(spark: SparkSession, values: dict[str, float | None], path: str) -> None:
    """One JSON object with the metrics, NaN as null, in place of what was there."""
    row = [None if v is None or v != v else float(v) for v in values.values()]
    schema = ", ".join(f"`{k}` double" for k in values)
    spark.createDataFrame([tuple(row)], schema).coalesce(1).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold a JSON array (or one object); other files give no rows."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Column value: each line, empty ones included."""
    return spark.read.text(path)
