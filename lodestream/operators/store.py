"""Upserts, replacement and pruning as relations, and their idempotent application to Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(old: DataFrame, new: DataFrame, keys: list[str], prefer: str = "new", always: tuple[str, ...] = ()) -> DataFrame:
    """Keyed upsert by full outer join.

    Columns other than ``keys`` take the preferred side where it isn't null; columns in
    ``always`` take the new row's value wherever there is a new row.
    """
    o, n = old.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    j = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    out = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        if c in always:
            out.append(F.when(F.col("__n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            a, b = ("n", "o") if prefer == "new" else ("o", "n")
            out.append(F.coalesce(f"{a}.{c}", f"{b}.{c}").alias(c))
    return j.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows of ``new`` whose key isn't there."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def prune(df: DataFrame, day, column: str = "day") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(day))


def replace_window(old: DataFrame, new: DataFrame, start, column: str = "day") -> DataFrame:
    """Rows before ``start`` from ``old``, the others from ``new``."""
    return old.filter(F.col(column) < F.lit(start)).unionByName(new.filter(F.col(column) >= F.lit(start)))


def update_from(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns from ``other`` where it has the key with a value."""
    j = df.alias("a").join(other.alias("b"), keys, "left")
    return j.select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in columns else F.col(c if c in keys else f"a.{c}").alias(c) for c in df.columns])


def delete_using(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(doomed, keys, "left_anti")


def survivors(df: DataFrame, name_key, referenced: str, entity: str) -> DataFrame:
    """One row per name: referenced first, then the smallest id."""
    w = Window.partitionBy("name_key").orderBy(F.desc(referenced), entity)
    return df.withColumn("name_key", name_key).withColumn("rn", F.row_number().over(w))


def _first(df: DataFrame, where, order: list[str]) -> DataFrame:
    """Column __hit: true for the first matching row by ``order``. The least key is one small aggregation; only rows that share it are numbered."""
    key = F.struct(*order)
    least = df.filter(where).agg(F.min(key).alias("__least"))
    df = df.join(F.broadcast(least), F.lit(True)).withColumn("__tied", F.coalesce(where, F.lit(False)) & (key == F.col("__least")))
    tied = df.filter("__tied").withColumn("__hit", F.row_number().over(Window.partitionBy("__least").orderBy(*order)) == 1)
    return df.filter("not coalesce(__tied, false)").withColumn("__hit", F.lit(False)).unionByName(tied).drop("__least", "__tied")


def update_one(df: DataFrame, where, order: list[str], changes: dict) -> DataFrame:
    """Set columns in the first matching row by ``order``."""
    df = _first(df, where, order)
    return df.withColumns({c: F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()}).drop("__hit")


def delete_one(df: DataFrame, where, order: list[str]) -> DataFrame:
    return _first(df, where, order).filter(~F.col("__hit")).drop("__hit")


def write_facts(df: DataFrame, path: str, *partition: str) -> None:
    """Replace whole partitions: repeating a load changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*(partition or ("dump_id",))).parquet(path)
