"""Keyed upserts and set operations on tables with a contract of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_contract(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """Contract columns first, in order, missing ones as nulls; extra columns last."""
    have = {c.lower(): c for c in df.columns}
    first = [F.col(have[c.lower()]).alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in contract]
    known = {c.lower() for c in contract}
    return df.select(*first, *[c for c in df.columns if c.lower() not in known])


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old without the keys of new, and new; columns that one side lacks are null there."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def keep_last(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """One row for each key, the last by version; the version must order rows of a key fully."""
    order = [F.desc_nulls_last(v) if isinstance(v, str) else v.desc_nulls_last() for v in version]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that tells all rows of a key apart."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str, version: Sequence[str], day: str | None = None) -> DataFrame:
    """Rows of both by trimmed key, new before old and later versions before earlier ones. Rows with an empty key
    or, where `day` names a column, without a valid date are dropped."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn(key, F.trim(F.col(key).cast("string"))).where(F.coalesce(F.col(key), F.lit("")) != "")
    last = keep_last(both, [key], ["_side", *version]).drop("_side")
    return last.where(F.col(day).cast("string").try_cast("date").isNotNull()) if day else last


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.distinct().exceptAll(right.distinct())


def set_union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right, allowMissingColumns=True).distinct()


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with the side; empty if both have the same."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def compare_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, column, before, after of every value that differs between rows that both versions have."""
    left = a.select(*keys, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    right = b.select(*keys, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in columns])
    return left.join(right, list(keys)).select(*keys, F.explode(each).alias("_d")).select(*keys, "_d.*").where(~F.col("before").eqNullSafe(F.col("after")))
