"""Data-quality constraints as one aggregate over a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import yes


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n_rows, n_violations; a rule is what every row must meet, and a missing answer counts as a violation."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(~yes(c)).alias(k) for k, c in rules.items()])
    each = F.array(*[F.struct(F.lit(k).alias("rule"), F.col("_n").alias("n_rows"), F.col(k).alias("n_violations")) for k in rules])
    return counted.select(F.inline(each))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, or that are missing."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | missing)


def one_of(column: str, *values: str) -> Column:
    return F.col(column).isin(*values)


def distribution(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, value, n and share of each value among its keys' rows."""
    from pyspark.sql import Window

    n = df.groupBy(*keys, F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def flag_counts(df: DataFrame, keys: list[str], flags: str, sep: str = "|") -> DataFrame:
    """keys, flag and n over a delimited list column; empty lists count nothing."""
    each = df.select(*keys, F.explode(F.split(F.coalesce(F.col(flags), F.lit("")), f"\\{sep}")).alias("flag")).where("flag <> ''")
    return each.groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def top_outliers(df: DataFrame, by: str, n: int = 20, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by), *(ties or [])).limit(n)
