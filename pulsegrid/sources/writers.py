"""Contract-ordered sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.upsert import in_contract


def contract_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Contract columns first, all fields quoted."""
    in_contract(df, columns).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def contract_parquet(df: DataFrame, path: str, columns: list[str], partitions: list[str]) -> None:
    """Replaces only the partitions that df has rows for."""
    in_contract(df, columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def beat_lines(beats: DataFrame) -> DataFrame:
    """The text lines `duration,offline` of a beat file, three decimals."""
    return beats.select(F.format_string("%.3f,%d", stats.round_even("duration_ms", 3), F.col("offline").cast("int")).alias("value"))


def payload(df: DataFrame, keys: list[str], fields: dict[str, Column]) -> DataFrame:
    """keys and a JSON object of the fields that have a value."""
    return df.select(*keys, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("payload"))


def slug(day: Column, time: Column, sport: Column, session_id: Column) -> Column:
    return F.regexp_replace(F.concat_ws("_", day.cast("string"), time, sport, session_id), ":", "-")


def params_hash(params: dict) -> str:
    """Eight digits that stand for a set of parameters."""
    import hashlib
    import json

    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:8]
