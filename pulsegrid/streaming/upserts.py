"""Incremental runs: what arrives is folded into stored tables batch by batch.

A late correction must replace what is stored, which a streaming de-duplication does not do, as it keeps the first
row. So each micro-batch is an upsert, keyed by the run's id, which its checkpoint holds, and the batch's number: a
batch that is run again after a failure writes the same version anew, and a run with a new checkpoint overwrites
nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import keep_last


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], version: Sequence[str]) -> StreamingQuery:
    """Keep at path the last row of each key by version, over all that has arrived; stops when input is used up.

    Batches are appended by run and number, so nothing that is being read is overwritten; `current` gives the rows
    that count, the later written ones where versions are equal, and `compact` folds old batches together.
    """

    def write(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        last = keep_last(batch, list(keys), list(version)).withColumn("_written", F.current_timestamp()).withColumn("_batch", F.lit(f"{run}-{number}"))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    return keep_last(spark.read.parquet(path), list(keys), [*version, "_written"]).drop("_batch", "_written")


def compact(spark: SparkSession, path: str, to: str, keys: Sequence[str], version: Sequence[str]) -> None:
    folded = current(spark, path, keys, version).withColumn("_written", F.current_timestamp()).withColumn("_batch", F.lit("compacted"))
    folded.write.mode("overwrite").partitionBy("_batch").parquet(to)


def tumbling(stream: DataFrame, keys: Sequence[str], at: str, size: str, late: str, aggregates: Sequence) -> DataFrame:
    """Aggregates in event-time windows; rows later than `late` are left out, and windows are given once they close."""
    return stream.withWatermark(at, late).groupBy(*keys, F.window(at, size).alias("window")).agg(*aggregates)


def sessions(stream: DataFrame, keys: Sequence[str], at: str, gap: str, late: str, aggregates: Sequence) -> DataFrame:
    """Aggregates over bursts of rows without a pause of `gap`."""
    return stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("window")).agg(*aggregates)


def each_batch(stream: DataFrame, checkpoint: str, fn: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def high_water_mark(table: DataFrame, keys: Sequence[str], day: str, back: int = 2) -> DataFrame:
    """keys and from_day: where the next run of each key starts, `back` days before its last stored day."""
    return table.groupBy(*keys).agg(F.date_sub(F.max(day), back).alias("from_day"))
