"""Tables that operators write between steps, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where that is not set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return f"{found or spark.conf.get('spark.sql.warehouse.dir') + '/_checkpoints'}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written once and read back: what is not the same when it is worked out again, as row numbers of a partition, stays."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
