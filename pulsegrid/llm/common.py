"""Helpers shared by the corpus operators: table access, lineage cuts, skew-aware joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: Words are maximal runs of anything but ASCII white space.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session: spark.checkpoint.dir, or a folder of the warehouse where it is not set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def fresh(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of df has, whatever the case of its letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def set_aside(docs: DataFrame, **own: Column) -> DataFrame:
    """doc_id (long), text and the given columns, with all else that docs has in one struct, _row: whatever its
    columns are called, none can clash with those that an operator adds. taken_back() undoes it."""
    rest = [quoted(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text", *[v.alias(k) for k, v in own.items()])


def taken_back(columns: list[str], **instead: Column) -> list[Column]:
    """The columns of docs out of set_aside(): text as it is now, and others as they were but for those given."""
    return [(instead[c] if c in instead else F.col("text") if c == "text" else F.col("_row").getField(c)).alias(c) for c in columns]


def append_column(docs: DataFrame, source: str, out: str, kind: pa.DataType, ddl: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """docs with one more column made of `source` by an Arrow map; one that is already called `out` is replaced. All else
    travels in one struct, so names may be odd. make() is called once a task and maps lists of values."""
    docs = docs.drop(out)
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), quoted(source).alias("_in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(values(batch.column("_in").to_pylist()), kind)], ["_row", "_out"])

    got = own.mapInArrow(run, StructType([own.schema["_row"], StructField("_out", DataType.fromDDL(ddl))]))
    return got.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("_out").alias(out))


def materialize(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it back.

    It cuts lineage as checkpoint() does, but the copy is columnar and compressed, column pruning
    works on it, and its size is known to the optimizer. Every executor can read it, so the loss of
    one costs nothing.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    copy = spark.read.schema(df.schema).parquet(path)
    copy.copied_to = path
    return copy


def discard(*copies: DataFrame) -> None:
    """Remove what materialize() wrote for frames that nothing will read again."""
    for copy in copies:
        remove(copy.sparkSession, copy.copied_to)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder, in whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text) -> F.Column:
    """Words of a text, unchanged; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")
