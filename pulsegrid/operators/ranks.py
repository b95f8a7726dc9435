"""Places in the order of a whole table, without a window that takes the table to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import written

#: monotonically_increasing_id() has the partition above these bits and the row below.
_BITS = 33


def global_rank(df: DataFrame, order: Sequence[str], ties: Sequence[str], tiles: int | None = None, descending: bool = False) -> DataFrame:
    """df with row_number, rank and percent_rank by `order` over all rows, and ntile with `tiles`.

    Two passes: the table is cut into ranges of (order, ties), each sorted by itself, and a row's number is its place in
    its range and the rows of the ranges before, of which there are as many as the session has shuffle partitions. Rows
    of one value of `order` have one rank, that of the first of them, which may lie ranges before. `ties` puts
    such rows in order, so that a value that a third of all rows have is cut like any other; rows equal in
    both are numbered as they come, and stay in one range. Nulls come first, or last with `descending`.
    """
    way = F.desc if descending else F.asc
    by = [way(c) for c in (*order, *ties)]
    at = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    own = written(at.withColumns({"_p": F.shiftright("_at", _BITS), "_i": F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("_at"))
    value = F.struct(*[F.col(c) for c in order])
    # of each range: its rows, its first value, and its last one with the place of the first row that has it
    if descending:
        ends = [F.max(value).alias("first"), F.min(F.struct(value.alias("v"), F.col("_i").alias("i"))).alias("last")]
        place = F.col("last.i")
    else:
        ends = [F.min(value).alias("first"), F.max(F.struct(value.alias("v"), (-F.col("_i")).alias("i"))).alias("last")]
        place = -F.col("last.i")
    parts = own.groupBy("_p").agg(F.count("*").alias("n"), *ends).select("_p", "n", "first", F.col("last.v").alias("last"), place.alias("i")).orderBy("_p").collect()
    rows, total, before, start = [], 0, None, 0
    for r in parts:
        first = start if before is not None and r["first"] == before else total + 1
        rows.append((r["_p"], total, first, r["first"]))
        start = first if r["last"] == r["first"] else total + r["i"] + 1
        before, total = r["last"], total + r["n"]
    schema = StructType([StructField("_p", LongType()), StructField("_before", LongType()), StructField("_start", LongType()), StructField("_first", StructType([own.schema[c] for c in order]))])
    ranges = df.sparkSession.createDataFrame(rows, schema)  # a row for each range
    local = F.rank().over(Window.partitionBy("_p").orderBy(*[way(c) for c in order]))
    out = own.withColumn("_local", local).join(F.broadcast(ranges), "_p")
    number = F.col("_before") + F.col("_i") + 1
    rank = F.when(value.eqNullSafe(F.col("_first")), F.col("_start")).otherwise(F.col("_before") + F.col("_local"))
    told = {"row_number": number, "rank": rank}
    out = out.withColumns(told).withColumn("percent_rank", (F.col("rank") - 1) / F.lit(max(total - 1, 1)))
    if tiles:
        out = out.withColumn("ntile", tile(F.col("row_number"), total, tiles))
    return out.drop("_p", "_i", "_local", "_before", "_start", "_first")


def tile(number: Column, total: int, tiles: int) -> Column:
    """Which of so many tiles, as even as can be and the larger ones first, has the row of a number."""
    small, more = divmod(total, tiles)
    wide = more * (small + 1)
    rest = F.expr(f"{more} + (row_number - {wide} - 1) div {max(small, 1)} + 1")
    return F.when(number <= wide, F.floor((number - 1) / F.lit(small + 1)) + 1).otherwise(rest).cast("long")
