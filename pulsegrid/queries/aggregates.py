"""Sketches, grouping sets and global ranks, streams and tables of days, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import BeatConfig
from ..operators import beats as B
from ..operators import ranks, sketches
from ..sources import scratch
from ..streaming import versioned, windows
from .registry import BEATS, beats_of, query, rounded, table


@query("w40_global_rank", """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) AS row_number, rank() OVER w AS rank, round(percent_rank() OVER w, 9) AS percent_rank,
  ntile(100) OVER (ORDER BY l_quantity DESC, l_orderkey DESC, l_linenumber DESC) AS ntile FROM lineitem WINDOW w AS (ORDER BY l_quantity DESC)""")
def w40(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    got = ranks.global_rank(lines, ["l_quantity"], ["l_orderkey", "l_linenumber"], 100, descending=True)
    return rounded(got.drop("l_quantity"), digits=9)


@query("a40_grouping_sets", """SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS level, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity)::DOUBLE, 6) AS quantity
  FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""")
def a40_cube(spark, sf_dir):
    # lines are dealt by supplier, so a task counts its own suppliers only and the groups it holds don't grow with all of them
    dims = ["l_returnflag", "l_linestatus", "l_linenumber"]
    lines = table(spark, sf_dir, "lineitem").select(*dims, "l_suppkey", "l_quantity").repartition("l_suppkey").groupBy(*dims, "l_suppkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))
    aggs = [F.sum("n").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("quantity").alias("quantity")]
    return rounded(sketches.grouping_sets(lines, dims, "cube", aggs))


@query("a40_rollup_sets", """SELECT l_returnflag, l_linenumber, grouping(l_returnflag, l_linenumber)::BIGINT AS level, count(*) AS n, max(l_shipdate)::DATE AS last_day
  FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_linenumber), ())""")
def a40_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return sketches.grouping_sets(lines, ["l_returnflag", "l_linenumber"], [["l_returnflag", "l_linenumber"], ["l_linenumber"], []], [F.count("*").alias("n"), F.to_date(F.max("l_shipdate")).alias("last_day")])


@query("a40_sketches", """SELECT o_orderpriority AS entity, year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(min(o_totalprice)::DOUBLE, 6) AS low, round(max(o_totalprice)::DOUBLE, 6) AS high,
  true AS distinct_within, true AS quantiles_within FROM orders GROUP BY 1, 2""")
def a40_sketches(spark, sf_dir):
    """Years put together from stored days, and whether what the sketches say is within its bounds of the exact figures: 5 % of a
    distinct count, 3 % of the rows, and one row, of a quantile."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day"), "o_custkey", F.col("o_totalprice").cast("double").alias("price"))
    stored = scratch.written(sketches.daily(o, ["entity"], "day", ["o_custkey"], ["price"]))
    years = sketches.merged(stored.withColumn("year", F.year("day")), ["entity", "year"])
    got = sketches.told(years, ["entity", "year"])
    below = lambda i: F.avg((F.col("price") <= F.col("quantiles_price")[i]).cast("int"))
    exact = o.withColumn("year", F.year("day")).join(got.select("entity", "year", "quantiles_price"), ["entity", "year"]).groupBy("entity", "year").agg(F.countDistinct("o_custkey").alias("customers"), *[below(i).alias(f"r{i}") for i in range(3)])
    near = [F.abs(F.col(f"r{i}") - q) <= 0.03 + 1 / F.col("n") for i, q in enumerate((0.1, 0.5, 0.9))]
    return rounded(got.join(exact, ["entity", "year"]).select(
        "entity", "year", "n", "customers", F.col("low_price").alias("low"), F.col("high_price").alias("high"),
        (F.abs(F.col("distinct_o_custkey") - F.col("customers")) <= 0.05 * F.col("customers")).alias("distinct_within"), (near[0] & near[1] & near[2]).alias("quantiles_within")))


@query("streaming_rmssd", f"""WITH {BEATS}, kept AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx) AS q FROM filtered WHERE base AND NOT jump),
e AS (SELECT entity, beat_idx, duration_ms, floor(t_end / 30)::BIGINT - o AS k FROM kept, (VALUES (0), (1)) v(o)),
p AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity, k ORDER BY beat_idx) AS q2 FROM e WHERE k >= 0)
SELECT entity, k, round(CASE WHEN count(q2) >= 20 THEN sqrt(avg((duration_ms - q2) ** 2)) END, 6) AS rmssd FROM p GROUP BY 1, 2""")
def streaming_rmssd(spark, sf_dir):
    """The sliding windows of all recordings from a stream of 20 files between which beats are dealt without order."""
    beats = B.jump_from_base(B.time_axis(beats_of(spark, sf_dir), ["entity"]), ["entity"]).where("clean").select("entity", "beat_idx", "t_end", "duration_ms")
    at = scratch.folder(spark)
    beats.withColumn("_f", F.pmod(F.xxhash64("entity", "beat_idx"), F.lit(20))).repartition(20, "_f").write.partitionBy("_f").parquet(f"{at}/in")
    # a last beat, of no recording, that is later than all others by more than they are late
    last = spark.range(1).select(F.lit(None).cast("long").alias("entity"), F.lit(0).cast("long").alias("beat_idx"), F.lit(4e9).alias("t_end"), F.lit(800.0).alias("duration_ms"))
    last.write.parquet(f"{at}/in/_f=20")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, windows.STATE_STORE)
    try:
        stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/_f=*")
        out = windows.sliding_rmssd(stream, ["entity"], 1e9, BeatConfig())
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return rounded(spark.read.schema(out.schema).parquet(f"{at}/out").where("entity IS NOT NULL"))


@query("k1_days_with_manifest", """WITH o AS (SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS month, o_totalprice::DOUBLE AS x, o_orderstatus AS s FROM orders)
SELECT k, month, round(CASE WHEN year(month) = 1996 AND k % 3 = 0 THEN x + 1 ELSE x END, 2) AS x, CASE WHEN year(month) = 1996 AND k % 3 = 0 THEN 2 ELSE 1 END AS v FROM o
UNION ALL SELECT -k, month, x, 2 FROM o WHERE year(month) = 1996 AND k % 7 = 0""")
def k1_manifest(spark, sf_dir):
    """All orders in months, then corrections of one year: later versions, rows that are older than those stored, and new ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"), F.col("o_totalprice").cast("double").alias("x"))
    t = versioned.VersionedTable(spark, scratch.folder(spark), ["k"], "month", ["v"])
    t.merge(o.withColumn("v", F.lit(1)))
    year = o.where(F.year("month") == 1996)
    fixed = year.where("k % 3 = 0").withColumns({"x": F.col("x") + 1, "v": F.lit(2)})
    stale = year.where("k % 3 = 1").withColumns({"x": F.lit(0.0), "v": F.lit(0)})
    more = year.where("k % 7 = 0").withColumns({"k": -F.col("k"), "v": F.lit(2)})
    t.merge(fixed.unionByName(stale).unionByName(more))
    t.vacuum()
    return rounded(t.read(), digits=2)


@query("s17_refresh_two_months", """SELECT o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS month, CASE WHEN o_orderdate >= DATE '1997-10-01' THEN 'new' ELSE 'old' END AS x FROM orders
WHERE NOT (o_orderdate >= DATE '1997-10-01' AND o_orderkey % 5 = 0)""")
def s17_refresh(spark, sf_dir):
    """Orders by month up to 1997; a later run takes the last stored month, the two before it and all after it anew, where rows were withdrawn."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.trunc(F.to_date("o_orderdate"), "month").alias("month"))
    t = versioned.VersionedTable(spark, scratch.folder(spark), ["k"], "month")
    t.refresh(o.where(F.col("month") < "1998-01-01").withColumn("x", F.lit("old")))
    t.refresh(o.where("k % 5 <> 0").withColumn("x", F.lit("new")), back=61)
    return t.read()
