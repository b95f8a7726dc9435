"""The registry, and the adapters that give the given tables the shape of the operators' inputs, in both languages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and only the named columns if any are named."""
    kinds = dict(df.dtypes)
    own = keep or df.columns
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in own])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["daily_gate"](spark, sf_dir)


# -- daily series: an order priority's orders of a day -----------------------------------------------------------

DAILY = """daily AS (
  SELECT o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice)::DOUBLE AS x, count(*) AS n_orders,
    sum(o_custkey)::BIGINT AS c, sum(o_orderkey)::BIGINT AS k
  FROM orders GROUP BY ALL),
core AS (
  SELECT entity, day, ln(x) AS ln_x, x AS rmssd, 50.0 + (c % 200) / 10.0 AS hr, n_orders,
    CASE WHEN k % 11 = 0 THEN 'INVALID' WHEN k % 7 = 0 THEN 'FLAG' ELSE 'OK' END AS quality, k % 11 <> 0 AND k % 7 <> 0 AS clean
  FROM daily)"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("day")).agg(
        F.avg(F.col("o_totalprice").cast("double")).alias("x"), F.count("*").alias("n_orders"), F.sum("o_custkey").cast("long").alias("c"), F.sum("o_orderkey").cast("long").alias("k"))


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = daily(spark, sf_dir)
    quality = F.when(F.col("k") % 11 == 0, "INVALID").when(F.col("k") % 7 == 0, "FLAG").otherwise("OK")
    return d.select("entity", "day", F.log("x").alias("ln_x"), F.col("x").alias("rmssd"), (50.0 + (F.col("c") % 200) / 10.0).alias("hr"), "n_orders", quality.alias("quality"), (quality == "OK").alias("clean"))


def core_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series in the shape of the measurement contract."""
    c = core(spark, sf_dir)
    return c.select(
        "entity", F.col("day").alias("Fecha"), F.when(F.col("quality") == "FLAG", "FLAG_mecánico").otherwise(F.col("quality")).alias("Calidad"), F.lit("OK").alias("HRV_Stability"), F.lit("OK").alias("Stability_Subtype"),
        F.lit(1.0).alias("Artifact_pct"), F.lit(60.0).alias("Tiempo_Estabilizacion"), F.col("hr").alias("HR_stable"), (60 / F.col("hr")).alias("RRbar_s"), F.col("rmssd").alias("RMSSD_stable"),
        F.col("rmssd").alias("RMSSD_stable_last2"), F.lit(0.0).alias("tail_mismatch_pct"), F.col("ln_x").alias("lnRMSSD"), F.lit("").alias("Flags"))


# -- beats: eight users' events in time order are one recording ---------------------------------------------------

BEATS = """beats AS (
  SELECT user_id // 8 AS entity, DATE '2024-01-01' AS day, row_number() OVER (PARTITION BY user_id // 8 ORDER BY ts, event_id) AS beat_idx,
    700.0 + value / 3 AS duration_ms, event_type = 'error' AS offline FROM events WHERE value IS NOT NULL),
timed AS (SELECT *, sum(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx) / 1000 AS t_end FROM beats),
filtered AS (
  SELECT *, base AND coalesce(abs(duration_ms - p) / p > 0.20, false) AS jump FROM (
    SELECT *, lag(duration_ms) OVER (PARTITION BY entity, base ORDER BY beat_idx) AS p FROM (
      SELECT *, NOT offline AND (duration_ms < 300 OR duration_ms > 2000) AS out_of_range, NOT offline AND duration_ms BETWEEN 300 AND 2000 AS base FROM timed)))"""


def beats_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("entity", F.floor(F.col("user_id") / 8))
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    return e.select("entity", F.lit("2024-01-01").cast("date").alias("day"), F.row_number().over(w).cast("long").alias("beat_idx"), (700.0 + F.col("value") / 3).alias("duration_ms"), (F.col("event_type") == "error").alias("offline"))


# -- samples: one reading a second for each group of users ---------------------------------------------------------

SAMPLES = """samples AS (
  SELECT user_id // 8 AS entity, 's1' AS session_id, row_number() OVER (PARTITION BY user_id // 8 ORDER BY ts, event_id) - 1 AS sec,
    90.0 + value / 5 AS hr, (event_id % 9) / 2.0 AS speed, event_id % 13 AS z FROM events WHERE value IS NOT NULL)"""


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("entity", F.floor(F.col("user_id") / 8))
    w = Window.partitionBy("entity").orderBy("ts", "event_id")
    return e.select("entity", F.lit("s1").alias("session_id"), (F.row_number().over(w) - 1).cast("long").alias("sec"), (90.0 + F.col("value") / 5).alias("hr"), ((F.col("event_id") % 9) / 2.0).alias("speed"), (F.col("event_id") % 13).alias("z"))


# -- sessions: an order is a session of its customer's nation ------------------------------------------------------

SESSIONS = """lines AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS q, count(*) AS n FROM lineitem GROUP BY 1),
sessions AS (
  SELECT c_nationkey AS entity, CAST(o_orderkey AS VARCHAR) AS session_id, CAST(o_orderdate AS DATE) AS day, '08:00' AS start_time,
    ['trail_run','road_run','bike','strength','mobility'][(o_orderkey % 5 + 1)::INTEGER] AS sport, o_orderpriority AS grp,
    CASE WHEN o_orderkey % 17 <> 0 THEN round(o_totalprice::DOUBLE / 1000, 1) END AS load, q AS duration, n AS rpe
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lines ON l_orderkey = o_orderkey)"""


def sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("double")).alias("q"), F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    sports = F.array(*map(F.lit, ("trail_run", "road_run", "bike", "strength", "mobility")))
    return o.select(
        F.col("c_nationkey").alias("entity"), F.col("o_orderkey").cast("string").alias("session_id"), F.to_date("o_orderdate").alias("day"), F.lit("08:00").alias("start_time"),
        F.element_at(sports, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("sport"), F.col("o_orderpriority").alias("grp"),
        F.when(F.col("o_orderkey") % 17 != 0, F.round(F.col("o_totalprice").cast("double") / 1000, 1)).alias("load"), F.col("q").alias("duration"), F.col("n").alias("rpe"))


def session_contract(spark, sf_dir):
    """The sessions in the shape of the session contract, as far as roll-ups and reports look at it."""
    s = sessions_of(spark, sf_dir)
    n = F.col("session_id").cast("long")
    return s.select(
        "entity", "session_id", F.col("day").alias("Fecha"), "start_time", "sport", "load", F.col("duration").alias("duration_min"), F.col("rpe").cast("double").alias("rpe"), F.col("grp").alias("session_group"),
        F.when(n % 3 != 0, F.round(F.col("duration") / 100, 4)).alias("stream_dt_est"), (n % 2).cast("int").alias("notes_present"), F.lit(1).alias("rpe_present"), F.when(n % 4 != 0, "icu").otherwise("fallback").alias("zones_source"),
        F.col("grp").alias("intensity_category"), F.when(n % 5 != 0, (n % 40).cast("double")).alias("elev_density"), F.when(n % 7 != 0, (n % 30).cast("double") + 1).alias("distance_km"),
        *[F.lit(None).cast("double").alias(c) for c in ("work_total_min", "z3_total_min", "hr_max", "hr_p95", "cardiac_drift_pct", "elev_gain_m", "elev_loss_m")], F.lit(None).cast("int").alias("work_n_blocks"), F.lit(0).alias("late_intensity"),
        F.lit("").alias("effort_vs_recent"), F.lit("").alias("effort_vs_anchor"))


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
