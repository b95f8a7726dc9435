"""Sensor recordings as a whole, activity days, older sleep exports and the choice among measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beats as B
from ..plans import contracts as C
from ..plans import sensors, sessions, sleep, weekly
from .registry import BEATS, SAMPLES, beats_of, query, rounded, samples_of, table

# A recording's samples as the packets of two sensors: the chest strap's clock is behind the phone's by a quarter of a second, the
# other one's by a half. Every tenth sample begins a packet.
_SENSORS = f"""{SAMPLES}, ecg AS (SELECT entity, session_id AS rec, sec + 0.25 AS t, hr FROM samples), acc AS (SELECT entity, session_id AS rec, sec + 0.5 AS t, hr, speed, z FROM samples)"""
_MOTION = """ms AS (SELECT entity, rec, t, (hr - avg(hr) OVER w) ** 2 + (speed - avg(speed) OVER w) ** 2 + (z - avg(z) OVER w) ** 2 AS e FROM acc WINDOW w AS (PARTITION BY entity ORDER BY t ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
mr AS (SELECT entity, rec, floor(t)::BIGINT - o AS k, sqrt(avg(e)) AS rms FROM ms, generate_series(0, 4) g(o) GROUP BY ALL), mb AS (SELECT entity, median(rms) + 3 * 1.4826 * mad(rms) AS bound FROM mr GROUP BY 1),
mo AS (SELECT entity, rec, k, k::DOUBLE AS start, (k + 5)::DOUBLE AS stop, rms, rms > bound AS high FROM mr JOIN mb USING (entity))"""
_PEAKS = """d AS (SELECT entity, rec, t, hr - avg(hr) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS d FROM ecg),
e AS (SELECT entity, rec, t, avg(d * d) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM d), m AS (SELECT entity, median(e) AS m, mad(e) AS s FROM e GROUP BY 1),
n AS (SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b FROM e WINDOW w AS (PARTITION BY entity ORDER BY t)), top AS (SELECT n.* FROM n JOIN m USING (entity) WHERE e > a AND e >= b AND e > m + 0.5 * 1.4826 * s),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) < 3 THEN 0 ELSE 1 END AS new FROM top), k AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY t) AS g FROM g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY e DESC, t) AS r FROM k) WHERE r = 1), c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM best),
p AS (SELECT entity, rec, t, lag(t) OVER w AS p, row_number() OVER w - 1 AS beat_idx FROM c WHERE n >= 5 WINDOW w AS (PARTITION BY entity ORDER BY t)),
b AS (SELECT entity, rec, beat_idx, (t + p) / 2 AS center, t AS t_end, 1000 * (t - p) AS duration_ms FROM p WHERE p IS NOT NULL),
be AS (SELECT *, CASE WHEN duration_ms NOT BETWEEN 300 AND 2000 THEN 'RR_OUT_OF_RANGE' WHEN coalesce(abs(duration_ms - lag(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx)) / lag(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx) > 0.2, false) THEN 'DELTA_RR_GT_20P' ELSE 'OK' END AS r0 FROM b),
bg AS (SELECT be.*, CASE WHEN r0 = 'OK' AND EXISTS (SELECT 1 FROM mo WHERE mo.entity = be.entity AND high AND center BETWEEN start AND stop) THEN 'ACC_HIGH_MOTION' ELSE r0 END AS reason FROM be)"""


def _converted(spark, sf_dir) -> sensors.Converted:
    s = samples_of(spark, sf_dir).select("entity", F.col("session_id").alias("rec"), F.col("sec").cast("double").alias("ts"), "hr", "speed", F.col("z").cast("double").alias("z"))
    packets = lambda late: s.where("ts % 10 = 0").select("entity", "rec", F.col("ts").alias("device"), (F.col("ts") + late).alias("phone"))
    return sensors.convert(
        s.select("entity", "rec", "ts", F.col("hr").alias("voltage")), s.select("entity", "rec", "ts", F.col("hr").alias("x"), F.col("speed").alias("y"), "z"), packets(0.25), packets(0.5), gate=True,
        cfg=B.BeatConfig(max_ms=8000.0), peak=sensors.PeakConfig(half=1, mult=0.5, apart_s=3.0, least=5), least=(20, 20), low=0.08, high=0.30)


@query("c20_beats", f"WITH {_SENSORS}, {_MOTION}, {_PEAKS.replace('300 AND 2000', '300 AND 8000')} SELECT entity, rec, beat_idx, round(center, 6) AS center, t_end::DOUBLE AS t_end, round(duration_ms, 6) AS duration_ms, (reason <> 'OK')::INTEGER AS offline, reason FROM bg")
def c20_beats(spark, sf_dir):
    return rounded(_converted(spark, sf_dir).beats)


@query("c20_motion", f"WITH {_SENSORS}, {_MOTION} SELECT entity, rec, k, start, stop, round(rms, 6) AS rms, high FROM mo")
def c20_motion(spark, sf_dir):
    return rounded(_converted(spark, sf_dir).motion)


@query("c20_respiration", f"""WITH {_SENSORS}, e AS (SELECT entity, rec, floor(t / 5)::BIGINT - o AS k, t, a.axis, CASE a.axis WHEN 'x' THEN hr WHEN 'y' THEN speed ELSE z END AS x FROM acc, generate_series(0, 5) g(o), (VALUES ('x'), ('y'), ('z')) a(axis)),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY entity, k, axis) AS c FROM e), f AS (SELECT round(0.08 + i * 0.02, 6) AS f FROM generate_series(0, 11) g(i)),
p AS (SELECT entity, rec, k, axis, f, sum(c * cos(2 * pi() * f * t)) ** 2 + sum(c * sin(2 * pi() * f * t)) ** 2 AS p FROM c, f GROUP BY ALL), b AS (SELECT *, sum(p) OVER w AS band, median(p) OVER w AS mid FROM p WINDOW w AS (PARTITION BY entity, k, axis)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, k ORDER BY band DESC, axis, p DESC, f) AS r FROM b)
SELECT entity, rec, k, axis, f::DOUBLE AS frequency, round(60 * f::DOUBLE, 6) AS per_minute, round(CASE WHEN mid > 0 THEN p / mid END, 3) AS confidence FROM r WHERE r = 1""")
def c20_respiration(spark, sf_dir):
    got = _converted(spark, sf_dir).respiration
    return rounded(got.withColumn("confidence", F.round("confidence", 3)))


@query("c20_summary", f"""WITH {_SENSORS}, {_MOTION}, {_PEAKS.replace('300 AND 2000', '300 AND 8000')}, q AS (SELECT entity, rec, count(*) AS rows, round(100.0 * count(*) FILTER (reason <> 'OK') / count(*), 6) AS offline_pct, count(*) FILTER (duration_ms NOT BETWEEN 300 AND 8000) AS out_of_range FROM bg GROUP BY 1, 2),
big AS (SELECT entity, rec FROM ecg GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT entity, rec, rows, offline_pct, out_of_range, CASE WHEN rows IS NOT NULL THEN 0 END AS n_issues, 1.0::DOUBLE AS fs_ecg, 1.0::DOUBLE AS fs_acc FROM big LEFT JOIN q USING (entity, rec)""")
def c20_summary(spark, sf_dir):
    got = _converted(spark, sf_dir).summary
    return rounded(got.select("entity", "rec", "rows", "offline_pct", "out_of_range", F.when(F.col("issues").isNotNull(), F.size("issues")).alias("n_issues"), "fs_ecg", "fs_acc"))


_LINE = lambda n: f"""e{n} AS (SELECT entity, rec, scale, median(device) FILTER (i * 3 < n) AS d0, median(phone - scale * device) FILTER (i * 3 < n) AS r0, median(device) FILTER (i * 3 >= 2 * n) AS d1, median(phone - scale * device) FILTER (i * 3 >= 2 * n) AS r1, count(*) AS m FROM i{n} GROUP BY ALL),
i{n + 1} AS (SELECT i{n}.* EXCLUDE (scale), e{n}.scale + CASE WHEN m >= 3 AND d1 > d0 THEN (r1 - r0) / (d1 - d0) ELSE 0 END AS scale FROM i{n} JOIN e{n} USING (entity, rec))"""  # noqa: E731


@query("c20_clock", f"""WITH {SAMPLES}, p AS (SELECT entity, session_id AS rec, sec::DOUBLE AS device, 5 + 1.0005::DOUBLE * sec + CASE WHEN sec % 7 = 0 THEN 3 ELSE 0 END AS phone FROM samples),
i0 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY device) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n, 1.0::DOUBLE AS scale FROM p), {_LINE(0)}, {_LINE(1)}
SELECT entity, rec, round(scale, 9) AS scale, round(median(phone - scale * device), 6) AS "offset" FROM i2 GROUP BY 1, 2, scale""")
def c20_clock(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    late = F.when(F.col("sec") % 7 == 0, 3).otherwise(0)
    got = sensors.clock(s.select("entity", F.col("session_id").alias("rec"), F.col("sec").cast("double").alias("device"), (5 + 1.0005 * F.col("sec") + late).alias("phone")))
    return got.select("entity", "rec", F.round("scale", 9).alias("scale"), F.round("offset", 6).alias("offset"))


@query("a26_activity_fields", """WITH o AS (SELECT o_custkey AS entity, date_trunc('month', o_orderdate)::DATE AS day, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 40)::DOUBLE END AS load, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS started, o_totalprice::DOUBLE AS p, o_orderpriority AS kind FROM orders)
SELECT entity, day, count(*) AS n_acts, sum(load) AS load, max(load) AS load_max, max(CASE WHEN k % 3 <> 0 THEN load * 2 END) AS intensity_max, round(sum(p) / 60, 6) AS duration_min, round(avg(90 + k % 60), 6) AS avg_hr, max(150 + k % 40)::DOUBLE AS max_hr,
  list(kind ORDER BY coalesce(load, '-infinity'::DOUBLE) DESC, k)[1] AS type_main, list(CASE WHEN k % 2 = 0 THEN round(p / 100, 6) END ORDER BY started DESC NULLS LAST, k)[1] AS atl, list((k % 11)::DOUBLE ORDER BY started DESC NULLS LAST, k)[1] AS ctl,
  list((k % 13)::DOUBLE ORDER BY started DESC NULLS LAST, k)[1] AS tsb, list((k % 10)::DOUBLE ORDER BY started DESC NULLS LAST, k)[1] AS rpe, list((40 + k % 20)::DOUBLE ORDER BY started DESC NULLS LAST, k)[1] AS resting_hr FROM o GROUP BY 1, 2""")
def a26_fields(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    load, price, num = F.when(k % 5 != 0, (k % 40).cast("double")), F.col("o_totalprice").cast("double"), lambda c: c.cast("double")
    acts = o.select(
        F.col("o_custkey").alias("entity"), F.trunc(F.to_date("o_orderdate"), "month").alias("day"), k.alias("k"), load.alias("load"), F.when(k % 3 != 0, load * 2).alias("intensity"), price.alias("moving_time_s"), num(90 + k % 60).alias("avg_hr"), num(150 + k % 40).alias("max_hr"),
        F.when(k % 2 == 0, price / 100).alias("atl"), num(k % 11).alias("ctl"), num(k % 13).alias("tsb"), num(k % 10).alias("rpe"), num(40 + k % 20).alias("resting_hr"), F.col("o_orderpriority").alias("type"), F.when(k % 7 != 0, F.col("o_orderdate")).alias("started"))
    return rounded(sessions.activity_fields(acts, ["entity", "day"], "k"))


@query("x1_best_measurement", """WITH m AS (SELECT o_custkey AS entity, year(o_orderdate) AS year, o_orderkey AS k, ['OK','FLAG_mecánico','INVALID'][(o_orderkey % 3 + 1)::INTEGER] AS q, o_orderkey % 4 = 0 AS stable, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 900 END AS s, o_shippriority + o_orderkey % 2 AS d,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 3 END AS a, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 24 END AS t FROM (SELECT *, 0 AS o_shippriority FROM orders))
SELECT entity, year, k FROM (SELECT *, row_number() OVER (PARTITION BY entity, year ORDER BY q = 'INVALID', q = 'OK' DESC, stable DESC, coalesce(s BETWEEN 60 AND 600, false) DESC, d DESC, a ASC NULLS LAST, t ASC NULLS LAST, k::VARCHAR) AS r FROM m) WHERE r = 1""")
def x1_best(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = F.element_at(F.array(F.lit("OK"), F.lit("FLAG_mecánico"), F.lit("INVALID")), (k % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("year"), k.alias("k"), pick.alias("Calidad"), F.when(k % 4 == 0, "OK").otherwise("Unstable").alias("HRV_Stability"), F.when(k % 5 != 0, k % 900).alias("Tiempo_Estabilizacion"), (k % 2).alias("duration_s"),
        F.when(k % 9 != 0, k % 3).alias("Artifact_pct"), F.when(k % 6 != 0, k % 24).alias("time"), k.cast("string").alias("file"))
    return C.best_measurement(rows, ["entity", "year"]).select("entity", "year", "k")


@query("c22_sleep_history", """WITH e AS (SELECT user_id AS entity, ts::DATE AS "Fecha", sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT entity, "Fecha", CASE WHEN n % 4 <> 0 THEN n % 9 * 60 + 30.0 + 15.0 / 60 END AS dur, CASE WHEN n % 3 <> 0 THEN n::DOUBLE END AS i, v / 10 AS night FROM e),
p AS (SELECT entity, CASE WHEN count(dur) >= 20 THEN quantile_cont(dur, 0.1) END AS p10, CASE WHEN count(dur) >= 20 THEN quantile_cont(dur, 0.9) END AS p90, CASE WHEN count(i) >= 20 THEN quantile_cont(i, 0.9) END AS ip FROM r GROUP BY 1)
SELECT entity, "Fecha", round(dur, 6) AS polar_sleep_duration_min, i AS polar_interruptions_long, round(night, 6) AS polar_night_rmssd, round(p10, 6) AS sleep_dur_p10, round(p90, 6) AS sleep_dur_p90, round(ip, 6) AS sleep_int_p90 FROM r JOIN p USING (entity)""")
def c22(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = e.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("Fecha")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    n = F.col("n")
    export = d.select("entity", "Fecha", F.when(n % 4 != 0, F.concat(F.lit("PT"), (n % 9).cast("string"), F.lit("H30M15S"))).otherwise("none").alias("asleep_duration"), F.when(n % 3 != 0, n).alias("sleep_long_interruptions"), (F.col("v") / 10).alias("nightly_rmssd"))
    return rounded(sleep.history(export).select("entity", "Fecha", "polar_sleep_duration_min", "polar_interruptions_long", "polar_night_rmssd", "sleep_dur_p10", "sleep_dur_p90", "sleep_int_p90"))


@query("a39_validation", f"""WITH {BEATS}, t AS (SELECT entity, CASE WHEN beat_idx % 211 <> 0 THEN duration_ms END AS d, CASE WHEN beat_idx % 97 = 0 THEN 2 ELSE offline::INTEGER END AS o FROM beats)
SELECT entity, count(*) AS rows, count(*) FILTER (d NOT BETWEEN 300 AND 2000) AS out_of_range, round(100.0 * count(*) FILTER (o = 1) / count(*), 6) AS offline_pct,
  bool_or(d IS NULL)::INTEGER + coalesce(bool_or(d <= 0), false)::INTEGER + bool_or(o NOT IN (0, 1))::INTEGER AS n_issues, NOT (bool_or(d IS NULL) OR coalesce(bool_or(d <= 0), false) OR bool_or(o NOT IN (0, 1))) AS ok FROM t GROUP BY 1""")
def a39(spark, sf_dir):
    b = beats_of(spark, sf_dir)
    rows = b.select("entity", F.when(F.col("beat_idx") % 211 != 0, F.col("duration_ms").cast("string")).otherwise("x").alias("duration"), F.when(F.col("beat_idx") % 97 == 0, 2).otherwise(F.col("offline").cast("int")).alias("offline"))
    got = B.validate(rows, ["entity"])
    return rounded(got.select("entity", "rows", "out_of_range", "offline_pct", F.size("issues").alias("n_issues"), "ok"))


@query("x8_grades", f"""WITH {SAMPLES}, d AS (SELECT entity, sec, z::DOUBLE AS alt, sum(speed) OVER (PARTITION BY entity ORDER BY sec) AS dist FROM samples), g AS (SELECT entity, CASE WHEN dist > lag(dist, 10) OVER w THEN (alt - lag(alt, 10) OVER w) / (dist - lag(dist, 10) OVER w) END AS s FROM d WINDOW w AS (PARTITION BY entity ORDER BY sec))
SELECT entity, count(*) FILTER (s > 0.01) AS up_s, count(*) FILTER (s < -0.01) AS down_s, count(*) FILTER (abs(s) <= 0.01) AS flat_s FROM g GROUP BY 1""")
def x8_grades(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)
    s = samples_of(spark, sf_dir).withColumns({"dist": F.sum("speed").over(w), "alt": F.col("z").cast("double")})
    return weekly.grades(s, ["entity"], "alt", "dist")
