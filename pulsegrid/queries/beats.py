"""Beat series, fractal scaling, islands and per-second samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import DfaConfig, SessionConfig
from ..functions import stats
from ..operators import beats as B
from ..operators import dfa as D
from ..operators import islands
from ..plans import sensors, sessions, weekly
from .registry import BEATS, SAMPLES, beats_of, query, rounded, samples_of

K = ["entity"]


def _timed(spark, sf_dir):
    return B.time_axis(beats_of(spark, sf_dir), K)


@query("a1_time_axis", f"WITH {BEATS} SELECT entity, beat_idx, round(t_end, 6) AS t_end FROM timed")
def a1(spark, sf_dir):
    return rounded(_timed(spark, sf_dir), "entity", "beat_idx", "t_end")


@query("p1_p2_a2_base_filter", f"""WITH {BEATS} SELECT entity, count(*) AS n_total, count(*) FILTER (offline) AS n_off, count(*) FILTER (out_of_range) AS n_oor, count(*) FILTER (jump) AS n_jump,
  round(100.0 * (count(*) FILTER (offline) + count(*) FILTER (out_of_range) + count(*) FILTER (jump)) / count(*), 6) AS artifact_pct FROM filtered GROUP BY entity""")
def p2(spark, sf_dir):
    d = B.jump_from_base(_timed(spark, sf_dir), K).groupBy("entity").agg(F.count("*").alias("n_total"), F.count_if("offline").alias("n_off"), F.count_if("out_of_range").alias("n_oor"), F.count_if("jump").alias("n_jump"))
    return rounded(d.withColumn("artifact_pct", 100 * (F.col("n_off") + F.col("n_oor") + F.col("n_jump")) / F.col("n_total")))


@query("p4_raw_filter", f"""WITH {BEATS} SELECT entity, beat_idx, CASE WHEN duration_ms NOT BETWEEN 300 AND 2000 THEN 'out_of_range' WHEN coalesce(abs(duration_ms - p) / p > 0.20, false) THEN 'jump' ELSE '' END AS reason
  FROM (SELECT *, lag(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx) AS p FROM timed)""")
def p4(spark, sf_dir):
    return B.jump_from_raw(_timed(spark, sf_dir), K).select("entity", "beat_idx", "reason")


ACCEPTED = """f(entity, beat_idx, reason, last) AS (
  SELECT entity, beat_idx, CASE WHEN offline THEN 'offline' WHEN out_of_range THEN 'out_of_range' ELSE '' END, CASE WHEN base THEN duration_ms END FROM filtered WHERE beat_idx = 1
  UNION ALL
  SELECT b.entity, b.beat_idx, r.reason, CASE WHEN r.reason = '' THEN b.duration_ms ELSE f.last END
  FROM f JOIN filtered b ON b.entity = f.entity AND b.beat_idx = f.beat_idx + 1,
    LATERAL (SELECT CASE WHEN b.offline THEN 'offline' WHEN b.out_of_range THEN 'out_of_range' WHEN coalesce(abs(b.duration_ms - f.last) / f.last > 0.20, false) THEN 'jump' ELSE '' END AS reason) r)"""


@query("p3_accepted_filter", f"""WITH RECURSIVE {BEATS},
{ACCEPTED}
SELECT entity, beat_idx, reason = '' AS accepted, reason FROM f""")
def p3(spark, sf_dir):
    return B.jump_from_accepted(_timed(spark, sf_dir), K)


_KEPT = f"{BEATS}, kept AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity ORDER BY beat_idx) AS q FROM filtered WHERE base AND NOT jump)"


def _kept(spark, sf_dir):
    return B.jump_from_base(_timed(spark, sf_dir), K).where("clean")


@query("a3_a8_segment_means", f"""WITH {_KEPT} SELECT entity, count(*) AS n, round(avg(duration_ms) / 1000, 6) AS rr, round(60000 / avg(duration_ms), 6) AS hr, round(sqrt(avg((duration_ms - q) ** 2)), 6) AS rmssd,
  round(ln(sqrt(avg((duration_ms - q) ** 2))), 6) AS ln_rmssd, round(stddev_pop(duration_ms) / avg(duration_ms), 6) AS cv FROM kept GROUP BY entity""")
def a3(spark, sf_dir):
    d = _kept(spark, sf_dir).withColumn("_p", F.lag("duration_ms").over(Window.partitionBy("entity").orderBy("beat_idx")))
    m = stats.rmssd("duration_ms", "_p")
    return rounded(d.groupBy("entity").agg(F.count("*").alias("n"), (F.avg("duration_ms") / 1000).alias("rr"), (60000 / F.avg("duration_ms")).alias("hr"), m.alias("rmssd"), F.log(m).alias("ln_rmssd"), (F.stddev_pop("duration_ms") / F.avg("duration_ms")).alias("cv")))


@query("a5_stress_index", f"""WITH {_KEPT}, s AS (SELECT entity, min(duration_ms) AS lo, max(duration_ms) AS hi, count(*) AS n FROM kept GROUP BY 1 HAVING count(*) >= 20 AND max(duration_ms) > min(duration_ms)),
b AS (SELECT s.*, least(floor((duration_ms - lo) / 50), ceil((hi - lo) / 50) - 1) AS bin, count(*) AS c FROM kept JOIN s USING (entity) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c DESC, bin) AS r FROM b)
SELECT entity, round_even((100 * c / n) / (2 * ((lo + (bin + 0.5) * 50) / 1000) * ((hi - lo) / 1000)), 1) AS si FROM t WHERE r = 1""")
def a5(spark, sf_dir):
    return B.stress_index(_kept(spark, sf_dir), K)


@query("a6_poincare", f"""WITH {_KEPT}, m AS (SELECT entity, count(*) AS n, stddev_pop(duration_ms - q) / sqrt(2) AS sd1, var_pop(duration_ms) AS v FROM kept GROUP BY 1)
SELECT entity, round(sd1, 2) AS sd1, round(sqrt(greatest(2 * v - sd1 ** 2, 0)), 2) AS sd2, round(sd1 / sqrt(2 * v - sd1 ** 2), 3) AS ratio FROM m WHERE n >= 10""")
def a6(spark, sf_dir):
    return B.poincare(_kept(spark, sf_dir), K)


@query("w12_sliding_rmssd", f"""WITH {_KEPT}, e AS (SELECT entity, beat_idx, duration_ms, floor(t_end / 30)::BIGINT - o AS k FROM kept, (VALUES (0), (1)) v(o)),
p AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity, k ORDER BY beat_idx) AS q2 FROM e WHERE k >= 0)
SELECT entity, k, round(CASE WHEN count(q2) >= 20 THEN sqrt(avg((duration_ms - q2) ** 2)) END, 6) AS rmssd FROM p GROUP BY 1, 2""")
def w12(spark, sf_dir):
    return rounded(B.sliding_rmssd(_kept(spark, sf_dir), K))


@query("w13_stable_start", f"""WITH {_KEPT}, e AS (SELECT entity, beat_idx, duration_ms, floor(t_end / 30)::BIGINT - o AS k FROM kept, (VALUES (0), (1)) v(o)),
p AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity, k ORDER BY beat_idx) AS q2 FROM e WHERE k >= 0),
w AS (SELECT entity, k, CASE WHEN count(q2) >= 20 THEN sqrt(avg((duration_ms - q2) ** 2)) END AS x FROM p GROUP BY 1, 2),
n AS (SELECT w.*, a.x AS xp, b.x AS xn, c.x AS x2 FROM w LEFT JOIN w a ON a.entity = w.entity AND a.k = w.k - 1 LEFT JOIN w b ON b.entity = w.entity AND b.k = w.k + 1 LEFT JOIN w c ON c.entity = w.entity AND c.k = w.k + 2),
g AS (SELECT entity, max(k) + 1 AS nw, CASE WHEN count(x) >= 4 THEN list_aggregate(list_slice(list(x ORDER BY k) FILTER (x IS NOT NULL), -4, -1), 'median') END AS goal FROM w GROUP BY 1)
SELECT n.entity, round(30.0 * coalesce(min(n.k) FILTER (n.k >= 1 AND n.k <= nw - 2 AND abs(x - xp) / xp < 0.08 AND abs(xn - x) / x < 0.08),
  min(n.k) FILTER (n.k <= nw - 3 AND abs(x - goal) / goal < 0.08 AND abs(xn - goal) / goal < 0.08 AND abs(x2 - goal) / goal < 0.08)), 3) AS latency FROM n JOIN g USING (entity) GROUP BY 1""")
def w13(spark, sf_dir):
    w = B.sliding_rmssd(_kept(spark, sf_dir), K)
    w = w.withColumn("nw", F.max("k").over(Window.partitionBy("entity")) + 1)
    return rounded(B.stable_start(w, K, "nw"), digits=3)


_LAYER = f"""{BEATS}, acc AS (SELECT *, base AND NOT jump AS accepted FROM filtered),
med AS (SELECT *, CASE WHEN count(duration_ms) OVER w >= 3 THEN median(duration_ms) OVER w END AS m FROM acc WINDOW w AS (PARTITION BY entity, accepted ORDER BY beat_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
lay AS (SELECT *, accepted AND coalesce(abs(duration_ms - m) / m > 0.10, false) AS local_artifact FROM med),
str AS (SELECT *, accepted AND NOT local_artifact AS strict FROM lay)"""
_CFG = DfaConfig(win_beats=120, step_beats=40, scale_max=16, local_rel=0.10)


def _layers(spark, sf_dir):
    b = B.jump_from_base(_timed(spark, sf_dir), K).withColumn("accepted", F.col("clean"))
    return B.local_artifacts(b, K, _CFG)


@query("w17_local_artifacts", f"WITH {_LAYER} SELECT entity, beat_idx, local_artifact, strict FROM str")
def w17(spark, sf_dir):
    return _layers(spark, sf_dir).select("entity", "beat_idx", "local_artifact", "strict")


@query("w18_longest_run", f"""WITH {_LAYER}, r AS (SELECT entity, beat_idx - row_number() OVER (PARTITION BY entity ORDER BY beat_idx) AS g FROM str WHERE strict), c AS (SELECT entity, g, count(*) AS n FROM r GROUP BY 1, 2)
SELECT entity, max(n) AS longest FROM c GROUP BY 1""")
def w18(spark, sf_dir):
    return islands.longest_run(_layers(spark, sf_dir), K, "beat_idx", F.col("strict"))


@query("w14_tumbling_rmssd", f"""WITH {_LAYER}, k AS (SELECT *, greatest(ceil(t_end / 60) - 1, 0)::BIGINT AS k FROM str),
p AS (SELECT *, CASE WHEN accepted THEN lag(duration_ms) OVER (PARTITION BY entity, k, accepted ORDER BY beat_idx) END AS q FROM k),
h AS (SELECT entity, k, count(*) AS beats, count(*) FILTER (accepted) AS core, count(*) FILTER (strict) AS strict, sqrt(avg((duration_ms - q) ** 2)) AS r FROM p GROUP BY 1, 2)
SELECT entity, k, beats, core, strict, round_even(core / beats, 6) AS valid_core, CASE WHEN core < 20 THEN 'insufficient_core_beats' WHEN core / beats < 0.8 THEN 'low_valid_fraction_core' ELSE 'ok' END AS reason,
  CASE WHEN core >= 20 AND core / beats >= 0.8 THEN round(r, 4) END AS rmssd FROM h""")
def w14(spark, sf_dir):
    w = B.tumbling_rmssd(_layers(spark, sf_dir), K, _CFG)
    return w.select("entity", "k", "beats", "core", "strict", "valid_core", "reason", F.round("rmssd", 4).alias("rmssd"))


_WINDOWS = f"""{_LAYER}, rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY beat_idx) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM str WHERE strict),
wi AS (SELECT entity, w AS win, r - w * 40 AS pos, duration_ms, beat_idx FROM rk, LATERAL (SELECT unnest(generate_series(0, ((n - 120) // 40)::BIGINT)) AS w WHERE n >= 120) x WHERE r BETWEEN w * 40 AND w * 40 + 119)"""


@query("w15_count_windows", f"WITH {_WINDOWS} SELECT entity, win, count(*) AS n, min(beat_idx) AS first, max(beat_idx) AS last FROM wi GROUP BY 1, 2")
def w15(spark, sf_dir):
    w = D.count_windows(_layers(spark, sf_dir).where("strict"), K, _CFG)
    return w.groupBy("entity", F.col("window").alias("win")).agg(F.count("*").alias("n"), F.min("beat_idx").alias("first"), F.max("beat_idx").alias("last"))


@query("w16_dfa_alpha1", f"""WITH {_WINDOWS}, c AS (SELECT entity, win, pos, duration_ms - avg(duration_ms) OVER (PARTITION BY entity, win) AS c FROM wi),
y AS (SELECT entity, win, pos, sum(c) OVER (PARTITION BY entity, win ORDER BY pos) AS y FROM c),
s AS (SELECT y.*, s, e, CASE WHEN e = 0 THEN pos ELSE 119 - pos END AS pl FROM y, generate_series(4, 16) g(s), (VALUES (0), (1)) v(e)),
b AS (SELECT entity, win, s, e, pl // s AS box, regr_syy(y, pl % s) AS yy, regr_sxy(y, pl % s) AS xy, regr_sxx(y, pl % s) AS xx FROM s WHERE pl // s < 120 // s GROUP BY ALL),
f AS (SELECT entity, win, s, sqrt(avg(greatest((yy - xy ** 2 / xx) / s, 0))) AS f FROM b GROUP BY ALL)
SELECT entity, win, round(regr_slope(ln(f), ln(s)), 5) AS alpha, count(*) AS n_scales FROM f WHERE f > 0 GROUP BY 1, 2""")
def w16(spark, sf_dir):
    w = D.count_windows(_layers(spark, sf_dir).where("strict"), K, _CFG)
    return rounded(D.alpha(w, K, "duration_ms", _CFG).withColumnRenamed("window", "win"), digits=5)


_S = ["entity", "session_id"]


@query("w19_threshold_islands", f"""WITH {SAMPLES}, o AS (SELECT *, hr >= 130 AND speed > 0.3 AS on_ FROM samples), r AS (SELECT entity, sec, sec - row_number() OVER (PARTITION BY entity ORDER BY sec) AS g FROM o WHERE on_)
SELECT entity, min(sec) AS first, max(sec) AS last, count(*) AS n, row_number() OVER (PARTITION BY entity ORDER BY min(sec)) AS run FROM r GROUP BY entity, g""")
def w19(spark, sf_dir):
    r = islands.runs(samples_of(spark, sf_dir), K, "sec", (F.col("hr") >= 130) & (F.col("speed") > 0.3))
    return r.select("entity", "first", "last", "n", F.col("run").cast("long").alias("run"))


def blocks_sql(vt1: float, drop: float) -> str:
    """mb: the merged blocks (entity, start, stop) of the samples sm (entity, sec, hr, moving)."""
    return f"""so AS (SELECT *, hr >= {vt1} AND moving AS o, CASE WHEN count(hr) OVER w = count(*) OVER w THEN sum(hr) OVER w / 10 END AS smooth, sum(hr) OVER (PARTITION BY entity ORDER BY sec) AS total FROM sm WINDOW w AS (PARTITION BY entity ORDER BY sec ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
sn AS (SELECT *, o AND NOT coalesce(lag(o) OVER (PARTITION BY entity ORDER BY sec), false) AS new FROM so), sb AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY entity ORDER BY sec) AS b FROM sn),
bk AS (SELECT entity, b::BIGINT AS b, min(sec) FILTER (o) AS s, max(sec) FILTER (o) AS e, count(*) FILTER (NOT o) AS gap, bool_and(hr < {vt1}) FILTER (NOT o) AS low, min(smooth) FILTER (NOT o) AS floor_, count(*) FILTER (NOT o AND smooth IS NULL) AS rough FROM sb WHERE b > 0 GROUP BY 1, 2),
bt AS (SELECT bk.*, coalesce(low, false) AND gap <= 60 AND rough = 0 AS ok, te.total AS he, tx.total AS hx, coalesce(ts.total, 0) AS hs FROM bk JOIN sb te ON te.entity = bk.entity AND te.sec = e LEFT JOIN sb tx ON tx.entity = bk.entity AND tx.sec = e - 30 LEFT JOIN sb ts ON ts.entity = bk.entity AND ts.sec = s - 1),
fb(entity, b, s, hs, e) AS (SELECT entity, b, s, hs, e FROM bt WHERE b = 1 UNION ALL
  SELECT n.entity, n.b, CASE WHEN j THEN f.s ELSE n.s END, CASE WHEN j THEN f.hs ELSE n.hs END, n.e FROM fb f JOIN bt p ON p.entity = f.entity AND p.b = f.b JOIN bt n ON n.entity = f.entity AND n.b = f.b + 1,
  LATERAL (SELECT coalesce(p.ok AND (CASE WHEN f.s > p.e - 30 THEN (p.he - f.hs) / (p.e - f.s + 1) ELSE (p.he - p.hx) / 30 END) - p.floor_ <= {drop}, false) AS j) x),
mb AS (SELECT entity, s AS start, max(e) AS stop FROM fb GROUP BY 1, 2)"""


@query("w20_merged_blocks", f"WITH RECURSIVE {SAMPLES}, sm AS (SELECT entity, sec, hr, speed > 0.3 AS moving FROM samples), {blocks_sql(130.0, 60.0)} SELECT entity, 's1' AS session_id, start, stop FROM mb")
def w20(spark, sf_dir):
    s = samples_of(spark, sf_dir).withColumn("moving", F.col("speed") > 0.3).withColumn("vt1", F.lit(130.0))
    return islands.work_blocks(s, _S, SessionConfig(hr_drop_max=60.0))


@query("w21_box_smoothing", f"""WITH {SAMPLES} SELECT entity, sec, round(sum(hr) OVER (PARTITION BY entity ORDER BY sec ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth FROM samples""")
def w21(spark, sf_dir):
    return rounded(islands.box_mean(samples_of(spark, sf_dir), ["entity"], "sec", "hr", 10), "entity", "sec", "smooth")


@query("w22_adjacent_merge", f"""WITH {SAMPLES}, r AS (SELECT entity, sec, sec - row_number() OVER (PARTITION BY entity ORDER BY sec) AS g FROM samples WHERE hr >= 130),
s AS (SELECT entity, min(sec) AS start, max(sec) AS stop FROM r GROUP BY entity, g),
b AS (SELECT *, CASE WHEN start - lag(stop) OVER (PARTITION BY entity ORDER BY start) <= 3 THEN 0 ELSE 1 END AS br FROM s), k AS (SELECT *, sum(br) OVER (PARTITION BY entity ORDER BY start) AS block FROM b)
SELECT entity, block::BIGINT AS block, min(start) AS start, max(stop) AS stop, count(*) AS n FROM k GROUP BY 1, 2""")
def w22(spark, sf_dir):
    r = islands.runs(samples_of(spark, sf_dir), K, "sec", F.col("hr") >= 130).select("entity", F.col("first").alias("start"), F.col("last").alias("stop"))
    return islands.merge_adjacent(r, K, 3)


@query("w35_w36_sampling_rate", """WITH s AS (SELECT user_id AS entity, epoch_us(ts) / 1e6 AS t, min(event_id) AS id FROM events GROUP BY 1, 2), g AS (SELECT entity, t - lag(t) OVER (PARTITION BY entity ORDER BY t) AS d FROM s)
SELECT entity, round(1 / median(d), 9) AS fs FROM g WHERE d > 0 GROUP BY 1""")
def w35(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("entity"), F.lit("r").alias("rec"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id")
    return rounded(sensors.sampling_rate(sensors.increasing(e, "event_id")).select("entity", "fs"), digits=9)


@query("a19_zone_shares", f"""WITH {SAMPLES}, m AS (SELECT *, speed > 0.3 AS mv, count(*) FILTER (speed > 0.3) OVER (PARTITION BY entity) AS nm, count(*) OVER (PARTITION BY entity) AS n FROM samples)
SELECT entity, round_even(quantile_cont(hr, 0.95), 1) AS hr_p95, round_even(100.0 * count(*) FILTER (hr <= 130) / count(*), 1) AS z1_pct, round_even(100.0 * count(*) FILTER (hr > 130 AND hr <= 160) / count(*), 1) AS z2_pct,
  round_even(100.0 * count(*) FILTER (hr > 160) / count(*), 1) AS z3_pct FROM m WHERE n >= 60 AND (mv OR nm < 60) GROUP BY 1""")
def a19(spark, sf_dir):
    s = samples_of(spark, sf_dir).withColumn("moving", F.col("speed") > 0.3).withColumn("vt1", F.lit(130.0)).withColumn("vt2", F.lit(160.0))
    return sessions.zones(s).select("entity", "hr_p95", "z1_pct", "z2_pct", "z3_pct")


@query("a21_a22_half_split", f"""WITH {SAMPLES}, v AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM samples WHERE sec >= 100 AND speed > 0.5 AND hr > 60)
SELECT entity, round_even(100 * ((avg(hr) FILTER (i >= n // 2) / avg(speed) FILTER (i >= n // 2)) - (avg(hr) FILTER (i < n // 2) / avg(speed) FILTER (i < n // 2))) / (avg(hr) FILTER (i < n // 2) / avg(speed) FILTER (i < n // 2)), 1) AS cardiac_drift_pct
FROM v GROUP BY entity HAVING count(*) >= 120""")
def a22(spark, sf_dir):
    s = samples_of(spark, sf_dir).withColumn("duration_s", F.lit(3600.0))
    return sessions.drift(s, SessionConfig(skip_s=100)).select("entity", "cardiac_drift_pct")


@query("a31_a32_rate_bins", f"""WITH {SAMPLES} SELECT entity, floor(hr / 3) * 3 AS bin, count(*) AS n, round(median(speed), 6) AS level, round(corr(hr, speed), 6) AS r, round(regr_slope(speed, hr), 6) AS slope FROM samples GROUP BY 1, 2 HAVING count(*) >= 3 AND var_pop(hr) > 0 AND var_pop(speed) > 0""")
def a31(spark, sf_dir):
    b = samples_of(spark, sf_dir).groupBy("entity", (F.floor(F.col("hr") / 3) * 3).cast("double").alias("bin")).agg(F.count("*").alias("n"), F.percentile("speed", 0.5).alias("level"), F.try_divide(F.covar_pop("hr", "speed"), F.stddev_pop("hr") * F.stddev_pop("speed")).alias("r"), F.regr_slope("speed", "hr").alias("slope"), F.var_pop("hr").alias("_a"), F.var_pop("speed").alias("_b"))
    return rounded(b.where("n >= 3 AND _a > 0 AND _b > 0").drop("_a", "_b"))


@query("w38_w39_crossings", f"""WITH {SAMPLES}, b AS (SELECT entity, floor(hr / 3) * 3 AS x, avg(speed) AS y FROM samples GROUP BY 1, 2), l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM b WINDOW w AS (PARTITION BY entity ORDER BY x)),
h AS (SELECT *, abs(y - 2) + abs(y2 - 2) AS score, x + (x2 - x) * (2 - y) / (y2 - y) AS pt FROM l WHERE (y - 2) * (y2 - 2) <= 0 AND y <> y2),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score, x) AS i, count(*) OVER (PARTITION BY entity) AS n, median(pt) OVER (PARTITION BY entity) AS m FROM h)
SELECT entity, round(pt, 4) AS rate_at_target, round(m, 4) AS median_crossing, n AS n_crossings FROM r WHERE i = 1""")
def w38(spark, sf_dir):
    b = samples_of(spark, sf_dir).groupBy("entity", (F.floor(F.col("hr") / 3) * 3).cast("double").alias("x")).agg(F.avg("speed").alias("y"))
    return rounded(D.crossing(b, K, "x", "y", 2.0), digits=4)


@query("x7_pauses", f"""WITH {SAMPLES}, r AS (SELECT entity, sec - row_number() OVER (PARTITION BY entity ORDER BY sec) AS g FROM samples WHERE speed < 0.6), c AS (SELECT entity, g, count(*) AS n FROM r GROUP BY 1, 2)
SELECT e.entity, count(n) AS n_pauses, coalesce(sum(n), 0)::BIGINT AS total_s, coalesce(max(n), 0) AS longest_s FROM (SELECT DISTINCT entity FROM samples) e LEFT JOIN (SELECT * FROM c WHERE n >= 2) c USING (entity) GROUP BY 1""")
def x7(spark, sf_dir):
    return weekly.pauses(samples_of(spark, sf_dir), K, "speed", 0.6, 2)


@query("x9_splits", f"""WITH {SAMPLES}, d AS (SELECT *, coalesce(sum(speed) OVER (PARTITION BY entity ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM samples)
SELECT entity, (floor(before / 100) + 1)::BIGINT AS split, count(*) AS seconds, count(*) FILTER (speed >= 0.5) AS moving_s, round(sum(speed), 6) AS distance_m, round(avg(hr), 6) AS hr_mean FROM d GROUP BY 1, 2""")
def x9(spark, sf_dir):
    return rounded(weekly.splits(samples_of(spark, sf_dir), K, "speed", "hr", 0.5, 100.0))


@query("x10_continuity", f"""WITH {SAMPLES}, z AS (SELECT entity, sec, CASE WHEN hr <= 130 THEN 'z1' WHEN hr <= 160 THEN 'z2' ELSE 'z3' END AS zone FROM samples), l AS (SELECT *, CASE WHEN zone = lag(zone) OVER (PARTITION BY entity ORDER BY sec) THEN 0 ELSE 1 END AS n FROM z),
g AS (SELECT *, sum(n) OVER (PARTITION BY entity ORDER BY sec) AS g FROM l), r AS (SELECT entity, zone, g, count(*) AS n FROM g GROUP BY ALL)
SELECT entity, zone, count(*) AS n_runs, max(n) AS longest_s, median(n) AS median_s, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS in_2s, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS in_3s, coalesce(sum(n) FILTER (n >= 5), 0)::BIGINT AS in_5s FROM r GROUP BY 1, 2""")
def x10(spark, sf_dir):
    zone = F.when(F.col("hr") <= 130, "z1").when(F.col("hr") <= 160, "z2").otherwise("z3")
    return weekly.continuity(samples_of(spark, sf_dir), K, zone, (2, 3, 5))


@query("x8_climb", f"""WITH RECURSIVE {SAMPLES}, h AS (SELECT entity, median(z::DOUBLE) OVER (PARTITION BY entity ORDER BY sec ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS h, row_number() OVER (PARTITION BY entity ORDER BY sec) AS i FROM samples),
f(entity, i, held, up, down) AS (SELECT entity, i, h, 0.0::DOUBLE, 0.0::DOUBLE FROM h WHERE i = 1 UNION ALL
  SELECT h.entity, h.i, CASE WHEN abs(h - held) >= 0.5 THEN h ELSE held END, up + CASE WHEN h - held >= 0.5 THEN h - held ELSE 0 END, down + CASE WHEN held - h >= 0.5 THEN held - h ELSE 0 END FROM f JOIN h ON h.entity = f.entity AND h.i = f.i + 1)
SELECT entity, round(arg_max(up, i), 6) AS gain_m, round(arg_max(down, i), 6) AS loss_m FROM f GROUP BY 1""")
def x8(spark, sf_dir):
    return rounded(weekly.climb(samples_of(spark, sf_dir), K, "z"))


@query("w32_motion_windows", f"""WITH {SAMPLES}, s AS (SELECT entity, session_id AS rec, sec AS t, (hr - avg(hr) OVER w) ** 2 + (speed - avg(speed) OVER w) ** 2 + (z - avg(z) OVER w) ** 2 AS e FROM samples WINDOW w AS (PARTITION BY entity ORDER BY sec ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
r AS (SELECT entity, rec, t - o AS k, sqrt(avg(e)) AS rms FROM s, generate_series(0, 4) g(o) GROUP BY ALL), b AS (SELECT entity, median(rms) + 3 * 1.4826 * mad(rms) AS bound FROM r GROUP BY 1)
SELECT entity, rec, k, k::DOUBLE AS start, (k + 5)::DOUBLE AS stop, round(rms, 6) AS rms, rms > bound AS high FROM r JOIN b USING (entity)""")
def w32(spark, sf_dir):
    s = samples_of(spark, sf_dir).select("entity", F.col("session_id").alias("rec"), F.col("sec").cast("double").alias("t"), "hr", "speed", F.col("z").cast("double").alias("z"))
    return rounded(sensors.motion(s, "hr", "speed", "z"))


@query("w34_dominant_frequency", f"""WITH {SAMPLES}, e AS (SELECT entity, session_id AS rec, (sec // 10) - o AS k, sec / 2.0 AS t, a.axis, CASE a.axis WHEN 'hr' THEN hr ELSE speed END AS x FROM samples, generate_series(0, 5) g(o), (VALUES ('hr'), ('speed')) a(axis)),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY entity, k, axis) AS c FROM e), f AS (SELECT round(0.08 + i * 0.02, 6) AS f FROM generate_series(0, 26) g(i)),
p AS (SELECT entity, rec, k, axis, f, sum(c * cos(2 * pi() * f * t)) ** 2 + sum(c * sin(2 * pi() * f * t)) ** 2 AS p FROM c, f GROUP BY ALL), b AS (SELECT *, sum(p) OVER w AS band, median(p) OVER w AS mid FROM p WINDOW w AS (PARTITION BY entity, k, axis)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, k ORDER BY band DESC, axis, p DESC, f) AS r FROM b)
SELECT entity, rec, k, axis, f::DOUBLE AS frequency, round(60 * f::DOUBLE, 6) AS per_minute, round(CASE WHEN mid > 0 THEN p / mid END, 3) AS confidence FROM r WHERE r = 1""")
def w34(spark, sf_dir):
    s = samples_of(spark, sf_dir).select("entity", F.col("session_id").alias("rec"), (F.col("sec") / 2).alias("t"), "hr", "speed")  # two a second, so the band is below half of that
    got = sensors.dominant_frequency(s, ["hr", "speed"])
    return rounded(got.withColumn("confidence", F.round("confidence", 3)))


@query("w33_w37_peaks_to_beats", f"""WITH {SAMPLES}, d AS (SELECT entity, session_id AS rec, sec::DOUBLE AS t, hr - avg(hr) OVER (PARTITION BY entity ORDER BY sec ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS d FROM samples),
e AS (SELECT entity, rec, t, avg(d * d) OVER (PARTITION BY entity ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM d), m AS (SELECT entity, median(e) AS m, mad(e) AS s FROM e GROUP BY 1),
n AS (SELECT *, lag(e) OVER w AS a, lead(e) OVER w AS b FROM e WINDOW w AS (PARTITION BY entity ORDER BY t)), top AS (SELECT n.* FROM n JOIN m USING (entity) WHERE e > a AND e >= b AND e > m + 0.5 * 1.4826 * s),
g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY entity ORDER BY t) < 3 THEN 0 ELSE 1 END AS new FROM top), k AS (SELECT *, sum(new) OVER (PARTITION BY entity ORDER BY t) AS g FROM g),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, g ORDER BY e DESC, t) AS r FROM k) WHERE r = 1), c AS (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM best),
p AS (SELECT entity, rec, t, lag(t) OVER w AS p, row_number() OVER w - 1 AS beat_idx FROM c WHERE n >= 5 WINDOW w AS (PARTITION BY entity ORDER BY t))
SELECT entity, rec, beat_idx, round((t + p) / 2, 6) AS center, t AS t_end, round(1000 * (t - p), 6) AS duration_ms FROM p WHERE p IS NOT NULL""")
def w33(spark, sf_dir):
    s = samples_of(spark, sf_dir).select("entity", F.col("session_id").alias("rec"), F.col("sec").cast("double").alias("t"), "hr")
    return rounded(sensors.intervals(sensors.peaks(s, "hr", half=1, mult=0.5, apart_s=3.0, least=5)))
