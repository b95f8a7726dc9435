"""Whole plans over the given tables: the contract results a user asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AuditConfig, BeatConfig, DfaConfig, GateConfig, LevelConfig, SessionConfig
from ..plans import analysis, final, sessions, sleep
from ..plans import audit as A
from ..plans import core as C
from .beats import ACCEPTED, blocks_sql
from .registry import BEATS, DAILY, SAMPLES, SESSIONS, beats_of, core_contract, query, rounded, samples_of, sessions_of, table


def measurements_of(spark, sf_dir):
    return C.measurements(beats_of(spark, sf_dir))


def _parts_sql(rescue: bool = False) -> str:
    """Recordings with latency, steady and last part, and the statistics of both."""
    latency = "CAST(NULL AS DOUBLE)" if rescue else """(SELECT 30.0 * coalesce(min(n.k) FILTER (n.k >= 1 AND n.k <= n_win - 2 AND abs(x - xp) / xp < 0.08 AND abs(xn - x) / x < 0.08),
  min(n.k) FILTER (n.k <= n_win - 3 AND abs(x - goal) / goal < 0.08 AND abs(xn - goal) / goal < 0.08 AND abs(x2 - goal) / goal < 0.08)) FROM nb n JOIN gl USING (entity) WHERE n.entity = m.entity)"""
    return f"""{BEATS},
n AS (SELECT entity, any_value(day) AS day, count(*) AS n_total, max(t_end) AS dur_raw, count(*) FILTER (offline) AS n_off, count(*) FILTER (out_of_range) AS n_oor, count(*) FILTER (base) AS n_base, count(*) FILTER (jump) AS n_jump,
  count(*) FILTER (base AND NOT jump) AS n_clean FROM filtered GROUP BY 1),
m AS (SELECT *, dur_raw - 15 AS end_eff, 100.0 * (n_off + n_oor + n_jump) / n_total AS artifact_pct, CASE WHEN dur_raw > 15 THEN floor((dur_raw - 15) / 30) + 1 ELSE 1 END AS n_win FROM n),
eff AS (SELECT f.entity, f.beat_idx, f.duration_ms, f.t_end FROM filtered f JOIN m USING (entity) WHERE base AND NOT jump AND t_end <= end_eff),
wv AS (SELECT entity, beat_idx, duration_ms, floor(t_end / 30)::BIGINT - o AS k FROM eff, (VALUES (0), (1)) v(o)),
wp AS (SELECT *, lag(duration_ms) OVER (PARTITION BY entity, k ORDER BY beat_idx) AS q2 FROM wv WHERE k >= 0),
w AS (SELECT wp.entity, k, any_value(n_win) AS n_win, CASE WHEN count(q2) >= 20 THEN sqrt(avg((duration_ms - q2) ** 2)) END AS x FROM wp JOIN m USING (entity) WHERE k < n_win GROUP BY 1, 2),
nb AS (SELECT w.*, a.x AS xp, b.x AS xn, c.x AS x2 FROM w LEFT JOIN w a ON a.entity = w.entity AND a.k = w.k - 1 LEFT JOIN w b ON b.entity = w.entity AND b.k = w.k + 1 LEFT JOIN w c ON c.entity = w.entity AND c.k = w.k + 2),
gl AS (SELECT entity, CASE WHEN count(x) >= 4 THEN list_aggregate(list_slice(list(x ORDER BY k) FILTER (x IS NOT NULL), -4, -1), 'median') END AS goal FROM w GROUP BY 1),
l AS (SELECT m.*, {latency} AS latency FROM m), r AS (SELECT *, greatest(coalesce(latency, 45), 45) AS t_start FROM l),
st AS (SELECT e.*, t_start, lag(duration_ms) OVER (PARTITION BY e.entity ORDER BY beat_idx) AS q FROM eff e JOIN r USING (entity) WHERE e.t_end >= t_start),
s AS (SELECT entity, count(*) AS n_steady, avg(duration_ms) / 1000 AS rr, sqrt(avg((duration_ms - q) ** 2)) AS rmssd, max(t_end) AS steady_end, min(duration_ms) AS lo, max(duration_ms) AS hi, stddev_pop(duration_ms - q) / sqrt(2) AS sd1, var_pop(duration_ms) AS v FROM st GROUP BY 1),
tl AS (SELECT e.*, lag(duration_ms) OVER (PARTITION BY e.entity ORDER BY beat_idx) AS q FROM eff e JOIN r USING (entity) WHERE e.t_end >= end_eff - 120),
t AS (SELECT entity, count(*) AS n_tail, max(t_end) - min(t_end) AS dur_tail, sqrt(avg((duration_ms - q) ** 2)) AS rmssd2, CASE WHEN count(*) > 1 THEN stddev_pop(duration_ms) / avg(duration_ms) END AS cv FROM tl GROUP BY 1),
bn AS (SELECT entity, least(floor((duration_ms - lo) / 50), ceil((hi - lo) / 50) - 1) AS b, count(*) AS c FROM st JOIN s USING (entity) WHERE hi > lo GROUP BY 1, 2),
tp AS (SELECT entity, b, c FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c DESC, b) AS i FROM bn) WHERE i = 1),
sd AS (SELECT s.*, sqrt(greatest(2 * v - sd1 ** 2, 0)) AS sd2 FROM s),
u AS (SELECT r.*, n_steady, rr, rmssd, steady_end, coalesce(n_tail, 0) AS n_tail, coalesce(dur_tail, 0) AS dur_tail, rmssd2, cv, 60 / rr AS hr, abs(rmssd2 - rmssd) / rmssd AS mismatch, sd1, sd2,
  100.0 * c / n_steady / (2 * (lo + (b + 0.5) * 50) / 1000 * (hi - lo) / 1000) AS si FROM r LEFT JOIN sd USING (entity) LEFT JOIN t USING (entity) LEFT JOIN tp USING (entity))"""


def _measurements_sql(rescue: bool = False) -> str:
    mode = "'RESCUE_MODE'" if rescue else "CAST(NULL AS VARCHAR)"
    return f"""WITH {_parts_sql(rescue)},
k AS (SELECT *, CASE WHEN dur_tail < 75 OR n_tail - 1 < 60 THEN 'STAB_TAIL_SHORT' WHEN cv > 0.2 THEN 'STAB_CV120_HIGH' WHEN rmssd2 IS NULL THEN 'STAB_LAST2_NAN' WHEN mismatch > 0.15 THEN 'STAB_LAST2_MISMATCH' ELSE 'OK' END AS kind FROM u)
SELECT entity, day AS "Fecha", CASE WHEN artifact_pct > 20 OR coalesce(hr < 35 OR hr > 100, false) THEN 'INVALID' WHEN latency IS NOT NULL AND artifact_pct <= 15 AND greatest(latency, 60) BETWEEN 60 AND 600 AND kind = 'OK' THEN 'OK' ELSE 'FLAG_mecánico' END AS "Calidad",
  CASE WHEN kind = 'OK' THEN 'OK' ELSE 'Unstable' END AS "HRV_Stability", kind AS "Stability_Subtype", round(artifact_pct, 6) AS "Artifact_pct", latency AS "Tiempo_Estabilizacion", round(hr, 6) AS "HR_stable", round(rr, 6) AS "RRbar_s", round(rmssd, 6) AS "RMSSD_stable",
  round(rmssd2, 6) AS "RMSSD_stable_last2", round(100 * mismatch, 6) AS "tail_mismatch_pct", round(ln(rmssd), 6) AS "lnRMSSD",
  concat_ws('|', {mode}, CASE WHEN latency IS NULL THEN 'LAT_NAN' END, CASE WHEN artifact_pct > 15 THEN 'ART_GT15' END, CASE WHEN artifact_pct > 20 THEN 'ART_GT20' END, CASE WHEN kind <> 'OK' THEN kind END) AS "Flags",
  CASE WHEN n_steady >= 20 THEN round_even(si, 1) END AS "SI_baevsky", CASE WHEN n_steady >= 10 THEN round_even(sd1, 2) END AS "SD1", CASE WHEN n_steady >= 10 THEN round_even(sd2, 2) END AS "SD2", CASE WHEN n_steady >= 10 AND sd2 > 0 THEN round_even(sd1 / sd2, 3) END AS "SD1_SD2_ratio",
  printf('src=%s; dur_raw=%.1fs; dur_eff=%.1fs; t_start_eff=%.1fs; dur_tramo=%.1fs; dur_tail=%.1fs; n_total=%d; n_base=%d; n_clean=%d; n_tramo=%d; n_tail=%d; off=%d; oor=%d; dRR=%d; lat_mode=%s; stab=%s',
    entity::VARCHAR || '_' || day::VARCHAR, dur_raw, end_eff, t_start, coalesce(steady_end - t_start, 0.0), dur_tail::DOUBLE, n_total, n_base, n_clean, coalesce(n_steady, 0), n_tail, n_off, n_oor, n_jump, CASE WHEN latency IS NULL THEN 'NAN' ELSE 'NUM' END, CASE WHEN kind = 'OK' THEN 'OK' ELSE 'Unstable' END) AS "Notes" FROM k"""


@query("c1_measurements", _measurements_sql())
def c1(spark, sf_dir):
    return rounded(measurements_of(spark, sf_dir))


@query("c2_rescue_measurements", _measurements_sql(True))
def c2(spark, sf_dir):
    return rounded(C.measurements(beats_of(spark, sf_dir), rescue=True))


@query("c4_ans_balance", f"""WITH {_parts_sql()} SELECT entity, day, CASE WHEN n_steady >= 20 THEN round_even(si, 1) END AS si, CASE WHEN n_steady >= 20 THEN round_even(sd1, 2) END AS sd1, CASE WHEN n_steady >= 20 THEN round_even(sd2, 2) END AS sd2,
  CASE WHEN n_steady >= 20 AND sd2 > 0 THEN round_even(sd1 / sd2, 3) END AS ratio FROM u WHERE n_steady > 0""")
def c4(spark, sf_dir):
    return rounded(C.balance(beats_of(spark, sf_dir)))


def _z(x: str, m: str, s: str) -> str:
    return f"CASE WHEN {s} <> 0 THEN greatest(least(({x} - {m}) / (1.4826 * {s}), 5), -5) END"


def _raised(z: str) -> str:
    level = f"CASE WHEN {z} IS NULL THEN 'Indef' WHEN {z} >= -1 THEN 'Verde' WHEN {z} >= -2 THEN 'Ámbar' ELSE 'Rojo' END"
    return f"CASE WHEN NOT ok THEN 'Indef' WHEN hz >= 3.8 THEN 'Rojo' WHEN hz >= 3.0 AND {z} >= -1 THEN 'Ámbar' ELSE {level} END"


_DAYS = lambda n: f"(PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL {n} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"


@query("c3_w7_w8_audit", f"""WITH RECURSIVE {DAILY}, c AS (SELECT entity, day, quality <> 'INVALID' AS ok, hr, 60 / hr AS rr, rmssd, ln_x, ln(60 / hr) AS lx, row_number() OVER (PARTITION BY entity ORDER BY day) AS i FROM core),
p AS (SELECT a.entity, a.day, b.rr, b.lx, b.ln_x AS ly FROM c a JOIN c b ON b.entity = a.entity AND b.ok AND b.day >= a.day - 90 AND b.day < a.day),
q AS (SELECT entity, day, count(*) AS n90, quantile_cont(rr, 0.75) - quantile_cont(rr, 0.25) AS iqr, median(rr) AS ref, quantile_cont(lx, 0.1) AS x1, quantile_cont(lx, 0.9) AS x9, quantile_cont(ly, 0.1) AS y1, quantile_cont(ly, 0.9) AS y9 FROM p GROUP BY 1, 2),
h AS (SELECT p.entity, p.day, greatest(least(lx, x9), x1) AS x, greatest(least(ly, y9), y1) AS y FROM p JOIN q USING (entity, day) WHERE n90 >= 60 AND iqr >= 0.03), fit AS (SELECT entity, day, regr_slope(y, x) AS b, regr_r2(y, x) AS r2 FROM h GROUP BY 1, 2),
s AS (SELECT c.*, ref, coalesce(n90 >= 60 AND iqr >= 0.03, false) AS can, b, r2 FROM c LEFT JOIN q USING (entity, day) LEFT JOIN fit USING (entity, day)),
f(entity, i, used, mode) AS (SELECT DISTINCT entity, 0::BIGINT, CAST(NULL AS DOUBLE), '' FROM c UNION ALL
  SELECT s.entity, s.i, CASE WHEN k THEN f.used ELSE greatest(least(b, 3.0), 0.1) END, CASE WHEN k AND f.used IS NOT NULL THEN 'frozen' WHEN k THEN 'none' WHEN b > 3.0 OR b < 0.1 THEN 'clipped' ELSE 'active' END
  FROM f JOIN s ON s.entity = f.entity AND s.i = f.i + 1, LATERAL (SELECT NOT can OR b IS NULL OR r2 IS NULL OR r2 < 0.0 OR coalesce(abs(b - f.used) > 5.0, false) AS k) x),
a AS (SELECT s.*, f.used, f.mode, CASE WHEN f.used IS NOT NULL AND ref > 0 AND rr > 0 THEN rmssd * pow(rr / ref, -f.used) ELSE rmssd END AS cr FROM s JOIN f ON f.entity = s.entity AND f.i = s.i),
w AS (SELECT *, median(hr) FILTER (ok) OVER d14 AS m14, mad(hr) FILTER (ok) OVER d14 AS s14, quantile_cont(cr, 0.15) FILTER (ok) OVER d30 AS p15, quantile_cont(cr, 0.30) FILTER (ok) OVER d30 AS p30, count(cr) FILTER (ok) OVER d30 AS n30,
  median(ln_x) FILTER (ok) OVER d28 AS ml, mad(ln_x) FILTER (ok) OVER d28 AS sl, median(ln(cr)) FILTER (ok) OVER d28 AS mc, mad(ln(cr)) FILTER (ok) OVER d28 AS sc FROM a WINDOW d14 AS {_DAYS(14)}, d30 AS {_DAYS(30)}, d28 AS {_DAYS(28)}),
z AS (SELECT *, round_even({_z('hr', 'm14', 's14')}, 2) AS hz, {_z('ln_x', 'ml', 'sl')} AS zl, {_z('ln(cr)', 'mc', 'sc')} AS zc FROM w)
SELECT entity, day AS "Fecha", hr AS "HR_stable", round(rr, 6) AS "RRbar_s", round(rmssd, 6) AS "RMSSD_stable", round(ln_x, 6) AS "lnRMSSD", round(cr, 6) AS "cRMSSD", mode AS beta_mode, round(b, 6) AS beta_est_90d, round(used, 6) AS beta_use_90d, round(r2, 6) AS "R2_winsor_90d",
  {_raised('zl')} AS "Color_Agudo_Diario", {_raised('zc')} AS "Color_Tiebreak",
  CASE WHEN NOT ok THEN 'Indef' WHEN n30 < 15 THEN 'Indef' WHEN cr >= p30 AND NOT coalesce(p30 > p15 AND cr - p30 < 0.1 * (p30 - p15) AND hz >= 3.0, false) THEN 'Verde' WHEN cr >= p15 THEN 'Ámbar' ELSE 'Rojo' END AS "Color_Tendencia" FROM z""")
def c3(spark, sf_dir):
    return rounded(A.audit(core_contract(spark, sf_dir), AuditConfig(min_r2=0.0, max_jump=5.0)))


@query("c5_decisions")
def c5(spark, sf_dir):
    return rounded(final.final(core_contract(spark, sf_dir), cfg=GateConfig(decision_mode="O3_OVERRIDE_PERSIST_2of3", healthy_start="1996-01-01", healthy_end="1996-12-31")))


@query("c5_dashboard")
def dashboard(spark, sf_dir):
    return rounded(final.dashboard(final.final(core_contract(spark, sf_dir))))


def activities_of(spark, sf_dir):
    """Eight users' events as one recorded activity, with samples for it."""
    s = samples_of(spark, sf_dir).withColumn("session_id", F.concat(F.lit("a"), F.col("entity").cast("string")))
    a = s.groupBy("entity", "session_id").agg(F.count("*").alias("n"), F.avg("hr").alias("m"), F.max("hr").alias("x"), F.sum("speed").alias("d"))
    act = a.select(
        "entity", F.col("session_id").alias("id"), F.element_at(F.array(*map(F.lit, ("TrailRun", "Ride", "WeightTraining"))), (F.col("entity") % 3 + 1).cast("int")).alias("type"),
        F.concat(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("entity") % 28).cast("int")).cast("string"), F.lit("T08:00:00")).alias("start_date_local"), F.col("n").cast("double").alias("elapsed_time"), F.col("n").cast("double").alias("moving_time"),
        F.col("d").alias("distance"), (F.col("n") / 2).alias("total_elevation_gain"), (F.col("n") / 3).alias("total_elevation_loss"), F.col("m").alias("average_heartrate"), F.col("x").alias("max_heartrate"), (F.col("m") / 2).alias("icu_training_load"),
        (F.col("entity") % 10).cast("double").alias("icu_rpe"), F.lit(3.0).alias("feel"), F.array(F.lit(120.0), F.lit(150.0)).alias("icu_hr_zones"), F.array(F.col("n") / 3, F.col("n") / 3, F.col("n") / 3).alias("icu_hr_zone_times"),
        F.array(F.struct(F.lit("TEXT").alias("type"), F.concat(F.lit("note "), F.col("session_id")).alias("content"))).alias("messages"))
    return act, s


_SESSIONS_SQL = f"""{SAMPLES}, ac AS (SELECT entity, count(*) AS n, avg(hr) AS m, max(hr) AS x, sum(speed) AS d, entity % 3 < 2 AS aero FROM samples GROUP BY 1),
sm AS (SELECT samples.*, n, speed > 0.3 AS moving FROM samples JOIN ac USING (entity) WHERE aero AND n > 60), mo AS (SELECT entity, count(*) FILTER (moving) AS mv FROM sm GROUP BY 1),
zo AS (SELECT entity, count(*) AS t, quantile_cont(hr, 0.95) AS p95, count(*) FILTER (hr <= 120) AS a, count(*) FILTER (hr > 120 AND hr <= 150) AS b, count(*) FILTER (hr > 150) AS c FROM sm JOIN mo USING (entity) WHERE moving OR mv < 60 GROUP BY 1),
{blocks_sql(120.0, 10.0)},
we AS (SELECT mb.entity, start, stop - start + 1 AS d, count(*) FILTER (hr > 150) AS z FROM mb JOIN sm ON sm.entity = mb.entity AND sec BETWEEN start AND stop WHERE stop - start + 1 >= 180 GROUP BY ALL),
wm AS (SELECT *, round_even(d / 60, 1) AS mi, round_even(100.0 * z / d, 0)::BIGINT AS pc FROM we),
wo AS (SELECT entity, string_agg(mi::VARCHAR, ';' ORDER BY start) AS bm, string_agg(pc::VARCHAR, ';' ORDER BY start) AS bz, count(*) AS nb, round_even(sum(mi), 1) AS wt, max(mi) AS wl, round_even(100.0 * sum(z)::DOUBLE / sum(d)::DOUBLE, 0) AS wz FROM wm GROUP BY 1),
lc AS (SELECT *, count(*) FILTER (moving) OVER (PARTITION BY entity) AS mv FROM sm WHERE sec >= CASE WHEN n >= 3600 THEN 600 ELSE 0 END),
lr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY entity) AS k FROM lc WHERE (moving OR mv <= 120) AND n >= 2400),
la AS (SELECT entity, avg(hr) FILTER (i >= k // 2) - avg(hr) FILTER (i < k // 2) AS rise FROM lr WHERE k >= 120 GROUP BY 1),
dr AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY entity) AS k FROM sm WHERE sec >= 600 AND speed > 0.5 AND hr > 60 AND n >= 1800),
dh AS (SELECT entity, avg(hr) FILTER (i < k // 2) AS h0, avg(hr) FILTER (i >= k // 2) AS h1, avg(speed) FILTER (i < k // 2) AS s0, avg(speed) FILTER (i >= k // 2) AS s1 FROM dr WHERE k >= 120 GROUP BY 1),
ju AS (SELECT ac.*, zo.*, wo.*, rise, CASE WHEN zo.entity IS NOT NULL THEN coalesce(rise >= 8, false)::INTEGER END AS late, CASE WHEN s0 >= 0.5 AND s1 >= 0.5 THEN round_even(100 * (h1 / s1 - h0 / s0) / (h0 / s0), 1) END AS drift, round_even(ac.d / 1000, 2) AS km, ac.entity AS ent,
  coalesce(wt, 0) AS wt0, coalesce(wz, 0) AS wz0 FROM ac LEFT JOIN zo ON zo.entity = ac.entity LEFT JOIN wo ON wo.entity = ac.entity LEFT JOIN la ON la.entity = ac.entity LEFT JOIN dh ON dh.entity = ac.entity),
se AS (SELECT ent AS entity, 'a' || ent AS session_id, DATE '2024-01-01' + (ent % 28)::INTEGER AS "Fecha", '08:00' AS start_time, ['trail_run','bike','strength'][(ent % 3 + 1)::INTEGER] AS sport, ['TrailRun','Ride','WeightTraining'][(ent % 3 + 1)::INTEGER] AS sport_raw, 'intervals' AS source,
  120.0 AS vt1_used, 150.0 AS vt2_used, 'icu' AS zones_source, round_even(n / 60, 1) AS duration_min, round_even(n / 60, 1) AS moving_min, km AS distance_km, n / 2 AS elev_gain_m, round(n / 3, 6) AS elev_loss_m, CASE WHEN km > 0.5 THEN round_even(n / 2 / km, 1) END AS elev_density,
  round(m, 6) AS hr_mean, round(x, 6) AS hr_max, round_even(p95, 1) AS hr_p95, CASE WHEN t IS NULL THEN 33.3 ELSE round_even(100.0 * a / t, 1) END AS z1_pct, CASE WHEN t IS NULL THEN 33.3 ELSE round_even(100.0 * b / t, 1) END AS z2_pct, CASE WHEN t IS NULL THEN 33.3 ELSE round_even(100.0 * c / t, 1) END AS z3_pct,
  CASE WHEN t IS NULL THEN round_even(n / 3 / 60, 1) ELSE round_even(b / 60, 1) END AS z2_total_min, CASE WHEN t IS NULL THEN round_even(n / 3 / 60, 1) ELSE round_even(c / 60, 1) END AS z3_total_min, coalesce(bm, '') AS work_blocks_min, coalesce(bz, '') AS work_blocks_z3pct, coalesce(nb, 0) AS work_n_blocks,
  wt0 AS work_total_min, coalesce(wl, 0) AS work_longest_min, wz0 AS work_avg_z3_pct, late AS late_intensity, drift AS cardiac_drift_pct,
  CASE WHEN NOT aero THEN 'NA' WHEN wt0 >= 10 AND wz0 >= 15 THEN 'work_intense' WHEN wt0 >= 20 THEN 'work_steady' WHEN wt0 >= 5 THEN 'work_moderate' WHEN late = 1 THEN 'finish_strong' ELSE 'easy' END AS intensity_category,
  round(m / 2, 6) AS load, CASE WHEN ent % 10 > 0 THEN (ent % 10)::DOUBLE END AS rpe, 3.0 AS feel, (ent % 10 > 0)::INTEGER AS rpe_present, 1 AS notes_present, 'note a' || ent AS notes_raw, CASE WHEN aero AND n > 60 THEN 1.0 END AS stream_dt_est, '1' AS pipeline_version, 'unknown' AS effort_vs_recent, 'unknown' AS effort_vs_anchor FROM ju)"""


@query("c6_sessions", f"""WITH RECURSIVE {_SESSIONS_SQL} SELECT *, CASE WHEN sport = 'strength' THEN 'strength_unknown' WHEN intensity_category = 'work_intense' THEN 'endurance_hard' WHEN intensity_category IN ('work_steady', 'work_moderate') THEN 'endurance_moderate' ELSE 'endurance_easy' END AS session_group FROM se""")
def c6(spark, sf_dir):
    return rounded(sessions.build(*activities_of(spark, sf_dir)))


@query("c7_session_days", f"""WITH RECURSIVE {_SESSIONS_SQL}, da AS (SELECT *, sport <> 'strength' AS ae FROM se)
SELECT entity, "Fecha", 1::BIGINT AS n_sessions, duration_min AS total_duration_min, ae::INTEGER AS has_aerobic, (NOT ae)::INTEGER AS has_strength, 0 AS has_mobility, round_even(load, 1) AS load_day, intensity_category AS intensity_cat_day, CASE WHEN ae THEN work_total_min END AS work_total_min_day,
  CASE WHEN ae THEN work_n_blocks END AS work_n_blocks_day, CASE WHEN ae THEN z3_total_min END AS z3_min_day, CASE WHEN ae THEN hr_max END AS hr_max_day, CASE WHEN ae THEN hr_p95 END AS hr_p95_max_day, CASE WHEN ae THEN coalesce(late_intensity = 1, false)::INTEGER END AS late_intensity_day,
  CASE WHEN ae THEN cardiac_drift_pct END AS cardiac_drift_worst, round_even(elev_gain_m, 0) AS elev_gain_day, round_even(elev_loss_m, 0) AS elev_loss_day, CASE WHEN ae THEN 0.0 ELSE duration_min END AS strength_min_day, 0.0 AS mobility_min_day, CASE WHEN ae THEN rpe END AS rpe_max_day,
  0 AS effort_above_typical_aerobic, 0 AS effort_above_typical_strength, 0 AS effort_above_anchor_aerobic, rpe_present::BIGINT AS n_with_rpe, 1::BIGINT AS n_with_notes, CASE WHEN ae AND distance_km > 0 THEN elev_density END AS elev_density_day,
  CAST(NULL AS DOUBLE) AS z3_7d_sum, 0 AS z3_7d_nobs, CAST(NULL AS DOUBLE) AS work_7d_sum, 0 AS work_7d_nobs, CAST(NULL AS DOUBLE) AS finish_strong_7d_count, CAST(NULL AS DOUBLE) AS load_3d, 0 AS load_3d_nobs, CAST(NULL AS DOUBLE) AS load_7d, 0 AS load_7d_nobs,
  CAST(NULL AS DOUBLE) AS load_14d, 0 AS load_14d_nobs, CAST(NULL AS DOUBLE) AS load_28d, 0 AS load_28d_nobs, CAST(NULL AS DOUBLE) AS elev_loss_7d_sum FROM da""")
def c7(spark, sf_dir):
    return rounded(sessions.days(sessions.build(*activities_of(spark, sf_dir))))


# four ways in which a document tells interruptions: counts, a list, counts under other names, and counts anywhere below
@query("c9_sleep", """WITH e AS (SELECT user_id AS entity, ts::DATE AS "Fecha", sum(value) AS v, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, v * 60 AS d, user_id_kind AS kind FROM (SELECT *, (entity + n) % 4 AS user_id_kind FROM e)),
r AS (SELECT entity, "Fecha", CASE WHEN d <= 0 THEN NULL WHEN d <= 1440 THEN d WHEN d <= 172800 THEN d / 60 WHEN d <= 172800000 THEN d / 60000 ELSE d END AS dur,
  (CASE kind WHEN 1 THEN (n >= 2)::INTEGER + (n % 3 = 0)::INTEGER ELSE n END)::DOUBLE AS i, (CASE kind WHEN 1 THEN 3 WHEN 3 THEN n + 2 ELSE n + 1 END)::DOUBLE AS t, (n % 5 / 10.0) * 100 AS eff, v / 10 AS night FROM m),
p AS (SELECT entity, quantile_cont(dur, 0.1) AS p10, quantile_cont(dur, 0.9) AS p90, quantile_cont(i, 0.9) AS ip FROM r GROUP BY 1)
SELECT entity, "Fecha", round(dur, 6) AS polar_sleep_duration_min, CAST(NULL AS DOUBLE) AS polar_sleep_span_min, CAST(NULL AS DOUBLE) AS polar_deep_pct, CAST(NULL AS DOUBLE) AS polar_rem_pct, round(eff, 6) AS polar_efficiency_pct, CAST(NULL AS DOUBLE) AS polar_continuity, CAST(NULL AS DOUBLE) AS polar_continuity_index,
  i AS polar_interruptions_long, t AS polar_interruptions_total, CAST(NULL AS DOUBLE) AS polar_sleep_score, round(night, 6) AS polar_night_rmssd, round(60000.0 / 52, 6) AS polar_night_rri, CAST(NULL AS DOUBLE) AS polar_night_resp,
  round(p10, 6) AS sleep_dur_p10, round(p90, 6) AS sleep_dur_p90, round(ip, 6) AS sleep_int_p90 FROM r JOIN p USING (entity)""")
def c9(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    d = e.groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("Fecha")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    n, kind = F.col("n"), (F.col("entity") + F.col("n")) % 4
    own = [(F.col("v") * 60).alias("sleep-duration"), (n % 5 / 10).alias("efficiency")]
    item = lambda name, value: F.create_map(F.lit(name), value.cast("string"))
    items = F.array(item("type", F.when(n >= 2, "LONG pause").otherwise("short")), item("interruption_duration", F.when(n % 3 == 0, "PT5M30S").otherwise("PT4M")), item("kind", F.lit("short")))
    doc = (
        F.when(kind == 0, F.to_json(F.struct(*own, F.struct(F.struct(n.alias("longCount"), (n + 1).alias("totalCount")).alias("interruptions")).alias("evaluation"))))
        .when(kind == 1, F.to_json(F.struct(*own, F.struct(items.alias("interruptions")).alias("evaluation"))))
        .when(kind == 2, F.to_json(F.struct(*own, F.struct(F.struct(n.alias("long-count"), (n + 1).alias("count")).alias("sleep_interruptions")).alias("sleep-evaluation"))))
        .otherwise(F.to_json(F.struct(*own, F.struct(F.array(F.struct(n.cast("string").alias("Sleep-Long-Interruptions"), F.lit("many").alias("interruptions_count"), (n + 2).alias("Number_of_interruptions"))).alias("parts")).alias("night")))))
    night = F.to_json(F.struct((F.col("v") / 10).alias("heart_rate_variability_avg"), F.lit(52).alias("heart-rate-avg")))
    raw = d.select("entity", "Fecha", doc.alias("sleep_json"), night.alias("nightly_json"))
    return rounded(sleep.with_percentiles(sleep.fields(raw)))


_EFFORT = SessionConfig(anchor_start="1995-01-01", anchor_end="1996-12-31")
_DFA = DfaConfig(win_beats=120, step_beats=40, local_rel=0.10)


_DFA_SQL = f"""{BEATS}, {ACCEPTED}, {SAMPLES},
acc AS (SELECT b.entity, b.beat_idx, b.duration_ms, b.t_end, f.reason = '' AS accepted FROM filtered b JOIN f ON f.entity = b.entity AND f.beat_idx = b.beat_idx),
med AS (SELECT *, CASE WHEN count(duration_ms) OVER w >= 3 THEN median(duration_ms) OVER w END AS m FROM acc WINDOW w AS (PARTITION BY entity, accepted ORDER BY beat_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
lay AS (SELECT *, accepted AND coalesce(abs(duration_ms - m) / m > {_DFA.local_rel}, false) AS bad, row_number() OVER (PARTITION BY entity ORDER BY beat_idx) AS rank FROM med),
gr AS (SELECT *, accepted AND NOT bad AS strict, sum((NOT bad)::INTEGER) OVER (PARTITION BY entity ORDER BY beat_idx) AS g FROM lay),
ru AS (SELECT *, sum(bad::INTEGER) OVER (PARTITION BY entity, g ORDER BY beat_idx) AS run FROM gr),
rk AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY beat_idx) - 1 AS r, count(*) OVER (PARTITION BY entity) AS n FROM ru WHERE strict),
wi AS (SELECT entity, x.w AS win, r - x.w * {_DFA.step_beats} AS pos, duration_ms, t_end, rank FROM rk, LATERAL (SELECT unnest(generate_series(0, ((n - {_DFA.win_beats}) // {_DFA.step_beats})::BIGINT)) AS w WHERE n >= {_DFA.win_beats}) x WHERE r BETWEEN x.w * {_DFA.step_beats} AND x.w * {_DFA.step_beats} + {_DFA.win_beats - 1}),
sp AS (SELECT entity, win, min(t_end - duration_ms / 1000) AS s, max(t_end) AS e, min(rank) AS a, max(rank) AS z, count(*) AS beats FROM wi GROUP BY 1, 2),
ct AS (SELECT sp.entity, win, count(*) FILTER (accepted) AS core, count(*) FILTER (strict) AS strict, coalesce(max(least(run, rank - a + 1)) FILTER (bad), 0) AS longest FROM sp JOIN ru ON ru.entity = sp.entity AND ru.rank BETWEEN a AND z GROUP BY 1, 2),
ce AS (SELECT entity, win, pos, duration_ms - avg(duration_ms) OVER (PARTITION BY entity, win) AS c FROM wi), yy AS (SELECT entity, win, pos, sum(c) OVER (PARTITION BY entity, win ORDER BY pos) AS y FROM ce),
sc AS (SELECT yy.*, gs.s, v.e, CASE WHEN v.e = 0 THEN pos ELSE {_DFA.win_beats - 1} - pos END AS pl FROM yy, generate_series({_DFA.scale_min}, {_DFA.scale_max}) gs(s), (VALUES (0), (1)) v(e) WHERE {_DFA.win_beats} // gs.s >= 4),
bx AS (SELECT entity, win, s, e, pl // s AS box, regr_syy(y, pl % s) AS yy, regr_sxy(y, pl % s) AS xy, regr_sxx(y, pl % s) AS xx FROM sc WHERE pl // s < {_DFA.win_beats} // s GROUP BY ALL),
fl AS (SELECT entity, win, s, sqrt(avg(greatest((yy - xy ** 2 / xx) / s, 0))) AS f FROM bx GROUP BY ALL),
al AS (SELECT entity, win, CASE WHEN count(*) >= 5 THEN regr_slope(ln(f), ln(s)) END AS alpha FROM fl WHERE f > 0 AND {_DFA.win_beats} >= {_DFA.scale_max * 4} GROUP BY 1, 2),
va AS (SELECT sp.*, round_even(core / (z - a + 1), 6) AS valid_core, round_even(strict / (z - a + 1), 6) AS valid_strict, longest, al.alpha AS a0 FROM sp JOIN ct USING (entity, win) LEFT JOIN al USING (entity, win)),
re AS (SELECT *, CASE WHEN valid_core < {_DFA.min_core} THEN 'low_valid_fraction_core' WHEN valid_strict < {_DFA.min_strict} THEN 'low_valid_fraction_strict' WHEN longest > {_DFA.max_run} THEN 'artifact_run_too_long' WHEN a0 IS NULL THEN 'alpha1_nan' ELSE 'ok' END AS reason, round_even((s + e) / 2, 3) AS mid FROM va),
dw AS (SELECT re.entity, 's1' AS session_id, win AS "window", round_even(s, 3) AS start_sec, round_even(e, 3) AS end_sec, mid AS center_sec, beats, valid_core, valid_strict, longest::BIGINT AS artifact_run_max, CASE WHEN reason = 'ok' THEN round_even(a0, 6) END AS alpha, reason = 'ok' AS usable, reason,
  CASE WHEN lo.sec = hi.sec THEN lo.hr ELSE lo.hr + (hi.hr - lo.hr) * (mid - lo.sec) END AS hr FROM re LEFT JOIN samples lo ON lo.entity = re.entity AND lo.sec = floor(mid)::BIGINT LEFT JOIN samples hi ON hi.entity = re.entity AND hi.sec = ceil(mid)::BIGINT)"""


@query("c10_dfa_windows", f"WITH RECURSIVE {_DFA_SQL} SELECT * REPLACE (round(alpha, 6) AS alpha, round(hr, 6) AS hr) FROM dw")
def c10(spark, sf_dir):
    b = beats_of(spark, sf_dir).withColumnRenamed("day", "d").withColumn("session_id", F.lit("s1")).drop("d")
    return rounded(analysis.dfa_windows(analysis.layers(b, BeatConfig(), _DFA), samples_of(spark, sf_dir).select("entity", "session_id", "sec", "hr"), _DFA))


_LEVEL = LevelConfig(min_windows=8, min_r2=0.02, min_bins=2, min_per_bin=1, min_span=0.05, near=0.2, min_near=2, min_side=1)


def _bad_beat(entity: str, at: str) -> str:
    """Every fifth recording lacks the duration of one beat, an offline one or not."""
    return f"({entity} % 5 = 4 AND {at} = 40)"


# the beats of the analysis: those whose duration is missing are left out of the axis
_BEATS_TOLD = BEATS.replace("FROM events WHERE value IS NOT NULL),\ntimed", f"FROM events WHERE value IS NOT NULL),\nbroken AS (SELECT * FROM beats WHERE {_bad_beat('entity', 'beat_idx')}),\ntimed", 1)
_TOLD_SQL = _DFA_SQL.replace(BEATS, _BEATS_TOLD, 1)


@query("c10_session_analysis", f"""WITH RECURSIVE {_TOLD_SQL}, st AS (SELECT entity, max(t_end) / 60 AS mins, avg(strict::INTEGER) AS share FROM gr GROUP BY 1),
tk AS (SELECT *, greatest(ceil(t_end / 60) - 1, 0) AS k FROM acc), tw AS (SELECT entity, k, count(*) AS n, count(*) FILTER (accepted) AS c FROM tk GROUP BY 1, 2), ro AS (SELECT entity, bool_or(c >= 20 AND c / n >= 0.8) AS ok FROM tw GROUP BY 1),
tr AS (SELECT dw.* REPLACE (CASE WHEN dw.entity IN (SELECT entity FROM broken) THEN NULL ELSE hr END AS hr) FROM dw), cv AS (SELECT entity, avg((hr IS NOT NULL)::INTEGER) AS cover FROM dw GROUP BY 1),
su AS (SELECT entity, count(*) AS n, count(alpha) FILTER (usable) AS nu, median(alpha) FILTER (usable) AS med, median(alpha) FILTER (usable AND hr <= 120) AS z1, median(alpha) FILTER (usable AND hr > 120 AND hr <= 150) AS z2, median(alpha) FILTER (usable AND hr >= 150) AS z3 FROM tr GROUP BY 1),
se AS (SELECT entity, count(*) / 60.0 AS dur FROM samples GROUP BY 1), jo AS (SELECT se.entity, dur, mins, share, ok, n, nu, med, cover, z1, z2, z3, abs(mins - dur) AS gap, se.entity NOT IN (SELECT entity FROM broken) AS axis_ok FROM se LEFT JOIN st USING (entity) LEFT JOIN ro USING (entity) LEFT JOIN su USING (entity) LEFT JOIN cv USING (entity)),
ga AS (SELECT *, CASE WHEN NOT coalesce(nu >= 10, false) THEN 'DFA_NO_INTERPRETABLE' WHEN share >= 0.9 AND (NOT coalesce(cover > 0, false) OR cover >= 0.8) THEN CASE WHEN axis_ok THEN 'DFA_OK' ELSE 'DFA_LIMITED' END WHEN share >= 0.75 THEN 'DFA_LIMITED' ELSE 'DFA_NO_INTERPRETABLE' END AS gate,
  CASE WHEN NOT coalesce(mins > 0 AND dur IS NOT NULL, false) THEN 'UNKNOWN' WHEN gap > greatest(8.0, dur * 0.12) THEN 'MISMATCH' WHEN gap > greatest(3.0, dur * 0.05) THEN 'WARN' ELSE 'OK' END AS ds FROM jo),
u AS (SELECT entity, hr, alpha FROM tr WHERE usable AND alpha IS NOT NULL AND hr IS NOT NULL),
ag AS (SELECT entity, count(*) AS un, corr(hr, alpha) AS r, regr_slope(alpha, hr) AS sl, count(*) FILTER (alpha BETWEEN 0.55 AND 0.95) AS near, count(*) FILTER (alpha < 0.75) AS below, count(*) FILTER (alpha > 0.75) AS above FROM u GROUP BY 1),
bi AS (SELECT entity, median(hr) AS x, median(alpha) AS y FROM u GROUP BY entity, floor(hr / 3)), bl AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM bi WINDOW w AS (PARTITION BY entity ORDER BY x)),
bg AS (SELECT entity, count(*) AS nb, max(y) - min(y) AS span, count(*) FILTER (y2 < y) AS falls FROM bl GROUP BY 1), hi AS (SELECT *, abs(y - 0.75) + abs(y2 - 0.75) AS s, x + (0.75 - y) * (x2 - x) / (y2 - y) AS pt FROM bl WHERE (y - 0.75) * (y2 - 0.75) <= 0 AND y <> y2),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY s, x) AS i FROM hi) WHERE i = 1), cr AS (SELECT entity, median(pt) AS pt, count(*) AS nc FROM hi GROUP BY 1),
le AS (SELECT ga.*, be.pt AS rate, cr.pt AS crs, nc, r, CASE WHEN gate <> 'DFA_OK' THEN 'dfa_gate_' || lower(gate) WHEN coalesce(un, 0) < 8 THEN 'too_few_dfa_windows_with_hr' WHEN r IS NULL OR isnan(r) THEN 'non_finite_hr_alpha1_correlation' WHEN sl >= 0 THEN 'alpha1_does_not_decrease_with_hr'
    WHEN r * r < 0.02 THEN 'weak_raw_hr_alpha1_relation_r2_' || printf('%.2f', r * r) WHEN nb < 2 THEN 'too_few_hr_bins' WHEN span < 0.05 THEN 'alpha1_too_flat_across_hr' WHEN falls < greatest(1, nb - 2) THEN 'binned_alpha1_not_monotonic_enough' WHEN be.pt IS NULL THEN 'no_local_alpha1_075_bracketing_bins'
    WHEN near < 2 THEN 'too_few_raw_windows_near_075' ELSE 'ok' END AS why, CASE WHEN gate <> 'DFA_OK' OR coalesce(un, 0) < 8 OR below < 1 OR above < 1 OR cr.pt IS NULL THEN NULL WHEN nc = 1 THEN 'approximate' ELSE 'low' END AS conf
  FROM ga LEFT JOIN ag USING (entity) LEFT JOIN bg USING (entity) LEFT JOIN be USING (entity) LEFT JOIN cr USING (entity)),
mo AS (SELECT *, CASE WHEN gate <> 'DFA_OK' THEN CASE WHEN coalesce(ok, false) THEN 'soften' ELSE 'unavailable' END WHEN ds = 'MISMATCH' OR coalesce(z3 >= z2, false) THEN 'question' WHEN why = 'ok' AND ds <> 'WARN' THEN 'confirm' ELSE 'soften' END AS modifier FROM le)
SELECT entity, 's1' AS session_id, n, nu AS n_usable, round(med, 6) AS alpha_median, round(z1, 6) AS alpha_z1, round(z2, 6) AS alpha_z2, round(z3, 6) AS alpha_z3, axis_ok, gate, ds AS duration_state,
  CASE WHEN why = 'ok' THEN round(rate, 4) END AS hr_at_level, why AS level_reason, CASE WHEN conf IS NOT NULL THEN round(crs, 4) END AS hr_at_crossing, conf AS crossing_confidence, modifier,
  array_to_string(list_filter(CASE WHEN gate <> 'DFA_OK' THEN ['dfa_gate = ' || gate, CASE WHEN coalesce(ok, false) THEN 'rmssd_1min usable' ELSE 'rmssd_1min no usable' END]
    ELSE ['dfa_gate = DFA_OK', CASE WHEN why = 'ok' THEN 'HR@0.75 usable' WHEN conf IS NOT NULL THEN 'HR@0.75 no usable (strict): ' || why ELSE 'HR@0.75 no usable: ' || why END, CASE WHEN why <> 'ok' AND conf IS NOT NULL THEN printf('HR@0.75 crossing approx: %.1f lpm (confidence=%s)', crs, conf) END,
      CASE WHEN z2 IS NOT NULL THEN printf('alpha1_med_z2_hr = %.3f', z2) END, CASE WHEN z3 IS NOT NULL THEN printf('alpha1_med_z3_hr = %.3f', z3) END, CASE WHEN z3 >= z2 THEN 'gradiente alpha1 por zonas no coherente' END,
      CASE ds WHEN 'WARN' THEN 'coherencia temporal RR-sesion en advertencia: diff ' || round_even(gap, 3) || ' min' WHEN 'MISMATCH' THEN 'coherencia temporal RR-sesion no valida: diff ' || round_even(gap, 3) || ' min' END] END, lambda x: x IS NOT NULL), ' / ') AS evidence,
  'Sessions sugiere `cardio' || CASE modifier WHEN 'confirm' THEN '` y RR lo confirma' WHEN 'soften' THEN '`; RR anade contexto pero con prudencia' WHEN 'question' THEN '`, pero RR cuestiona la lectura fina' ELSE '`; RR no fue interpretable' END AS note FROM mo""")
def c10_whole(spark, sf_dir):
    b = beats_of(spark, sf_dir).withColumn("session_id", F.lit("s1")).drop("day")
    # a beat without a duration, as an input may have it, behind one that is there
    broken = b.where(_bad_beat("entity", "beat_idx")).withColumns({"beat_idx": F.col("beat_idx") + 10**9, "duration_ms": F.lit(None).cast("double")})
    s = samples_of(spark, sf_dir)
    whole = s.groupBy("entity", "session_id").agg((F.count("*") / 60).alias("duration_min"), F.lit("cardio").alias("dominant"))
    got = analysis.analyse(b.unionByName(broken), s.select("entity", "session_id", "sec", "hr"), whole, BeatConfig(), _DFA, 120, 150, level=_LEVEL)
    got = got.withColumns({"evidence": F.array_join("evidence", " / "), "hr_at_level": F.round("hr_at_level", 4), "hr_at_crossing": F.round("hr_at_crossing", 4)})
    return rounded(got.drop("gate_reason"))


@query("x11_time_windows", f"""WITH RECURSIVE {BEATS}, {ACCEPTED}, acc AS (SELECT b.entity, b.beat_idx, b.duration_ms, b.t_end, f.reason = '' AS ok FROM filtered b JOIN f ON f.entity = b.entity AND f.beat_idx = b.beat_idx),
e AS (SELECT entity, beat_idx, duration_ms, ok, ceil(t_end / 5)::BIGINT - 1 - o AS win FROM acc, generate_series(0, 23) g(o) WHERE ceil(t_end / 5)::BIGINT - 1 - o >= 0),
n AS (SELECT *, count(*) OVER (PARTITION BY entity, win) AS n, count(*) FILTER (ok) OVER (PARTITION BY entity, win) AS k FROM e), h AS (SELECT entity, win, max(k) AS beats, round_even(max(k) / max(n), 6) AS valid FROM n WHERE ok GROUP BY 1, 2),
p AS (SELECT entity, win, k, duration_ms, row_number() OVER (PARTITION BY entity, win ORDER BY beat_idx) - 1 AS pos FROM n WHERE ok AND k >= 100 AND k >= 0.7 * n),
c AS (SELECT *, duration_ms - avg(duration_ms) OVER (PARTITION BY entity, win) AS c FROM p), y AS (SELECT entity, win, k, pos, sum(c) OVER (PARTITION BY entity, win ORDER BY pos) AS y FROM c),
s AS (SELECT y.*, gs.s, v.e, CASE WHEN v.e = 0 THEN pos ELSE k - 1 - pos END AS pl FROM y, generate_series(4, 16) gs(s), (VALUES (0), (1)) v(e) WHERE k >= 64 AND k // gs.s >= 4),
b AS (SELECT entity, win, s, e, pl // s AS box, regr_syy(y, pl % s) AS yy, regr_sxy(y, pl % s) AS xy, regr_sxx(y, pl % s) AS xx FROM s WHERE pl // s < k // s GROUP BY ALL), fl AS (SELECT entity, win, s, sqrt(avg(greatest((yy - xy ** 2 / xx) / s, 0))) AS f FROM b GROUP BY ALL),
al AS (SELECT entity, win, CASE WHEN count(*) >= 5 THEN regr_slope(ln(f), ln(s)) END AS a FROM fl WHERE f > 0 GROUP BY 1, 2)
SELECT entity, 's1' AS session_id, win AS "window", beats, valid, round(a, 3) AS alpha, (win * 5)::DOUBLE AS start_sec FROM h LEFT JOIN al USING (entity, win)""")
def x11(spark, sf_dir):
    b = beats_of(spark, sf_dir).withColumn("session_id", F.lit("s1")).drop("day")
    got = analysis.time_windows(analysis.layers(b, BeatConfig(), _DFA), min_beats=100, min_valid=0.7, cfg=_DFA)
    return got.select("entity", "session_id", "window", "beats", "valid", F.round("alpha", 3).alias("alpha"), "start_sec")


@query("a33_alpha_by_zone", f"""WITH RECURSIVE {_DFA_SQL}, d AS (SELECT * REPLACE (round(hr, 6) AS hr) FROM dw)
SELECT entity, session_id, round(median(alpha) FILTER (usable AND hr <= 120), 6) AS alpha_z1, round(median(alpha) FILTER (usable AND hr > 120 AND hr <= 150), 6) AS alpha_z2, round(median(alpha) FILTER (usable AND hr >= 150), 6) AS alpha_z3 FROM d GROUP BY 1, 2""")
def a33(spark, sf_dir):
    return rounded(analysis.alpha_by_zone(c10(spark, sf_dir), 120, 150))


@query("a34_blocks", f"""WITH RECURSIVE {_DFA_SQL}, s AS (SELECT entity, session_id, sec // 120 AS block, avg(hr) AS hr_mean, avg(speed * 3.6) FILTER (speed > 0.5 / 3.6) AS speed_kmh, count(*) AS n_samples FROM samples GROUP BY 1, 2, 3),
w AS (SELECT entity, session_id, floor(center_sec / 120)::BIGINT AS block, median(alpha) FILTER (usable) AS m, avg(alpha) FILTER (usable) AS a, 100.0 * avg((alpha < 0.75)::INTEGER) FILTER (usable AND alpha IS NOT NULL) AS pct FROM dw GROUP BY 1, 2, 3)
SELECT entity, session_id, block, round(hr_mean, 6) AS hr_mean, round(speed_kmh, 6) AS speed_kmh, n_samples, round(m, 6) AS alpha_median, round(a, 6) AS alpha_mean, round(pct, 6) AS pct_lt_075 FROM s FULL JOIN w USING (entity, session_id, block)""")
def a34(spark, sf_dir):
    return rounded(analysis.blocks(c10(spark, sf_dir), samples_of(spark, sf_dir), 120))


@query("c8_effort_classes", f"""WITH {SESSIONS}, a AS (SELECT *, row_number() OVER (PARTITION BY entity, grp, day ORDER BY start_time, session_id) AS i FROM sessions),
h AS (SELECT s.entity, s.session_id, count(p.session_id) AS n, bool_and(p.load IS NOT NULL) AS whole, quantile_cont(p.load, 0.25) AS q1, quantile_cont(p.load, 0.75) AS q3 FROM a s LEFT JOIN a p ON p.entity = s.entity AND p.grp = s.grp AND p.day >= s.day - {_EFFORT.effort_days} AND (p.day < s.day OR p.day = s.day AND p.i < s.i) GROUP BY 1, 2),
b AS (SELECT entity, grp, quantile_cont(load, 0.25) AS b1, quantile_cont(load, 0.75) AS b3 FROM sessions WHERE day BETWEEN DATE '{_EFFORT.anchor_start}' AND DATE '{_EFFORT.anchor_end}' AND load IS NOT NULL GROUP BY 1, 2 HAVING count(load) >= {_EFFORT.effort_min_prev})
SELECT s.entity, s.session_id, CASE WHEN n < {_EFFORT.effort_min_prev} OR load IS NULL THEN 'unknown' WHEN whole AND load > q3 THEN 'above' WHEN whole AND load < q1 THEN 'below' ELSE 'typical' END AS effort_vs_recent,
  CASE WHEN b1 IS NULL OR load IS NULL THEN 'unknown' WHEN load > b3 THEN 'above' WHEN load < b1 THEN 'below' ELSE 'typical' END AS effort_vs_anchor FROM sessions s JOIN h ON h.session_id = s.session_id LEFT JOIN b ON b.entity = s.entity AND b.grp = s.grp""")
def c8(spark, sf_dir):
    s = sessions_of(spark, sf_dir).withColumnRenamed("grp", "session_group").withColumnRenamed("day", "Fecha")
    return sessions.effort(s, _EFFORT).select("entity", "session_id", "effort_vs_recent", "effort_vs_anchor")
