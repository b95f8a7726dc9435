"""Windows over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, stats
from ..operators import windows as W
from ..plans.audit import trend_colour
from .registry import DAILY, SESSIONS, core, daily, query, rounded, sessions_of

E = ["entity"]


def _base(days: int, x: str, name: str) -> str:
    w = f"OVER (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    return f"median({x}) FILTER (clean) {w} AS base_{name}, 0.5 * 1.4826 * mad({x}) FILTER (clean) {w} AS swc_{name}, count({x}) FILTER (clean) {w} AS n_{name}"


@query("daily_gate", f"""WITH {DAILY},
b AS (SELECT *, {_base(60, 'ln_x', 'ln')}, {_base(60, 'hr', 'hr')} FROM core)
SELECT entity, day, round(base_ln, 6) AS base, round(swc_ln, 6) AS swc, n_ln AS n,
  CASE WHEN n_ln < 30 OR swc_ln IS NULL OR swc_hr IS NULL OR swc_ln = 0 OR swc_hr = 0 THEN 'NO'
    WHEN ln_x - base_ln < -swc_ln AND hr - base_hr > swc_hr THEN 'ROJO' WHEN ln_x - base_ln < -swc_ln OR hr - base_hr > swc_hr THEN 'ÁMBAR' ELSE 'VERDE' END AS gate,
  CASE WHEN n_ln < 30 THEN 'BASE60_INSUF' WHEN swc_ln IS NULL OR swc_hr IS NULL OR swc_ln = 0 OR swc_hr = 0 THEN 'SWC_NAN/0'
    WHEN ln_x - base_ln < -swc_ln AND hr - base_hr > swc_hr THEN '2D_AMBOS' WHEN ln_x - base_ln < -swc_ln THEN '2D_LN' WHEN hr - base_hr > swc_hr THEN '2D_HR' ELSE '2D_OK' END AS reason
FROM b""")
def daily_gate(spark, sf_dir):
    d = core(spark, sf_dir)
    d = W.rolling_baseline(d, E, "day", "ln_x", 60, F.col("clean")).withColumnsRenamed({"base": "b", "swc": "s", "n": "m"})
    d = W.rolling_baseline(d, E, "day", "hr", 60, F.col("clean"))
    g = rules.gate("ln_x", "hr", "b", "base", "s", "swc", "SWC_NAN/0")
    short = F.struct(F.lit("NO").alias("gate"), F.lit("BASE60_INSUF").alias("reason"))
    d = d.withColumn("_g", F.when(F.col("m") < 30, short).otherwise(g))
    return rounded(d.select("entity", "day", F.col("b").alias("base"), F.col("s").alias("swc"), F.col("m").alias("n"), "_g.gate", "_g.reason"))


for _days in (42, 28):

    @query(f"w26_shadow_baseline_{_days}", f"WITH {DAILY}, b AS (SELECT *, {_base(_days, 'ln_x', 'ln')} FROM core) SELECT entity, day, round(base_ln, 6) AS base, round(swc_ln, 6) AS swc, n_ln AS n FROM b")
    def _shadow(spark, sf_dir, days=_days):
        return rounded(W.rolling_baseline(core(spark, sf_dir), E, "day", "ln_x", days, F.col("clean")), "entity", "day", "base", "swc", "n")


@query("w1_last_valid_mean", f"""WITH {DAILY},
v AS (SELECT entity, day, avg(ln_x) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m, least(row_number() OVER (PARTITION BY entity ORDER BY day), 3) AS k FROM core WHERE clean)
SELECT c.entity, c.day, round(v.m, 6) AS used, coalesce(v.k, 0)::INTEGER AS n FROM core c ASOF LEFT JOIN v ON c.entity = v.entity AND c.day >= v.day""")
def w1(spark, sf_dir):
    d = W.last_valid_mean(core(spark, sf_dir), E, "day", ["ln_x"], F.col("clean"), 3)
    return rounded(d.select("entity", "day", F.col("ln_x_roll").alias("used"), F.col("n_roll").alias("n")))


@query("w5_rolling_residual", f"""WITH {DAILY},
f AS (SELECT *, regr_slope(ln_x, ln(60 / hr)) FILTER (clean) OVER w AS b, regr_intercept(ln_x, ln(60 / hr)) FILTER (clean) OVER w AS a, count(*) FILTER (clean) OVER w AS n,
  list(struct_pack(x := ln(60 / hr), y := ln_x)) FILTER (clean) OVER w AS p
  FROM core WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 60 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
r AS (SELECT entity, day, CASE WHEN n >= 30 THEN ln_x - (a + b * ln(60 / hr)) END AS residual,
  CASE WHEN n >= 30 THEN 0.5 * 1.4826 * list_aggregate(list_transform(p, lambda q: q.y - (a + b * q.x)), 'mad') END AS s FROM f)
SELECT entity, day, round(residual, 6) AS residual, round(CASE WHEN s <> 0 THEN residual / s END, 4) AS residual_z FROM r""")
def w5(spark, sf_dir):
    d = core(spark, sf_dir).withColumn("lnrr", F.log(60 / F.col("hr")))
    d = W.rolling_residual(d, E, "day", "lnrr", "ln_x", 60, 30, F.col("clean"))
    return d.select("entity", "day", F.round("residual", 6).alias("residual"), F.round("residual_z", 4).alias("residual_z"))


@query("w6_rows_median", f"""WITH {DAILY} SELECT entity, day, round(CASE WHEN count(rmssd) OVER w >= 3 THEN median(rmssd) OVER w END, 6) AS med FROM core
WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def w6(spark, sf_dir):
    return rounded(W.rolling_rows_median(core(spark, sf_dir), E, ["day"], "rmssd", 6), "entity", "day", "med")


@query("w10_trend_colour", f"""WITH {DAILY}, q AS (SELECT *, quantile_cont(rmssd, 0.15) FILTER (quality <> 'INVALID') OVER w AS p15, quantile_cont(rmssd, 0.30) FILTER (quality <> 'INVALID') OVER w AS p30,
  count(*) FILTER (quality <> 'INVALID') OVER w AS n FROM core WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT entity, day, CASE WHEN n < 15 THEN 'Indef' WHEN rmssd >= p30 AND NOT (p30 > p15 AND rmssd - p30 < 0.1 * (p30 - p15) AND (hr - 55) / 2 >= 3) THEN 'Verde' WHEN rmssd >= p15 THEN 'Ámbar' ELSE 'Rojo' END AS colour FROM q""")
def w10(spark, sf_dir):
    w = W.day_frame(E, "day", 30)
    v = F.when(F.col("quality") != "INVALID", F.col("rmssd"))
    d = core(spark, sf_dir).withColumn("_q", F.percentile(v, F.array(F.lit(0.15), F.lit(0.30))).over(w)).withColumn("_n", F.count(v).over(w))
    return d.select("entity", "day", trend_colour(F.col("rmssd"), F.col("_n"), F.col("_q")[0], F.col("_q")[1], (F.col("hr") - 55) / 2).alias("colour"))


@query("w11_robust_z", f"""WITH {DAILY}, q AS (SELECT *, median(ln_x) FILTER (quality <> 'INVALID') OVER w AS m, 1.4826 * mad(ln_x) FILTER (quality <> 'INVALID') OVER w AS s
  FROM core WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT entity, day, round(CASE WHEN s <> 0 THEN greatest(least((ln_x - m) / s, 5), -5) END, 6) AS z FROM q""")
def w11(spark, sf_dir):
    v = F.when(F.col("quality") != "INVALID", F.col("ln_x"))
    d = core(spark, sf_dir).withColumn("_v", F.collect_list(v).over(W.day_frame(E, "day", 28)))
    return rounded(d.select("entity", "day", stats.robust_z("ln_x", F.col("_v")).alias("z")))


@query("w27_acute_veto", f"""WITH {DAILY}, b AS (SELECT *, {_base(60, 'ln_x', 'ln')} FROM core)
SELECT entity, day, coalesce(clean AND ln_x < base_ln - 2 * greatest(swc_ln, 0.04879), false) AS veto FROM b""")
def w27(spark, sf_dir):
    d = W.rolling_baseline(core(spark, sf_dir), E, "day", "ln_x", 60, F.col("clean"))
    return d.select("entity", "day", rules.yes(F.col("clean") & (F.col("ln_x") < F.col("base") - 2 * F.greatest("swc", F.lit(0.04879)))).alias("veto"))


@query("w23_coverage_sums", f"""WITH {DAILY}, g AS (SELECT entity, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM core GROUP BY entity),
d AS (SELECT g.entity, g.day, c.entity IS NOT NULL AS has, CASE WHEN c.quality <> 'INVALID' THEN c.n_orders END AS load FROM g LEFT JOIN core c ON c.entity = g.entity AND c.day = g.day),
s AS (SELECT entity, day, has, sum(CASE WHEN has THEN coalesce(load, 0) END) OVER w AS load_7d, count(load) OVER w AS load_7d_nobs FROM d WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT entity, day, round(load_7d::DOUBLE, 1) AS load_7d, load_7d_nobs::INTEGER AS load_7d_nobs FROM s WHERE has""")
def w23(spark, sf_dir):
    d = core(spark, sf_dir).withColumn("load", F.when(F.col("quality") != "INVALID", F.col("n_orders")))
    return W.coverage_sums(d, E, "day", [("load", 7, "load_7d", "load_7d_nobs")]).select("entity", "day", "load_7d", "load_7d_nobs")


@query("j15_dense_calendar", f"""WITH {DAILY}, g AS (SELECT entity, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM core GROUP BY entity)
SELECT g.entity, g.day, c.entity IS NOT NULL AS has_data, c.n_orders FROM g LEFT JOIN core c ON c.entity = g.entity AND c.day = g.day""")
def j15(spark, sf_dir):
    return W.dense_calendar(core(spark, sf_dir).select("entity", "day", "n_orders"), E, "day").select("entity", "day", "has_data", "n_orders")


_GATED = f"""{DAILY}, gated AS (SELECT entity, day, row_number() OVER (PARTITION BY entity ORDER BY day) AS i,
  CASE WHEN k % 5 = 0 THEN 'ROJO' WHEN k % 5 = 1 THEN 'ÁMBAR' WHEN k % 5 = 2 THEN 'NO' ELSE 'VERDE' END AS gate,
  CASE WHEN k % 4 = 0 THEN 'ROJO' WHEN k % 4 = 1 THEN 'ÁMBAR' WHEN k % 4 = 2 THEN 'NO' ELSE 'VERDE' END AS s28,
  CASE WHEN k % 3 = 0 THEN 'ROJO' WHEN k % 3 = 1 THEN 'ÁMBAR' ELSE 'VERDE' END AS s42 FROM daily)"""


def _gated(spark, sf_dir):
    d, k = daily(spark, sf_dir), F.col("k")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return d.select("entity", "day", pick(5, "ROJO", "ÁMBAR", "NO", "VERDE", "VERDE").alias("gate"), pick(4, "ROJO", "ÁMBAR", "NO", "VERDE").alias("s28"), pick(3, "ROJO", "ÁMBAR", "VERDE").alias("s42"))


@query("w29_w30_streaks", f"""WITH {_GATED}, g AS (SELECT *, sum(CASE WHEN gate = 'ROJO' THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY day) AS grp FROM gated)
SELECT entity, day, (sum(CASE WHEN gate = 'ROJO' THEN 1 ELSE 0 END) OVER (PARTITION BY entity, grp ORDER BY day))::INTEGER AS streak,
  (sum(CASE WHEN gate = 'ROJO' THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::INTEGER AS bad_7 FROM g""")
def w29(spark, sf_dir):
    return W.streak(_gated(spark, sf_dir), E, ["day"], F.col("gate") == "ROJO").select("entity", "day", "streak", "bad_7")


@query("w31_streaks_red_or_none", f"""WITH {_GATED}, g AS (SELECT *, sum(CASE WHEN gate IN ('ROJO', 'NO') THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY day) AS grp FROM gated)
SELECT entity, day, (sum(CASE WHEN gate IN ('ROJO', 'NO') THEN 1 ELSE 0 END) OVER (PARTITION BY entity, grp ORDER BY day))::INTEGER AS streak,
  (sum(CASE WHEN gate IN ('ROJO', 'NO') THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::INTEGER AS bad_7 FROM g""")
def w31(spark, sf_dir):
    return W.streak(_gated(spark, sf_dir), E, ["day"], F.col("gate").isin("ROJO", "NO")).select("entity", "day", "streak", "bad_7")


@query("w28_persistence", f"""WITH {_GATED}, r AS (SELECT *, list_position(['VERDE', 'ÁMBAR', 'ROJO'], gate) AS b, list_position(['VERDE', 'ÁMBAR', 'ROJO'], CASE WHEN s28 <> 'NO' THEN s28 ELSE s42 END) AS s,
  CASE WHEN s28 <> 'NO' THEN 28 ELSE 42 END AS src FROM gated),
c AS (SELECT *, count(*) FILTER (s > b AND src = 28) OVER w AS w28, count(*) FILTER (s > b AND src = 42) OVER w AS w42, count(*) FILTER (s < b AND src = 28) OVER w AS u28, count(*) FILTER (s < b AND src = 42) OVER w AS u42
  FROM r WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN b IS NULL OR i < 3 OR (w28 + w42 >= 2 AND u28 + u42 >= 2) THEN 0 WHEN w28 + w42 >= 2 THEN -1 WHEN u28 + u42 >= 2 THEN 1 ELSE 0 END AS delta FROM c)
SELECT entity, day, CASE WHEN delta = 0 THEN gate ELSE ['VERDE', 'ÁMBAR', 'ROJO'][greatest(least(b - delta, 3), 1)] END AS final, delta,
  CASE delta WHEN -1 THEN 'OVERRIDE_DOWN_' || CASE WHEN w28 >= w42 THEN '28' ELSE '42' END || '_2of3' WHEN 1 THEN 'OVERRIDE_UP_' || CASE WHEN u28 >= u42 THEN '28' ELSE '42' END || '_2of3' ELSE 'BASE60_ONLY' END AS path FROM d""")
def w28(spark, sf_dir):
    return W.persistence(_gated(spark, sf_dir), E, ["day"], "gate", "s28", "s42").select("entity", "day", "final", "delta", "path")


@query("w24_effort_recent", f"""WITH {SESSIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY entity, grp ORDER BY day, session_id) AS i FROM sessions),
p AS (SELECT a.session_id, count(*) AS n, count(b.load) AS nl, quantile_cont(b.load, 0.25) AS q1, quantile_cont(b.load, 0.75) AS q3 FROM o a JOIN o b ON a.entity = b.entity AND a.grp = b.grp AND b.i < a.i AND b.day >= a.day - 60 GROUP BY 1)
SELECT o.session_id, CASE WHEN o.load IS NULL OR coalesce(n, 0) < 5 THEN 'unknown' WHEN n > nl THEN 'typical' WHEN o.load > q3 THEN 'above' WHEN o.load < q1 THEN 'below' ELSE 'typical' END AS effort FROM o LEFT JOIN p USING (session_id)""")
def w24(spark, sf_dir):
    return W.rolling_class(sessions_of(spark, sf_dir), ["entity", "grp"], "day", ["session_id"], "load").select("session_id", "effort")


@query("w25_effort_anchor", f"""WITH {SESSIONS}, q AS (SELECT entity, grp, count(load) AS n, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM sessions WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND load IS NOT NULL GROUP BY 1, 2 HAVING count(load) >= 5)
SELECT session_id, CASE WHEN load IS NULL OR q1 IS NULL THEN 'unknown' WHEN load > q3 THEN 'above' WHEN load < q1 THEN 'below' ELSE 'typical' END AS effort FROM sessions LEFT JOIN q USING (entity, grp)""")
def w25(spark, sf_dir):
    return W.anchor_class(sessions_of(spark, sf_dir), ["entity", "grp"], "day", "load", "1996-01-01", "1996-12-31").select("session_id", "effort")
