"""Daily and weekly roll-ups of sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import quality as Q
from ..operators.upsert import best_rows
from ..plans import sessions, sleep, weekly
from .registry import DAILY, SESSIONS, core, query, rounded, session_contract, sessions_of, table

_AERO = "('trail_run','road_run','bike')"


@query("a23_a24_day_rollup", f"""WITH {SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity, day ORDER BY load DESC NULLS LAST, duration DESC NULLS LAST, session_id) AS i FROM sessions)
SELECT entity, day AS "Fecha", count(*) AS n_sessions, round_even(sum(duration), 1) AS total_duration_min, max((sport IN {_AERO})::INTEGER) AS has_aerobic, max((sport = 'strength')::INTEGER) AS has_strength, max((sport = 'mobility')::INTEGER) AS has_mobility,
  round_even(sum(load), 1) AS load_day, max(CASE WHEN i = 1 THEN grp END) AS intensity_cat_day, round_even(coalesce(sum(duration) FILTER (sport = 'strength'), 0), 1) AS strength_min_day,
  round_even(coalesce(sum(duration) FILTER (sport = 'mobility'), 0), 1) AS mobility_min_day, max(rpe::DOUBLE) FILTER (sport IN {_AERO}) AS rpe_max_day, count(*) AS n_with_rpe, sum(session_id::BIGINT % 2)::BIGINT AS n_with_notes FROM r GROUP BY 1, 2""")
def a23(spark, sf_dir):
    d = sessions.day_rollup(session_contract(spark, sf_dir))
    return d.select("entity", "Fecha", "n_sessions", "total_duration_min", "has_aerobic", "has_strength", "has_mobility", "load_day", "intensity_cat_day", "strength_min_day", "mobility_min_day", "rpe_max_day", "n_with_rpe", "n_with_notes")


@query("a25_weighted_mean", f"""WITH {SESSIONS}, t AS (SELECT entity, day, sport IN {_AERO} AS a, session_id::BIGINT AS n FROM sessions), v AS (SELECT entity, day, CASE WHEN a AND n % 5 <> 0 AND n % 7 <> 0 THEN n % 40 END AS x, CASE WHEN a AND n % 5 <> 0 AND n % 7 <> 0 THEN n % 30 + 1 END AS km FROM t)
SELECT entity, day AS "Fecha", round_even(sum(x * km)::DOUBLE / sum(km)::DOUBLE, 1) AS elev_density_day FROM v GROUP BY 1, 2""")
def a25(spark, sf_dir):
    return sessions.day_rollup(session_contract(spark, sf_dir)).select("entity", "Fecha", "elev_density_day")


@query("a26_activity_day", f"""WITH {SESSIONS} SELECT entity, day, round(sum(load), 6) AS sum_load, round(max(load), 6) AS max_load, sum(duration) AS minutes, round(avg(load), 6) AS mean_load,
  arg_max(sport, struct_pack(l := coalesce(load, -1), s := session_id)) AS sport_of_max FROM sessions GROUP BY 1, 2""")
def a26(spark, sf_dir):
    return rounded(sessions.activity_day(sessions_of(spark, sf_dir), ["entity", "day"], "load", "duration", "sport", "session_id"))


@query("a27_run_statistics", f"""WITH {SESSIONS}, t AS (SELECT entity, day, session_id::BIGINT AS n, CASE WHEN session_id::BIGINT % 3 <> 0 THEN round(duration / 100, 4) END AS dt FROM sessions)
SELECT entity, count(*) AS n_sessions, count(DISTINCT day) AS n_days, count(dt) AS n_streams, sum(n % 2)::BIGINT AS n_notes, round(avg(dt), 6) AS dt_mean, min(dt) AS dt_min, max(dt) AS dt_max, bool_and(dt > 0.9 AND dt < 1.1) AS is_1hz FROM t GROUP BY 1""")
def a27(spark, sf_dir):
    return rounded(sessions.run_statistics(session_contract(spark, sf_dir)).drop("classes"))


@query("a10_a12_percentiles", f"""WITH {SESSIONS} SELECT session_id, round(p.q[1], 6) AS p10, round(p.q[2], 6) AS p90, round(p.i, 6) AS int_p90
FROM sessions JOIN (SELECT entity, quantile_cont(duration, [0.1, 0.9]) AS q, quantile_cont(rpe::DOUBLE, 0.9) AS i FROM sessions GROUP BY 1) p USING (entity)""")
def a12(spark, sf_dir):
    from .. import schema

    s = sessions_of(spark, sf_dir)
    named = {"Fecha": F.col("day"), "polar_sleep_duration_min": F.col("duration"), "polar_interruptions_long": F.col("rpe").cast("double"), "polar_continuity_index": F.col("session_id").cast("double")}
    table_ = s.select("entity", *[named.get(c, F.lit(None).cast("double")).alias(c) for c in schema.SLEEP])
    got = sleep.with_percentiles(table_)
    return rounded(got.select(F.col("polar_continuity_index").cast("long").cast("string").alias("session_id"), F.col("sleep_dur_p10").alias("p10"), F.col("sleep_dur_p90").alias("p90"), F.col("sleep_int_p90").alias("int_p90")))


@query("a11_winsorized_mean", f"WITH {DAILY}, q AS (SELECT entity, quantile_cont(rmssd, 0.1) AS a, quantile_cont(rmssd, 0.9) AS b FROM core GROUP BY 1) SELECT entity, round(avg(greatest(least(rmssd, b), a)), 4) AS m FROM core JOIN q USING (entity) GROUP BY 1")
def a11(spark, sf_dir):
    g = core(spark, sf_dir).groupBy("entity").agg(stats.winsorize(F.collect_list("rmssd")).alias("_w"))
    return rounded(g.select("entity", (F.aggregate("_w", F.lit(0.0), lambda a, x: a + x) / F.size("_w")).alias("m")), digits=4)


@query("a13_robust_spread", f"WITH {DAILY} SELECT entity, round(1.4826 * mad(rmssd), 4) AS sd, round(median(rmssd), 4) AS med FROM core GROUP BY 1")
def a13(spark, sf_dir):
    g = core(spark, sf_dir).groupBy("entity").agg(F.collect_list("rmssd").alias("_a"))
    return rounded(g.select("entity", stats.robust_sd(F.col("_a")).alias("sd"), stats.median(F.col("_a")).alias("med")), digits=4)


@query("a15_a16_line", f"WITH {DAILY} SELECT entity, round(regr_slope(ln_x, hr), 6) AS slope, round(regr_intercept(ln_x, hr), 6) AS intercept, round(regr_r2(ln_x, hr), 6) AS r2, count(*) AS n FROM core GROUP BY 1")
def a15(spark, sf_dir):
    g = core(spark, sf_dir).groupBy("entity").agg(F.collect_list(F.struct(F.col("hr").alias("x"), F.col("ln_x").alias("y"))).alias("_p"))
    return rounded(g.select("entity", stats.ols(F.col("_p")).alias("f")).select("entity", "f.slope", "f.intercept", "f.r2", "f.n"))


@query("a17_a18_healthy_anchor", f"""WITH {DAILY}, m AS (SELECT entity, day, CASE WHEN count(rmssd) OVER w >= 3 THEN median(rmssd) OVER w END AS med FROM core WHERE clean WINDOW w AS (PARTITION BY entity ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT entity, round(coalesce(median(med) FILTER (day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'), median(med)), 6) AS anchor, round(0.85 * coalesce(median(med) FILTER (day BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'), median(med)), 6) AS threshold FROM m GROUP BY 1""")
def a17(spark, sf_dir):
    from ..config import GateConfig
    from ..plans.final import healthy_anchors
    from .registry import core_contract

    a = healthy_anchors(core_contract(spark, sf_dir), GateConfig(healthy_start="1996-01-01", healthy_end="1996-12-31"))
    return rounded(a.select("entity", F.col("healthy_rmssd").alias("anchor"), (0.85 * F.col("healthy_rmssd")).alias("threshold")))


@query("x2_week_calendar", f"""WITH {DAILY}, w AS (SELECT DISTINCT entity, date_trunc('week', day)::DATE AS week FROM core WHERE clean), e AS (SELECT entity, week, (week + i::INTEGER)::DATE AS day FROM w, generate_series(0, 6) t(i))
SELECT e.entity, e.week, e.day, c.n_orders FROM e LEFT JOIN (SELECT * FROM core WHERE clean) c ON c.entity = e.entity AND c.day = e.day""")
def x2(spark, sf_dir):
    return weekly.week_calendar(core(spark, sf_dir).where("clean"), ["entity"], ["n_orders"], "day").select("entity", "week", "day", "n_orders")


@query("x3_load_versus_before", f"""WITH {DAILY}, t AS (SELECT entity, date_trunc('week', day)::DATE AS week, sum(n_orders)::BIGINT AS load FROM core GROUP BY 1, 2), b AS (SELECT *, avg(load) OVER w AS before, count(load) OVER w AS n FROM t WINDOW w AS (PARTITION BY entity ORDER BY week RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING))
SELECT entity, week, load, round(before, 6) AS before, CASE WHEN n < 3 THEN 'unknown' WHEN load > 1.3 * before THEN 'up' WHEN load < 0.7 * before THEN 'down' ELSE 'steady' END AS class FROM b""")
def x3(spark, sf_dir):
    return rounded(weekly.load_versus_before(core(spark, sf_dir), ["entity"], "n_orders", "day"))


@query("x4_zone_shares", f"""WITH {SESSIONS}, z AS (SELECT entity, date_trunc('week', day)::DATE AS week, coalesce(sum(load), 0)::DOUBLE AS load, coalesce(sum(duration), 0)::DOUBLE AS duration FROM sessions GROUP BY 1, 2)
SELECT entity, week, round(100 * load / (load + duration), 6) AS load_pct, round(100 * duration / (load + duration), 6) AS duration_pct, CASE WHEN 100 * load / (load + duration) > 60 THEN 'load' WHEN 100 * duration / (load + duration) > 60 THEN 'duration' END AS dominant FROM z""")
def x4(spark, sf_dir):
    return rounded(weekly.zone_shares(sessions_of(spark, sf_dir), ["entity"], ["load", "duration"], "day", 60.0).select("entity", "week", "load_pct", "duration_pct", "dominant"))


@query("x5_week_means", f"WITH {DAILY} SELECT entity, date_trunc('week', day)::DATE AS week, count(hr) FILTER (clean) AS n, round(avg(hr) FILTER (clean), 6) AS mean, min(hr) FILTER (clean) AS low, max(hr) FILTER (clean) AS high, round(100.0 * avg((hr < 58)::INTEGER) FILTER (clean), 6) AS pct_below FROM core GROUP BY 1, 2")
def x5(spark, sf_dir):
    return rounded(weekly.week_means(core(spark, sf_dir), ["entity"], "hr", F.col("clean"), "day", 58.0))


@query("x6_monotony", f"""WITH {DAILY}, w AS (SELECT entity, date_trunc('week', day)::DATE AS week, sum(n_orders)::DOUBLE AS total, sum(n_orders * n_orders)::DOUBLE AS q FROM core GROUP BY 1, 2), s AS (SELECT *, sqrt(greatest(q / 7 - (total / 7) ** 2, 0)) AS sd FROM w)
SELECT entity, week, total, round(CASE WHEN sd > 1e-9 THEN total / 7 / sd END, 6) AS monotony, round(CASE WHEN sd > 1e-9 THEN total * total / 7 / sd END, 4) AS strain FROM s""")
def x6(spark, sf_dir):
    m = weekly.monotony(core(spark, sf_dir), ["entity"], "n_orders", "day")
    return m.select("entity", "week", "total", F.round("monotony", 6).alias("monotony"), F.round("strain", 4).alias("strain"))


@query("x1_best_of_duplicates", """SELECT o_custkey, day, o_orderkey FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1""")
def x1(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    best = best_rows(o, ["o_custkey", "day"], [(F.col("o_orderstatus") == "F").desc(), F.desc("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderkey")])
    return best.select("o_custkey", "day", "o_orderkey")


@query("q1_q6_constraints", """SELECT 'key' AS rule, count(*) AS n_rows, count(*) FILTER (o_orderkey IS NULL) AS n_violations FROM orders
UNION ALL SELECT 'status', count(*), count(*) FILTER (NOT coalesce(o_orderstatus IN ('F', 'O'), false)) FROM orders UNION ALL SELECT 'price', count(*), count(*) FILTER (NOT coalesce(o_totalprice BETWEEN 1000 AND 300000, false)) FROM orders""")
def q1(spark, sf_dir):
    return Q.violations(table(spark, sf_dir, "orders"), {"key": F.col("o_orderkey").isNotNull(), "status": Q.one_of("o_orderstatus", "F", "O"), "price": F.col("o_totalprice").between(1000, 300000)})


@query("q1_unique_days", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def q1u(spark, sf_dir):
    return Q.duplicates(table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")), ["o_custkey", "day"])


@query("a36_a37_q7_distribution", f"WITH {DAILY} SELECT entity, quality AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY entity), 6) AS share FROM core GROUP BY 1, 2")
def q7(spark, sf_dir):
    return rounded(Q.distribution(core(spark, sf_dir), ["entity"], "quality"))


@query("q7_flag_counts", "SELECT o_orderpriority AS entity, flag, count(*) AS n FROM (SELECT o_orderpriority, unnest(string_split(concat_ws('|', CASE WHEN o_orderkey % 2 = 0 THEN 'EVEN' END, CASE WHEN o_custkey % 3 = 0 THEN 'THIRD' END), '|')) AS flag FROM orders) WHERE flag <> '' GROUP BY 1, 2")
def q7f(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("entity"), F.concat_ws("|", F.when(F.col("o_orderkey") % 2 == 0, "EVEN"), F.when(F.col("o_custkey") % 3 == 0, "THIRD")).alias("flags"))
    return Q.flag_counts(o, ["entity"], "flags")


@query("o5_top_outliers", "SELECT o_orderkey, o_totalprice::DOUBLE AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o5(spark, sf_dir):
    return Q.top_outliers(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), "price", 20, ["o_orderkey"])


@query("o4_tail_days", f"WITH {DAILY} SELECT entity, day, n_orders FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY day DESC) AS r FROM core) WHERE r <= 7")
def o4(spark, sf_dir):
    return best_rows(core(spark, sf_dir), ["entity"], [F.desc("day")], 7).select("entity", "day", "n_orders")
