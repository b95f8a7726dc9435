"""Rule sets, reports and gathered tables: orders stand for days, decisions and recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SessionConfig
from ..functions import parse, rules
from ..plans import contracts as C
from ..plans import weekly
from ..sources.writers import params_hash
from .registry import DAILY, SAMPLES, SESSIONS, core, query, rounded, samples_of, session_contract, sessions_of, table

_O = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice::DOUBLE AS p, o_orderpriority AS e, o_orderstatus AS s FROM orders)"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").cast("double").alias("p"), F.col("o_orderpriority").alias("e"), F.col("o_orderstatus").alias("s"))


def _pick(index, *values):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _rules_sql(source: str, rules_: dict[str, str], unique: str, more: str = "") -> str:
    parts = [f"SELECT '{k}' AS rule, count(*) AS n_rows, count(*) FILTER (NOT ({v})) AS n_violations FROM t" for k, v in rules_.items()]
    parts.append(f"SELECT 'unique', sum(n)::BIGINT, sum(CASE WHEN n > 1 OR Fecha IS NULL THEN n ELSE 0 END)::BIGINT FROM (SELECT {unique}, count(*) AS n FROM t GROUP BY ALL)")
    return f"WITH {_O}, t AS ({source}) " + " UNION ALL ".join(parts) + more


_CORE = """SELECT c AS entity, CASE WHEN k % 97 <> 0 THEN d END AS Fecha, ['OK','FLAG_mecánico','INVALID','BAD'][(k % 4 + 1)::INTEGER] AS q, ['OK','Unstable','odd'][(k % 3 + 1)::INTEGER] AS st, 50.0 + c % 20 AS hr, 60 / (50.0 + c % 20) * (1 + k % 5 / 1600.0) AS rr FROM o"""


@query("q1_q5_core_contract", _rules_sql(_CORE, {"day": "Fecha IS NOT NULL", "quality": "q IN ('OK','FLAG_mecánico','INVALID')", "stability": "st IN ('OK','Unstable')", "units": "abs(hr * rr / 60 - 1) <= 0.001"}, "entity, Fecha"))
def q1(spark, sf_dir):
    k, hr = F.col("k"), 50.0 + F.col("c") % 20
    t = _orders(spark, sf_dir).select(
        F.col("c").alias("entity"), F.when(k % 97 != 0, F.col("d")).alias("Fecha"), _pick(k % 4, "OK", "FLAG_mecánico", "INVALID", "BAD").alias("Calidad"), _pick(k % 3, "OK", "Unstable", "odd").alias("HRV_Stability"),
        hr.alias("HR_stable"), (60 / hr * (1 + k % 5 / 1600.0)).alias("RRbar_s"))
    return C.contract(t, ["entity", "Fecha"], C.core_rules())


_FINAL = """SELECT c AS entity, CASE WHEN k % 89 <> 0 THEN d END AS Fecha, ['VERDE','ÁMBAR','ROJO','NO','AZUL'][(k % 5 + 1)::INTEGER] AS g, ['INTENSIDAD_OK','Z2_O_TEMPO_SUAVE','SUAVE_O_DESCANSO','x'][(c % 4 + 1)::INTEGER] AS a, ['healthy85','p20','y'][(c % 3 + 1)::INTEGER] AS w, k % 6 = 0 AS v, CASE WHEN k % 4 <> 0 THEN ln(p) END AS today, ln(p) + (c % 2) * 0.01 AS used FROM o"""


@query("q2_final_contract", _rules_sql(_FINAL, {"day": "Fecha IS NOT NULL", "gate": "g IN ('VERDE','ÁMBAR','ROJO','NO')", "action": "a <> 'x'", "warning": "w <> 'y'", "veto": "NOT v OR today IS NULL OR abs(used - today) < 0.001"}, "entity, Fecha", " UNION ALL SELECT 'columns', count(*), 52::BIGINT FROM t"))
def q2(spark, sf_dir):
    from .. import schema

    k, c = F.col("k"), F.col("c")
    t = _orders(spark, sf_dir).select(
        c.alias("entity"), F.when(k % 89 != 0, F.col("d")).alias("Fecha"), _pick(k % 5, "VERDE", "ÁMBAR", "ROJO", "NO", "AZUL").alias("gate_final"), _pick(c % 4, *C.ACTIONS, "x").alias("Action"),
        _pick(c % 3, "healthy85", "p20", "y").alias("warning_mode"), (k % 6 == 0).alias("veto_agudo"), F.when(k % 4 != 0, F.log("p")).alias("lnRMSSD_today"), (F.log("p") + c % 2 * 0.01).alias("lnRMSSD_used"), F.lit(1).alias("extra"))
    return C.contract(t, ["entity", "Fecha"], C.final_rules(), schema.FINAL)


@query("q3_sleep_contract", f"""WITH {_O}, t AS (SELECT e AS entity, d AS Fecha, CASE WHEN k % 3 <> 0 THEN c % 60 END AS i, c % 2 AS p10, 1 AS p90 FROM o)
SELECT 'day' AS rule, count(*) AS n_rows, count(*) FILTER (Fecha IS NULL) AS n_violations FROM t UNION ALL SELECT 'interruptions', count(*), count(*) FILTER (i >= 50) FROM t
UNION ALL SELECT 'unique', sum(n)::BIGINT, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT FROM (SELECT entity, Fecha, count(*) AS n FROM t GROUP BY ALL)
UNION ALL SELECT 'sleep_dur_p10', count(*), count(*) FILTER (a > 1) FROM (SELECT entity, count(DISTINCT p10) AS a FROM t GROUP BY 1) UNION ALL SELECT 'sleep_dur_p90', count(*), count(*) FILTER (a > 1) FROM (SELECT entity, count(DISTINCT p90) AS a FROM t GROUP BY 1)""")
def q3(spark, sf_dir):
    c = F.col("c")
    t = _orders(spark, sf_dir).select(F.col("e").alias("entity"), F.col("d").alias("Fecha"), F.when(F.col("k") % 3 != 0, c % 60).alias("polar_interruptions_long"), (c % 2).alias("sleep_dur_p10"), F.lit(1).alias("sleep_dur_p90"))
    return C.contract(t, ["entity", "Fecha"], C.sleep_rules()).unionByName(C.constant_columns(t, ["entity"], ["sleep_dur_p10", "sleep_dur_p90"]))


@query("q4_core_final_agreement", f"""WITH {DAILY}, a AS (SELECT entity, day, round(rmssd, 3) AS r, n_orders AS n FROM core WHERE quality <> 'FLAG'), b AS (SELECT entity, day, CASE WHEN n_orders % 3 = 0 THEN round(rmssd, 3) + 1 ELSE round(rmssd, 3) END AS r, n_orders AS n FROM core WHERE quality <> 'INVALID'),
j AS (SELECT a.r AS ar, b.r AS br, a.n AS an, b.n AS bn FROM a JOIN b USING (entity, day)), t AS (SELECT count(*) AS n FROM a)
SELECT 'same_keys' AS rule, n AS n_rows, (SELECT count(*) FROM a ANTI JOIN b USING (entity, day)) + (SELECT count(*) FROM b ANTI JOIN a USING (entity, day)) AS n_violations FROM t
UNION ALL SELECT 'r', n, (SELECT count(*) FROM j WHERE ar IS DISTINCT FROM br) FROM t UNION ALL SELECT 'n', n, (SELECT count(*) FROM j WHERE an IS DISTINCT FROM bn) FROM t""")
def q4(spark, sf_dir):
    d = core(spark, sf_dir).select("entity", "day", "quality", F.round("rmssd", 3).alias("r"), F.col("n_orders").alias("n"))
    b = d.withColumn("r", F.when(F.col("n") % 3 == 0, F.col("r") + 1).otherwise(F.col("r")))
    return C.agreement(d.where("quality <> 'FLAG'").drop("quality"), b.where("quality <> 'INVALID'").drop("quality"), ["entity", "day"], ["r", "n"])


_SESS = "SELECT c AS entity, d AS Fecha, ['endurance_easy','strength','endurance_hard'][(k % 3 + 1)::INTEGER] AS g, (k % 50)::DOUBLE AS z1, (50 - k % 50)::DOUBLE AS z2, (50 + (c % 4) * 0.05)::DOUBLE AS z3, (c % 40)::DOUBLE AS w, (k % 60)::DOUBLE AS m, (c % 45)::DOUBLE AS l FROM o"


@query("q6_session_contract", _rules_sql(_SESS, {"zones": "g = 'strength' OR abs(z1 + z2 + z3 - 100) < 0.1", "work_moving": "g = 'strength' OR w <= m + 0.1", "work_longest": "g = 'strength' OR l <= w + 0.1"}, "entity, Fecha"))
def q6(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = _orders(spark, sf_dir).select(
        c.alias("entity"), F.col("d").alias("Fecha"), _pick(k % 3, "endurance_easy", "strength", "endurance_hard").alias("session_group"), (k % 50).cast("double").alias("z1_pct"), (50 - k % 50).cast("double").alias("z2_pct"), (50 + c % 4 * 0.05).alias("z3_pct"),
        (c % 40).cast("double").alias("work_total_min"), (k % 60).cast("double").alias("moving_min"), (c % 45).cast("double").alias("work_longest_min"))
    return C.contract(t, ["entity", "Fecha"], C.session_rules())


@query("q6_day_contract", _rules_sql("SELECT c AS entity, d AS Fecha, CASE WHEN k % 5 <> 0 THEN k % 6 END AS a, c % 9 AS b FROM o", {"load_3d_nobs": "a IS NULL OR a <= 3", "z3_7d_nobs": "b <= 7"}, "entity, Fecha"))
def q6d(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = _orders(spark, sf_dir).select(c.alias("entity"), F.col("d").alias("Fecha"), F.when(k % 5 != 0, k % 6).alias("load_3d_nobs"), (c % 9).alias("z3_7d_nobs"))
    return C.contract(t, ["entity", "Fecha"], C.day_rules([("load_3d_nobs", 3), ("z3_7d_nobs", 7)]))


@query("c19_version_report", f"""WITH {_O}, j AS (SELECT ['VERDE','ÁMBAR','ROJO','NO'][(k % 4 + 1)::INTEGER] AS a, CASE WHEN k % 7 = 0 THEN 'ROJO' ELSE ['VERDE','ÁMBAR','ROJO','NO'][(k % 4 + 1)::INTEGER] END AS b FROM o),
g AS (SELECT unnest(['VERDE','ÁMBAR','ROJO','NO']) AS gate) SELECT gate, count(*) FILTER (a = gate) AS n_before, count(*) FILTER (b = gate) AS n_after, count(*) FILTER (b = gate) - count(*) FILTER (a = gate) AS delta, count(*) FILTER (a = gate AND b <> gate) AS n_changed FROM g, j GROUP BY 1""")
def c19(spark, sf_dir):
    a = _orders(spark, sf_dir).select("k", _pick(F.col("k") % 4, "VERDE", "ÁMBAR", "ROJO", "NO").alias("gate_final"))
    return C.version_report(a, a.withColumn("gate_final", F.when(F.col("k") % 7 == 0, "ROJO").otherwise(F.col("gate_final"))), ["k"])


@query("k6_run_metadata", f"""WITH {SESSIONS}, t AS (SELECT *, session_id::BIGINT AS n FROM sessions), z AS (SELECT entity, count(*) FILTER (n % 4 <> 0) AS icu, count(*) FILTER (n % 4 = 0) AS fb FROM t GROUP BY 1)
SELECT t.entity, min(day)::VARCHAR AS oldest, count(*) AS sessions, count(DISTINCT day) AS days, count(*) FILTER (n % 3 <> 0) AS with_streams, sum(n % 2)::BIGINT AS with_notes, '{params_hash(vars(SessionConfig()))}' AS params_hash, any_value(icu) AS icu FROM t JOIN z USING (entity) GROUP BY 1""")
def k6(spark, sf_dir):
    m = C.run_metadata(session_contract(spark, sf_dir))
    at = lambda path, kind: F.get_json_object("metadata", path).cast(kind)
    return m.select(
        "entity", at("$.input_range.oldest", "string").alias("oldest"), at("$.counts.sessions", "long").alias("sessions"), at("$.counts.days", "long").alias("days"), at("$.counts.with_streams", "long").alias("with_streams"),
        at("$.counts.with_notes", "long").alias("with_notes"), at("$.params_hash", "string").alias("params_hash"), at("$.zones_source_dist.icu", "long").alias("icu"))


@query("k8_context_payload", f"""WITH {SESSIONS}, {DAILY}, c1 AS (SELECT entity, day, n_orders, quality FROM core), s AS (SELECT session_id, grp AS entity, day FROM sessions)
SELECT session_id, s.entity, s.day, n_orders AS orders, quality, CASE WHEN n_orders IS NOT NULL THEN 1 ELSE 0 END AS has_core FROM s LEFT JOIN c1 ON c1.entity = s.entity AND c1.day = s.day""")
def k8(spark, sf_dir):
    c = core(spark, sf_dir).select("entity", "day", "n_orders", "quality")
    out = C.context_payload(sessions_of(spark, sf_dir).select(F.col("grp").alias("entity"), "day", "session_id"), {"core": (c, ["n_orders", "quality"])}, ["entity", "day"])
    at = lambda path: F.get_json_object("context", path)
    return out.select("session_id", "entity", "day", at("$.core.n_orders").cast("long").alias("orders"), at("$.core.quality").alias("quality"), at("$.core").isNotNull().cast("int").alias("has_core"))


@query("c24_attach_cost", f"""WITH {_O} SELECT a.k, b.k IS NOT NULL AS usable, CASE WHEN b.k IS NULL THEN 'session_not_found' END AS reason, CASE WHEN b.k IS NOT NULL THEN round(b.p / 1000, 3) END AS score FROM o a LEFT JOIN o b ON b.k = a.k AND b.k % 3 = 0""")
def c24(spark, sf_dir):
    o = _orders(spark, sf_dir)
    cost = o.where("k % 3 = 0").select("k", F.round(F.col("p") / 1000, 3).alias("score"))
    return C.attach_cost(o.select("k"), cost, ["k"], ["score"]).select("k", "cost.usable", "cost.reason", "cost.score")


@query("c25_session_beats", """WITH a AS (SELECT user_id, event_id AS session_id, epoch_us(ts) / 6e7 AS t, value AS z FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS rec_id, epoch_us(ts) / 6e7 AS u, value AS y FROM events WHERE event_type = 'click'),
n AS (SELECT user_id, session_id, rec_id, abs(t - u) AS delta, row_number() OVER (PARTITION BY session_id ORDER BY abs(t - u), abs(z - y), rec_id) AS r FROM a JOIN b USING (user_id) WHERE abs(t - u) <= 240),
h AS (SELECT l_orderkey AS rec_id, count(*) AS n_beats, round_even(100 * avg((l_linenumber > 4)::INTEGER), 4) AS offline_pct FROM lineitem GROUP BY 1)
SELECT user_id, session_id, n.rec_id, round(delta, 4) AS delta, coalesce(n_beats, 0) AS n_beats, offline_pct FROM n LEFT JOIN h ON h.rec_id = n.rec_id WHERE r = 1""")
def c25(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), (F.unix_micros("ts") / 6e7).alias("at"), F.col("value").alias("size"))
    beats = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rec_id"), (F.col("l_linenumber") > 4).alias("offline"))
    return rounded(C.session_beats(side("purchase", "session_id"), side("click", "rec_id"), beats, ["user_id"], 240.0), digits=4)


@query("c23_speed_patch", f"""WITH {SAMPLES}, s AS (SELECT DISTINCT entity, session_id FROM samples), m AS (SELECT entity, session_id, avg(speed) FILTER (speed >= 0.5) AS v, count(*) AS n FROM samples WHERE entity % 5 <> 0 AND (entity % 7 <> 0 OR speed < 0.5) GROUP BY 1, 2)
SELECT entity, session_id, CASE WHEN n IS NULL THEN 'SKIP' WHEN v IS NULL THEN 'FAIL' ELSE 'OK' END AS status, CASE WHEN n IS NULL THEN 'no samples' WHEN v IS NULL THEN 'no speed' END AS reason, round_even(v * 3.6, 2) AS avg_speed_kmh,
  CASE WHEN v > 0 THEN format('{{:d}}:{{:02d}}', (round(1000 / v)::BIGINT // 60), round(1000 / v)::BIGINT % 60) END AS avg_pace FROM s LEFT JOIN m USING (entity, session_id)""")
def c23(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    return C.speed_patch(s.select("entity", "session_id").distinct(), s.where("entity % 5 <> 0 AND (entity % 7 <> 0 OR speed < 0.5)"))


@query("w31_load_reasons", f"""WITH {_O}, t AS (SELECT k, ['VERDE','ÁMBAR','ROJO'][(k % 3 + 1)::INTEGER] AS g, (c % 100) / 100.0 AS d, 0.1 AS w, (c % 90)::DOUBLE AS l3, 60.0 AS p90, (k % 50 - 40)::DOUBLE AS tsb, CASE WHEN k % 4 <> 0 THEN (c % 60)::DOUBLE END AS y FROM o)
SELECT k, concat_ws(' | ', CASE WHEN d > 2 * w THEN 'HRV excesivamente alto (d_ln=+' || printf('%.3f', d) || ' > 2×SWC=0.200): posible saturación parasimpática' END,
  CASE WHEN l3 > p90 THEN printf('Carga acumulada alta (3d=%.0f > P90=60)', l3) END, CASE WHEN tsb < -25 THEN printf('Fatiga profunda (TSB=%.0f)', tsb) END,
  CASE WHEN g = 'ROJO' AND y < 30 THEN 'ROJO sin carga previa ni sueño malo: revisar otros factores' END, CASE WHEN g = 'VERDE' AND tsb < -20 THEN printf('VERDE con fatiga acumulada (TSB=%.0f): precaución intensidad', tsb) END) AS reasons FROM t""")
def w31(spark, sf_dir):
    k, c = F.col("k"), F.col("c")
    t = _orders(spark, sf_dir).select(
        "k", _pick(k % 3, "VERDE", "ÁMBAR", "ROJO").alias("gate_final"), (c % 100 / 100.0).alias("d_ln"), F.lit(0.1).alias("swc_ln"), (c % 90).cast("double").alias("load_3d"), F.lit(60.0).alias("load_3d_p90"), (k % 50 - 40).cast("double").alias("tsb"),
        F.when(k % 4 != 0, (c % 60).cast("double")).alias("load_yday"))
    return t.select("k", C.load_reasons(t).alias("reasons"))


@query("p5_o3_exercises", f"""WITH {_O} SELECT k, d, s, p FROM o WHERE (k % 19 = 0 OR d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') AND s IN ('F', 'O') AND p <= 150000 ORDER BY p, k LIMIT 50""")
def p5(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("day", F.when(F.col("k") % 19 != 0, F.col("d")))
    return C.exercises(o, "day", "s", "p", "1995-01-01", "1996-12-31", ["F", "O"], 150000.0, ["p", "k"], 50).select("k", "d", "s", "p")


@query("p32_gate_family", f"""WITH {_O}, t AS (SELECT k, ['verde++','ÁMBAR--','ambar',' Rojo ','NO','x',NULL][(k % 7 + 1)::INTEGER] AS b FROM o), u AS (SELECT k, upper(trim(b)) AS b FROM t)
SELECT k, CASE WHEN b LIKE 'VERDE%' THEN 'VERDE' WHEN b LIKE 'ÁMBAR%' OR b LIKE 'AMBAR%' THEN 'ÁMBAR' WHEN b LIKE 'ROJO%' THEN 'ROJO' WHEN b LIKE 'NO%' THEN 'NO' END AS family FROM u""")
def p32(spark, sf_dir):
    badge = F.element_at(F.array(*map(F.lit, ("verde++", "ÁMBAR--", "ambar", " Rojo ", "NO", "x")), F.lit(None).cast("string")), (F.col("k") % 7 + 1).cast("int"))
    return _orders(spark, sf_dir).select("k", rules.gate_family(badge).alias("family"))


_NAMES = ("Polar_ECG_20240101.jsonl", "x/acc-01.JSONL", "ecg.jsonl", "acc_ecg.jsonl", "notes.txt")


@query("p40_p39_sensor_files", f"""WITH {_O}, t AS (SELECT k, c, [{', '.join(f"'{n}'" for n in _NAMES)}][(k % 5 + 1)::INTEGER] AS n, d FROM o), u AS (SELECT *, lower(regexp_replace(regexp_replace(n, '^.*/', ''), '(.)\\.[^.]*$', '\\1')) AS st FROM t),
v AS (SELECT *, st LIKE '%ecg%' AS a, st LIKE '%acc%' AS b, regexp_replace(regexp_replace(st, 'ecg|acc', '', 'g'), '[^a-z0-9]+', '', 'g') AS y FROM u)
SELECT k, CASE WHEN a <> b THEN CASE WHEN a THEN 'ecg' ELSE 'acc' END END AS sensor, CASE WHEN a <> b THEN CASE WHEN y = '' THEN 'default' ELSE y END END AS key,
  CASE k % 3 WHEN 0 THEN d WHEN 1 THEN DATE '2024-02-03' ELSE DATE '1970-01-01' END AS day FROM v""")
def p40(spark, sf_dir):
    k = F.col("k")
    stamp = F.when(k % 3 == 0, F.unix_date("d").cast("double") * 86_400_000 + 5000)
    name = F.when(k % 3 == 1, "rec_20240203_101500").otherwise("rec")
    o = _orders(spark, sf_dir).select("k", parse.sensor_and_key(_pick(k % 5, *_NAMES)).alias("s"), parse.recording_day(stamp, name).alias("day"))
    return o.select("k", "s.sensor", "s.key", "day")


@query("p45_p18_visibility", f"""WITH {_O} SELECT k, NOT (k % 2 = 0 OR coalesce(['confirm','no_rr','unavailable',NULL][(k % 4 + 1)::INTEGER] IN ('unavailable','no_rr'), false)) AS shown,
  ['trail','road','road','bike','trail'][(c % 5 + 1)::INTEGER] AS family FROM o""")
def p45(spark, sf_dir):
    k = F.col("k")
    modifier = F.element_at(F.array(*map(F.lit, ("confirm", "no_rr", "unavailable")), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    return _orders(spark, sf_dir).select("k", C.beats_visible(k % 2 == 0, modifier).alias("shown"), parse.analyser_sport(_pick(F.col("c") % 5, "Trail_Run", "running", " virtualrun", "bike", "climbing")).alias("family"))


@query("p46_local_times", f"""WITH {_O} SELECT k, CASE k % 3 WHEN 0 THEN d::TIMESTAMP + INTERVAL 10 HOUR WHEN 1 THEN d::TIMESTAMP + INTERVAL 10 HOUR + INTERVAL 330 MINUTE ELSE d::TIMESTAMP + INTERVAL 10 HOUR + INTERVAL 210 MINUTE END AS at FROM o""")
def p46(spark, sf_dir):
    k, day = F.col("k"), F.col("d").cast("string")
    a = F.when(k % 3 == 0, F.concat(day, F.lit("T10:00:00")))
    b = F.when(k % 3 == 1, F.concat(day, F.lit("T10:00:00Z"))).when(k % 3 == 2, F.concat(day, F.lit("T10:00:00+02:00")))
    return _orders(spark, sf_dir).select("k", parse.first_time("Asia/Kolkata", F.lit("no time"), a, b).alias("at"))


@query("a30_a38_comparison", f"""WITH {DAILY}, g AS (SELECT entity, abs(hr - CASE WHEN clean THEN ln_x END) AS x, hr FROM core) SELECT entity, round(median(x), 6) AS median_abs_diff, round(avg(x), 6) AS mean_abs_diff, round(max(x), 6) AS max_abs_diff, count(x) AS n_compared, round(median(hr), 6) AS median,
  round(quantile_cont(hr, 0.1), 6) AS p10, round(quantile_cont(hr, 0.9), 6) AS p90, count(hr) AS n FROM g GROUP BY 1""")
def a30(spark, sf_dir):
    c = core(spark, sf_dir).withColumn("b", F.when(F.col("clean"), F.col("ln_x")))
    return rounded(C.method_comparison(c, ["entity"], "hr", "b").join(C.describe(c, ["entity"], ["hr"]).drop("column"), "entity"))


@query("s5_s6_best_recording", f"""WITH {_O} SELECT c, d, k FROM (SELECT *, row_number() OVER (PARTITION BY c, d ORDER BY s = 'F', k % 2 = 0 DESC, p DESC, k) AS r FROM o) WHERE r = 1""")
def s5(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("archived", F.col("s") == "F").withColumn("converted", F.col("k") % 2 == 0)
    return C.best_recording(o, ["c", "d"], "archived", "converted", "p", "k").select("c", "d", "k")


@query("x9_splits_climb", f"""WITH RECURSIVE {SAMPLES}, d AS (SELECT *, (sum(speed) OVER w - speed) AS d FROM samples WINDOW w AS (PARTITION BY entity ORDER BY sec)),
s AS (SELECT *, floor(d / 1000)::BIGINT + 1 AS split FROM d), h AS (SELECT entity, split, median(z::DOUBLE) OVER (PARTITION BY entity, split ORDER BY sec ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS h, row_number() OVER (PARTITION BY entity, split ORDER BY sec) AS i FROM s),
f(entity, split, i, held, up, down) AS (SELECT entity, split, i, h, 0.0::DOUBLE, 0.0::DOUBLE FROM h WHERE i = 1 UNION ALL
  SELECT h.entity, h.split, h.i, CASE WHEN abs(h - held) >= 0.5 THEN h ELSE held END, up + CASE WHEN h - held >= 0.5 THEN h - held ELSE 0 END, down + CASE WHEN held - h >= 0.5 THEN held - h ELSE 0 END FROM f JOIN h ON h.entity = f.entity AND h.split = f.split AND h.i = f.i + 1),
g AS (SELECT entity, split, arg_max(up, i) AS gain_m, arg_max(down, i) AS loss_m FROM f GROUP BY 1, 2)
SELECT entity, split, count(*) AS seconds, count(*) - count(*) FILTER (speed >= 0.5) AS stopped_s, round(avg(hr), 6) AS hr_mean, round(any_value(gain_m), 6) AS gain_m, round(any_value(loss_m), 6) AS loss_m FROM s JOIN g USING (entity, split) GROUP BY 1, 2""")
def x9(spark, sf_dir):
    s = samples_of(spark, sf_dir).withColumn("alt", F.col("z").cast("double"))
    got = weekly.splits(s, ["entity"], "speed", "hr", altitude="alt")
    return rounded(got.select("entity", "split", "seconds", (F.col("seconds") - F.col("moving_s")).alias("stopped_s"), "hr_mean", "gain_m", "loss_m"))
