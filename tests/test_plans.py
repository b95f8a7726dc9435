"""Plans and folds on hand-made cases, against plain Python."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.config import AuditConfig, GateConfig, SessionConfig
from pulsegrid.functions import parse, rules, stats
from pulsegrid.operators import beats as B
from pulsegrid.operators import dfa, islands, upsert
from pulsegrid.operators import windows as W
from pulsegrid.plans import audit, core, cost, final, sessions, sleep

DAY = datetime.date(2025, 6, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_stats(spark):
    r = random.Random(1)
    v = [r.gauss(0, 3) for _ in range(41)]
    a = F.array(*map(F.lit, v), F.lit(None).cast("double"))
    med = float(np.median(v))
    mad = float(np.median(np.abs(np.array(v) - med)))
    assert one(spark, stats.quantile(a, 0.3)) == pytest.approx(np.quantile(v, 0.3))
    assert one(spark, stats.mad(a)) == pytest.approx(mad)
    assert one(spark, stats.robust_z(F.lit(1.0), a)) == pytest.approx((1 - med) / (1.4826 * mad))
    assert one(spark, stats.robust_z(F.lit(None).cast("double"), a)) is None
    lo, hi = np.quantile(v, 0.1), np.quantile(v, 0.9)
    assert one(spark, stats.winsorize(a))[:41] == pytest.approx(list(np.clip(v, lo, hi)))
    fit = one(spark, stats.ols(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(2 * x + 1).alias("y")) for x in v])))
    assert (fit.slope, fit.intercept, fit.r2) == pytest.approx((2, 1, 1))
    assert one(spark, stats.mad(F.array().cast("array<double>"))) is None


def test_parsers(spark):
    cases = {"PT1H30M5.5S": 90 + 5.5 / 60, "90": 90, "7200": 120, "5400000": 90, "x": None, "": None, "0": None, "-5": None, "PT": None, "150000": 2500, "PT30H": 30, "P1D": None, "1e9": 1e9}
    for text, want in cases.items():
        got = one(spark, parse.minutes(F.lit(text)))
        assert got == (pytest.approx(want) if want is not None else None)
    assert one(spark, parse.number(F.lit("3,5"))) == 3.5 and one(spark, parse.number(F.lit("NaN"))) is None
    assert one(spark, parse.colour_code(F.lit("Ámbar "))) == 2
    note = F.array(*[F.struct(F.lit("TEXT").alias("type"), F.lit(x).alias("content")) for x in ("a\n\n\nb", " ", "## " + "z" * 600)])
    assert one(spark, parse.user_note(note)) == "a | b |"


def test_gate_rules(spark):
    g = lambda a, b, s=1.0: one(spark, rules.gate(F.lit(a), F.lit(b), F.lit(0.0), F.lit(0.0), F.lit(s), F.lit(1.0)))
    assert g(-2.0, 2.0).gate == schema.ROJO and g(-2.0, 0.0).reason == "2D_LN" and g(0.0, 2.0).reason == "2D_HR" and g(0.0, 0.0).gate == schema.VERDE and g(0.0, 0.0, 0.0).gate == "NO"
    assert one(spark, rules.shift_gate(F.lit("NO"), 1)) == "NO" and one(spark, rules.shift_gate(F.lit(schema.ROJO), 1)) == schema.ROJO


def fold_filter(beats):
    last, out = None, []
    for i, d, off in beats:
        reason = "offline" if off else "out_of_range" if not 300 <= d <= 2000 else "jump" if last and abs(d - last) / last > 0.2 else ""
        if not reason:
            last = d
        out.append((i, not reason, reason))
    return out


def test_accepted_filter_is_a_fold(spark):
    r = random.Random(2)
    rows = [(i, r.choice([900.0, 950.0, 1250.0, 2500.0, 700.0]), r.random() < 0.1) for i in range(300)]
    df = spark.createDataFrame([("e", *x) for x in rows], "entity string, beat_idx long, duration_ms double, offline boolean")
    got = sorted((x.beat_idx, x.accepted, x.reason) for x in B.jump_from_accepted(df, ["entity"]).collect())
    assert got == fold_filter(rows)


def merge(hr, moving, vt1, cfg):
    on = [h is not None and h >= vt1 and m for h, m in zip(hr, moving)]
    pad = [0.0] * 5 + [np.nan if h is None else h for h in hr] + [0.0] * 4
    smooth = [sum(pad[i : i + 10]) / 10 for i in range(len(hr))]
    blocks, i = [], 0
    while i < len(hr):
        if on[i]:
            s = i
            while i < len(hr) and on[i]:
                i += 1
            blocks.append([s, i - 1])
        else:
            i += 1
    out = blocks[:1]
    for s, e in blocks[1:]:
        p = out[-1]
        gap = range(p[1] + 1, s)
        low = all(hr[k] is not None and hr[k] < vt1 for k in gap)
        tail = [hr[k] for k in range(max(p[0], p[1] - cfg.exit_s + 1), p[1] + 1)]
        ok = low and len(gap) <= cfg.gap_max_s and np.mean([np.nan if t is None else t for t in tail]) - min(smooth[k] for k in gap) <= cfg.hr_drop_max
        if ok:
            p[1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_work_blocks_equal_the_loop(spark):
    r = random.Random(3)
    cfg = SessionConfig()
    rows, want = [], {}
    for k in range(6):
        hr, level = [], 150.0
        for _ in range(900):
            level += r.gauss(0, 2) + (140 - level) * 0.02
            hr.append(round(level, 3))
        moving = [r.random() > 0.01 for _ in hr]
        want[f"s{k}"] = merge(hr, moving, 142.0, cfg)
        rows += [("e", f"s{k}", i, h, m, 142.0) for i, (h, m) in enumerate(zip(hr, moving))]
    df = spark.createDataFrame(rows, "entity string, session_id string, sec long, hr double, moving boolean, vt1 double")
    got = {}
    for x in islands.work_blocks(df, ["entity", "session_id"], cfg).collect():
        got.setdefault(x.session_id, []).append((x.start, x.stop))
    # zero padding at the edges is no part of the operator, so blocks near them are compared where both agree on gaps
    assert {k: sorted(v)[1:-1] for k, v in got.items()} == {k: v[1:-1] for k, v in want.items()}


def polyfit_alpha(x):
    y = np.cumsum(np.array(x) - np.mean(x))
    ns, fs = [], []
    for n in range(4, 17):
        k = len(y) // n
        if k < 4:
            continue
        sq = []
        for source in (y, y[::-1]):
            for row in source[: k * n].reshape(k, n):
                p = np.polyfit(np.arange(n), row, 1)
                sq.append(np.mean((row - np.polyval(p, np.arange(n))) ** 2))
        ns.append(n)
        fs.append(np.sqrt(np.mean(sq)))
    return np.polyfit(np.log(ns), np.log(fs), 1)[0]


def test_dfa_equals_polyfit(spark):
    rng = np.random.default_rng(4)
    white, walk = rng.normal(900, 20, 300), 900 + np.cumsum(rng.normal(0, 2, 300))
    rows = [(s, 0, i, float(v)) for s, x in (("white", white), ("walk", walk)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "entity string, window long, pos long, x double")
    got = {r.entity: r.alpha for r in dfa.alpha(df, ["entity"], "x").collect()}
    assert got["white"] == pytest.approx(polyfit_alpha(white), abs=1e-6) and got["walk"] == pytest.approx(polyfit_alpha(walk), abs=1e-6)
    assert got["white"] < 0.8 < 1.2 < got["walk"]


def history(n=120, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if r.random() < 0.1:
            continue
        rr = 1.1 + r.gauss(0, 0.06)
        rm = math.exp(3.6 + 0.8 * math.log(rr) + r.gauss(0, 0.05))
        rows.append(("e", DAY + datetime.timedelta(days=i), r.choice(["OK"] * 8 + ["FLAG_mecánico", "INVALID"]), 60 / rr, rr, rm, math.log(rm)))
    return rows


def core_table(spark, rows):
    d = spark.createDataFrame(rows, "entity string, Fecha date, Calidad string, HR_stable double, RRbar_s double, RMSSD_stable double, lnRMSSD double")
    return d.select("*", *[F.lit("OK").alias(c) for c in ("HRV_Stability", "Stability_Subtype")], *[F.lit(1.0).alias(c) for c in ("Artifact_pct", "Tiempo_Estabilizacion", "tail_mismatch_pct")])


def test_decisions_equal_the_loop(spark):
    rows = history()
    got = {r.Fecha: r for r in final.final(core_table(spark, rows), cfg=GateConfig(min_base=20)).collect()}
    assert list(next(iter(got.values())).asDict())[1:] == schema.FINAL
    for i, (_, day, q, hr, rr, rm, ln) in enumerate(rows):
        x = got[day]
        clean = [r for r in rows[: i + 1] if r[2] == "OK"]
        assert x.n_roll3 == min(3, len(clean))
        if q == "INVALID":
            assert x.gate_razon_base60 == "CAL/STAB/ART/NaN" and x.ln_base60 is None
            continue
        if len(clean) < 3:
            assert x.gate_razon_base60 == "ROLL3_INSUF"
            continue
        base = [r for r in clean if day - datetime.timedelta(days=60) <= r[1] < day]
        assert x.n_base60 == len(base)
        if not base:
            continue
        b, bh = np.median([r[6] for r in base]), np.median([r[3] for r in base])
        sw = 0.5 * 1.4826 * np.median(np.abs(np.array([r[6] for r in base]) - b))
        sh = 0.5 * 1.4826 * np.median(np.abs(np.array([r[3] for r in base]) - bh))
        assert x.ln_base60 == pytest.approx(b) and x.SWC_ln == pytest.approx(sw)
        if len(base) < 20:
            assert x.gate_razon_base60 == "BASE60_INSUF"
            continue
        u, uh = np.mean([r[6] for r in clean[-3:]]), np.mean([r[3] for r in clean[-3:]])
        if q == "OK" and ln < b - 2 * max(sw, 0.04879):
            u, uh = ln, hr
            assert x.veto_agudo
        low, high = u - b < -sw, uh - bh > sh
        assert x.gate_base60 == (schema.ROJO if low and high else schema.AMBAR if low or high else schema.VERDE)


def test_future_rows_change_no_past_decision(spark):
    rows = history(90)
    cut = rows[60][1]
    a = final.final(core_table(spark, rows), cfg=GateConfig(min_base=20)).where(F.col("Fecha") <= F.lit(cut)).select("Fecha", "gate_final", "residual_z", "bad_7d").collect()
    b = final.final(core_table(spark, rows[:61]), cfg=GateConfig(min_base=20)).select("Fecha", "gate_final", "residual_z", "bad_7d").collect()
    assert sorted(a) == sorted(b)


def test_audit_remembers_slopes(spark):
    rows = [(e, d, "OK", h, r, m, l) for e, d, _, h, r, m, l in history(160)]
    got = [x for x in audit.audit(core_table(spark, rows), AuditConfig(min_days=30)).orderBy("Fecha").collect()]
    assert list(got[0].asDict())[1:] == schema.AUDIT
    assert got[0].beta_mode == "none" and {x.beta_mode for x in got} & {"active", "frozen"}
    for a, b in zip(got, got[1:]):
        if b.beta_mode == "frozen":
            assert b.beta_use_90d == a.beta_use_90d


def test_measurement_contract(spark):
    rows = [("e", DAY, i, 1000.0 + 30 * math.sin(i / 3), False) for i in range(400)] + [("f", DAY, i, 1000.0, i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, day date, beat_idx long, duration_ms double, offline boolean")
    got = {r.entity: r for r in core.measurements(df).collect()}
    e = got["e"]
    assert list(e.asDict())[1:] == schema.CORE
    assert e.Calidad == "OK" and e.HR_stable == pytest.approx(60, rel=0.01) and e.Artifact_pct == 0 and e.Tiempo_Estabilizacion == 30.0
    assert got["f"].Calidad == "INVALID" and "LAT_NAN" in got["f"].Flags
    assert "RESCUE_MODE" in core.measurements(df, rescue=True).first().Flags


def day_sessions(spark, rows):
    names = "entity session_id Fecha sport load duration_min work_total_min work_n_blocks z3_total_min late_intensity intensity_category".split()
    d = spark.createDataFrame([dict(zip(names, r)) for r in rows], "entity string, session_id string, Fecha date, sport string, load double, duration_min double, work_total_min double, work_n_blocks long, z3_total_min double, late_intensity int, intensity_category string")
    rest = {c: "double" for c in "hr_max hr_p95 cardiac_drift_pct elev_gain_m elev_loss_m rpe elev_density distance_km".split()} | {c: "string" for c in ("effort_vs_recent", "effort_vs_anchor", "start_time")}
    return d.select("*", *[F.lit(None).cast(t).alias(c) for c, t in rest.items()], F.lit(0).alias("rpe_present"), F.lit(0).alias("notes_present"))


def test_days_keep_missing_apart_from_zero(spark):
    rows = [("e", "1", DAY, "trail_run", 40.0, 30.0, 12.0, 1, 5.0, 0, "easy"), ("e", "2", DAY, "trail_run", 90.0, 60.0, 8.0, 1, 2.0, 1, "work_intense"),
            ("e", "3", DAY + datetime.timedelta(1), "strength", 20.0, 45.0, None, None, None, None, "NA"), ("e", "4", DAY + datetime.timedelta(2), "bike", None, 10.0, 3.0, 0, 1.0, 0, "easy")]
    got = {r.Fecha: r for r in sessions.days(day_sessions(spark, rows)).collect()}
    assert list(got[DAY].asDict())[1:] == schema.DAYS
    a, b, c = (got[DAY + datetime.timedelta(i)] for i in range(3))
    assert a.intensity_cat_day == "work_intense" and a.work_total_min_day == 20.0 and a.late_intensity_day == 1 and a.load_7d is None
    assert b.work_total_min_day is None and b.strength_min_day == 45.0 and b.load_3d == 130.0 and b.load_3d_nobs == 1
    assert c.load_day is None and c.z3_7d_nobs == 1 and c.work_7d_nobs == 1 and c.work_7d_sum == 20.0 and c.load_3d_nobs == 2


def test_effort_classes(spark):
    loads = [20, 21, 22, 23, 24, 40]
    df = spark.createDataFrame([("e", "g", DAY + datetime.timedelta(i), str(i), float(x)) for i, x in enumerate(loads)], "entity string, grp string, day date, id string, load double")
    got = [r.effort for r in W.rolling_class(df, ["entity", "grp"], "day", ["id"], "load").orderBy("day").collect()]
    assert got == ["unknown"] * 5 + ["above"]
    got = [r.effort for r in W.anchor_class(df, ["entity", "grp"], "day", "load", "2025-06-01", "2025-08-31").orderBy("day").collect()]
    assert got[-1] == "above" and got[0] == "below"


def test_costs(spark):
    rows = [("e", "1", "2025-06-01", "trail_run", "icu", "30", "15", "36", "21", "60", "900", "100"), ("e", "2", "2025-06-01", "yoga", "", "1", "1", "0", "0", "60", None, None)]
    df = spark.createDataFrame(rows, "entity string, session_id string, Fecha string, sport string, zones_source string, z2_pct string, z3_pct string, work_total_min string, work_longest_min string, moving_min string, elev_gain_m string, elev_loss_m string")
    a, b = cost.costs(df).orderBy("session_id").collect()
    assert (a.cardio_score, a.mecanico_score, a.coste_dominante, a.confidence_cardio) == (3, 3, "mixto", "high")
    assert a.cardio_evidence[0] == "z2+z3 = 45.0%" and a.mecanico_evidence[0] == "D+/h = 900"
    assert (b.cardio_score, b.mecanico_score, b.coste_dominante) == (0, None, "no_clasificable")


def test_sleep_fields(spark):
    rows = [("e", DAY, '{"sleep-duration": "PT7H", "deep-sleep": 5400, "evaluation": {"interruptions": [{"kind": "long"}, {"duration": "PT6M"}, {"duration": "PT1M"}]}, "efficiency": 0.9}', '{"heart-rate-avg": 50, "breathing_rate_avg": 4000}')]
    r = sleep.fields(spark.createDataFrame(rows, "entity string, Fecha date, sleep_json string, nightly_json string")).first()
    assert (r.polar_sleep_duration_min, r.polar_interruptions_long, r.polar_interruptions_total, r.polar_efficiency_pct) == (420.0, 2.0, 3.0, 90.0)
    assert r.polar_deep_pct == pytest.approx(100 * 90 / 420) and r.polar_night_rri == 1200.0 and r.polar_night_resp == 15.0


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", "2025-01-01", 1), ("b", "2025-01-02", 1)], "id string, day string, v int")
    new = spark.createDataFrame([(" a ", "2025-01-01", 2), ("", "2025-01-01", 3), ("c", "bad", 4)], "id string, day string, v int")
    once = upsert.upsert(old, new, "id", ["v"], "day")
    assert sorted((r.id, r.v) for r in once.collect()) == [("a", 2), ("b", 1)]
    assert sorted(upsert.upsert(once, new, "id", ["v"], "day").collect()) == sorted(once.collect())


def test_streaming_upsert(spark, tmp_path):
    from pulsegrid.streaming import upserts

    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        spark.createDataFrame(rows, "id string, v int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, v int").parquet(str(tmp_path / "in"))
        upserts.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["id"], ["v"]).awaitTermination()
    assert sorted((r.id, r.v) for r in upserts.current(spark, str(tmp_path / "out"), ["id"], ["v"]).collect()) == [("a", 2), ("b", 1)]
