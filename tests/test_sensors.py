"""Sensor recordings as a whole, clocks, validation and the tables around sleep and activities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import beats as B
from pulsegrid.plans import contracts, sensors, sessions, sleep

PACKET = "entity string, rec string, phone double, device double"


def test_clock_is_not_bent_by_late_stamps(spark):
    r = random.Random(3)
    rows = []
    for rec, scale, offset in (("a", 1.0004, 1.7e9), ("b", 0.999, -3.0)):
        rows += [("e", rec, offset + scale * t + (r.uniform(0.5, 9) if r.random() < 0.2 else r.gauss(0, 0.002)), float(t)) for t in range(0, 3600, 2)]
    rows += [("e", "two", 10.0, 1.0), ("e", "two", 12.0, 2.0), ("e", "same", 4.0, 1.0), ("e", "same", 4.0, 1.0), ("e", "same", 5.0, 1.0), ("e", "gone", None, 1.0)]
    got = {x.rec: (x.scale, x.offset) for x in sensors.clock(spark.createDataFrame(rows, PACKET)).collect()}
    assert got.keys() == {"a", "b", "two", "same"}
    assert got["a"][0] == pytest.approx(1.0004, abs=1e-6) and got["a"][1] == pytest.approx(1.7e9, abs=0.01)
    assert got["b"][0] == pytest.approx(0.999, abs=1e-6) and got["b"][1] == pytest.approx(-3.0, abs=0.01)
    assert got["two"] == (1.0, 9.5) and got["same"] == (1.0, 3.0)


def test_a_pair_of_recordings_on_one_axis(spark):
    """Beats a second apart but for one early one, motion in the middle, breath of 0.25 Hz, clocks that drift apart."""
    fs, n, T = 50, 90, 1.7e9
    t = np.arange(0, n, 1 / fs)
    peaks_at = [*range(2, 50), 50.3, *range(52, n - 1)]
    wave = sum(np.exp(-(((t - p) / 0.03) ** 2)) for p in peaks_at)
    moving = (t > 60) & (t < 66)
    r = np.random.default_rng(1)
    shake = np.where(moving, r.normal(0, 800, len(t)), 0)
    breath = 20 * np.sin(2 * np.pi * 0.25 * t)
    ecg = [("e", "r", int((T + x) * 1e9), float(v)) for x, v in zip(t, wave)]
    acc = [("e", "r", int((T - 500 + x / 1.0002) * 1e3), float(b + s), float(s), 0.0) for x, b, s in zip(t, breath, shake)]
    packets = [("e", "r", T + x + 100.0, T + x) for x in range(0, n, 2)]
    other = [("e", "r", T + x + 100.0, T - 500 + x / 1.0002) for x in range(0, n, 2)]
    got = sensors.convert(
        spark.createDataFrame(ecg + ecg[:5] + [("e", "short", 1, 1.0)], "entity string, rec string, ts long, voltage double"), spark.createDataFrame(acc, "entity string, rec string, ts long, x double, y double, z double"),
        spark.createDataFrame(packets, PACKET), spark.createDataFrame(other, PACKET), gate=True)
    beats = got.beats.orderBy("beat_idx").collect()
    assert len(beats) == len(peaks_at) - 1 and all(abs(b.t_end - T - 100 - p) <= 0.2 for b, p in zip(beats, peaks_at[1:]))
    assert "DELTA_RR_GT_20P" in {b.reason for b in beats if 50 < b.t_end - T - 100 < 53}
    assert {b.reason for b in beats if 60.5 < b.center - T - 100 < 65.5} == {"ACC_HIGH_MOTION"} and sum(b.reason != "OK" for b in beats if T + 105 < b.center < T + 145) <= 6
    assert all(b.offline == int(b.reason != "OK") for b in beats)
    assert any(w.high for w in got.motion.collect() if T + 159 <= w.start <= T + 166)
    still = [x for x in got.respiration.collect() if T + 100 <= x.k * 5 <= T + 125]
    assert still and all(x.axis == "x" and abs(x.frequency - 0.25) < 0.021 for x in still)
    s = got.summary.collect()
    assert [(x.rec, x.rows, x.ok, round(x.fs_ecg), round(x.fs_acc)) for x in s] == [("r", len(beats), True, 50, 50)]


def test_axes_of_equal_power_in_short_windows(spark):
    """Of axes that move by the same amount, up or down, the first one by name counts, whatever rounding says."""
    rows = [("e", str(i), 35.0 * i + j + 0.5, 0.1, y / 2, 6.0 - y / 2) for i in range(60) for j, y in enumerate((i % 7, i % 5 + 7, i % 3)[: 2 + i % 2])]
    got = sensors.dominant_frequency(spark.createDataFrame(rows, "entity string, rec string, t double, x double, y double, z double"), ["x", "y", "z"]).collect()
    assert len(got) == 60 * 6 and {r.axis for r in got} == {"y"}


def test_spectra_of_windows_are_those_of_a_loop(spark):
    """Recordings over several blocks of windows, with gaps and nulls, against the sums taken window by window."""
    r = random.Random(8)
    own = {(e, t / 4): [r.gauss(100, 3), None if r.random() < 0.2 else r.gauss(0, 3), 7.0] for e in "ab" for t in range(4000) if t % 900 < 700 and r.random() < 0.5}
    rows = [(e, "r", t, *v) for (e, t), v in own.items()]
    r.shuffle(rows)
    found = sensors.dominant_frequency(spark.createDataFrame(rows, "entity string, rec string, t double, x double, y double, z double"), ["x", "y", "z"], 0.08, 0.30, block=7)
    got = {(x.entity, x.k): x for x in found.collect()}
    grid = np.round(0.08 + 0.02 * np.arange(12), 6)
    for e in "ab":
        for k in range(-5, 200):
            told = []
            for i, axis in enumerate("xyz"):
                at = [(t, v[i]) for (o, t), v in own.items() if o == e and 5 * k <= t < 5 * k + 30 and v[i] is not None]
                if at:
                    t, x = np.array(at).T
                    p = abs((x - x.mean()) @ np.exp(2j * np.pi * t[:, None] * grid)) ** 2
                    told.append((p.sum(), axis, grid[p.argmax()], p.max() / np.median(p)))
            if told:
                _, axis, f, c = max(told)
                x = got.pop((e, k))
                assert (x.axis, x.frequency) == (axis, f) and x.confidence == pytest.approx(c) and x.per_minute == pytest.approx(60 * f)
    assert not got


def test_percentiles_of_nights_read_a_document_once(spark):
    cols = "entity string, " + ", ".join(f"{c} double" for c in sleep.SLEEP_FIELDS + sleep.NIGHT_FIELDS) + ", Fecha int"
    none = [None] * (len(sleep.SLEEP_FIELDS + sleep.NIGHT_FIELDS))
    at = [(sleep.SLEEP_FIELDS + sleep.NIGHT_FIELDS).index(c) for c in ("polar_sleep_duration_min", "polar_interruptions_long")]
    rows = []
    for i, (e, d, n) in enumerate([("a", 400.0, 1.0), ("a", 500.0, None), ("a", None, 3.0), ("b", None, None), (None, 300.0, 1.0)]):
        own = none[:]
        own[at[0]], own[at[1]] = d, n
        rows.append((e, *own, i))
    got = sleep.with_percentiles(spark.createDataFrame(rows, cols))
    told = {x.Fecha: (x.sleep_dur_p10, x.sleep_dur_p90, x.sleep_int_p90) for x in got.collect()}
    assert told[0] == told[1] == told[2] == pytest.approx((410.0, 490.0, 2.8)) and told[3] == told[4] == (None, None, None)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_what_is_told_of_a_recording_needs_no_join(spark):
    """Medians stand beside the samples by windows; a join would make the samples anew on each side."""
    s = spark.createDataFrame([("e", "r", 1.0, 2.0)], "entity string, rec string, t double, x double")
    packets = s.select("entity", "rec", F.col("t").alias("phone"), F.col("x").alias("device"))
    for got in (sensors.unit_seconds(s.withColumnRenamed("t", "ts"), "ts"), sensors.peaks(s, "x"), sensors.motion(s, "x", "x", "x"), sensors.clock(packets)):
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_validation_names_what_is_wrong(spark):
    rows = [("good", "800", "0"), ("good", "2500", "1"), ("bad", "x", "2"), ("bad", "-1", None)]
    got = {x.k: x for x in B.validate(spark.createDataFrame(rows, "k string, duration string, offline string"), ["k"]).collect()}
    assert (got["good"].ok, got["good"].issues, got["good"].rows, got["good"].offline_pct, got["good"].out_of_range) == (True, [], 2, 50.0, 1)
    assert not got["bad"].ok and len(got["bad"].issues) == 4
    lacking = B.validate(spark.createDataFrame(rows, "k string, duration string, flag string"), ["k"]).first()
    assert not lacking.ok and "no column offline" in lacking.issues


def test_activity_fields_of_the_last_and_the_hardest(spark):
    cols = "k string, i int, load double, intensity double, moving_time_s double, avg_hr double, max_hr double, atl double, ctl double, tsb double, rpe double, resting_hr double, type string, started timestamp"
    import datetime as d

    at = lambda h: d.datetime(2024, 1, 1, h)
    rows = [("a", 1, 50.0, None, 600.0, 120.0, 150.0, 1.0, 2.0, 3.0, 4.0, 5.0, "run", at(9)), ("a", 2, 50.0, 80.0, None, None, 160.0, None, 9.0, 9.0, 9.0, 9.0, "bike", at(9)), ("a", 3, None, 70.0, 300.0, 100.0, None, 7.0, 7.0, 7.0, 7.0, 7.0, "walk", None),
            ("b", 1, None, None, None, None, None, None, None, None, None, None, "none", None)]
    got = {x.k: x for x in sessions.activity_fields(spark.createDataFrame(rows, cols), ["k"], "i").collect()}
    a = got["a"]
    assert (a.n_acts, a.load, a.load_max, a.intensity_max, a.duration_min, a.avg_hr, a.max_hr, a.type_main, a.atl, a.resting_hr) == (3, 100.0, 50.0, 80.0, 15.0, 110.0, 160.0, "run", 1.0, 5.0)
    assert (got["b"].n_acts, got["b"].load, got["b"].type_main, got["b"].ctl) == (1, None, "none", None)


def test_the_measurement_of_a_day(spark):
    base = {"entity": "e", "Fecha": "d", "Calidad": "OK", "HRV_Stability": "OK", "Tiempo_Estabilizacion": 100.0, "duration_s": 300.0, "Artifact_pct": 1.0, "time": "07:00", "file": "b"}
    worse = [{"Calidad": "INVALID"}, {"Calidad": "FLAG_mecánico"}, {"HRV_Stability": "Unstable"}, {"Tiempo_Estabilizacion": None}, {"duration_s": 200.0}, {"Artifact_pct": 2.0}, {"time": "08:00"}, {"file": "c"}]
    schema = "entity string, Fecha string, Calidad string, HRV_Stability string, Tiempo_Estabilizacion double, duration_s double, Artifact_pct double, time string, file string"
    for i, one in enumerate(worse):
        rows = [{**base, **one, "Fecha": str(i), **({} if "file" in one else {"file": "a"})}, {**base, "Fecha": str(i)}]
        assert contracts.best_measurement(spark.createDataFrame([tuple(x.values()) for x in rows], schema)).first().file == "b"


def test_older_sleep_exports(spark):
    rows = [("e", f"2024-01-{i:02}", "PT7H30M" if i > 1 else "7.5", 80 + i, 2.0) for i in range(1, 25)] + [("few", "2024-01-01", "PT8H", 1, 3.0)]
    export = spark.createDataFrame(rows, "entity string, Fecha string, asleep_duration string, sleep_score int, efficiency_pct double")
    got = {(x.entity, x.Fecha): x for x in sleep.history(export).collect()}
    first, other, few = got["e", "2024-01-01"], got["e", "2024-01-02"], got["few", "2024-01-01"]
    assert first.polar_sleep_duration_min is None and other.polar_sleep_duration_min == 450 and other.polar_sleep_score == 82 and other.polar_efficiency_pct == 2.0
    assert other.sleep_dur_p10 == 450 and other.sleep_int_p90 is None and few.sleep_dur_p10 is None and few.polar_sleep_duration_min == 480


def test_why_there_is_no_heart_rate_at_the_level(spark):
    from pulsegrid.config import LevelConfig
    from pulsegrid.plans import analysis

    r = random.Random(4)
    line = lambda slope, noise, n=60: [(120 + i % 20 * 2.0, 0.75 - slope * (120 + i % 20 * 2.0 - 140) + r.uniform(-noise, noise)) for i in range(n)]
    cases = {
        "ok": line(0.02, 0.01), "few": line(0.02, 0.01, 10), "constant": [(140.0, 0.7 + i % 5 / 10) for i in range(30)], "rising": line(-0.02, 0.01), "weak": line(0.006, 0.25), "bins": [(120.0 + i % 3 * 3, 1 - i % 3 * 0.2) for i in range(30)],
        "flat": line(0.002, 0.001), "above": [(h, a + 0.5) for h, a in line(0.02, 0.01)], "gate": line(0.02, 0.01), "none": []}
    rows = [("e", name, h, a, True) for name, own in cases.items() for h, a in own] + [("e", "ok", None, 0.1, True), ("e", "ok", 90.0, 9.0, False)]
    windows = spark.createDataFrame(rows, "entity string, session_id string, hr double, alpha double, usable boolean")
    gates = spark.createDataFrame([("e", name, "DFA_LIMITED" if name == "gate" else "DFA_OK") for name in cases], "entity string, session_id string, state string")
    got = {x.session_id: x for x in analysis.levels(windows, gates, LevelConfig()).collect()}
    want = {"ok": "ok", "few": "too_few_dfa_windows_with_hr", "constant": "non_finite_hr_alpha1_correlation", "rising": "alpha1_does_not_decrease_with_hr", "bins": "too_few_hr_bins", "flat": "alpha1_too_flat_across_hr",
            "above": "no_local_alpha1_075_bracketing_bins", "gate": "dfa_gate_dfa_limited", "none": "too_few_dfa_windows_with_hr"}
    assert {k: got[k].strict.reason for k in want} == want
    assert got["weak"].strict.reason.startswith("weak_raw_hr_alpha1_relation_r2_0.")
    assert got["ok"].strict.rate == pytest.approx(140, abs=1.5) and got["ok"].strict.r2 > 0.9 and got["ok"].strict.slope < 0
    assert got["ok"].approx.confidence in ("approximate", "low") and got["ok"].approx.rate == pytest.approx(140, abs=2)
    assert got["above"].approx.reason == "insufficient_windows_bracketing_075" and got["few"].strict.rate is None and got["gate"].approx.rate is None


def test_a_missing_duration_makes_the_time_axis_untrusted(spark):
    from pulsegrid.plans import analysis

    beats = [("e", s, i, 800.0 + (i * 7919 % 13), False) for s in ("good", "bad") for i in range(1, 1500)] + [("e", "bad", 1500, None, False)]
    hr = [("e", s, t, 100.0 + t % 60) for s in ("good", "bad") for t in range(1300)]
    sessions_ = [("e", s, 20.0, "cardio") for s in ("good", "bad", "none")]
    got = {x.session_id: x for x in analysis.analyse(
        spark.createDataFrame(beats, "entity string, session_id string, beat_idx long, duration_ms double, offline boolean"), spark.createDataFrame(hr, "entity string, session_id string, sec long, hr double"),
        spark.createDataFrame(sessions_, "entity string, session_id string, duration_min double, dominant string")).collect()}
    assert got["good"].axis_ok and got["good"].gate == "DFA_OK" and got["good"].alpha_z1 is not None
    assert not got["bad"].axis_ok and got["bad"].gate == "DFA_LIMITED" and got["bad"].gate_reason.startswith("time_axis_compromised") and got["bad"].alpha_z1 is None
    assert got["bad"].evidence == ["dfa_gate = DFA_LIMITED", "rmssd_1min usable"] and got["bad"].modifier == "soften" and got["bad"].alpha_median == got["good"].alpha_median
    assert got["none"].modifier == "unavailable" and got["none"].note == "Sessions sugiere `cardio`; RR no fue interpretable"
