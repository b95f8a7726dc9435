"""Contracts, reports, readers and plans in small cases that the given tables don't hold."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pulsegrid.functions import parse, rules
from pulsegrid.operators import joins
from pulsegrid.plans import contracts, core, sleep
from pulsegrid.sources import readers
from pulsegrid.streaming import upserts


def violated(df):
    return {r.rule: r.n_violations for r in df.collect() if r.n_violations}


def test_core_contract(spark):
    rows = [("a", "2024-01-01", "OK", "OK", 60.0, 1.0), ("a", "2024-01-01", "bad", "OK", 60.0, 1.2), ("b", None, "INVALID", None, None, 1.0)]
    df = spark.createDataFrame(rows, "entity string, Fecha string, Calidad string, HRV_Stability string, HR_stable double, RRbar_s double")
    assert violated(contracts.contract(df, ["entity", "Fecha"], contracts.core_rules())) == {"day": 1, "quality": 1, "stability": 1, "units": 1, "unique": 3}
    empty = contracts.contract(df.limit(0), ["entity", "Fecha"], contracts.core_rules(), df.columns[1:])
    assert violated(empty) == {} and {r.n_rows for r in empty.collect()} == {0}


def test_session_and_day_contract(spark):
    s = spark.createDataFrame([("s1", "endurance_easy", 50.0, 30.0, 20.0, 10.0, 9.0, 12.0), ("s2", "strength", None, None, None, 99.0, 1.0, 100.0), ("s3", "endurance_hard", None, 1.0, 1.0, 1.0, 2.0, 1.0)], "session_id string, session_group string, z1_pct double, z2_pct double, z3_pct double, work_total_min double, moving_min double, work_longest_min double")
    assert violated(contracts.contract(s, ["session_id"], contracts.session_rules())) == {"zones": 1, "work_moving": 1, "work_longest": 1}
    d = spark.createDataFrame([(1, 3), (2, 4), (3, None)], "k int, load_3d_nobs int")
    assert violated(contracts.contract(d, ["k"], contracts.day_rules([("load_3d_nobs", 3)]))) == {"load_3d_nobs": 1}


def test_agreement_and_cost(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0), (4, None)], "k int, v double")
    assert violated(contracts.agreement(a, b, ["k"], ["v"])) == {"same_keys": 2, "v": 1}
    got = {r.k: (r.cost.usable, r.cost.reason, r.cost.v) for r in contracts.attach_cost(a.select("k"), a.where("k = 2"), ["k"], ["v"]).collect()}
    assert got == {1: (False, "session_not_found", None), 2: (True, None, 2.0), 3: (False, "session_not_found", None)}


def test_exercises_and_best_recording(spark):
    df = spark.createDataFrame([(1, "2024-01-05", "run", 10.0), (2, None, "run", None), (3, "2024-02-05", "run", 10.0), (4, "2024-01-06", "Run", 10.0), (5, "2024-01-07", "run", 99.0)], "k int, d string, s string, m double")
    got = contracts.exercises(df.withColumn("d", F.to_date("d")), "d", "s", "m", "2024-01-01", "2024-01-31", ["run"], 60.0, ["k"])
    assert [r.k for r in got.collect()] == [1, 2]
    files = spark.createDataFrame([(1, True, False, 9, "a"), (1, False, False, 1, "b"), (1, False, True, 1, "d"), (1, False, True, 1, "c")], "day int, archived boolean, converted boolean, changed int, name string")
    assert [r.name for r in contracts.best_recording(files, ["day"], "archived", "converted", "changed", "name").collect()] == ["c"]


def test_parsing(spark):
    df = spark.createDataFrame([("2024-07-01T10:00:00Z", "a/ECG_01.json", " ámbar-"), ("2024-07-01T10:00:00", "acc.txt", "NO"), ("no", "eccg", None)], "t string, n string, g string")
    got = df.select(parse.local_time("t", "America/New_York").cast("string").alias("t"), parse.sensor_and_key("n").alias("s"), rules.gate_family("g").alias("g")).collect()
    assert [(r.t, r.s.sensor, r.s.key, r.g) for r in got] == [("2024-07-01 06:00:00", "ecg", "01", "ÁMBAR"), ("2024-07-01 10:00:00", "acc", "default", "NO"), (None, None, None, None)]


def test_nested_sleep_keys(spark):
    docs = [
        {"result": [{"x": 1}, {"night": {"Sleep-Duration": "PT7H", "deep": {"DEEP_SLEEP": 90, "efficiency": " "}}}], "efficiency": None, "more": {"efficiency": 0.9}},
        [{"sleep_duration": 400}],  # no object
        {"a": {"sleep_score": 1, "deep_sleep": 10}, "b": {"sleep_score": 2}, "sleep-duration": True, "c": "{\"deep_sleep\": 99}"},  # the last container first; text is no container
        {"b": {"sleep-score": 5}, "sleep_score": {"value": 7}},  # a value that holds others counts, and is no number
        {"x": {"y": {"z": {"deep": {"deeper": {"sleep_span": 7200000}}}}}},
    ]
    raw = spark.createDataFrame([("e", f"2024-01-0{i + 1}", json.dumps(d), None) for i, d in enumerate(docs)] + [("e", "2024-01-09", "not json", "{}")], "entity string, Fecha string, sleep_json string, nightly_json string")
    got = {r.Fecha[-1]: r for r in sleep.fields(raw).collect()}
    assert got["1"].polar_sleep_duration_min == 420 and got["1"].polar_efficiency_pct == 90
    assert abs(got["1"].polar_deep_pct - 100 * 90 / 420) < 1e-9
    assert all(v is None for k in "29" for c, v in got[k].asDict().items() if c not in ("entity", "Fecha"))
    assert got["3"].polar_sleep_score == 2 and got["3"].polar_sleep_duration_min == 10
    assert got["4"].polar_sleep_score is None and got["5"].polar_sleep_span_min == 120


def test_interruptions_as_vendors_send_them(spark):
    cases = [
        ({"evaluation": {"interruptions": {"longCount": 2, "totalCount": "5"}}}, 2, 5),
        ({"sleep-evaluation": {"sleep-interruptions": {"long_count": 1, "count": 4}}}, 1, 4),
        ({"evaluation": None, "sleep_evaluation": {"interruptions": [{"type": "LONG"}, {"x": {"interruption_type": "a long one"}}, {"kind": "short", "duration": "PT5M"}, {"duration": 4.9}, {"interruption_duration": 600000}, "long", 3]}}, 4, 5),
        ({"evaluation": {"interruptions": []}, "number_of_interruptions": 7, "x": [{"sleep_long_interruptions": "3,5"}]}, 3.5, 7),
        ({"evaluation": {"interruptions": {"longCount": "n/a"}}, "y": {"interruptions_count": True, "interruptions_total": 6}}, None, 6),
        ({"evaluation": [{"interruptions": {"longCount": 2}}]}, 2, None),  # found as a count anywhere
        ({"interruptions": [{"kind": "long"}]}, None, None),
        ({"evaluation": "none"}, None, None),
    ]
    rows = [("e", str(i), json.dumps(d), None) for i, (d, _, _) in enumerate(cases)]
    got = {int(r.Fecha): r for r in sleep.fields(spark.createDataFrame(rows, "entity string, Fecha string, sleep_json string, nightly_json string")).collect()}
    assert [(got[i].polar_interruptions_long, got[i].polar_interruptions_total) for i in range(len(cases))] == [c[1:] for c in cases]


def test_nightly_fields(spark):
    docs = [{"breathing-rate-avg": 4000, "hr_avg": 50}, {"nightly_resp": 200, "nightly_rri": "1.100,5"}, {"nightly_resp": "x", "deep": {"nightly_resp_int": 14}, "heart-rate-avg": 0}, {"nightly_resp": 0}]
    raw = spark.createDataFrame([("e", str(i), None, json.dumps(d)) for i, d in enumerate(docs)], "entity string, Fecha string, sleep_json string, nightly_json string")
    got = sorted((r.Fecha, r.polar_night_resp, r.polar_night_rri) for r in sleep.fields(raw).collect())
    assert got == [("0", 15.0, 1200.0), ("1", 200.0, None), ("2", 14.0, None), ("3", None, None)]


def test_beat_files_of_several_people(spark, tmp_path):
    for who, beat in (("ann", 800), ("bob", 900)):
        (tmp_path / who).mkdir()
        (tmp_path / who / "2024-01-01_RR.csv").write_text(f"duration,offline\n{beat},0\n{beat},1\n")
    got = {(r.entity, str(r.day), r.duration_ms, r.offline) for r in readers.beat_files(spark, str(tmp_path)).collect()}
    assert got == {(w, "2024-01-01", d, o) for w, d in (("ann", 800.0), ("bob", 900.0)) for o in (False, True)}
    assert {(r.folder, r.name) for r in readers.listing(spark, str(tmp_path), "*.csv").collect()} == {("ann", "2024-01-01_RR.csv"), ("bob", "2024-01-01_RR.csv")}


def test_runs_with_new_checkpoints_overwrite_nothing(spark, tmp_path):
    for run, ids in enumerate(([1, 2], [2, 3])):
        source = tmp_path / f"in{run}"
        spark.createDataFrame([(i, run) for i in ids], "id int, v int").write.parquet(str(source))
        stream = spark.readStream.schema("id int, v int").parquet(str(source))
        upserts.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / f"cp{run}"), ["id"], ["v"]).awaitTermination()
    assert {(r.id, r.v) for r in upserts.current(spark, str(tmp_path / "out"), ["id"], ["v"]).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_measurements_deal_beats_once(spark):
    beats = spark.createDataFrame([("e", "2024-01-01", i, 900.0 + i % 7 * 10, False) for i in range(400)], "entity string, day string, beat_idx long, duration_ms double, offline boolean")
    df = core.measurements(beats)
    assert df.count() == 1
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") <= 8


def test_interpolation_at_the_ends(spark):
    p = spark.createDataFrame([("a", 0.5, 1), ("a", 3.0, 2), ("a", 9.0, 3), ("b", 1.0, 4)], "k string, at double, id int")
    s = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 20.0), ("a", 3.0, None), ("a", 5.0, 40.0)], "k string, t double, v double")
    got = {r.id: r.v for r in joins.interpolate(p, s, ["k"], "at", "t", "v").collect()}
    assert got == {1: 15.0, 2: 30.0, 3: None, 4: None}
