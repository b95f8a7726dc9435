"""Readers and writers on small files of the shapes they are for."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import parse
from pulsegrid.operators import beats as B
from pulsegrid.plans import analysis, sensors
from pulsegrid.sources import readers, writers


def test_vendor_sample_lists(spark):
    rows = [("e", "11", "800,NULL, 2500,x,750.5,"), ("e", "3", "1,2"), ("f", None, "900"), ("g", "11", None)]
    got = sorted(tuple(r) for r in readers.vendor_beats(spark.createDataFrame(rows, "k string, sample_type string, data string"), ["k"], "data").collect())
    assert got == [("e", 0, 800.0, False), ("e", 2, 2500.0, True), ("e", 4, 750.5, False)]


def test_packet_lines(spark, tmp_path):
    lines = [
        {"recordingName": "r1", "phoneTimestamp": 5.0, "data": [{"timeStamp": 1, "voltage": 2.5}, {"timeStamp": 2}, {"voltage": 9}]}, {"recordingName": "r1", "phoneTimestamp": 6.0, "data": [{"timeStamp": 3, "voltage": -1}]},
        {"recordingName": "few", "data": [{"timeStamp": 1, "voltage": 0}]}, {"recordingName": "none"}]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "ecg.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = sorted(tuple(r) for r in readers.packets(spark, str(tmp_path), ["voltage"], 3).collect())
    assert got == [("r1", 5.0, 1.0, 2.5), ("r1", 5.0, 2.0, None), ("r1", 6.0, 3.0, -1.0)]


def test_activity_files(spark, tmp_path):
    one = lambda i: {"id": i, "type": "Run", "icu_hr_zones": [1, 2.5], "messages": [{"type": "TEXT", "content": "x"}], "other": 1}
    for who, name, body in (("ann", "list", [one("a"), one("b")]), ("ann", "held", {"activities": [one("c")]}), ("bob", "data", {"data": [one("d")]}), ("bob", "single", one("e"))):
        (tmp_path / who).mkdir(exist_ok=True)
        (tmp_path / who / f"{name}.json").write_text(json.dumps(body))
    got = readers.activities(spark, str(tmp_path)).collect()
    assert sorted((r.entity, r.id) for r in got) == [("ann", "a"), ("ann", "b"), ("ann", "c"), ("bob", "d"), ("bob", "e")]
    assert all(r.icu_hr_zones == [1.0, 2.5] and r.messages[0].content == "x" and r.distance is None for r in got)
    assert {r.entity for r in readers.activities(spark, str(tmp_path), "me").collect()} == {"me"}


def test_signals_of_unequal_length(spark):
    kind = "k string, s array<struct<type:string,data:array<double>>>"
    df = spark.createDataFrame([("a", [("hr", [1.0, 2.0]), ("speed", [9.0])]), ("b", [("other", [1.0])]), ("c", None)], kind)
    assert sorted(tuple(r) for r in readers.signals(df, ["k"], "s", ["hr", "speed"]).collect()) == [("a", 0, 1.0, 9.0), ("a", 1, 2.0, None)]


def test_heart_rate_tables_and_track_points(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_sec,Heart_Rate,velocity_mps\n0,100,2\n1,\"101,5\",\nx,5,5\n")
    assert sorted((r.sec, r.hr, r.speed_kmh, r.cadence) for r in readers.heart_rate_csv(spark, str(tmp_path / "a.csv")).collect()) == [(0.0, 100.0, 7.2, None), (1.0, 101.5, None, None)]
    point = lambda t, hr: f"<Trackpoint><Time>{t}</Time>" + (f"<HeartRateBpm><Value>{hr}</Value></HeartRateBpm>" if hr else "") + "</Trackpoint>"
    (tmp_path / "a.tcx").write_text("<Track>" + point("2024-01-01T10:00:05Z", 90) + point("2024-01-01T10:00:07.500Z", None) + point("no", 1) + "</Track>")
    assert sorted((r.file, r.sec, r.hr) for r in readers.trackpoints(spark, str(tmp_path / "a.tcx")).collect()) == [("a.tcx", 0.0, 90.0), ("a.tcx", 2.5, None)]


def test_tables_with_a_contract(spark, tmp_path):
    assert readers.table(spark, str(tmp_path / "gone.csv"), ["a", "b"]).columns == ["a", "b"]
    df = spark.createDataFrame([(1, "NA", None)], "c int, a string, b string")
    writers.contract_csv(df, str(tmp_path / "t"), ["a", "b", "d"])
    back = readers.table(spark, str(tmp_path / "t"), ["a", "b"])
    assert back.columns == ["a", "b", "d", "c"] and tuple(back.first()) == ("NA", None, None, "1")
    days = spark.createDataFrame([(1, "x"), (2, "y")], "v int, day string")
    writers.contract_parquet(days, str(tmp_path / "p"), ["v", "day"], ["day"])
    writers.contract_parquet(days.where("day = 'y'").withColumn("v", F.lit(3)), str(tmp_path / "p"), ["v", "day"], ["day"])
    assert sorted((r.v, r.day) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, "x"), (3, "y")]
    assert [r.value for r in writers.beat_lines(spark.createDataFrame([(800.0005, True), (750.0, False)], "duration_ms double, offline boolean")).collect()] == ["800.000,1", "750.000,0"]


def test_small_parsers_and_quality(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(parse.minutes_between(F.lit("2024-01-01T22:00:00+02:00"), F.lit("2024-01-01T21:30:00Z"))) == 90 and one(parse.minutes_between(F.lit("2024-01-01"), F.lit("2024-01-01"))) is None
    assert one(parse.percent(F.lit("0,85"))) == 85 and one(parse.percent(F.lit("85"))) == 85 and one(parse.breaths(F.lit("4000"))) == 15 and one(parse.breaths(F.lit("200"))) == 200
    assert [one(parse.colour_code(F.lit(x))) for x in ("VERDE", "Amarillo", "rojo", "Indef", "x")] == [1, 2, 3, 0, None]
    assert str(one(parse.file_date(F.lit("a_2024-02-03_RR.csv")))) == "2024-02-03" and one(parse.file_date(F.lit("a_2024-13-03"))) is None
    raw = spark.createDataFrame([("k", "800", "0"), ("k", "x", "maybe"), ("k", "700", "yes")], "k string, d string, o string")
    got = B.input_quality(raw, ["k"], "d", "o").first()
    assert (got.rows, got.bad_duration, got.unknown_offline) == (3, 1, 1) and got.offline_pct == pytest.approx(200 / 3)
    bands = analysis.rmssd_bands(spark.createDataFrame([("e", "s", r, True) for r in (7.0, 7.1, 11.0, 11.1)] + [("e", "s", 5.0, False)], "entity string, session_id string, rmssd double, usable boolean")).first()
    assert (bands.low_min, bands.mid_min, bands.high_min) == (1, 2, 1)


def test_units_of_stamps(spark):
    rows = [("e", rec, int(base * unit) + i * int(unit)) for rec, unit in (("s", 1), ("ms", 1e3), ("us", 1e6), ("ns", 1e9)) for i, base in enumerate([1.7e9] * 3)]
    got = {(r.rec, round(r.t - 1.7e9)) for r in sensors.unit_seconds(spark.createDataFrame(rows, "entity string, rec string, ts long"), "ts").collect()}
    assert got == {(rec, i) for rec in ("s", "ms", "us", "ns") for i in range(3)}
