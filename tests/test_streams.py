"""Event-time windows and versioned tables."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.config import BeatConfig
from pulsegrid.operators import beats as B
from pulsegrid.streaming import versioned, windows

BEAT = "entity string, beat_idx long, t_end double, duration_ms double"


@pytest.fixture
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, windows.STATE_STORE)
    yield spark
    spark.conf.unset(name)


def recording(entity, n, seed):
    r, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        d = float(r.randint(600, 1100))
        t += d / 1000
        out.append((entity, i + 1, t, d))
    return out


def run(spark, files, folder, late):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, BEAT).coalesce(1).write.mode("append").parquet(f"{folder}/in/b{i:03}")
    stream = spark.readStream.schema(BEAT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    out = windows.sliding_rmssd(stream, ["entity"], late)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def test_shuffled_batches_give_the_windows_of_the_whole(stateful, tmp_path):
    rows = recording("a", 700, 1) + recording("b", 300, 2)
    mixed = rows[:]
    random.Random(3).shuffle(mixed)
    files = [mixed[i::20] for i in range(20)]
    files.append([("end", 1, 1e7, 800.0)])  # moves the watermark past all that came
    got = run(stateful, files, str(tmp_path), 1000)
    want = B.sliding_rmssd(stateful.createDataFrame(rows, BEAT), ["entity"])
    show = lambda df: sorted((x.entity, x.k, x.rmssd and round(x.rmssd, 9)) for x in df.where("entity <> 'end'").collect())
    assert show(got) == show(want) and got.count() > 20


def test_beats_behind_the_watermark_are_left_out(stateful, tmp_path):
    rows = recording("a", 400, 4)
    late = [x for x in rows if 60 <= x[2] < 90]
    on_time = [x for x in rows if not 60 <= x[2] < 90]
    got = run(stateful, [on_time, [("a", 5000, 900.0, 800.0)], late, [("end", 1, 1e7, 800.0)]], str(tmp_path), 30)
    want = B.sliding_rmssd(stateful.createDataFrame(on_time + [("a", 5000, 900.0, 800.0)], BEAT), ["entity"])
    show = lambda df: sorted((x.k, x.rmssd and round(x.rmssd, 9)) for x in df.where("entity = 'a'").collect())
    assert show(got) == show(want)


def test_windows_are_groups_of_a_stream_and_need_no_python(spark, tmp_path):
    """Any state store will do; beats are added up and put in order without Python workers."""
    rows = recording("a", 200, 5) + [(None, 1, 10.0, 800.0), (None, 2, None, 800.0)]
    got = run(spark, [rows[::-2], rows[-2::-2], [("end", 1, 1e7, 800.0)]], str(tmp_path), 1000)
    want = B.sliding_rmssd(spark.createDataFrame(rows[:-1], BEAT), ["entity"])
    show = lambda df: sorted((x.entity or "", x.k, x.rmssd and round(x.rmssd, 9)) for x in df.where("entity IS NULL OR entity <> 'end'").collect())
    assert show(got) == show(want) and got.count() > 5
    stream = spark.readStream.schema(BEAT).parquet(f"{tmp_path}/in/*")
    assert "Pandas" not in windows.sliding_rmssd(stream, ["entity"], 1000)._jdf.queryExecution().analyzed().toString()


ROW = "k long, day date, v long, x string"


def rows_of(df):
    return sorted((r.k, str(r.day), r.v, r.x) for r in df.collect())


def test_a_merge_reads_and_writes_the_days_it_touches(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k"], "day", ["v"])
    with pytest.raises(ValueError):
        t.read()
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int"))
    first = spark.range(100).select(F.col("id").alias("k"), day.alias("day"), F.lit(1).cast("long").alias("v"), F.lit("old").alias("x"))
    assert t.merge(first) == 1
    before = t.manifest()["days"]
    fix = spark.createDataFrame([(3, "2024-01-04", 2, "new"), (13, "2024-01-04", 0, "stale"), (900, "2024-01-04", 1, "more"), (23, "2024-01-04", 1, "equal"), (1, "2024-02-01", 1, "day"), (7, None, 1, "none")], "k long, day string, v long, x string")
    assert t.merge(fix) == 2
    after = t.manifest()["days"]
    assert {d for d in after if after[d] != before.get(d)} == {"2024-01-04", "2024-02-01"}
    now = {(r.k, str(r.day)): r.x for r in t.read().collect()}
    assert len(now) == 102 and now[3, "2024-01-04"] == "new" and now[13, "2024-01-04"] == "old" and now[23, "2024-01-04"] == "equal" and now[900, "2024-01-04"] == "more"
    assert rows_of(t.read(1)) == rows_of(first)
    files = t.read(days=["2024-01-04"]).inputFiles()
    assert files and all("_of=2024-01-04" in f for f in files)
    assert t.vacuum() == 1 and t.versions() == [2] and t.read().count() == 102


def test_refresh_replaces_the_last_days(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k"], "day")
    make = lambda rows: spark.createDataFrame(rows, "k long, day string, x string")
    t.refresh(make([(k, f"2024-03-{d:02}", "old") for k in (1, 2) for d in range(1, 11)]))
    t.refresh(make([(1, f"2024-03-{d:02}", "new") for d in range(1, 13)]))
    got = sorted((r.k, str(r.day)[-2:], r.x) for r in t.read().collect())
    assert [x for x in got if x[2] == "new"] == [(1, f"{d:02}", "new") for d in range(8, 13)]
    assert [x for x in got if x[2] == "old"] == [(k, f"{d:02}", "old") for k in (1, 2) for d in range(1, 8)]


def test_writers_conflict_and_batches_are_known(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k"], "day", ["v"])
    one = spark.createDataFrame([(1, "2024-01-01", 1, "a")], "k long, day string, v long, x string")
    assert t.merge(one, "run", 0) == 1 and t.merge(one, "run", 0) == 1 and t.merge(one, "run", 1) == 2
    stale = t.manifest(1)
    with pytest.raises(versioned.Conflict):
        t._write(one.withColumn("day", F.to_date("day")), stale, {"2024-01-01"}, None, None)
    assert t.merge(one.limit(0)) == 2 and rows_of(t.read()) == [(1, "2024-01-01", 1, "a")]


def test_a_stream_of_corrections(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, f"2024-01-0{1 + (k + i) % 3}", 5 if i == 1 else i, f"b{i}") for k in range(6)], "k long, day string, v long, x string").selectExpr("k", "cast(day as date) day", "v", "x").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    t = versioned.VersionedTable(spark, str(tmp_path / "t"), ["k"], "day", ["v"])
    for _ in range(2):  # the second finds nothing new
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        t.merge_stream(stream, str(tmp_path / "cp")).awaitTermination()
    assert rows_of(t.read()) == sorted((k, f"2024-01-0{1 + (k + i) % 3}", 5 if i == 1 else i, f"b{i}") for i in range(3) for k in range(6))
    assert len(t.versions()) == 3
