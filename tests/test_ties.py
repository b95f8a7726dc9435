"""Values at the edge of a rule: halves that are none, and quartiles that equal a value."""

import datetime

import numpy as np

from pulsegrid.functions import stats
from pulsegrid.operators import windows as W
from pulsegrid.plans import sessions

DAY = datetime.date(1996, 1, 1)


def test_rounding_takes_the_double_as_it_is_held(spark):
    values = [1.015, 1.005, 0.125, 0.375, 2.675, 8.345, -1.015, 163.245]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.r for r in df.select("i", stats.round_even("v", 2).alias("r")).orderBy("i").collect()]
    assert got == [float(np.round(v, 2)) for v in values] and got[0] == 1.01


def test_a_load_that_equals_a_quartile_is_typical(spark):
    # 131.4 + (136.2 - 131.4) / 4 is 132.6, 0.75 * 131.4 + 0.25 * 136.2 a bit more
    loads = [100.0, 131.4, 136.2, 140.0, 150.0, 160.0]
    rows = [("e", "g", DAY + datetime.timedelta(i), str(i), v) for i, v in enumerate(loads)] + [("e", "g", DAY + datetime.timedelta(400), "6", 132.6), ("e", "g", None, "7", 90.0), ("e", None, DAY, "8", 90.0)]
    df = spark.createDataFrame(rows, "entity string, session_group string, Fecha date, session_id string, load double")
    got = {r.session_id: r.effort for r in W.anchor_class(df, ["entity", "session_group"], "Fecha", "load", "1996-01-01", "1996-12-31").collect()}
    assert np.quantile(loads, 0.25) == 132.6
    assert (got["6"], got["0"], got["5"], got["7"], got["8"]) == ("typical", "below", "above", "below", "unknown")


def test_effort_against_the_anchor_meets_its_quartile(spark):
    from pulsegrid.config import SessionConfig

    loads = [100.0, 131.4, 136.2, 140.0, 150.0, 160.0]
    rows = [("e", "g", DAY + datetime.timedelta(i), "08:00", str(i), v) for i, v in enumerate(loads)] + [("e", "g", DAY + datetime.timedelta(400), "08:00", "6", 132.6)]
    df = spark.createDataFrame(rows, "entity string, session_group string, Fecha date, start_time string, session_id string, load double")
    got = {r.session_id: r.effort_vs_anchor for r in sessions.effort(df, SessionConfig(anchor_start="1996-01-01", anchor_end="1996-12-31")).collect()}
    assert got["6"] == "typical"


def test_durations_of_large_keys_equal_the_sql(spark, tmp_path):
    import oracle
    from pulsegrid.queries import ORACLES, QUERIES

    keys = [0, 999, 1000, 170_799, 170_800, 170_801, 899_999, 5_399_999]
    spark.createDataFrame([(4 * i + k, c) for i, c in enumerate(keys) for k in range(4)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert oracle.compare(QUERIES["p27_durations"](spark, str(tmp_path)), ORACLES["p27_durations"], str(tmp_path)) == ""


def test_time_windows_round_once(spark, monkeypatch):
    from pulsegrid.plans import analysis

    beats = spark.createDataFrame([("e", "s", i, 1000.0, float(i + 1), True) for i in range(5)], "entity string, session_id string, beat_idx long, duration_ms double, t_end double, accepted boolean")
    one = spark.createDataFrame([("e", "s", 0, 0.5094996)], "entity string, session_id string, window long, alpha double")
    monkeypatch.setattr(analysis.D, "alpha", lambda *_: one)
    got = analysis.time_windows(beats, min_beats=1, min_valid=0.0).where("window = 0").first()
    assert got.alpha == 0.5094996 and round(got.alpha, 3) == 0.509


def test_an_exponent_holds_no_row_for_each_box(spark):
    from pulsegrid.operators import dfa

    df = spark.createDataFrame([("e", 0, i, 800.0 + i % 7) for i in range(80)], "entity string, window long, pos long, x double")
    plan = dfa.alpha(df, ["entity"], "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "regr_s" not in plan


def test_suppliers_are_dealt_before_they_are_counted(spark):
    from pulsegrid.queries import QUERIES

    plan = QUERIES["a40_grouping_sets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_suppkey" in plan and plan.index("Expand") < plan.index("RepartitionByExpression")


def test_loads_at_a_quartile_take_the_class_of_the_sql(spark, tmp_path):
    import oracle
    from pulsegrid.queries import ORACLES, QUERIES

    # 111.2 + (120.8 - 111.2) * 0.75 is 118.4 and 276.4 + (286.8 - 276.4) * 0.75 is 284.2; the SQL's quartiles lie a bit beside them
    cases = {"a": ([90.0, 100.0, 110.0, 111.2, 120.8, 130.0], 118.4), "b": ([270.0, 276.4, 286.8, 290.0, 300.0, 310.0, 320.0, 330.0], 284.2)}
    orders, key = [], 0
    for grp, (loads, x) in cases.items():
        for i, v in enumerate([*loads, x, x]):
            key += 2 if key % 17 == 16 else 1
            day = datetime.datetime(1996, 12, 20) + datetime.timedelta(30 if i == len(loads) else 400 if i > len(loads) else i)
            orders.append((key, 1, v * 1000, day, grp))
    write = lambda name, rows, shape: spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write("orders", orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    write("customer", [(1, 1)], "c_custkey long, c_nationkey int")
    write("lineitem", [(o[0], 1.0) for o in orders], "l_orderkey long, l_quantity double")
    got = QUERIES["c8_effort_classes"](spark, str(tmp_path))
    assert oracle.compare(got, ORACLES["c8_effort_classes"], str(tmp_path)) == ""
    assert {(r.effort_vs_recent, r.effort_vs_anchor) for r in got.collect()} >= {("above", "above"), ("below", "below"), ("unknown", "above"), ("unknown", "below")}


def test_a_line_is_rounded_as_a_fused_sum(spark):
    import math
    import random

    r = random.Random(5)
    rows = [(r.uniform(-500, 500), r.uniform(-500, 500), r.choice([0.0, 0.1, 0.25, 0.5, 0.75, r.random()])) for _ in range(3000)]
    rows += [(round(a, 1), round(b, 1), d) for a, b, d in rows]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a double, b double, d double")
    got = [x.v for x in df.select("i", stats.between("a", "b", "d").alias("v")).orderBy("i").collect()]
    assert got == [math.fma(a, 1 - d, b * d) if d else a for a, b, d in rows]
    odd = spark.createDataFrame([(1.0, math.inf, 0.0), (1.0, math.inf, 0.25), (-math.inf, 1.0, 0.5), (None, 1.0, 0.5)], "a double, b double, d double")
    assert [x.v for x in odd.select(stats.between("a", "b", "d").alias("v")).collect()] == [1.0, math.inf, -math.inf, None]


def test_a_beat_that_ends_on_an_edge_is_on_it(spark):
    import math
    import random

    from pulsegrid.operators import beats as B
    from pulsegrid.plans import analysis

    r = random.Random(1)
    # 75 beats of 733 1/3 ms end at 55 s; their running sum goes to 55.00000000000005 s
    given = {"even": [2200 / 3] * 75, "mixed": [r.uniform(300, 2000) for _ in range(500)] + [1e9, 1e-9, 5e11], "odd": [800.0, math.inf, 800.0]}
    rows = [(e, "s", i, x, False) for e, d in given.items() for i, x in enumerate(d, 1)] + [("even", "s", 0, None, False), ("even", "s", 76, math.nan, False)]
    beats = spark.createDataFrame(rows, "entity string, session_id string, beat_idx long, duration_ms double, offline boolean")
    timed = B.time_axis(beats, ["entity", "session_id"])
    assert timed.columns == [*beats.columns, "t_end"]
    got = {(x.entity, x.beat_idx): x.t_end for x in timed.collect()}
    want = {(e, i): math.fsum(d[:i]) / 1000 for e, d in given.items() for i in range(1, len(d) + 1)}
    assert got == want and got["even", 75] == 55.0
    windows = analysis.time_windows(timed.where("entity = 'even'").withColumn("accepted", timed.duration_ms > 0), min_beats=1, min_valid=0.0)
    assert windows.agg({"window": "max"}).first()[0] == 10
