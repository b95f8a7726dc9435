"""Held states by composed functions against the plain loop."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import BeatConfig
from pulsegrid.operators import beats as B
from pulsegrid.operators import folds


def walks(r, n):
    """Series that jump, drift, creep and stay."""
    x, out = 800.0, []
    for _ in range(n):
        kind = r.random()
        x = r.uniform(300, 2000) if kind < 0.05 else x * r.choice([1.2, 0.8, 1.0, 1.25]) if kind < 0.15 else x + r.choice([-1, 0, 1, 0.01])
        x = min(max(x, 300.0), 2000.0)
        out.append(round(x))
    return out


@pytest.mark.parametrize("guard", [folds.Guard("ratio", 0.2), folds.Guard("within", 25.0), folds.Guard("beyond", 40.0)])
def test_pieces_compose_to_the_loop(guard):
    r = random.Random(1)
    for case in range(60):
        x = walks(r, r.choice([0, 1, 5, 300]))
        value = x if case % 2 else [min(max(v, 500.0), 1500.0) for v in x]
        met, last = folds.run(x, value, guard, None)
        cuts = sorted(r.randint(0, len(x)) for _ in range(6))
        state = None
        for a, b in zip([0, *cuts], [*cuts, len(x)]):
            at, end = folds.captors(np.array(x[a:b], float), np.array(value[a:b], float), guard, (300.0, 2000.0))
            assert a == b or state == met[a]
            for s in [*walks(r, 20), None] if a < b else []:
                assert folds.after(s, at, end, guard) == folds.run(x[a:b], value[a:b], guard, s)[1]
            state = folds.after(state, at, end, guard)
        assert state == last


def test_held_with_rows_that_take_part_in_nothing(spark):
    r = random.Random(5)
    rows = [(k, i, None if r.random() < 0.2 else float(v), "own") for k in ("a", "b", None) for i, v in enumerate(walks(r, 200))] + [("none", 1, None, "own"), ("one", -7, 500.0, None)]
    df = spark.createDataFrame(rows, "k string, i long, x double, before_ string").repartition(7)
    guard = folds.Guard("ratio", 0.2)
    got = folds.held(df, ["k"], "i", F.floor(F.col("i") / 30), F.col("x"), F.col("x"), guard).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"k", "i", "x", "before_", "before"}
    state = {}
    for x in sorted(got, key=lambda x: (str(x.k), x.i)):
        assert x.before == state.get(x.k)
        if x.x is not None and (x.before is None or guard.takes(x.before, x.x)):
            state[x.k] = x.x
    assert folds.held(df.limit(0), ["k"], "i", F.lit(0), F.col("x"), F.col("x"), guard).count() == 0


def test_two_million_beats_of_one_recording(spark):
    n, cfg = 2_000_000, BeatConfig()
    d = (700 + F.pmod(F.xxhash64("id"), F.lit(400)) + F.when(F.col("id") % 97 == 0, 900).otherwise(0)).cast("double")
    beats = spark.range(n, numPartitions=8).select(F.lit("e").alias("entity"), F.col("id").alias("beat_idx"), d.alias("duration_ms"), (F.col("id") % 1000 == 1).alias("offline"))
    began = time.time()
    got = B.jump_from_accepted(beats, ["entity"], cfg).groupBy("reason").agg(F.count("*").alias("n"), F.sum("beat_idx").alias("s")).collect()
    took = time.time() - began
    rows = beats.select("duration_ms", "offline").toArrow()
    x, off = rows.column("duration_ms").to_pylist(), rows.column("offline").to_pylist()
    want, last = {}, None
    for i, (v, o) in enumerate(zip(x, off)):
        reason = "offline" if o else "out_of_range" if v < 300 or v > 2000 else "jump" if last is not None and abs(v - last) / last > 0.2 else ""
        c, t = want.get(reason, (0, 0))
        want[reason] = (c + 1, t + i)
        last = v if reason == "" else last
    assert {r.reason: (r.n, r.s) for r in got} == want
    assert took < 120
