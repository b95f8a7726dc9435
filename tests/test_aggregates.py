"""Global ranks and merging sketches."""

import random

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators import ranks, sketches


def test_ranks_over_ranges_equal_the_sorted_list(spark):
    r = random.Random(1)
    # a value that a third of all rows have, nulls, and more ranges than values
    values = [5.0] * 200 + [None] * 40 + [float(r.randint(0, 6)) for _ in range(360)]
    r.shuffle(values)
    rows = [(v, i, "own") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "x double, id long, rank_ string").repartition(5)
    for descending in (False, True):
        got = ranks.global_rank(df, ["x"], ["id"], 7, descending).collect()
        low = lambda v: float("-inf") if v is None else v
        order = sorted(rows, key=lambda t: (low(t[0]), t[1]), reverse=descending)
        first, want = {}, {}
        for i, (v, k, _) in enumerate(order):
            first.setdefault(v, i + 1)
            size, more = divmod(len(rows), 7)
            tile = i // (size + 1) if i < more * (size + 1) else more + (i - more * (size + 1)) // size
            want[k] = (i + 1, first[v], (first[v] - 1) / (len(rows) - 1), tile + 1)
        assert {x.id: (x.row_number, x.rank, x.percent_rank, x.ntile) for x in got} == want
        assert set(got[0].asDict()) == {"x", "id", "rank_", "row_number", "rank", "percent_rank", "ntile"}
    few = ranks.global_rank(df.limit(3), ["x"], ["id"], 10).collect()
    assert sorted((x.row_number, x.ntile) for x in few) == [(1, 1), (2, 2), (3, 3)]
    assert ranks.global_rank(df.limit(0), ["x"], ["id"], 10).count() == 0
    one = ranks.global_rank(df.limit(1), ["x"], ["id"]).first()
    assert (one.row_number, one.rank, one.percent_rank) == (1, 1, 0.0)


def test_no_window_over_the_whole_table(spark, capsys):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("x"))
    ranks.global_rank(df, ["x"], ["id"], 4).explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_days_merge_to_what_one_sketch_of_the_range_says(spark):
    df = spark.range(40_000, numPartitions=6).select((F.col("id") % 2).alias("e"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")).alias("day"),
        F.when(F.col("id") % 11 != 0, F.col("id") % 7000).alias("who"), (F.col("id") / 7).alias("ratio"), F.when(F.col("id") % 13 != 0, F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10).alias("x"))
    days = sketches.daily(df, ["e"], "day", ["who", "ratio"], ["x"])
    weeks = sketches.merged(days.withColumn("week", F.trunc("day", "week")), ["e", "week"])
    whole = sketches.told(sketches.merged(weeks, ["e"]), ["e"]).collect()
    rows = df.collect()
    for got in whole:
        own = [r for r in rows if r.e == got.e]
        x = np.array([r.x for r in own if r.x is not None])
        assert got.n == len(own) and got.low_x == x.min() and got.high_x == x.max() and abs(got.mean_x - x.mean()) < 1e-6
        assert abs(got.distinct_who - len({r.who for r in own if r.who is not None})) <= 0.05 * 3500
        assert abs(got.distinct_ratio - 20_000) <= 0.05 * 20_000
        assert all(abs((x <= q).mean() - p) <= 0.03 for q, p in zip(got.quantiles_x, (0.1, 0.5, 0.9)))
    empty = sketches.told(sketches.daily(df.limit(3).withColumn("x", F.lit(None).cast("double")), ["e"], "day", [], ["x"]), ["e", "day"]).first()
    assert empty.quantiles_x is None and empty.mean_x is None


def test_grouping_sets_tell_totals_from_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    got = {(r.x, r.y, r.level): r.n for r in sketches.grouping_sets(df, ["x", "y"], "rollup", [F.count("*").alias("n")]).collect()}
    assert got == {("a", 1, 0): 1, ("a", None, 0): 1, (None, 1, 0): 1, ("a", None, 1): 2, (None, None, 1): 1, (None, None, 3): 3}


def test_block_means_by_running_sums(spark):
    from pulsegrid.operators import joins

    r = random.Random(2)
    samples = [(k, float(t), r.choice([None, r.uniform(60, 180)])) for k in ("a", "b") for t in range(0, 3000) if r.random() < 0.8]
    blocks = [(k, s, s + r.choice([0, 7, 1500]), r.uniform(60, 180)) for k in ("a", "b") for s in (-10, 20, 700, 900, 2990)]
    df, b = spark.createDataFrame(samples, "k string, sec double, value double"), spark.createDataFrame(blocks + blocks[:1], "k string, start int, stop int, target double")
    wanted = spark.createDataFrame([(k, float(t), t) for k in ("a", "b", "c") for t in (-5, 0, 1, 500, 501, 9999)], "k string, sec double, id int")
    for piece in (100_000.0, 300.0):
        for x in joins.sums_before(df, wanted, ["k"], "sec", "value", piece).collect():
            own = [v for k, t, v in samples if k == x.k and t < x.sec and v is not None]
            assert x.n == len(own) and abs(x.total - sum(own)) < 1e-6
    want = {}
    for k in ("a", "b"):
        scores = []
        for o in range(-6, 7, 3):
            gaps = []
            for start, stop, target in {(s, e, t) for n, s, e, t in blocks if n == k}:
                own = [v for n, t, v in samples if n == k and v is not None and start + o <= t < stop + o]
                if own:
                    gaps.append(abs(sum(own) / len(own) - target))
            scores.append((round(sum(gaps) / len(gaps), 9), o))
        want[k] = min(scores)
    got = {x.k: (round(x.score, 9), x.best_offset) for x in joins.grid_search(df, b, ["k"], (-6, 6, 3)).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6 for k in got)
