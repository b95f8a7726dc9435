"""Joins in time: nearest, interval, as-of, fallback, positional, and against calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_days(have: DataFrame, keys: Sequence[str], day: str, start: str, end: str) -> DataFrame:
    """keys and the days from start to end that a key has no row for."""
    every = have.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(day))
    return every.join(have.select(*keys, day).distinct(), [*keys, day], "left_anti")


def covered_days(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of left whose keys the right side has."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi").select(*left.columns)


def replace_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """left with these columns as the right side has them, null where it has no row of the keys; others stay."""
    return left.drop(*columns).join(right.select(*keys, *columns), list(keys), "left")


def same_or_previous(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, groups: Sequence[Sequence[str]]) -> DataFrame:
    """left with right's columns of the same day; each group of columns falls back as a whole to the day before."""
    columns = [c for g in groups for c in g]
    same = right.select(*keys, day, *[F.col(c).alias(f"_s_{c}") for c in columns])
    before = right.select(*keys, F.date_add(day, 1).alias(day), *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = left.join(same, [*keys, day], "left").join(before, [*keys, day], "left")
    for g in groups:
        have = F.coalesce(*[F.col(f"_s_{c}").cast("string") for c in g]).isNotNull()
        for c in g:
            both = both.withColumn(c, F.when(have, F.col(f"_s_{c}")).otherwise(F.col(f"_b_{c}")))
    return both.drop(*[f"_{p}_{c}" for p in "sb" for c in columns])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, left_at: str, right_id: str, right_at: str, tolerance: float, left_size: str | None = None, right_size: str | None = None) -> DataFrame:
    """For each left row the right row of the same keys that is nearest in time: left_id, right_id, delta, size_gap.

    Times are numbers. Right rows are sent to the bucket of their time and its two neighbours, each as wide as the
    tolerance, so the join is an equi-join on (keys, bucket) whatever the number of rows of a key. Ties go to the
    nearer size, then the smaller right_id. Rows without a partner within the tolerance are left out.
    """
    a = left.select(*keys, left_id, F.col(left_at).cast("double").alias("_t"), (F.col(left_size) if left_size else F.lit(None)).cast("double").alias("_z")).withColumn("_k", F.floor(F.col("_t") / tolerance))
    b = right.select(*keys, right_id, F.col(right_at).cast("double").alias("_u"), (F.col(right_size) if right_size else F.lit(None)).cast("double").alias("_y"))
    b = b.withColumn("_k", F.explode(F.array(*[F.floor(F.col("_u") / tolerance) + i for i in (-1, 0, 1)])))
    near = a.join(b, [*keys, "_k"]).withColumn("delta", F.abs(F.col("_t") - F.col("_u"))).where(F.col("delta") <= tolerance)
    near = near.withColumn("size_gap", F.abs(F.col("_z") - F.col("_y")))
    order = Window.partitionBy(*keys, left_id).orderBy("delta", F.col("size_gap").asc_nulls_last(), right_id)
    return near.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, left_id, right_id, "delta", "size_gap")


def in_any_interval(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_id: str, at: str, start: str, stop: str, width: float) -> DataFrame:
    """points with inside: whether a point lies in one of the intervals of its keys, both ends included.

    Intervals are sent to the buckets of `width` that they touch; points join on (keys, bucket). Choose a width
    near the intervals' length. Overlapping intervals mark a point once.
    """
    cut = lambda c: F.floor(F.col(c) / width)
    spans = intervals.select(*keys, start, stop).distinct().withColumn("_k", F.explode(F.sequence(cut(start), cut(stop))))
    near = points.select(*keys, point_id, at).withColumn("_k", cut(at)).join(spans, [*keys, "_k"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop)))
    hits = near.select(*keys, point_id).distinct().withColumn("inside", F.lit(True))
    return points.join(hits, [*keys, point_id], "left").fillna({"inside": False})


def interpolate(points: DataFrame, series: DataFrame, keys: Sequence[str], at: str, series_at: str, value: str, point_id: str | None = None) -> DataFrame:
    """points with value interpolated between the series' neighbours; null outside its range.

    Both sides are stacked and walked once each way, so there is no join on inequality. Of series rows with the
    same time the one with the least value counts.
    """
    clean = series.where(F.col(value).isNotNull() & F.col(series_at).isNotNull()).groupBy(*keys, F.col(series_at).cast("double").alias("_t")).agg(F.min(F.col(value).cast("double")).alias("_v"))
    own = points.withColumn("_t", F.col(at).cast("double")).withColumn("_row", F.struct(*points.columns))
    both = own.select(*keys, "_t", F.lit(None).cast("double").alias("_v"), "_row").unionByName(clean.withColumn("_row", F.lit(None).cast(own.schema["_row"].dataType)))
    # the next neighbour is the last one on the way back: a frame that only grows costs a row once
    w, back = Window.partitionBy(*keys).orderBy("_t"), Window.partitionBy(*keys).orderBy(F.desc("_t"))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    both = both.withColumn("_lo", F.last(known, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.last(known, ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    a, b = F.col("_lo"), F.col("_hi")
    line = F.when(a["t"] == b["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("_t") - a["t"]) / (b["t"] - a["t"]))
    return both.where("_row IS NOT NULL").select("_row.*", F.when(a.isNotNull() & b.isNotNull(), line).alias(value))


def zip_positions(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], left_cols: Sequence[str], right_cols: Sequence[str]) -> DataFrame:
    """The n-th left row of each key beside the n-th right one; what one side has more is left out."""
    number = lambda df, order: df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).select(*keys, "position", *left_cols).join(number(right, right_order).select(*keys, "position", *right_cols), [*keys, "position"])


def first_source(candidates: DataFrame, keys: Sequence[str], priority: str, usable: str) -> DataFrame:
    """All rows of the source with the least priority that has a usable value, for each key."""
    w = Window.partitionBy(*keys)
    best = F.min(F.when(F.col(usable).isNotNull(), F.col(priority))).over(w)
    return candidates.withColumn("_best", best).where(F.col(priority) == F.col("_best")).drop("_best")


def lookup_last(left: DataFrame, right: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """left with right's columns by key; of several right rows the last by version counts."""
    last = right.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version]))).where("_r = 1").drop("_r", *[v for v in version if v not in keys])
    return left.join(last, list(keys), "left")


def sums_before(samples: DataFrame, wanted: DataFrame, keys: Sequence[str], at: str, value: str, piece: float = 100_000.0) -> DataFrame:
    """wanted (keys, at and more) with total and n: the sum and number of the samples' values before each row's place.

    Both sides lie in one order, in which a sample adds to the sum and a wanted row reads it. A series is cut into
    pieces of so many units of `at`, each summed up by itself and from the sums of the pieces before.
    """
    more = [c for c in wanted.columns if c not in (*keys, at)]
    s = samples.select(*keys, F.col(at).cast("double").alias(at), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_s"))
    both = s.unionByName(wanted.select(*keys, F.col(at).cast("double").alias(at), *more, F.lit(0).alias("_s")), allowMissingColumns=True).withColumn("_piece", F.floor(F.col(at) / piece))
    inside = Window.partitionBy(*keys, "_piece").orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = both.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_t"), F.count("_v").alias("_m"))
    whole = whole.select(*keys, "_piece", F.coalesce(F.sum("_t").over(ahead), F.lit(0.0)).alias("_t"), F.coalesce(F.sum("_m").over(ahead), F.lit(0)).alias("_m"))
    own = both.withColumns({"total": F.coalesce(F.sum("_v").over(inside), F.lit(0.0)), "n": F.count("_v").over(inside)}).where("_s = 0").join(whole, [*keys, "_piece"])
    return own.select(*keys, at, *more, (F.col("total") + F.col("_t")).alias("total"), (F.col("n") + F.col("_m")).alias("n"))


def grid_search(samples: DataFrame, blocks: DataFrame, keys: Sequence[str], offsets: tuple[int, int, int], at: str = "sec", value: str = "value") -> DataFrame:
    """keys, best_offset and score: the shift at which block means fit best, ties to the smaller shift.

    blocks have start, stop and target; the score is the mean absolute gap between the target and the mean of the
    samples in [start + offset, stop + offset). A block's mean is the difference of two running sums, so work grows
    with the blocks and their offsets, a small fixed grid, but not with what a block spans.
    """
    grid = blocks.select(*keys, "start", "stop", "target").withColumn("offset", F.explode(F.sequence(*[F.lit(x) for x in offsets]))).where("stop > start")
    ends = grid.withColumn("_e", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn(at, F.when(F.col("_e") < 0, F.col("start")).otherwise(F.col("stop")) + F.col("offset"))
    read = sums_before(samples, ends, keys, at, value)
    means = read.groupBy(*keys, "offset", "start", "stop", "target").agg(F.sum(F.col("_e") * F.col("total")).alias("_t"), F.sum(F.col("_e") * F.col("n")).alias("_m"))
    means = means.where("_m > 0").withColumn("_mean", F.col("_t") / F.col("_m"))  # of equal blocks both are as many times as large
    scored = means.groupBy(*keys, "offset").agg(F.avg(F.abs(F.col("_mean") - F.col("target"))).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.round("score", 9), "offset")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*keys, F.col("offset").alias("best_offset"), "score")
