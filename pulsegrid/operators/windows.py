"""Baselines and rolling classes over calendar-ordered series.

All windows of one call share their partitioning and order, so one exchange and one sort serve them all.
Frames are calendar ranges that end the day before, unless a docstring says rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import rules, stats


def day_number(day) -> Column:
    return F.unix_date(stats.col(day).cast("date"))


def day_frame(keys: Sequence[str], day: str, days: int) -> WindowSpec:
    """The `days` calendar days before a row's day."""
    return Window.partitionBy(*keys).orderBy(day_number(day)).rangeBetween(-days, -1)


def rolling_baseline(df: DataFrame, keys: Sequence[str], day: str, x: str, days: int, valid: Column | None = None, swc_mult: float = 0.5) -> DataFrame:
    """df with base, swc and n: median, swc_mult robust standard deviations, and count of x over valid earlier days."""
    w = day_frame(keys, day, days)
    value = F.when(rules.yes(valid), F.col(x)) if valid is not None else F.col(x)
    df = df.withColumn("_v", stats.missing_to_null(value))
    out = df.withColumn("_all", F.array_sort(F.collect_list("_v").over(w)))  # one frame serves all three
    mid = stats.quantile_sorted(F.col("_all"), 0.5)
    return out.withColumns({"base": mid, "n": F.size("_all").cast("long"), "swc": swc_mult * stats.robust_sd(F.col("_all"))}).drop("_v", "_all")


def rolling_baselines(df: DataFrame, keys: Sequence[str], day: str, frames: dict[str, tuple[str, int]], valid: Column, where: Column, swc_mult: float = 0.5) -> DataFrame:
    """df with base_<k>, swc_<k> and n_<k> of several (column, days), null where `where` says no: all of them in one
    projection over one partitioning, as in rolling_baseline."""
    ok = rules.yes(valid)
    lists = {f"_all_{k}": F.array_sort(F.collect_list(F.when(ok, stats.missing_to_null(F.col(x)))).over(day_frame(keys, day, days))) for k, (x, days) in frames.items()}
    out = {}
    for k in frames:
        held = F.col(f"_all_{k}")
        out |= {f"base_{k}": F.when(where, stats.quantile_sorted(held, 0.5)), f"swc_{k}": F.when(where, swc_mult * stats.robust_sd(held)), f"n_{k}": F.when(where, F.size(held).cast("long"))}
    return df.withColumns(lists).withColumns(out).drop(*lists)


def rolling_residual(df: DataFrame, keys: Sequence[str], day: str, x: str, y: str, days: int, min_n: int, valid: Column | None = None, swc_mult: float = 0.5) -> DataFrame:
    """df with residual and residual_z of y against the line fitted on earlier days; z is in units of the
    training residuals' scaled robust spread."""
    w = day_frame(keys, day, days)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = ok & rules.yes(valid) if valid is not None else ok
    pairs = F.collect_list(F.when(ok, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).over(w)
    df = df.withColumn("_p", pairs).withColumn("_fit", F.when(F.size("_p") >= min_n, stats.ols(F.col("_p"))))
    left = F.transform("_p", lambda p: p["y"] - (F.col("_fit.intercept") + F.col("_fit.slope") * p["x"]))
    df = df.withColumn("residual", F.col(y) - (F.col("_fit.intercept") + F.col("_fit.slope") * F.col(x)))
    scale = swc_mult * stats.robust_sd(left)
    return df.withColumn("_s", F.when(F.col("_fit").isNotNull(), scale)).withColumn("residual_z", F.when(F.col("_s") != 0, F.col("residual") / F.col("_s"))).drop("_p", "_fit", "_s")


def last_valid_mean(df: DataFrame, keys: Sequence[str], day: str, columns: Sequence[str], valid: Column, n: int = 3) -> DataFrame:
    """df with <c>_roll, the mean of the last n valid rows up to and with this one, and n_roll; no age limit."""
    order = Window.partitionBy(*keys).orderBy(day)
    df = df.withColumn("_ok", rules.yes(valid)).withColumn("_k", F.sum(F.col("_ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # rows up to the next valid one belong to the latest valid row, so it is enough to average over valid ranks
    rank = Window.partitionBy(*keys, "_ok").orderBy("_k").rowsBetween(-(n - 1), 0)
    for c in columns:
        df = df.withColumn(f"_{c}", F.when(F.col("_ok"), F.avg(c).over(rank)))
        df = df.withColumn(f"{c}_roll", F.last(f"_{c}", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop(f"_{c}")
    return df.withColumn("n_roll", F.least(F.col("_k"), F.lit(n)).cast("int")).drop("_ok", "_k")


def rolling_rows_median(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, before: int, after: int = 0, min_n: int = 3) -> DataFrame:
    """df with med, the median over rows from `before` back to `after` ahead, if at least min_n have x."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumn("med", F.when(F.count(x).over(w) >= min_n, stats.frame_median(x, w)))


def dense_calendar(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """df with a row for every day between each key's first and last; has_data tells its own rows from fillers."""
    span = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias(day))
    return days.join(df.withColumn("has_data", F.lit(True)), [*keys, day], "left").withColumn("has_data", rules.yes(F.col("has_data")))


def coverage_sums(df: DataFrame, keys: Sequence[str], day: str, sums: Sequence[tuple[str, int, str, str | None]]) -> DataFrame:
    """df (one row a day and key) with shifted rolling sums of (column, days, sum name, count name).

    The sum is over the days before; a missing value counts as zero on days that have a row, and the count says
    on how many days the value itself was there. Days without a row are not there at all, which is the same as a
    dense calendar without its fillers: the frame is a range of days, so no filler is ever made. Sums are null
    where no earlier day of the frame has a row, and rounded to one decimal.
    """
    number = day_number(day)
    first = F.min(number).over(Window.partitionBy(*keys))
    for x, days, total, seen in sums:
        w = day_frame(keys, day, days)
        df = df.withColumn(total, stats.round_even(F.sum(F.coalesce(F.col(x), F.lit(0)).cast("double")).over(w), 1))
        if seen:
            df = df.withColumn(seen, F.when(number >= first, F.count(x).over(w)).cast("int"))
    return df


def rolling_class(df: DataFrame, keys: Sequence[str], day: str, tie: Sequence[str], x: str, days: int = 60, min_prev: int = 5, out: str = "effort") -> DataFrame:
    """df with a class of x against the quartiles of earlier rows within `days`: above, typical, below, unknown.

    Earlier is by (day, tie), so rows of the same day count if they come first. A missing value among the earlier
    ones leaves no quartiles and the class typical. Rows with a missing key or x are unknown. Rows are dealt by key
    and block of `days` days, to their own block and, as history alone, to the next one, and each block keeps its window's values
    in order: a task never holds more than two blocks of a key.
    """
    at, n = day_number(day), len(keys)
    own = F.floor(at / days).cast("long")
    alone = F.struct((-1 - F.pmod(F.xxhash64(*tie), F.lit(64)) - (1 << 40)).alias("b"), F.lit(True).alias("own"))  # no day: no past, and nobody's
    both = F.array(F.struct(own.alias("b"), F.lit(True).alias("own")), F.struct((own + 1).alias("b"), F.lit(False).alias("own")))
    group, order = [*[f"_k{i}" for i in range(n)], "_b"], ["_d", *[f"_t{i}" for i in range(len(tie))]]
    d = df.select(
        *[F.col(k).alias(g) for k, g in zip(keys, group)], at.alias("_d"), *[F.col(t).alias(o) for t, o in zip(tie, order[1:])], F.col(x).cast("double").alias("_x"), F.struct(*df.columns).alias("_row"),
        F.explode(F.when(at.isNull(), F.array(alone)).otherwise(both)).alias("_c"))
    d = d.withColumns({"_b": F.col("_c.b"), "_own": F.col("_c.own"), "_row": F.when(F.col("_c.own"), F.col("_row"))}).drop("_c").repartition(*group)
    d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).select(*group, "_i", "_d", "_x", "_own", "_row")
    ends = ["_l0", "_l1", "_h0", "_h1"]
    shape = StructType([d.schema["_row"], StructField("_n", LongType()), StructField("_last", LongType()), *[StructField(c, DoubleType()) for c in ends]])
    d = d.groupBy(*group).applyInArrow(lambda t: _past_quartiles(t, days), shape).select("_row.*", "_n", "_last", *ends)
    d = d.withColumns(_quartiles(F.col("_last"))).drop("_last", *ends)
    known = F.col("_n") >= min_prev
    for k in keys:
        known &= F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return d.withColumn(out, rules.versus(x, "_low", "_high", known)).drop("_n", "_low", "_high")


def _quartiles(last: Column) -> dict[str, Column]:
    """_low and _high, from the values on both sides of them; last is the rank of the greatest value, from 0."""
    share = lambda q: last * q - F.floor(last * q)
    return {"_low": stats.between("_l0", "_l1", share(0.25)), "_high": stats.between("_h0", "_h1", share(0.75))}


def _past_quartiles(t: pa.Table, days: int) -> pa.Table:
    """The own rows of a block, with the number of rows before them within `days` and, where none of those lacks x, the rank of the
    greatest value and the values on both sides of the quartiles."""
    t = t.take(pc.sort_indices(t, [("_i", "ascending")]))
    day, x, own = (t[c].to_pylist() for c in ("_d", "_x", "_own"))
    held, first, lacking, got = [], 0, 0, []
    sides = lambda h: (held[int(h)], held[min(int(h) + 1, len(held) - 1)])
    none = (None,) * 5
    for i, (now, v) in enumerate(zip(day, x)):
        if now is None:
            got.append((0, *none))
            continue
        while first < i and day[first] < now - days:
            gone = x[first]
            if gone is None:
                lacking -= 1
            elif gone == gone:
                del held[bisect_left(held, gone)]
            first += 1
        if own[i]:
            last = len(held) - 1
            got.append((i - first, last, *sides(last * 0.25), *sides(last * 0.75)) if last >= 0 and not lacking else (i - first, *none))
        if v is None:
            lacking += 1
        elif v == v:
            insort(held, v)
    n, top, *ends = zip(*got) if got else [()] * 6
    return pa.table({"_row": t.filter(t["_own"])["_row"], "_n": pa.array(n, pa.int64()), "_last": pa.array(top, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in zip(("_l0", "_l1", "_h0", "_h1"), ends)}})


def anchor_class(df: DataFrame, keys: Sequence[str], day: str, x: str, start: str, end: str, min_n: int = 5, out: str = "effort") -> DataFrame:
    """df with a class of x against the quartiles of a fixed period of the same keys."""
    w = Window.partitionBy(*keys)
    v = F.when((F.col(day) >= F.lit(start).cast("date")) & (F.col(day) <= F.lit(end).cast("date")), stats.missing_to_null(x))
    df = df.withColumn("_v", v).withColumns({"_n": F.count("_v").over(w), "_i": F.row_number().over(w.orderBy(F.col("_v").asc_nulls_last())) - 1})
    # the values on both sides of a quartile by their rank; percentile() rounds their line in another way, which leaves a quartile that
    # equals a value a bit above it
    last = F.col("_n") - 1
    ends = {f"_{k}{end}": F.max(F.when((F.col("_n") > 0) & (F.col("_i") == F.least(F.floor(last * q) + end, last)), F.col("_v"))).over(w) for k, q in (("l", 0.25), ("h", 0.75)) for end in (0, 1)}
    df = df.withColumns(ends)
    df = df.withColumns({k: F.when(F.col("_n") >= min_n, v) for k, v in _quartiles(last).items()})
    known = F.col("_low").isNotNull()
    for k in keys:
        known &= F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != "")
    return df.withColumn(out, rules.versus(x, "_low", "_high", known)).drop("_v", "_n", "_i", "_low", "_high", *ends)


def streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, rows: int = 7) -> DataFrame:
    """df with streak, the run of bad rows that ends here, and bad_<rows>, the bad ones among the last rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_bad", rules.yes(bad).cast("int")).withColumn("_g", F.sum(1 - F.col("_bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("streak", F.sum("_bad").over(inside).cast("int")).withColumn(f"bad_{rows}", F.sum("_bad").over(w.rowsBetween(-(rows - 1), 0)).cast("int")).drop("_bad", "_g")


def persistence(df: DataFrame, keys: Sequence[str], order: Sequence[str], gate: str, first: str, second: str, first_days: int = 28, second_days: int = 42) -> DataFrame:
    """df with final, delta, path and why: a gate moved one level where shadows differ from it the same way on two
    of the last three rows. The first shadow is used where it has a gate, else the second."""
    w = Window.partitionBy(*keys).orderBy(*order)
    has = rules.gate_rank(first).isNotNull()
    shadow = F.when(has, rules.gate_rank(first)).otherwise(rules.gate_rank(second))
    source = F.when(has, first_days).otherwise(second_days)
    base = rules.gate_rank(gate)
    df = df.withColumn("_n", F.row_number().over(w))
    last = w.rowsBetween(-2, 0)
    for name, cond in (("worse", shadow > base), ("better", shadow < base)):
        for days in (first_days, second_days):
            df = df.withColumn(f"_{name}{days}", F.sum((rules.yes(cond) & (source == days)).cast("int")).over(last))
    a, b = F.col(f"_worse{first_days}") + F.col(f"_worse{second_days}"), F.col(f"_better{first_days}") + F.col(f"_better{second_days}")
    can = base.isNotNull() & (F.col("_n") >= 3) & ~((a >= 2) & (b >= 2))
    delta = F.when(rules.yes(can & (a >= 2)), -1).when(rules.yes(can & (b >= 2)), 1).otherwise(0)
    pick = lambda name: F.when(F.col(f"_{name}{first_days}") >= F.col(f"_{name}{second_days}"), first_days).otherwise(second_days)
    src = F.when(delta == -1, pick("worse")).otherwise(pick("better"))
    df = df.withColumn("delta", delta).withColumn("_src", src.cast("string"))
    df = df.withColumn("final", rules.shift_gate(gate, -F.col("delta")))
    df = df.withColumn("path", F.when(F.col("delta") == -1, F.concat(F.lit("OVERRIDE_DOWN_"), "_src", F.lit("_2of3"))).when(F.col("delta") == 1, F.concat(F.lit("OVERRIDE_UP_"), "_src", F.lit("_2of3"))).otherwise("BASE60_ONLY"))
    df = df.withColumn("why", F.when(F.col("delta") == -1, F.concat(F.lit("shadow"), "_src", F.lit(" peor 2/3"))).when(F.col("delta") == 1, F.concat(F.lit("shadow"), "_src", F.lit(" mejor 2/3"))).otherwise(""))
    return df.drop("_n", "_src", *[f"_{n}{d}" for n in ("worse", "better") for d in (first_days, second_days)])
