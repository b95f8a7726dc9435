"""Runs of equal state over ordered rows, and their conditional merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SessionConfig
from ..functions.rules import yes


def runs(df: DataFrame, keys: Sequence[str], order: str, state: Column) -> DataFrame:
    """A row for each maximal run of rows where state holds: keys, run (from 1), first, last (order values), n."""
    w = Window.partitionBy(*keys).orderBy(order)
    on = df.withColumn("_on", yes(state)).withColumn("_g", F.row_number().over(w) - F.sum(F.col("_on").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = on.where("_on").groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")))


def longest_run(df: DataFrame, keys: Sequence[str], order: str, state: Column) -> DataFrame:
    """keys and longest, 0 where state never holds."""
    return df.select(*keys).distinct().join(runs(df, keys, order, state).groupBy(*keys).agg(F.max("n").alias("longest")), list(keys), "left").fillna({"longest": 0})


def box_mean(df: DataFrame, keys: Sequence[str], order: str, x: str, rows: int, out: str = "smooth") -> DataFrame:
    """df with the sum of x over a centred frame of so many rows, by their number; short frames at the ends are not
    scaled, as in a convolution of the same length. Null where a row of the frame has no x."""
    half = rows // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, rows - half - 1)
    return df.withColumn(out, F.when(F.count(x).over(w) == F.count("*").over(w), F.sum(x).over(w) / rows))


def work_blocks(samples: DataFrame, keys: Sequence[str], cfg: SessionConfig = SessionConfig(), above: Column | None = None) -> DataFrame:
    """Merged effort blocks of (keys, sec from 0, hr, moving, vt1): keys, start, stop in seconds, both inside, and with
    `above` n_above, the samples of a block where it holds.

    A raw block is a run of moving samples at vt1 or above. A gap joins two blocks if it is at most gap_max_s long,
    all of it is below vt1 (a missing value is not), and the mean of the last exit_s samples of the block so far
    exceeds the least smoothed value in the gap by at most hr_drop_max. The block so far starts where the merged one
    does, so blocks are folded in order. Each brings running sums of its session at its two ends, from which means and counts of any
    merged block follow, so samples are dealt out once and never joined with blocks.
    """
    order = Window.partitionBy(*keys).orderBy("sec")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    exit_ = order.rangeBetween(-(cfg.exit_s - 1), 0)
    on = yes((F.col("hr") >= F.col("vt1")) & F.col("moving"))
    hit = yes(above).cast("int") if above is not None else F.lit(0)
    hr = F.col("hr").cast("double")
    s = box_mean(samples.withColumns({"_on": on, "_hit": hit}), keys, "sec", "hr", cfg.smooth_s, "_smooth")
    s = s.withColumn("_new", (F.col("_on") & ~yes(F.lag("_on").over(order))).cast("int"))
    # _b numbers the block that a sample is in, or that a gap's samples come after
    s = s.withColumns({
        "_b": F.sum("_new").over(upto), "_sum": F.sum(hr).over(upto), "_rows": F.count("*").over(upto), "_vals": F.count("hr").over(upto), "_hits": F.sum("_hit").over(upto),
        "_xs": F.sum(hr).over(exit_), "_xr": F.count("*").over(exit_), "_xv": F.count("hr").over(exit_)}).where("_b > 0")
    at = lambda c: F.when(F.col("_on"), c)
    off = lambda c: F.when(~F.col("_on"), c)
    own = lambda k: F.when(F.col("hr").isNotNull(), hr).otherwise(0.0) if k == "_sum" else F.lit(1)
    # sums before a block's first sample, and up to and with its last one
    before = F.struct((F.coalesce("_sum", F.lit(0.0)) - own("_sum")).alias("sum"), (F.col("_rows") - 1).alias("rows"), (F.col("_vals") - F.col("hr").isNotNull().cast("int")).alias("vals"), (F.col("_hits") - F.col("_hit")).alias("hits"))
    ahead = F.struct(F.coalesce("_sum", F.lit(0.0)).alias("sum"), F.col("_rows").alias("rows"), F.col("_vals").alias("vals"), F.col("_hits").alias("hits"), F.when(F.col("_xv") == F.col("_xr"), F.col("_xs") / F.col("_xr")).alias("exit"))
    each = s.groupBy(*keys, "_b").agg(
        F.min(at(F.col("sec").cast("long"))).alias("s"), F.max(at(F.col("sec").cast("long"))).alias("e"), F.min_by(before, at(F.col("sec"))).alias("p"), F.max_by(ahead, at(F.col("sec"))).alias("q"),
        F.count_if(~F.col("_on")).alias("gap"), F.min(off(yes(F.col("hr") < F.col("vt1")))).alias("_low"), F.min(off(F.col("_smooth"))).alias("floor"), F.count_if(~F.col("_on") & F.col("_smooth").isNull()).alias("_rough"))
    each = each.withColumn("ok", yes(F.col("_low")) & (F.col("_rough") == 0) & (F.col("gap") <= cfg.gap_max_s))
    parts = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e", "p", "q", "ok", "floor"))).alias("_p"))
    whole = lambda first, last: F.struct(first["s"].alias("s"), last["e"].alias("e"), first["p"].alias("p"), last["q"].alias("q"))

    def fold(done: Column, x: Column) -> Column:
        run, gap = done["run"], done["gap"]
        rows = run["q"]["rows"] - run["p"]["rows"]
        short = F.when(run["q"]["vals"] - run["p"]["vals"] == rows, (run["q"]["sum"] - run["p"]["sum"]) / rows)
        mean = F.when(run["s"] > run["e"] - cfg.exit_s, short).otherwise(run["q"]["exit"])
        join = yes(gap["ok"] & (mean - gap["floor"] <= cfg.hr_drop_max))
        now = F.struct(x["ok"].alias("ok"), x["floor"].alias("floor"))
        return F.when(join, F.struct(done["out"].alias("out"), whole(run, x).alias("run"), now.alias("gap"))).otherwise(
            F.struct(F.concat(done["out"], F.array(run)).alias("out"), whole(x, x).alias("run"), now.alias("gap")))

    first = F.col("_p")[0]
    kind = f"array<{each.select(whole(F.struct('s', 'e', 'p', 'q'), F.struct('s', 'e', 'p', 'q')).alias('x')).schema['x'].dataType.simpleString()}>"
    start = F.struct(F.array().cast(kind).alias("out"), whole(first, first).alias("run"), F.struct(first["ok"].alias("ok"), first["floor"].alias("floor")).alias("gap"))
    merged = parts.select(*keys, F.explode(F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), start, fold, lambda d: F.concat(d["out"], F.array(d["run"])))).alias("_m"))
    hits = [(F.col("_m.q.hits") - F.col("_m.p.hits")).alias("n_above")] if above is not None else []
    return merged.select(*keys, F.col("_m.s").alias("start"), F.col("_m.e").alias("stop"), *hits)


def merge_adjacent(segments: DataFrame, keys: Sequence[str], gap_max: float, extra: Column | None = None) -> DataFrame:
    """Segments (start, stop) joined where the gap to the one before is at most gap_max and `extra` allows it.

    The decision uses neighbours only, so it is a running count of breaks: keys, block, start, stop, n.
    """
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    join = F.col("start") - F.lag("stop").over(w) <= gap_max
    join = join & extra if extra is not None else join
    marked = segments.withColumn("_break", (~yes(join)).cast("int")).withColumn("block", F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "block").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n"))
