"""Short-term fractal scaling of beat series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DfaConfig
from ..functions.rules import yes


def count_windows(beats: DataFrame, keys: Sequence[str], cfg: DfaConfig = DfaConfig()) -> DataFrame:
    """beats (strict ones, in order of beat_idx) once for each complete window of win_beats they lie in:
    window (from 0) and pos (from 0 inside it). A beat is in win / step windows at most."""
    w = Window.partitionBy(*keys)
    ranked = beats.withColumn("_r", F.row_number().over(w.orderBy("beat_idx")) - 1).withColumn("_n", F.count("*").over(w))
    low = F.greatest(F.ceil((F.col("_r") - cfg.win_beats + 1) / cfg.step_beats), F.lit(0))
    high = F.least(F.floor(F.col("_r") / cfg.step_beats), F.floor((F.col("_n") - cfg.win_beats) / cfg.step_beats))
    each = ranked.where(F.col("_n") >= cfg.win_beats).withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi")
    return each.withColumn("window", F.explode(F.sequence("_lo", "_hi"))).withColumn("pos", F.col("_r") - F.col("window") * cfg.step_beats).drop("_r", "_n", "_lo", "_hi")


def alpha(windows: DataFrame, keys: Sequence[str], x: str, cfg: DfaConfig = DfaConfig(), both_ends: bool = True) -> DataFrame:
    """keys, window, alpha and n_scales: slope of log fluctuation on log box size.

    The profile (running sum of x less its mean) is cut into boxes of each size from the start and, for both_ends,
    from the end; a box's mean squared residual around its own line is (syy - sxy^2 / sxx) / n. Sizes with fewer than four
    boxes are left out; at least five sizes are needed. A window is one row with its few hundred values, so a task's memory
    does not grow with the number of boxes. x has no nulls.
    """
    values = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(x).cast("double").alias("x")))), lambda v: v["x"])
    each = windows.groupBy(*keys, "window").agg(values.alias("_v")).where(F.size("_v") >= cfg.scale_max * 4)

    @F.pandas_udf("a double, n long")
    def slopes(v: pd.Series) -> pd.DataFrame:
        return _slopes(v, cfg.scale_min, cfg.scale_max, both_ends)

    fit = each.select(*keys, "window", slopes("_v").alias("_f")).where("_f.n > 0")
    return fit.select(*keys, "window", F.when(F.col("_f.n") >= 5, F.col("_f.a")).alias("alpha"), F.col("_f.n").alias("n_scales"))


def _slopes(values: pd.Series, low: int, high: int, both_ends: bool) -> pd.DataFrame:
    """The slope and the number of sizes with a fluctuation for each of many windows, those of one length at a time."""
    length, got = values.map(len).to_numpy(), np.full((len(values), 2), np.nan)
    for n in np.unique(length):
        of = np.flatnonzero(length == n)
        for rows in np.array_split(of, -(-len(of) // 1024)):
            x = np.stack(values.iloc[rows].to_list())
            y = np.cumsum(x - x.mean(1, keepdims=True), 1)
            sizes = [s for s in range(max(low, 2), high + 1) if n // s >= 4]
            f = np.zeros((len(rows), len(sizes)))
            for i, s in enumerate(sizes):
                t = np.arange(s) - (s - 1) / 2
                boxes = np.concatenate([side[:, : n // s * s].reshape(len(rows), -1, s) for side in ((y, y[:, ::-1]) if both_ends else (y,))], 1)
                boxes = boxes - boxes.mean(2, keepdims=True)
                left = ((boxes**2).sum(2) - (boxes @ t) ** 2 / (t @ t)) / s
                f[:, i] = np.sqrt(np.maximum(left, 0).mean(1))
            there = f > 0
            m = there.sum(1)
            lx, ly = np.where(there, np.log(sizes), 0.0), np.log(np.where(there, f, 1.0))
            with np.errstate(invalid="ignore", divide="ignore"):
                dx = np.where(there, lx - (lx.sum(1) / m)[:, None], 0.0)
                got[rows] = np.column_stack([(dx * ly).sum(1) / (dx**2).sum(1), m])
    return pd.DataFrame({"a": got[:, 0], "n": got[:, 1].astype("int64")})


def alpha_summary(found: DataFrame, keys: Sequence[str], usable: str = "usable") -> DataFrame:
    """keys, n, n_usable, median, q25, q75, iqr, pct_lt_075 of alpha over usable windows."""
    a = F.when(yes(F.col(usable)), F.col("alpha"))
    q = F.percentile(a, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    got = found.groupBy(*keys).agg(F.count("*").alias("n"), F.count(a).alias("n_usable"), q.alias("_q"), (100 * F.avg(F.when(a.isNotNull(), (a < 0.75).cast("int")))).alias("pct_lt_075"))
    return got.select(*keys, "n", "n_usable", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q25"), F.col("_q")[2].alias("q75"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"), "pct_lt_075")


def crossing(bins: DataFrame, keys: Sequence[str], rate: str, level: str, target: float = 0.75) -> DataFrame:
    """keys, rate_at_target, n_crossings: neighbouring bins whose levels lie on both sides of the target, their line
    taken to it; the pair nearest to the target counts, ties to the lower rate."""
    w = Window.partitionBy(*keys).orderBy(rate)
    b = bins.withColumn("_x2", F.lead(rate).over(w)).withColumn("_y2", F.lead(level).over(w))
    a, z = F.col(level) - target, F.col("_y2") - target
    hit = b.where((a * z <= 0) & (a != z)).withColumn("_score", F.abs(a) + F.abs(z)).withColumn("_at", F.col(rate) + (F.col("_x2") - F.col(rate)) * (-a) / (z - a))
    n = hit.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).withColumn("_mid", F.percentile("_at", 0.5).over(Window.partitionBy(*keys)))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_score", rate))).where("_r = 1")
    return best.select(*keys, F.col("_at").alias("rate_at_target"), F.col("_mid").alias("median_crossing"), F.col("_n").alias("n_crossings"))
