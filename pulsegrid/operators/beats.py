"""Beat series: filters, time axis, windows and segment metrics. A series is (keys, beat_idx, duration_ms, offline)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BeatConfig, DfaConfig
from ..functions import stats
from ..functions.rules import yes
from . import folds


def _order(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("beat_idx")


def time_axis(beats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Beats with a duration, with t_end in seconds: the running sum of raw durations, which no filter compresses.

    What rounding takes from the sum at each beat is summed too and put back, so a beat that ends on a window's edge is on it.
    """
    w = _order(keys)
    so_far = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    beats = beats.withColumn("duration_ms", stats.missing_to_null("duration_ms")).where("duration_ms IS NOT NULL").withColumn("offline", F.coalesce(F.col("offline").cast("boolean"), F.lit(False)))
    beats = beats.withColumn("_t", so_far("duration_ms")).withColumn("_p", F.lag("_t", 1, 0.0).over(w))
    beats = beats.withColumn("_l", stats.lost(F.col("_p"), F.col("duration_ms"), F.col("_t")))
    return beats.withColumn("t_end", (F.col("_t") + F.nanvl(so_far("_l"), F.lit(0.0))) / 1000).drop("_t", "_p", "_l")


def jump_from_base(beats: DataFrame, keys: Sequence[str], cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """beats with out_of_range, base, jump and clean; a jump is measured from the previous base beat, kept or not."""
    out = ~F.col("offline") & ((F.col("duration_ms") < cfg.min_ms) | (F.col("duration_ms") > cfg.max_ms))
    b = beats.withColumn("out_of_range", out).withColumn("base", ~F.col("offline") & ~F.col("out_of_range"))
    before = F.lag("duration_ms").over(Window.partitionBy(*keys, "base").orderBy("beat_idx"))
    b = b.withColumn("jump", yes(F.col("base") & (F.abs(F.col("duration_ms") - before) / before > cfg.delta_max)))
    return b.withColumn("clean", F.col("base") & ~F.col("jump"))


def jump_from_raw(beats: DataFrame, keys: Sequence[str], cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """beats with reason: out_of_range, or jump from the previous raw beat, or empty."""
    before = F.lag("duration_ms").over(_order(keys))
    inside = F.col("duration_ms").between(cfg.min_ms, cfg.max_ms)
    return beats.withColumn("reason", F.when(~inside, "out_of_range").when(yes((before > 0) & (F.abs(F.col("duration_ms") - before) / before > cfg.delta_max)), "jump").otherwise(""))


def jump_from_accepted(beats: DataFrame, keys: Sequence[str], cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """keys, beat_idx, accepted and reason; a jump is measured from the last accepted beat.

    Whether a beat is accepted depends on all decisions before it, so the last accepted duration is a held state: a
    recording is cut into pieces of beats, which tasks go through side by side.
    """
    guard = folds.Guard("ratio", cfg.delta_max)
    d = F.col("duration_ms").cast("double")
    b = beats.select(*keys, F.col("beat_idx").cast("long").alias("beat_idx"), d.alias("_d"), F.when(F.col("offline"), "offline").when((d < cfg.min_ms) | (d > cfg.max_ms), "out_of_range").otherwise("").alias("_r"))
    whole = F.when(F.col("_r") == "", F.col("_d"))
    b = folds.held(b, keys, "beat_idx", F.floor(F.col("beat_idx") / folds.PIECE), whole, whole, guard, (cfg.min_ms, cfg.max_ms))
    reason = F.when((F.col("_r") == "") & yes(~guard.column(F.col("before"), F.col("_d"))), "jump").otherwise(F.col("_r"))
    return b.select(*keys, "beat_idx", (reason == "").alias("accepted"), reason.alias("reason"))


def local_artifacts(beats: DataFrame, keys: Sequence[str], cfg: DfaConfig = DfaConfig()) -> DataFrame:
    """beats (with accepted) and local_artifact, strict: accepted beats far from the centred median of their neighbours."""
    half = cfg.local_beats // 2
    w = Window.partitionBy(*keys, "accepted").orderBy("beat_idx").rowsBetween(-half, cfg.local_beats - half - 1)
    least = max(3, cfg.local_beats // 2 + 1)
    mid = F.when(F.count("duration_ms").over(w) >= least, stats.frame_median("duration_ms", w))
    b = beats.withColumn("local_artifact", yes(F.col("accepted") & (F.abs(F.col("duration_ms") - mid) / mid > cfg.local_rel)))
    return b.withColumn("strict", F.col("accepted") & ~F.col("local_artifact"))


def sliding_rmssd(beats: DataFrame, keys: Sequence[str], cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """keys, k, rmssd of overlapping windows [k step, k step + window) over (t_end, duration_ms); null with few pairs.

    A beat goes to each window that holds it, and differences are taken inside a window.
    """
    per = int(cfg.window_s // cfg.step_s)
    k = F.floor(F.col("t_end") / cfg.step_s)
    each = beats.withColumn("k", F.explode(F.array(*[k - i for i in range(per)]))).where("k >= 0")
    each = each.withColumn("_p", F.lag("duration_ms").over(Window.partitionBy(*keys, "k").orderBy("beat_idx")))
    return each.groupBy(*keys, "k").agg(F.when(F.count("_p") >= cfg.min_pairs, stats.rmssd("duration_ms", "_p")).alias("rmssd"))


def stable_start(windows: DataFrame, keys: Sequence[str], n_windows: str, cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """keys and latency in seconds: the first window whose change to both neighbours is small, else the first of three
    that are all near the median of the last four valid ones, else null. n_windows bounds the window index."""
    near = lambda a, b: yes((a > 0) & (F.abs(b - a) / a < cfg.stable_rel))
    # a recording's windows, one for every step_s seconds, as one array
    each = windows.groupBy(*keys, F.col(n_windows).alias("_n")).agg(F.sort_array(F.collect_list(F.struct("k", F.col("rmssd").alias("v")))).alias("_w"))
    valid = F.transform(F.filter("_w", lambda s: s["v"].isNotNull()), lambda s: s["v"])
    each = each.withColumn("_goal", F.when(F.size(valid) >= 4, stats.median(F.slice(valid, -4, 4))))

    def at(i: Column, k: Column, off: int) -> Column:
        """The value off windows further; a window without beats has no row, so its index must be the next."""
        s = F.get("_w", i + off)
        return F.when(s["k"] == k + off, s["v"])

    def first(s: Column, i: Column) -> Column:
        k, x = s["k"], s["v"]
        return F.when((k >= 1) & (k <= F.col("_n") - 2) & near(at(i, k, -1), x) & near(x, at(i, k, 1)), k)

    def second(s: Column, i: Column) -> Column:
        close = lambda c: yes((F.col("_goal") > 0) & (F.abs(c - F.col("_goal")) / F.col("_goal") < cfg.stable_rel))
        k = s["k"]
        return F.when((k <= F.col("_n") - 3) & close(s["v"]) & close(at(i, k, 1)) & close(at(i, k, 2)), k)

    found = F.coalesce(F.array_min(F.transform("_w", first)), F.array_min(F.transform("_w", second)))
    return each.select(*keys, (found * cfg.step_s).alias("latency"))


def stress_index(beats: DataFrame, keys: Sequence[str], min_beats: int = 20, bin_ms: float = 50.0) -> DataFrame:
    """keys and stress index: modal share in percent over twice the mode times the range, all in seconds.

    Bins start at the least value, the last one is closed, and the first of equally full ones is the mode.
    """
    span = beats.groupBy(*keys).agg(F.min("duration_ms").alias("_lo"), F.max("duration_ms").alias("_hi"), F.count("*").alias("_n"))
    span = span.where((F.col("_n") >= min_beats) & (F.col("_hi") > F.col("_lo")))
    last = F.ceil((F.col("_hi") - F.col("_lo")) / bin_ms) - 1
    binned = beats.join(span, list(keys)).withColumn("_bin", F.least(F.floor((F.col("duration_ms") - F.col("_lo")) / bin_ms), last))
    counts = binned.groupBy(*keys, "_bin", "_lo", "_hi", "_n").agg(F.count("*").alias("_c"))
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_c"), "_bin"))).where("_r = 1")
    mode = (F.col("_lo") + (F.col("_bin") + 0.5) * bin_ms) / 1000
    share, reach = 100 * F.col("_c") / F.col("_n"), (F.col("_hi") - F.col("_lo")) / 1000
    return top.select(*keys, stats.round_even(share / (2 * mode * reach), 1).alias("si"))


def poincare(beats: DataFrame, keys: Sequence[str], min_beats: int = 10) -> DataFrame:
    """keys, sd1, sd2 and their ratio of successive durations."""
    d = beats.withColumn("_d", F.col("duration_ms") - F.lag("duration_ms").over(_order(keys)))
    one = F.stddev_pop("_d") / F.sqrt(F.lit(2.0))
    many = d.groupBy(*keys).agg(F.count("*").alias("_n"), one.alias("sd1"), F.var_pop("duration_ms").alias("_v")).where(F.col("_n") >= min_beats)
    two = 2 * F.col("_v") - F.pow("sd1", 2)
    out = many.withColumn("sd2", F.sqrt(F.greatest(two, F.lit(0.0))))
    return out.select(*keys, stats.round_even("sd1", 2).alias("sd1"), stats.round_even("sd2", 2).alias("sd2"), F.when(F.col("sd2") > 0, stats.round_even(F.col("sd1") / F.col("sd2"), 3)).alias("ratio"))


def tumbling_rmssd(beats: DataFrame, keys: Sequence[str], cfg: DfaConfig = DfaConfig(), seconds: int | None = None) -> DataFrame:
    """Windows (k s, (k + 1) s] over t_end with counts, valid shares, rmssd of accepted beats, usable and reason.

    Empty windows up to the last beat are there too. beats have accepted and strict.
    """
    s = seconds or cfg.rmssd_s
    b = beats.withColumn("k", F.greatest(F.ceil(F.col("t_end") / s) - 1, F.lit(0)))
    b = b.withColumn("_p", F.when(F.col("accepted"), F.lag("duration_ms").over(Window.partitionBy(*keys, "k", "accepted").orderBy("beat_idx"))))
    held = b.groupBy(*keys, "k").agg(
        F.count("*").alias("beats"), F.count_if("accepted").alias("core"), F.count_if("strict").alias("strict"),
        F.when(F.count_if("accepted") >= 3, stats.rmssd("duration_ms", "_p")).alias("_r"))
    every = b.groupBy(*keys).agg(F.max("k").alias("_m")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("k"))
    w = every.join(held, [*keys, "k"], "left").fillna(0, ["beats", "core", "strict"])
    share = lambda c: F.when(F.col("beats") > 0, F.col(c) / F.col("beats")).otherwise(0.0)
    reason = (
        F.when(F.col("beats") == 0, "no_beats").when(F.col("core") < cfg.rmssd_min_beats, "insufficient_core_beats")
        .when(share("core") < cfg.rmssd_min_valid, "low_valid_fraction_core").when(F.col("_r").isNull(), "rmssd_nan").otherwise("ok"))
    w = w.withColumn("reason", reason).withColumn("usable", F.col("reason") == "ok")
    return w.select(
        *keys, "k", (F.col("k") * s).cast("double").alias("window_start_sec"), "beats", "core", "strict", stats.round_even(share("core"), 6).alias("valid_core"),
        stats.round_even(share("strict"), 6).alias("valid_strict"), F.when(F.col("usable"), stats.round_even("_r", 6)).alias("rmssd"), "usable", "reason")


def input_quality(raw: DataFrame, keys: Sequence[str], duration: str, offline: str) -> DataFrame:
    """keys, rows, bad_duration, unknown_offline, offline_pct of a raw text scan."""
    from ..functions.parse import number, offline_flag

    t = raw.withColumn("_d", number(duration)).withColumn("_o", offline_flag(offline))
    return t.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("_d").isNull()).alias("bad_duration"), F.count_if(~F.col("_o.known")).alias("unknown_offline"),
        (100 * F.avg(F.col("_o.offline").cast("int"))).alias("offline_pct"))


def validate(beats: DataFrame, keys: Sequence[str], duration: str = "duration", offline: str = "offline", cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """keys, ok, issues, rows, offline_pct and out_of_range of beat series as they are to be written.

    Text that is no number counts as missing. A column that isn't there is an issue of every series.
    """
    have = {c.lower() for c in beats.columns}
    gone = [c for c in (duration, offline) if c.lower() not in have]
    value = lambda c: F.col(c).cast("string").try_cast("double") if c not in gone else F.lit(None).cast("double")
    d, o = value(duration), value(offline)
    n = lambda cond: F.count_if(yes(cond)) > 0
    found = [
        F.when(n(d.isNull()), "duration is missing or no number"), F.when(n(o.isNull()), "offline is missing or no number"),
        F.when(n(d <= 0), "duration is not positive"), F.when(n(o.isNull() | ~o.isin(0.0, 1.0)), "offline is not 0 or 1")]
    issues = F.array_compact(F.array(*[F.lit(f"no column {c}") for c in gone], *found))
    out = beats.groupBy(*keys).agg(issues.alias("issues"), F.count("*").alias("rows"), (100 * F.avg((F.coalesce(o, F.lit(0.0)) == 1).cast("int"))).alias("offline_pct"), F.count_if((d < cfg.min_ms) | (d > cfg.max_ms)).alias("out_of_range"))
    return out.withColumn("ok", F.size("issues") == 0)
