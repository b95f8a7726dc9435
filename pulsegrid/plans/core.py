"""Daily measurements from beat recordings: one row for each (entity, day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import BeatConfig
from ..functions import stats
from ..functions.rules import yes
from ..operators import beats as B

KEY = ["entity", "day"]


def segments(raw: DataFrame, cfg: BeatConfig = BeatConfig(), rescue: bool = False) -> DataFrame:
    """Every beat with its recording's figures, latency and t_start, and whether it is of the effective (eff), the
    steady and the last part of the recording.

    All windows are over a recording, so the beats are dealt once; only the latency, which comes from overlapping
    windows, is joined back."""
    one = Window.partitionBy(*KEY)
    d = B.jump_from_base(B.time_axis(raw, KEY), KEY, cfg)
    counts = {"n_off": "offline", "n_oor": "out_of_range", "n_base": "base", "n_jump": "jump", "n_clean": "clean"}
    d = d.select("*", F.count("*").over(one).alias("n_total"), F.max("t_end").over(one).alias("dur_raw"), *[F.count_if(c).over(one).alias(n) for n, c in counts.items()])
    end = F.col("dur_raw") - cfg.tail_trim_s
    d = d.select(
        "*", end.alias("end_eff"), (100 * (F.col("n_off") + F.col("n_oor") + F.col("n_jump")) / F.col("n_total")).alias("artifact_pct"),
        F.when(end > 0, F.floor(end / cfg.step_s) + 1).otherwise(1).alias("n_win"), (F.col("clean") & (F.col("t_end") <= end)).alias("eff"))
    if rescue:
        d = d.withColumn("latency", F.lit(None).cast("double"))
    else:
        windows = B.sliding_rmssd(d.where("eff"), [*KEY, "n_win"], cfg).where("k < n_win")
        d = d.join(B.stable_start(windows, KEY, "n_win", cfg), KEY, "left")
    start = F.greatest(F.coalesce("latency", F.lit(cfg.start_min_s)), F.lit(cfg.start_min_s))
    return d.select("*", start.alias("t_start"), (F.col("eff") & (F.col("t_end") >= start)).alias("steady"), (F.col("eff") & (F.col("t_end") >= F.col("end_eff") - cfg.tail_s)).alias("tail"))


def figures(seg: DataFrame, cfg: BeatConfig = BeatConfig(), min_index: int = 20, min_cloud: int = 10) -> DataFrame:
    """One row for each recording: its figures, and the statistics of its steady and its last part."""
    x = F.col("duration_ms")
    of = lambda part, c: F.when(F.col(part), c)
    before = lambda part: of(part, F.lag(x).over(Window.partitionBy(*KEY, part).orderBy("beat_idx")))
    part = Window.partitionBy(*KEY, "steady")
    d = seg.select("*", before("steady").alias("_ps"), before("tail").alias("_pt"), of("steady", F.min(x).over(part)).alias("_lo"), of("steady", F.max(x).over(part)).alias("_hi"))
    last = F.ceil((F.col("_hi") - F.col("_lo")) / cfg.bin_ms) - 1
    d = d.withColumn("_bin", F.least(F.floor((x - F.col("_lo")) / cfg.bin_ms), last))
    d = d.withColumn("_full", F.count("*").over(Window.partitionBy(*KEY, "steady", "_bin")))
    same = ["n_total", "dur_raw", "n_off", "n_oor", "n_base", "n_jump", "n_clean", "end_eff", "artifact_pct", "latency", "t_start"]
    gap = of("steady", x - F.col("_ps"))
    g = d.groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in same], F.count_if("steady").alias("n_steady"), (F.avg(of("steady", x)) / 1000).alias("rr"), F.sqrt(F.avg(F.pow(gap, 2))).alias("rmssd"), F.max(of("steady", F.col("t_end"))).alias("steady_end"),
        F.count_if("tail").alias("n_tail"), (F.max(of("tail", F.col("t_end"))) - F.min(of("tail", F.col("t_end")))).alias("dur_tail"), F.sqrt(F.avg(F.pow(of("tail", x - F.col("_pt")), 2))).alias("rmssd2"),
        F.when(F.count_if("tail") > 1, F.stddev_pop(of("tail", x)) / F.avg(of("tail", x))).alias("cv"),
        F.max(of("steady", F.struct(F.col("_full").alias("n"), (-F.col("_bin")).alias("b")))).alias("_top"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"),
        (F.stddev_pop(gap) / F.sqrt(F.lit(2.0))).alias("_1"), F.var_pop(of("steady", x)).alias("_v"))
    reach = (F.col("_hi") - F.col("_lo")) / 1000
    mode = (F.col("_lo") + (-F.col("_top.b") + 0.5) * cfg.bin_ms) / 1000
    index = F.when((F.col("n_steady") >= min_index) & (reach > 0), stats.round_even(100 * F.col("_top.n") / F.col("n_steady") / (2 * mode * reach), 1))
    two = F.sqrt(F.greatest(2 * F.col("_v") - F.pow("_1", 2), F.lit(0.0)))
    g = g.withColumn("_2", two)
    many = F.col("n_steady") >= min_cloud
    return g.select(
        *KEY, *same, "n_steady", "rr", "rmssd", "steady_end", "n_tail", "dur_tail", "rmssd2", "cv", index.alias("si"), F.when(many, stats.round_even("_1", 2)).alias("sd1"), F.when(many, stats.round_even("_2", 2)).alias("sd2"),
        F.when(many & (F.col("_2") > 0), stats.round_even(F.col("_1") / F.col("_2"), 3)).alias("ratio"))


def measurement_flags(latency, artifact, subtype, rescue: bool = False, cfg: BeatConfig = BeatConfig()) -> Column:
    """The delimited flags of a measurement."""
    a, kind = stats.col(artifact), stats.col(subtype)
    return F.concat_ws(
        "|", F.when(F.lit(rescue), "RESCUE_MODE"), F.when(stats.col(latency).isNull(), "LAT_NAN"), F.when(a > cfg.artifact_ok_max, "ART_GT15"), F.when(a > cfg.artifact_max, "ART_GT20"), F.when(kind != "OK", kind))


def measurements(raw: DataFrame, cfg: BeatConfig = BeatConfig(), rescue: bool = False) -> DataFrame:
    """The contract table from (entity, day, beat_idx, duration_ms, offline). rescue starts at a fixed time and never
    rates a day OK."""
    d = figures(segments(raw, cfg, rescue), cfg)
    d = d.fillna(0, ["n_steady", "n_tail", "dur_tail"]).withColumn("hr", F.when(F.col("rr") > 0, 60 / F.col("rr"))).withColumn("mismatch", F.when(F.col("rmssd") > 0, F.abs(F.col("rmssd2") - F.col("rmssd")) / F.col("rmssd")))
    subtype = (
        F.when((F.col("dur_tail") < cfg.tail_min_s) | (F.col("n_tail") - 1 < cfg.tail_min_pairs), "STAB_TAIL_SHORT").when(F.col("cv") > cfg.cv_max, "STAB_CV120_HIGH")
        .when(F.col("rmssd2").isNull(), "STAB_LAST2_NAN").when(F.col("mismatch") > cfg.mismatch_max, "STAB_LAST2_MISMATCH").otherwise("OK"))
    d = d.withColumn("subtype", subtype).withColumn("stability", F.when(F.col("subtype") == "OK", "OK").otherwise("Unstable"))
    invalid = yes(F.col("artifact_pct") > cfg.artifact_max) | yes((F.col("hr") < cfg.hr_min) | (F.col("hr") > cfg.hr_max))
    late = F.greatest(F.col("latency"), F.lit(60.0))
    good = yes(F.col("latency").isNotNull() & (F.col("artifact_pct") <= cfg.artifact_ok_max) & late.between(60, 600) & (F.col("stability") == "OK"))
    d = d.withColumn("quality", F.when(invalid, "INVALID").when(good, "OK").otherwise("FLAG_mecánico"))
    flags = measurement_flags("latency", "artifact_pct", "subtype", rescue, cfg)
    steady_s = F.coalesce(F.col("steady_end") - F.col("t_start"), F.lit(0.0))
    notes = F.format_string(
        "src=%s; dur_raw=%.1fs; dur_eff=%.1fs; t_start_eff=%.1fs; dur_tramo=%.1fs; dur_tail=%.1fs; n_total=%d; n_base=%d; n_clean=%d; n_tramo=%d; n_tail=%d; off=%d; oor=%d; dRR=%d; lat_mode=%s; stab=%s",
        F.concat(F.col("entity").cast("string"), F.lit("_"), F.col("day").cast("string")), "dur_raw", "end_eff", "t_start", steady_s, F.col("dur_tail").cast("double"),
        "n_total", "n_base", "n_clean", "n_steady", "n_tail", "n_off", "n_oor", "n_jump", F.when(F.col("latency").isNull(), "NAN").otherwise("NUM"), "stability")
    named = {
        "Fecha": F.col("day"), "Calidad": F.col("quality"), "HRV_Stability": F.col("stability"), "Stability_Subtype": F.col("subtype"), "Artifact_pct": F.col("artifact_pct"),
        "Tiempo_Estabilizacion": F.col("latency"), "HR_stable": F.col("hr"), "RRbar_s": F.col("rr"), "RMSSD_stable": F.col("rmssd"), "RMSSD_stable_last2": F.col("rmssd2"),
        "tail_mismatch_pct": 100 * F.col("mismatch"), "lnRMSSD": F.when(F.col("rmssd") > 0, F.log("rmssd")), "Flags": flags, "SI_baevsky": F.col("si"), "SD1": F.col("sd1"),
        "SD2": F.col("sd2"), "SD1_SD2_ratio": F.col("ratio"), "Notes": notes,
    }
    return d.select("entity", *[named[c].alias(c) for c in schema.CORE])


def balance(raw: DataFrame, cfg: BeatConfig = BeatConfig(), min_beats: int = 20) -> DataFrame:
    """entity, day, si, sd1, sd2, ratio of the stable segment, for filling in history; null below min_beats."""
    g = figures(segments(raw, cfg), cfg, min_beats, min_beats)
    return g.where("n_steady > 0").select(*KEY, "si", "sd1", "sd2", "ratio")
