"""In-session beat analysis for all sessions at once: layers, windows, fractal scaling, gates and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BeatConfig, DfaConfig, LevelConfig
from ..functions import stats
from ..functions.rules import evidence, yes
from ..operators import beats as B
from ..operators import dfa as D
from ..operators.joins import interpolate
from ..sources.scratch import written

KEY = ["entity", "session_id"]


def layers(raw: DataFrame, beat: BeatConfig = BeatConfig(), cfg: DfaConfig = DfaConfig()) -> DataFrame:
    """raw beats with t_end, accepted, reason, local_artifact and strict."""
    timed = B.time_axis(raw, KEY)
    return B.local_artifacts(timed.join(B.jump_from_accepted(timed, KEY, beat), [*KEY, "beat_idx"]), KEY, cfg)


def dfa_windows(beats: DataFrame, hr: DataFrame | None = None, cfg: DfaConfig = DfaConfig()) -> DataFrame:
    """Windows of strict beats with the share of accepted and strict ones among the raw beats they span, the longest
    run of local artifacts there, alpha, usable, reason, and the heart rate at the centre.

    What lies between a window's first and last beat is counted by differences of running sums, without a join on
    time."""
    w = Window.partitionBy(*KEY).orderBy("beat_idx").rowsBetween(Window.unboundedPreceding, 0)
    b = beats.withColumn("_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy("beat_idx")))
    for c in ("accepted", "strict"):
        b = b.withColumn(f"_{c}", F.sum(F.col(c).cast("long")).over(w))
    # the length so far of the run of local artifacts that a beat ends
    b = b.withColumn("_g", F.sum((~F.col("local_artifact")).cast("int")).over(w)).withColumn("_run", F.sum(F.col("local_artifact").cast("int")).over(Window.partitionBy(*KEY, "_g").orderBy("beat_idx").rowsBetween(Window.unboundedPreceding, 0)))
    placed = D.count_windows(b.where("strict"), KEY, cfg)
    span = placed.groupBy(*KEY, "window").agg(
        F.min(F.col("t_end") - F.col("duration_ms") / 1000).alias("start_sec"), F.max("t_end").alias("end_sec"), F.min("_rank").alias("_a"), F.max("_rank").alias("_z"),
        F.min("_accepted").alias("_ca"), F.max("_accepted").alias("_cz"), F.min("_strict").alias("_sa"), F.max("_strict").alias("_sz"), F.count("*").alias("beats"))
    n = F.col("_z") - F.col("_a") + 1
    span = span.withColumn("valid_core", stats.round_even((F.col("_cz") - F.col("_ca") + 1) / n, 6)).withColumn("valid_strict", stats.round_even((F.col("_sz") - F.col("_sa") + 1) / n, 6))
    bad = b.where("local_artifact").select(*KEY, F.col("_rank").alias("_at"), "_run")
    width = cfg.win_beats
    spread = span.select(*KEY, "window", "_a", "_z", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))).alias("_k"))
    hits = spread.join(bad.withColumn("_k", F.floor(F.col("_at") / width)), [*KEY, "_k"]).where("_at BETWEEN _a AND _z")
    longest = hits.groupBy(*KEY, "window").agg(F.max(F.least(F.col("_run"), F.col("_at") - F.col("_a") + 1)).alias("artifact_run_max"))
    found = span.join(longest, [*KEY, "window"], "left").fillna(0, ["artifact_run_max"]).join(D.alpha(placed, KEY, "duration_ms", cfg), [*KEY, "window"], "left")
    reason = (
        F.when(F.col("valid_core") < cfg.min_core, "low_valid_fraction_core").when(F.col("valid_strict") < cfg.min_strict, "low_valid_fraction_strict")
        .when(F.col("artifact_run_max") > cfg.max_run, "artifact_run_too_long").when(F.col("alpha").isNull(), "alpha1_nan").otherwise("ok"))
    found = found.withColumn("reason", reason).withColumn("usable", F.col("reason") == "ok").withColumn("alpha", F.when(F.col("usable"), stats.round_even("alpha", 6)))
    found = found.withColumn("center_sec", stats.round_even((F.col("start_sec") + F.col("end_sec")) / 2, 3))
    out = found.select(*KEY, "window", stats.round_even("start_sec", 3).alias("start_sec"), stats.round_even("end_sec", 3).alias("end_sec"), "center_sec", "beats", "valid_core", "valid_strict", "artifact_run_max", "alpha", "usable", "reason")
    return interpolate(out, hr, KEY, "center_sec", "sec", "hr") if hr is not None else out.withColumn("hr", F.lit(None).cast("double"))


def hr_at_level(windows: DataFrame, target: float = 0.75, bin_bpm: float = 3.0) -> DataFrame:
    """Heart rate where the binned medians of alpha cross the target."""
    used = windows.where("usable AND alpha IS NOT NULL AND hr IS NOT NULL")
    bins = used.groupBy(*KEY, (F.floor(F.col("hr") / bin_bpm) * bin_bpm).alias("bin")).agg(F.percentile("alpha", 0.5).alias("alpha"), F.count("*").alias("n"))
    return D.crossing(bins.withColumn("bin", F.col("bin") + bin_bpm / 2), KEY, "bin", "alpha", target)


# Why there is no estimate, in the order in which it is looked at.
NO_LEVEL = (
    "too_few_dfa_windows_with_hr", "non_finite_hr_alpha1_correlation", "alpha1_does_not_decrease_with_hr", "weak_raw_hr_alpha1_relation_r2_", "too_few_hr_bins", "alpha1_too_flat_across_hr",
    "binned_alpha1_not_monotonic_enough", "no_local_alpha1_075_bracketing_bins", "degenerate_local_crossing_bins", "non_finite_hr075", "too_few_raw_windows_near_075")
NO_CROSSING = ("too_few_dfa_windows_with_hr", "insufficient_windows_bracketing_075", "no_crossing_found_in_hr_sorted_bins")


def levels(windows: DataFrame, gates: DataFrame, cfg: LevelConfig = LevelConfig()) -> DataFrame:
    """KEY and two estimates of the heart rate at which alpha meets the target, for each of gates (KEY, state).

    strict: struct(rate, reason, r2, r, slope, n_bins), by the neighbouring bins of heart rate whose medians are nearest around
    it, where alpha falls with heart rate clearly enough. approx: struct(rate, reason, n_crossings, confidence), the median of all crossings.
    A reason other than ok says what is wanting, and the rate is null. Bins of one session are few, as heart rates are.
    """
    used = windows.where("usable AND alpha IS NOT NULL AND hr IS NOT NULL").select(*KEY, F.col("hr").cast("double").alias("hr"), "alpha")
    a = F.col("alpha")
    whole = used.groupBy(*KEY).agg(
        F.count("*").alias("_n"), F.covar_pop("hr", "alpha").alias("_c"), (F.stddev_pop("hr") * F.stddev_pop("alpha")).alias("_s"), F.regr_slope("alpha", "hr").alias("_slope"), F.count_if(a.between(cfg.target - cfg.near, cfg.target + cfg.near)).alias("_near"),
        F.count_if(a < cfg.target).alias("_below"), F.count_if(a > cfg.target).alias("_above"))
    bins = used.groupBy(*KEY, F.floor(F.col("hr") / cfg.bin_bpm)).agg(F.percentile("hr", 0.5).alias("x"), F.percentile("alpha", 0.5).alias("y"), F.count("*").alias("n"))
    bins = bins.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("_all"))
    d = gates.join(whole, KEY, "left").join(bins, KEY, "left").withColumn("_some", F.filter("_all", lambda b: b["n"] >= cfg.min_per_bin))

    def pairs(bins: str) -> Column:
        side = lambda at: F.slice(bins, F.lit(at), F.greatest(F.size(bins) - 1, F.lit(0)))
        return F.zip_with(side(1), side(2), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    off = lambda y: y - cfg.target
    at = lambda p: p["x1"] + (cfg.target - p["y1"]) * (p["x2"] - p["x1"]) / (p["y2"] - p["y1"])
    d = d.withColumns({"_sp": pairs("_some"), "_ap": pairs("_all")})
    hits = F.filter("_sp", lambda p: off(p["y1"]) * off(p["y2"]) <= 0)
    best = F.array_min(F.transform(hits, lambda p: F.struct((F.abs(off(p["y1"])) + F.abs(off(p["y2"]))).alias("s"), p["x1"].alias("x1"), p["y1"].alias("y1"), p["x2"].alias("x2"), p["y2"].alias("y2"))))
    crossings = F.transform(F.filter("_ap", lambda p: (p["y1"] != p["y2"]) & (off(p["y1"]) * off(p["y2"]) <= 0)), at)
    y = F.transform("_some", lambda b: b["y"])
    d = d.withColumns({
        "_best": best, "_cross": crossings, "_r": F.when(F.col("_s") > 0, F.col("_c") / F.col("_s")), "_bins": F.coalesce(F.when(F.size("_some") >= 0, F.size("_some")), F.lit(0)), "_span": F.array_max(y) - F.array_min(y),
        "_falls": F.size(F.filter("_sp", lambda p: p["y2"] < p["y1"]))})
    r2, flat = F.pow("_r", 2), (F.col("_best.x1") == F.col("_best.x2")) | (F.col("_best.y1") == F.col("_best.y2"))
    rate = F.when(~flat, at(F.col("_best")))
    closed = F.concat(F.lit("dfa_gate_"), F.lower("state"))
    few = F.coalesce(F.col("_n"), F.lit(0)) < cfg.min_windows
    want = [few, F.col("_r").isNull(), F.col("_slope") >= 0, r2 < cfg.min_r2, F.col("_bins") < cfg.min_bins, F.col("_span") < cfg.min_span, F.col("_falls") < F.greatest(F.lit(1), F.col("_bins") - 2), F.col("_best").isNull(), flat, rate.isNull() | F.isnan(rate), F.col("_near") < cfg.min_near]
    reason = F.when(F.col("state") != "DFA_OK", closed)
    for cond, said in zip(want, NO_LEVEL):
        reason = reason.when(yes(cond), F.concat(F.lit(said), F.format_string("%.2f", r2)) if said.endswith("_r2_") else F.lit(said))
    reason = reason.otherwise("ok")
    lacking = [few, (F.col("_below") < cfg.min_side) | (F.col("_above") < cfg.min_side), F.size("_cross") <= 0]
    other = F.when(F.col("state") != "DFA_OK", closed)
    for cond, said in zip(lacking, NO_CROSSING):
        other = other.when(yes(cond), said)
    other = other.otherwise("ok")
    d = d.withColumns({"_why": reason, "_not": other})
    ok, near = F.col("_why") == "ok", F.col("_not") == "ok"
    strict = F.struct(F.when(ok, rate).alias("rate"), F.col("_why").alias("reason"), r2.alias("r2"), F.col("_r").alias("r"), F.col("_slope").alias("slope"), F.col("_bins").alias("n_bins"))
    approx = F.struct(F.when(near, stats.median(F.sort_array("_cross"))).alias("rate"), F.col("_not").alias("reason"), F.when(near, F.size("_cross")).alias("n_crossings"), F.when(near, F.when(F.size("_cross") == 1, "approximate").otherwise("low")).alias("confidence"))
    return d.select(*KEY, strict.alias("strict"), approx.alias("approx"))


def alpha_by_zone(windows: DataFrame, low: float = 144, high: float = 161) -> DataFrame:
    """Medians of alpha up to low, above low up to high, and from high on; the upper edge counts in both."""
    ok, hr = yes(F.col("usable")) & F.col("hr").isNotNull(), F.col("hr")
    mid = lambda c: F.percentile(F.when(ok & c, F.col("alpha")), 0.5)
    return windows.groupBy(*KEY).agg(mid(hr <= low).alias("alpha_z1"), mid((hr > low) & (hr <= high)).alias("alpha_z2"), mid(hr >= high).alias("alpha_z3"))


def rmssd_bands(windows: DataFrame) -> DataFrame:
    r = F.when(yes(F.col("usable")), F.col("rmssd"))
    return windows.groupBy(*KEY).agg(F.count_if(r <= 7).alias("low_min"), F.count_if((r > 7) & (r <= 11)).alias("mid_min"), F.count_if(r > 11).alias("high_min"))


def dfa_gate(strict_share: Column, coverage: Column, has_hr: Column, n_usable: Column, min_usable: int = 10, ok_share: float = 0.90, limited_share: float = 0.75, min_coverage: float = 0.80) -> Column:
    """struct(state, reason) of how far the scaling exponents can be read."""
    pick = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    return (
        F.when(~yes(n_usable >= min_usable), pick("DFA_NO_INTERPRETABLE", f"too_few_usable_dfa_windows_min_{min_usable}"))
        .when(yes(strict_share >= ok_share) & (~yes(has_hr) | yes(coverage >= min_coverage)), pick("DFA_OK", "strict_artifact_load_low_and_dfa_windows_sufficient"))
        .when(yes(strict_share >= limited_share), pick("DFA_LIMITED", "dfa_usable_but_artifact_load_or_hr_coverage_not_optimal"))
        .otherwise(pick("DFA_NO_INTERPRETABLE", "strict_artifact_load_too_high_for_confident_dfa")))


def time_axis_gate(gate: Column, trusted: Column) -> Column:
    """An untrusted time axis leaves a good gate limited."""
    lowered = F.struct(F.lit("DFA_LIMITED").alias("state"), F.lit("time_axis_compromised_dfa_values_available_but_time_based_interpretation_limited").alias("reason"))
    return F.when(~yes(trusted) & (gate["state"] == "DFA_OK"), lowered).otherwise(gate)


def duration_check(beats_min, reference_min) -> Column:
    """struct(state, abs_diff_min, rel_diff) of two durations in minutes: OK, WARN, MISMATCH or UNKNOWN."""
    a, b = stats.col(beats_min), stats.col(reference_min)
    gap = F.abs(a - b)
    state = F.when(~yes((a > 0) & b.isNotNull()), "UNKNOWN").when(gap > F.greatest(F.lit(8.0), b * 0.12), "MISMATCH").when(gap > F.greatest(F.lit(3.0), b * 0.05), "WARN").otherwise("OK")
    return F.struct(state.alias("state"), F.when(state != "UNKNOWN", stats.round_even(gap, 3)).alias("abs_diff_min"), F.when(state != "UNKNOWN", stats.round_even(gap / F.greatest(b, F.lit(1e-9)), 4)).alias("rel_diff"))


def context(gate: Column, strict: Column, approx: Column, rmssd_ok: Column, alpha_z2: Column, alpha_z3: Column, duration: Column) -> Column:
    """struct(modifier, evidence): whether the beats confirm, soften or question the session's reading. strict and approx are those of
    levels(). The texts are fixed values."""
    good = gate["state"] == "DFA_OK"
    found, near = yes(strict["reason"] == "ok"), yes(approx["reason"] == "ok")
    uphill = yes(alpha_z3 >= alpha_z2)
    first = F.when(found, "confirm").otherwise("soften")
    second = F.when(uphill, "question").otherwise(first)
    third = F.when(duration["state"] == "MISMATCH", "question").when((duration["state"] == "WARN") & (second == "confirm"), "soften").otherwise(second)
    missing = F.coalesce(strict["reason"], F.lit(""))
    said = evidence(
        F.concat(F.lit("dfa_gate = "), gate["state"]), F.when(~good, F.when(yes(rmssd_ok), "rmssd_1min usable").otherwise("rmssd_1min no usable")),
        F.when(good & found, "HR@0.75 usable"), F.when(good & ~found & near, F.concat(F.lit("HR@0.75 no usable (strict): "), missing)),
        F.when(good & ~found & near, F.format_string("HR@0.75 crossing approx: %.1f lpm (confidence=%s)", approx["rate"], approx["confidence"])), F.when(good & ~found & ~near, F.concat(F.lit("HR@0.75 no usable: "), missing)),
        F.when(good & alpha_z2.isNotNull(), F.format_string("alpha1_med_z2_hr = %.3f", alpha_z2)), F.when(good & alpha_z3.isNotNull(), F.format_string("alpha1_med_z3_hr = %.3f", alpha_z3)),
        F.when(good & uphill, "gradiente alpha1 por zonas no coherente"),
        F.when(good & (duration["state"] == "WARN"), F.concat(F.lit("coherencia temporal RR-sesion en advertencia: diff "), duration["abs_diff_min"].cast("string"), F.lit(" min"))),
        F.when(good & (duration["state"] == "MISMATCH"), F.concat(F.lit("coherencia temporal RR-sesion no valida: diff "), duration["abs_diff_min"].cast("string"), F.lit(" min"))))
    return F.struct(F.when(good, third).when(yes(rmssd_ok), "soften").otherwise("unavailable").alias("modifier"), said.alias("evidence"))


def final_note(dominant, modifier) -> Column:
    """The session's reading in a sentence; the texts are fixed values."""
    d, m = stats.col(dominant), stats.col(modifier)
    text = lambda tail: F.concat(F.lit("Sessions sugiere `"), d, F.lit(tail))
    return (
        F.when(d.isNull(), None).when(m == "confirm", text("` y RR lo confirma")).when(m == "soften", text("`; RR anade contexto pero con prudencia"))
        .when(m == "question", text("`, pero RR cuestiona la lectura fina")).when(m.isin("unavailable", "no_rr"), text("`; RR no fue interpretable")).otherwise("Lectura primaria derivada desde sessions"))


def blocks(windows: DataFrame, samples: DataFrame, block_s: int = 600, offset_s: int = 0) -> DataFrame:
    """Means of speed, heart rate and cadence and of alpha in blocks [a, b) of block_s seconds."""
    cut = lambda c: F.floor((F.col(c) - offset_s) / block_s)
    s = samples.where(F.col("sec") >= offset_s).groupBy(*KEY, cut("sec").alias("block")).agg(F.avg("hr").alias("hr_mean"), F.avg(F.when(F.col("speed") > 0.5 / 3.6, F.col("speed") * 3.6)).alias("speed_kmh"), F.count("*").alias("n_samples"))
    a = F.when(yes(F.col("usable")), F.col("alpha"))
    w = windows.where(F.col("center_sec") >= offset_s).groupBy(*KEY, cut("center_sec").alias("block")).agg(F.percentile(a, 0.5).alias("alpha_median"), F.avg(a).alias("alpha_mean"), (100 * F.avg(F.when(a.isNotNull(), (a < 0.75).cast("int")))).alias("pct_lt_075"))
    return s.join(w, [*KEY, "block"], "full")


def time_windows(beats: DataFrame, seconds: int = 120, step: int = 5, min_beats: int = 200, min_valid: float = 0.95, cfg: DfaConfig = DfaConfig()) -> DataFrame:
    """The other mode: windows (k step, k step + seconds] of the time axis with alpha over their accepted beats, where at
    least min_beats are and their share is min_valid. beats have t_end and accepted. alpha is not rounded."""
    last = F.ceil(F.col("t_end") / step).cast("long") - 1
    each = beats.withColumn("window", F.explode(F.sequence(F.greatest(last - seconds // step + 1, F.lit(0)), last)))
    n = Window.partitionBy(*KEY, "window")
    each = each.withColumn("_n", F.count("*").over(n)).withColumn("_k", F.count_if("accepted").over(n)).where("accepted")
    held = each.groupBy(*KEY, "window").agg(F.max("_k").alias("beats"), stats.round_even(F.max("_k") / F.max("_n"), 6).alias("valid"))
    placed = each.withColumn("pos", F.row_number().over(n.orderBy("beat_idx")) - 1).where((F.col("_k") >= min_beats) & (F.col("_k") >= min_valid * F.col("_n")))
    a = D.alpha(placed, KEY, "duration_ms", cfg).select(*KEY, "window", "alpha")
    return held.join(a, [*KEY, "window"], "left").withColumn("start_sec", (F.col("window") * step).cast("double"))


def analyse(raw: DataFrame, hr: DataFrame, sessions: DataFrame, beat: BeatConfig = BeatConfig(), cfg: DfaConfig = DfaConfig(), low: float = 144, high: float = 161, cost: DataFrame | None = None, cost_columns: tuple[str, ...] = (), level: LevelConfig = LevelConfig()) -> DataFrame:
    """One row for each of sessions (entity, session_id, duration_min, dominant): windows, exponents by zone, gate,
    context, note and, where cost is given, its columns; a session without beats is unavailable.

    raw: entity, session_id, beat_idx, duration_ms, offline. hr: entity, session_id, sec, hr. A beat whose duration is missing
    shifts all after it, so the time axis of its session is not trusted: a good gate is limited, and what is read by heart rate at a
    time is left out. Beats and windows are written once, as several figures are taken of each.
    """
    b = written(layers(raw, beat, cfg))
    w = written(dfa_windows(b, hr, cfg))
    axis = raw.groupBy(*KEY).agg((F.count_if(stats.missing_to_null("duration_ms").isNull()) == 0).alias("axis_ok"))
    whole = b.groupBy(*KEY).agg((F.max("t_end") / 60).alias("beats_min"), F.avg(F.col("strict").cast("int")).alias("strict_share"))
    rmssd = B.tumbling_rmssd(b, KEY, cfg).groupBy(*KEY).agg(F.max("usable").alias("rmssd_ok"))
    cover = w.groupBy(*KEY).agg(F.avg(F.col("hr").isNotNull().cast("int")).alias("coverage"))
    trusted = w.join(axis, KEY).withColumn("hr", F.when(F.col("axis_ok"), F.col("hr"))).drop("axis_ok")
    d = sessions
    for part in (axis, whole, rmssd, D.alpha_summary(w, KEY), cover, alpha_by_zone(trusted, low, high)):
        d = d.join(part, KEY, "left")
    gate = dfa_gate(F.col("strict_share"), F.col("coverage"), F.col("coverage") > 0, F.col("n_usable"))
    d = d.withColumns({"gate": time_axis_gate(gate, F.coalesce("axis_ok", F.lit(True))), "duration": duration_check("beats_min", "duration_min")})
    d = d.join(levels(trusted, d.select(*KEY, F.col("gate.state").alias("state")), level), KEY, "left")
    d = d.withColumn("context", context(F.col("gate"), F.col("strict"), F.col("approx"), F.col("rmssd_ok"), F.col("alpha_z2"), F.col("alpha_z3"), F.col("duration")))
    d = d.select(
        *KEY, "n", "n_usable", F.col("median").alias("alpha_median"), "alpha_z1", "alpha_z2", "alpha_z3", F.coalesce("axis_ok", F.lit(True)).alias("axis_ok"), F.col("strict.rate").alias("hr_at_level"), F.col("strict.reason").alias("level_reason"),
        F.col("approx.rate").alias("hr_at_crossing"), F.col("approx.confidence").alias("crossing_confidence"), F.col("gate.state").alias("gate"), F.col("gate.reason").alias("gate_reason"),
        F.col("duration.state").alias("duration_state"), F.col("context.modifier").alias("modifier"), F.col("context.evidence").alias("evidence"), final_note("dominant", F.col("context.modifier")).alias("note"))
    if cost is not None:
        from .contracts import attach_cost

        d = attach_cost(d, cost, KEY, cost_columns)
    return d
