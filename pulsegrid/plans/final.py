"""Daily decision table: smoothed signals against calendar baselines, shadows, persistence, actions and reasons.

Everything is partitioned by entity and ordered by day, so one exchange serves all windows. Actions and reasons are fixed texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import GateConfig
from ..functions import rules, stats
from ..functions.rules import yes
from ..operators import windows as W

KEY = ["entity"]


def _text(template: str, *columns) -> Column:
    return F.format_string(template, *[stats.round_even(c, 0) if template.count("%.0f") and i < template.count("%.0f") else stats.col(c) for i, c in enumerate(columns)])


def healthy_anchors(core: DataFrame, cfg: GateConfig = GateConfig()) -> DataFrame:
    """entity, healthy_rmssd, healthy_hr, healthy_period: medians of 7-row medians of clean days in the period, or of
    all days where the period has none."""
    clean = core.where("Calidad = 'OK' AND lnRMSSD IS NOT NULL AND HR_stable IS NOT NULL AND RMSSD_stable IS NOT NULL AND Fecha IS NOT NULL")
    w = Window.partitionBy("entity").orderBy("Fecha").rowsBetween(-6, 0)
    for c in ("RMSSD_stable", "HR_stable"):
        clean = clean.withColumn(f"_{c}", F.when(F.count(c).over(w) >= 3, stats.frame_median(c, w)))
    inside = F.col("Fecha").between(F.lit(cfg.healthy_start).cast("date"), F.lit(cfg.healthy_end).cast("date"))
    mid = lambda c, when=None: F.percentile(F.when(when, F.col(c)) if when is not None else F.col(c), 0.5)
    a = clean.groupBy(*KEY).agg(
        F.count_if(inside).alias("_n"), mid("_RMSSD_stable", inside).alias("_r"), mid("_HR_stable", inside).alias("_h"), mid("_RMSSD_stable").alias("_ra"), mid("_HR_stable").alias("_ha"))
    period = f"{cfg.healthy_start}..{cfg.healthy_end}"
    some = F.col("_n") > 0
    return a.select(*KEY, F.when(some, F.col("_r")).otherwise(F.col("_ra")).alias("healthy_rmssd"), F.when(some, F.col("_h")).otherwise(F.col("_ha")).alias("healthy_hr"), F.when(some, period).otherwise(f"{period}(fallback)").alias("healthy_period"))


def final(core: DataFrame, sleep: DataFrame | None = None, days: DataFrame | None = None, cfg: GateConfig = GateConfig()) -> DataFrame:
    """entity and the decision contract from core rows; sleep and days, if given, add to the reasons.

    Missing values are null throughout. An INVALID day, and one with too few smoothed days, stays without baselines;
    one with too short a baseline keeps it, and its shadows and residual. Counts that are not reached are 0."""
    if cfg.decision_mode not in ("O2_SHADOW", "O3_OVERRIDE_PERSIST_2of3") or cfg.warning_mode not in ("healthy85", "p20"):
        raise ValueError("unknown decision_mode or warning_mode")
    ln, hr = F.col("lnRMSSD"), F.col("HR_stable")
    d = core.withColumns({c: stats.missing_to_null(c) for c in ("lnRMSSD", "HR_stable", "RMSSD_stable", "RRbar_s")})
    numeric = ln.isNotNull() & hr.isNotNull() & F.col("RMSSD_stable").isNotNull()
    invalid = yes(F.col("Calidad") == "INVALID") | ~numeric | F.col("Fecha").isNull()
    clean = yes(F.col("Calidad") == "OK") & ~invalid
    d = d.withColumns({"_invalid": invalid, "_clean": clean, "quality_flag": ~clean & ~invalid, "_lnrr": F.when(F.col("RRbar_s") > 0, F.log("RRbar_s"))})
    d = W.last_valid_mean(d, KEY, "Fecha", ["lnRMSSD", "HR_stable"], F.col("_clean"), cfg.roll_n)
    d = d.withColumn("_open", ~F.col("_invalid") & (F.col("n_roll") >= cfg.min_roll))
    spans = (cfg.base_days, *cfg.shadow_days)
    frames = {f"{name}{n}": (c, n) for n in spans for c, name in (("lnRMSSD", "ln"), ("HR_stable", "hr"))}
    d = W.rolling_baselines(d, KEY, "Fecha", frames, F.col("_clean"), F.col("_open"), cfg.swc_mult)
    d = d.withColumns({f"n{n}": F.coalesce(F.least(f"n_ln{n}", f"n_hr{n}"), F.lit(0)).cast("int") for n in spans})
    b = cfg.base_days
    base, base_hr, swc, swc_hr = (F.col(f"{x}{b}") for x in ("base_ln", "base_hr", "swc_ln", "swc_hr"))
    usable = yes((swc != 0) & (swc_hr != 0))
    full = F.col("_open") & (F.col(f"n{b}") >= cfg.min_base) & usable
    reason = F.when(F.col("_invalid"), "CAL/STAB/ART/NaN").when(~F.col("_open"), "ROLL3_INSUF")
    floor = F.when(full, F.greatest(swc, F.lit(cfg.swc_floor)))
    d = d.withColumns({"swc_ln_floor": floor, "veto_agudo": yes(F.col("_clean") & (ln < base - cfg.veto_mult * floor))})
    veto = F.col("veto_agudo")
    d = d.withColumns({"ln_pre_veto": F.when(veto, F.col("lnRMSSD_roll")), "lnRMSSD_used": F.when(veto, ln).otherwise(F.col("lnRMSSD_roll")), "HR_used": F.when(veto, hr).otherwise(F.col("HR_stable_roll"))})
    none = lambda why: F.struct(F.lit(schema.NO_GATE).alias("gate"), why.alias("reason"))

    def judged(n: int, least: int, name: str, a: Column, r: Column) -> Column:
        got = rules.gate(a, r, F.col(f"base_ln{n}"), F.col(f"base_hr{n}"), F.col(f"swc_ln{n}"), F.col(f"swc_hr{n}"), "SWC_NAN/0")
        return F.when(reason.isNotNull(), none(reason)).when(F.col(f"n{n}") < least, none(F.lit(f"{name}_INSUF"))).otherwise(got)

    raw = F.when(~F.col("_open"), none(F.lit(""))).when(F.col(f"n{b}") < cfg.min_base, none(F.lit(f"BASE{b}_INSUF"))).when(~usable, none(F.lit("SWC_NAN/0"))).otherwise(rules.gate(ln, hr, base, base_hr, swc, swc_hr))
    s1, s2 = cfg.shadow_days
    used = F.col("lnRMSSD_used"), F.col("HR_used")
    d = d.withColumns({
        "_judged": judged(b, cfg.min_base, f"BASE{b}", *used), "_raw": raw, "d_ln": F.when(full, F.col("lnRMSSD_used") - base), "d_HR": F.when(full, F.col("HR_used") - base_hr),
        **{f"_s{n}": judged(n, least, f"BASE{n}", *used) for n, least in zip(cfg.shadow_days, cfg.min_shadow)}})
    note = F.concat(F.lit("Raw="), F.col("_raw.gate"), F.lit("("), F.col("_raw.reason"), F.lit(") vs ref="), F.col("_judged.gate"), F.lit("("), F.col("_judged.reason"), F.lit(")"))
    d = d.withColumn("unstable_note", F.when(full & F.col("quality_flag") & F.col("_raw.gate").isin(*schema.GATES), note).otherwise(""))
    d = W.rolling_residual(d, KEY, "Fecha", "_lnrr", "lnRMSSD", b, cfg.min_base, F.col("_clean"), cfg.swc_mult)
    z = F.when(F.col("_open"), F.col("residual_z"))
    d = d.withColumns({
        "residual_ln": F.when(F.col("_open"), F.col("residual")), "residual_z": z, "residual_tag": rules.residual_tag(z, cfg), "gate_base60": F.col("_judged.gate"), "_g1": F.col(f"_s{s1}.gate"), "_g2": F.col(f"_s{s2}.gate")})
    if cfg.decision_mode == "O2_SHADOW":
        d = d.withColumns({"final": F.col("gate_base60"), "delta": F.lit(0), "path": F.lit("BASE60_ONLY"), "why": F.lit("")})
    else:
        d = W.persistence(d, KEY, ["Fecha"], "gate_base60", "_g2", "_g1", s2, s1)
    d = W.streak(d, KEY, ["Fecha"], F.col("final").isin(*cfg.bad_gates), 7)
    d = d.withColumn("_act", rules.action("final", "quality_flag"))
    heavy = (F.col("final") == schema.ROJO) & ((F.col("streak") >= 2) | (F.col("bad_7") >= 3)) & (F.col("_act.detail") != "SUAVE_QUALITY")
    d = d.withColumn("_detail", F.when(heavy, "DESCARGA").otherwise(F.col("_act.detail")))
    d = d.join(healthy_anchors(d, cfg), KEY, "left")
    equiv = F.exp(base)
    if cfg.warning_mode == "healthy85":
        threshold = cfg.healthy_factor * F.col("healthy_rmssd")
    else:
        all_rows = Window.partitionBy("entity")
        threshold = F.when(F.count(equiv).over(all_rows) >= 10, F.percentile(equiv, cfg.p20).over(all_rows))
    d = d.withColumn("warning_threshold", threshold).withColumn("baseline60_degraded", yes(equiv < F.col("warning_threshold")))
    d = _reasons(d, sleep, days, cfg)
    named = {
        "HR_today": hr, "lnRMSSD_today": ln, "n_roll3": F.col("n_roll"), "gate_raw_today": F.col("_raw.gate"), "gate_raw_reason": F.col("_raw.reason"),
        "ln_base60": base, "HR_base60": base_hr, "n_base60": F.col(f"n{b}"), "SWC_ln": swc, "SWC_HR": swc_hr, "gate_razon_base60": F.col("_judged.reason"),
        "gate_shadow42": F.col(f"_s{s1}.gate"), "gate_razon_shadow42": F.col(f"_s{s1}.reason"), "n_base42": F.col(f"n{s1}"),
        "gate_shadow28": F.col(f"_s{s2}.gate"), "gate_razon_shadow28": F.col(f"_s{s2}.reason"), "n_base28": F.col(f"n{s2}"),
        "decision_mode": F.lit(cfg.decision_mode), "gate_final": F.col("final"), "gate_final_delta": F.col("delta"), "decision_path": F.col("path"), "override_reason": F.col("why"),
        "gate_badge": F.concat("final", "residual_tag"), "Color_operativo": F.col("final"), "Action": F.col("_act.action"), "Action_detail": F.col("_detail"),
        "bad_streak": F.col("streak"), "bad_7d": F.col("bad_7"), "flag_sistemico": F.lit(False), "flag_razon": F.lit(""), "warning_mode": F.lit(cfg.warning_mode),
    }
    return d.select("entity", *[named.get(c, F.col(c)).alias(c) for c in schema.FINAL])


def _reasons(d: DataFrame, sleep: DataFrame | None, days: DataFrame | None, cfg: GateConfig) -> DataFrame:
    """d with reason_text: the messages that apply, in a fixed order."""
    base = F.col(f"base_ln{cfg.base_days}")
    gate, drop = F.col("final"), cfg.veto_mult * F.col("swc_ln_floor")
    parts = [
        F.when(F.col("veto_agudo"), F.format_string("Caída aguda HRV: raw=%.3f vs base=%.3f (drop=%.3f, umbral=-%.3f)", "lnRMSSD", base, F.col("lnRMSSD") - base, drop)),
        F.when(yes(F.col("d_ln") > 2 * F.col("swc_ln_floor")), "HRV excesivamente alto: posible saturación parasimpática"),
        F.when(F.col("quality_flag") & gate.isin(schema.VERDE, schema.AMBAR), "Dato dudoso: limitar a Z1-Z2 máx 90min"),
    ]
    bad = F.lit(False)
    if sleep is not None:
        own = ["polar_sleep_duration_min", "polar_interruptions_long", "sleep_dur_p10", "sleep_int_p90", "polar_night_rmssd"]
        d = d.join(sleep.select("entity", "Fecha", *[F.col(c).alias(f"_z_{c}") for c in own]), ["entity", "Fecha"], "left")
        dur, ints, p10, p90, night = (F.col(f"_z_{c}") for c in own)
        short, broken = yes(dur < p10), yes(ints > p90)
        bad = short | broken
        parts += [
            F.when(short, _text("Noche corta (%.0fmin < P10=%.0f)", dur, p10)), F.when(broken, _text("Noche fragmentada (%.0f interr > P90=%.0f)", ints, p90)),
            F.when(yes((gate == schema.VERDE) & (night < 25)), _text("VERDE pero nightly_rmssd bajo (%.0fms)", night)).when(
                yes((gate == schema.ROJO) & (night > 45)), _text("ROJO con nightly_rmssd alto (%.0fms): posible confusor", night)),
        ]
    if days is not None:
        own = ["load_3d", "load_3d_nobs", "load_day", "work_7d_sum", "z3_7d_sum"]
        d = d.join(days.select("entity", "Fecha", *[F.col(c).alias(f"_w_{c}") for c in own]), ["entity", "Fecha"], "left")
        load, seen, today, work, z3 = (F.col(f"_w_{c}") for c in own)
        covered = yes(seen >= 2)
        parts += [
            F.when(covered & yes(load > 250), _text("Carga acumulada alta (load_3d=%.0f)", load)), F.when(yes(work > 200), _text("Volumen semanal alto (work_7d=%.0fmin)", work)),
            F.when(yes(z3 > 60), _text("Z3 acumulado alto (z3_7d=%.0fmin)", z3)),
            F.when(yes((gate == schema.ROJO) & (today < 30)) & ~bad, "ROJO sin carga previa ni sueño malo: revisar otros factores"),
            F.when(covered & yes((gate == schema.VERDE) & (load > 200)), _text("VERDE con carga acumulada (load_3d=%.0f): precaución intensidad", load)),
        ]
    return d.withColumn("reason_text", F.concat_ws(" | ", *parts))


def dashboard(decisions: DataFrame) -> DataFrame:
    return decisions.select("entity", *schema.DASHBOARD)
