"""Regression audit: heart-rate-corrected variability with a slope that remembers its last use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import AuditConfig
from ..functions import stats
from ..functions.rules import level_colour, yes
from ..operators import folds
from ..operators.windows import day_frame

KEY = ["entity"]


def slopes(core: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """core with n90, iqr, rr_ref, beta_est, r2 from the days before that are not INVALID.

    Quartiles and reference are of plain intervals, limits and line of logarithms; the line is fitted where both
    logarithms exist, each held to its own limits."""
    w = day_frame(KEY, "Fecha", cfg.days)
    ok = F.coalesce(F.col("Calidad") != "INVALID", F.lit(True))
    rr = F.collect_list(F.when(ok, F.col("RRbar_s"))).over(w)
    log = lambda c: F.when(F.col(c) > 0, F.log(c))
    pair = F.when(ok, F.struct(log("RRbar_s").alias("x"), log("RMSSD_stable").alias("y")))
    d = core.withColumns({"n90": F.count_if(ok).over(w), "_rr": stats.sorted_values(rr), "_xy": F.collect_list(pair).over(w)})
    side = lambda k: stats.sorted_values(F.transform("_xy", lambda p: p[k]))
    d = d.withColumns({"_x": side("x"), "_y": side("y")})
    quarter = lambda q: stats.quantile_sorted(F.col("_rr"), q)
    d = d.withColumns({
        "iqr": quarter(0.75) - quarter(0.25), "rr_ref": quarter(0.5),
        **{f"_{side}{name}": stats.quantile_sorted(F.col(f"_{side}"), q) for side in "xy" for name, q in (("lo", 0.10), ("hi", 0.90))}})
    held = F.transform(
        F.filter("_xy", lambda p: p["x"].isNotNull() & p["y"].isNotNull()),
        lambda p: F.struct(F.greatest(F.least(p["x"], F.col("_xhi")), F.col("_xlo")).alias("x"), F.greatest(F.least(p["y"], F.col("_yhi")), F.col("_ylo")).alias("y")))
    can = yes((F.col("n90") >= cfg.min_days) & (F.col("iqr") >= cfg.min_iqr))
    d = d.withColumn("can_est", can).withColumn("_fit", F.when(F.col("can_est"), stats.ols(held)))
    return d.withColumns({"beta_est": F.col("_fit.slope"), "r2": F.col("_fit.r2")}).drop("_rr", "_xy", "_x", "_y", "_xlo", "_xhi", "_ylo", "_yhi", "_fit")


def remembered(d: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """d with beta_use and beta_mode: active, clipped, frozen to the day before's, or none.

    A day's slope is judged against the one used the day before, which is a held state: an entity's days are cut into
    pieces of years, which tasks go through side by side."""
    guard = folds.Guard("within", cfg.max_jump)
    fit = F.col("can_est") & F.col("beta_est").isNotNull() & F.col("r2").isNotNull() & (F.col("r2") >= cfg.min_r2)
    own = F.when(fit, F.greatest(F.least("beta_est", F.lit(cfg.beta_max)), F.lit(cfg.beta_min)))
    days = d.select(*KEY, "Fecha", F.when(fit, F.col("beta_est")).alias("_b"), own.alias("_own"))
    used = folds.held(days, KEY, "Fecha", F.year("Fecha"), F.col("_b"), F.col("_own"), guard)
    taken = F.col("_own").isNotNull() & F.coalesce(guard.column(F.col("before"), F.col("_b")), F.lit(True))
    outside = (F.col("_b") > cfg.beta_max) | (F.col("_b") < cfg.beta_min)
    mode = F.when(taken & outside, "clipped").when(taken, "active").when(F.col("before").isNotNull(), "frozen").otherwise("none")
    used = used.select(*KEY, "Fecha", F.when(taken, F.col("_own")).otherwise(F.col("before")).alias("beta_use"), mode.alias("beta_mode"))
    return d.join(used, [*KEY, "Fecha"])


def trend_colour(x: Column, n: Column, p15: Column, p30: Column, hr_z: Column) -> Column:
    """Verde, Ámbar or Rojo of x against two percentiles of the days before, Indef below 15 of them. With a raised
    heart rate a value just above the upper one is no longer Verde."""
    tight = yes((p30 > p15) & (x - p30 < 0.10 * (p30 - p15)) & (hr_z >= 3.0))
    return F.when(~yes((n >= 15) & x.isNotNull()), "Indef").when((x >= p30) & ~tight, "Verde").when(x >= p15, "Ámbar").otherwise("Rojo")


def audit(core: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """entity and the audit contract from core rows, one for each (entity, Fecha)."""
    d = remembered(slopes(core, cfg), cfg)
    ok = F.coalesce(F.col("Calidad") != "INVALID", F.lit(True))
    corrected = F.col("RMSSD_stable") * F.pow(F.col("RRbar_s") / F.col("rr_ref"), -F.col("beta_use"))
    usable = yes(F.col("beta_use").isNotNull() & (F.col("rr_ref") > 0) & (F.col("RRbar_s") > 0))
    d = d.withColumn("cRMSSD", F.when(usable, corrected).otherwise(F.col("RMSSD_stable")))
    d = d.withColumn("_lnc", F.when(F.col("cRMSSD") > 0, F.log("cRMSSD")))
    frame = lambda c, days: F.collect_list(F.when(ok, F.col(c))).over(day_frame(KEY, "Fecha", days))
    d = d.withColumns({"_hr14": frame("HR_stable", 14), "_c30": stats.sorted_values(frame("cRMSSD", 30)), "_l28": frame("lnRMSSD", 28), "_c28": frame("_lnc", 28)})
    d = d.withColumns({
        "hr_z": stats.round_even(stats.robust_z("HR_stable", F.col("_hr14")), 2), "z": stats.robust_z("lnRMSSD", F.col("_l28")), "zc": stats.robust_z("_lnc", F.col("_c28")),
        "p15": stats.quantile_sorted(F.col("_c30"), 0.15), "p30": stats.quantile_sorted(F.col("_c30"), 0.30)})
    trend = trend_colour(F.col("cRMSSD"), F.size("_c30"), F.col("p15"), F.col("p30"), F.col("hr_z"))

    def raised(base: Column) -> Column:
        return F.when(yes(F.col("hr_z") >= 3.8), "Rojo").when(yes(F.col("hr_z") >= 3.0) & (base == "Verde"), "Ámbar").otherwise(base)

    shown = lambda x: F.when(~ok, "Indef").otherwise(x)
    out = d.withColumns({"Color_Tendencia": shown(trend), "Color_Agudo_Diario": shown(raised(level_colour("z"))), "Color_Tiebreak": shown(raised(level_colour("zc")))})
    out = out.withColumnRenamed("beta_est", "beta_est_90d").withColumnRenamed("beta_use", "beta_use_90d").withColumnRenamed("r2", "R2_winsor_90d")
    return out.select("entity", *schema.AUDIT)
