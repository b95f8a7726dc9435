"""Training sessions from activities and per-second samples, and their daily roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..config import SessionConfig
from ..functions import parse, rules, stats
from ..functions.rules import yes
from ..operators import islands
from ..operators import windows as W

KEY = ["entity", "session_id"]


#: A part of a session's figures: the columns that it needs on samples, its aggregates, and what it makes of them.
Part = tuple[DataFrame, list[Column], dict[str, Column]]


def _zones(s: DataFrame, cfg: SessionConfig) -> Part:
    hr, w = F.col("hr"), Window.partitionBy(*KEY)
    s = s.withColumns({"_zn": F.count("hr").over(w), "_zm": F.count(F.when(F.col("moving"), hr)).over(w)})
    used = hr.isNotNull() & (F.col("_zn") >= 60) & (F.col("moving") | (F.col("_zm") < 60))
    n = lambda c: F.count_if(used & c)
    aggs = [F.count_if(used).alias("_t"), F.percentile(F.when(used, hr), 0.95).alias("_p"), n(hr <= F.col("vt1")).alias("_1"), n((hr > F.col("vt1")) & (hr <= F.col("vt2"))).alias("_2"), n(hr > F.col("vt2")).alias("_3")]
    some = F.col("_t") > 0
    share = lambda c: F.when(some, stats.round_even(100.0 * F.col(c) / F.col("_t"), 1))
    minutes = lambda c: F.when(some, stats.round_even(F.col(c) / 60.0, 1))
    return s, aggs, {"hr_p95": stats.round_even("_p", 1), "z1_pct": share("_1"), "z2_pct": share("_2"), "z3_pct": share("_3"), "z2_total_min": minutes("_2"), "z3_total_min": minutes("_3")}


def _halves(s: DataFrame, name: str, valid: Column, columns: list[str]) -> tuple[DataFrame, list[Column]]:
    """Means of columns over the first and second half of a session's valid samples, with their number."""
    w = Window.partitionBy(*KEY)
    s = s.withColumn(f"_{name}", yes(valid).cast("int"))
    s = s.withColumns({f"_{name}_i": F.sum(f"_{name}").over(w.orderBy("sec").rowsBetween(Window.unboundedPreceding, 0)) - 1, f"_{name}_n": F.sum(f"_{name}").over(w)})
    late = F.col(f"_{name}_i") >= F.floor(F.col(f"_{name}_n") / 2)
    means = [F.avg(F.when((F.col(f"_{name}") == 1) & (late if k else ~late), F.col(c))).alias(f"_{name}_{c}_{k}") for c in columns for k in (0, 1)]
    return s, [F.max(f"_{name}_n").alias(f"_{name}_m"), *means]


def _late(s: DataFrame, cfg: SessionConfig) -> Part:
    counted = F.col("sec") >= F.when(F.col("duration_s") >= 3600, cfg.skip_s).otherwise(0)
    s = s.withColumn("_lm", F.count_if(counted & F.col("moving")).over(Window.partitionBy(*KEY)))
    s, aggs = _halves(s, "late", counted & F.col("hr").isNotNull() & (F.col("moving") | (F.col("_lm") <= 120)) & (F.col("duration_s") >= cfg.late_min_s), ["hr"])
    risen = yes((F.col("_late_m") >= 120) & (F.col("_late_hr_1") - F.col("_late_hr_0") >= cfg.late_rise))
    return s, aggs, {"late_intensity": F.when(risen, 1).otherwise(0)}


def _drift(s: DataFrame, cfg: SessionConfig) -> Part:
    ok = (F.col("sec") >= cfg.skip_s) & (F.col("speed") > cfg.drift_min_speed) & (F.col("hr") > 60) & (F.col("duration_s") >= cfg.drift_min_s)
    s, aggs = _halves(s, "drift", ok, ["hr", "speed"])
    far = (F.col("_drift_m") >= 120) & (F.col("_drift_speed_0") >= cfg.drift_min_speed) & (F.col("_drift_speed_1") >= cfg.drift_min_speed)
    a, b = F.col("_drift_hr_0") / F.col("_drift_speed_0"), F.col("_drift_hr_1") / F.col("_drift_speed_1")
    return s, aggs, {"cardiac_drift_pct": F.when(far, stats.round_even(100 * (b - a) / a, 1))}


def _figures(samples: DataFrame, cfg: SessionConfig, *parts) -> DataFrame:
    """KEY and the figures of parts: windows and one aggregate over one deal of the samples by session."""
    s, aggs, made = samples, [], {}
    for part in parts:
        s, more, columns = part(s, cfg)
        aggs, made = aggs + more, made | columns
    return s.groupBy(*KEY).agg(*aggs).select(*KEY, *[v.alias(k) for k, v in made.items()])


def zones(samples: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Shares and minutes below, between and above the thresholds and the 95th percentile, over moving samples; over
    all where fewer than 60 move. Sessions with fewer than 60 heart rates are left out. Samples have vt1, vt2, moving."""
    return _figures(samples, cfg, _zones).where("z1_pct IS NOT NULL")


def late_intensity(samples: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """late_intensity 0 or 1: whether the second half is harder. Samples have duration_s and moving; the first ten
    minutes of sessions of an hour or more do not count, and moving samples alone do where over 120 move."""
    return _figures(samples, cfg, _late)


def drift(samples: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """cardiac_drift_pct: how much the heart rate per speed of the second half exceeds the first's."""
    return _figures(samples, cfg, _drift).where("cardiac_drift_pct IS NOT NULL")


def work(samples: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Merged effort blocks of min_block_s and more, summed for each session, with the delimited strings."""
    each = islands.work_blocks(samples, KEY, cfg, F.col("hr") > F.col("vt2")).withColumn("_d", F.col("stop") - F.col("start") + 1).where(f"_d >= {cfg.min_block_s}").withColumnRenamed("n_above", "_z")
    each = each.withColumn("_min", stats.round_even(F.col("_d") / 60.0, 1)).withColumn("_pct", stats.round_even(100.0 * F.col("_z") / F.col("_d"), 0).cast("long"))
    parts = F.sort_array(F.collect_list(F.struct("start", F.col("_min").cast("string").alias("m"), F.col("_pct").cast("string").alias("p"))))
    return each.groupBy(*KEY).agg(
        F.array_join(F.transform(parts, lambda x: x["m"]), ";").alias("work_blocks_min"), F.array_join(F.transform(parts, lambda x: x["p"]), ";").alias("work_blocks_z3pct"),
        F.count("*").alias("work_n_blocks"), stats.round_even(F.sum("_min"), 1).alias("work_total_min"), F.max("_min").alias("work_longest_min"),
        stats.round_even(100.0 * F.sum("_z") / F.sum("_d"), 0).alias("work_avg_z3_pct"))


def _stream(samples: DataFrame, a: DataFrame, cfg: SessionConfig) -> DataFrame:
    """KEY and all that samples tell of the aerobic sessions of a. They are dealt out by session once, with the thresholds; the
    windows, the figures and the work blocks all stand on that deal."""
    s = samples.join(a.where(F.col("sport").isin(*schema.AEROBIC)).select("entity", "session_id", F.col("vt1_used").alias("vt1"), F.col("vt2_used").alias("vt2"), F.col("_s").alias("duration_s")).hint("merge"), KEY)
    w = Window.partitionBy(*KEY)
    # a missing speed signal moves always; a signal that ends early ends the session
    s = s.withColumns({"_has": F.max(F.col("speed").isNotNull()).over(w), "_last": F.max(F.when(F.col("speed").isNotNull(), F.col("sec"))).over(w), "_len": F.count("*").over(w)})
    s = s.where((F.col("_len") > 60) & (~F.col("_has") | (F.col("sec") <= F.col("_last"))))
    s = s.withColumn("moving", F.when(F.col("_has"), yes(F.col("speed") > cfg.moving_min_speed)).otherwise(True))
    length = lambda x, _: (x, [F.max("_len").alias("_len")], {"_len": F.col("_len")})
    found = _figures(s, cfg, _zones, _late, _drift, length).join(work(s, cfg), KEY, "left")
    # without zones there is no work and no late intensity
    only = ["late_intensity", "work_blocks_min", "work_blocks_z3pct", "work_n_blocks", "work_total_min", "work_longest_min", "work_avg_z3_pct"]
    return found.withColumns({c: F.when(F.col("z1_pct").isNotNull(), F.col(c)) for c in only})


def build(activities: DataFrame, samples: DataFrame | None = None, cfg: SessionConfig = SessionConfig(), version: str = "1") -> DataFrame:
    """entity and the session contract.

    activities: entity, id, type, start_date_local, elapsed_time, moving_time, distance, total_elevation_gain,
    total_elevation_loss, average_heartrate, max_heartrate, icu_training_load, icu_rpe, feel, icu_hr_zones,
    icu_hr_zone_times, messages. samples: entity, session_id, sec, hr, speed (null if there is no speed signal).
    """
    a = activities.withColumns({
        "session_id": F.col("id").cast("string"), "sport": parse.sport_of("type"), "_own": yes(F.size("icu_hr_zones") >= 2), "_moving": F.coalesce("moving_time", "elapsed_time"),
        "distance_km": stats.round_even(F.coalesce("distance", F.lit(0.0)) / 1000, 2)})
    a = a.withColumn("_vt", F.when(F.col("_own"), F.slice("icu_hr_zones", 1, 2).cast("array<double>")).otherwise(parse.thresholds_of("sport")))
    a = a.withColumns({"vt1_used": F.col("_vt")[0], "vt2_used": F.col("_vt")[1]})
    num = lambda c: F.col(c).cast("double")
    a = a.select(
        "entity", "session_id", F.to_date(F.substring("start_date_local", 1, 10)).alias("Fecha"), F.substring("start_date_local", 12, 5).alias("start_time"), "sport", F.col("type").alias("sport_raw"),
        F.lit("intervals").alias("source"), "vt1_used", "vt2_used", F.when(F.col("_own"), "icu").otherwise("fallback").alias("zones_source"),
        stats.round_even(num("elapsed_time") / 60, 1).alias("duration_min"), stats.round_even(num("_moving") / 60, 1).alias("moving_min"), "distance_km",
        num("total_elevation_gain").alias("elev_gain_m"), num("total_elevation_loss").alias("elev_loss_m"),
        F.when(F.col("distance_km") > 0.5, stats.round_even(num("total_elevation_gain") / F.col("distance_km"), 1)).alias("elev_density"),
        num("average_heartrate").alias("hr_mean"), num("max_heartrate").alias("hr_max"), num("icu_training_load").alias("load"), F.when(F.col("icu_rpe") > 0, num("icu_rpe")).alias("rpe"), num("feel").alias("feel"),
        num("_moving").alias("_s"), num("elapsed_time").alias("_e"), F.col("icu_hr_zone_times").cast("array<double>").alias("_zt"), parse.user_note(F.col("messages")).alias("_note"))
    derived = ["hr_p95", "z1_pct", "z2_pct", "z3_pct", "z2_total_min", "z3_total_min", "work_blocks_min", "work_blocks_z3pct", "work_n_blocks", "work_total_min", "work_longest_min", "work_avg_z3_pct", "late_intensity", "cardiac_drift_pct", "_len"]
    if samples is not None:
        a = a.join(_stream(samples, a, cfg), KEY, "left")
    else:
        for c in derived:
            a = a.withColumn(c, F.lit(None).cast("string" if c.startswith("work_blocks") else "double"))
    total = F.aggregate("_zt", F.lit(0.0), lambda x, y: x + y)
    given = yes((F.size("_zt") >= 3) & (total > 0) & F.col("z1_pct").isNull())
    a = a.withColumn("_given", given)
    filled = lambda c, v: F.when(F.col("_given"), stats.round_even(v, 1)).otherwise(F.col(c))
    a = a.withColumns({f"z{i + 1}_pct": filled(f"z{i + 1}_pct", 100.0 * F.col("_zt")[i] / total) for i in range(3)} | {f"z{i + 1}_total_min": filled(f"z{i + 1}_total_min", F.col("_zt")[i] / 60.0) for i in (1, 2)})
    a = a.fillna("", ["work_blocks_min", "work_blocks_z3pct"]).fillna(0, ["work_n_blocks", "work_total_min", "work_longest_min", "work_avg_z3_pct"])
    said = F.col("_note") != ""
    a = a.withColumns({
        "intensity_category": rules.intensity_class("sport", "late_intensity", "work_total_min", "work_avg_z3_pct"), "rpe_present": F.col("rpe").isNotNull().cast("int"), "notes_present": said.cast("int"),
        "notes_raw": F.when(said, F.col("_note")), "stream_dt_est": F.when(F.col("_e") > 0, stats.round_even(F.col("_e") / F.col("_len"), 3)), "pipeline_version": F.lit(version)})
    a = a.withColumn("session_group", rules.session_group("sport", "intensity_category"))
    a = effort(a, cfg)
    return a.select("entity", *schema.SESSIONS)


def effort(sessions: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """sessions with effort_vs_recent and effort_vs_anchor of load, within (entity, session_group)."""
    keys = ["entity", "session_group"]
    s = W.rolling_class(sessions, keys, "Fecha", ["start_time", "session_id"], "load", cfg.effort_days, cfg.effort_min_prev, "effort_vs_recent")
    return W.anchor_class(s, keys, "Fecha", "load", cfg.anchor_start, cfg.anchor_end, cfg.effort_min_prev, "effort_vs_anchor")


ROLLING = [
    ("z3_min_day", 7, "z3_7d_sum", "z3_7d_nobs"), ("work_total_min_day", 7, "work_7d_sum", "work_7d_nobs"), ("late_intensity_day", 7, "finish_strong_7d_count", None),
    ("load_day", 3, "load_3d", "load_3d_nobs"), ("load_day", 7, "load_7d", "load_7d_nobs"), ("load_day", 14, "load_14d", "load_14d_nobs"), ("load_day", 28, "load_28d", "load_28d_nobs"),
    ("elev_loss_day", 7, "elev_loss_7d_sum", None),
]


def day_rollup(sessions: DataFrame) -> DataFrame:
    """One row for each (entity, Fecha): sums that stay missing where every part is, and the primary session's class."""
    keys = ["entity", "Fecha"]
    first = Window.partitionBy(*keys).orderBy(F.col("load").desc_nulls_last(), F.col("duration_min").desc_nulls_last(), "start_time", "session_id")
    s = sessions.withColumn("_r", F.row_number().over(first))
    kind = F.col("sport")
    aero, strong, mobile = yes(kind.isin(*schema.AEROBIC)), yes(kind == "strength"), yes(kind == "mobility")
    of = lambda cond, c: F.when(cond, F.col(c))
    flag = lambda cond: F.coalesce(F.max(cond.cast("int")), F.lit(0))
    weight = aero & F.col("elev_density").isNotNull() & F.col("distance_km").isNotNull()
    km = F.sum(of(weight, "distance_km"))
    r = lambda c, n=1: stats.round_even(c, n)
    return s.groupBy(*keys).agg(
        F.count("*").alias("n_sessions"), r(F.coalesce(F.sum("duration_min"), F.lit(0.0))).alias("total_duration_min"), flag(aero).alias("has_aerobic"), flag(strong).alias("has_strength"), flag(mobile).alias("has_mobility"),
        r(F.sum("load")).alias("load_day"), F.max(F.when(F.col("_r") == 1, F.col("intensity_category"))).alias("intensity_cat_day"), r(F.sum(of(aero, "work_total_min"))).alias("work_total_min_day"),
        F.sum(of(aero, "work_n_blocks")).alias("work_n_blocks_day"), r(F.sum(of(aero, "z3_total_min"))).alias("z3_min_day"), F.max(of(aero, "hr_max")).alias("hr_max_day"), F.max(of(aero, "hr_p95")).alias("hr_p95_max_day"),
        F.max(F.when(aero, yes(F.col("late_intensity") == 1).cast("int"))).alias("late_intensity_day"), F.max(of(aero, "cardiac_drift_pct")).alias("cardiac_drift_worst"),
        r(F.sum("elev_gain_m"), 0).alias("elev_gain_day"), r(F.sum("elev_loss_m"), 0).alias("elev_loss_day"), r(F.coalesce(F.sum(of(strong, "duration_min")), F.lit(0.0))).alias("strength_min_day"),
        r(F.coalesce(F.sum(of(mobile, "duration_min")), F.lit(0.0))).alias("mobility_min_day"), F.max(of(aero, "rpe")).alias("rpe_max_day"),
        flag(aero & yes(F.col("effort_vs_recent") == "above")).alias("effort_above_typical_aerobic"), flag(strong & yes(F.col("effort_vs_recent") == "above")).alias("effort_above_typical_strength"),
        flag(aero & yes(F.col("effort_vs_anchor") == "above")).alias("effort_above_anchor_aerobic"), F.coalesce(F.sum("rpe_present"), F.lit(0)).alias("n_with_rpe"), F.coalesce(F.sum("notes_present"), F.lit(0)).alias("n_with_notes"),
        F.when(km > 0, r(F.sum(F.when(weight, F.col("elev_density") * F.col("distance_km"))) / km)).alias("elev_density_day"))


def days(sessions: DataFrame) -> DataFrame:
    """entity and the day contract, with rolling sums over the days before."""
    return W.coverage_sums(day_rollup(sessions), ["entity"], "Fecha", ROLLING).select("entity", *schema.DAYS)


def activity_day(sessions: DataFrame, keys: list[str], load: str, minutes: str, sport: str, ident: str) -> DataFrame:
    """keys, sum_load, max_load, minutes, mean_load and the sport of the session with the most load (ties to the
    greatest id)."""
    return sessions.groupBy(*keys).agg(
        F.sum(load).alias("sum_load"), F.max(load).alias("max_load"), F.sum(minutes).alias("minutes"), F.avg(load).alias("mean_load"),
        F.max_by(sport, F.struct(F.coalesce(F.col(load), F.lit(-1.0)), ident)).alias("sport_of_max"))


def activity_fields(acts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and the day's figures of activities: n_acts, load, load_max, intensity_max, duration_min, avg_hr, max_hr, the
    type of the one with the most load, and atl, ctl, tsb, rpe and resting_hr of the one that started last.

    acts: keys, load, intensity, moving_time_s, avg_hr, max_hr, atl, ctl, tsb, rpe, resting_hr, type, started; nulls are passed over,
    but the last activity's are kept. Of equal loads or starts the first by `order` counts; one without a load or start
    comes behind all others.
    """
    first = -F.col(order)
    most = F.struct(F.coalesce(F.col("load"), F.lit(float("-inf"))), first)
    last = F.struct(F.col("started").isNotNull(), F.col("started"), first)
    return acts.groupBy(*keys).agg(
        F.count("*").alias("n_acts"), F.sum("load").alias("load"), F.max("load").alias("load_max"), F.max("intensity").alias("intensity_max"), (F.sum("moving_time_s") / 60).alias("duration_min"),
        F.avg("avg_hr").alias("avg_hr"), F.max("max_hr").alias("max_hr"), F.max_by("type", most).alias("type_main"), *[F.max_by(c, last).alias(c) for c in ("atl", "ctl", "tsb", "rpe", "resting_hr")])


def run_statistics(sessions: DataFrame) -> DataFrame:
    """entity, n_sessions, n_days, n_streams, n_notes, dt_mean, dt_min, dt_max, is_1hz and the map of intensity classes."""
    each = sessions.groupBy("entity", "intensity_category").agg(F.count("*").alias("n"))
    kinds = each.groupBy("entity").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("intensity_category", "n")))).alias("classes"))
    dt = F.col("stream_dt_est")
    return sessions.groupBy("entity").agg(
        F.count("*").alias("n_sessions"), F.countDistinct("Fecha").alias("n_days"), F.count(dt).alias("n_streams"), F.sum("notes_present").alias("n_notes"), F.avg(dt).alias("dt_mean"), F.min(dt).alias("dt_min"),
        F.max(dt).alias("dt_max"), F.min(F.when(dt.isNotNull(), dt.between(0.9, 1.1) & (dt > 0.9) & (dt < 1.1))).alias("is_1hz")).join(kinds, "entity", "left")
