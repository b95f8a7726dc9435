"""Rule sets of the exchanged tables, reports over them, and what is gathered from several of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import SessionConfig
from ..functions import stats
from ..functions.rules import yes
from ..operators import quality as Q
from ..operators.joins import nearest
from ..operators.upsert import best_rows, compare_versions, same_keys
from ..sources.writers import params_hash

# Closed vocabularies of the contracts.
QUALITIES = ("OK", "FLAG_mecánico", "INVALID")
STABILITIES = ("OK", "Unstable")
ACTIONS = ("INTENSIDAD_OK", "Z2_O_TEMPO_SUAVE", "SUAVE_O_DESCANSO")
WARNINGS = ("healthy85", "p20")


def _known(condition: Column, *needs: str) -> Column:
    """A rule that says nothing about rows where one of the columns is missing."""
    missing = F.lit(False)
    for c in needs:
        missing = missing | F.col(c).isNull()
    return missing | condition


def core_rules() -> dict[str, Column]:
    units = F.abs(F.col("HR_stable") * F.col("RRbar_s") / 60 - 1) <= 0.001
    return {
        "day": F.col("Fecha").isNotNull(), "quality": Q.one_of("Calidad", *QUALITIES), "stability": Q.one_of("HRV_Stability", *STABILITIES),
        "units": _known(units, "HR_stable", "RRbar_s")}


def final_rules() -> dict[str, Column]:
    same = F.abs(F.col("lnRMSSD_used") - F.col("lnRMSSD_today")) < 0.001
    return {
        "day": F.col("Fecha").isNotNull(), "gate": Q.one_of("gate_final", *schema.GATES, schema.NO_GATE), "action": Q.one_of("Action", *ACTIONS), "warning": Q.one_of("warning_mode", *WARNINGS),
        "veto": ~yes(F.col("veto_agudo")) | _known(same, "lnRMSSD_today")}


def sleep_rules() -> dict[str, Column]:
    return {"day": F.col("Fecha").isNotNull(), "interruptions": _known(F.col("polar_interruptions_long") < 50, "polar_interruptions_long")}


def session_rules() -> dict[str, Column]:
    other = ~yes(F.col("session_group").startswith("endurance"))
    zones = F.abs(F.col("z1_pct") + F.col("z2_pct") + F.col("z3_pct") - 100) < 0.1
    return {
        "zones": other | yes(zones), "work_moving": other | yes(F.col("work_total_min") <= F.col("moving_min") + 0.1),
        "work_longest": other | yes(F.col("work_longest_min") <= F.col("work_total_min") + 0.1)}


def day_rules(frames: Sequence[tuple[str, int]] = (("load_3d_nobs", 3), ("load_7d_nobs", 7), ("z3_7d_nobs", 7), ("work_7d_nobs", 7))) -> dict[str, Column]:
    return {name: _known(F.col(name) <= days, name) for name, days in frames}


def contract(df: DataFrame, keys: Sequence[str], rows: dict[str, Column], columns: Sequence[str] | None = None) -> DataFrame:
    """rule, n_rows, n_violations: the row rules, `unique` (rows that share their key with another, or lack one), and
    with columns `columns`, how many of them are missing or not foreseen."""
    out = Q.violations(df, rows)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.lit("unique").alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when((F.col("n") > 1) | missing, F.col("n"))), F.lit(0)).alias("n_violations"))
    out = out.unionByName(twice)
    if columns is not None:
        wrong = len(set(columns) ^ (set(df.columns) - {"entity"}))
        out = out.unionByName(df.agg(F.lit("columns").alias("rule"), F.count("*").alias("n_rows"), F.lit(wrong).cast("long").alias("n_violations")))
    return out


def constant_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rule, n_rows (keys) and n_violations (keys for which a column has several values)."""
    each = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    return Q.violations(each, {c: F.col(c) <= 1 for c in columns})


def agreement(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rule, n_rows, n_violations: keys of one side only, and values that differ where both have the key."""
    names = F.array(F.lit("same_keys"), *map(F.lit, columns))
    total = left.select(*keys).distinct().agg(F.count("*").alias("n_rows")).select(F.explode(names).alias("rule"), "n_rows")
    apart = same_keys(left, right, keys).agg(F.lit("same_keys").alias("rule"), F.count("*").alias("n"))
    changed = compare_versions(left, right, keys, columns).groupBy(F.col("column").alias("rule")).agg(F.count("*").alias("n"))
    return total.join(apart.unionByName(changed), "rule", "left").select("rule", "n_rows", F.coalesce("n", F.lit(0)).alias("n_violations"))


def version_report(before: DataFrame, after: DataFrame, keys: Sequence[str], gate: str = "gate_final", values: Sequence[str] = (*schema.GATES, schema.NO_GATE)) -> DataFrame:
    """gate, n_before, n_after, delta and n_changed (rows that left it) over the keys that both versions have."""
    both = before.select(*keys, F.col(gate).alias("_a")).join(after.select(*keys, F.col(gate).alias("_b")), list(keys))
    sides = both.select("_a", "_b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_a").alias("gate")), F.struct(F.lit(1).alias("side"), F.col("_b").alias("gate")))).alias("_s")).select("_a", "_b", "_s.*")
    got = sides.where(F.col("gate").isin(*values)).groupBy("gate").agg(
        F.count_if(F.col("side") == 0).alias("n_before"), F.count_if(F.col("side") == 1).alias("n_after"), F.count_if((F.col("side") == 0) & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_changed"))
    return got.select("gate", "n_before", "n_after", (F.col("n_after") - F.col("n_before")).alias("delta"), "n_changed")


def run_metadata(sessions: DataFrame, cfg: SessionConfig = SessionConfig(), version: str = "1") -> DataFrame:
    """entity and metadata, a JSON object: version, hash of the parameters, range of days, counts, sampling, zone sources."""
    dt = F.col("stream_dt_est")
    zones = sessions.groupBy("entity", "zones_source").agg(F.count("*").alias("n")).groupBy("entity").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("zones_source", F.lit("none")).alias("k"), "n")))).alias("_zones"))
    one = sessions.groupBy("entity").agg(
        F.struct(F.min("Fecha").cast("string").alias("oldest"), F.max("Fecha").cast("string").alias("newest")).alias("input_range"),
        F.struct(F.count("*").alias("sessions"), F.countDistinct("Fecha").alias("days"), F.count(dt).alias("with_streams"), F.coalesce(F.sum("notes_present"), F.lit(0)).alias("with_notes")).alias("counts"),
        F.struct(F.round(F.avg(dt), 4).alias("mean"), F.min(dt).alias("min"), F.max(dt).alias("max")).alias("stream_sampling"))
    body = F.struct(F.lit(version).alias("pipeline_version"), F.lit(params_hash(vars(cfg))).alias("params_hash"), "input_range", "counts", "stream_sampling", F.col("_zones").alias("zones_source_dist"))
    return one.join(zones, "entity").select("entity", F.to_json(body).alias("metadata"))


def context_payload(sessions: DataFrame, parts: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str] = ("entity", "Fecha")) -> DataFrame:
    """keys, session_id and context, a JSON object with the given columns of each part's row of that day; a part without
    a row, and columns without a value, are left out. Each part has one row for each of the keys at most."""
    out = sessions
    for name, (df, columns) in parts.items():
        out = out.join(df.select(*keys, F.struct(*columns).alias(f"_{name}")), list(keys), "left")
    return out.select(*keys, "session_id", F.to_json(F.struct(*[F.col(f"_{n}").alias(n) for n in parts])).alias("context"))


def attach_cost(beats: DataFrame, cost: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """beats' rows with cost, a struct of usable, reason and the columns; a session without a result is not usable."""
    found = cost.select(*keys, F.struct(F.lit(True).alias("usable"), F.lit(None).cast("string").alias("reason"), *columns).alias("cost"))
    kind = found.schema["cost"].dataType
    none = F.struct(F.lit(False).alias("usable"), F.lit("session_not_found").alias("reason"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[2:]])
    return beats.join(found, list(keys), "left").withColumn("cost", F.coalesce("cost", none))


def session_beats(sessions: DataFrame, recordings: DataFrame, beats: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """keys, session_id, rec_id, delta, n_beats and offline_pct of the recording nearest to each session's start.

    sessions: keys, session_id, at, size. recordings: keys, rec_id, at, size. beats: rec_id, offline."""
    match = nearest(sessions, recordings, keys, "session_id", "at", "rec_id", "at", tolerance, "size", "size")
    held = beats.groupBy("rec_id").agg(F.count("*").alias("n_beats"), stats.round_even(100 * F.avg(F.col("offline").cast("int")), 4).alias("offline_pct"))
    return match.select(*keys, "session_id", "rec_id", "delta").join(held, "rec_id", "left").fillna({"n_beats": 0})


def speed_patch(sessions: DataFrame, samples: DataFrame, min_speed: float = 0.5) -> DataFrame:
    """entity, session_id, status (OK, SKIP, FAIL), reason, avg_speed_kmh and avg_pace of each session from its samples:
    a session without samples is skipped, one that never moves fails."""
    key = ["entity", "session_id"]
    moved = F.when(F.col("speed") >= min_speed, F.col("speed"))
    s = samples.groupBy(*key).agg(F.count("*").alias("_n"), F.avg(moved).alias("_v"))
    d = sessions.select(*key).join(s, key, "left")
    status = F.when(F.col("_n").isNull(), "SKIP").when(F.col("_v").isNull(), "FAIL").otherwise("OK")
    from ..functions.parse import pace

    return d.select(
        *key, status.alias("status"), F.when(status == "SKIP", "no samples").when(status == "FAIL", "no speed").alias("reason"),
        stats.round_even(F.col("_v") * 3.6, 2).alias("avg_speed_kmh"), F.when(F.col("_v") > 0, pace(1000 / F.col("_v"))).alias("avg_pace"))


def load_reasons(d: DataFrame, gate: str = "gate_final", sleep_bad: Column | None = None) -> Column:
    """One text of what speaks of saturation, load and fatigue: columns d_ln, swc_ln, load_3d, load_3d_p90, tsb, load_yday."""
    poor = yes(sleep_bad) if sleep_bad is not None else F.lit(False)
    fmt = lambda text, *c: F.format_string(text, *c)
    whole = lambda c: stats.round_even(c, 0).cast("double")
    # Texts of the decision contract.
    return F.concat_ws(
        " | ",
        F.when(F.col("d_ln") > 2 * F.col("swc_ln"), fmt("HRV excesivamente alto (d_ln=+%.3f > 2×SWC=%.3f): posible saturación parasimpática", F.col("d_ln"), 2 * F.col("swc_ln"))),
        F.when(F.col("load_3d") > F.col("load_3d_p90"), fmt("Carga acumulada alta (3d=%.0f > P90=%.0f)", whole("load_3d"), whole("load_3d_p90"))),
        F.when(F.col("tsb") < -25, fmt("Fatiga profunda (TSB=%.0f)", whole("tsb"))),
        F.when((F.col(gate) == schema.ROJO) & (F.col("load_yday") < 30) & ~poor, "ROJO sin carga previa ni sueño malo: revisar otros factores"),
        F.when((F.col(gate) == schema.VERDE) & (F.col("tsb") < -20), fmt("VERDE con fatiga acumulada (TSB=%.0f): precaución intensidad", whole("tsb"))))


def exercises(df: DataFrame, day: str, sport: str, minutes: str, first: str | None = None, last: str | None = None, sports: Sequence[str] = (), most_minutes: float | None = None, order: Sequence[str] = (), most: int = 50) -> DataFrame:
    """The first `most` rows by `order` in a range of days, of exactly these sports and of at most so many minutes; a
    missing day or duration does not count against a row."""
    keep = F.lit(True)
    if first:
        keep &= _known(F.col(day) >= F.lit(first).cast("date"), day)
    if last:
        keep &= _known(F.col(day) <= F.lit(last).cast("date"), day)
    if sports:
        keep &= yes(F.col(sport).isin(*sports))
    if most_minutes:
        keep &= _known(F.col(minutes) <= most_minutes, minutes)
    return df.where(keep).orderBy(*(order or [day])).limit(most)


def best_recording(files: DataFrame, keys: Sequence[str], archived: str, converted: str, changed: str, name: str) -> DataFrame:
    """One file for each of the keys: loose ones before archived, converted ones before others, then the newest, then
    the least name."""
    return best_rows(files, keys, [F.col(archived).asc(), F.col(converted).desc(), F.col(changed).desc_nulls_last(), F.col(name)])


def method_comparison(windows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """keys, median_abs_diff, mean_abs_diff, max_abs_diff and n_compared of two columns where both have a value."""
    gap = F.abs(F.col(a) - F.col(b))
    return windows.groupBy(*keys).agg(F.percentile(gap, 0.5).alias("median_abs_diff"), F.avg(gap).alias("mean_abs_diff"), F.max(gap).alias("max_abs_diff"), F.count(gap).alias("n_compared"))


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, column, n, median, p10 and p90."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    got = df.select(*keys, F.explode(each).alias("_e")).select(*keys, "_e.*").groupBy(*keys, "column").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, (0.5, 0.1, 0.9)))).alias("_q"))
    return got.select(*keys, "column", "n", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p10"), F.col("_q")[2].alias("p90"))


def beats_visible(unavailable, modifier) -> Column:
    """Whether a session's beat sections are shown."""
    return ~(yes(stats.col(unavailable)) | yes(stats.col(modifier).isin("unavailable", "no_rr")))



def best_measurement(rows: DataFrame, keys: Sequence[str] = ("entity", "Fecha")) -> DataFrame:
    """The one measurement of each day to go by, the first criterion that tells two apart deciding: not INVALID, then OK,
    stable, stabilised between 60 and 600 s, longer, fewer artifacts, earlier, and by the file's name.

    rows have Calidad, HRV_Stability, Tiempo_Estabilizacion, duration_s, Artifact_pct, time (null if unknown) and file.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    order = [
        known(F.col("Calidad") == "INVALID").asc(), known(F.col("Calidad") == "OK").desc(), known(F.col("HRV_Stability") == "OK").desc(), known(F.col("Tiempo_Estabilizacion").between(60, 600)).desc(),
        F.col("duration_s").desc_nulls_last(), F.col("Artifact_pct").asc_nulls_last(), F.col("time").asc_nulls_last(), F.col("file").asc()]
    return best_rows(rows, list(keys), order)
