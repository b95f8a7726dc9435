"""Session cost: scores of cardiovascular and mechanical cost by thresholds, with the evidence for them.

Thresholds and texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, stats
from ..functions.rules import evidence, yes

#: Spellings of sports that share a rubric.
ALIASES = {
    "trail_run": "trail", "road_run": "road", "run": "road", "running": "road", "virtual_run": "road", "virtualrun": "road", "ride": "bike",
    "virtual_ride": "bike", "pool_swim": "swim", "open_water_swim": "swim",
}
NUMBERS = "z2_pct z3_pct hr_p95 vt2_used work_total_min work_longest_min work_n_blocks work_avg_z3_pct moving_min elev_gain_m elev_loss_m elev_density avg_cadence".split()


def family(sport) -> Column:
    s = F.lower(F.trim(F.coalesce(stats.col(sport), F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), s), s)


def steps(x: Column, *limits: float) -> Column:
    """How many of the rising limits x reaches; 0 if it is missing."""
    return sum((yes(x >= v).cast("int") for v in limits), F.lit(0))


def show(name: str, x: Column, digits: int = 1, tail: str = "") -> Column:
    return F.format_string(f"{name} = %.{digits}f{tail}", stats.round_even(x, digits) if digits == 0 else x.cast("double"))


def _ladder(total: Column, longest: Column, *pairs: tuple[float, float]) -> Column:
    """The number of the hardest (total, longest) pair that is reached, counted from the easiest."""
    rule = F.lit(0)
    for i, (a, b) in enumerate(pairs, 1):
        rule = F.when(yes((total >= a) & (longest >= b)), i).otherwise(rule)
    return rule


def cardio(r: dict[str, Column], zones_source: Column) -> Column:
    """struct(score, confidence, evidence); no score where zones or blocks are missing."""
    z2p, z3, total, longest, z3w = r["z2_pct"] + r["z3_pct"], r["z3_pct"], r["work_total_min"], r["work_longest_min"], r["work_avg_z3_pct"]
    known = r["z2_pct"].isNotNull() & z3.isNotNull() & total.isNotNull() & longest.isNotNull()
    src = F.lower(F.trim(F.coalesce(zones_source, F.lit(""))))
    near = r["hr_p95"] - r["vt2_used"]
    said = evidence(
        F.when(z2p >= 25, show("z2+z3", z2p, 1, "%%")), F.when(z3 >= 5, show("z3_pct", z3, 1, "%%")), F.when(total >= 8, show("work_total_min", total)), F.when(longest >= 8, show("work_longest_min", longest)),
        F.when(r["work_n_blocks"] >= 3, F.format_string("work_n_blocks = %d", r["work_n_blocks"].cast("long"))), F.when(z3w >= 15, show("work_avg_z3_pct", z3w, 0)),
        F.when(near >= 3, show("hr_p95", r["hr_p95"], 1, " (por encima de VT2)")).when(near >= -3, show("hr_p95", r["hr_p95"], 1, " (cerca de VT2)")), F.when(src == "fallback", "zones_source = fallback"))
    score = F.when((z2p >= 40) | (z3 >= 12) | (total >= 35) | yes((longest >= 20) & (z3w >= 15)), 3).when((z2p >= 25) | (z3 >= 5) | (total >= 20) | (longest >= 20), 2).when((z2p >= 10) | (z3 >= 2) | (total >= 8) | (longest >= 8), 1).otherwise(0)
    empty = F.array(F.lit("sin senal cardiometabolica material en zonas o work blocks"))
    return F.struct(
        F.when(known, score).alias("score"), F.when(~known, "low").when(src == "icu", "high").otherwise("medium").alias("confidence"),
        F.when(~known, F.array(F.lit("faltan metricas base de zonas o work blocks"))).when(F.size(said) == 0, empty).otherwise(said).alias("evidence"))


def _result(known: Column, missing: str | Column, score: Column, confidence: Column, said: Column, empty: str) -> Column:
    missing = F.lit(missing) if isinstance(missing, str) else missing
    return F.struct(
        F.when(known, score).cast("int").alias("score"), F.when(known, confidence).otherwise("low").alias("confidence"),
        F.when(~known, F.array(missing)).when(F.size(said) == 0, F.array(F.lit(empty))).otherwise(said).alias("evidence"))


def _both(a: Column, b: Column) -> Column:
    """The harder of two scores, one more where both are hard."""
    return F.when((a >= 2) & (b >= 2), F.least(F.greatest(a, b) + 1, F.lit(3))).otherwise(F.greatest(a, b))


def mechanical(r: dict[str, Column], sport: Column) -> Column:
    """struct(score, confidence, evidence) by the sport's rubric."""
    total, longest, hours = r["work_total_min"], r["work_longest_min"], r["moving_min"] / 60
    moving, blocks = yes(r["moving_min"] > 0), total.isNotNull() & longest.isNotNull()
    up, down, density = r["elev_gain_m"] / hours, r["elev_loss_m"] / hours, r["elev_density"]
    climb = F.greatest(up, down)
    held = lambda label: F.format_string(f"{label}: total %.1f min, max %.1f min", total, longest)
    slopes = [F.when(up.isNotNull(), show("D+/h", up, 0)), F.when(down.isNotNull(), show("D-/h", down, 0))]

    terrain = F.when(climb.isNotNull(), steps(climb, 150, 400, 800)).otherwise(steps(density, 20, 60, 100))
    flat = F.when(terrain <= 1, _ladder(total, longest, (10, 8), (20, 12), (35, 20))).otherwise(0)
    trail = _result(
        moving, "faltan metricas de moving_min", _both(terrain, flat), F.when(climb.isNotNull() | density.isNotNull(), "high").otherwise("medium"),
        evidence(*slopes, F.when(climb.isNull() & density.isNotNull(), show("elev_density", density)), F.when(flat >= 1, held("bloque corrible sostenido"))), "sin senal mecanica material de terreno o locomocion")

    signal = F.coalesce(climb, density)
    steep = steps(signal, 150, 400, 800)
    climbing = F.when(yes((total >= 35) & (longest >= 20)) & (steep >= 2), 3).when(yes((total >= 20) & (longest >= 12)) & (steep >= 1), 2).when(yes((total >= 10) & (longest >= 8)), 1).otherwise(0)
    hike = _result(
        moving & signal.isNotNull(), F.when(moving, "faltan metricas de terreno para hike").otherwise("faltan metricas de moving_min"), _both(steep, climbing), F.lit("medium"),
        evidence(*slopes, F.when(climb.isNull() & density.isNotNull(), show("elev_density", density)), F.when(climbing >= 1, held("bloque de esfuerzo en hike"))), "sin senal mecanica material de terreno o esfuerzo en hike")

    hills = F.when(up.isNotNull(), steps(up, 120, 350, 700)).otherwise(steps(density, 15, 35, 70))
    pedal = _ladder(total, longest, (15, 8), (30, 12), (50, 18))
    bike = _result(
        moving, "faltan metricas de moving_min", _both(hills, pedal), F.lit("medium"),
        evidence(slopes[0], F.when(up.isNull() & density.isNotNull(), show("elev_density", density)), F.when(pedal >= 1, held("bloques exigentes"))), "sin senal mecanica material de relieve o bloques exigentes")

    two = _ladder(total, longest, (15, 8), (35, 15))
    hard = yes(r["z3_pct"] >= 12)
    swim = _result(
        blocks, "faltan metricas de estructura para coste propulsivo", F.when(hard, F.least(two + 1, F.lit(3))).otherwise(two), F.lit("low"),
        evidence(F.when(two >= 1, held("bloques de nado sostenido")), F.when(hard, show("z3_pct", r["z3_pct"], 1, "%%"))), "base limitada para coste propulsivo en swim")

    turning, near = yes(r["avg_cadence"] >= 60) & (two >= 1), yes(r["hr_p95"] >= r["vt2_used"] - 3) & (two >= 1)
    score = F.when(near & (total >= 35), 3).when(turning & (total >= 20), F.greatest(two, F.lit(2))).otherwise(two)
    elliptical = _result(
        blocks, "faltan metricas de estructura para elliptical", score, F.when(r["avg_cadence"].isNull(), "low").otherwise("medium"),
        evidence(F.when(two >= 1, held("bloques de trabajo sostenido")), F.when(turning, show("avg_cadence", r["avg_cadence"], 0)), F.when(near, show("hr_p95", r["hr_p95"], 1, " (cerca de VT2)"))), "base limitada para coste propulsivo en elliptical")

    f = family(sport)
    other = _result(F.lit(False), F.concat(F.lit("deporte sin rubrica mecanica automatizada: "), F.coalesce(F.nullif(sport, F.lit("")), F.lit("unknown"))), F.lit(0), F.lit("low"), F.array().cast("array<string>"), "")
    return F.when(f.isin("trail", "road"), trail).when(f == "hike", hike).when(f == "bike", bike).when(f == "swim", swim).when(f == "elliptical", elliptical).otherwise(other)


def dominant(c: Column, m: Column) -> Column:
    return (
        F.when(c.isNull() | m.isNull(), "no_clasificable").when((c <= 1) & (m <= 1), "bajo_estimulo").when((c >= 2) & (c > m), "cardiometabolico")
        .when((m >= 2) & (m > c), "mecanico").otherwise("mixto"))


def costs(sessions: DataFrame) -> DataFrame:
    """entity, session_id, date, sport, both scores with confidence and evidence, and coste_dominante.

    Numbers may come as text; columns that are not there count as missing."""
    have = set(sessions.columns)
    r = {c: parse.number(c) if c in have else F.lit(None).cast("double") for c in NUMBERS}
    s = sessions.select("entity", "session_id", "Fecha", "sport", F.col("zones_source") if "zones_source" in have else F.lit(None).cast("string").alias("zones_source"), *[v.alias(k) for k, v in r.items()])
    own = {c: F.col(c) for c in NUMBERS}
    s = s.withColumn("_c", cardio(own, F.col("zones_source"))).withColumn("_m", mechanical(own, F.col("sport")))
    return s.select(
        "entity", "session_id", F.col("Fecha").alias("date"), "sport", F.col("_c.score").alias("cardio_score"), F.col("_m.score").alias("mecanico_score"), dominant(F.col("_c.score"), F.col("_m.score")).alias("coste_dominante"),
        F.col("_c.confidence").alias("confidence_cardio"), F.col("_m.confidence").alias("confidence_mecanico"), F.col("_c.evidence").alias("cardio_evidence"), F.col("_m.evidence").alias("mecanico_evidence"))
