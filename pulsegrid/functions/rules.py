"""Decision rules as Columns: gates, tags, actions, classes. Missing inputs never satisfy a comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GateConfig
from ..schema import AEROBIC, AMBAR, GATES, NO_GATE, ROJO, VERDE
from .stats import col


def yes(condition: Column) -> Column:
    """A condition whose missing inputs mean no."""
    return F.coalesce(condition, F.lit(False))


def gate(signal, rate, base, base_rate, swc, swc_rate, bad_reason: str = "RAW_NAN/0") -> Column:
    """struct(gate, reason): low signal and high rate against their baselines."""
    v = list(map(col, (signal, rate, base, base_rate, swc, swc_rate)))
    usable = (v[4] != 0) & (v[5] != 0)
    for x in v:
        usable &= x.isNotNull()
    low, high = v[0] - v[2] < -v[4], v[1] - v[3] > v[5]
    pick = lambda g, r: F.struct(F.lit(g).alias("gate"), F.lit(r).alias("reason"))
    return (
        F.when(~yes(usable), pick(NO_GATE, bad_reason)).when(low & high, pick(ROJO, "2D_AMBOS"))
        .when(low, pick(AMBAR, "2D_LN")).when(high, pick(AMBAR, "2D_HR")).otherwise(pick(VERDE, "2D_OK")))


def gate_rank(g) -> Column:
    """0, 1, 2 for the three gates; null for none."""
    at = F.array_position(F.array(*map(F.lit, GATES)), col(g))
    return F.when(at > 0, at - 1)


def shift_gate(g, by) -> Column:
    """The gate `by` levels worse (or better, if negative), held at the ends; no gate stays none."""
    rank = gate_rank(g)  # greatest() and least() pass over nulls, so no gate is kept apart
    to = F.greatest(F.least(rank + by, F.lit(2)), F.lit(0))
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, GATES)), (to + 1).cast("int"))).otherwise(col(g))


def residual_tag(z, cfg: GateConfig = GateConfig()) -> Column:
    z, (a, b, c) = col(z), cfg.tag_steps
    rule = F.when(z >= c, "+++").when(z >= b, "++").when(z >= a, "+").when(z <= -c, "---").when(z <= -b, "--").when(z <= -a, "-")
    return F.coalesce(rule, F.lit(""))


def action(g, doubtful) -> Column:
    """struct(action, detail) of a gate, for clean or doubtful data."""
    g, q = col(g), yes(col(doubtful))
    pick = lambda a, d: F.struct(F.lit(a).alias("action"), F.lit(d).alias("detail"))
    return (
        F.when((g == VERDE) & ~q, pick("INTENSIDAD_OK", "EJECUTAR_PLAN")).when((g == AMBAR) & ~q, pick("Z2_O_TEMPO_SUAVE", "SIN_HIIT"))
        .when(q & g.isin(*GATES), pick("SUAVE_O_DESCANSO", "SUAVE_QUALITY")).otherwise(pick("SUAVE_O_DESCANSO", "SUAVE")))


def intensity_class(sport, late, work_total, work_z3) -> Column:
    total, z3 = F.coalesce(col(work_total), F.lit(0)), F.coalesce(col(work_z3), F.lit(0))
    return (
        F.when(~yes(col(sport).isin(*AEROBIC)), "NA").when((total >= 10) & (z3 >= 15), "work_intense").when((total >= 20) & (z3 < 15), "work_steady")
        .when(total >= 5, "work_moderate").when(F.coalesce(col(late), F.lit(0)) == 1, "finish_strong").otherwise("easy"))


def session_group(sport, intensity) -> Column:
    s, i = col(sport), col(intensity)
    return (
        F.when(s == "strength", "strength_unknown").when(s == "mobility", "mobility").when(~yes(s.isin(*AEROBIC)), "other")
        .when(i == "work_intense", "endurance_hard").when(i.isin("work_steady", "work_moderate"), "endurance_moderate").otherwise("endurance_easy"))


def elevation_bin(density) -> Column:
    d = col(density)
    return F.when(d.isNull(), "no_gps").when(d < 10, "flat").when(d < 25, "rolling").when(d < 50, "mountain").otherwise("steep_mountain")


def level_colour(z) -> Column:
    """Colour of a robust z: worse below -1 and -2, undefined if missing."""
    z = col(z)
    return F.when(z.isNull(), "Indef").when(z >= -1, "Verde").when(z >= -2, "Ámbar").otherwise("Rojo")


def versus(x, low, high, known=None) -> Column:
    """above / typical / below a range; unknown where x is missing or `known` says no."""
    x = col(x)
    rule = F.when(yes(x > col(high)), "above").when(yes(x < col(low)), "below").otherwise("typical")
    ok = x.isNotNull() if known is None else x.isNotNull() & yes(known)
    return F.when(ok, rule).otherwise("unknown")


def evidence(*items: Column) -> Column:
    """The texts that apply, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def gate_family(badge) -> Column:
    """The gate that a badge like ÁMBAR-- starts with, whatever its case or accent; null for none of them."""
    b = F.upper(F.trim(col(badge).cast("string")))
    return F.when(b.startswith("VERDE"), "VERDE").when(b.startswith("ÁMBAR") | b.startswith("AMBAR"), "ÁMBAR").when(b.startswith("ROJO"), "ROJO").when(b.startswith("NO"), "NO")
