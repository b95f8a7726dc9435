"""Sleep table from nested vendor JSON with several spellings of each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import parse, stats
from ..operators.joins import same_or_previous
from ..operators.upsert import in_contract, replace_keys

#: Spellings of each field, in order of preference.
KEYS = {
    "start": ["sleep_start_time", "sleep-start-time", "sleepStartTime"], "end": ["sleep_end_time", "sleep-end-time", "sleepEndTime"],
    "asleep": ["asleep_duration", "asleep-duration", "sleep_duration", "sleep-duration", "sleepDuration"], "span": ["sleep_span", "sleep-span", "sleepSpan", "time_in_bed"],
    "deep": ["deep_sleep", "deep-sleep", "deepSleep", "sleep_n3"], "rem": ["rem_sleep", "rem-sleep", "remSleep", "sleep_rem"], "light": ["light_sleep", "light-sleep", "lightSleep"],
    "deep_pct": ["polar_deep_pct", "deep_pct", "deep_percentage"], "rem_pct": ["polar_rem_pct", "rem_pct", "rem_percentage"], "continuity": ["continuity", "sleep_continuity"],
    "continuity_index": ["continuity_index", "continuity-class", "continuity_class"], "efficiency": ["efficiency_pct", "sleep_efficiency", "efficiency"], "score": ["sleep_score", "sleep-score"],
    "rmssd": ["heart_rate_variability_avg", "heart-rate-variability-avg", "nightly_rmssd"], "rri": ["nightly_rri", "rri_avg", "heart_rate_rri_avg", "heart-rate-rri-avg"],
    "hr": ["heart_rate_avg", "heart-rate-avg", "hr_avg"], "resp": ["breathing_rate_avg", "breathing-rate-avg", "nightly_resp", "nightly_resp_int"],
    "long": ["longCount", "long_count", "long-count", "sleep_long_interruptions", "interruptions_long"],
    "total": ["totalCount", "total_count", "total-count", "interruptions_total", "sleep_interruptions_total", "interruptions_count", "number_of_interruptions"],
    "item_kind": ["type", "kind", "interruption_type"], "item_duration": ["duration", "interruption_duration"],
}
#: Fields that are taken only where the value is a number; of the others the first value counts, whatever it is.
NUMERIC = frozenset("rmssd rri hr resp long total".split())
#: Where interruptions are told, and their counts, by the exact spelling.
EVALUATION, INTERRUPTIONS = ["evaluation", "sleep-evaluation", "sleep_evaluation"], ["interruptions", "sleep-interruptions", "sleep_interruptions"]
LONG_COUNT, TOTAL_COUNT = ["longCount", "long_count", "long-count"], ["totalCount", "total_count", "total-count", "count"]


def _plain(key: str) -> str:
    return key.strip().lower().replace("-", "_")


def _members(text: Column) -> Column:
    """array<struct<k,v,t>>: an object's or array's members in the document's order, with plain keys, values as text, and what
    those are that look as if they held others. A variant tells values apart but sorts an object's keys, so the order comes from the text."""
    holds = lambda v: F.coalesce(v.startswith("{") | v.startswith("["), F.lit(False))

    def told(members: Column, kinds: Column, value: Callable, key: Callable) -> Column:
        plain = lambda m, t: F.struct(key(m).alias("k"), value(m).alias("v"), t.alias("t"))
        kind = lambda x: F.substring(F.schema_of_variant(x), 1, 5)
        return stats.let(members, lambda own: F.when(F.exists(own, lambda m: holds(value(m))), F.zip_with(own, kinds, lambda m, x: plain(m, kind(x)))).otherwise(F.transform(own, lambda m: plain(m, F.lit("")))))

    of_object = told(F.map_entries(F.from_json(text, "map<string,string>")), F.map_values(F.from_json(text, "map<string,variant>")), lambda m: m["value"], lambda m: F.translate(F.lower(F.trim(m["key"])), "-", "_"))
    of_array = told(F.from_json(text, "array<string>"), F.from_json(text, "array<variant>"), lambda m: m, lambda m: F.lit(None).cast("string"))
    return F.coalesce(F.when(text.startswith("{"), of_object).otherwise(of_array), F.array().cast("array<struct<k:string,v:string,t:string>>"))


def first_values(doc, names: list[str]) -> Column:
    """struct of the named fields of KEYS as text: the first value of each in a JSON object, however deep.

    An object's own members come before what lies in it, and of what lies in it the last comes first. Null and empty
    values are passed over, and of NUMERIC fields all that are no numbers. A document that is no object has none. A walk over a stack
    of what is still to be opened, inside the row.
    """
    spellings = {n: sorted({_plain(k) for k in KEYS[n]}) for n in names}
    doc = F.trim(F.col(doc) if isinstance(doc, str) else doc)

    def wanted(n: str) -> Callable[[Column], Column]:
        there = lambda e: F.trim(e["v"]) != ""
        return lambda e: e["k"].isin(spellings[n]) & (parse.number(e["v"]).isNotNull() if n in NUMERIC else F.coalesce(there(e), F.lit(False)))

    every = sorted({k for own in spellings.values() for k in own})

    def step(s: Column, _: Column) -> Column:
        below = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)

        def opened(own: Column) -> Column:
            todo = F.concat(below, F.transform(F.filter(own, lambda e: e["t"].isin("OBJEC", "ARRAY")), lambda e: e["v"])).alias("todo")
            found = lambda some: F.when(F.size(some) > 0, F.struct(todo, *[F.coalesce(s[n], F.get(F.filter(some, wanted(n)), F.lit(0))["v"]).alias(n) for n in names])).otherwise(F.struct(todo, *[s[n].alias(n) for n in names]))
            return stats.let(F.filter(own, lambda e: F.coalesce(e["k"].isin(every), F.lit(False))), found)

        return F.when(F.size(s["todo"]) == 0, s).otherwise(stats.let(_members(F.element_at(s["todo"], -1)), opened))

    # as many steps as there are objects and arrays, at most
    steps = F.length(doc) - F.length(F.translate(doc, "{[", ""))
    start = F.struct(F.array(doc).alias("todo"), *[F.lit(None).cast("string").alias(n) for n in names])
    walk = F.aggregate(F.when(doc.startswith("{"), F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step)
    return stats.let(walk, lambda s: F.struct(*[s[n].alias(n) for n in names]))


def _named(text: Column, spellings: list[str]) -> Column:
    """The first member of an object that is there under one of the spellings, as they are."""
    return stats.let(F.from_json(F.when(F.trim(text).startswith("{"), text), "map<string,string>"), lambda m: F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in spellings]))


def interruptions(doc: Column, found: Column) -> Column:
    """struct(long, total) of a sleep document: the counts of its evaluation, or of its list of interruptions, of which long ones say so
    or last five minutes, or else counts from anywhere in the document (`found`)."""
    told = F.trim(_named(_named(doc, EVALUATION), INTERRUPTIONS))

    def is_long(item: Column) -> Column:
        by = lambda s: F.coalesce(F.lower(s["item_kind"]).contains("long"), F.lit(False)) | F.coalesce(parse.minutes(s["item_duration"]) >= 5, F.lit(False))
        return stats.let(first_values(item["v"], ["item_kind", "item_duration"]), by)

    items = F.filter(_members(F.when(told.startswith("["), told)), lambda e: e["t"] == "OBJEC")
    counts = stats.let(F.struct(told.alias("told"), items.alias("items")), lambda x: F.struct(
        F.coalesce(parse.number(_named(x["told"], LONG_COUNT)), F.when(F.size(x["items"]) > 0, F.size(F.filter(x["items"], is_long)).cast("double"))).alias("long"),
        F.coalesce(parse.number(_named(x["told"], TOTAL_COUNT)), F.when(F.size(x["items"]) > 0, F.size(x["items"]).cast("double"))).alias("total")))
    return stats.let(counts, lambda c: F.struct(F.coalesce(c["long"], parse.number(found["long"])).alias("long"), F.coalesce(c["total"], parse.number(found["total"])).alias("total")))


def fields(raw: DataFrame) -> DataFrame:
    """entity, Fecha and the sleep fields of (entity, Fecha, sleep_json, nightly_json); what is not said is null,
    derived where it can be."""
    night = ["rmssd", "rri", "hr", "resp"]
    d = raw.select("entity", "Fecha", "sleep_json", first_values("sleep_json", [k for k in KEYS if k not in night and not k.startswith("item_")]).alias("_s"), first_values("nightly_json", night).alias("_n"))
    s, n = F.col("_s"), F.col("_n")
    d = d.select(
        "entity", "Fecha", *[parse.minutes(s[k]).alias(f"_{k}") for k in ("asleep", "span", "deep", "rem", "light")], parse.minutes_between(s["start"], s["end"]).alias("_between"),
        *[parse.number(s[k]).alias(f"_{k}") for k in ("deep_pct", "rem_pct", "continuity", "continuity_index", "score")], parse.percent(s["efficiency"]).alias("_eff"),
        interruptions(F.col("sleep_json"), s).alias("_i"), *[parse.number(n[k]).alias(f"_{k}") for k in ("rmssd", "rri", "hr")], parse.breaths(n["resp"]).alias("_resp"))
    stages = F.coalesce(F.col("_deep"), F.lit(0.0)) + F.coalesce(F.col("_rem"), F.lit(0.0)) + F.coalesce(F.col("_light"), F.lit(0.0))
    any_stage = F.coalesce("_deep", "_rem", "_light").isNotNull()
    d = d.withColumn("_asleep", F.coalesce("_asleep", F.when(any_stage, stages))).withColumn("_span", F.coalesce("_span", "_between"))
    share = lambda c: F.when(F.col("_asleep") > 0, 100 * F.col(c) / F.col("_asleep"))
    named = {
        "polar_sleep_duration_min": F.col("_asleep"), "polar_sleep_span_min": F.col("_span"), "polar_deep_pct": F.coalesce("_deep_pct", share("_deep")), "polar_rem_pct": F.coalesce("_rem_pct", share("_rem")),
        "polar_efficiency_pct": F.coalesce("_eff", F.when(F.col("_span") > 0, 100 * F.col("_asleep") / F.col("_span"))), "polar_continuity": F.col("_continuity"), "polar_continuity_index": F.col("_continuity_index"),
        "polar_interruptions_long": F.col("_i.long"), "polar_interruptions_total": F.col("_i.total"), "polar_sleep_score": F.col("_score"), "polar_night_rmssd": F.col("_rmssd"),
        "polar_night_rri": F.coalesce("_rri", F.when(F.col("_hr") > 0, 60000 / F.col("_hr"))), "polar_night_resp": F.col("_resp"),
    }
    return d.select("entity", "Fecha", *[v.alias(k) for k, v in named.items()])


SLEEP_FIELDS = [c for c in schema.SLEEP if c.startswith("polar_") and "night" not in c]
NIGHT_FIELDS = [c for c in schema.SLEEP if "night" in c]


def with_percentiles(sleep: DataFrame) -> DataFrame:
    """sleep with each entity's percentiles of duration and long interruptions, the same on all its rows."""
    each = Window.partitionBy("entity")  # not a join, which would read every document twice
    of = lambda c, *q: F.when(F.col("entity").isNotNull(), F.percentile(c, F.array(*map(F.lit, q))).over(each))
    p = sleep.withColumns({"_d": of("polar_sleep_duration_min", 0.1, 0.9), "_i": of("polar_interruptions_long", 0.9)})
    return p.withColumns({"sleep_dur_p10": F.col("_d")[0], "sleep_dur_p90": F.col("_d")[1], "sleep_int_p90": F.col("_i")[0]}).select("entity", *schema.SLEEP)


def for_days(days: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each wanted (entity, Fecha): that day's record, or the day before's, for sleep and night apart."""
    return same_or_previous(days, found, ["entity"], "Fecha", [SLEEP_FIELDS, NIGHT_FIELDS])


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    """table with new's days replaced, and percentiles taken anew."""
    return with_percentiles(replace_keys(in_contract(table, ["entity", *schema.SLEEP]), new, ["entity", "Fecha"]))


#: Columns of the older export and what they are called here.
HISTORY = {
    "sleep_score": "polar_sleep_score", "sleep_continuity": "polar_continuity", "sleep_efficiency": "polar_efficiency_pct", "sleep_rem": "polar_rem_pct", "sleep_n3": "polar_deep_pct",
    "sleep_long_interruptions": "polar_interruptions_long", "nightly_rmssd": "polar_night_rmssd", "nightly_rri": "polar_night_rri", "nightly_resp_int": "polar_night_resp", "continuity_index": "polar_continuity_index"}
HISTORY_LEAST = 20


def history(export: DataFrame) -> DataFrame:
    """The sleep table of an older export (entity, Fecha and whatever columns of HISTORY it has, asleep_duration and sleep_span
    as ISO durations). Columns it lacks are null. A percentile needs HISTORY_LEAST nights of its entity with a value."""
    have = set(export.columns)
    iso = lambda c: F.when(F.col(c).cast("string").startswith("PT"), parse.iso_minutes(c)) if c in have else F.lit(None).cast("double")
    named = {new: F.col(old).cast("double") for old, new in HISTORY.items() if old in have}
    if "efficiency_pct" in have:
        named["polar_efficiency_pct"] = F.col("efficiency_pct").cast("double")
    named |= {"polar_sleep_duration_min": iso("asleep_duration"), "polar_sleep_span_min": iso("sleep_span")}
    every = [c for c in schema.SLEEP if c != "Fecha" and not c.startswith("sleep_")]
    d = export.select("entity", "Fecha", *[named.get(c, F.lit(None).cast("double")).alias(c) for c in every])
    full = with_percentiles(d)
    count = d.groupBy("entity").agg(F.count("polar_sleep_duration_min").alias("_d"), F.count("polar_interruptions_long").alias("_i"))
    enough = {"sleep_dur_p10": "_d", "sleep_dur_p90": "_d", "sleep_int_p90": "_i"}
    return full.join(count, "entity").withColumns({c: F.when(F.col(n) >= HISTORY_LEAST, F.col(c)) for c, n in enough.items()}).select("entity", *schema.SLEEP)
