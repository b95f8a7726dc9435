"""Tolerant parsing of text fields: anything that does not parse is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import col


def offline_flag(token) -> Column:
    """struct(offline, known): yes/no words to a boolean; what is not known counts as offline."""
    t = F.lower(F.trim(F.coalesce(col(token).cast("string"), F.lit(""))))
    yes, no = t.isin("1", "true", "t", "yes", "y"), t.isin("0", "false", "f", "no", "n", "")
    return F.struct((~no).alias("offline"), (yes | no).alias("known"))


def number(text) -> Column:
    """A double with a comma or a point; words for nothing are null."""
    t = F.trim(col(text).cast("string"))
    plain = F.when(~F.lower(t).isin("", "nan", "none", "null", "n/a", "na"), F.replace(t, F.lit(","), F.lit(".")))
    value = plain.try_cast("double")
    return F.when(~F.isnan(value), value)


def integer(text) -> Column:
    return F.floor(number(text)).cast("long")


def iso_minutes(text) -> Column:
    """Minutes of an ISO-8601 duration like PT1H30M5.5S; other text is null."""
    t = F.upper(F.trim(col(text).cast("string")))
    pattern = r"^P(?:(\d+(?:\.\d+)?)D)?(?:T(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, pattern, i).try_cast("double"), F.lit(0.0))
    some = t.rlike(pattern) & t.rlike(r"\d")
    return F.when(some, part(1) * 1440 + part(2) * 60 + part(3) + part(4) / 60)


def minutes(value) -> Column:
    """Minutes from text like PT7H30M or a number in minutes, seconds or milliseconds, told by its size; null unless
    positive."""
    t = F.trim(col(value).cast("string"))
    part = lambda unit: F.coalesce(F.regexp_extract(t, rf"([\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    n = F.when(t.startswith("PT"), part("H") * 60 + part("M") + part("S") / 60).otherwise(number(value))
    return F.when(n <= 0, None).when(n <= 1_440, n).when(n <= 172_800, n / 60).when(n <= 172_800_000, n / 60_000).otherwise(n)


def minutes_between(start, end) -> Column:
    """Minutes from one ISO timestamp to another; null unless positive."""
    a, b = F.try_to_timestamp(col(start)), F.try_to_timestamp(col(end))
    gap = (F.unix_micros(b) - F.unix_micros(a)) / 60e6
    return F.when(gap > 0, gap)


def percent(value) -> Column:
    """Shares up to one become percentages."""
    n = number(value)
    return F.when(n <= 1, n * 100).otherwise(n)


def breaths(value) -> Column:
    """Breaths a minute; large numbers are intervals in milliseconds where those make 4 to 40 breaths."""
    n = number(value)
    return F.when(n <= 0, None).when((n > 100) & (60_000 / n).between(4, 40), 60_000 / n).otherwise(n)


def colour_code(text) -> Column:
    """Traffic-light words to 1..3, indefinite ones to 0; others null."""
    t = F.translate(F.lower(F.trim(col(text))), "áéíóú", "aeiou")
    return F.when(t.startswith("verde"), 1).when(t.startswith("ambar") | t.startswith("amarillo"), 2).when(t.startswith("rojo"), 3).when(t.startswith("indef"), 0)


def file_date(name) -> Column:
    return F.try_to_timestamp(F.regexp_extract(col(name), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")


def sanitize(text, most: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; runs of others become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, most)


def pace(seconds_per_km) -> Column:
    """m:ss of a pace in seconds."""
    s = F.round(col(seconds_per_km)).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), F.pmod(s, F.lit(60)))


def sport_of(raw) -> Column:
    from ..schema import SPORTS

    pairs = [F.lit(x) for pair in SPORTS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(raw)), F.lit("other"))


def thresholds_of(sport) -> Column:
    """array(first, second) of default heart-rate thresholds."""
    from ..schema import THRESHOLDS

    pairs = [x for k, (a, b) in THRESHOLDS.items() for x in (F.lit(k), F.array(F.lit(a).cast("double"), F.lit(b).cast("double")))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(sport)), F.array(F.lit(143.0), F.lit(161.0)))


def user_note(messages) -> Column:
    """One line from an array of struct(type, content): TEXT ones, less long reports, joined by ' | '."""
    m = F.filter(F.coalesce(messages, F.array().cast("array<struct<type:string,content:string>>")), lambda x: x["type"] == "TEXT")
    body = F.transform(m, lambda x: F.coalesce(x["content"], F.lit("")))
    said = F.filter(body, lambda c: ~((F.length(c) > 500) & (c.contains("##") | c.contains("---"))))
    joined = F.regexp_replace(F.array_join(said, " | "), "\r\n|\n|\r", " | ")
    return F.trim(F.regexp_replace(joined, r" \|(  \|)+ ", " | "))


def sensor_and_key(name) -> Column:
    """struct(sensor, key) of a file name with ecg or acc in it, but not both; key is what else it says, or default."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(col(name), r"^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    ecg, acc = stem.contains("ecg"), stem.contains("acc")
    key = F.regexp_replace(F.regexp_replace(stem, "ecg|acc", ""), "[^a-z0-9]+", "")
    one = ecg != acc
    return F.struct(F.when(one, F.when(ecg, "ecg").otherwise("acc")).alias("sensor"), F.when(one, F.when(key == "", "default").otherwise(key)).alias("key"))


def recording_day(phone_ms, name) -> Column:
    """Day (UTC) of a phone time stamp in milliseconds, else the one in the name (yyyymmdd_hhmmss), else 1970-01-01."""
    stamp = F.when(col(phone_ms).isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(col(phone_ms) / 86_400_000).cast("int")))
    named = F.try_to_timestamp(F.regexp_extract(col(name), r"(\d{8})_\d{6}", 1), F.lit("yyyyMMdd")).cast("date")
    return F.coalesce(stamp, named, F.lit("1970-01-01").cast("date"))


def local_time(text, zone: str) -> Column:
    """Wall time in a zone of an ISO timestamp with an offset or Z; one without is wall time already. Null if it is none."""
    t = F.trim(col(text).cast("string"))
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    wall = F.regexp_replace(t, "T", " ").try_cast("timestamp_ntz")
    return F.when(zoned, F.convert_timezone(F.current_timezone(), F.lit(zone), F.try_to_timestamp(t).cast("timestamp_ntz"))).otherwise(wall)


def first_time(zone: str, *texts) -> Column:
    """The first of several spellings that is a time."""
    return F.coalesce(*[local_time(t, zone) for t in texts])


#: Sports of the beat analyser.
ANALYSER_SPORTS = {"trail_run": "trail", "trail": "trail", "road_run": "road", "run": "road", "running": "road", "virtualrun": "road", "virtual_run": "road", "hike": "hike", "bike": "bike", "swim": "swim", "elliptical": "elliptical"}


def analyser_sport(sport) -> Column:
    """The analyser's name of a sport; trail for any other."""
    s = F.lower(F.trim(F.coalesce(col(sport), F.lit(""))))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANALYSER_SPORTS.items() for x in kv]), s), F.lit("trail"))
