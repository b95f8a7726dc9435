"""Scans that never fail on a bad field: text is parsed tolerantly and nulls stand for what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse

ACTIVITY = (
    "id string, type string, start_date_local string, elapsed_time double, moving_time double, distance double, total_elevation_gain double, total_elevation_loss double, "
    "average_heartrate double, max_heartrate double, icu_training_load double, icu_rpe double, feel double, icu_hr_zones array<double>, icu_hr_zone_times array<double>, "
    "messages array<struct<type:string,content:string>>")


def parent_folder(path) -> Column:
    """The name of the folder that a file lies in."""
    return F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, changed and size of all files below a path whose name matches, without reading them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    return found.select("path", name.alias("name"), parent_folder(F.col("path")).alias("folder"), F.col("modificationTime").alias("changed"), F.col("length").alias("size"))


def beat_files(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """entity, day, beat_idx, duration_ms, offline of all *_RR.csv files below a path; the day is in the file's name, and
    the entity is the folder the file lies in, if none is given.

    Rows of a file have no order of their own in a distributed scan, so each file is read whole: recordings are
    minutes long. Where an entity has several files of a day, loose ones before converted ones and then the newest, one is kept.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_RR.[cC][sS][vV]").select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), (parent_folder(F.col("_metadata.file_path")) if entity is None else F.lit(entity)).alias("entity"))
    f = raw.withColumn("day", parse.file_date("file")).where("day IS NOT NULL").withColumn("_pref", F.col("file").contains("from_jsonl"))
    f = f.groupBy("entity", "day").agg(F.max_by(F.struct("file", "value"), F.struct("_pref", "changed", "file")).alias("_f")).select("entity", "day", "_f.*")
    lines = f.select("entity", "day", F.posexplode(F.split("value", "\r?\n")).alias("_i", "_line")).where("_i > 0 AND trim(_line) <> ''")
    part = F.split("_line", ",")
    return lines.select("entity", "day", F.col("_i").cast("long").alias("beat_idx"), parse.number(F.try_element_at(part, F.lit(1))).alias("duration_ms"), (F.coalesce(parse.number(F.try_element_at(part, F.lit(2))), F.lit(0.0)) != 0).alias("offline"))


def vendor_beats(samples: DataFrame, keys: list[str], data: str, kind: str = "sample_type", wanted: int = 11) -> DataFrame:
    """keys, beat_idx, duration_ms, offline from delimited sample lists of one type; NULL items are skipped and
    durations outside 300 to 2000 ms are offline."""
    each = samples.where(F.col(kind).cast("int") == wanted).select(*keys, F.posexplode(F.split(data, ",")).alias("beat_idx", "_x"))
    d = each.withColumn("duration_ms", parse.number("_x")).where("duration_ms IS NOT NULL")
    return d.select(*keys, F.col("beat_idx").cast("long").alias("beat_idx"), "duration_ms", (~F.col("duration_ms").between(300, 2000)).alias("offline"))


def packets(spark: SparkSession, path: str, fields: list[str], least: int) -> DataFrame:
    """rec, phone_ts, ts and the fields of packet lines {recordingName, phoneTimestamp, data: [{timeStamp, ...}]};
    recordings with fewer than `least` samples are left out."""
    item = ", ".join(f"{f}:double" for f in ["timeStamp", *fields])
    raw = spark.read.schema(f"recordingName string, phoneTimestamp double, data array<struct<{item}>>").json(path, recursiveFileLookup=True)
    each = raw.select(F.col("recordingName").alias("rec"), F.col("phoneTimestamp").alias("phone_ts"), F.explode("data").alias("_d")).select("rec", "phone_ts", F.col("_d.timeStamp").alias("ts"), *[F.col(f"_d.{f}").alias(f) for f in fields]).where("ts IS NOT NULL")
    enough = each.groupBy("rec").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("rec")
    return each.join(enough, "rec")


def activities(spark: SparkSession, path: str, entity: str | None = None) -> DataFrame:
    """entity and activity fields of JSON files: lists, or objects that hold one under a usual name. The entity is the folder
    a file lies in, if none is given."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    body = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("activities", "data", "results", "items")], F.when(F.trim("value").startswith("["), F.col("value")), F.concat(F.lit("["), "value", F.lit("]")))
    whose = parent_folder(F.col("_metadata.file_path")) if entity is None else F.lit(entity)
    return raw.select(whose.alias("entity"), F.inline(F.from_json(body, f"array<struct<{', '.join(':'.join(p.split(' ', 1)) for p in _fields())}>>")))


def _fields() -> list[str]:
    parts, depth, own = [], 0, ""
    for c in ACTIVITY:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(own.strip())
            own = ""
        else:
            own += c
    return [*parts, own.strip()]


def signals(raw: DataFrame, keys: list[str], streams: str, names: list[str]) -> DataFrame:
    """keys, sec and a column for each named signal from array<struct<type, data:array<double>>>; shorter signals end
    in nulls."""
    one = lambda n: F.coalesce(F.get(F.filter(streams, lambda s: s["type"] == n), F.lit(0))["data"], F.array().cast("array<double>"))
    zipped = F.arrays_zip(*[one(n).alias(n) for n in names])
    return raw.select(*keys, F.posexplode(zipped).alias("sec", "_z")).select(*keys, "sec", *[F.col("_z")[n].alias(n) for n in names])


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their spellings that exists, as tolerant numbers; null where none does."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda xs: next((F.col(have[x.lower()]) for x in xs if x.lower() in have), F.lit(None))
    return df.select(*[parse.number(pick(xs).cast("string")).alias(n) for n, xs in names.items()])


def heart_rate_csv(spark: SparkSession, path: str) -> DataFrame:
    """sec, hr, speed_kmh, cadence of a CSV with one of the usual headings; speeds in m/s are converted."""
    raw = spark.read.csv(path, header=True)
    d = aliased(raw, {"sec": ["sec", "time_sec"], "hr": ["hr", "heart_rate"], "_kmh": ["speed_kmh"], "_mps": ["velocity_mps"], "cadence": ["cadence"]})
    return d.where("sec IS NOT NULL").select("sec", "hr", F.coalesce("_kmh", F.col("_mps") * 3.6).alias("speed_kmh"), "cadence")


def trackpoints(spark: SparkSession, path: str) -> DataFrame:
    """file, sec, hr of XML track points, from each file's first one."""
    from pyspark.sql import Window

    raw = spark.read.format("xml").option("rowTag", "Trackpoint").schema("Time string, HeartRateBpm struct<Value:double>").load(path).select("*", F.col("_metadata.file_name").alias("file"))
    t = raw.select("file", F.try_to_timestamp(F.col("Time")).alias("_t"), F.col("HeartRateBpm.Value").alias("hr")).where("_t IS NOT NULL")
    us = F.unix_micros("_t")
    return t.select("file", ((us - F.min(us).over(Window.partitionBy("file"))) / 1e6).alias("sec"), "hr")


def table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with its contract columns first; literal NA stays text, and a missing file gives no rows."""
    from pyspark.errors import AnalysisException

    from ..operators.upsert import in_contract

    try:
        return in_contract(spark.read.csv(path, header=True, nullValue=""), columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
