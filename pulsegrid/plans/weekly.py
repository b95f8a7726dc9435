"""Weekly views of the day tables, and distance splits, pauses, climbs and continuity of single sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rules import yes
from ..operators import folds, islands
from ..operators.windows import day_number


def week_of(day: str = "Fecha") -> Column:
    return F.trunc(F.col(day), "week")


def week_calendar(days: DataFrame, keys: Sequence[str], columns: Sequence[str], day: str = "Fecha") -> DataFrame:
    """Seven rows for each key and week that has a day; missing days stay missing, they are no zeros."""
    weeks = days.select(*keys, week_of(day).alias("week")).distinct()
    every = weeks.select(*keys, "week", F.explode(F.sequence(F.col("week"), F.date_add("week", 6))).alias(day))
    return every.join(days.select(*keys, day, *columns), [*keys, day], "left")


def load_versus_before(days: DataFrame, keys: Sequence[str], load: str, day: str = "Fecha", weeks: int = 3, band: float = 0.30) -> DataFrame:
    """keys, week, load, before and class against the mean of the calendar weeks before: up, down, steady, unknown."""
    total = days.groupBy(*keys, week_of(day).alias("week")).agg(F.sum(load).alias("load"))
    w = Window.partitionBy(*keys).orderBy(day_number("week")).rangeBetween(-7 * weeks, -7)
    t = total.withColumn("before", F.avg("load").over(w)).withColumn("_n", F.count("load").over(w))
    rule = F.when(~yes(F.col("_n") >= weeks), "unknown").when(F.col("load") > (1 + band) * F.col("before"), "up").when(F.col("load") < (1 - band) * F.col("before"), "down").otherwise("steady")
    return t.select(*keys, "week", "load", "before", rule.alias("class"))


def zone_shares(sessions: DataFrame, keys: Sequence[str], zones: Sequence[str], day: str = "Fecha", dominance: float = 80.0) -> DataFrame:
    """keys, week and the share of each zone's minutes in percent, with the zone that exceeds `dominance`, if any."""
    sums = sessions.groupBy(*keys, week_of(day).alias("week")).agg(*[F.coalesce(F.sum(z), F.lit(0.0)).cast("double").alias(z) for z in zones])
    total = sum((F.col(z) for z in zones), F.lit(0.0))
    out = sums.withColumn("_t", total)
    for z in zones:
        out = out.withColumn(f"{z}_pct", F.when(F.col("_t") > 0, 100 * F.col(z) / F.col("_t")))
    return out.withColumn("dominant", F.coalesce(*[F.when(F.col(f"{z}_pct") > dominance, z) for z in zones])).drop("_t")


def week_means(days: DataFrame, keys: Sequence[str], x: str, ok: Column, day: str = "Fecha", below: float | None = None) -> DataFrame:
    """keys, week, n, mean, low, high and, with `below`, the percentage of days under it, over days that are ok."""
    v = F.when(yes(ok), F.col(x))
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high")]
    if below is not None:
        aggs.append((100 * F.avg(F.when(v.isNotNull(), (v < below).cast("int")))).alias("pct_below"))
    return days.groupBy(*keys, week_of(day).alias("week")).agg(*aggs)


def monotony(days: DataFrame, keys: Sequence[str], load: str, day: str = "Fecha") -> DataFrame:
    """keys, week, total, monotony and strain: mean over spread of the week's seven loads, days without one as zero."""
    sums = days.groupBy(*keys, week_of(day).alias("week"), day).agg(F.coalesce(F.sum(load), F.lit(0)).cast("double").alias("_l"))
    w = sums.groupBy(*keys, "week").agg(F.sum("_l").alias("total"), F.sum(F.pow("_l", 2)).alias("_q"))
    spread = F.sqrt(F.greatest(F.col("_q") / 7 - F.pow(F.col("total") / 7, 2), F.lit(0.0)))
    m = F.when(spread > 1e-9, F.col("total") / 7 / spread)
    return w.select(*keys, "week", "total", m.alias("monotony"), (F.col("total") * m).alias("strain"))


def pauses(samples: DataFrame, keys: Sequence[str], speed: str, min_speed: float = 0.5, min_s: int = 15) -> DataFrame:
    """keys, n_pauses, total_s, longest_s of stops of at least min_s; samples are a second each."""
    r = islands.runs(samples, keys, "sec", ~yes(F.col(speed) >= min_speed)).where(F.col("n") >= min_s)
    got = r.groupBy(*keys).agg(F.count("*").alias("n_pauses"), F.sum("n").alias("total_s"), F.max("n").alias("longest_s"))
    return samples.select(*keys).distinct().join(got, list(keys), "left").fillna(0, ["n_pauses", "total_s", "longest_s"])


def continuity(samples: DataFrame, keys: Sequence[str], zone: Column, least: Sequence[int] = (60, 120, 300)) -> DataFrame:
    """keys, zone, n_runs, longest_s, median_s and the seconds in runs of at least so many seconds each."""
    w = Window.partitionBy(*keys).orderBy("sec")
    s = samples.withColumn("zone", zone)
    s = s.withColumn("_g", F.sum(F.when(F.col("zone").eqNullSafe(F.lag("zone").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = s.where("zone IS NOT NULL").groupBy(*keys, "zone", "_g").agg(F.count("*").alias("_n"))
    held = lambda n: F.coalesce(F.sum(F.when(F.col("_n") >= n, F.col("_n"))), F.lit(0)).alias(f"in_{n}s")
    return r.groupBy(*keys, "zone").agg(F.count("*").alias("n_runs"), F.max("_n").alias("longest_s"), F.percentile("_n", 0.5).alias("median_s"), *map(held, least))


def splits(samples: DataFrame, keys: Sequence[str], speed: str, hr: str, moving_speed: float = 0.5, length_m: float = 1000.0, altitude: str | None = None) -> DataFrame:
    """keys, split (from 1), seconds, moving_s, distance_m, hr_mean for each length_m of running distance; with an
    altitude also gain_m and loss_m inside the split."""
    w = Window.partitionBy(*keys).orderBy("sec")
    d = F.sum(F.coalesce(F.col(speed), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = samples.withColumn("split", (F.floor(F.coalesce(d, F.lit(0.0)) / length_m) + 1).cast("long"))
    got = s.groupBy(*keys, "split").agg(F.count("*").alias("seconds"), F.count_if(F.col(speed) >= moving_speed).alias("moving_s"), F.sum(speed).alias("distance_m"), F.avg(hr).alias("hr_mean"))
    return got.join(climb(s, [*keys, "split"], altitude), [*keys, "split"], "left") if altitude else got


def climb(samples: DataFrame, keys: Sequence[str], altitude: str, dead_band: float = 0.5, smooth: int = 11) -> DataFrame:
    """keys, gain_m, loss_m of the smoothed altitude; a move counts once it leaves the dead band around the last
    counted height, which depends on all moves before, so that height is a held state."""
    half = smooth // 2
    w = Window.partitionBy(*keys).orderBy("sec").rowsBetween(-half, half)
    guard = folds.Guard("beyond", dead_band)
    s = samples.withColumn("_h", stats.frame_median(altitude, w)).where("_h IS NOT NULL").select(*keys, F.col("sec").cast("long").alias("sec"), F.col("_h").cast("double").alias("_h"))
    s = folds.held(s, keys, "sec", F.floor(F.col("sec") / folds.PIECE), F.col("_h"), F.col("_h"), guard)
    move = F.when(yes(guard.column(F.col("before"), F.col("_h"))), F.col("_h") - F.col("before")).otherwise(0.0)
    s = s.withColumn("_m", move)
    return s.groupBy(*keys).agg(F.sum(F.greatest("_m", F.lit(0.0))).alias("gain_m"), F.sum(F.greatest(-F.col("_m"), F.lit(0.0))).alias("loss_m"))


def grades(samples: DataFrame, keys: Sequence[str], altitude: str, distance: str, seconds: int = 10, flat: float = 0.01) -> DataFrame:
    """keys and seconds uphill, downhill and flat by the slope over the last `seconds` samples."""
    w = Window.partitionBy(*keys).orderBy("sec")
    run = F.col(distance) - F.lag(distance, seconds).over(w)
    slope = samples.withColumn("_s", F.when(run > 0, (F.col(altitude) - F.lag(altitude, seconds).over(w)) / run))
    return slope.groupBy(*keys).agg(F.count_if(F.col("_s") > flat).alias("up_s"), F.count_if(F.col("_s") < -flat).alias("down_s"), F.count_if(F.abs("_s") <= flat).alias("flat_s"))
