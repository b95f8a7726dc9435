"""Sensor packets to beats, motion and respiration.

Filters of the signal-processing kind are re-aimed as moving means and aggregates: the operators are the same, the
bits are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..config import BeatConfig
from ..functions.rules import yes
from ..operators import beats as B
from ..operators.joins import in_any_interval

KEY = ["entity", "rec"]


def _w():
    return Window.partitionBy(*KEY).orderBy("t")


def _each():
    """A recording as a whole: what is told of it stands beside its samples without a join, which would make them anew."""
    return Window.partitionBy(*KEY)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.where(" AND ".join(f"{c} IS NOT NULL" for c in KEY))


def unit_seconds(samples: DataFrame, ts: str) -> DataFrame:
    """samples with t in seconds; whether stamps are in s, ms, us or ns is told by a recording's median. Samples of no recording are left out."""
    scale = F.when(F.col("_m") > 1e17, 1e9).when(F.col("_m") > 1e14, 1e6).when(F.col("_m") > 1e11, 1e3).otherwise(1.0)
    return _keyed(samples).withColumn("_m", F.percentile(ts, 0.5).over(_each())).withColumn("t", F.col(ts) / scale).drop("_m")


def increasing(samples: DataFrame, tie: str) -> DataFrame:
    """One sample for each time of a recording, the first by tie."""
    return samples.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "t").orderBy(tie))).where("_r = 1").drop("_r")


def sampling_rate(samples: DataFrame) -> DataFrame:
    gaps = samples.withColumn("_d", F.col("t") - F.lag("t").over(_w())).where("_d > 0")
    return gaps.groupBy(*KEY).agg((1 / F.percentile("_d", 0.5)).alias("fs"))


def peaks(samples: DataFrame, x: str, half: int = 8, mult: float = 3.0, apart_s: float = 0.45, least: int = 20) -> DataFrame:
    """Times and strengths of peaks: energy of the detrended signal, local maxima over a robust threshold, and of
    those nearer than apart_s to the one before the strongest. Recordings with fewer than `least` are left out."""
    near = _w().rowsBetween(-half, half)
    s = _keyed(samples).withColumn("_d", F.col(x) - F.avg(x).over(_w().rowsBetween(-4 * half, 4 * half)))
    s = s.withColumn("e", F.avg(F.pow("_d", 2)).over(near))
    s = s.withColumns({"_m": F.percentile("e", 0.5).over(_each()), "_a": F.lag("e").over(_w()), "_b": F.lead("e").over(_w())})
    top = s.withColumn("_s", F.percentile(F.abs(F.col("e") - F.col("_m")), 0.5).over(_each()))
    top = top.where((F.col("e") > F.col("_a")) & (F.col("e") >= F.col("_b")) & (F.col("e") > F.col("_m") + mult * 1.4826 * F.col("_s")))
    g = top.withColumn("_new", F.coalesce((F.col("t") - F.lag("t").over(_w()) >= apart_s).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    best = g.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY, "_g").orderBy(F.desc("e"), "t"))).where("_r = 1")
    enough = best.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= least)
    return enough.select(*KEY, "t", F.col("e").alias("strength"))


def intervals(found: DataFrame) -> DataFrame:
    """Beats between peaks: beat_idx, center, t_end and duration_ms."""
    b = found.withColumn("_p", F.lag("t").over(_w())).withColumn("beat_idx", F.row_number().over(_w()) - 1).where("_p IS NOT NULL")
    return b.select(*KEY, F.col("beat_idx").cast("long").alias("beat_idx"), ((F.col("t") + F.col("_p")) / 2).alias("center"), F.col("t").alias("t_end"), (1000 * (F.col("t") - F.col("_p"))).alias("duration_ms"))


def motion(samples: DataFrame, x: str, y: str, z: str, window_s: int = 5, mult: float = 3.0) -> DataFrame:
    """Windows of window_s, one a second, with the root mean square of dynamic acceleration and whether it is high:
    above median plus mult robust spreads of the recording's windows."""
    s = _keyed(samples)
    for c in (x, y, z):
        s = s.withColumn(f"_{c}", F.col(c) - F.avg(c).over(_w().rowsBetween(-50, 50)))
    s = s.withColumn("_e", sum((F.pow(F.col(f"_{c}"), 2) for c in (x, y, z)), F.lit(0.0)))
    k = F.floor("t").cast("long")
    each = s.withColumn("k", F.explode(F.sequence(k - window_s + 1, k)))
    w = each.groupBy(*KEY, "k").agg(F.sqrt(F.avg("_e")).alias("rms"), F.count("*").alias("n"))
    w = w.withColumn("_m", F.percentile("rms", 0.5).over(_each())).withColumn("_s", F.percentile(F.abs(F.col("rms") - F.col("_m")), 0.5).over(_each()))
    bound = F.col("_m") + mult * 1.4826 * F.col("_s")
    return w.select(*KEY, "k", F.col("k").cast("double").alias("start"), (F.col("k") + window_s).cast("double").alias("stop"), "rms", (F.col("rms") > bound).alias("high"))


def gate_by_motion(beats: DataFrame, windows: DataFrame, width: float = 5.0) -> DataFrame:
    """beats with inside: whether their centre lies in a window of high motion, both ends included."""
    return in_any_interval(beats, windows.where("high"), KEY, "beat_idx", "center", "start", "stop", width)


def dominant_frequency(samples: DataFrame, axes: list[str], low: float = 0.08, high: float = 0.60, step: float = 0.02, window_s: int = 30, hop_s: int = 5, block: int = 60) -> DataFrame:
    """For each window the axis and frequency of greatest power in the band, and peak over median power.

    The transform is sums of c cos and c sin over a fixed grid of frequencies, c being a sample less its window's mean: taken from
    sums of x afterwards, the mean would leave rounding errors that decide between axes of equal power. Samples are dealt by blocks of so many
    windows, those of a window that begins in the block before once more, and go through Arrow in order of time, so a task holds one block at a time.
    """
    n = window_s // hop_s
    grid = [round(low + i * step, 6) for i in range(int(round((high - low) / step)) + 1)]
    hop = F.floor(F.col("t") / hop_s).cast("long")
    dealt = samples.where("t IS NOT NULL").select(*KEY, F.col("t").cast("double").alias("t"), *[F.col(a).cast("double").alias(a) for a in axes], hop.alias("_h"))
    dealt = dealt.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_h") - n + 1) / block), F.floor(F.col("_h") / block))))
    dealt = dealt.repartition(*KEY, "_b").sortWithinPartitions(*KEY, "_b", "t")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts(rows)
            held = rows.slice(starts[-1]) if len(starts) else rows  # may go on in the next batch
            if len(starts) > 1:
                yield from _spectra(rows.slice(0, starts[-1]), starts[:-1], sorted(axes), grid, n, block).to_batches()
        if held is not None and len(held):
            yield from _spectra(held, _starts(held), sorted(axes), grid, n, block).to_batches()

    kinds = [samples.schema[c] for c in KEY]
    told = StructType([*kinds, StructField("k", LongType()), StructField("axis", StringType()), StructField("frequency", DoubleType()), StructField("confidence", DoubleType())])
    return dealt.mapInArrow(found, told).select(*KEY, "k", "axis", "frequency", (60 * F.col("frequency")).alias("per_minute"), "confidence")


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a recording's block begins, in rows that are in order of both."""
    if not len(rows):
        return np.zeros(0, int)
    new = np.ones(len(rows), bool)
    codes = [rows[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (*KEY, "_b")]
    new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(new)


def _spectra(rows: pa.Table, starts: np.ndarray, axes: list[str], grid: list[float], n: int, block: int) -> pa.Table:
    """The rows of dominant_frequency() of whole blocks; of equal powers the lower frequency, of equal bands the first axis."""
    t, b = rows["t"].to_numpy(), rows["_b"].to_numpy()
    of = np.repeat(np.arange(len(starts)), np.diff([*starts, len(t)]))
    wide = block + 2 * n
    place = of * wide + rows["_h"].to_numpy() - b * block
    first = (np.arange(len(starts))[:, None] * wide + np.arange(block)).ravel()
    lo, hi = np.searchsorted(place, first), np.searchsorted(place, first + n)
    there = hi > lo
    lo, size = lo[there], (hi - lo)[there]
    row = np.repeat(starts, block)[there]
    k = (b[starts][:, None] * block + np.arange(block)).ravel()[there]
    # a window's samples one behind the other; where each window begins there
    begin = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(lo - begin, size)
    wave = 2 * np.pi * np.array(grid) * t[:, None]
    wave = np.hstack([np.cos(wave), np.sin(wave)])[at]
    power, band = np.zeros((len(axes), len(k), len(grid))), np.full((len(axes), len(k)), -1.0)
    for i, a in enumerate(axes):
        have = rows[a].is_valid().to_numpy()[at]
        x = np.where(have, rows[a].to_numpy()[at], 0.0)
        m = np.add.reduceat(have.astype(float), begin)
        c = np.where(have, x - np.repeat(np.add.reduceat(x, begin) / np.maximum(m, 1), size), 0.0)
        sums = np.add.reduceat(c[:, None] * wave, begin)
        power[i] = sums[:, : len(grid)] ** 2 + sums[:, len(grid) :] ** 2
        band[i] = np.where(m > 0, np.add.reduce(power[i].T), -1.0)
    # bands that are equal but for rounding are equal: short windows of axes that go up and down together
    some, band = band.max(0) != -1, np.where(np.isnan(band), np.inf, band)
    best = np.argmax(band >= band.max(0) * (1 - 1e-12), 0)
    p = power[best, np.arange(len(k))]
    top, mid = np.argmax(p, 1), np.median(p, 1)
    flat = mid <= 0
    confidence = pa.array(p[np.arange(len(k)), top] / np.where(flat, 1.0, mid), mask=flat)
    got = pa.table({**{c: rows[c].take(pa.array(row)) for c in KEY}, "k": pa.array(k, pa.int64()), "axis": pa.array(axes).take(pa.array(best)), "frequency": pa.array(np.array(grid)[top]), "confidence": confidence})
    return got.filter(pa.array(some))


def clock(packets: DataFrame, rounds: int = 2) -> DataFrame:
    """KEY, scale and offset of a recording's device clock: phone time is offset + scale times device time.

    packets have phone and device, both in seconds. The line goes through the medians of what is left in the first and the last
    third of the packets by device time, first beside a scale of one and then beside the line before, so packets that the phone was late to stamp do not
    bend it. Fewer than three packets, or packets of one device time, give a scale of one.
    """
    known = _keyed(packets).where("phone IS NOT NULL AND device IS NOT NULL").select(*KEY, F.col("phone").cast("double").alias("phone"), F.col("device").cast("double").alias("device"))
    order = Window.partitionBy(*KEY).orderBy("device", "phone")
    thirds = known.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*KEY)), "scale": F.lit(1.0)})
    first, last = F.col("_i") * 3 < F.col("_n"), F.col("_i") * 3 >= 2 * F.col("_n")
    mid = lambda cond, c: F.percentile(F.when(cond, c), 0.5).over(_each())
    for _ in range(rounds):
        rest = F.col("phone") - F.col("scale") * F.col("device")
        thirds = thirds.withColumns({f"_{name}{k}": mid(cond, c) for k, cond in enumerate((first, last)) for name, c in (("r", rest), ("d", F.col("device")))})
        span = F.col("_d1") - F.col("_d0")
        thirds = thirds.withColumn("scale", F.col("scale") + F.when((F.col("_n") >= 3) & (span > 0), (F.col("_r1") - F.col("_r0")) / span).otherwise(0.0))
    return thirds.groupBy(*KEY, "scale").agg(F.percentile(F.col("phone") - F.col("scale") * F.col("device"), 0.5).alias("offset"))


def on_phone_time(samples: DataFrame, packets: DataFrame) -> DataFrame:
    """samples with t on the phone's axis, by their recording's clock; recordings without packets stay on their own."""
    c = clock(packets)
    return samples.join(c, KEY, "left").withColumn("t", F.coalesce(F.col("offset") + F.col("scale") * F.col("t"), F.col("t"))).drop("scale", "offset")


def beat_events(found: DataFrame, cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """intervals() with offline and reason: out of range, or off by more than a share of the interval before, whatever that is."""
    b = intervals(found)
    before = F.lag("duration_ms").over(Window.partitionBy(*KEY).orderBy("beat_idx"))
    d = F.col("duration_ms")
    b = b.withColumn("reason", F.when((d < cfg.min_ms) | (d > cfg.max_ms), "RR_OUT_OF_RANGE").when(yes(F.abs(d - before) / F.greatest(before, F.lit(1e-9)) > cfg.delta_max), "DELTA_RR_GT_20P").otherwise("OK"))
    return b.withColumn("offline", (F.col("reason") != "OK").cast("int"))


@dataclass(frozen=True)
class PeakConfig:
    half: int = 8
    mult: float = 3.0
    apart_s: float = 0.45
    least: int = 20


@dataclass(frozen=True)
class Converted:
    """What a pair of recordings gives: beats, windows of motion, respiration, and a row of figures for each recording."""

    beats: DataFrame
    motion: DataFrame
    respiration: DataFrame
    summary: DataFrame


def convert(ecg: DataFrame, acc: DataFrame, ecg_packets: DataFrame | None = None, acc_packets: DataFrame | None = None, gate: bool = False,
            cfg: BeatConfig = BeatConfig(), peak: PeakConfig = PeakConfig(), least: tuple[int, int] = (200, 50), **band) -> Converted:
    """Beats, motion and respiration of recordings: ecg (KEY, ts, voltage) and acc (KEY, ts, x, y, z).

    Stamps of either unit become seconds; with packets (KEY, phone, device, in seconds) both sensors are put on the phone's
    axis, as their own clocks have different origins and drift apart. Samples of one time count once. With `gate` beats
    whose centre lies in a window of high motion are offline. Recordings of fewer samples than `least` are left out
    on that side. `band` goes to dominant_frequency().
    """
    def ready(samples: DataFrame, packets: DataFrame | None, few: int, tie: str) -> DataFrame:
        s = increasing(unit_seconds(samples.where("ts IS NOT NULL"), "ts"), tie)
        s = s.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= few).drop("_n")
        return s if packets is None else on_phone_time(s, packets)

    e = ready(ecg.where("voltage IS NOT NULL"), ecg_packets, least[0], "voltage")
    a = ready(acc.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"), acc_packets, least[1], "x")
    beats = beat_events(peaks(e, "voltage", peak.half, peak.mult, peak.apart_s, peak.least), cfg)
    windows = motion(a, "x", "y", "z")
    if gate:
        beats = gate_by_motion(beats, windows).withColumn("reason", F.when(F.col("inside") & (F.col("offline") == 0), "ACC_HIGH_MOTION").otherwise(F.col("reason")))
        beats = beats.withColumn("offline", (F.col("reason") != "OK").cast("int")).drop("inside")
    beats = beats.select(*KEY, "beat_idx", "center", "t_end", "duration_ms", "offline", "reason")
    checked = B.validate(beats, KEY, "duration_ms", "offline", cfg)
    rates = sampling_rate(e).withColumnRenamed("fs", "fs_ecg").join(sampling_rate(a).withColumnRenamed("fs", "fs_acc"), KEY, "full")
    return Converted(beats, windows, dominant_frequency(a, ["x", "y", "z"], **band), checked.join(rates, KEY, "full"))
