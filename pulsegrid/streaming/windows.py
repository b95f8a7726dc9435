"""Variability of beats in event-time windows, as they arrive.

Each window of each recording is a group and a state of its own, so a recording that brings a third of all beats is
spread over all tasks, and a state never holds more than a window's beats. Beats may come in any order: they are put in order when
the watermark passes the window's end, once, and then the state is removed. A batch adds its beats of a window at once, without Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BeatConfig

#: The state store that keeps windows on disk, not on the executors' heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sliding_rmssd(beats: DataFrame, keys: Sequence[str], late_s: float, cfg: BeatConfig = BeatConfig()) -> DataFrame:
    """keys, k, rmssd of a stream of (keys, beat_idx, t_end, duration_ms): the rows of operators.beats.sliding_rmssd, each
    given once, after beats of its recording or others have come that end late_s and a window later.

    Beats that come up to late_s behind the latest one are in their windows; those of windows already given are left
    out. Rows without a time or a duration are left out. t_end is in seconds on one axis for all recordings, as the latest beat of any of them moves the watermark.
    The session should have STATE_STORE as its state store.
    """
    per = int(cfg.window_s // cfg.step_s)
    k = F.floor(F.col("t_end") / cfg.step_s)
    own = beats.where("t_end IS NOT NULL AND duration_ms IS NOT NULL").select(*keys, F.col("beat_idx").cast("long").alias("beat_idx"), F.col("duration_ms").cast("double").alias("duration_ms"), F.explode(F.array(*[k - i for i in range(per)])).alias("k")).where("k >= 0")
    own = own.withColumn("_end", F.timestamp_micros(((F.col("k") * cfg.step_s + cfg.window_s) * 1_000_000).cast("long")))
    own = own.withWatermark("_end", f"{int((late_s + cfg.window_s) * 1000)} milliseconds")
    held = own.groupBy(*keys, "k", "_end").agg(F.sort_array(F.collect_list(F.struct("beat_idx", "duration_ms"))).alias("_v"))
    held = held.select(*keys, "k", F.transform("_v", lambda v: v["duration_ms"]).alias("_d"), (F.size("_v") - 1).alias("_n"))
    steps = F.zip_with(F.slice("_d", F.lit(2), F.col("_n")), F.slice("_d", F.lit(1), F.col("_n")), lambda a, b: F.pow(a - b, 2))
    return held.select(*keys, "k", F.when(F.col("_n") >= max(cfg.min_pairs, 1), F.sqrt(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.col("_n"))).alias("rmssd"))
