"""Aggregates that merge: sketches stored for each entity and day, put together over any range, and grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a distinct count (2^12: a standard error of 1.6 %) and items of a quantile sketch (rank error below 1 %).
LOG_REGISTERS, ITEMS = 12, 400


def daily(df: DataFrame, keys: Sequence[str], day: str, distinct: Sequence[str] = (), measures: Sequence[str] = ()) -> DataFrame:
    """keys, day, n, distinct_<c> (binary) of each distinct column, and sum_<c>, low_<c>, high_<c>, quantiles_<c> (binary) of
    each measure.

    A row a key and day, whatever the rows behind it: the table to store. Nulls count in n alone. A day's sketches are
    as good as those of any range that they are merged to.
    """
    plain = dict(df.dtypes)
    item = lambda c: F.col(c) if plain[c] in ("int", "bigint", "string", "binary") else F.xxhash64(F.when(F.col(c).isNotNull(), F.col(c)))
    known = lambda c: F.when(F.col(c).isNotNull(), item(c))
    aggs = [F.count("*").alias("n"), *[F.hll_sketch_agg(known(c), F.lit(LOG_REGISTERS)).alias(f"distinct_{c}") for c in distinct]]
    for c in measures:
        x = F.col(c).cast("double")
        aggs += [F.sum(x).alias(f"sum_{c}"), F.min(x).alias(f"low_{c}"), F.max(x).alias(f"high_{c}"), F.kll_sketch_agg_double(x, F.lit(ITEMS)).alias(f"quantiles_{c}")]
    return df.groupBy(*keys, day).agg(*aggs)


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of daily() for coarser keys, or for the days that are left after a filter; they merge on in the same way."""
    aggs = [F.sum("n").alias("n")]
    for c in sketches.columns:
        kind = c.split("_", 1)[0]
        if kind == "distinct":
            aggs.append(F.hll_union_agg(c).alias(c))
        elif kind == "quantiles":
            aggs.append(F.kll_merge_agg_double(c, F.lit(ITEMS)).alias(c))
        elif kind in ("sum", "low", "high") and c not in keys:
            aggs.append({"sum": F.sum, "low": F.min, "high": F.max}[kind](c).alias(c))
    return sketches.groupBy(*keys).agg(*aggs)


def told(sketches: DataFrame, keys: Sequence[str], ranks: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """keys, n and what the sketches say: distinct_<c> as a number, mean_<c>, low_<c>, high_<c> and quantiles_<c> at the ranks;
    null where no value was seen."""
    out = [F.col("n")]
    for c in sketches.columns:
        kind, _, name = c.partition("_")
        if kind == "distinct":
            out.append(F.hll_sketch_estimate(c).alias(c))
        elif kind == "quantiles":
            seen = F.kll_sketch_get_n_double(c)
            out.append(F.when(seen > 0, F.kll_sketch_get_quantile_double(c, F.array(*map(F.lit, ranks)))).alias(c))
            out.append(F.when(seen > 0, F.col(f"sum_{name}") / seen).alias(f"mean_{name}"))
        elif kind in ("low", "high") and c not in keys:
            out.append(F.col(c))
    return sketches.select(*keys, *out)


def grouping_sets(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]] | str, aggs: Sequence) -> DataFrame:
    """dims, level and the aggregates for several groupings in one pass: "rollup", "cube" or the sets of dims named.

    level has a bit for each dim, the first one highest, which is set where the dim is not grouped by: it
    tells the null of a total from that of the data.
    """
    dims = list(dims)
    if sets == "rollup":
        grouped = df.rollup(*dims)
    elif sets == "cube":
        grouped = df.cube(*dims)
    else:
        grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *dims)
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *aggs)
