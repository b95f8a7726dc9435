"""Robust statistics over arrays and frames. Null stands for a missing value throughout; NaN is taken in as null."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def missing_to_null(x) -> Column:
    x = col(x).cast("double")
    return F.when(~F.isnan(x), x)


def round_even(x, digits: int = 0) -> Column:
    """Halves to the even digit of x * 10^digits, a double as it is held: 1.015 lies below its half and becomes 1.01. bround
    would round the decimals that are shown, 1.02."""
    scale = float(10**digits)
    return F.rint(col(x).cast("double") * scale) / scale


def sorted_values(values: Column) -> Column:
    """An array's values that are neither null nor NaN, ascending."""
    return F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))


def quantile_sorted(values: Column, q: float) -> Column:
    """Linear-interpolation quantile (type 7) of a sorted array without nulls; null if it is empty."""
    h = (F.size(values) - 1) * F.lit(float(q))
    low = F.floor(h).cast("int")
    a = F.try_element_at(values, low + 1)
    b = F.try_element_at(values, F.least(low + 2, F.size(values)))
    return F.when(F.size(values) > 0, a + (b - a) * (h - low))


def lost(a: Column, b: Column, total: Column) -> Column:
    """What rounding took from a + b, total as a double, without an error of its own."""
    off = total - a
    return (a - (total - off)) + (b - off)


def between(low, high, share) -> Column:
    """low * (1 - share) + high * share in doubles, rounded as a fused multiply-add: the first product is whole when the second is
    added to it. SQL's quantile_cont takes the line so, and a value that equals a quantile there has to equal it here.

    What rounding takes from the product and from the sum is told without error by their halves, and added at the end.
    """
    low, high, share = (col(c).cast("double") for c in (low, high, share))
    rest = 1 - share
    upper = lambda c: c * 134217729.0 - (c * 134217729.0 - c)  # the first 26 bits
    a, b, product, more = upper(low), upper(rest), low * rest, high * share
    off = ((a * b - product) + a * (rest - b) + (low - a) * b) + (low - a) * (rest - b)
    total = product + more
    return F.when(share == 0, low).otherwise(total + F.nanvl(off + lost(product, more, total), F.lit(0.0)))


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once: inside a lambda, a plain expression is evaluated again for each element."""
    return F.transform(F.array(x), use)[0]


def quantile(values: Column, q: float) -> Column:
    return let(sorted_values(values), lambda s: quantile_sorted(s, q))


def median(values: Column) -> Column:
    return quantile(values, 0.5)


def mad(values: Column) -> Column:
    """Median absolute deviation from the median."""
    gaps = lambda s, mid: F.array_sort(F.transform(s, lambda v: F.abs(v - mid)))
    of = lambda s: let(quantile_sorted(s, 0.5), lambda mid: let(gaps(s, mid), lambda d: quantile_sorted(d, 0.5)))
    return let(sorted_values(values), of)


def robust_sd(values: Column) -> Column:
    return mad(values) * 1.4826


def robust_z(x, values: Column, clip: float = 5.0) -> Column:
    """(x - median) / robust standard deviation, clipped; null where that is zero or missing."""
    scale = robust_sd(values)
    z = (col(x) - median(values)) / scale
    return F.when((scale != 0) & z.isNotNull(), F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)))


def winsorize(values: Column, low: float = 0.10, high: float = 0.90) -> Column:
    """Values held between two quantiles of themselves; nulls stay null."""
    hold = lambda b: F.transform(values, lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, b["high"]), b["low"])))
    return let(F.struct(quantile(values, low).alias("low"), quantile(values, high).alias("high")), hold)


def ols(pairs: Column) -> Column:
    """struct(slope, intercept, r2, n) of an array of struct(x, y) without nulls.

    Sums are taken around the first point, which keeps them exact for values far from zero.
    """
    return let(F.struct(pairs.alias("all"), F.try_element_at(pairs, F.lit(1)).alias("first")), lambda b: _line(b["all"], b["first"]["x"], b["first"]["y"]))


def _line(pairs: Column, x0: Column, y0: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy", "yy")])

    def add(s: Column, p: Column) -> Column:
        x, y = p["x"] - x0, p["y"] - y0
        return F.struct(
            (s["n"] + 1).alias("n"), (s["x"] + x).alias("x"), (s["y"] + y).alias("y"),
            (s["xx"] + x * x).alias("xx"), (s["xy"] + x * y).alias("xy"), (s["yy"] + y * y).alias("yy"))

    def end(s: Column) -> Column:
        sxx, sxy, syy = s["xx"] - s["x"] * s["x"] / s["n"], s["xy"] - s["x"] * s["y"] / s["n"], s["yy"] - s["y"] * s["y"] / s["n"]
        slope = F.when(sxx > 0, sxy / sxx)
        return F.struct(
            slope.alias("slope"), (y0 + s["y"] / s["n"] - slope * (x0 + s["x"] / s["n"])).alias("intercept"),
            F.when((sxx > 0) & (syy > 0), sxy * sxy / (sxx * syy)).alias("r2"), s["n"].cast("long").alias("n"))

    return F.when(F.size(pairs) > 0, F.aggregate(pairs, zero, add, end))


def frame_median(x, w: WindowSpec) -> Column:
    """Median over a frame; percentile() is the form that takes frames."""
    return F.percentile(col(x), 0.5).over(w)


def frame_mad(x, w: WindowSpec) -> Column:
    return mad(F.collect_list(col(x)).over(w))


def rmssd(x, previous) -> Column:
    """Aggregate: root mean square of successive differences; pairs with a missing side do not count."""
    return F.sqrt(F.avg(F.pow(col(x) - col(previous), 2)))
