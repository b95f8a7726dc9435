"""Sequential states, by composition of state functions.

A held state meets the rows of a series in order and takes a row's value where a guard allows it: the last accepted beat,
the slope in use, the last counted height. What a stretch of rows does to a state is a function that is told by few rows, its
captors: the first one that takes the state decides which value it has at the end, and a state that none of them takes
stays as it was. So a series is cut into pieces by its order, the functions of all pieces are found side by side, a pass over one
function a piece gives the state that each piece begins with, and the pieces are gone through again from there. No task
holds more than a piece, whatever the length of a series, and work is linear in its rows but for the states that a
piece keeps apart, most often one: a row that all of them accept makes them one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Rows of a piece, where rows are numbered.
PIECE = 100_000
_SLACK = 1e-12


@dataclass(frozen=True)
class Guard:
    """Which states take a row's x: with `ratio`, those that x is off by at most `by` of the state; with `within`, by at most
    `by`; with `beyond`, by `by` at least. A state that is null takes any."""

    kind: str
    by: float

    def takes(self, state: float, x: float) -> bool:
        if self.kind == "ratio":
            return abs(x - state) / state <= self.by
        return abs(x - state) <= self.by if self.kind == "within" else abs(x - state) >= self.by

    def column(self, state: Column, x: Column) -> Column:
        """takes() as a column; null where the state is."""
        off = F.abs(x - state)
        return off / state <= self.by if self.kind == "ratio" else off <= self.by if self.kind == "within" else off >= self.by

    def reach(self, x: float, wider: float) -> list[tuple[float, float]]:
        """Intervals of the states that take x, made wider by so much of their size, or narrower."""
        if self.kind == "ratio":  # of positive states
            low, high = x / (1 + self.by), x / (1 - self.by) if self.by < 1 else math.inf
        else:
            low, high = x - self.by, x + self.by
        slack = wider * max(abs(x), abs(self.by), 1.0)
        if self.kind == "beyond":
            return [(-math.inf, low + slack), (high - slack, math.inf)]
        return [(low - slack, high + slack)]


def captors(x: np.ndarray, value: np.ndarray, guard: Guard, domain: tuple[float, float]) -> tuple[list[float], list[float]]:
    """The function of a piece: x of each captor, and the value at the end of a state that it takes."""
    open_, at, live = [domain], [], {}  # states that no row has taken for sure; the captors of each value held now
    x, value = x.tolist(), value.tolist()
    n, i = len(x), 0
    while i < n:
        if not open_ and len(live) == 1:
            break
        d, v = x[i], value[i]
        moved = [s for s in live if s != v and guard.takes(s, d)]
        if moved:
            live.setdefault(v, []).extend(c for s in moved for c in live.pop(s))
        if open_ and any(a <= hi and b >= lo for lo, hi in guard.reach(d, _SLACK) for a, b in open_):
            live.setdefault(v, []).append(len(at))
            at.append(d)
            for lo, hi in guard.reach(d, -_SLACK):
                if lo <= hi:
                    open_ = [part for a, b in open_ for part in ((a, min(b, lo)), (max(a, hi), b)) if part[0] < part[1]]
        i += 1
    if i < n:
        s = run(x[i:], value[i:], guard, next(iter(live)))[1]
        live = {s: [c for own in live.values() for c in own]}
    end = {c: s for s, own in live.items() for c in own}
    return at, [end[c] for c in range(len(at))]


def after(state: float | None, at: Sequence[float], end: Sequence[float], guard: Guard) -> float | None:
    """The state behind a piece with the given captors."""
    for x, v in zip(at, end):
        if state is None or guard.takes(state, x):
            return v
    return state


def run(x: Sequence[float], value: Sequence[float], guard: Guard, state: float | None) -> tuple[list[float | None], float | None]:
    """The state that each row meets, and the last one."""
    met, by = [], guard.by
    if guard.kind == "ratio":
        for d, v in zip(x, value):
            met.append(state)
            if state is None or abs(d - state) / state <= by:
                state = v
    elif guard.kind == "within":
        for d, v in zip(x, value):
            met.append(state)
            if state is None or abs(d - state) <= by:
                state = v
    else:
        for d, v in zip(x, value):
            met.append(state)
            if state is None or abs(d - state) >= by:
                state = v
    return met, state


def held(df: DataFrame, keys: Sequence[str], order: str, piece: Column, x: Column, value: Column, guard: Guard, domain: tuple[float, float] = (-math.inf, math.inf)) -> DataFrame:
    """df with `before`, the state that a row of (keys) meets in the given order, null before a row was taken.

    A row with a null x or value takes part in nothing but meets the state. `piece` numbers the pieces of a series and must not
    fall along the order; rows of one key and piece are what a task holds. `domain` bounds the values.
    """
    own = df.withColumns({"_piece": piece.cast("long"), "_x": x.cast("double"), "_v": F.when(x.isNotNull(), value.cast("double"))})
    own = own.withColumn("_x", F.when(F.col("_v").isNotNull(), F.col("_x")))
    by = [*keys, "_piece"]
    kinds = [own.schema[k] for k in by]

    def ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by(order)
        v = table.column("_v").to_numpy(zero_copy_only=False).astype(float)
        some = np.flatnonzero(table.column("_v").is_valid().to_numpy(zero_copy_only=False))
        return table, some, table.column("_x").to_numpy(zero_copy_only=False).astype(float)[some], v[some]

    def function(table: pa.Table) -> pa.Table:
        _, _, x, v = ordered(table.select([order, "_x", "_v"]))
        at, end = captors(x, v, guard, domain)
        lists = pa.list_(pa.float64())
        return table.select(by).slice(0, 1).append_column("_at", pa.array([at], lists)).append_column("_end", pa.array([end], lists))

    def prefix(table: pa.Table) -> pa.Table:
        table = table.sort_by("_piece")
        state, starts = None, []
        for at, end in zip(table.column("_at").to_pylist(), table.column("_end").to_pylist()):
            starts.append(state)
            state = after(state, at, end, guard)
        return table.select(by).append_column("_start", pa.array(starts, pa.float64()))

    def again(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows, some, x, v = ordered(rows)
        state = start.column("_start")[0].as_py()
        met, last = run(x.tolist(), v.tolist(), guard, state)
        # a row that takes part in nothing meets what the next one does, or what is left at the end
        every = [*met, last]
        upto = np.searchsorted(some, np.arange(rows.num_rows))
        return rows.drop_columns(["_piece", "_x", "_v"]).append_column("before", pa.array(every, pa.float64()).take(pa.array(upto)))

    numbers = ArrayType(DoubleType())
    told = own.groupBy(*by).applyInArrow(function, StructType([*kinds, StructField("_at", numbers), StructField("_end", numbers)]))
    starts = told.groupBy(*keys).applyInArrow(prefix, StructType([*kinds, StructField("_start", DoubleType())]))
    out = StructType([*[StructField(f.name, f.dataType) for f in df.schema], StructField("before", DoubleType())])
    return own.groupBy(*by).cogroup(starts.groupBy(*by)).applyInArrow(again, out)
