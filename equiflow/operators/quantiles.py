"""Exact order statistics of many columns in few passes, whatever the number of rows.

A wanted quantile is the element of rank ceil(p * n) among a column's n values that are not NULL (NaN is the largest).
Each pass reads the frame once for all columns:

1. a sketch (combined in the map tasks) of the values still in question proposes a few elements around the wanted rank;
2. counts of the rows below and equal to each proposed element either name the answer or leave the open
   gap between two of them, which holds a small share of the values;
3. once a gap holds at most ``ROWS`` values, they are counted by value and the answer is read off.

The sketch only proposes: every answer follows from exact counts, so it does not depend on the number of rows or
their order.  The driver holds at most ``ROWS`` values for each column and quantile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 5_000
GRID = 256
ACCURACY = 2_000


class _Wanted:
    """One wanted element: its column and rank, and the open interval (low, high) that still holds it, with the rows below."""

    def __init__(self, col: str, p: float, n: int):
        self.col, self.rank = col, max(1, math.ceil(p * n))
        self.low = self.high = None
        self.below, self.inside = 0, n
        self.value = None

    def within(self) -> Column:
        c = F.col(self.col)
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c > F.lit(self.low))
        if self.high is not None:
            out = out & (c < F.lit(self.high))
        return out

    def proposed(self, grid: list[float]) -> list[float]:
        """Different elements around the wanted rank."""
        at = round((self.rank - self.below) / self.inside * GRID)
        return sorted(set(grid[max(0, at - 2):at + 3]), key=_nan_last)

    def narrowed(self, elements: list[float], below: list[int], equal: list[int]) -> None:
        low, high, lower, upper = self.low, self.high, self.below, self.below + self.inside
        for v, b, e in zip(elements, below, equal):
            if b < self.rank <= b + e:
                self.value = v
                return
            if b + e < self.rank:
                low, lower = v, b + e
            elif high == self.high and b < upper:
                high, upper = v, b
        self.low, self.high, self.below, self.inside = low, high, lower, upper - lower


def _nan_last(v: float):
    return (math.isnan(v), v if not math.isnan(v) else 0.0)


def exact_quantiles(df: DataFrame, cols: list[str], ps: list[float], counts: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """The elements of rank ceil(p * n) of each column (as doubles); None for a column without values."""
    df = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    counts = counts or df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    wanted = {c: [_Wanted(c, p, counts[c]) for p in ps] if counts[c] else [] for c in cols}
    while todo := [w for ws in wanted.values() for w in ws if w.value is None]:
        if wide := [w for w in todo if w.inside > ROWS]:
            _narrow(df, wide)
        if small := [w for w in todo if w.value is None and w.inside <= ROWS]:
            _read_off(df, small)
    return {c: [w.value for w in wanted[c]] or [None] * len(ps) for c in cols}


def _narrow(df: DataFrame, wanted: list[_Wanted]) -> None:
    steps = [k / GRID for k in range(GRID + 1)]
    spans = {(w.col, str(w.low), str(w.high)): w for w in wanted}  # at first all of a column share one sketch
    got = df.agg(*[F.percentile_approx(F.when(w.within(), F.col(w.col)), steps, ACCURACY).alias(f"g{k}") for k, w in enumerate(spans.values())]).first()
    grids = {span: got[k] for k, span in enumerate(spans)}
    elements = [w.proposed(grids[w.col, str(w.low), str(w.high)]) for w in wanted]
    asked = [(w, v) for w, vs in zip(wanted, elements) for v in vs]
    sums = df.agg(*[F.count(F.when(test, 1)).alias(f"{kind}{k}") for k, (w, v) in enumerate(asked)
                    for kind, test in (("b", F.col(w.col) < F.lit(v)), ("e", F.col(w.col) == F.lit(v)))]).first()
    k = 0
    for w, vs in zip(wanted, elements):
        at = range(k, k + len(vs))
        w.narrowed(vs, [sums[f"b{i}"] for i in at], [sums[f"e{i}"] for i in at])
        k += len(vs)


def _read_off(df: DataFrame, wanted: list[_Wanted]) -> None:
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.when(w.within(), F.col(w.col)).alias("v"), w.within().alias("on")) for k, w in enumerate(wanted)])
    rows = df.select(F.explode(F.filter(each, lambda x: x["on"])).alias("x")).groupBy("x.k", "x.v").count().collect()
    for k, w in enumerate(wanted):
        rank = w.rank - w.below
        for v, n in sorted(((r["v"], r["count"]) for r in rows if r["k"] == k), key=lambda r: _nan_last(r[0])):
            if rank <= n:
                w.value = v
                break
            rank -= n
