"""Exponentially weighted means (W05, W06) with built-in sums, exact over series of any length.

Recurrence ``y_t = q*y_{t-1} + a*x_t`` (``adjust=False``, seeded ``y_0 = x_0``)
or the normalised mean ``sum q^(t-k) x_k / sum q^(t-k)`` (``adjust=True``),
with ``q = 1 - a``.  The series is cut into sub-blocks of ``B`` positions
(``i // B``); within one

    s_j = q^r * sum_{k <= j in sub-block} w_k * q^(-r_k)        (r = i mod B)

is a running window sum.  What older sub-blocks carry in is a sum over their
last ``s``, each weaker by ``q^B``; as ``q^B < e^-40``, the last ``CHAIN`` of them hold
everything a double can.  Those sums are one row per sub-block: a partial
aggregate, a window over the ticker's sub-blocks (1/``B`` of its rows), and one map
per block joined back on (ticker, block), so the rows themselves are not dealt again.

The halo of a blocked frame must hold one whole sub-block (``B`` rows, and one more
for differences), and ``block_rows`` must be a multiple of ``B``: then running sums
of copied rows are complete too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EFOLDS = 40.0
_MAX_EXP = 650.0
#: e^-40 to this power is below the least double.
CHAIN = 19


def sub_block_rows(*alphas: float) -> int:
    """Smallest sub-block length valid for all ``alphas``."""
    rates = [-math.log1p(-a) for a in alphas]
    b = max(math.ceil(EFOLDS / r) for r in rates)
    if b * max(rates) > _MAX_EXP:
        raise ValueError("alphas too far apart for one sub-block length; compute them separately")
    return b


def alpha_from(span: float | None = None, com: float | None = None) -> float:
    if span is not None:
        return 2.0 / (span + 1.0)
    if com is not None:
        return 1.0 / (1.0 + com)
    raise ValueError("give span or com")


def _weighted(x: Column, alpha: float, adjust: bool, B: int) -> Column:
    """``w_k * q^(-r_k)`` of a row."""
    w = x if adjust else F.when(F.col("i") == 0, x).otherwise(F.lit(alpha) * x)
    return w * F.pow(F.lit(1.0 - alpha), -(F.col("i") % B))


def ewm_frame(df: DataFrame, specs: dict[str, tuple[Column, float, bool, int]], B: int, block_rows: int,
              key: str = "ticker") -> DataFrame:
    """Add one EWM column per ``name: (x, alpha, adjust, min_periods)`` to a blocked frame.

    The frame has ``_blk``, ``_halo``, ``j`` and ``i`` (``series.with_blocks`` with a halo of more than ``B`` rows).
    """
    if block_rows % B:
        raise ValueError(f"block_rows must be a multiple of {B}")
    df = df.withColumn("_sub", F.floor(F.col("i") / B).cast("long"))
    r = (F.col("i") % B).cast("double")
    ends = df.where(~F.col("_halo")).groupBy(key, "_blk", "_sub").agg(*[
        (F.sum(_weighted(x, alpha, adjust, B)) * F.lit((1.0 - alpha) ** (B - 1))).alias(name)
        for name, (x, alpha, adjust, _mp) in specs.items()])
    # the older sub-blocks, oldest first: each weakens all before it by q^B
    older = Window.partitionBy(key).orderBy("_sub").rowsBetween(-CHAIN, -1)
    carried = ends.withColumn("_old", F.collect_list(F.struct(*specs)).over(older)).select(key, "_blk", "_sub", F.struct(*[
        F.expr(f"aggregate(_old, 0D, (c, e) -> c * {(1.0 - alpha) ** B!r}D + e.`{name}`)").alias(name)
        for name, (_x, alpha, _adjust, _mp) in specs.items()]).alias("_c"))
    # the last sub-block of a block is also the halo of the next one
    per_block = F.lit(block_rows // B)
    carried = carried.withColumn("_to", F.explode(F.when(
        F.col("_sub") % per_block == per_block - 1, F.array("_blk", F.col("_blk") + 1)).otherwise(F.array("_blk"))))
    by_block = carried.groupBy(F.col(key).alias("_k"), "_to").agg(F.map_from_entries(F.collect_list(F.struct("_sub", "_c"))).alias("_carry"))
    # running sums first: the join then finds the rows as they were dealt and sorted for them
    sub = Window.partitionBy(key, "_blk", "_sub").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_s_{name}": F.sum(_weighted(x, alpha, adjust, B)).over(sub) for name, (x, alpha, adjust, _mp) in specs.items()})
    df = df.join(by_block, (F.col(key) == F.col("_k")) & (F.col("_blk") == F.col("_to")), "left")
    out = {}
    for name, (_x, alpha, adjust, mp) in specs.items():
        q = F.lit(1.0 - alpha)
        y = F.pow(q, r) * F.col(f"_s_{name}") + F.coalesce(F.try_element_at("_carry", F.col("_sub"))[name], F.lit(0.0)) * F.pow(q, r + 1)
        if adjust:
            y = y * F.lit(alpha) / (F.lit(1.0) - F.pow(q, F.col("i") + 1))
        if mp > 1:
            y = F.when(F.col("i") >= mp - 1, y)
        out[name] = y
    return df.withColumns(out).drop("_k", "_to", "_carry", "_sub", *[f"_s_{name}" for name in specs])


def ema_of_ema(outer_of_x: Column, inner: Column, outer_alpha: float, inner_alpha: float) -> Column:
    """The EMA at ``outer_alpha`` of ``inner``, which is x's EMA at ``inner_alpha``; ``outer_of_x`` is x's own EMA at ``outer_alpha``.

    All are recursive and seeded with their first value, which is a constant history: then the two filters in a
    row are a weighted difference of the two alone (partial fractions), row by row.
    """
    p, q = 1.0 - outer_alpha, 1.0 - inner_alpha
    if p == q:
        raise ValueError("equal rates have no such form")
    return outer_of_x * F.lit(inner_alpha * p / (p - q)) - inner * F.lit(outer_alpha * q / (p - q))
