"""Per-ticker row positions and row blocks for long series.

Rolling windows, lags and exponentially weighted means need the position of a
row inside its ticker's ordered series.  A plain ``row_number() over
(partition by ticker order by dt)`` puts a whole ticker into one task, which
does not survive a ticker holding a third of all rows.  Instead:

1. ``series_index``: count rows per (ticker, time bucket) with a partial
   aggregate (tiny output), turn the counts into starting offsets with a window
   over that small table, join them back (AQE turns the join into a broadcast
   when the measured offsets side is small) and number the rows inside each
   (ticker, bucket).  ``i`` is the 0-based global position.
2. ``with_blocks``: cut the series into blocks of ``block_rows`` positions and
   copy the last ``halo`` rows of each block into the next one, so every
   window of up to ``halo`` rows is complete inside one (ticker, block)
   partition.  The frame is dealt by ``(ticker, _blk)`` once; all later windows
   partition by ``(ticker, _blk[, ...])`` and need no further exchange.
3. ``drop_halo``: keep each row once, in its own block.

Rows with a NULL position column cannot be placed; callers split them off first
(``technical.quarantine``), ``series_index`` itself numbers them before all others.  A NULL key is no series: its
rows have no position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiflow.sources.tables import shared

BLOCK_ROWS = 16200


def order_bucket(df: DataFrame, col: str) -> Column:
    """A coarse order-keeping bucket of a column, from its value alone: at most some ten thousand of them.

    Numbers, dates and times: 64 buckets per power of two, either sign; text: its first two characters; NULL is NULL.
    """
    kind, c = df.schema[col].dataType.typeName(), F.col(col)
    if kind == "string":
        return F.substring(c, 1, 2)
    if kind == "date":
        c = F.datediff(c, F.lit("1970-01-01").cast("date"))
    elif kind.startswith("timestamp"):
        c = F.unix_micros(c.cast("timestamp"))
    x = c.cast("double")
    return F.signum(x) * F.floor(F.log2(F.abs(x) + 1) * 64)


def series_index(df: DataFrame, key: str = "ticker", order: str = "dt", bucket: Column | None = None,
                 out: str = "i") -> DataFrame:
    """Add the 0-based position ``out`` of each row in its key's series ordered by ``order``."""
    bucket = F.coalesce(F.trunc(F.col(order), "month"), F.lit("0001-01-01").cast("date")) if bucket is None else bucket
    b = shared(df.withColumn("_bucket", bucket))  # read once for the counts and the rows
    counts = b.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    rn = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(order))
    offsets = offsets.withColumnsRenamed({key: "_k", "_bucket": "_b"})
    same = (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b"))  # plain equality: the window needs no further deal
    return (b.join(offsets, same, "left")
            .withColumn(out, (F.col("_off") + rn - 1).cast("long"))
            .drop("_bucket", "_off", "_k", "_b"))


def with_blocks(df: DataFrame, halo: int, key: str = "ticker", i: str = "i",
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign rows to blocks ``_blk`` with a ``halo``-row lead-in copied from the previous block.

    Adds ``_blk``, ``_halo`` (copy from the previous block), ``j`` (position in
    the block partition, lead-in included) and ``_first`` (partition starts at
    the series start, so no lead-in truncation).
    """
    if halo > block_rows:
        raise ValueError("halo must not exceed block_rows")
    pos = F.col(i)
    own = F.floor(pos / block_rows).cast("long")
    tail = (pos % block_rows) >= (block_rows - halo)
    targets = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    start = F.greatest(F.col("_blk") * block_rows - halo, F.lit(0))
    return (df.withColumn("_blk", F.explode(targets))
            .withColumn("_halo", F.col("_blk") != own)
            .withColumn("j", pos - start)
            .withColumn("_first", F.col("_blk") == 0)
            .repartition(key, "_blk"))


def block_window(key: str = "ticker", order: str = "j") -> Window:
    return Window.partitionBy(key, "_blk").orderBy(order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_blk", "_halo", "j", "_first")
