"""As-of attachment (J04): each left row gets the newest right row of its key whose time is not after its own.

No range join and no window over a whole key:

1. both sides are put in one frame, cut into (key, time block); in a block, the newest right row up to a left row is a
   running window;
2. the newest right row of each block is a partial aggregate, and the newest before a block a window over the blocks of a
   key (as many rows as the key's time span has blocks);
3. left rows without a right row in their own block take the one carried into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_block(t: Column) -> Column:
    return F.trunc(t, "month")


def asof_join(left: DataFrame, right: DataFrame, key: str = "ticker", time: str = "dt", values: list[str] | None = None,
              tie: str | None = None, block=month_block, right_time: str = "asof_dt") -> DataFrame:
    """``left`` with ``right_time`` and the columns ``values`` of the newest right row at or before ``time``.

    NULL where there is none, and for left rows without key or time.  Of right rows with the same key and time the one
    with the greatest ``tie`` counts (without one, the greatest of ``values`` taken in order).  ``block`` maps a time to a
    coarser one that keeps its order; finer blocks spread a hot key over more tasks.
    """
    values = values or [c for c in right.columns if c not in (key, time, tie)]
    clash = {c.lower() for c in left.columns} & {c.lower() for c in [*values, right_time]}
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    found = F.struct(F.col(time).alias("t"), *([F.col(tie).alias("tie")] if tie else []), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    lefts = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.struct(*left.columns).alias("l"))
    rights = right.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).alias("t"), found.alias("r"))
    nowhere = F.col("k").isNull() | F.col("t").isNull()  # such rows have no place in a series; they are spread
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumns({"b": block(F.col("t")), "s": F.when(nowhere, F.pmod(F.xxhash64("l"), F.lit(1024))).otherwise(F.lit(0))})
    # a right row counts for left rows of its own time, so it comes first
    run = Window.partitionBy("k", "b", "s").orderBy("t", F.col("l").isNotNull(), "r")
    seen = both.withColumn("own", F.last("r", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0))).where("l IS NOT NULL")
    newest = rights.groupBy("k", block(F.col("t")).alias("b")).agg(F.max("r").alias("r"))
    # a block's rows look at the newest of the blocks before it: list the blocks of both sides once
    blocks = lefts.where("k IS NOT NULL AND t IS NOT NULL").select("k", block(F.col("t")).alias("b")).distinct()
    spans = blocks.join(newest, ["k", "b"], "full").select("k", "b", "r")
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("k").alias("ck"), F.col("b").alias("cb"), F.last("r", ignorenulls=True).over(before).alias("carried"))
    out = seen.join(carried, (F.col("k") == F.col("ck")) & (F.col("b") == F.col("cb")), "left").withColumn("f", F.coalesce("own", "carried"))
    out = out.withColumn("f", F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.col("f")))
    return out.select("l.*", F.col("f.t").alias(right_time), *[F.col(f"f.v{i}").alias(c) for i, c in enumerate(values)])
