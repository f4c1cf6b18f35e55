"""Dense numbers over a whole frame in a given order, without a task that holds all rows or all rows of one value.

1. Rows are dealt by ranges of the order columns (sampled splitters), sorted inside each range and written below the
   shared scratch folder, each row with its place (range, position).
2. Rows are counted per range: a table as long as the number of ranges, whose running total gives each range its offset.
3. A row's number is its range's offset plus its position.

The written table is what both the counts and the numbers are read from, so a lost executor changes neither.
Ranges keep equal order values together: where one value may hold a large share of the rows, end the order with
columns that tell its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiflow.session import scratch_folder

_PLACE = 33  # bits of a position in monotonically_increasing_id


def numbered(df: DataFrame, order: list[str | Column], out: str = "row_id", start: int = 0, parts: int | None = None) -> DataFrame:
    """``df`` with ``out``: ``start``, ``start + 1``, ... in the given order (runs one write of ``df``)."""
    spark = df.sparkSession
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = "__place"
    while at in (c.lower() for c in df.columns):
        at += "_"
    sorted_ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    folder = scratch_folder(spark, "numbered")
    sorted_ranges.write.parquet(folder)
    rows = spark.read.schema(sorted_ranges.schema).parquet(folder)
    part, off = F.shiftright(at, _PLACE), f"{at}_off"
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(off))
    offsets = offsets.withColumnRenamed("part", f"{at}_part")
    place = F.col(at).bitwiseAND(F.lit((1 << _PLACE) - 1))
    return rows.join(F.broadcast(offsets), part == F.col(f"{at}_part")).withColumn(out, (F.col(off) + place + start).cast("long")).drop(at, off, f"{at}_part")
