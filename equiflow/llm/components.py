"""Connected components of a table of links, as Spark joins (alternating large and small stars).

No list of a component's members is built: each round joins links with the
smallest neighbour of each node and keeps (node, smaller node) rows, and the
table is written to the checkpoint folder after each round.  Its rows are counted
then, and it goes on in no more partitions than so many rows need; with few
links that is one, and a round needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed


ROWS_PER_PARTITION = 200_000


def _star(links: DataFrame, parts: int) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(small, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(small.select("u", F.col("m").alias("v"))).coalesce(parts).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches; nodes without a link have no row."""
    now = checkpointed(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, parts = mark, -(-mark[0] // ROWS_PER_PARTITION)
        now = checkpointed(_star(now.coalesce(parts), parts))
