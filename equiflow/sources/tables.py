"""Readers for the landed parquet tables.

Only ``spark.read.parquet`` + ``select`` so that Catalyst prunes columns and
pushes filters into the scan; no schema inference passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """``df`` kept alike in every branch that uses it, so Spark plans its exchange once and reuses it.

    Without this each branch pushes its own filters and column list below the
    aggregate that ends ``df``, the subtrees differ, and the source is scanned
    once per branch.  The filter below is true for every row and names all
    columns; nothing is pushed through the row id.  Nothing is stored and nothing runs.
    """
    every = (F.col("_shared_row") >= 0) | (F.xxhash64(*df.columns) == 0)
    return df.withColumn("_shared_row", F.monotonically_increasing_id()).where(every).drop("_shared_row")
