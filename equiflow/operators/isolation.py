"""Failure isolation by ticker (S10): one bad input row takes its ticker out of the whole run, and no other."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Rows of ``table`` for which ``broken`` holds (NULL does not) spoil their key; ``order`` names the column that tells the first."""

    name: str
    table: DataFrame
    broken: Column
    order: str | None = None


def broken_keys(rules: list[Rule], key: str = "ticker") -> DataFrame:
    """``key, rule, first_bad``: one row per spoilt key, with the first rule (as listed) it breaks and the least ``order``
    value of the rows that break it, as text.

    One partial aggregate over the spoilt rows; a NULL key cannot be left out by name and is reported as one key.
    """
    found = [r.table.where(r.broken).select(F.col(key).alias("k"), F.struct(F.lit(n).alias("n"), F.lit(r.name).alias("rule"), (F.col(r.order) if r.order else F.lit(None)).cast("string").alias("first_bad")).alias("bad"))
             for n, r in enumerate(rules)]
    least = reduce(DataFrame.unionByName, found).groupBy("k").agg(F.min("bad").alias("bad"))
    return least.select(F.col("k").alias(key), "bad.rule", "bad.first_bad")


def without(df: DataFrame, broken: DataFrame, key: str = "ticker") -> DataFrame:
    """``df`` without the rows of spoilt keys (a NULL key among them)."""
    gone = broken.select(F.col(key).alias("_gone"))
    return df.join(gone, F.col(key).eqNullSafe(F.col("_gone")), "left_anti")
