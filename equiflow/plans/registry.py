"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from equiflow.plans import clean_plans, fundamental_plans, io_plans, screening_plans, technical_plans, text_plans, valuation_plans

_MODULES = [fundamental_plans, technical_plans, valuation_plans, screening_plans, text_plans, io_plans, clean_plans]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        dup = set(out) & set(m.QUERIES)
        if dup:
            raise ValueError(f"duplicate query names {dup}")
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
