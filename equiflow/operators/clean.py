"""Statement-level cleaning and reshaping.

The pivot always receives its value list, so there is no extra job to find the
distinct metrics and the output schema does not depend on the data.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three statement kinds.
STATEMENTS = ("income", "balance", "cash")


def normalize_name(c: Column) -> Column:
    """P08 on long data: strip -> ' ' to '_' -> drop ``[^\\w_]`` (Unicode ``\\w``, Q31)."""
    stripped = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, " ", "_"), r"(?U)[^\w_]", "")


def normalize_names(df: DataFrame) -> DataFrame:
    """P08 on wide data: rename columns; duplicate names after normalisation are an error."""
    names = [re.sub(r"[^\w_]", "", c.strip().replace(" ", "_")) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate column names after normalisation: {names}")
    return df.toDF(*names)


def pivot_statement(long: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """Long (key, metric, value) -> one column per metric, explicit value list; of a repeated cell the greatest value."""
    return long.groupBy(*keys).pivot("metric", metrics).agg(F.max("value"))


def unpivot_statement(wide: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("ticker", "dt")) -> DataFrame:
    """Wide -> long, NULL cells dropped."""
    return wide.unpivot(list(keys), metrics, "metric", "value").where(F.col("value").isNotNull())


def complete_tickers(statements: DataFrame, kinds: tuple[str, ...] = STATEMENTS) -> DataFrame:
    """Tickers that have every statement kind with at least one row."""
    return (statements.where(F.col("statement").isin(*kinds)).groupBy("ticker")
            .agg(F.countDistinct("statement").alias("_n")).where(F.col("_n") == len(kinds)).select("ticker"))


def missing_statements(universe: DataFrame, statements: DataFrame, kinds: tuple[str, ...] = STATEMENTS) -> DataFrame:
    """(ticker, statement) pairs of the universe with no statement rows (anti join)."""
    wanted = universe.select("ticker", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("statement"))
    present = statements.select("ticker", "statement").distinct()
    return wanted.join(present, ["ticker", "statement"], "left_anti")


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """P10: lenient numeric parse, unparsable -> NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def select_available(df: DataFrame, cols: list[str]) -> DataFrame:
    """Project only the wanted columns that exist."""
    return df.select(*[c for c in cols if c in df.columns])


def select_matching(df: DataFrame, patterns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Keep columns whose name contains any pattern (case-insensitive)."""
    rx = re.compile("|".join(re.escape(p) for p in patterns), re.I)
    return df.select(*(keep or []), *[c for c in df.columns if rx.search(c) and c not in (keep or [])])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One aggregate pass of non-NULL counts, then drop the columns that are all NULL.

    Only the per-column counts (one row) reach the driver.
    """
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def standardize_date(df: DataFrame, out: str = "dt") -> DataFrame:
    """Rename the first column with 'date' in its name (any case) to ``out``, as a date; values that are none become NULL.

    Error when no column has such a name.
    """
    found = [c for c in df.columns if "date" in c.lower()]
    if not found:
        raise ValueError(f"no date column among {df.columns}")
    c = F.col(found[0])
    value = F.try_to_date(c) if df.schema[found[0]].dataType.typeName() == "string" else c.cast("date")
    return df.select(*[value.alias(out) if x == found[0] else F.col(x) for x in df.columns if x == found[0] or x != out])


def positional_slice(df: DataFrame, order: str, min_row: int, max_col: int) -> DataFrame:
    """Rows from position ``min_row`` (1-based, by ``order``) and the first ``max_col`` columns."""
    from equiflow.operators.screening import with_row_id
    cols = df.columns[:max_col]
    return with_row_id(df, order).where(F.col("row_id") >= min_row - 1).select(*cols)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Result frames one under the other by column name; a column that a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Per-row failure isolation: (valid, rejects) by a predicate; bad rows never stop the job."""
    ok = F.coalesce(rule, F.lit(False))
    return df.where(ok), df.where(~ok)


def rows_from_map(df: DataFrame, map_col: str, key: str = "ticker") -> DataFrame:
    """A map of key -> row struct (dict of dicts) to one row per key."""
    return df.select(F.explode(F.col(map_col)).alias(key, "_row")).select(key, "_row.*")
