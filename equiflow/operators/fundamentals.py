"""Three-statement merge and the eleven fundamental ratios.

The statements are joined on the real period date per ticker (full outer), so
periods missing from one statement survive with NULLs.  All three inputs are
keyed by ``(ticker, dt)``; the two joins share one hash partitioning on those
keys, so the merge costs one exchange per input and none after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from equiflow.functions.safe import div

KEYS = ("ticker", "dt")

# The metric names every ratio needs (back-filled with NULL when absent).
ESSENTIAL_METRICS = (
    "operating_cash_flow", "capital_expenditure", "net_income_common_stockholders", "total_revenue",
    "operating_income", "gross_profit", "total_assets", "stockholders_equity",
    "current_assets", "current_liabilities", "inventory", "total_debt",
    "cash_and_cash_equivalents", "ordinary_shares_number", "ebitda",
    "interest_expense", "tax_provision", "pretax_income",
)

RATIO_COLUMNS = (
    "net_profit_margin", "operating_margin", "gross_margin", "roa", "roe", "current_ratio",
    "quick_ratio", "debt_to_equity", "debt_to_assets", "operating_cash_flow_ratio", "free_cash_flow",
)


def suffix_join(left: DataFrame, right: DataFrame, on: list[str] | tuple[str, ...], how: str = "inner",
                suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Join, renaming only colliding non-key columns with pandas-style suffixes."""
    on = list(on)
    clash = (set(left.columns) & set(right.columns)) - set(on)
    lx = left.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns])
    ry = right.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns])
    return lx.join(ry, on=on, how=how)


def merge_statements(income: DataFrame, balance: DataFrame, cash: DataFrame,
                     keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Three-way full outer equi-join on (ticker, period)."""
    return reduce(lambda a, b: suffix_join(a, b, keys, "full"), [income, balance, cash])


def zero_to_null(df: DataFrame, exclude: tuple[str, ...] = KEYS) -> DataFrame:
    """Every numeric 0 becomes NULL (numerators included), in one projection."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}
    return df.select(*[
        F.when(F.col(c) != F.lit(0), F.col(c)).alias(c) if c in numeric and c not in exclude else F.col(c)
        for c in df.columns
    ])


def ensure_columns(df: DataFrame, cols: tuple[str, ...] = ESSENTIAL_METRICS) -> DataFrame:
    """Add missing columns as DOUBLE NULL."""
    missing = {c: F.lit(None).cast("double") for c in cols if c not in df.columns}
    return df.withColumns(missing) if missing else df


def ratios(df: DataFrame) -> DataFrame:
    """R01-R11 on a merged, zero-cleaned frame (full precision; round only for presentation)."""
    c = F.col
    r = {
        "net_profit_margin": div("net_income_common_stockholders", "total_revenue"),
        "operating_margin": div("operating_income", "total_revenue"),
        "gross_margin": div("gross_profit", "total_revenue"),
        "roa": div("net_income_common_stockholders", "total_assets"),
        "roe": div("net_income_common_stockholders", "stockholders_equity"),
        "current_ratio": div("current_assets", "current_liabilities"),
        "quick_ratio": div(c("current_assets") - c("inventory"), "current_liabilities"),
        "debt_to_equity": div("total_debt", "stockholders_equity"),
        "debt_to_assets": div("total_debt", "total_assets"),
        "operating_cash_flow_ratio": div("operating_cash_flow", "current_liabilities"),
    }
    r["free_cash_flow"] = c("operating_cash_flow") - c("capital_expenditure")
    return df.withColumns(r)


def fundamentals(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Merged statements + all eleven ratios, one row per (ticker, period)."""
    merged = zero_to_null(merge_statements(income, balance, cash))
    return ratios(ensure_columns(merged))
