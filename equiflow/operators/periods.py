"""Per-ticker period selection and period-over-period measures.

Statement data has one row per (ticker, fiscal period), so a ticker's history
is bounded by its number of periods (tens of rows).  Per-ticker windows here
are therefore small; the latest row is still taken with a partial aggregate
(``max_by``) rather than a whole-ticker sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiflow.functions.safe import div


def latest(df: DataFrame, key: str = "ticker", order: str = "dt") -> DataFrame:
    """The newest row per key (``iloc[-1]``), as a map-side-combinable aggregate."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
            .select(key, "_r.*"))


def last_n(df: DataFrame, n: int, key: str = "ticker", order: str = "dt") -> DataFrame:
    """The last ``n`` rows per key (``tail(n)``), with ``rn`` = 1 for the newest."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def nth_of_last(df: DataFrame, n: int = 4, k: int = 1, key: str = "ticker", order: str = "dt") -> DataFrame:
    """The k-th oldest of the last ``n`` rows (``tail(n).iloc[k-1]``)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    cnt = F.count(F.lit(1)).over(Window.partitionBy(key))
    return (df.withColumns({"_rn": F.row_number().over(w), "_cnt": cnt})
            .where(F.col("_rn") == F.least(F.lit(n), F.col("_cnt")) - (k - 1))
            .drop("_rn", "_cnt"))


def pick_period(df: DataFrame, pick: str = "latest", key: str = "ticker", order: str = "dt") -> DataFrame:
    """Q2/Q3: 'latest' (true newest) or 'first_of_last_4' (what ``tail(4).iloc[0]`` returns)."""
    if pick == "latest":
        return latest(df, key, order)
    if pick == "first_of_last_4":
        return nth_of_last(df, 4, 1, key, order)
    raise ValueError(f"unknown pick {pick!r}")


def growth(x: Column, prev: Column) -> Column:
    """Period growth ``(x - prev) / |prev|``; NULL when prev is 0 or NULL."""
    return div(x - prev, F.abs(prev))


def with_growth(df: DataFrame, col: str, out: str | None = None, key: str | list[str] = "ticker",
                order: str = "dt") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out or f"{col}_growth", growth(F.col(col), F.lag(col).over(w)))


def avg_growth(df: DataFrame, col: str, key: str | list[str] = "ticker", order: str = "dt") -> DataFrame:
    """Mean period growth of ``col`` over its non-NULL history; NULL with fewer than 2 points.

    Returns ``key, n_points, last_value, avg_growth``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    pts = df.where(F.col(col).isNotNull())
    g = with_growth(pts, col, "_g", keys, order)
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.max_by(F.col(col), F.col(order)).alias("last_value"),
        F.avg("_g").alias("avg_growth"),
    ).withColumn("avg_growth", F.when(F.col("n_points") >= 2, F.col("avg_growth")))


def nwc(df: DataFrame) -> Column:
    """Net working capital: (current assets - cash) - (current liabilities - short-term debt)."""
    c = F.col
    return (c("current_assets") - c("cash_and_cash_equivalents")) - (c("current_liabilities") - c("current_debt"))


def delta_nwc(df: DataFrame, key: str = "ticker", order: str = "dt") -> DataFrame:
    """NWC and its change from the previous period."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("nwc", nwc(df)).withColumn("delta_nwc", F.col("nwc") - F.lag("nwc").over(w))


def avg_cost_of_debt(df: DataFrame, n: int = 3, key: str = "ticker", order: str = "dt") -> DataFrame:
    """Average total debt of the last ``n`` periods and latest interest / that average."""
    tail = last_n(df, n, key, order)
    return tail.groupBy(key).agg(
        F.avg("total_debt").alias("avg_total_debt"),
        F.max_by(F.col("interest_expense"), F.col(order)).alias("interest_expense"),
    ).withColumn("cost_of_debt", div("interest_expense", "avg_total_debt"))


def smoothed(df: DataFrame, col: str, n: int = 3, key: str = "ticker", order: str = "dt") -> DataFrame:
    """Mean of the last ``n`` non-NULL values of ``col`` (smoothing an erratic driver)."""
    tail = last_n(df.where(F.col(col).isNotNull()), n, key, order)
    return tail.groupBy(key).agg(F.avg(col).alias("smoothed"), F.count(F.lit(1)).alias("n_points"))
