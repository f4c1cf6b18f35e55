"""Input shapes of the engine derived from the driver tables (FIXTURES.md §2).

A "ticker" is a supplier key, a trading day is a ship date and a fiscal year a
ship year.  Built with the DataFrame API (the DuckDB oracle builds the same
shapes independently in SQL).  Money sums go through DECIMAL and are cast to
DOUBLE once, so both engines agree bit for bit.  The modulo rules below are
part of the fixture definition: they punch holes (outer joins), zeros
(zero-to-null), NULLs (fallback chains) and negative market caps on purpose;
they never subset the data that a query scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.sources.tables import shared, table


def _dec(c: str, p: int = 14, s: int = 2) -> Column:
    return F.col(c).cast(f"decimal({p},{s})")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_prices: one close/high/low/volume row per (ticker, dt)."""
    li = table(spark, sf_dir, "lineitem")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("dt"))
        .agg(
            (F.sum(_dec("l_extendedprice")).cast("double") / F.sum("l_quantity")).alias("close"),
            F.max(unit).alias("high"),
            F.min(unit).alias("low"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_base: one row per (ticker, fiscal year) with revenue, tax, quantity, line count.

    Shared: the statements built from it use one scan and one exchange of the line items.
    """
    li = table(spark, sf_dir, "lineitem")
    return shared(
        li.groupBy(F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fy"))
        .agg(
            F.sum(_dec("l_extendedprice") * (F.lit(1) - _dec("l_discount", 4, 2))).cast("double").alias("rev"),
            F.sum(_dec("l_extendedprice") * _dec("l_tax", 4, 2)).cast("double").alias("tax"),
            F.sum(_dec("l_quantity")).cast("double").alias("qty"),
            F.count(F.lit(1)).cast("double").alias("n"),
        )
    )


def _period(b: DataFrame) -> Column:
    return F.make_date(F.col("fy"), F.lit(12), F.lit(31)).alias("dt")


def income(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = base(spark, sf_dir) if b is None else b
    t, rev = F.col("ticker"), F.col("rev")
    return b.where((t + F.col("fy")) % 17 != 0).select(
        "ticker", _period(b),
        rev.alias("total_revenue"),
        (rev * 0.45).alias("gross_profit"),
        (rev * 0.25).alias("operating_income"),
        F.when(t % 6 != 0, rev * 0.26).alias("ebit"),
        (rev * 0.30).alias("ebitda"),
        (F.col("n") * 100.0).alias("interest_expense"),
        F.col("tax").alias("tax_provision"),
        F.when(t % 13 == 0, F.lit(0.0)).otherwise(rev * 0.22).alias("pretax_income"),
        (rev * 0.22 - F.col("tax")).alias("net_income_common_stockholders"),
    )


def balance(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = base(spark, sf_dir) if b is None else b
    t, rev, n, qty = F.col("ticker"), F.col("rev"), F.col("n"), F.col("qty")
    return b.where((t + F.col("fy")) % 19 != 0).select(
        "ticker", _period(b),
        (rev * 2.0).alias("total_assets"),
        (rev * 0.8).alias("stockholders_equity"),
        (rev * 0.5).alias("current_assets"),
        (rev * 0.3).alias("current_liabilities"),
        F.when(t % 9 == 0, F.lit(0.0)).otherwise(qty * 50.0).alias("inventory"),
        F.when(t % 10 == 3, F.lit(0.0)).otherwise(n * 2000.0).alias("total_debt"),
        (qty * 20.0).alias("cash_and_cash_equivalents"),
        (n * 1500.0).alias("net_debt"),
        (n * 300.0).alias("current_debt"),
        (F.lit(1000) + t).cast("double").alias("ordinary_shares_number"),
    )


def cashflow(spark: SparkSession, sf_dir: str, b: DataFrame | None = None) -> DataFrame:
    b = base(spark, sf_dir) if b is None else b
    return b.where((F.col("ticker") + F.col("fy")) % 23 != 0).select(
        "ticker", _period(b),
        (F.col("rev") * 0.28).alias("operating_cash_flow"),
        (F.col("qty") * 60.0).alias("capital_expenditure"),
        (F.col("n") * 900.0).alias("depreciation_and_amortization"),
        ((F.col("qty") - 1500.0) * 10.0).alias("change_in_working_capital"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_statements: long form (ticker, statement, dt, metric, value)."""
    b = base(spark, sf_dir)
    inc, bal, cf = income(spark, sf_dir, b), balance(spark, sf_dir, b), cashflow(spark, sf_dir, b)

    def part(df: DataFrame, stmt: str, metric: str, c: str) -> DataFrame:
        return df.select("ticker", F.lit(stmt).alias("statement"), "dt",
                         F.lit(metric).alias("metric"), F.col(c).alias("value"))

    inc_ok = inc.where(F.col("ticker") % 29 != 1)
    bal_ok = bal.where(F.col("ticker") % 31 != 2)
    return (
        part(inc_ok, "income", " Total Revenue ", "total_revenue")
        .unionAll(part(inc_ok, "income", "Pretax Income", "pretax_income"))
        .unionAll(part(bal_ok, "balance", "Total Assets", "total_assets"))
        .unionAll(part(bal_ok, "balance", "Total Debt", "total_debt"))
        .unionAll(part(cf, "cash", "Operating Cash Flow", "operating_cash_flow"))
    )


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_info: one company/market-info row per ticker.

    nation (25 rows) and region (5 rows) are fixed-size TPC-H dimensions, so
    broadcasting them is bounded at any scale factor.
    """
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    dims = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                       .select("n_nationkey", "n_name", "r_name"))
    return s.join(dims, s.s_nationkey == dims.n_nationkey).select(
        k.alias("ticker"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("sector"),
        F.col("n_name").alias("industry"),
        (F.col("s_acctbal") * 1000.0).alias("market_cap"),
        F.when(k % 7 == 0, F.lit(None).cast("double"))
        .when(k % 5 == 0, F.lit(0.0))
        .otherwise((F.lit(5) + k % 20).cast("double") / 10.0).alias("beta"),
        F.when(k % 8 == 0, F.lit(None).cast("double"))
        .otherwise((F.lit(1000) + k * 10).cast("double")).alias("shares_outstanding"),
    )


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_company (S01): a company's profile fields as text, 'N/A' where the source has none."""
    i = info(spark, sf_dir)
    k = F.col("ticker")
    text = lambda c, form: F.coalesce(F.format_string(form, c), F.lit("N/A"))
    pe = F.when((k % 4 != 0) & (F.col("market_cap") > 0), F.col("market_cap") / 100000.0)
    dividend = F.when(k % 3 == 0, (k % 5).cast("double") / 100.0)
    margin = F.when(k % 5 != 1, (k % 30).cast("double") / 100.0)
    number = lambda c: F.when(c.isNull(), F.lit("N/A")).otherwise(text(c, "%.2f"))
    return i.select("ticker", "name", "sector", "industry", number(F.col("market_cap")).alias("market_cap"), number(pe).alias("trailing_pe"),
                    number(dividend).alias("dividend_yield"), number(margin).alias("profit_margin"), number(F.col("beta")).alias("beta"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_universe: symbol -> company name, one row per symbol; some symbols that replies name are not listed."""
    k = F.col("s_suppkey")
    even = F.concat(F.char((F.lit(65) + k % 11).cast("int")), F.char((F.lit(75) + k % 11).cast("int")))
    odd = F.concat(F.char((F.lit(65) + k % 5).cast("int")), F.lit("Q"))
    return table(spark, sf_dir, "supplier").groupBy(F.when(k % 2 == 0, even).otherwise(odd).alias("symbol")).agg(F.min("s_name").alias("name"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_scores: factor table (0..5 per factor)."""
    t = F.col("ticker")
    return info(spark, sf_dir).select(
        "ticker", "name", "sector",
        (t % 6).cast("int").alias("ethics_score"),
        ((t * 7) % 6).cast("int").alias("volatility_score"),
        ((t * 11) % 6).cast("int").alias("growth_score"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_replies: one screening reply (pipe table in prose) per order."""
    o = table(spark, sf_dir, "orders")
    nl = F.lit("\n")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("Here is the table"), nl, F.lit("| Symbol | Company Name | Rationale |"), nl,
        F.lit("|--------|------|------|"), nl,
        F.lit("| "), F.char((F.lit(65) + ok % 11).cast("int")), F.char((F.lit(75) + ok % 11).cast("int")),
        # a first body row with a cell missing, or one that only a no-break space fills
        F.when(ok % 13 == 5, " | Co A |").when(ok % 13 == 7, " | Co\u00a0A\u00a0| \u00a0 |").otherwise(" | Co A | . low beta |"),
        nl, F.lit("|  |  | . cash |"), nl,
        F.lit("| "), F.char((F.lit(65) + ck % 7).cast("int")), F.lit("Q | Co B | . growth |"), nl,
        F.lit(" | ZZ | indented | . no |"),
    )
    return o.select((ck % 25).alias("request_id"), ok.alias("reply_id"), text.alias("text"))


def forecast_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_forecast_replies: driver forecast replies, some without a list, some negative."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")

    def v(off: int) -> Column:
        return (F.lit(off) + k).cast("string")

    text = F.concat(
        F.lit("EBIT Growth Rate: "), F.when(k % 5 == 0, F.lit("-")).otherwise(F.lit("")),
        (F.lit(1) + k % 9).cast("string"), F.lit(".5%"), F.lit("\n"), F.lit("Forecast: ["),
        v(100), F.lit(", "), v(110), F.lit(".25, "), v(121), F.lit(","), v(133), F.lit(", "), v(146), F.lit("]"),
    )
    return s.select(k.alias("ticker"),
                    F.when(k % 12 == 0, F.lit("no forecast given")).otherwise(text).alias("text"))


def number_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_number_replies: replies that should be one number; some are, in several notations, some are not."""
    s = table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    forms = [F.concat(n, F.lit(".5")), F.concat(F.lit("."), n), F.concat(F.lit("-"), n, F.lit("e-2")), F.concat(F.lit(" \n"), n, F.lit(" \u00a0")), F.concat(F.lit("+"), n, F.lit(".")),
             F.concat(F.lit("WACC for 2024: "), n, F.lit("%")), F.concat(n, F.lit(",234.5")), F.lit("")]
    text = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return s.select(k.alias("ticker"), text.alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_chunks: ordered reply chunks."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"),
                    F.col("text").alias("response"))
