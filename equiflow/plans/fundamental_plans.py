"""Registered queries: statements, ratios, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.operators.fundamentals import RATIO_COLUMNS, fundamentals
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.sources import fixtures as fx


def fundamental_ratios(spark: SparkSession, sf: str) -> DataFrame:
    b = fx.base(spark, sf)
    f = fundamentals(fx.income(spark, sf, b), fx.balance(spark, sf, b), fx.cashflow(spark, sf, b))
    return f.select("ticker", "dt", *[F.round(c, 2 if c == "free_cash_flow" else 6).alias(c) for c in RATIO_COLUMNS])


QUERIES = {
    "fundamental_ratios": fundamental_ratios,
}

_MERGED = """m AS (
SELECT * FROM v_income FULL JOIN v_balance USING (ticker, dt) FULL JOIN v_cashflow USING (ticker, dt))"""

ORACLE = {
    "fundamental_ratios": with_fixtures(["v_income", "v_balance", "v_cashflow"], _MERGED, body="""
SELECT ticker, dt,
  ROUND(NULLIF(net_income_common_stockholders, 0) / NULLIF(total_revenue, 0), 6) AS net_profit_margin,
  ROUND(NULLIF(operating_income, 0) / NULLIF(total_revenue, 0), 6) AS operating_margin,
  ROUND(NULLIF(gross_profit, 0) / NULLIF(total_revenue, 0), 6) AS gross_margin,
  ROUND(NULLIF(net_income_common_stockholders, 0) / NULLIF(total_assets, 0), 6) AS roa,
  ROUND(NULLIF(net_income_common_stockholders, 0) / NULLIF(stockholders_equity, 0), 6) AS roe,
  ROUND(NULLIF(current_assets, 0) / NULLIF(current_liabilities, 0), 6) AS current_ratio,
  ROUND((NULLIF(current_assets, 0) - NULLIF(inventory, 0)) / NULLIF(current_liabilities, 0), 6) AS quick_ratio,
  ROUND(NULLIF(total_debt, 0) / NULLIF(stockholders_equity, 0), 6) AS debt_to_equity,
  ROUND(NULLIF(total_debt, 0) / NULLIF(total_assets, 0), 6) AS debt_to_assets,
  ROUND(NULLIF(operating_cash_flow, 0) / NULLIF(current_liabilities, 0), 6) AS operating_cash_flow_ratio,
  ROUND(NULLIF(operating_cash_flow, 0) - NULLIF(capital_expenditure, 0), 2) AS free_cash_flow
FROM m"""),
}
