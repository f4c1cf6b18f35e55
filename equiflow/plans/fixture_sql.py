"""The fixture views of FIXTURES.md §2 as SQL CTEs for the DuckDB oracle.

``oracle_sql()`` strings cannot create views, so each oracle query is
``WITH <needed fixture CTEs>, <query CTEs> SELECT ...``.  ``ctes(...)``
returns the CTE list for the named fixtures plus everything they depend on,
in dependency order.
"""

from __future__ import annotations

# The fixture definitions of FIXTURES.md §2, as given.
_CTE = {
    "v_prices": """v_prices AS (
SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS dt,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / SUM(l_quantity) AS close,
  MAX(l_extendedprice / l_quantity) AS high, MIN(l_extendedprice / l_quantity) AS low,
  SUM(l_quantity) AS volume
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE))""",
    "v_base": """v_base AS (
SELECT l_suppkey AS ticker, YEAR(l_shipdate) AS fy,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS rev,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS tax,
  CAST(SUM(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS qty,
  CAST(COUNT(*) AS DOUBLE) AS n
FROM lineitem GROUP BY l_suppkey, YEAR(l_shipdate))""",
    "v_income": """v_income AS (
SELECT ticker, MAKE_DATE(fy, 12, 31) AS dt, rev AS total_revenue, rev * 0.45 AS gross_profit,
  rev * 0.25 AS operating_income, CASE WHEN ticker % 6 = 0 THEN NULL ELSE rev * 0.26 END AS ebit,
  rev * 0.30 AS ebitda, n * 100.0 AS interest_expense, tax AS tax_provision,
  CASE WHEN ticker % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE rev * 0.22 END AS pretax_income,
  rev * 0.22 - tax AS net_income_common_stockholders
FROM v_base WHERE (ticker + fy) % 17 <> 0)""",
    "v_balance": """v_balance AS (
SELECT ticker, MAKE_DATE(fy, 12, 31) AS dt, rev * 2.0 AS total_assets, rev * 0.8 AS stockholders_equity,
  rev * 0.5 AS current_assets, rev * 0.3 AS current_liabilities,
  CASE WHEN ticker % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE qty * 50.0 END AS inventory,
  CASE WHEN ticker % 10 = 3 THEN CAST(0 AS DOUBLE) ELSE n * 2000.0 END AS total_debt,
  qty * 20.0 AS cash_and_cash_equivalents, n * 1500.0 AS net_debt, n * 300.0 AS current_debt,
  CAST(1000 + ticker AS DOUBLE) AS ordinary_shares_number
FROM v_base WHERE (ticker + fy) % 19 <> 0)""",
    "v_cashflow": """v_cashflow AS (
SELECT ticker, MAKE_DATE(fy, 12, 31) AS dt, rev * 0.28 AS operating_cash_flow, qty * 60.0 AS capital_expenditure,
  n * 900.0 AS depreciation_and_amortization, (qty - 1500.0) * 10.0 AS change_in_working_capital
FROM v_base WHERE (ticker + fy) % 23 <> 0)""",
    "v_statements": """v_statements AS (
SELECT ticker, 'income' AS statement, dt, ' Total Revenue ' AS metric, total_revenue AS value FROM v_income WHERE ticker % 29 <> 1
UNION ALL SELECT ticker, 'income', dt, 'Pretax Income', pretax_income FROM v_income WHERE ticker % 29 <> 1
UNION ALL SELECT ticker, 'balance', dt, 'Total Assets', total_assets FROM v_balance WHERE ticker % 31 <> 2
UNION ALL SELECT ticker, 'balance', dt, 'Total Debt', total_debt FROM v_balance WHERE ticker % 31 <> 2
UNION ALL SELECT ticker, 'cash', dt, 'Operating Cash Flow', operating_cash_flow FROM v_cashflow)""",
    "v_info": """v_info AS (
SELECT s.s_suppkey AS ticker, s.s_name AS name, r.r_name AS sector, n.n_name AS industry,
  s.s_acctbal * 1000.0 AS market_cap,
  CASE WHEN s.s_suppkey % 7 = 0 THEN CAST(NULL AS DOUBLE) WHEN s.s_suppkey % 5 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(5 + s.s_suppkey % 20 AS DOUBLE) / 10.0 END AS beta,
  CASE WHEN s.s_suppkey % 8 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(1000 + s.s_suppkey * 10 AS DOUBLE) END AS shares_outstanding
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "v_company": """v_company AS (
SELECT ticker, name, sector, industry, COALESCE(printf('%.2f', market_cap), 'N/A') AS market_cap,
  CASE WHEN ticker % 4 <> 0 AND market_cap > 0 THEN printf('%.2f', market_cap / 100000.0) ELSE 'N/A' END AS trailing_pe,
  CASE WHEN ticker % 3 = 0 THEN printf('%.2f', CAST(ticker % 5 AS DOUBLE) / 100.0) ELSE 'N/A' END AS dividend_yield,
  CASE WHEN ticker % 5 <> 1 THEN printf('%.2f', CAST(ticker % 30 AS DOUBLE) / 100.0) ELSE 'N/A' END AS profit_margin,
  COALESCE(printf('%.2f', beta), 'N/A') AS beta FROM v_info)""",
    "v_universe": """v_universe AS (
SELECT CASE WHEN s_suppkey % 2 = 0 THEN CHR(CAST(65 + s_suppkey % 11 AS INT)) || CHR(CAST(75 + s_suppkey % 11 AS INT))
  ELSE CHR(CAST(65 + s_suppkey % 5 AS INT)) || 'Q' END AS symbol, MIN(s_name) AS name FROM supplier GROUP BY 1)""",
    "v_scores": """v_scores AS (
SELECT ticker, name, sector, CAST(ticker % 6 AS INT) AS ethics_score, CAST((ticker * 7) % 6 AS INT) AS volatility_score,
  CAST((ticker * 11) % 6 AS INT) AS growth_score
FROM v_info)""",
    "v_replies": """v_replies AS (
SELECT o_custkey % 25 AS request_id, o_orderkey AS reply_id,
  CONCAT('Here is the table', CHR(10), '| Symbol | Company Name | Rationale |', CHR(10), '|--------|------|------|', CHR(10),
   '| ', CHR(CAST(65 + o_orderkey % 11 AS INT)), CHR(CAST(75 + o_orderkey % 11 AS INT)), CASE WHEN o_orderkey % 13 = 5 THEN ' | Co A |' WHEN o_orderkey % 13 = 7 THEN ' | Co' || CHR(160) || 'A' || CHR(160) || '| ' || CHR(160) || ' |'
    ELSE ' | Co A | . low beta |' END, CHR(10), '|  |  | . cash |', CHR(10),
   '| ', CHR(CAST(65 + o_custkey % 7 AS INT)), 'Q | Co B | . growth |', CHR(10), ' | ZZ | indented | . no |') AS text
FROM orders)""",
    "v_forecast_replies": """v_forecast_replies AS (
SELECT s_suppkey AS ticker, CASE WHEN s_suppkey % 12 = 0 THEN 'no forecast given' ELSE
  CONCAT('EBIT Growth Rate: ', CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE '' END, CAST(1 + s_suppkey % 9 AS VARCHAR(4)), '.5%', CHR(10), 'Forecast: [',
   CAST(100 + s_suppkey AS VARCHAR(9)), ', ', CAST(110 + s_suppkey AS VARCHAR(9)), '.25, ', CAST(121 + s_suppkey AS VARCHAR(9)), ',',
   CAST(133 + s_suppkey AS VARCHAR(9)), ', ', CAST(146 + s_suppkey AS VARCHAR(9)), ']') END AS text
FROM supplier)""",
    "v_number_replies": """v_number_replies AS (
SELECT s_suppkey AS ticker, CASE s_suppkey % 8 WHEN 0 THEN s_suppkey || '.5' WHEN 1 THEN '.' || s_suppkey WHEN 2 THEN '-' || s_suppkey || 'e-2'
  WHEN 3 THEN ' ' || CHR(10) || s_suppkey || ' ' || CHR(160) WHEN 4 THEN '+' || s_suppkey || '.'
  WHEN 5 THEN 'WACC for 2024: ' || s_suppkey || '%' WHEN 6 THEN s_suppkey || ',234.5' ELSE '' END AS text
FROM supplier)""",
    "v_chunks": """v_chunks AS (
SELECT conv_id AS request_id, turn AS seq, text AS response FROM conversations)""",
}

_DEPS = {
    "v_income": ["v_base"],
    "v_balance": ["v_base"],
    "v_cashflow": ["v_base"],
    "v_statements": ["v_income", "v_balance", "v_cashflow"],
    "v_scores": ["v_info"],
    "v_company": ["v_info"],
}


def ctes(*names: str) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return [_CTE[n] for n in order]


def with_fixtures(fixtures: list[str] | tuple[str, ...], *extra_ctes: str, body: str) -> str:
    """``WITH <fixture ctes>, <extra ctes> <body>``."""
    parts = ctes(*fixtures) + [e.strip() for e in extra_ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
