"""Registered queries: periods, cost of capital, forecasts and DCF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.functions.safe import div
from equiflow.operators.asof import asof_join
from equiflow.operators import periods as P
from equiflow.operators import valuation as V
from equiflow.operators.fundamentals import fundamentals
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.sources import fixtures as fx


def _r(c, d: int, alias: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, d).alias(alias or (c if isinstance(c, str) else None))


def fund(spark: SparkSession, sf: str) -> DataFrame:
    """Merged statements + ratios, one row per (ticker, year).

    Lazy: the three statements come from one shared base, so however many branches
    use the frame the line items are scanned and dealt once.
    """
    b = fx.base(spark, sf)
    return fundamentals(fx.income(spark, sf, b), fx.balance(spark, sf, b), fx.cashflow(spark, sf, b))


def q_asof_fundamentals(spark, sf):
    """Every price row with the newest statement of its ticker at or before its date."""
    values = ["total_revenue", "ebit", "total_debt"]
    return asof_join(fx.prices(spark, sf).select("ticker", "dt", "close"), fund(spark, sf).select("ticker", "dt", *values), values=values, right_time="statement_dt")


def q_latest_period(spark, sf):
    return P.latest(fund(spark, sf)).select("ticker", "dt", "total_revenue", "total_debt", "ebitda")


def q_last_n_periods(spark, sf):
    return P.last_n(fund(spark, sf), 4).select("ticker", "dt", F.col("rn").cast("long").alias("rn"))


def q_first_of_last_4(spark, sf):
    return P.nth_of_last(fund(spark, sf), 4, 1).select("ticker", "dt")


def q_tax_rate(spark, sf):
    f = fund(spark, sf)
    a = V.tax_rate(f, "latest").withColumnRenamed("tax_rate", "tax_rate_latest")
    b = V.tax_rate(f, "latest", strict=True).withColumnRenamed("tax_rate", "tax_rate_strict")
    c = V.tax_rate(f, "first_of_last_4").withColumnRenamed("tax_rate", "tax_rate_first_of_last_4")
    return a.join(b, "ticker").join(c, "ticker").select(
        "ticker", _r("tax_rate_latest", 9), _r("tax_rate_strict", 9), _r("tax_rate_first_of_last_4", 9))


def q_net_debt_reported(spark, sf):
    f = fund(spark, sf)
    a = V.net_debt_reported(f, "latest").withColumnRenamed("net_debt", "net_debt_latest")
    b = V.net_debt_reported(f, "first_of_last_4").withColumnRenamed("net_debt", "net_debt_first_of_last_4")
    return a.join(b, "ticker")


def q_capital_base(spark, sf):
    lm = V.capital_base(V.attach_market(fund(spark, sf), fx.info(spark, sf)))
    return lm.select("ticker", _r("calc_net_debt", 2, "net_debt"), F.col("calc_shares").alias("shares_outstanding"))


def q_wacc(spark, sf):
    w = V.wacc(V.attach_market(fund(spark, sf), fx.info(spark, sf)))
    return w.select("ticker", "market_value_equity", "market_value_debt", _r("total_capital", 2),
                    F.col("wacc_beta").alias("beta"), _r("cost_of_equity", 9), _r("cost_of_debt", 9),
                    _r("corporate_tax_rate", 9), _r("wacc", 9))


def q_dcf_parameters(spark, sf):
    p = V.dcf_parameters(fund(spark, sf), fx.info(spark, sf))
    return p.select("ticker", "terminal_growth_rate", "exit_multiple", _r("wacc", 9), _r("net_debt", 2),
                    "shares_outstanding")


def q_avg_cost_of_debt(spark, sf):
    a = P.avg_cost_of_debt(fund(spark, sf), 3)
    return a.select("ticker", _r("avg_total_debt", 2), "interest_expense", _r("cost_of_debt", 9))


def q_delta_nwc(spark, sf):
    d = P.delta_nwc(fund(spark, sf))
    return d.select("ticker", "dt", _r("nwc", 2), _r("delta_nwc", 2))


def q_period_growth(spark, sf):
    g = P.with_growth(fund(spark, sf), "total_revenue", "revenue_growth")
    return g.select("ticker", "dt", "total_revenue", _r("revenue_growth", 9))


def q_avg_growth(spark, sf):
    g = P.avg_growth(fund(spark, sf), "free_cash_flow")
    return g.select("ticker", "n_points", "last_value", _r("avg_growth", 9))


def q_smoothed_forecast(spark, sf):
    s = P.smoothed(fund(spark, sf), "capital_expenditure", 3)
    out = s.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(V.HORIZON))))
    return out.select("ticker", F.col("step").cast("int").alias("step"), _r("smoothed", 2, "value"))


def q_growth_forecast(spark, sf):
    g = V.growth_forecast(V.driver_history(fund(spark, sf)))
    return g.select("ticker", "driver", "step", _r("value", 2))


def q_constant_forecast(spark, sf):
    return V.constant_forecast(V.driver_history(fund(spark, sf)))


def _run(f: DataFrame, info: DataFrame):
    params = V.dcf_parameters(f, info)
    drivers = V.zip_drivers(V.growth_forecast(V.driver_history(f)))
    yearly = V.dcf_yearly(drivers, params, V.tax_rate(f, "latest"))
    ebitda_g = P.avg_growth(f, "ebitda")
    return f, params, yearly, ebitda_g


def valuation_of(f: DataFrame, info: DataFrame) -> DataFrame:
    _, params, yearly, eg = _run(f, info)
    return V.valuation(yearly, params, eg)


def _pipeline(spark, sf):
    return _run(fund(spark, sf), fx.info(spark, sf))


def q_dcf_yearly(spark, sf):
    _, _, y, _ = _pipeline(spark, sf)
    return y.select("ticker", "step", "year", _r("ebit", 2), _r("tax_rate", 9), _r("d_and_a", 2), _r("capex", 2),
                    _r("wc_change", 2), _r("fcf", 2), _r("discounted_fcf", 2), _r("cumulative_pv", 2))


def _valuation(spark, sf):
    return valuation_of(fund(spark, sf), fx.info(spark, sf))


def q_terminal_values(spark, sf):
    v = _valuation(spark, sf)
    return v.select("ticker", _r("terminal_value_gordon", 2), _r("terminal_value_gordon_pv", 2),
                    _r("terminal_value_exit", 2), _r("terminal_value_exit_pv", 2), "wacc_le_g", "complete")


SUMMARY_DIGITS = {"wacc": 9, "implied_share_price": 4}


def q_dcf_summary(spark, sf):
    return V.dcf_summary(_valuation(spark, sf), SUMMARY_DIGITS)


def q_dcf_table(spark, sf):
    _, _, y, _ = _pipeline(spark, sf)
    return V.dcf_table(y)


SHEET_METRICS = (("NOPAT", "nopat"), ("D&A", "d_and_a"), ("CapEx", "capex"), ("Change in WC", "wc_change"),
                 ("FCF", "fcf"))


def q_dcf_sheet(spark, sf):
    """NOPAT .. FCF by year, then terminal value and share price in the last year column."""
    _, params, y, eg = _pipeline(spark, sf)
    y = y.withColumn("nopat", F.col("ebit") * (F.lit(1.0) - F.col("tax_rate")))
    body = V.dcf_table(y, SHEET_METRICS)
    v = V.valuation(y, params, eg)
    last = f"y{V.HORIZON}"
    tail = v.select("ticker", F.explode(F.array(
        F.struct(F.lit("Terminal Value").alias("metric"), F.round("terminal_value", 4).alias(last)),
        F.struct(F.lit("Implied Share Price").alias("metric"), F.round("implied_share_price", 4).alias(last)),
    )).alias("m")).select("ticker", "m.metric", *[F.lit(None).cast("double").alias(f"y{k}")
                                                  for k in range(1, V.HORIZON)], f"m.{last}")
    return body.unionByName(tail)


def q_simple_dcf(spark, sf):
    """Historic FCF (OCF - CapEx) grown at its average growth, 8 % discount, 2.5 % growth."""
    g = P.avg_growth(fund(spark, sf), "free_cash_flow")
    r, tg, n = V.SIMPLE_DISCOUNT, V.TERMINAL_GROWTH, V.HORIZON
    rate = F.coalesce(F.col("avg_growth"), F.lit(0.0))
    steps = g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    steps = steps.withColumn("fcf", F.col("last_value") * F.pow(F.lit(1.0) + rate, F.col("step")))
    agg = steps.groupBy("ticker").agg(
        F.sum(V.discount(F.col("fcf"), F.lit(r), F.col("step"))).alias("pv_fcf"),
        F.max_by(F.col("fcf"), F.col("step")).alias("fcf_last"))
    tv, tv_pv = V.terminal_gordon(F.col("fcf_last"), F.lit(tg), F.lit(r), F.lit(n))
    out = agg.withColumns({"terminal_value": tv, "terminal_value_pv": tv_pv})
    return out.select("ticker", _r("pv_fcf", 2), _r("terminal_value", 2),
                      _r(F.col("pv_fcf") + F.col("terminal_value_pv"), 2, "enterprise_value"))


def q_valuation_label(spark, sf):
    info = fx.info(spark, sf)
    price = div(F.when(F.col("market_cap") > 0, F.col("market_cap")), F.col("info_shares"))
    v = _valuation(spark, sf).join(info.select("ticker", "market_cap", F.col("shares_outstanding").alias("info_shares")),
                                   "ticker", "left")
    v = V.valuation_label(v.withColumn("market_price", price), F.col("market_price"))
    return v.select("ticker", _r("implied_share_price", 4), _r("market_price", 4), _r("upside", 6), "valuation")


QUERIES = {
    "asof_fundamentals": q_asof_fundamentals,
    "latest_period": q_latest_period,
    "last_n_periods": q_last_n_periods,
    "first_of_last_4": q_first_of_last_4,
    "tax_rate": q_tax_rate,
    "net_debt_reported": q_net_debt_reported,
    "capital_base": q_capital_base,
    "wacc": q_wacc,
    "dcf_parameters": q_dcf_parameters,
    "avg_cost_of_debt": q_avg_cost_of_debt,
    "delta_nwc": q_delta_nwc,
    "period_growth": q_period_growth,
    "avg_growth": q_avg_growth,
    "smoothed_forecast": q_smoothed_forecast,
    "growth_forecast": q_growth_forecast,
    "constant_forecast": q_constant_forecast,
    "dcf_yearly": q_dcf_yearly,
    "terminal_values": q_terminal_values,
    "dcf_summary": q_dcf_summary,
    "dcf_table": q_dcf_table,
    "dcf_sheet": q_dcf_sheet,
    "simple_dcf": q_simple_dcf,
    "valuation_label": q_valuation_label,
}

# ---------------------------------------------------------------- oracle ----

_NUM = ("total_revenue", "gross_profit", "operating_income", "ebit", "ebitda", "interest_expense", "tax_provision",
        "pretax_income", "net_income_common_stockholders", "total_assets", "stockholders_equity", "current_assets",
        "current_liabilities", "inventory", "total_debt", "cash_and_cash_equivalents", "net_debt", "current_debt",
        "ordinary_shares_number", "operating_cash_flow", "capital_expenditure", "depreciation_and_amortization",
        "change_in_working_capital")

_FX = ["v_income", "v_balance", "v_cashflow"]
_M = """m AS (SELECT * FROM v_income FULL JOIN v_balance USING (ticker, dt) FULL JOIN v_cashflow USING (ticker, dt))"""
_F = ("f AS (SELECT ticker, dt, " + ", ".join(f"NULLIF({c}, 0) AS {c}" for c in _NUM)
      + ", NULLIF(operating_cash_flow, 0) - NULLIF(capital_expenditure, 0) AS free_cash_flow FROM m)")
_RN = """fr AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn,
  COUNT(*) OVER (PARTITION BY ticker) AS cnt FROM f)"""
_LT = """lt AS (SELECT * FROM fr WHERE rn = 1)"""
_F4 = """f4 AS (SELECT * FROM fr WHERE rn = LEAST(4, cnt))"""
_LM = """lm AS (SELECT lt.*, i.market_cap, i.beta, i.shares_outstanding AS info_shares FROM lt LEFT JOIN v_info i USING (ticker))"""
_W = """w0 AS (SELECT *, CASE WHEN market_cap > 0 THEN market_cap END AS e, total_debt AS d,
  CASE WHEN beta IS NULL OR beta = 0 THEN CAST(1 AS DOUBLE) ELSE beta END AS b1,
  CASE WHEN total_debt IS NOT NULL AND total_debt > 0 AND interest_expense IS NOT NULL
       THEN interest_expense / total_debt ELSE 0.05 END AS rd1,
  CASE WHEN tax_provision / pretax_income IS NULL THEN 0.21
       WHEN tax_provision / pretax_income > 0 THEN LEAST(tax_provision / pretax_income, 0.25) ELSE 0 END AS tc1,
  CASE WHEN total_debt IS NOT NULL THEN total_debt - COALESCE(cash_and_cash_equivalents, 0) ELSE net_debt END AS nd1,
  COALESCE(info_shares, ordinary_shares_number) AS sh1
FROM lm),
w1 AS (SELECT *, e + d AS v FROM w0),
wc AS (SELECT ticker, dt, ebitda, e AS market_value_equity, d AS market_value_debt, v AS total_capital,
  CASE WHEN v > 0 THEN b1 END AS beta, CASE WHEN v > 0 THEN 0.045 + b1 * 0.055 END AS cost_of_equity,
  CASE WHEN v > 0 THEN rd1 END AS cost_of_debt, CASE WHEN v > 0 THEN tc1 END AS corporate_tax_rate,
  CASE WHEN v > 0 AND e IS NOT NULL AND d IS NOT NULL
       THEN (e / v) * (0.045 + b1 * 0.055) + (d / v) * rd1 * (1 - tc1) END AS wacc,
  nd1 AS net_debt, sh1 AS shares_outstanding
FROM w1)"""
_HIST = """hist AS (
SELECT ticker, dt, 'ebit' AS driver, COALESCE(ebit, operating_income) AS value FROM f
UNION ALL SELECT ticker, dt, 'capex', capital_expenditure FROM f
UNION ALL SELECT ticker, dt, 'd_and_a', depreciation_and_amortization FROM f
UNION ALL SELECT ticker, dt, 'wc_change', change_in_working_capital FROM f),
hg AS (SELECT *, (value - LAG(value) OVER w) / NULLIF(ABS(LAG(value) OVER w), 0) AS g
  FROM hist WHERE value IS NOT NULL WINDOW w AS (PARTITION BY ticker, driver ORDER BY dt)),
ag AS (SELECT ticker, driver, ARG_MAX(value, dt) AS last_value,
  CASE WHEN COUNT(*) >= 2 THEN AVG(g) END AS avg_growth FROM hg GROUP BY ticker, driver),
gf AS (SELECT ticker, driver, CAST(s.step AS INTEGER) AS step,
  last_value * POW(1 + COALESCE(avg_growth, 0), s.step) AS value
  FROM ag, generate_series(1, 5) AS s(step))"""
_Y = """zd AS (SELECT ticker, step,
  MAX(CASE WHEN driver = 'ebit' THEN value END) AS ebit, MAX(CASE WHEN driver = 'capex' THEN value END) AS capex,
  MAX(CASE WHEN driver = 'd_and_a' THEN value END) AS d_and_a,
  MAX(CASE WHEN driver = 'wc_change' THEN value END) AS wc_change
  FROM gf GROUP BY ticker, step),
tx AS (SELECT ticker, COALESCE(tax_provision / pretax_income, 0.2) AS tax_rate FROM lt),
y0 AS (SELECT zd.*, wc.wacc, CAST(YEAR(wc.dt) + zd.step AS INTEGER) AS year, tx.tax_rate,
  zd.ebit * (1 - tx.tax_rate) - zd.capex - zd.wc_change + zd.d_and_a AS fcf
  FROM zd JOIN wc USING (ticker) LEFT JOIN tx USING (ticker)
  WHERE zd.ebit IS NOT NULL AND zd.capex IS NOT NULL AND zd.d_and_a IS NOT NULL AND zd.wc_change IS NOT NULL),
y1 AS (SELECT *, fcf / POW(1 + wacc, step) AS discounted_fcf FROM y0),
yr AS (SELECT *, SUM(discounted_fcf) OVER (PARTITION BY ticker ORDER BY step ROWS UNBOUNDED PRECEDING) AS cumulative_pv
  FROM y1)"""
_EG = """eh AS (SELECT ticker, dt, ebitda AS x FROM f WHERE ebitda IS NOT NULL),
ehg AS (SELECT *, (x - LAG(x) OVER w) / NULLIF(ABS(LAG(x) OVER w), 0) AS g FROM eh
  WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
eg AS (SELECT ticker, CASE WHEN COUNT(*) >= 2 THEN AVG(g) END AS ebitda_growth FROM ehg GROUP BY ticker)"""
_VAL = """va AS (SELECT ticker, SUM(discounted_fcf) AS pv_sum, ARG_MAX(fcf, step) AS fcf_last, COUNT(*) AS n_years
  FROM yr GROUP BY ticker),
v0 AS (SELECT va.*, wc.wacc, wc.net_debt, wc.shares_outstanding, wc.ebitda, eg.ebitda_growth,
  CASE WHEN wc.wacc > 0.025 THEN va.fcf_last * (1 + 0.025) / (wc.wacc - 0.025) END AS tvg,
  wc.ebitda * POW(1 + COALESCE(eg.ebitda_growth, 0), 5) * 10.0 AS tvx
  FROM va JOIN wc USING (ticker) LEFT JOIN eg USING (ticker)),
v1 AS (SELECT *, tvg / POW(1 + wacc, 5) AS tvg_pv, tvx / POW(1 + wacc, 5) AS tvx_pv,
  COALESCE(tvg, tvx) AS terminal_value FROM v0),
v2 AS (SELECT *, COALESCE(tvg_pv, tvx_pv) AS terminal_value_pv FROM v1),
v3 AS (SELECT *, pv_sum + terminal_value_pv AS enterprise_value FROM v2),
val AS (SELECT *, enterprise_value - net_debt AS equity_value,
  (enterprise_value - net_debt) / NULLIF(shares_outstanding, 0) AS implied_share_price FROM v3)"""

_DCF = (_M, _F, _RN, _LT, _LM, _W, _HIST, _Y)
_DCFV = _DCF + (_EG, _VAL)


def _long(metrics, src: str, digits) -> str:
    return "\nUNION ALL ".join(
        f"SELECT ticker, '{label}' AS metric, ROUND({c}, {digits(c)}) AS value FROM {src}" for label, c in metrics)


_TABLE_SQL = "SELECT ticker, metric, " + ", ".join(
    f"ROUND(MAX(CASE WHEN step = {k} THEN value END), 4) AS y{k}" for k in range(1, 6))

ORACLE = {
    "asof_fundamentals": with_fixtures(["v_prices"] + _FX, _M, _F, body="""
SELECT p.ticker, p.dt, p.close, f.dt AS statement_dt, f.total_revenue, f.ebit, f.total_debt
FROM v_prices p ASOF LEFT JOIN f ON p.ticker = f.ticker AND p.dt >= f.dt"""),
    "latest_period": with_fixtures(_FX, _M, _F, _RN, _LT, body="""
SELECT ticker, dt, total_revenue, total_debt, ebitda FROM lt"""),
    "last_n_periods": with_fixtures(_FX, _M, _F, _RN, body="""SELECT ticker, dt, rn FROM fr WHERE rn <= 4"""),
    "first_of_last_4": with_fixtures(_FX, _M, _F, _RN, _F4, body="""SELECT ticker, dt FROM f4"""),
    "tax_rate": with_fixtures(_FX, _M, _F, _RN, _LT, _F4, body="""
SELECT lt.ticker, ROUND(COALESCE(lt.tax_provision / lt.pretax_income, 0.2), 9) AS tax_rate_latest,
  ROUND(lt.tax_provision / lt.pretax_income, 9) AS tax_rate_strict,
  ROUND(COALESCE(f4.tax_provision / f4.pretax_income, 0.2), 9) AS tax_rate_first_of_last_4
FROM lt JOIN f4 USING (ticker)"""),
    "net_debt_reported": with_fixtures(_FX, _M, _F, _RN, _LT, _F4, body="""
SELECT lt.ticker, lt.net_debt AS net_debt_latest, f4.net_debt AS net_debt_first_of_last_4
FROM lt JOIN f4 USING (ticker)"""),
    "capital_base": with_fixtures(_FX + ["v_info"], _M, _F, _RN, _LT, _LM, _W, body="""
SELECT ticker, ROUND(net_debt, 2) AS net_debt, shares_outstanding FROM wc"""),
    "wacc": with_fixtures(_FX + ["v_info"], _M, _F, _RN, _LT, _LM, _W, body="""
SELECT ticker, market_value_equity, market_value_debt, ROUND(total_capital, 2) AS total_capital, beta,
  ROUND(cost_of_equity, 9) AS cost_of_equity, ROUND(cost_of_debt, 9) AS cost_of_debt,
  ROUND(corporate_tax_rate, 9) AS corporate_tax_rate, ROUND(wacc, 9) AS wacc FROM wc"""),
    "dcf_parameters": with_fixtures(_FX + ["v_info"], _M, _F, _RN, _LT, _LM, _W, body="""
SELECT ticker, CAST(0.025 AS DOUBLE) AS terminal_growth_rate, CAST(10 AS DOUBLE) AS exit_multiple,
  ROUND(wacc, 9) AS wacc, ROUND(net_debt, 2) AS net_debt, shares_outstanding FROM wc"""),
    "avg_cost_of_debt": with_fixtures(_FX, _M, _F, _RN, body="""
SELECT ticker, ROUND(AVG(total_debt), 2) AS avg_total_debt, ARG_MAX_NULL(interest_expense, dt) AS interest_expense,
  ROUND(ARG_MAX_NULL(interest_expense, dt) / NULLIF(AVG(total_debt), 0), 9) AS cost_of_debt
FROM fr WHERE rn <= 3 GROUP BY ticker"""),
    "delta_nwc": with_fixtures(_FX, _M, _F, body="""
SELECT ticker, dt, ROUND(nwc, 2) AS nwc, ROUND(nwc - LAG(nwc) OVER (PARTITION BY ticker ORDER BY dt), 2) AS delta_nwc
FROM (SELECT *, (current_assets - cash_and_cash_equivalents) - (current_liabilities - current_debt) AS nwc FROM f) x"""),
    "period_growth": with_fixtures(_FX, _M, _F, body="""
SELECT ticker, dt, total_revenue,
  ROUND((total_revenue - LAG(total_revenue) OVER w) / NULLIF(ABS(LAG(total_revenue) OVER w), 0), 9) AS revenue_growth
FROM f WINDOW w AS (PARTITION BY ticker ORDER BY dt)"""),
    "avg_growth": with_fixtures(_FX, _M, _F, body="""
SELECT ticker, COUNT(*) AS n_points, ARG_MAX(x, dt) AS last_value,
  ROUND(CASE WHEN COUNT(*) >= 2 THEN AVG(g) END, 9) AS avg_growth
FROM (SELECT ticker, dt, free_cash_flow AS x,
        (free_cash_flow - LAG(free_cash_flow) OVER w) / NULLIF(ABS(LAG(free_cash_flow) OVER w), 0) AS g
      FROM f WHERE free_cash_flow IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY dt)) x
GROUP BY ticker"""),
    "smoothed_forecast": with_fixtures(_FX, _M, _F, body="""
SELECT ticker, CAST(s.step AS INTEGER) AS step, ROUND(sm, 2) AS value
FROM (SELECT ticker, AVG(capital_expenditure) AS sm FROM (
        SELECT ticker, capital_expenditure, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn
        FROM f WHERE capital_expenditure IS NOT NULL) x WHERE rn <= 3 GROUP BY ticker) a,
     generate_series(1, 5) AS s(step)"""),
    "growth_forecast": with_fixtures(_FX, _M, _F, _HIST, body="""
SELECT ticker, driver, step, ROUND(value, 2) AS value FROM gf"""),
    "constant_forecast": with_fixtures(_FX, _M, _F, _HIST, body="""
SELECT ticker, driver, CAST(s.step AS INTEGER) AS step, value
FROM (SELECT ticker, driver, ARG_MAX(value, dt) AS value FROM hist WHERE value IS NOT NULL GROUP BY ticker, driver) a,
     generate_series(1, 5) AS s(step)"""),
    "dcf_yearly": with_fixtures(_FX + ["v_info"], *_DCF, body="""
SELECT ticker, step, year, ROUND(ebit, 2) AS ebit, ROUND(tax_rate, 9) AS tax_rate, ROUND(d_and_a, 2) AS d_and_a,
  ROUND(capex, 2) AS capex, ROUND(wc_change, 2) AS wc_change, ROUND(fcf, 2) AS fcf,
  ROUND(discounted_fcf, 2) AS discounted_fcf, ROUND(cumulative_pv, 2) AS cumulative_pv FROM yr"""),
    "terminal_values": with_fixtures(_FX + ["v_info"], *_DCFV, body="""
SELECT ticker, ROUND(tvg, 2) AS terminal_value_gordon, ROUND(tvg_pv, 2) AS terminal_value_gordon_pv,
  ROUND(tvx, 2) AS terminal_value_exit, ROUND(tvx_pv, 2) AS terminal_value_exit_pv,
  wacc <= 0.025 AS wacc_le_g, n_years = 5 AS complete FROM val"""),
    "dcf_summary": with_fixtures(_FX + ["v_info"], *_DCFV, body=_long(
        V.SUMMARY_METRICS, "val", lambda c: SUMMARY_DIGITS.get(c, 2))),
    "dcf_table": with_fixtures(_FX + ["v_info"], *_DCF, f"""tl AS ({_long(
        [(lbl, f"CAST({c} AS DOUBLE)") for lbl, c in V.TABLE_METRICS], "yr", lambda c: 17).replace(
        "SELECT ticker,", "SELECT ticker, step,")})""", body=_TABLE_SQL + " FROM tl GROUP BY ticker, metric"),
    "dcf_sheet": with_fixtures(_FX + ["v_info"], *_DCFV, f"""tl AS ({_long(
        [(lbl, c) for lbl, c in (("NOPAT", "ebit * (1 - tax_rate)"),) + SHEET_METRICS[1:]], "yr",
        lambda c: 17).replace("SELECT ticker,", "SELECT ticker, step,")})""", body=_TABLE_SQL
        + """ FROM tl GROUP BY ticker, metric
UNION ALL SELECT ticker, 'Terminal Value', NULL, NULL, NULL, NULL, ROUND(terminal_value, 4) FROM val
UNION ALL SELECT ticker, 'Implied Share Price', NULL, NULL, NULL, NULL, ROUND(implied_share_price, 4) FROM val"""),
    "simple_dcf": with_fixtures(_FX, _M, _F, """sg AS (
SELECT ticker, ARG_MAX(x, dt) AS last_value, CASE WHEN COUNT(*) >= 2 THEN AVG(g) END AS avg_growth
FROM (SELECT ticker, dt, free_cash_flow AS x,
        (free_cash_flow - LAG(free_cash_flow) OVER w) / NULLIF(ABS(LAG(free_cash_flow) OVER w), 0) AS g
      FROM f WHERE free_cash_flow IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY dt)) x GROUP BY ticker),
sp AS (SELECT ticker, s.step, last_value * POW(1 + COALESCE(avg_growth, 0), s.step) AS fcf
  FROM sg, generate_series(1, 5) AS s(step)),
sa AS (SELECT ticker, SUM(fcf / POW(1 + 0.08, step)) AS pv_fcf, ARG_MAX(fcf, step) AS fcf_last FROM sp GROUP BY ticker),
st AS (SELECT *, fcf_last * (1 + 0.025) / (0.08 - 0.025) AS tv FROM sa)""", body="""
SELECT ticker, ROUND(pv_fcf, 2) AS pv_fcf, ROUND(tv, 2) AS terminal_value,
  ROUND(pv_fcf + tv / POW(1 + 0.08, 5), 2) AS enterprise_value FROM st"""),
    "valuation_label": with_fixtures(_FX + ["v_info"], *_DCFV, body="""
SELECT ticker, ROUND(implied_share_price, 4) AS implied_share_price, ROUND(market_price, 4) AS market_price,
  ROUND(upside, 6) AS upside,
  CASE WHEN upside > 0.15 THEN 'undervalued' WHEN upside < -0.15 THEN 'overvalued'
       WHEN upside IS NOT NULL THEN 'fair' END AS valuation
FROM (SELECT val.ticker, implied_share_price, mp AS market_price, implied_share_price / NULLIF(mp, 0) - 1 AS upside
      FROM val LEFT JOIN (SELECT ticker, CASE WHEN market_cap > 0 THEN market_cap END
                                 / NULLIF(shares_outstanding, 0) AS mp FROM v_info) i USING (ticker)) x"""),
}
