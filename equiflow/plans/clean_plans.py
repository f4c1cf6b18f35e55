"""Registered queries: column and row cleaning, company scans, unions, gate and as-of forms
(P04 P07 P10 P12 P15 P17 S01 S02 S05 S10 T01 U01 U02 V18 X17 J04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from equiflow.operators import clean as C
from equiflow.operators import technical as T
from equiflow.operators import text_parse as TP
from equiflow.operators import valuation as V
from equiflow.plans import valuation_plans as VP
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.plans.valuation_plans import _F, _FX, _M
from equiflow.sources import fixtures as fx
from equiflow.sources.tables import table

PRICE_SCHEMA_COLUMNS = ("ticker", "dt", "close", "volume")


def q_coerce_numeric(spark, sf):
    """P10: text cells of a sheet, some of them no number."""
    t = F.col("text")
    cells = fx.number_replies(spark, sf).select("ticker", t.alias("cell"), F.concat(t, F.lit("x")).alias("bad"))
    return C.coerce_numeric(cells, ["cell", "bad"])


def q_standardize_date(spark, sf):
    """A text column 'Ship Date' becomes the date column."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("Ship Date"))
    return C.standardize_date(li)


def q_select_available(spark, sf):
    return C.select_available(fx.info(spark, sf), ["ticker", "name", "trailing_pe", "sector", "dividend_yield"])


def q_select_matching(spark, sf):
    return C.select_matching(fx.balance(spark, sf), ["debt", "ASSET"], keep=["ticker", "dt"])


def q_require_columns(spark, sf):
    return fx.prices(spark, sf).transform(T.require_columns, PRICE_SCHEMA_COLUMNS).select(*PRICE_SCHEMA_COLUMNS)


def q_rows_from_map(spark, sf):
    """A map key -> record per sector, as one row per key."""
    info = fx.info(spark, sf).select("sector", "industry", F.struct("ticker", "name").alias("rec"))
    maps = info.select(F.create_map(F.concat_ws("/", "sector", "industry", F.col("rec.ticker").cast("string")), "rec").alias("m"))
    return C.rows_from_map(maps, "m", "path")


def q_split_valid(spark, sf):
    """Companies with a usable market value, and the others, told apart by ``valid``."""
    good, bad = C.split_valid(fx.info(spark, sf).select("ticker", "market_cap", "shares_outstanding"), (F.col("market_cap") > 0) & F.col("shares_outstanding").isNotNull())
    return good.withColumn("valid", F.lit(True)).union(bad.withColumn("valid", F.lit(False)))


def q_with_default(spark, sf):
    """A field of a JSON request, with the default where it is missing or null."""
    k = F.col("ticker")
    body = F.when(k % 3 == 0, F.lit("{}")).when(k % 3 == 1, F.concat(F.lit('{"years": "'), (k % 7).cast("string"), F.lit('"}'))).otherwise(F.lit('{"years": null}'))
    return fx.info(spark, sf).select("ticker", TP.with_default(body, "$.years", "5").alias("years"))


def q_company_info(spark, sf):
    return fx.company_info(spark, sf)


def q_market_info(spark, sf):
    return fx.info(spark, sf).select("ticker", "market_cap", "beta", "shares_outstanding")


def q_universe(spark, sf):
    return fx.universe(spark, sf)


def q_ordered_periods(spark, sf):
    """Each ticker's periods in order, as a list of (period, revenue)."""
    f = VP.fund(spark, sf).where(F.col("total_revenue").isNotNull())
    lists = f.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("dt", "total_revenue"))).alias("p"))  # tens of periods
    return lists.select("ticker", F.posexplode("p").alias("pos", "p")).select("ticker", "pos", "p.dt", "p.total_revenue")


def q_union_results(spark, sf):
    """Results of two valuation methods, one under the other; each has a figure that the other lacks."""
    simple = VP.q_simple_dcf(spark, sf).select("ticker", "enterprise_value", "pv_fcf", F.lit("simple").alias("method"))
    full = VP._valuation(spark, sf).select(F.lit("full").alias("method"), "ticker", F.round("implied_share_price", 4).alias("implied_share_price"), F.round("enterprise_value", 2).alias("enterprise_value"))
    return C.union_all([full, simple])


def q_union_attempts(spark, sf):
    """Votes of the first and of later attempts of each request, kept apart."""
    from equiflow.operators import screening as S

    attempt = F.when(F.col("reply_id") % 5 == 0, "first").otherwise("later").alias("attempt")
    return S.extract_tickers(fx.replies(spark, sf)).groupBy("request_id", "symbol", attempt).agg(F.count(F.lit(1)).alias("votes"))


def q_price_rejects(spark, sf):
    """Q22: price rows that cannot enter a series, with the reason."""
    k = F.col("ticker")
    p = fx.prices(spark, sf).select(
        F.when(k % 10 != 7, k).alias("ticker"), F.when(k % 10 != 8, F.col("dt")).alias("dt"), F.when(k % 10 != 9, F.col("close")).alias("close"))
    return T.quarantine(p)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def q_dcf_run(spark, sf):
    """One row per company of the universe: valued, or why not."""
    gate = C.complete_tickers(fx.statements(spark, sf))
    return V.run_dcf(fx.info(spark, sf).select("ticker"), gate, VP._valuation(spark, sf)).select(
        "ticker", "status", F.round("implied_share_price", 4).alias("implied_share_price"))


QUERIES = {
    "coerce_numeric": q_coerce_numeric, "standardize_date": q_standardize_date, "select_available": q_select_available,
    "select_matching": q_select_matching, "require_columns": q_require_columns, "rows_from_map": q_rows_from_map,
    "split_valid": q_split_valid, "with_default": q_with_default, "company_info": q_company_info, "market_info": q_market_info,
    "universe": q_universe, "ordered_periods": q_ordered_periods, "union_results": q_union_results,
    "union_attempts": q_union_attempts, "price_rejects": q_price_rejects, "dcf_run": q_dcf_run,
}

# ---------------------------------------------------------------- oracle ----


def _oracle() -> dict[str, str]:
    from equiflow.plans.screening_plans import _LINES, _TK
    simple, summary = VP.ORACLE["simple_dcf"], VP.ORACLE["dcf_summary"]
    return {
        "coerce_numeric": with_fixtures(["v_number_replies"], body="""
SELECT ticker, CASE WHEN ticker % 8 < 5 AND ticker % 8 <> 3 THEN CAST(text AS DOUBLE) END AS cell, CAST(NULL AS DOUBLE) AS bad FROM v_number_replies"""),
        "standardize_date": "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS dt FROM lineitem",
        "select_available": with_fixtures(["v_info"], body="SELECT ticker, name, sector FROM v_info"),
        "select_matching": with_fixtures(["v_balance"], body="""
SELECT ticker, dt, total_assets, current_assets, total_debt, net_debt, current_debt FROM v_balance"""),
        "require_columns": with_fixtures(["v_prices"], body="SELECT ticker, dt, close, volume FROM v_prices"),
        "rows_from_map": with_fixtures(["v_info"], body="SELECT sector || '/' || industry || '/' || ticker AS path, ticker, name FROM v_info"),
        "split_valid": with_fixtures(["v_info"], body="""
SELECT ticker, market_cap, shares_outstanding, COALESCE(market_cap > 0, FALSE) AND shares_outstanding IS NOT NULL AS valid FROM v_info"""),
        "with_default": with_fixtures(["v_info"], body="SELECT ticker, CASE WHEN ticker % 3 = 1 THEN CAST(ticker % 7 AS VARCHAR) ELSE '5' END AS years FROM v_info"),
        "company_info": with_fixtures(["v_company"], body="SELECT * FROM v_company"),
        "market_info": with_fixtures(["v_info"], body="SELECT ticker, market_cap, beta, shares_outstanding FROM v_info"),
        "universe": with_fixtures(["v_universe"], body="SELECT * FROM v_universe"),
        "ordered_periods": with_fixtures(_FX, _M, _F, body="""
SELECT ticker, CAST(ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS INTEGER) AS pos, dt, total_revenue FROM f WHERE total_revenue IS NOT NULL"""),
        "union_results": f"""SELECT 'simple' AS method, ticker, enterprise_value, pv_fcf, CAST(NULL AS DOUBLE) AS implied_share_price FROM ({simple}) a
UNION ALL SELECT 'full', ticker, MAX(CASE WHEN metric = 'Enterprise Value' THEN value END), NULL, MAX(CASE WHEN metric = 'Implied Share Price' THEN value END)
FROM ({summary}) b GROUP BY ticker""",
        "union_attempts": with_fixtures(["v_replies"], _LINES, _TK, body="""
SELECT request_id, symbol, COUNT(*) AS votes, CASE WHEN reply_id % 5 = 0 THEN 'first' ELSE 'later' END AS attempt FROM tk GROUP BY ALL"""),
        "price_rejects": with_fixtures(["v_prices"], body="""
SELECT CASE ticker % 10 WHEN 7 THEN 'no ticker' WHEN 8 THEN 'no date' ELSE 'no close' END AS reason, COUNT(*) AS n
FROM v_prices WHERE ticker % 10 IN (7, 8, 9) GROUP BY 1"""),
        "dcf_run": f"""SELECT i.s_suppkey AS ticker,
  CASE WHEN NOT g.ok THEN 'statement missing' WHEN v.ticker IS NULL THEN 'driver missing' WHEN v.value IS NULL THEN 'no price' ELSE 'valued' END AS status,
  CASE WHEN g.ok THEN v.value END AS implied_share_price
FROM supplier i
JOIN (SELECT s_suppkey AS t, EXISTS (SELECT 1 FROM ({_gate()}) c WHERE c.ticker = s_suppkey) AS ok FROM supplier) g ON g.t = i.s_suppkey
LEFT JOIN (SELECT ticker, value FROM ({summary}) z WHERE metric = 'Implied Share Price') v ON v.ticker = i.s_suppkey""",
    }


def _gate() -> str:
    return with_fixtures(["v_statements"], body="""
SELECT ticker FROM v_statements WHERE statement IN ('income', 'balance', 'cash') GROUP BY ticker HAVING COUNT(DISTINCT statement) = 3""")


ORACLE = _oracle()
