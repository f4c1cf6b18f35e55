"""Registered queries: screener votes, factor screens, top-k, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.operators import screening as S
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.sources import fixtures as fx
from equiflow.sources.tables import table

FACTORS = ["ethics_score", "volatility_score", "growth_score"]
TOTAL_COLUMNS = ["total_revenue", "gross_profit", "operating_income", "ebitda", "total_assets",
                 "stockholders_equity", "total_debt", "operating_cash_flow", "capital_expenditure"]


def q_extract_tickers(spark, sf):
    return S.extract_tickers(fx.replies(spark, sf))


def q_vote_count(spark, sf):
    v = S.count_votes(S.extract_tickers(fx.replies(spark, sf)))
    return v.select("request_id", "symbol", "votes", "first_reply_id", "first_line_no")


def q_top_voted(spark, sf):
    t = S.top_voted(S.count_votes(S.extract_tickers(fx.replies(spark, sf))), 3)
    return t.select("request_id", "rank", "symbol", "votes")


def q_vote_share(spark, sf):
    r = fx.replies(spark, sf)
    v = S.vote_share(S.count_votes(S.extract_tickers(r)), S.attempts(r))
    return v.select("request_id", "symbol", "votes", "attempts", F.round("vote_share", 9).alias("vote_share"))


def q_consistent_top3(spark, sf):
    r = fx.replies(spark, sf)
    return S.consistent_top3(r, fx.universe(spark, sf))


def q_name_lookup(spark, sf):
    r = fx.replies(spark, sf)
    syms = S.extract_tickers(r).select("symbol").distinct()
    return S.name_lookup(syms, fx.universe(spark, sf)).select("symbol", "name")


def q_keep_members(spark, sf):
    r = fx.replies(spark, sf)
    winners = S.top_voted(S.count_votes(S.extract_tickers(r)), 3)
    return S.keep_members(fx.universe(spark, sf), winners).select("request_id", "rank", "symbol", "name")


def q_sector_screen(spark, sf):
    return S.screen_sector(fx.info(spark, sf), "ASIA", ["ticker", "name"])


def q_with_row_id(spark, sf):
    return S.with_row_id(fx.info(spark, sf).select("ticker", "name"), "ticker")


def q_lineitem_row_id(spark, sf):
    """P02 over a large table, by two columns; the other columns are ties' last resort."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return S.with_row_id(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])


def q_supplier_row_id(spark, sf):
    """P02 by a text column."""
    return S.with_row_id(table(spark, sf, "supplier").select("s_name", "s_suppkey"), ["s_name", "s_suppkey"])


def q_describe_ticker(spark, sf):
    """Every ticker's info row as ``field value`` rows (``df.loc[t]`` for all t)."""
    i = fx.info(spark, sf)
    num = ["market_cap", "beta", "shares_outstanding"]
    fields = [F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ["name", "sector", "industry"]]
    fields += [F.struct(F.lit(c).alias("field"),
                        F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.col(c))).alias("value")) for c in num]
    return i.select("ticker", F.explode(F.array(*fields)).alias("f")).select("ticker", "f.field", "f.value")


def q_first_n(spark, sf):
    return S.first_n(fx.info(spark, sf).select("ticker", "name"), 10, ["ticker"])


def q_repeatable_sample(spark, sf):
    return S.sample_n(fx.info(spark, sf).select("ticker", "name"), 10, "ticker", "42")


def q_factor_screen(spark, sf):
    t = S.factor_screen(fx.scores(spark, sf), FACTORS, 3)
    return t.select("ticker", "name", F.col("total_score").cast("int").alias("total_score"))


def q_factor_screen_by_sector(spark, sf):
    t = S.factor_screen(fx.scores(spark, sf), FACTORS, 3, group="sector")
    return t.select("sector", "rank", "ticker", F.col("total_score").cast("int").alias("total_score"))


def q_factor_score(spark, sf):
    return S.factor_score(fx.info(spark, sf), "market_cap").select("ticker", "sector", "market_cap_score")


def q_column_totals_rank(spark, sf):
    from equiflow.plans.valuation_plans import fund
    t = S.rank_columns_by_total(fund(spark, sf), TOTAL_COLUMNS)
    return t.select("metric", F.round("total", 2).alias("total"), "rank")


QUERIES = {
    "extract_tickers": q_extract_tickers,
    "vote_count": q_vote_count,
    "top_voted": q_top_voted,
    "vote_share": q_vote_share,
    "consistent_top3": q_consistent_top3,
    "name_lookup": q_name_lookup,
    "keep_members": q_keep_members,
    "sector_screen": q_sector_screen,
    "with_row_id": q_with_row_id,
    "lineitem_row_id": q_lineitem_row_id,
    "supplier_row_id": q_supplier_row_id,
    "describe_ticker": q_describe_ticker,
    "first_n": q_first_n,
    "repeatable_sample": q_repeatable_sample,
    "factor_screen": q_factor_screen,
    "factor_screen_by_sector": q_factor_screen_by_sector,
    "factor_score": q_factor_score,
    "column_totals_rank": q_column_totals_rank,
}

# ---------------------------------------------------------------- oracle ----

_LINES = """ln AS (
SELECT request_id, reply_id, CAST(g.i - 1 AS INTEGER) AS line_no, lines[g.i] AS line
FROM (SELECT request_id, reply_id, string_split_regex(text, '\\r\\n|[\\n\\r]') AS lines FROM v_replies) x,
     generate_series(1, len(x.lines)) AS g(i))"""
_TK = """tk AS (SELECT request_id, reply_id, line_no, regexp_extract(line, '^\\|\\s*([A-Z]{1,5})\\s*\\|', 1) AS symbol
FROM ln WHERE regexp_extract(line, '^\\|\\s*([A-Z]{1,5})\\s*\\|', 1) <> '')"""
_VC = """vc AS (SELECT request_id, symbol, COUNT(*) AS votes, MIN(reply_id * 1000 + line_no) AS fs
FROM tk GROUP BY request_id, symbol)"""
_TV = """tv AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY votes DESC, fs) AS INTEGER) AS rank
FROM vc)"""
_SC = """sc AS (SELECT *, LEAST(GREATEST(ethics_score, 0), 5) + LEAST(GREATEST(volatility_score, 0), 5)
  + LEAST(GREATEST(growth_score, 0), 5) AS total_score FROM v_scores)"""

ORACLE = {
    "extract_tickers": with_fixtures(["v_replies"], _LINES, _TK, body="SELECT * FROM tk"),
    "vote_count": with_fixtures(["v_replies"], _LINES, _TK, body="""
SELECT request_id, symbol, COUNT(*) AS votes, ARG_MIN(reply_id, reply_id * 1000 + line_no) AS first_reply_id,
  ARG_MIN(line_no, reply_id * 1000 + line_no) AS first_line_no FROM tk GROUP BY request_id, symbol"""),
    "top_voted": with_fixtures(["v_replies"], _LINES, _TK, _VC, _TV, body="""
SELECT request_id, rank, symbol, votes FROM tv WHERE rank <= 3"""),
    "vote_share": with_fixtures(["v_replies"], _LINES, _TK, _VC, body="""
SELECT vc.request_id, symbol, votes, a.attempts, ROUND(votes / a.attempts, 9) AS vote_share
FROM vc JOIN (SELECT request_id, COUNT(*) AS attempts FROM v_replies GROUP BY request_id) a USING (request_id)"""),
    "consistent_top3": with_fixtures(["v_replies", "v_universe"], _LINES, _TK, _VC, _TV, body="""
SELECT request_id, rank, symbol, COALESCE(name, 'Unknown Company') AS name, votes
FROM tv LEFT JOIN v_universe USING (symbol) WHERE rank <= 3"""),
    "name_lookup": with_fixtures(["v_replies", "v_universe"], _LINES, _TK, body="""
SELECT s.symbol, COALESCE(name, 'Unknown Company') AS name
FROM (SELECT DISTINCT symbol FROM tk) s LEFT JOIN v_universe USING (symbol)"""),
    "keep_members": with_fixtures(["v_replies", "v_universe"], _LINES, _TK, _VC, _TV, body="""
SELECT request_id, rank, symbol, name FROM tv JOIN v_universe USING (symbol) WHERE rank <= 3"""),
    "sector_screen": with_fixtures(["v_info"], body="SELECT ticker, name FROM v_info WHERE sector = 'ASIA'"),
    "with_row_id": with_fixtures(["v_info"], body="""
SELECT ticker, name, ROW_NUMBER() OVER (ORDER BY ticker) - 1 AS row_id FROM v_info"""),
    "lineitem_row_id": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  ROW_NUMBER() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS row_id FROM lineitem""",
    "supplier_row_id": "SELECT s_name, s_suppkey, ROW_NUMBER() OVER (ORDER BY s_name, s_suppkey) - 1 AS row_id FROM supplier",
    "describe_ticker": with_fixtures(["v_info"], body="""
SELECT ticker, 'name' AS field, name AS value FROM v_info
UNION ALL SELECT ticker, 'sector', sector FROM v_info
UNION ALL SELECT ticker, 'industry', industry FROM v_info
UNION ALL SELECT ticker, 'market_cap', printf('%.2f', market_cap) FROM v_info
UNION ALL SELECT ticker, 'beta', printf('%.2f', beta) FROM v_info
UNION ALL SELECT ticker, 'shares_outstanding', printf('%.2f', shares_outstanding) FROM v_info"""),
    "first_n": with_fixtures(["v_info"], body="SELECT ticker, name FROM v_info ORDER BY ticker LIMIT 10"),
    "repeatable_sample": with_fixtures(["v_info"], body="""
SELECT ticker, name FROM v_info ORDER BY md5(CAST(ticker AS VARCHAR) || '42'), ticker LIMIT 10"""),
    "factor_screen": with_fixtures(["v_scores"], _SC, body="""
SELECT ticker, name, CAST(total_score AS INTEGER) AS total_score FROM sc ORDER BY total_score DESC, ticker LIMIT 3"""),
    "factor_screen_by_sector": with_fixtures(["v_scores"], _SC, body="""
SELECT sector, rank, ticker, CAST(total_score AS INTEGER) AS total_score FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY sector ORDER BY total_score DESC, ticker) AS INTEGER) AS rank FROM sc) x
WHERE rank <= 3"""),
    "factor_score": with_fixtures(["v_info"], body="""
SELECT ticker, sector, CASE WHEN market_cap IS NOT NULL THEN
  CAST(ROUND(PERCENT_RANK() OVER (PARTITION BY sector ORDER BY market_cap) * 5, 0) AS INTEGER) END AS market_cap_score
FROM v_info"""),
}


def _totals_sql() -> str:
    from equiflow.plans.valuation_plans import _F, _FX, _M
    parts = "\nUNION ALL ".join(f"SELECT '{c}' AS metric, SUM({c}) AS total FROM f" for c in TOTAL_COLUMNS)
    return with_fixtures(_FX, _M, _F, f"t AS ({parts})", body="""
SELECT metric, ROUND(total, 2) AS total, CAST(ROW_NUMBER() OVER (ORDER BY total DESC, metric) AS INTEGER) AS rank
FROM t""")


ORACLE["column_totals_rank"] = _totals_sql()
