"""Registered queries: price scan, SMA, RSI, MACD, indicator table, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.operators import technical as T
from equiflow.operators.series import drop_halo
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.sources import fixtures as fx


def _r(c: str, d: int = 6, alias: str | None = None):
    return F.round(F.col(c), d).alias(alias or c)


def _blocked(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return T.blocked_prices(fx.prices(spark, sf).select("ticker", "dt", *cols))


def q_trailing_year_prices(spark, sf):
    return T.trailing_period(fx.prices(spark, sf), 12).select("ticker", "dt", "close")


def q_sma(spark, sf):
    b = T.sma(T.sma(_blocked(spark, sf, "close"), 20), 50)
    return drop_halo(b).select("ticker", "dt", "close", _r("sma_20"), _r("sma_50"))


def q_rsi(spark, sf):
    b = T.rsi(_blocked(spark, sf, "close"))
    return drop_halo(b).select("ticker", "dt", "gain", "loss", _r("avg_gain"), _r("avg_loss"), _r("rsi"))


def q_macd(spark, sf):
    b = T.macd(_blocked(spark, sf, "close"))
    return drop_halo(b).select("ticker", "dt", _r("ema_fast", alias="ema_12"), _r("ema_slow", alias="ema_26"),
                               _r("macd"), _r("macd_signal"), _r("macd_hist"))


def q_technical_indicators(spark, sf):
    t = T.technical_indicators(fx.prices(spark, sf).select("ticker", "dt", "close"))
    return t.select("ticker", "dt", "close", *[_r(c) for c in T.INDICATOR_COLUMNS])


def q_trend_signal(spark, sf):
    b = T.trend_signal(T.sma(T.sma(_blocked(spark, sf, "close"), 20), 50))
    return drop_halo(b).select("ticker", "dt", "trend", "ma_cross")


def q_rsi_zone(spark, sf):
    b = T.rsi_zone(T.rsi(_blocked(spark, sf, "close")))
    return drop_halo(b).select("ticker", "dt", _r("rsi"), "rsi_zone")


def q_macd_cross(spark, sf):
    b = T.macd_signal(T.macd(_blocked(spark, sf, "close")))
    return drop_halo(b).select("ticker", "dt", "macd_cross", "hist_direction")


def q_levels(spark, sf):
    b = T.levels(_blocked(spark, sf, "close", "high", "low"), 20)
    return drop_halo(b).select("ticker", "dt", "support", "resistance")


def q_price_action(spark, sf):
    b = T.price_action(T.indicators(_blocked(spark, sf, "close")))
    return drop_halo(b).select("ticker", "dt", "bias_score", "bias")


QUERIES = {
    "trailing_year_prices": q_trailing_year_prices,
    "sma": q_sma,
    "rsi": q_rsi,
    "macd": q_macd,
    "technical_indicators": q_technical_indicators,
    "trend_signal": q_trend_signal,
    "rsi_zone": q_rsi_zone,
    "macd_cross": q_macd_cross,
    "levels": q_levels,
    "price_action": q_price_action,
}

# ---------------------------------------------------------------- oracle ----
# Independent form: positions by ROW_NUMBER over the whole ticker, EWMs as
# explicit weighted sums over a self-join (b.i <= a.i), windows by SQL frames.

_P = """p AS (
SELECT ticker, dt, close, high, low,
  ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i,
  close - LAG(close) OVER (PARTITION BY ticker ORDER BY dt) AS delta,
  CASE WHEN COUNT(close) OVER w20 = 20 THEN AVG(close) OVER w20 END AS sma_20,
  CASE WHEN COUNT(close) OVER w50 = 50 THEN AVG(close) OVER w50 END AS sma_50,
  CASE WHEN COUNT(close) OVER w20 = 20 THEN MIN(low) OVER w20 END AS support,
  CASE WHEN COUNT(close) OVER w20 = 20 THEN MAX(high) OVER w20 END AS resistance
FROM v_prices
WINDOW w20 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
       w50 AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""

_G = """g AS (
SELECT *, CASE WHEN delta > 0 THEN delta ELSE CAST(0 AS DOUBLE) END AS gain,
  CASE WHEN delta < 0 THEN -delta ELSE CAST(0 AS DOUBLE) END AS loss FROM p)"""

_E = """e AS (
SELECT a.ticker, a.dt,
  SUM(POW(CAST(13 AS DOUBLE) / 14, a.i - b.i) * b.gain) / SUM(POW(CAST(13 AS DOUBLE) / 14, a.i - b.i)) AS eg,
  SUM(POW(CAST(13 AS DOUBLE) / 14, a.i - b.i) * b.loss) / SUM(POW(CAST(13 AS DOUBLE) / 14, a.i - b.i)) AS el,
  SUM(POW(CAST(11 AS DOUBLE) / 13, a.i - b.i) * CASE WHEN b.i = 0 THEN b.close ELSE CAST(2 AS DOUBLE) / 13 * b.close END) AS ema_12,
  SUM(POW(CAST(25 AS DOUBLE) / 27, a.i - b.i) * CASE WHEN b.i = 0 THEN b.close ELSE CAST(2 AS DOUBLE) / 27 * b.close END) AS ema_26
FROM g a JOIN g b ON a.ticker = b.ticker AND b.i <= a.i
GROUP BY a.ticker, a.dt)"""

_T1 = """t1 AS (
SELECT g.*, CASE WHEN g.i >= 13 THEN e.eg END AS avg_gain, CASE WHEN g.i >= 13 THEN e.el END AS avg_loss,
  e.ema_12, e.ema_26, e.ema_12 - e.ema_26 AS macd
FROM g JOIN e USING (ticker, dt))"""

_S = """s AS (
SELECT a.ticker, a.dt,
  SUM(POW(CAST(8 AS DOUBLE) / 10, a.i - b.i) * CASE WHEN b.i = 0 THEN b.macd ELSE CAST(2 AS DOUBLE) / 10 * b.macd END) AS macd_signal
FROM t1 a JOIN t1 b ON a.ticker = b.ticker AND b.i <= a.i
GROUP BY a.ticker, a.dt)"""

_TI = """ti AS (
SELECT t1.*, s.macd_signal, t1.macd - s.macd_signal AS macd_hist,
  CASE WHEN avg_gain IS NULL OR avg_loss IS NULL THEN NULL
       WHEN avg_loss = 0 AND avg_gain > 0 THEN CAST(100 AS DOUBLE)
       WHEN avg_loss = 0 THEN NULL
       ELSE 100 - 100 / (1 + avg_gain / avg_loss) END AS rsi
FROM t1 JOIN s USING (ticker, dt))"""

_FULL = (_P, _G, _E, _T1, _S, _TI)

ORACLE = {
    "trailing_year_prices": with_fixtures(["v_prices"], body="""
SELECT ticker, dt, close FROM (SELECT *, MAX(dt) OVER (PARTITION BY ticker) AS mx FROM v_prices) x
WHERE dt >= mx - INTERVAL 12 MONTH"""),
    "sma": with_fixtures(["v_prices"], _P, body="""
SELECT ticker, dt, close, ROUND(sma_20, 6) AS sma_20, ROUND(sma_50, 6) AS sma_50 FROM p"""),
    "rsi": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt, gain, loss, ROUND(avg_gain, 6) AS avg_gain,
  ROUND(avg_loss, 6) AS avg_loss, ROUND(rsi, 6) AS rsi FROM ti"""),
    "macd": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt, ROUND(ema_12, 6) AS ema_12, ROUND(ema_26, 6) AS ema_26, ROUND(macd, 6) AS macd,
  ROUND(macd_signal, 6) AS macd_signal, ROUND(macd_hist, 6) AS macd_hist FROM ti"""),
    "technical_indicators": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt, close, ROUND(sma_20, 6) AS sma_20, ROUND(sma_50, 6) AS sma_50, ROUND(rsi, 6) AS rsi,
  ROUND(macd, 6) AS macd, ROUND(macd_signal, 6) AS macd_signal, ROUND(macd_hist, 6) AS macd_hist
FROM ti WHERE sma_20 IS NOT NULL AND sma_50 IS NOT NULL AND rsi IS NOT NULL
  AND macd IS NOT NULL AND macd_signal IS NOT NULL AND macd_hist IS NOT NULL"""),
    "trend_signal": with_fixtures(["v_prices"], _P, body="""
SELECT ticker, dt,
  CASE WHEN sma_20 IS NULL OR sma_50 IS NULL THEN NULL
       WHEN close > sma_20 AND sma_20 > sma_50 THEN 'uptrend'
       WHEN close < sma_20 AND sma_20 < sma_50 THEN 'downtrend' ELSE 'sideways' END AS trend,
  CASE WHEN prev <= 0 AND diff > 0 THEN 'golden_cross' WHEN prev >= 0 AND diff < 0 THEN 'death_cross' END AS ma_cross
FROM (SELECT *, sma_20 - sma_50 AS diff,
        LAG(sma_20 - sma_50) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM p) x"""),
    "rsi_zone": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt, ROUND(rsi, 6) AS rsi,
  CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' WHEN rsi IS NOT NULL THEN 'neutral' END AS rsi_zone
FROM ti"""),
    "macd_cross": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt,
  CASE WHEN prev <= 0 AND macd_hist > 0 THEN 'bullish' WHEN prev >= 0 AND macd_hist < 0 THEN 'bearish' END AS macd_cross,
  CASE WHEN prev IS NULL THEN NULL WHEN macd_hist > prev THEN 'rising' WHEN macd_hist < prev THEN 'falling'
       ELSE 'flat' END AS hist_direction
FROM (SELECT *, LAG(macd_hist) OVER (PARTITION BY ticker ORDER BY dt) AS prev FROM ti) x"""),
    "levels": with_fixtures(["v_prices"], _P, body="""
SELECT ticker, dt, support, resistance FROM p"""),
    "price_action": with_fixtures(["v_prices"], *_FULL, body="""
SELECT ticker, dt, CAST(sc AS INTEGER) AS bias_score,
  CASE WHEN sc >= 2 THEN 'bullish' WHEN sc <= -2 THEN 'bearish' ELSE 'consolidating' END AS bias
FROM (SELECT *,
  (CASE WHEN close > sma_50 THEN 1 WHEN close < sma_50 THEN -1 ELSE 0 END)
  + (CASE WHEN macd > macd_signal THEN 1 WHEN macd < macd_signal THEN -1 ELSE 0 END)
  + (CASE WHEN rsi > 50 THEN 1 WHEN rsi < 50 THEN -1 ELSE 0 END) AS sc FROM ti) x"""),
}
