"""Technical indicators (W01-W11) and the signals built on them.

All functions take a *blocked* price frame (``blocked_prices``) and add
columns; ``drop_halo`` at the end keeps each row once.  Windows are
``partition by (ticker, _blk) order by j``, so one hot ticker is spread over
many tasks and every window below reuses the same hash exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.operators.ewm import alpha_from, ema_of_ema, ewm_frame, sub_block_rows
from equiflow.operators.series import block_window, drop_halo, series_index, with_blocks
from equiflow.sources.tables import shared

# Indicator parameters of the reference.
SMA_WINDOWS = (20, 50)
RSI_PERIOD = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9

EWM_ROWS = sub_block_rows(alpha_from(span=MACD_FAST), alpha_from(span=MACD_SLOW),
                          alpha_from(span=MACD_SIGNAL), alpha_from(com=RSI_PERIOD - 1))
# one sub-block, and a row for differences
HALO = max(EWM_ROWS + 1, max(SMA_WINDOWS))
BLOCK_ROWS = EWM_ROWS * 30
#: Differences below this share of the price are rounding: no cross, no trend, flat.
TOLERANCE = 1e-11


def quarantine(prices: DataFrame, key: str = "ticker", order: str = "dt", close: str = "close") -> tuple[DataFrame, DataFrame]:
    """Q22: ``(usable rows, rejects)``; a row without key, date or close cannot enter a series."""
    bad = F.col(key).isNull() | F.col(order).isNull() | F.col(close).isNull()
    reason = F.when(F.col(key).isNull(), "no ticker").when(F.col(order).isNull(), "no date").otherwise("no close")
    return prices.where(~bad), prices.where(bad).withColumn("reason", reason)


def blocked_prices(prices: DataFrame, key: str = "ticker", order: str = "dt", halo: int = HALO,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The usable rows as a blocked frame; ``quarantine(prices)[1]`` has the others."""
    valid, _ = quarantine(prices, key, order)
    return with_blocks(series_index(valid, key, order), halo, key, block_rows=block_rows)


def require_columns(df: DataFrame, cols: tuple[str, ...], on_missing: str = "raise") -> DataFrame:
    """Schema guard for ``transform``: ``df`` itself, or an error that names the missing columns
    (``on_missing='passthrough'``: ``df`` unchanged, the caller's step is skipped)."""
    missing = [c for c in cols if c not in df.columns]
    if missing and on_missing != "passthrough":
        raise ValueError(f"missing required columns {missing}")
    return df


def sma(b: DataFrame, n: int, col: str = "close", out: str | None = None, key: str = "ticker") -> DataFrame:
    """Mean of the last ``n`` closes, NULL until the window is full."""
    w = block_window(key).rowsBetween(-(n - 1), 0)
    return b.withColumn(out or f"sma_{n}", F.when(F.count(col).over(w) == n, F.avg(col).over(w)))


def delta(b: DataFrame, col: str = "close", out: str = "delta", key: str = "ticker") -> DataFrame:
    """First difference."""
    return b.withColumn(out, F.col(col) - F.lag(col).over(block_window(key)))


def gain_loss(b: DataFrame, d: str = "delta") -> DataFrame:
    """Gain and loss; the first row counts as an observation of 0 (Q18)."""
    return b.withColumns({
        "gain": F.when(F.col(d) > 0, F.col(d)).otherwise(F.lit(0.0)),
        "loss": F.when(F.col(d) < 0, -F.col(d)).otherwise(F.lit(0.0)),
    })


def _rsi_value(ag: str = "avg_gain", al: str = "avg_loss"):
    g, l_ = F.col(ag), F.col(al)
    return (F.when(g.isNull() | l_.isNull(), F.lit(None).cast("double"))
            .when((l_ == 0) & (g > 0), F.lit(100.0))
            .when(l_ == 0, F.lit(None).cast("double"))
            .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + g / l_)))


def rsi(b: DataFrame, n: int = RSI_PERIOD, col: str = "close", key: str = "ticker", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """RSI with normalised EWM (com = n-1, min_periods = n), zero-loss rules of Q20."""
    b = gain_loss(delta(b, col, key=key))
    a = alpha_from(com=n - 1)
    b = ewm_frame(b, {"avg_gain": (F.col("gain"), a, True, n),
                      "avg_loss": (F.col("loss"), a, True, n)}, EWM_ROWS, block_rows, key=key)
    return b.withColumn("rsi", _rsi_value())


def _macd_means(fast: int, slow: int, signal: int, col: str) -> dict:
    return {name: (F.col(col), alpha_from(span=span), False, 0) for name, span in (("ema_fast", fast), ("ema_slow", slow), ("_ema_signal", signal))}


def _macd_columns(b: DataFrame, fast: int, slow: int, signal: int) -> DataFrame:
    """W08-W10 from the three EMAs of the close: the signal line, an EMA of their difference, follows from them row by row."""
    f, s, g = (alpha_from(span=n) for n in (fast, slow, signal))
    own = F.col("_ema_signal")
    line = settled(ema_of_ema(own, F.col("ema_fast"), g, f) - ema_of_ema(own, F.col("ema_slow"), g, s), F.col("ema_slow"))
    b = b.withColumns({"macd": settled(F.col("ema_fast") - F.col("ema_slow"), F.col("ema_slow")), "macd_signal": line})
    return b.withColumn("macd_hist", settled(F.col("macd") - F.col("macd_signal"), F.col("ema_slow"))).drop("_ema_signal")


def macd(b: DataFrame, fast: int = MACD_FAST, slow: int = MACD_SLOW, signal: int = MACD_SIGNAL,
         col: str = "close", key: str = "ticker", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Recursive EMAs, MACD line, signal line and histogram, all from one pass of sums."""
    return _macd_columns(ewm_frame(b, _macd_means(fast, slow, signal, col), EWM_ROWS, block_rows, key=key), fast, slow, signal)


def settled(difference: Column, scale: Column) -> Column:
    """A difference, 0 where it is only rounding against ``scale``."""
    return F.when(F.abs(difference) <= F.abs(scale) * TOLERANCE, F.lit(0.0)).otherwise(difference)


def indicators(b: DataFrame, key: str = "ticker", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """W01-W10 on a blocked frame; all EWMs share one pass of sums and one table of carried ones."""
    for n in SMA_WINDOWS:
        b = sma(b, n, key=key)
    b = gain_loss(delta(b, key=key))
    a_rsi = alpha_from(com=RSI_PERIOD - 1)
    spans = (MACD_FAST, MACD_SLOW, MACD_SIGNAL)
    b = ewm_frame(b, {
        "avg_gain": (F.col("gain"), a_rsi, True, RSI_PERIOD),
        "avg_loss": (F.col("loss"), a_rsi, True, RSI_PERIOD),
        **_macd_means(*spans, "close"),
    }, EWM_ROWS, block_rows, key=key)
    return _macd_columns(b.withColumn("rsi", _rsi_value()), *spans)


INDICATOR_COLUMNS = ("sma_20", "sma_50", "rsi", "macd", "macd_signal", "macd_hist")


def drop_incomplete(df: DataFrame, cols: tuple[str, ...] | list[str]) -> DataFrame:
    """Drop a row when any of ``cols`` is NULL.

    The row id keeps the test above the projection that makes the columns; else each would be computed again inside the filter.
    """
    kept = df.withColumn("_row", F.monotonically_increasing_id()).where(F.expr(f"_row >= 0 AND {' AND '.join(f'`{c}` IS NOT NULL AND NOT isnan(`{c}`)' if t in ('double', 'float') else f'`{c}` IS NOT NULL' for c, t in df.dtypes if c in cols)}"))
    return kept.drop("_row")


def technical_indicators(prices: DataFrame, key: str = "ticker", dropna: bool = True,
                         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """SMA 20/50, RSI 14, MACD 12/26/9 for every ticker; rows with any NULL indicator dropped."""
    out = drop_halo(indicators(blocked_prices(prices, key, block_rows=block_rows), key, block_rows))
    return drop_incomplete(out, INDICATOR_COLUMNS) if dropna else out


# ---- signals (re-aimed prompt items), computed on the blocked frame so lags see the halo ----

def _sign_change(cur, prev, up: str, down: str):
    return (F.when((prev <= 0) & (cur > 0), F.lit(up))
            .when((prev >= 0) & (cur < 0), F.lit(down)))


def trend_signal(b: DataFrame, key: str = "ticker") -> DataFrame:
    """Close vs SMA20 vs SMA50 and golden/death crosses of SMA20 over SMA50."""
    c, s20, s50 = F.col("close"), F.col("sma_20"), F.col("sma_50")
    diff = settled(s20 - s50, s50)
    above = settled(c - s20, s20)
    prev = F.lag(diff).over(block_window(key))
    return b.withColumns({
        "trend": F.when(s20.isNull() | s50.isNull(), F.lit(None).cast("string"))
        .when((above > 0) & (diff > 0), F.lit("uptrend"))
        .when((above < 0) & (diff < 0), F.lit("downtrend"))
        .otherwise(F.lit("sideways")),
        "ma_cross": _sign_change(diff, prev, "golden_cross", "death_cross"),
    })


def rsi_zone(b: DataFrame, upper: float = 70.0, lower: float = 30.0) -> DataFrame:
    """Overbought / oversold / neutral (bounds are parameters)."""
    r = F.col("rsi")
    return b.withColumn("rsi_zone", F.when(r >= upper, F.lit("overbought"))
                        .when(r <= lower, F.lit("oversold"))
                        .when(r.isNotNull(), F.lit("neutral")))


def macd_signal(b: DataFrame, key: str = "ticker") -> DataFrame:
    """MACD/signal crossover and histogram direction."""
    w = block_window(key)
    h = F.col("macd_hist")
    prev = F.lag(h).over(w)
    step = settled(h - prev, F.col("ema_slow"))
    return b.withColumns({
        "macd_cross": _sign_change(h, prev, "bullish", "bearish"),
        "hist_direction": F.when(prev.isNull(), F.lit(None).cast("string"))
        .when(step > 0, F.lit("rising")).when(step < 0, F.lit("falling")).otherwise(F.lit("flat")),
    })


def levels(b: DataFrame, n: int = 20, key: str = "ticker") -> DataFrame:
    """Support (min low) and resistance (max high) of the last ``n`` rows."""
    w = block_window(key).rowsBetween(-(n - 1), 0)
    full = F.count("close").over(w) == n
    return b.withColumns({"support": F.when(full, F.min("low").over(w)),
                          "resistance": F.when(full, F.max("high").over(w))})


def price_action(b: DataFrame) -> DataFrame:
    """Bullish / bearish / consolidating by a vote of trend, MACD and RSI."""
    def vote(cond_up, cond_down):
        return F.when(cond_up, F.lit(1)).when(cond_down, F.lit(-1)).otherwise(F.lit(0))
    over = settled(F.col("close") - F.col("sma_50"), F.col("sma_50"))
    score = (vote(over > 0, over < 0) + vote(F.col("macd_hist") > 0, F.col("macd_hist") < 0)
             + vote(F.col("rsi") > 50, F.col("rsi") < 50))
    return b.withColumns({
        "bias_score": score.cast("int"),
        "bias": F.when(score >= 2, F.lit("bullish")).when(score <= -2, F.lit("bearish"))
        .otherwise(F.lit("consolidating")),
    })


def trailing_period(prices: DataFrame, months: int = 12, key: str = "ticker", order: str = "dt") -> DataFrame:
    """Keep each ticker's last ``months`` months (``period='1y'``), relative to its latest date.

    The latest date per ticker is a partial aggregate joined back (AQE broadcasts
    it when small), not a whole-ticker window; the prices are read once for both.
    """
    prices = shared(prices)
    last = prices.groupBy(key).agg(F.max(order).alias("_last"))
    return (prices.join(last, key)
            .where(F.col(order) >= F.add_months(F.col("_last"), -months))
            .drop("_last"))
