"""Indicators against pandas rolling/ewm, including series cut into several blocks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equiflow.operators import technical as T


def _pandas_reference(close: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame({"close": close})
    out["sma_20"] = close.rolling(20).mean()
    out["sma_50"] = close.rolling(50).mean()
    d = close.diff()
    gain, loss = d.where(d > 0, 0), -d.where(d < 0, 0)
    ag = gain.ewm(com=13, min_periods=14).mean()
    al = loss.ewm(com=13, min_periods=14).mean()
    out["rsi"] = 100 - 100 / (1 + ag / al)
    e12 = close.ewm(span=12, adjust=False).mean()
    e26 = close.ewm(span=26, adjust=False).mean()
    out["macd"] = e12 - e26
    out["macd_signal"] = out["macd"].ewm(span=9, adjust=False).mean()
    out["macd_hist"] = out["macd"] - out["macd_signal"]
    return out


@pytest.fixture(scope="module")
def long_series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for t, n in ((1, 4000), (2, 2600), (3, 30)):
        c = 100 + np.cumsum(rng.normal(0, 1, n))
        d0 = dt.date(1990, 1, 1)
        rows += [(t, d0 + dt.timedelta(days=k), float(c[k])) for k in range(n)]
    return spark.createDataFrame(rows, "ticker long, dt date, close double"), rows


@pytest.mark.parametrize("block_rows", [2 * T.EWM_ROWS, 3 * T.EWM_ROWS, T.BLOCK_ROWS])
def test_indicators_match_pandas_across_blocks(spark, long_series, block_rows):
    df, rows = long_series
    got = (T.technical_indicators(df, dropna=False, block_rows=block_rows)
           .orderBy("ticker", "dt").toPandas())
    pdf = pd.DataFrame(rows, columns=["ticker", "dt", "close"])
    for t, g in pdf.groupby("ticker"):
        ref = _pandas_reference(g["close"].reset_index(drop=True))
        mine = got[got.ticker == t].reset_index(drop=True)
        assert len(mine) == len(ref)
        for c in T.INDICATOR_COLUMNS:
            a, b = mine[c].to_numpy(dtype=float), ref[c].to_numpy(dtype=float)
            assert np.array_equal(np.isnan(a), np.isnan(b)), c
            m = ~np.isnan(a)
            assert np.allclose(a[m], b[m], rtol=1e-9, atol=1e-9), c


def test_rsi_flat_and_rising(spark):
    rows = [(1, dt.date(2000, 1, 1) + dt.timedelta(days=k), 5.0) for k in range(20)]
    rows += [(2, dt.date(2000, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "ticker long, dt date, close double")
    out = T.technical_indicators(df, dropna=False).orderBy("ticker", "dt").toPandas()
    flat, rising = out[out.ticker == 1], out[out.ticker == 2]
    assert flat["rsi"].isna().all()
    assert rising["rsi"].iloc[:13].isna().all()
    assert (rising["rsi"].iloc[13:] == 100.0).all()


def test_ewm_span3_recursive(spark):
    from equiflow.operators.ewm import ewm_frame
    from equiflow.operators.series import drop_halo, series_index, with_blocks

    df = spark.createDataFrame([(1, dt.date(2000, 1, k + 1), v) for k, v in enumerate([1.0, 2.0, 4.0])],
                               "ticker long, dt date, x double")
    b = with_blocks(series_index(df), halo=61, block_rows=120)
    out = drop_halo(ewm_frame(b, {"y": (F.col("x"), 0.5, False, 0)}, 60, 120)).orderBy("dt")
    assert [r.y for r in out.collect()] == [1.0, 1.5, 2.75]


def test_sma_short_series_is_null(spark):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1) + dt.timedelta(days=k), 1.0) for k in range(19)],
                               "ticker long, dt date, close double")
    out = T.technical_indicators(df, dropna=False)
    assert out.where(F.col("sma_20").isNotNull()).count() == 0


def _series(spark, closes):
    d0 = dt.date(1990, 1, 1)
    return spark.createDataFrame([(1, d0 + dt.timedelta(days=k), float(c)) for k, c in enumerate(closes)], "ticker long, dt date, close double")


@pytest.mark.parametrize("block_rows", [2 * T.EWM_ROWS, T.BLOCK_ROWS])
def test_rsi_keeps_old_gains_over_a_long_flat_stretch(spark, block_rows):
    rng = np.random.default_rng(3)
    closes = np.r_[100 + np.cumsum(rng.normal(0, 1, 60)), np.full(1600, 100.0)]
    got = T.technical_indicators(_series(spark, closes), dropna=False, block_rows=block_rows).orderBy("dt").toPandas()
    ref = _pandas_reference(pd.Series(closes))
    assert np.array_equal(got["rsi"].isna(), ref["rsi"].isna())
    m = ~ref["rsi"].isna()
    assert np.allclose(got["rsi"][m].astype(float), ref["rsi"][m], rtol=1e-7)


@pytest.mark.parametrize("block_rows", [2 * T.EWM_ROWS, T.BLOCK_ROWS])
def test_flat_series_has_no_signal(spark, block_rows):
    b = T.blocked_prices(_series(spark, np.full(1300, 5.1)).withColumns({"low": F.lit(5.1), "high": F.lit(5.1)}), block_rows=block_rows)
    out = T.drop_halo(T.price_action(T.macd_signal(T.trend_signal(T.indicators(b, block_rows=block_rows))))).toPandas()
    assert (out["macd"] == 0).all() and (out["macd_hist"] == 0).all()
    assert out["macd_cross"].isna().all() and out["ma_cross"].isna().all()
    assert set(out["hist_direction"].dropna()) == {"flat"} and set(out["trend"].dropna()) == {"sideways"}
    assert set(out["bias"]) == {"consolidating"}


def test_rows_without_key_date_or_close_are_rejects(spark):
    day = dt.date(2000, 1, 1)
    df = spark.createDataFrame([(1, day, 1.0), (1, None, 1.0), (1, day, None), (None, day, 1.0)], "ticker long, dt date, close double")
    good, bad = T.quarantine(df)
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no close", "no date", "no ticker"]
