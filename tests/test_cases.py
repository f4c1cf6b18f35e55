"""Hand-made cases of FIXTURES.md §3 and the semantics ledger (small literal frames)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from equiflow.operators import screening as S
from equiflow.operators import text_parse as TP
from equiflow.operators import valuation as V
from equiflow.operators.fundamentals import merge_statements


def test_vote_tie_first_appearance(spark):
    # B,A,A,B,C,D -> B, A, C  (Counter.most_common ties by first appearance)
    rows = [(0, 1, i, s) for i, s in enumerate("BAABCD")]
    t = spark.createDataFrame(rows, "request_id int, reply_id long, line_no int, symbol string")
    top = S.top_voted(S.count_votes(t), 3).orderBy("rank")
    assert [r.symbol for r in top.collect()] == ["B", "A", "C"]


def test_outer_merge_collision_suffixes(spark):
    a = spark.createDataFrame([(1, dt.date(2020, 1, 1), 1.0)], "ticker long, dt date, X double")
    b = spark.createDataFrame([(1, dt.date(2021, 1, 1), 2.0)], "ticker long, dt date, X double")
    c = spark.createDataFrame([(1, dt.date(2021, 1, 1), 3.0)], "ticker long, dt date, Y double")
    m = merge_statements(a, b, c).orderBy("dt")
    assert m.columns == ["ticker", "dt", "X_x", "X_y", "Y"]
    assert [r.dt for r in m.collect()] == [dt.date(2020, 1, 1), dt.date(2021, 1, 1)]


def _fund(spark, rows):
    return spark.createDataFrame(rows, "ticker long, dt date, tax_provision double, pretax_income double")


def test_tax_rate_default_and_strict(spark):
    f = _fund(spark, [(1, dt.date(2020, 12, 31), 10.0, None)])  # pretax 0 already turned NULL
    assert V.tax_rate(f).first().tax_rate == 0.2
    assert V.tax_rate(f, strict=True).first().tax_rate is None


def test_tax_cap_in_wacc_not_in_v01(spark):
    f = _fund(spark, [(1, dt.date(2020, 12, 31), 40.0, 100.0)])
    assert V.tax_rate(f).first().tax_rate == pytest.approx(0.40)
    lm = f.withColumns({"market_cap": F.lit(100.0), "total_debt": F.lit(50.0), "interest_expense": F.lit(5.0),
                        "beta": F.lit(None).cast("double")})
    w = V.wacc(lm).first()
    assert w.corporate_tax_rate == pytest.approx(0.25)
    assert w.cost_of_equity == pytest.approx(0.10)  # beta NULL -> 1.0: 0.045 + 0.055


def test_beta_zero_is_market(spark):
    lm = spark.createDataFrame([(1, 100.0, 50.0, 0.0, None, None, None)],
                               "ticker long, market_cap double, total_debt double, beta double, "
                               "interest_expense double, tax_provision double, pretax_income double")
    assert V.wacc(lm).first().cost_of_equity == pytest.approx(0.10)


def _dcf(spark, wacc):
    drivers = spark.createDataFrame([(1, k, 100.0, 0.0, 0.0, 0.0) for k in range(1, 6)],
                                    "ticker long, step int, ebit double, capex double, d_and_a double, wc_change double")
    params = spark.createDataFrame([(1, dt.date(2024, 12, 31), wacc, 0.025, 10.0, 50.0, 10.0, None)],
                                   "ticker long, base_dt date, wacc double, terminal_growth_rate double, "
                                   "exit_multiple double, net_debt double, shares_outstanding double, ebitda double")
    tax = spark.createDataFrame([(1, 0.0)], "ticker long, tax_rate double")
    y = V.dcf_yearly(drivers, params, tax)
    eg = spark.createDataFrame([(1, None)], "ticker long, avg_growth double")
    return y, V.valuation(y, params, eg).first()


def test_dcf_golden_numbers(spark):
    y, v = _dcf(spark, 0.10)
    assert v.pv_sum == pytest.approx(379.0787, abs=1e-4)
    assert v.terminal_value == pytest.approx(1366.6667, abs=1e-4)
    assert v.terminal_value_pv == pytest.approx(848.5924, abs=1e-4)
    assert v.enterprise_value == pytest.approx(1227.6711, abs=1e-4)
    assert v.equity_value == pytest.approx(1177.6711, abs=1e-4)
    assert v.implied_share_price == pytest.approx(117.7671, abs=1e-4)
    last = y.orderBy(F.col("step").desc()).first()
    assert last.cumulative_pv == pytest.approx(v.pv_sum)  # last cumulative PV = sum
    assert v.equity_value + 50.0 == pytest.approx(v.enterprise_value)


def test_dcf_wacc_below_growth(spark):
    _, v = _dcf(spark, 0.02)
    assert v.terminal_value_gordon is None and v.wacc_le_g


def test_forecast_list_and_growth_sign(spark):
    df = spark.createDataFrame([(1, "Forecast: [1, 2.5,3]\nEBIT Growth Rate: -5%")], "ticker long, text string")
    out = TP.explode_forecast(df, ["ticker"]).orderBy("step").collect()
    assert [r.value for r in out] == [1.0, 2.5, 3.0] and not out[0].complete
    g = df.select(TP.parse_growth(F.col("text"), "EBIT Growth Rate").alias("g"),
                  TP.parse_growth(F.col("text"), "EBIT Growth Rate", strict=True).alias("s")).first()
    assert g.g == pytest.approx(-0.05) and g.s is None


def test_pipe_table_edge_cases(spark):
    df = spark.createDataFrame([
        (1, "| a | b | c |\n|---|---|---|\n| 1 |  | 3 |\n| 4 | 5 | 6 |"),
        (2, "| a | b |\n|---|---|"),
    ], "id int, text string")
    cells = TP.parse_pipe_table(df, ["id"]).collect()
    assert {r.id for r in cells} == {1}
    assert sorted((r.header, r.cell) for r in cells) == [("a", "4"), ("b", "5"), ("c", "6")]


def test_csv_reply_with_fence_and_prose(spark):
    body = "\n".join(f"{2025 + k},{k}.5" for k in range(5))
    df = spark.createDataFrame([(1, f"Sure!\n```csv\nYear,FCF\n{body}\n```\nThat is all.")], "id int, text string")
    out = TP.extract_csv(df, ["id"], "Year,FCF", "year INT, fcf DOUBLE").collect()
    assert len(out) == 5 and out[0].year == 2025
