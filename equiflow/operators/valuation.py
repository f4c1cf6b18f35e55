"""Cost of capital and discounted-cash-flow valuation.

Every function works on all tickers at once.  Per-ticker parameter rows
(``dcf_parameters``) are one row per ticker; the yearly DCF is
``tickers x horizon`` rows made by ``explode(sequence(1, horizon))``.  The
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiflow.functions.safe import div
from equiflow.operators.periods import avg_growth, latest, pick_period

# Assumptions of the reference (rates as fractions).
RISK_FREE = 0.045
MARKET_PREMIUM = 0.055
DEFAULT_BETA = 1.0
DEFAULT_COST_OF_DEBT = 0.05
DEFAULT_CORP_TAX = 0.21
CORP_TAX_CAP = 0.25
DEFAULT_TAX_RATE = 0.2
TERMINAL_GROWTH = 0.025
EXIT_MULTIPLE = 10.0
HORIZON = 5
SIMPLE_DISCOUNT = 0.08

DRIVERS = ("ebit", "capex", "d_and_a", "wc_change")


# ---- V01 / V02: tax rate and reported net debt from one picked period ----

def tax_rate(fund: DataFrame, pick: str = "latest", default: float = DEFAULT_TAX_RATE,
             strict: bool = False) -> DataFrame:
    """Effective tax = provision / pretax on the picked period (Q2, Q5).

    Default: 0.2 whenever the ratio is not computable (the intent); ``strict``
    reproduces the code, where zeros were already NULL so the result is NULL.
    """
    row = pick_period(fund.select("ticker", "dt", "tax_provision", "pretax_income"), pick)
    t = div("tax_provision", "pretax_income")
    return row.select("ticker", (t if strict else F.coalesce(t, F.lit(default))).alias("tax_rate"))


def net_debt_reported(fund: DataFrame, pick: str = "latest") -> DataFrame:
    """Reported Net_Debt of the picked period."""
    return pick_period(fund.select("ticker", "dt", "net_debt"), pick).select("ticker", "net_debt")


# ---- V03-V05: capital base, WACC and the parameter row ----

def attach_market(fund: DataFrame, info: DataFrame) -> DataFrame:
    """Latest fundamentals per ticker with its market info (left join)."""
    return latest(fund).join(info, "ticker", "left")


def capital_base(lm: DataFrame) -> DataFrame:
    """Net debt = total debt - cash (missing cash = 0), else reported net debt (Q10);
    shares = market shares outstanding, else ordinary shares number (Q11)."""
    c = F.col
    return lm.withColumns({
        "calc_net_debt": F.when(c("total_debt").isNotNull(),
                                c("total_debt") - F.coalesce(c("cash_and_cash_equivalents"), F.lit(0.0)))
        .otherwise(c("net_debt")),
        "calc_shares": F.coalesce(c("shares_outstanding"), c("ordinary_shares_number")),
    })


def beta_or_market(beta: Column) -> Column:
    """Q7: a beta that is missing or zero is the market's."""
    return F.when(beta.isNull() | (beta == 0), F.lit(DEFAULT_BETA)).otherwise(beta)


def cost_of_equity(beta: Column, rf: float = RISK_FREE, mrp: float = MARKET_PREMIUM) -> Column:
    """CAPM."""
    return F.lit(rf) + beta_or_market(beta) * F.lit(mrp)


def wacc(lm: DataFrame, rf: float = RISK_FREE, mrp: float = MARKET_PREMIUM) -> DataFrame:
    """V04a-e: market weights, CAPM, cost of debt, capped corporate tax and WACC.

    The breakdown columns are NULL when total capital is not positive, as in
    the reference, where the breakdown stops there.
    """
    c = F.col
    e = F.when(c("market_cap") > 0, c("market_cap"))
    d = c("total_debt")
    v = e + d
    ok = v.isNotNull() & (v > 0)
    rd = F.when(d.isNotNull() & (d > 0) & c("interest_expense").isNotNull(), div("interest_expense", d)) \
        .otherwise(F.lit(DEFAULT_COST_OF_DEBT))
    tc_raw = div("tax_provision", "pretax_income")
    tc = (F.when(tc_raw.isNull(), F.lit(DEFAULT_CORP_TAX))
          .when(tc_raw > 0, F.least(tc_raw, F.lit(CORP_TAX_CAP)))
          .otherwise(F.lit(0.0)))
    out = lm.withColumns({
        "market_value_equity": e,
        "market_value_debt": d,
        "total_capital": v,
        "wacc_beta": F.when(ok, beta_or_market(c("beta"))),
        "cost_of_equity": F.when(ok, cost_of_equity(c("beta"), rf, mrp)),
        "cost_of_debt": F.when(ok, rd),
        "corporate_tax_rate": F.when(ok, tc),
    })
    e_, d_, v_ = c("market_value_equity"), c("market_value_debt"), c("total_capital")
    w = (e_ / v_) * c("cost_of_equity") + (d_ / v_) * c("cost_of_debt") * (F.lit(1.0) - c("corporate_tax_rate"))
    return out.withColumn("wacc", F.when(ok & e_.isNotNull() & d_.isNotNull(), w))


def dcf_parameters(fund: DataFrame, info: DataFrame, g: float = TERMINAL_GROWTH,
                   multiple: float = EXIT_MULTIPLE) -> DataFrame:
    """One parameter row per ticker (growth, multiple, WACC, net debt, shares, breakdown)."""
    lm = wacc(capital_base(attach_market(fund, info)))
    return lm.select(
        "ticker",
        F.col("dt").alias("base_dt"),
        F.lit(g).alias("terminal_growth_rate"),
        F.lit(multiple).alias("exit_multiple"),
        "wacc",
        F.col("calc_net_debt").alias("net_debt"),
        F.col("calc_shares").alias("shares_outstanding"),
        F.struct("market_value_equity", "market_value_debt", "total_capital", F.col("wacc_beta").alias("beta"),
                 "cost_of_equity", "cost_of_debt", "corporate_tax_rate").alias("wacc_breakdown"),
        "ebitda",
    )


# ---- V14 / V15 / V19: driver forecasts ----

def driver_history(fund: DataFrame) -> DataFrame:
    """Long driver history (ticker, dt, driver, value); EBIT falls back to operating income."""
    wide = fund.select(
        "ticker", "dt",
        F.coalesce("ebit", "operating_income").alias("ebit"),
        F.col("capital_expenditure").alias("capex"),
        F.col("depreciation_and_amortization").alias("d_and_a"),
        F.col("change_in_working_capital").alias("wc_change"),
    )
    return (wide.unpivot(["ticker", "dt"], list(DRIVERS), "driver", "value")
            .where(F.col("value").isNotNull()))


def _horizon(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def growth_forecast(hist: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Latest value grown at its average historical growth; constant under two points."""
    g = avg_growth(hist, "value", key=["ticker", "driver"])
    rate = F.coalesce(F.col("avg_growth"), F.lit(0.0))
    return _horizon(g, horizon).select(
        "ticker", "driver", F.col("step").cast("int").alias("step"),
        (F.col("last_value") * F.pow(F.lit(1.0) + rate, F.col("step"))).alias("value"),
    )


def constant_forecast(hist: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Latest value held constant over the horizon (``[x] * len(years)``)."""
    last = (hist.groupBy("ticker", "driver")
            .agg(F.max_by(F.col("value"), F.col("dt")).alias("value")))
    return _horizon(last, horizon).select("ticker", "driver", F.col("step").cast("int").alias("step"), "value")


def zip_drivers(forecast: DataFrame, drivers: tuple[str, ...] = DRIVERS) -> DataFrame:
    """One row per (ticker, step) with all drivers; steps missing a driver are dropped (Q16)."""
    wide = (forecast.groupBy("ticker", "step").pivot("driver", list(drivers))
            .agg(F.first("value")))
    return wide.na.drop("any", subset=list(drivers))


# ---- V06-V13: FCF, discounting, terminal value, bridge, tables ----

def discount(cf: Column, rate: Column, period: Column) -> Column:
    """Present value ``cf / (1 + r)^t``."""
    return cf / F.pow(F.lit(1.0) + rate, period)


def dcf_yearly(drivers: DataFrame, params: DataFrame, tax: DataFrame, base_year: Column | None = None) -> DataFrame:
    """V07 + V08 + W15 + J06: FCF per year, its PV and the running PV per ticker."""
    c = F.col
    y = (drivers.join(params.select("ticker", "wacc", "base_dt"), "ticker")
         .join(tax, "ticker", "left"))
    fcf = c("ebit") * (F.lit(1.0) - c("tax_rate")) - c("capex") - c("wc_change") + c("d_and_a")
    y = y.withColumns({
        "year": ((F.year("base_dt") if base_year is None else base_year) + c("step")).cast("int"),
        "fcf": fcf,
    })
    y = y.withColumn("discounted_fcf", discount(c("fcf"), c("wacc"), c("step")))
    w = Window.partitionBy("ticker").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return y.withColumn("cumulative_pv", F.sum("discounted_fcf").over(w))


def terminal_gordon(fcf_last: Column, g: Column, rate: Column, n: Column) -> tuple[Column, Column]:
    """Gordon terminal value and its PV; NULL when WACC <= g (Q14)."""
    tv = F.when(rate > g, fcf_last * (F.lit(1.0) + g) / (rate - g))
    return tv, tv / F.pow(F.lit(1.0) + rate, n)


def terminal_exit(ebitda: Column, growth_: Column, multiple: Column, rate: Column, n: Column) -> tuple[Column, Column]:
    """Exit-multiple terminal value on EBITDA grown at its average growth (else constant)."""
    tv = ebitda * F.pow(F.lit(1.0) + F.coalesce(growth_, F.lit(0.0)), n) * multiple
    return tv, tv / F.pow(F.lit(1.0) + rate, n)


def valuation(yearly: DataFrame, params: DataFrame, ebitda_growth: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Terminal values, EV (Gordon preferred, exit multiple otherwise), equity, price."""
    c = F.col
    agg = yearly.groupBy("ticker").agg(
        F.sum("discounted_fcf").alias("pv_sum"),
        F.max_by(c("fcf"), c("step")).alias("fcf_last"),
        F.count(F.lit(1)).alias("n_years"),
    )
    v = (agg.join(params, "ticker")
         .join(ebitda_growth.select("ticker", c("avg_growth").alias("ebitda_growth")), "ticker", "left"))
    n = F.lit(horizon)
    tv_g, tv_g_pv = terminal_gordon(c("fcf_last"), c("terminal_growth_rate"), c("wacc"), n)
    tv_x, tv_x_pv = terminal_exit(c("ebitda"), c("ebitda_growth"), c("exit_multiple"), c("wacc"), n)
    v = v.withColumns({
        "complete": c("n_years") == horizon,
        "wacc_le_g": c("wacc") <= c("terminal_growth_rate"),
        "terminal_value_gordon": tv_g, "terminal_value_gordon_pv": tv_g_pv,
        "terminal_value_exit": tv_x, "terminal_value_exit_pv": tv_x_pv,
    })
    v = v.withColumns({
        "terminal_value": F.coalesce(c("terminal_value_gordon"), c("terminal_value_exit")),
        "terminal_value_pv": F.coalesce(c("terminal_value_gordon_pv"), c("terminal_value_exit_pv")),
    })
    v = v.withColumn("enterprise_value", c("pv_sum") + c("terminal_value_pv"))
    v = v.withColumn("equity_value", c("enterprise_value") - c("net_debt"))
    return v.withColumn("implied_share_price", div("equity_value", "shares_outstanding"))


def run_dcf(universe: DataFrame, gate: DataFrame, valued: DataFrame) -> DataFrame:
    """Every ticker of the universe with its valuation or the reason why there is none (``status``).

    ``gate``: tickers with all statements (S11); ``valued``: ``valuation`` rows (tickers that lack a driver have none).
    """
    v = valued.select(F.col("ticker").alias("_t"), "complete", "implied_share_price")
    out = universe.join(gate.select("ticker", F.lit(True).alias("_ok")), "ticker", "left").join(v, F.col("ticker") == F.col("_t"), "left")
    ok = F.coalesce("_ok", F.lit(False))
    status = (F.when(~ok, "statement missing").when(F.col("_t").isNull() | ~F.col("complete"), "driver missing")
              .when(F.col("implied_share_price").isNull(), "no price").otherwise("valued"))
    return out.select("ticker", status.alias("status"), F.when(ok, F.col("implied_share_price")).alias("implied_share_price"))


SUMMARY_METRICS = (
    ("WACC", "wacc"), ("Net Debt", "net_debt"), ("Terminal Value", "terminal_value"),
    ("Terminal Value (PV)", "terminal_value_pv"), ("Enterprise Value", "enterprise_value"),
    ("Equity Value", "equity_value"), ("Implied Share Price", "implied_share_price"),
)


def dcf_summary(val: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """label/value rows per ticker (``stack``); Q15: both TV and its PV are emitted."""
    digits = digits or {}
    pairs = [F.struct(F.lit(label).alias("metric"), F.round(F.col(c), digits.get(c, 2)).alias("value"))
             for label, c in SUMMARY_METRICS]
    return val.select("ticker", F.explode(F.array(*pairs)).alias("m")).select("ticker", "m.metric", "m.value")


TABLE_METRICS = (
    ("EBIT", "ebit"), ("Tax Rate", "tax_rate"), ("D&A", "d_and_a"), ("Capex", "capex"),
    ("WC Change", "wc_change"), ("FCF", "fcf"), ("Discounted FCF", "discounted_fcf"),
    ("Cumulative PV", "cumulative_pv"),
)


def dcf_table(yearly: DataFrame, metrics=TABLE_METRICS, horizon: int = HORIZON, digits: int = 4) -> DataFrame:
    """Metrics as rows, horizon years as columns ``y1..yN`` (explicit pivot values)."""
    pairs = [F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for label, c in metrics]
    long = yearly.select("ticker", "step", F.explode(F.array(*pairs)).alias("m")).select(
        "ticker", "step", "m.metric", "m.value")
    wide = long.groupBy("ticker", "metric").pivot("step", list(range(1, horizon + 1))).agg(F.first("value"))
    return wide.select("ticker", "metric", *[F.round(F.col(str(k)), digits).alias(f"y{k}")
                                             for k in range(1, horizon + 1)])


def valuation_label(val: DataFrame, price: Column, band: float = 0.15) -> DataFrame:
    """Undervalued / overvalued / fair by implied-to-market upside beyond ``band``."""
    up = div(F.col("implied_share_price"), price) - F.lit(1.0)
    return val.withColumn("upside", up).withColumn(
        "valuation", F.when(up > band, F.lit("undervalued")).when(up < -band, F.lit("overvalued"))
        .when(up.isNotNull(), F.lit("fair")))
