"""Request texts from templates (X14): templates are data, placeholders are checked, tables are rendered blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.operators import text_render as TR

PLACEHOLDER = re.compile(r"\{(\w+)\}")

#: Kind of request -> its lines, with {field} in place of a formatted value or of a rendered table.
TEMPLATES = {
    "screener": ("Would you put company {ticker} ({name}, sector {sector}) on a list of steady companies?", "Market value: {market_cap}", "Answer with a table: Symbol | Company Name | Rationale."),
    "final_table": ("Company {ticker} has made the list. Write its line of the final table.", "Name: {name}", "Sector: {sector}", "Columns: Symbol | Company Name | Rationale, one line per reason."),
    "technical": ("Read the chart of company {ticker}.", "Latest closes:", "{closes_table}", "Say whether the trend is up, down or sideways, and where support and resistance lie."),
    "valuation": ("Value company {ticker} by its free cash flows.", "Growth after the horizon: {terminal_growth_rate}", "EBITDA multiple at exit: {exit_multiple}",
                  "Discount rate: {wacc}", "Net debt: {net_debt}", "Shares: {shares_outstanding}", "Free cash flows and their present values:", "{yearly_table}"),
    "discount_rate": ("Check the discount rate of company {ticker}.", "Cost of capital computed here: {wacc}", "Reply with one number."),
    "drivers": ("Forecast revenue, margins and investment of company {ticker} for five years.", "The forecast so far:", "{yearly_table}", "Reply with one list of five numbers per driver."),
}


def field_values() -> dict[str, Column]:
    """The formatted value of each field, from the columns of a parameter row."""
    c = F.col
    return {
        "ticker": c("ticker").cast("string"), "name": TR.fmt_or(c("name"), c("name")), "sector": TR.fmt_or(c("sector"), c("sector")),
        "market_cap": TR.fmt_or(c("market_cap"), TR.fmt_money(c("market_cap"))),
        "terminal_growth_rate": TR.fmt_or(c("terminal_growth_rate"), TR.fmt_pct(c("terminal_growth_rate"))),
        "exit_multiple": TR.fmt_or(c("exit_multiple"), TR.fmt_mult(c("exit_multiple"))), "wacc": TR.fmt_or(c("wacc"), TR.fmt_pct(c("wacc"))),
        "net_debt": TR.fmt_or(c("net_debt"), TR.fmt_money(c("net_debt"))),
        "shares_outstanding": TR.fmt_or(c("shares_outstanding"), F.format_number(c("shares_outstanding"), 0)),
    }


def request_texts(params: DataFrame, tables: dict[str, DataFrame] | None = None, templates: dict[str, tuple[str, ...]] = TEMPLATES,
                  values: dict[str, Column] | None = None, key: str = "ticker") -> DataFrame:
    """``key, template, request``: one row per parameter row and template.

    ``tables`` are frames (key, text) with one row per key, by placeholder.  A field or table without value reads NOT PROVIDED.
    A placeholder that is neither a field nor a table is an error that names it.  Values are set in once: braces in
    them stay as they are.
    """
    values, tables = dict(field_values() if values is None else values), tables or {}
    wanted = {name: PLACEHOLDER.findall("\n".join(lines)) for name, lines in templates.items()}
    unknown = sorted({f"{name}: {field}" for name, fields in wanted.items() for field in fields if field not in values and field not in tables})
    if unknown:
        raise ValueError(f"placeholders without a value: {unknown}")
    for field in sorted({f for fields in wanted.values() for f in fields} & set(tables)):
        block = tables[field].select(F.col(key).alias("_k"), F.col("text").alias(f"_t_{field}"))
        params = params.join(block, F.col(key) == F.col("_k"), "left").drop("_k")
        values[field] = F.coalesce(F.col(f"_t_{field}"), F.lit(TR.NOT_PROVIDED))
    texts = []
    for name, lines in templates.items():
        parts = PLACEHOLDER.split("\n".join(lines))  # text, field, text, ...
        texts.append(F.struct(F.lit(name).alias("template"), F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]).alias("request")))
    return params.select(key, F.explode(F.array(*texts)).alias("t")).select(key, "t.template", "t.request")
