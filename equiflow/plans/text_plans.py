"""Registered queries: reply parsing and text rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiflow.operators import requests as RQ
from equiflow.operators import text_parse as TP
from equiflow.operators import text_render as TR
from equiflow.operators import valuation as V
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.sources import fixtures as fx

# Labels and headers that replies carry.
EBIT_LABEL = "EBIT Growth Rate"
CSV_HEADER = "Year,Projected FCF,Present Value of FCF"
CSV_SCHEMA = "year INT, fcf DOUBLE, pv DOUBLE"
ROW3 = r"^\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|\s*([^|]*?)\s*\|"


def _yearly_text(spark, sf) -> DataFrame:
    """DCF yearly values rounded to cents and formatted, the input of the render/parse round trips."""
    from equiflow.plans.valuation_plans import _pipeline
    _, _, y, _ = _pipeline(spark, sf)
    def cents(c):
        return F.when(F.col(c).isNotNull(), F.format_string("%.2f", F.round(c, 2)))
    return y.select("ticker", "step", "year", cents("fcf").alias("fcf"), cents("discounted_fcf").alias("pv"))


def q_parse_forecast(spark, sf):
    return TP.explode_forecast(fx.forecast_replies(spark, sf), ["ticker"])


def q_forecast_rejects(spark, sf):
    return TP.forecast_rejects(fx.forecast_replies(spark, sf)).select("ticker", "text")


def q_parse_growth(spark, sf):
    t = F.col("text")
    return fx.forecast_replies(spark, sf).select(
        "ticker", TP.parse_growth(t, EBIT_LABEL).alias("growth"),
        TP.parse_growth(t, EBIT_LABEL, strict=True).alias("growth_strict"))


def q_parse_number(spark, sf):
    return fx.number_replies(spark, sf).select("ticker", TP.parse_number(F.col("text")).alias("value"))


def q_number_rejects(spark, sf):
    return TP.number_rejects(fx.number_replies(spark, sf))


def q_parse_pipe_table(spark, sf):
    return TP.parse_pipe_table(fx.replies(spark, sf), ["request_id", "reply_id"])


def q_render_csv(spark, sf):
    y = _yearly_text(spark, sf)
    return TR.render_csv(y, ["ticker"], "step", ["year", "fcf", "pv"], CSV_HEADER.split(","))


def q_extract_csv(spark, sf):
    """X05/X06 round trip: CSV rendered inside prose and a code fence, then parsed back."""
    csv = q_render_csv(spark, sf)
    return TP.extract_csv(_csv_replies(csv), ["ticker"], CSV_HEADER, CSV_SCHEMA)


def _csv_replies(csv: DataFrame) -> DataFrame:
    """CSV text as a model would send it: in prose and a fence, with a line in it that is no row."""
    return csv.select("ticker", F.concat(F.lit("Here is the table:\n```csv\n"), "text",
                                         F.lit("\ntotal of all years\n```\nHope this helps.")).alias("text"))


def q_csv_rejects(spark, sf):
    return TP.csv_rejects(_csv_replies(q_render_csv(spark, sf)), ["ticker"], CSV_HEADER, CSV_SCHEMA)


def q_render_pipe_table(spark, sf):
    return TR.render_pipe_table(_yearly_text(spark, sf), ["ticker"], "step", ["year", "fcf", "pv"])


def q_render_table(spark, sf):
    return TR.render_table(_yearly_text(spark, sf), ["ticker"], "step", ["year", "fcf", "pv"])


BREAKDOWN = {
    "Equity value": ("market_value_equity", TR.MONEY), "Debt value": ("market_value_debt", TR.MONEY),
    "Total capital": ("total_capital", TR.MONEY), "Beta": ("beta", TR.RATIO), "Cost of equity": ("cost_of_equity", TR.RATE),
    "Cost of debt": ("cost_of_debt", TR.RATE), "Tax rate": ("corporate_tax_rate", TR.RATE),
}


def q_render_breakdown(spark, sf):
    from equiflow.plans.valuation_plans import fund
    p = V.dcf_parameters(fund(spark, sf), fx.info(spark, sf)).select("ticker", "wacc_breakdown.*")
    return TR.render_breakdown(p, "ticker", BREAKDOWN)


def latest_closes(spark, sf, n: int = 5) -> DataFrame:
    """The last ``n`` closes of each ticker as text, in order."""
    last = Window.partitionBy("ticker").orderBy(F.desc("dt"))  # limited to n rows a ticker before it is dealt
    rows = fx.prices(spark, sf).select("ticker", "dt", "close").withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n)
    cents = F.floor(F.col("close") * 100 + 0.5).cast("long")
    text = F.format_string("%d.%02d", F.floor(cents / 100).cast("long"), F.pmod(cents, F.lit(100)))
    return rows.select("ticker", (n - F.col("rn")).alias("pos"), F.col("dt").cast("string").alias("dt"), text.alias("close"))


def q_render_requests(spark, sf):
    """The six kinds of request texts of every ticker from its parameter row, with rendered tables in them."""
    from equiflow.plans.valuation_plans import fund
    info = fx.info(spark, sf)
    params = V.dcf_parameters(fund(spark, sf), info).join(info.select("ticker", "name", "sector", "market_cap"), "ticker", "left")
    return RQ.request_texts(params, {"yearly_table": q_render_table(spark, sf), "closes_table": TR.render_table(latest_closes(spark, sf), ["ticker"], "pos", ["dt", "close"])})


def q_to_html_rows(spark, sf):
    keys = ["request_id", "reply_id"]
    return TR.to_html_rows(TP.table_parts(fx.replies(spark, sf), keys), keys)


def q_explode_bullets(spark, sf):
    """Company rows with their rationale bullets (a row without symbol belongs to the symbol above).

    The table is found by its separator line; rows before it are no company rows.
    """
    return TR.explode_bullets(TR.bullet_groups(fx.replies(spark, sf), ["reply_id"], ROW3), ["reply_id"]).drop("more")


def q_table_profile(spark, sf):
    p = TR.profile(fx.prices(spark, sf), ["close", "high", "low", "volume"])
    return p.select("column", "count", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"),
                    "min", "p25", "p50", "p75", "max")


QUERIES = {
    "parse_forecast": q_parse_forecast,
    "forecast_rejects": q_forecast_rejects,
    "parse_growth": q_parse_growth,
    "parse_number": q_parse_number,
    "number_rejects": q_number_rejects,
    "csv_rejects": q_csv_rejects,
    "parse_pipe_table": q_parse_pipe_table,
    "render_csv": q_render_csv,
    "extract_csv": q_extract_csv,
    "render_pipe_table": q_render_pipe_table,
    "render_table": q_render_table,
    "render_breakdown": q_render_breakdown,
    "render_requests": q_render_requests,
    "to_html_rows": q_to_html_rows,
    "explode_bullets": q_explode_bullets,
    "table_profile": q_table_profile,
}

# ---------------------------------------------------------------- oracle ----


def _yearly_ctes():
    from equiflow.plans.valuation_plans import _DCF
    return _DCF + ("""yt AS (SELECT ticker, step, CAST(year AS VARCHAR) AS year, printf('%.2f', ROUND(fcf, 2)) AS fcf,
  printf('%.2f', ROUND(discounted_fcf, 2)) AS pv FROM yr)""",)


_YFX = ["v_income", "v_balance", "v_cashflow", "v_info"]
_FC = """fl AS (SELECT ticker, string_split(regexp_extract(text, 'Forecast:\\s*\\[(.*?)\\]', 1), ',') AS l,
  regexp_extract(text, 'Forecast:\\s*\\[(.*?)\\]', 1) AS body, text FROM v_forecast_replies)"""
_CSV = """csv AS (SELECT ticker, 'Year,Projected FCF,Present Value of FCF' || chr(10)
  || string_agg(year || ',' || COALESCE(fcf, '') || ',' || COALESCE(pv, ''), chr(10) ORDER BY step) AS text
  FROM yt GROUP BY ticker)"""
_PT = """tl AS (SELECT request_id, reply_id, list_filter(string_split(trim(text, {WS}), chr(10)),
   lambda l: contains(l, '|')) AS t FROM v_replies),
hd AS (SELECT request_id, reply_id, t,
   list_filter(list_transform(string_split(t[1], '|'), lambda c: trim(c, {WS})),
   lambda c: c <> '') AS h FROM tl WHERE len(t) >= 3),
rw AS (SELECT request_id, reply_id, h, g.i - 1 AS row_no,
   list_filter(list_transform(string_split(t[g.i], '|'), lambda c: trim(c, {WS})),
   lambda c: c <> '') AS c FROM hd, generate_series(3, len(t)) AS g(i)),
pt AS (SELECT request_id, reply_id, CAST(row_no AS INTEGER) AS row_no, CAST(k.j - 1 AS INTEGER) AS col_no,
   h[k.j] AS header, c[k.j] AS cell FROM rw, generate_series(1, len(h)) AS k(j) WHERE len(c) = len(h))""".replace(
    "{WS}", "' ' || " + " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 160)))  # the white space that the fixture holds
_W = """wd AS (SELECT ticker, step, year, fcf, pv,
  CAST(GREATEST(MAX(length(year)) OVER (PARTITION BY ticker), 4) AS INTEGER) AS wy,
  CAST(GREATEST(MAX(length(fcf)) OVER (PARTITION BY ticker), 3) AS INTEGER) AS wf,
  CAST(GREATEST(MAX(length(pv)) OVER (PARTITION BY ticker), 2) AS INTEGER) AS wp
  FROM (SELECT ticker, step, year, COALESCE(fcf, '{NULL}') AS fcf, COALESCE(pv, '{NULL}') AS pv FROM yt) z)"""

ORACLE = {
    "parse_forecast": with_fixtures(["v_forecast_replies"], _FC, body="""
SELECT ticker, CAST(g.i AS INTEGER) AS step, TRY_CAST(regexp_replace(l[g.i], '^\\s+|\\s+$', '', 'g') AS DOUBLE) AS value,
  len(l) = 5 AS complete FROM fl, generate_series(1, len(l)) AS g(i) WHERE body <> ''"""),
    "forecast_rejects": with_fixtures(["v_forecast_replies"], _FC, body="""
SELECT ticker, text FROM fl WHERE body = ''
  OR len(list_filter(l, lambda x: TRY_CAST(regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS DOUBLE) IS NULL)) > 0"""),
    "parse_growth": with_fixtures(["v_forecast_replies"], body="""
SELECT ticker,
  TRY_CAST(NULLIF(regexp_extract(text, 'EBIT Growth Rate:\\s*([+-]?\\d+\\.?\\d*)%', 1), '') AS DOUBLE) / 100.0 AS growth,
  TRY_CAST(NULLIF(regexp_extract(text, 'EBIT Growth Rate:\\s*([\\d.]+)%', 1), '') AS DOUBLE) / 100.0 AS growth_strict
FROM v_forecast_replies"""),
    "parse_number": with_fixtures(["v_number_replies"], body="""
SELECT ticker, CASE WHEN ticker % 8 IN (0, 1, 2, 3, 4) THEN TRY_CAST(regexp_extract(text, '[0-9.eE+-]+', 0) AS DOUBLE) END AS value
FROM v_number_replies"""),
    "number_rejects": with_fixtures(["v_number_replies"], body="""
SELECT ticker, text FROM v_number_replies WHERE ticker % 8 NOT IN (0, 1, 2, 3, 4)"""),
    "csv_rejects": with_fixtures(_YFX, *_yearly_ctes(), body="""
SELECT ticker, CAST(COUNT(*) + 1 AS INTEGER) AS row_no, 'total of all years' AS line FROM yt GROUP BY ticker"""),
    "parse_pipe_table": with_fixtures(["v_replies"], _PT, body="SELECT * FROM pt"),
    "render_csv": with_fixtures(_YFX, *_yearly_ctes(), _CSV, body="SELECT ticker, text FROM csv"),
    "extract_csv": with_fixtures(_YFX, *_yearly_ctes(), body="""
SELECT ticker, CAST(step AS INTEGER) AS row_no, CAST(year AS INTEGER) AS year, CAST(fcf AS DOUBLE) AS fcf,
  CAST(pv AS DOUBLE) AS pv FROM yt"""),
    "render_pipe_table": with_fixtures(_YFX, *_yearly_ctes(), _W.replace("{NULL}", ""), body="""
SELECT ticker, string_agg(line, chr(10) ORDER BY o) AS text FROM (
  SELECT ticker, o, line FROM (
    SELECT DISTINCT ticker, -2 AS o, '| ' || rpad('year', wy, ' ') || ' | ' || rpad('fcf', wf, ' ') || ' | '
      || rpad('pv', wp, ' ') || ' |' AS line FROM wd
    UNION ALL SELECT DISTINCT ticker, -1, '|' || repeat('-', wy + 2) || '|' || repeat('-', wf + 2) || '|'
      || repeat('-', wp + 2) || '|' FROM wd
    UNION ALL SELECT ticker, step, '| ' || rpad(year, wy, ' ') || ' | ' || rpad(fcf, wf, ' ') || ' | '
      || rpad(pv, wp, ' ') || ' |' FROM wd) u) x GROUP BY ticker"""),
    "render_table": with_fixtures(_YFX, *_yearly_ctes(), _W.replace("{NULL}", "NaN"), body="""
SELECT ticker, string_agg(line, chr(10) ORDER BY o) AS text FROM (
  SELECT DISTINCT ticker, -1 AS o, lpad('year', wy, ' ') || '  ' || lpad('fcf', wf, ' ') || '  '
    || lpad('pv', wp, ' ') AS line FROM wd
  UNION ALL SELECT ticker, step, lpad(year, wy, ' ') || '  ' || lpad(fcf, wf, ' ') || '  ' || lpad(pv, wp, ' ')
  FROM wd) x GROUP BY ticker"""),
    "table_profile": with_fixtures(["v_prices"], body="\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, "
        f"ROUND(STDDEV_SAMP({c}), 6) AS stddev, MIN({c}) AS min, "
        + "".join(f"LIST_SORT(LIST({c}))[CAST(CEIL({q} * COUNT({c})) AS BIGINT)] AS p{q * 100:.0f}, " for q in (0.25, 0.5, 0.75))
        + f" MAX({c}) AS max FROM v_prices"
        for c in ("close", "high", "low", "volume"))),
}


def _breakdown_sql() -> str:
    from equiflow.plans.valuation_plans import _F, _FX, _LM, _LT, _M, _RN, _W as WACC
    forms = {TR.RATE: "printf('%.2f%%', {c} * 100)", TR.MONEY: "'$' || format('{{:,.0f}}', {c})", TR.RATIO: "printf('%.2f', {c})"}
    parts = [f"SELECT ticker, CAST({pos} AS INTEGER) AS pos, '{label}: ' || CASE WHEN {c} IS NULL THEN 'N/A' ELSE {forms[kind].format(c=c)} END AS line FROM wc"
             for pos, (label, (c, kind)) in enumerate(BREAKDOWN.items())]
    return with_fixtures(_FX + ["v_info"], _M, _F, _RN, _LT, _LM, WACC, body="\nUNION ALL ".join(parts))


_CLOSES = ("""cl AS (SELECT ticker, CAST(dt AS VARCHAR) AS dt, CAST(CAST(FLOOR(close * 100 + 0.5) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(FLOOR(close * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS close,
  ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM v_prices QUALIFY rn <= 5)""", """cw AS (
SELECT ticker, CAST(GREATEST(MAX(LENGTH(close)), 5) AS INTEGER) AS w FROM cl GROUP BY ticker)""", """ct AS (
SELECT ticker, string_agg(line, chr(10) ORDER BY o) AS closes_table FROM (
  SELECT ticker, 0 AS o, lpad('dt', 10, ' ') || '  ' || lpad('close', w, ' ') AS line FROM cw
  UNION ALL SELECT ticker, 6 - rn, lpad(dt, 10, ' ') || '  ' || lpad(close, w, ' ') FROM cl JOIN cw USING (ticker)) x GROUP BY ticker)""")


def _requests_sql() -> str:
    from equiflow.plans.valuation_plans import _F, _FX, _LM, _LT, _M, _RN, _W as WACC
    given = lambda c, text: f"CASE WHEN {c} IS NULL THEN 'NOT PROVIDED' ELSE {text} END"
    fields = {
        "ticker": "CAST(wc.ticker AS VARCHAR)", "name": given("i.name", "i.name"), "sector": given("i.sector", "i.sector"),
        "market_cap": given("i.market_cap", "'$' || format('{:,.0f}', i.market_cap)"), "terminal_growth_rate": "'2.5%'", "exit_multiple": "'10.0x'",
        "wacc": given("wacc", "printf('%.1f%%', wacc * 100)"), "net_debt": given("net_debt", "'$' || format('{:,.0f}', net_debt)"),
        "shares_outstanding": given("wc.shares_outstanding", "format('{:,.0f}', wc.shares_outstanding)"),
        "yearly_table": "COALESCE(yearly_table, 'NOT PROVIDED')", "closes_table": "COALESCE(closes_table, 'NOT PROVIDED')",
    }
    selects = []
    for name, lines in RQ.TEMPLATES.items():
        text = "'" + " || chr(10) || '".join(line.replace("'", "''") + "'" for line in lines)
        for field, sql in fields.items():
            text = text.replace("{" + field + "}", f"' || {sql} || '")
        selects.append(f"SELECT wc.ticker, '{name}' AS template, {text} AS request FROM wc LEFT JOIN v_info i ON i.ticker = wc.ticker LEFT JOIN yt2 ON yt2.ticker = wc.ticker LEFT JOIN ct ON ct.ticker = wc.ticker")
    yearly = f"yt2 AS (SELECT ticker, text AS yearly_table FROM ({ORACLE['render_table']}) q)"
    return with_fixtures(_FX + ["v_info", "v_prices"], _M, _F, _RN, _LT, _LM, WACC, *_CLOSES, yearly, body="\nUNION ALL ".join(selects))


_HTML = """SELECT hd.request_id, hd.reply_id,
  '<table><thead><tr>' || list_aggregate(list_transform(h, lambda x: '<th>' || x || '</th>'), 'string_agg', '') || '</tr></thead><tbody>'
  || COALESCE(tb, '') || '</tbody></table>' AS html
FROM hd LEFT JOIN (SELECT reply_id, string_agg('<tr>' || list_aggregate(list_transform(c, lambda x: '<td>' || x || '</td>'), 'string_agg', '') || '</tr>', '' ORDER BY row_no) AS tb
  FROM rw WHERE len(c) = len(h) GROUP BY reply_id) b ON b.reply_id = hd.reply_id"""

_BUL = """bl AS (SELECT reply_id, CAST(g.i - 1 AS INTEGER) AS ln, string_split(text, chr(10))[g.i] AS line
  FROM v_replies, generate_series(1, len(string_split(text, chr(10)))) AS g(i)),
b2 AS (SELECT reply_id, ln, regexp_extract(line, '^\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|', 1) AS sym,
  regexp_extract(line, '^\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|', 2) AS nm,
  regexp_extract(line, '^\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|\\s*([^|]*?)\\s*\\|', 3) AS bullet
  FROM bl JOIN (SELECT reply_id AS rid, MIN(ln) AS rule FROM bl WHERE regexp_matches(line, '^\\s*\\|(\\s*:?-+:?\\s*\\|)+\\s*$') GROUP BY reply_id) z
    ON z.rid = bl.reply_id WHERE ln > rule),
b3 AS (SELECT reply_id, ln, bullet,
  LAST_VALUE(NULLIF(sym, '') IGNORE NULLS) OVER w AS symbol, LAST_VALUE(NULLIF(nm, '') IGNORE NULLS) OVER w AS cname
  FROM b2 WHERE bullet <> '' WINDOW w AS (PARTITION BY reply_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b4 AS (SELECT reply_id, symbol, ARG_MIN(cname, ln) AS name, list(bullet ORDER BY ln) AS bullets
  FROM b3 GROUP BY reply_id, symbol)"""

ORACLE["render_breakdown"] = _breakdown_sql()
ORACLE["render_requests"] = _requests_sql()
ORACLE["to_html_rows"] = with_fixtures(["v_replies"], _PT, body=_HTML)
ORACLE["explode_bullets"] = with_fixtures(["v_replies"], _BUL, body="""
SELECT reply_id, CAST(g.i - 1 AS INTEGER) AS pos, CASE WHEN g.i = 1 THEN symbol ELSE '' END AS symbol_cell,
  CASE WHEN g.i = 1 THEN name ELSE '' END AS name_cell, bullets[g.i] AS bullet
FROM b4, generate_series(1, len(bullets)) AS g(i)""")
