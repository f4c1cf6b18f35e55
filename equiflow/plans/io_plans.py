"""Registered queries: statement reshaping and cleaning, sinks read back, chunk assembly and its stream
(P05 P08 P13 S04 S06 S09 S11 S12 J02 J08 K01-K04 G01)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiflow.operators import clean as C
from equiflow.operators.fundamentals import suffix_join
from equiflow.plans.fixture_sql import with_fixtures
from equiflow.session import scratch_folder
from equiflow.sources import fixtures as fx
from equiflow.sources import sinks as K
from equiflow.sources.tables import table
from equiflow.streaming import chunks as G

#: Lines of the chunk fixtures that are cut off.
_CUT = "request_id % 10 = 3 AND seq = 1"
METRICS = ["Total_Revenue", "Pretax_Income", "Total_Assets", "Total_Debt", "Operating_Cash_Flow"]


def _normalized(spark, sf) -> DataFrame:
    return fx.statements(spark, sf).withColumn("metric", C.normalize_name(F.col("metric")))


def q_normalize_metrics(spark, sf):
    return _normalized(spark, sf)


def q_statement_pivot(spark, sf):
    return C.pivot_statement(_normalized(spark, sf), METRICS)


def q_statement_roundtrip(spark, sf):
    return C.unpivot_statement(C.pivot_statement(_normalized(spark, sf), METRICS), METRICS)


def q_complete_tickers(spark, sf):
    return C.complete_tickers(fx.statements(spark, sf))


def q_missing_statements(spark, sf):
    return C.missing_statements(fx.info(spark, sf), fx.statements(spark, sf))


def q_suffix_join(spark, sf):
    b = fx.base(spark, sf)
    inc = fx.income(spark, sf, b).select("ticker", "dt", F.col("total_revenue").alias("value"))
    bal = fx.balance(spark, sf, b).select("ticker", "dt", F.col("total_assets").alias("value"))
    return suffix_join(inc, bal, ["ticker", "dt"], "full")


def q_drop_all_null_columns(spark, sf):
    from equiflow.operators.fundamentals import ensure_columns
    from equiflow.plans.valuation_plans import fund
    f = ensure_columns(fund(spark, sf).select("ticker", "dt", "total_revenue", "ebit", "total_debt"),
                       ("total_revenue", "minority_interest"))
    return C.drop_all_null_columns(f)


def q_positional_slice(spark, sf):
    return C.positional_slice(fx.info(spark, sf), "ticker", 2, 2)


def q_sink_roundtrip(spark, sf):
    """The DCF summary and yearly table written as a bundle; both read back, as (table, ticker, field, value) rows."""
    from equiflow.plans.valuation_plans import q_dcf_summary, q_dcf_yearly
    path = scratch_folder(spark, "bundle")
    K.write_bundle({"summary": q_dcf_summary(spark, sf), "yearly": q_dcf_yearly(spark, sf)}, path)
    tables = K.read_bundle(spark, path)
    summary = tables["summary"].select(F.lit("summary").alias("table"), "ticker", F.col("metric").alias("field"), "value")
    yearly = tables["yearly"]
    fields = ["year", "ebit", "fcf", "discounted_fcf"]
    yearly = yearly.select("ticker", "step", *[F.col(c).cast("double") for c in fields]).unpivot(["ticker", "step"], fields, "field", "value")
    return summary.union(yearly.select(F.lit("yearly"), "ticker", F.concat_ws("_", "field", "step"), "value"))


def q_csv_roundtrip(spark, sf):
    """K02 + S06: yearly DCF written as CSV files per ticker, read back with a declared schema."""
    from equiflow.plans.valuation_plans import q_dcf_yearly
    y = q_dcf_yearly(spark, sf).select("ticker", "step", "year", "fcf", "discounted_fcf")
    path = K.write_per_ticker(y, scratch_folder(spark, "per-ticker"))
    back, _ = K.read_csv(spark, path, "ticker BIGINT, step INT, year INT, fcf DOUBLE, discounted_fcf DOUBLE")
    return back.select("ticker", "step", "year", "fcf", "discounted_fcf")


def q_isolated_run(spark, sf):
    """Valuation of all tickers whose inputs are sound, and for each other ticker the reason it was left out.

    The income statements come from CSV files in which some cells are no numbers.
    """
    from equiflow.operators import isolation as I
    from equiflow.operators import valuation as V
    from equiflow.operators.fundamentals import fundamentals
    from equiflow.plans import valuation_plans as VP

    b = fx.base(spark, sf)
    income, balance, cash = fx.income(spark, sf, b), fx.balance(spark, sf, b), fx.cashflow(spark, sf, b)
    path = scratch_folder(spark, "income")
    spoilt = F.when((F.col("ticker") % 11 == 4) & (F.year("dt") % 5 == 0), F.lit("n.a.")).otherwise(F.col("total_revenue").cast("string"))
    income.withColumn("total_revenue", spoilt).write.option("header", True).csv(path)
    income, corrupt = K.read_csv(spark, path, income.schema)
    info = fx.info(spark, sf)
    broken = I.broken_keys([
        I.Rule("income record is not readable", corrupt, F.lit(True), "dt"),
        I.Rule("revenue is not positive", income, F.col("total_revenue") <= 0, "dt"),
        I.Rule("no market value", info, F.coalesce(F.col("market_cap") <= 0, F.lit(True))),
    ])
    sound = lambda df: I.without(df, broken)
    fund = fundamentals(sound(income), sound(balance), sound(cash))
    run = VP.valuation_of(fund, sound(info))
    rows = V.dcf_summary(run, VP.SUMMARY_DIGITS).select("ticker", "metric", "value", F.lit(None).cast("string").alias("reason"), F.lit(None).cast("date").alias("first_bad"))
    return rows.unionByName(broken.select("ticker", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("rule").alias("reason"), F.col("first_bad").cast("date").alias("first_bad")))


def q_text_json_sink(spark, sf):
    """K03 + K04: request texts as JSON reply records, written as text and read back."""
    from equiflow.plans.text_plans import q_render_requests
    js = K.reply_json(q_render_requests(spark, sf).withColumnRenamed("request", "reply"))
    path = K.write_text(js, scratch_folder(spark, "text"), "json")
    return spark.read.schema("reply STRING").json(path)


def q_chunk_assembly(spark, sf):
    return G.assemble_chunks(fx.chunks(spark, sf))


def q_event_sessions(spark, sf):
    """G01 over the whole table as a bounded stream in complete mode: sessions of 30 minutes per user."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    top = scratch_folder(spark, "event-stream")
    events.write.parquet(f"{top}/src")
    return G.run_session_stream(spark, f"{top}/src", events.schema, f"{top}/out", f"{top}/checkpoint", key="user_id", ts="ts", seq="event_id", text="event_type", mode="complete")


def _stream(spark, sf) -> tuple[DataFrame, G.StreamCounts]:
    """``conversations`` as JSON lines in two waves, read by two runs over one checkpoint.

    A chunk's time is a minute per request and a second per ``seq``.  The first wave holds the requests up to the middle
    one.  The second holds the others, the first wave's last five minutes once more, a late line for each good line more
    than twenty minutes old, and a line without request that closes the sessions.
    """
    chunks = fx.chunks(spark, sf)
    middle = chunks.agg(F.floor((F.min("request_id") + F.max("request_id")) / 2)).first()[0]
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("request_id") * 60 + F.col("seq"))
    rows = _chunk_lines(spark, sf, at).withColumn("at", at)
    first, second = rows.where(F.col("request_id") <= F.lit(middle)), rows.where(~(F.col("request_id") <= F.lit(middle)))
    good = first.where(f"NOT ({_CUT})")
    last = F.lit(first.agg(F.max("at")).first()[0])
    again = good.where(F.col("at") >= last - F.expr("INTERVAL 5 MINUTES"))
    late = good.where(F.col("at") < last - F.expr("INTERVAL 20 MINUTES")).withColumn("line", F.regexp_replace("line", '"seq":(\\d+)', '"seq":1000$1'))
    end = spark.range(1).select(F.lit('{"seq":0,"ts":"2100-01-01 00:00:00"}').alias("line"))
    top, counts = scratch_folder(spark, "chunk-stream"), G.StreamCounts()
    for wave in ([first], [second, again, late, end]):
        for part in wave:
            part.select("line").write.mode("append").text(f"{top}/src")
        out = G.run_line_stream(spark, f"{top}/src", "request_id BIGINT, seq BIGINT, ts STRING, response STRING", f"{top}/out", f"{top}/checkpoint",
                                key="request_id", ts="ts", seq="seq", text="response", gap="5 minutes", watermark="10 minutes", sep="", counts=counts)
    return out, counts


def q_chunk_stream(spark, sf):
    return _stream(spark, sf)[0]


def q_chunk_stream_counts(spark, sf):
    """What the stream read and left out, one row per figure."""
    counts = _stream(spark, sf)[1]
    return spark.createDataFrame([(k, getattr(counts, k)) for k in ("lines", "rejects", "duplicates", "late")], "figure string, n long")


def _chunk_lines(spark, sf, at=None) -> DataFrame:
    """Reply chunks as JSON lines; every tenth conversation's second line is cut off.  With ``at`` the line has keys and time."""
    c = fx.chunks(spark, sf)
    line = F.to_json(F.struct("response") if at is None else F.struct("request_id", "seq", at.cast("string").alias("ts"), "response"))
    return c.select("request_id", "seq", F.when(F.expr(_CUT), F.lit('{"response": "cut')).otherwise(line).alias("line"))


def q_chunk_decode(spark, sf):
    """JSON lines decoded, then assembled."""
    good, _ = G.decode_chunks(_chunk_lines(spark, sf), "response STRING")
    return G.assemble_chunks(good)


def q_chunk_rejects(spark, sf):
    return G.decode_chunks(_chunk_lines(spark, sf), "response STRING")[1]


QUERIES = {
    "normalize_metrics": q_normalize_metrics,
    "statement_pivot": q_statement_pivot,
    "statement_roundtrip": q_statement_roundtrip,
    "complete_tickers": q_complete_tickers,
    "missing_statements": q_missing_statements,
    "suffix_join": q_suffix_join,
    "drop_all_null_columns": q_drop_all_null_columns,
    "positional_slice": q_positional_slice,
    "sink_roundtrip": q_sink_roundtrip,
    "csv_roundtrip": q_csv_roundtrip,
    "text_json_sink": q_text_json_sink,
    "isolated_run": q_isolated_run,
    "chunk_assembly": q_chunk_assembly,
    "event_sessions": q_event_sessions,
    "chunk_stream": q_chunk_stream,
    "chunk_stream_counts": q_chunk_stream_counts,
    "chunk_decode": q_chunk_decode,
    "chunk_rejects": q_chunk_rejects,
}

# ---------------------------------------------------------------- oracle ----

_NORM = """nm AS (SELECT ticker, statement, dt,
  regexp_replace(replace(regexp_replace(metric, '^\\s+|\\s+$', '', 'g'), ' ', '_'), '[^\\w_]', '', 'g') AS metric, value
  FROM v_statements)"""
_PIV = "pv AS (SELECT ticker, dt, " + ", ".join(
    f"MAX(CASE WHEN metric = '{m}' THEN value END) AS \"{m}\"" for m in METRICS) + " FROM nm GROUP BY ticker, dt)"
_ST = ["v_statements"]
_AT = "tm AS (SELECT *, make_timestamp(1704067200000000 + (request_id * 60 + seq) * 1000000) AS ts FROM v_chunks)"


def _oracle() -> dict[str, str]:
    from equiflow.plans.text_plans import _requests_sql
    from equiflow.plans.valuation_plans import ORACLE as VO
    req = _requests_sql()
    return {
        "normalize_metrics": with_fixtures(_ST, _NORM, body="SELECT * FROM nm"),
        "statement_pivot": with_fixtures(_ST, _NORM, _PIV, body="SELECT * FROM pv"),
        "statement_roundtrip": with_fixtures(_ST, _NORM, body="""
SELECT ticker, dt, metric, value FROM nm WHERE value IS NOT NULL"""),
        "complete_tickers": with_fixtures(_ST, body="""
SELECT ticker FROM v_statements WHERE statement IN ('income', 'balance', 'cash')
GROUP BY ticker HAVING COUNT(DISTINCT statement) = 3"""),
        "missing_statements": with_fixtures(_ST + ["v_info"], body="""
SELECT i.ticker, s.statement FROM v_info i, (VALUES ('income'), ('balance'), ('cash')) s(statement)
WHERE NOT EXISTS (SELECT 1 FROM v_statements v WHERE v.ticker = i.ticker AND v.statement = s.statement)"""),
        "suffix_join": with_fixtures(["v_income", "v_balance"], body="""
SELECT ticker, dt, i.total_revenue AS value_x, b.total_assets AS value_y
FROM v_income i FULL JOIN v_balance b USING (ticker, dt)"""),
        "drop_all_null_columns": with_fixtures(["v_income", "v_balance", "v_cashflow"], body="""
SELECT ticker, dt, NULLIF(total_revenue, 0) AS total_revenue, NULLIF(ebit, 0) AS ebit,
  NULLIF(total_debt, 0) AS total_debt
FROM v_income FULL JOIN v_balance USING (ticker, dt) FULL JOIN v_cashflow USING (ticker, dt)"""),
        "positional_slice": with_fixtures(["v_info"], body="""
SELECT ticker, name FROM (SELECT ticker, name, ROW_NUMBER() OVER (ORDER BY ticker) AS rn FROM v_info) x WHERE rn >= 2"""),
        "sink_roundtrip": f"""
SELECT 'summary' AS "table", ticker, metric AS field, value FROM ({VO["dcf_summary"]}) s
""" + "".join(f"""UNION ALL SELECT 'yearly', ticker, '{c}_' || step, CAST({c} AS DOUBLE) FROM ({VO["dcf_yearly"]}) y
""" for c in ("year", "ebit", "fcf", "discounted_fcf")),
        "chunk_decode": with_fixtures(["v_chunks"], body="""
SELECT request_id, COUNT(*) AS n_chunks, MAX(seq) - MIN(seq) + 1 - COUNT(DISTINCT seq) AS n_missing, COUNT(*) - COUNT(DISTINCT seq) AS n_repeated,
  string_agg(response, '' ORDER BY seq) AS text
FROM v_chunks WHERE NOT (request_id % 10 = 3 AND seq = 1) GROUP BY request_id"""),
        "chunk_rejects": with_fixtures(["v_chunks"], body="""
SELECT request_id, seq, '{"response": "cut' AS line FROM v_chunks WHERE request_id % 10 = 3 AND seq = 1"""),
        "csv_roundtrip": VO["dcf_yearly"].rsplit("\nSELECT", 1)[0] + """
SELECT ticker, step, year, ROUND(fcf, 2) AS fcf, ROUND(discounted_fcf, 2) AS discounted_fcf FROM yr""",
        "isolated_run": with_fixtures(["v_income", "v_info"], """found AS (
SELECT ticker, 0 AS n, 'income record is not readable' AS reason, MIN(dt) AS first_bad FROM v_income WHERE ticker % 11 = 4 AND YEAR(dt) % 5 = 0 GROUP BY ticker
UNION ALL SELECT ticker, 1, 'revenue is not positive', MIN(dt) FROM v_income WHERE total_revenue <= 0 AND NOT (ticker % 11 = 4 AND YEAR(dt) % 5 = 0) GROUP BY ticker
UNION ALL SELECT ticker, 2, 'no market value', NULL FROM v_info WHERE COALESCE(market_cap <= 0, TRUE))""", """bad AS (
SELECT ticker, reason, first_bad FROM found QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY n) = 1)""", body=f"""
SELECT ticker, metric, value, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DATE) AS first_bad FROM ({VO["dcf_summary"]}) s WHERE ticker NOT IN (SELECT ticker FROM bad)
UNION ALL SELECT ticker, NULL, NULL, reason, first_bad FROM bad"""),
        "text_json_sink": "SELECT request AS reply FROM (" + req + ") r",
        "chunk_assembly": with_fixtures(["v_chunks"], body="""
SELECT request_id, COUNT(*) AS n_chunks, MAX(seq) - MIN(seq) + 1 - COUNT(DISTINCT seq) AS n_missing, COUNT(*) - COUNT(DISTINCT seq) AS n_repeated,
  string_agg(response, '' ORDER BY seq) AS text
FROM v_chunks GROUP BY request_id"""),
        "chunk_stream": with_fixtures(["v_chunks"], _AT, body=f"""
SELECT request_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 5 MINUTE AS session_end, COUNT(*) AS n, string_agg(response, '' ORDER BY seq) AS text
FROM tm WHERE NOT ({_CUT}) GROUP BY request_id"""),
        "chunk_stream_counts": with_fixtures(["v_chunks"], _AT, """first AS (
SELECT * FROM tm WHERE request_id <= (SELECT FLOOR((MIN(request_id) + MAX(request_id)) / 2) FROM tm))""", f"""good AS (
SELECT *, (SELECT MAX(ts) FROM first) AS last FROM first WHERE NOT ({_CUT}))""", """again AS (
SELECT COUNT(*) AS n FROM good WHERE ts >= last - INTERVAL 5 MINUTE)""", """late AS (
SELECT COUNT(*) AS n FROM good WHERE ts < last - INTERVAL 20 MINUTE)""", body=f"""
SELECT 'lines' AS figure, (SELECT COUNT(*) FROM tm) + (SELECT n FROM again) + (SELECT n FROM late) + 1 AS n
UNION ALL SELECT 'rejects', COUNT(*) FROM tm WHERE {_CUT}
UNION ALL SELECT 'duplicates', n FROM again
UNION ALL SELECT 'late', n FROM late"""),
        "event_sessions": """
WITH s AS (SELECT *, CASE WHEN LAG(ts) OVER w IS NULL OR ts - LAG(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s2 AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM s)
SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n,
  string_agg(event_type, ' ' ORDER BY ts, event_id) AS text
FROM s2 GROUP BY user_id, sid""",
    }


ORACLE = _oracle()
