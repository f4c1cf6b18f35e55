"""Literal frames for parsing, rendering, cleaning, ranks and the session stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from equiflow.operators import clean as C
from equiflow.operators import screening as S
from equiflow.operators import technical as T
from equiflow.operators import text_parse as TP
from equiflow.operators import text_render as TR
from equiflow.sources import sinks as K
from equiflow.streaming import chunks as G


def _one(spark, text):
    return spark.createDataFrame([(1, text)], "id int, text string")


@pytest.mark.parametrize("text,value", [
    (".5", 0.5), ("8e-2", 0.08), ("\xa0 -3. \n", -3.0), ("+7", 7.0), ("1,234.5", None), ("WACC for 2024: 8.5%", None), ("", None), (None, None), ("1 2", None), ("NaN", None)])
def test_a_number_is_the_whole_reply(spark, text, value):
    df = _one(spark, text)
    assert df.select(TP.parse_number(F.col("text")).alias("v")).first().v == value
    assert TP.number_rejects(df).count() == (value is None)


def test_trim_removes_no_break_space(spark):
    text = "| a\xa0 | b |\n|---|---|\n| 1 | \xa0 |\n| 2 | 3 |"
    got = [(r.row_no, r.header, r.cell) for r in TP.parse_pipe_table(_one(spark, text), ["id"]).orderBy("row_no", "col_no").collect()]
    assert got == [(3, "a", "2"), (3, "b", "3")]


def test_html_keeps_the_header(spark):
    bad_first = "| a | b |\n|-|-|\n| 1 |\n| 2 | <3> |"
    none = "| a | b |\n|-|-|\n| 1 |"
    html = lambda t, **k: TR.to_html_rows(TP.table_parts(_one(spark, t), ["id"]), ["id"], **k).first().html
    assert html(bad_first) == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>2</td><td>&lt;3&gt;</td></tr></tbody></table>"
    assert html(none, caption="x") == "<table><caption>x</caption><thead><tr><th>a</th><th>b</th></tr></thead><tbody></tbody></table>"
    assert TP.table_parts(_one(spark, "no table | here"), ["id"]).count() == 0


def test_a_long_table_is_read_whole(spark):
    text = "| a |\n|-|\n" + "\n".join(f"| {k} |" for k in range(5000))
    assert TP.parse_pipe_table(_one(spark, text), ["id"]).count() == 5000


def test_csv_cells_are_quoted_and_read_back(spark):
    rows = [(1, 0, "a,b", 'say "x"'), (1, 1, "plain", None)]
    csv = TR.render_csv(spark.createDataFrame(rows, "id int, o int, p string, q string"), ["id"], "o", ["p", "q"])
    assert csv.first().text == 'p,q\n"a,b","say ""x"""\nplain,'
    reply = csv.select("id", F.concat(F.lit("text\n```\n"), "text", F.lit("\n```\nmore,lines")).alias("text"))
    back = TP.extract_csv(reply, ["id"], "p,q", "p STRING, q STRING").orderBy("row_no").collect()
    assert [(r.p, r.q) for r in back][1] == ("plain", None) and back[0].p == "a,b"


def test_a_bad_csv_line_is_a_reject_and_ends_nothing(spark):
    text = 'Year,FCF\n2024,"1234.5"\ntotals\n2025,7\n\nnot,csv'
    df = _one(spark, text)
    assert [(r.row_no, r.y, r.v) for r in TP.extract_csv(df, ["id"], "Year,FCF", "y INT, v DOUBLE").orderBy("row_no").collect()] == [(1, 2024, 1234.5), (3, 2025, 7.0)]
    assert [(r.row_no, r.line) for r in TP.csv_rejects(df, ["id"], "Year,FCF", "y INT, v DOUBLE").collect()] == [(2, "totals")]


def test_csv_files_give_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\nz,3\n4,5,6\n")
    good, bad = K.read_csv(spark, str(tmp_path), "a INT, b INT")
    assert good.count() == 1 and bad.count() == 2
    assert [tuple(r) for r in good.collect()] == [(1, 2)] and sorted(r[K.CORRUPT] for r in bad.collect()) == ["4,5,6", "z,3"]


def test_all_bullets_stay(spark):
    df = spark.createDataFrame([(1, "S", "N", ["a", "b", "c", "d"])], "id int, symbol string, name string, bullets array<string>")
    assert [(r.symbol_cell, r.bullet) for r in TR.explode_bullets(df, ["id"]).orderBy("pos").collect()] == [("S", "a"), ("", "b"), ("", "c"), ("", "d")]
    assert {(r.pos, r.more) for r in TR.explode_bullets(df, ["id"], 3).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_breakdown_kinds(spark):
    df = spark.createDataFrame([(1, 1234.0, 0.0812, 1.05, None)], "t int, m double, r double, b double, n double")
    out = TR.render_breakdown(df, "t", {"Value": ("m", TR.MONEY), "Rate": ("r", TR.RATE), "Beta": ("b", TR.RATIO), "None": ("n", TR.MONEY)})
    assert [r.line for r in out.orderBy("pos").collect()] == ["Value: $1,234", "Rate: 8.12%", "Beta: 1.05", "None: N/A"]


def test_date_column_is_found_by_name(spark):
    df = spark.createDataFrame([("2020-01-02", 1), ("no date", 2)], "`Report Date` string, x int")
    assert [tuple(r) for r in C.standardize_date(df).collect()] == [(dt.date(2020, 1, 2), 1), (None, 2)]
    with pytest.raises(ValueError, match="no date column"):
        C.standardize_date(df.select("x"))


def test_row_ids_of_text_numbers_and_nulls(spark):
    for kind, values in (("string", ["b", None, "aa", "ab", "zz", "é"]), ("double", [-1e9, None, 0.0, 3.5, 1e12, -2.0]), ("date", [dt.date(1960, 1, 1), None, dt.date(2020, 2, 2), dt.date(1970, 1, 1)])):
        got = {r.v: r.row_id for r in S.with_row_id(spark.createDataFrame([(v,) for v in values], f"v {kind}"), "v").collect()}
        assert got == {v: i for i, v in enumerate(sorted(values, key=lambda v: (v is not None, v if v is not None else 0)))}, kind


def test_percent_ranks_equal_the_window_function(spark):
    import random
    from pyspark.sql import Window
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice([None, float(r.randrange(-50, 50)), r.gauss(0, 1e6)])) for _ in range(400)] + [("solo", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for up in (True, False):
        got = sorted((x.g, x.v, round(x.pr, 12)) for x in S.percent_ranks(df, "v", "g", up, "pr").where("v is not null").collect())
        w = Window.partitionBy("g").orderBy(F.col("v").asc() if up else F.col("v").desc())
        want = sorted((x.g, x.v, round(x.pr, 12)) for x in df.where("v is not null").withColumn("pr", F.percent_rank().over(w)).collect())
        assert got == want


def test_a_missing_factor_gives_no_total(spark):
    df = spark.createDataFrame([(1, 3, None), (2, 9, 1)], "ticker int, a int, b int")
    assert {r.ticker: r.t for r in df.withColumn("t", S.total_score(df, ["a", "b"])).collect()} == {1: None, 2: 6}


def test_required_columns_pass_through(spark):
    df = spark.range(2)
    assert df.transform(T.require_columns, ("id",)).count() == 2
    assert df.transform(T.require_columns, ("nope",), on_missing="passthrough").columns == ["id"]
    with pytest.raises(ValueError, match="nope"):
        T.require_columns(df, ("nope",))


def test_json_lines_rejects(spark):
    df = spark.createDataFrame([(1, '{"response": "a"}'), (2, '{"response": '), (3, None), (4, "[]")], "k int, line string")
    good, bad = G.decode_chunks(df, "response STRING")
    assert [(r.k, r.response) for r in good.collect()] == [(1, "a")] and sorted(r.k for r in bad.collect()) == [2, 3, 4]


def test_closed_sessions_of_the_stream_equal_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(u, t0 + dt.timedelta(minutes=m), i, f"e{i}") for i, (u, m) in enumerate([(1, 0), (1, 10), (2, 5), (1, 100), (2, 300), (3, 301)])]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, event_id int, event_type string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    args = {"key": "user_id", "ts": "ts", "seq": "event_id", "text": "event_type"}
    stream = G.run_session_stream(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/ckpt", **args).collect()
    batch = G.session_chunks(df, **args).collect()
    closed = [r for r in batch if r.session_end <= t0 + dt.timedelta(minutes=301 - 60)]
    assert sorted(map(tuple, stream)) == sorted(map(tuple, closed)) and len(closed) == 3
