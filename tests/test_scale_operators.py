"""Quantiles, as-of join, numbering, chunk assembly and the line stream on small frames and odd inputs."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from equiflow.operators import numbering
from equiflow.operators import quantiles as Q
from equiflow.operators.asof import asof_join
from equiflow.operators.numbering import numbered
from equiflow.streaming import chunks as G


def ranked(values, p):
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x if not math.isnan(x) else 0))
    return v[max(1, math.ceil(p * len(v))) - 1] if v else None


@pytest.mark.parametrize("rows", [3, 50, 5000])
def test_quantiles_equal_sorted_ranks(spark, monkeypatch, rows):
    """With few values read off at the end the gaps are narrowed again and again; the answer stays."""
    monkeypatch.setattr(Q, "ROWS", rows)
    monkeypatch.setattr(Q, "GRID", 16)
    monkeypatch.setattr(Q, "ACCURACY", 40)
    r = random.Random(rows)
    n = 3000
    cols = {
        "even": [float(k) for k in range(n)], "ties": [float(r.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "wide": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)], "holes": [None if k % 3 else float(k) for k in range(n)],
        "nan": [float("nan") if k % 2 else 1.0 * k for k in range(n)], "none": [None] * n, "two": [0.0] * 1500 + [1.0] * 1500,
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols))
    ps = [0.0, 0.25, 0.5, 0.501, 0.75, 1.0]
    got = Q.exact_quantiles(df, list(cols), ps)
    for c, values in cols.items():
        assert str(got[c]) == str([ranked(values, p) for p in ps]), c


def test_quantiles_of_nothing(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5]) == {"a": [None]}


def brute_asof(left, right):
    out = []
    for k, t, v in left:
        fit = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
        best = max(fit, key=lambda x: (x[1], x[2]), default=(None, None, None))
        out.append((k, t, v, best[1], best[2]))
    return out


def test_asof_join_against_brute_force(spark):
    r = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=r.randrange(700))
    left = [(r.choice([1, 2, 3, 4, None]), r.choice([day(), day(), day(), None]), k) for k in range(400)]
    right = [(r.choice([1, 2, 3, None]), r.choice([day(), day(), None]), k) for k in range(60)] + [(1, dt.date(2020, 5, 5), 900), (1, dt.date(2020, 5, 5), 901)]
    got = asof_join(spark.createDataFrame(left, "ticker int, dt date, v int"), spark.createDataFrame(right, "ticker int, dt date, w int"), values=["w"])
    key = lambda x: tuple((y is None, y or 0) if not isinstance(y, dt.date) else (False, y.toordinal()) for y in x)
    assert got.columns == ["ticker", "dt", "v", "asof_dt", "w"]
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(brute_asof(left, right), key=key)


def test_asof_join_empty_sides_and_clashing_names(spark):
    left, right = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "ticker int, dt date"), spark.createDataFrame([], "ticker int, dt date, w int")
    assert [tuple(r) for r in asof_join(left, right).collect()] == [(1, dt.date(2020, 1, 1), None, None)]
    assert asof_join(left.limit(0), right).count() == 0
    with pytest.raises(ValueError, match="w"):
        asof_join(left.withColumn("W", F.lit(1)), right)


def test_asof_join_spreads_a_hot_key(spark):
    """One ticker over 40 months: its rows lie in many partitions of the running window."""
    left = spark.range(4000).select(F.lit(1).alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1200).cast("int")).alias("dt"))
    right = spark.createDataFrame([(1, dt.date(2020, 2, 3), 5)], "ticker int, dt date, w int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof_join(left, right)
        rows = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(rows) > 4 and max(r["count"] for r in rows) < 2000
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "NestedLoop" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("values", [["Supplier#%09d" % k for k in range(2000)], [10**12 + k * k for k in range(2000)], [dt.date(2024, 1, 1) + dt.timedelta(days=k % 300) for k in range(2000)]])
def test_numbered_is_dense_and_even(spark, tmp_path, monkeypatch, values):
    monkeypatch.setattr(numbering, "scratch_folder", lambda *_: str(tmp_path / "n"))
    r = random.Random(1)
    rows = [(v, k) for k, v in enumerate(values)]
    r.shuffle(rows)
    kind = {str: "string", int: "long"}.get(type(values[0]), "date")
    df = spark.createDataFrame(rows, f"v {kind}, k int")
    out = numbered(df, ["v", "k"], parts=8)
    got = sorted(out.collect(), key=lambda x: x.row_id)
    assert [x.row_id for x in got] == list(range(len(values)))
    assert [(x.v, x.k) for x in got] == sorted((v, k) for k, v in enumerate(values))
    sizes = [x["count"] for x in spark.read.parquet(str(tmp_path / "n")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_numbered_empty_and_clashing_name(spark):
    assert numbered(spark.createDataFrame([], "a int"), ["a"]).count() == 0
    got = numbered(spark.createDataFrame([(3, 1), (None, 2)], "a int, __PLACE int"), [F.asc_nulls_first("a")], "n", start=1)
    assert sorted((r.n, r.a) for r in got.collect()) == [(1, None), (2, 3)]


def test_chunks_are_joined_by_blocks(spark):
    rows = [(1, k, f"<{k}>") for k in range(1000) if k not in (7, 500)] + [(1, 9, "<9>"), (1, 9, "z"), (2, 4, "only"), (3, 1, None), (3, 2, "b"), (4, None, "x"), (4, None, "a")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "request_id int, seq int, response string")
    got = {r.request_id: tuple(r)[1:] for r in G.assemble_chunks(df, block=16).collect()}
    assert got == {1: (1000, 2, 2, "".join(f"<{k}>" for k in range(1000) if k not in (7, 500))), 2: (1, 0, 0, "only"), 3: (2, 0, 0, "b"), 4: (2, 0, 1, "a")}
    apart = {r.request_id: r.text for r in G.assemble_chunks(df.where("request_id != 1"), sep="-", block=1).collect()}
    assert apart == {2: "only", 3: "b", 4: "a"}


def test_line_stream_restarts_and_keeps_count(spark, tmp_path):
    """Two runs over one checkpoint: open sessions go on, lines sent twice and late lines are left out, bad ones are kept apart."""
    def wave(name, *lines):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"{name}.txt").write_text("\n".join(lines))

    line = lambda k, s, t: f'{{"k":{k},"s":{s},"t":"2024-01-01 {t}","x":"{k}.{s}"}}'
    counts = G.StreamCounts()
    run = lambda: G.run_line_stream(spark, str(tmp_path / "src"), "k INT, s INT, t STRING, x STRING", str(tmp_path / "out"), str(tmp_path / "check"),
                                    "k", "t", "s", "x", gap="5 minutes", watermark="10 minutes", counts=counts)
    wave("a", line(1, 0, "00:00:00"), line(1, 1, "00:01:00"), line(2, 0, "01:00:00"), "{broken", '{"k":1,"s":9,"t":"no time","x":"?"}', "")
    first = sorted((r.k, r.n, r.text) for r in run().collect())
    assert first == [(1, 2, "1.0 1.1")]
    wave("b", line(2, 0, "01:00:00"), line(2, 1, "01:02:00"), line(1, 2, "00:02:00"), '{"s":0,"t":"2100-01-01 00:00:00"}')
    second = sorted((r.k, r.n, r.text) for r in run().collect())
    assert second == [(1, 2, "1.0 1.1"), (2, 2, "2.0 2.1")]
    assert (counts.rejects, counts.duplicates, counts.late) == (2, 1, 1)


def test_bundle_versions_are_whole_or_not_there(spark, tmp_path):
    from equiflow.sources import sinks as K

    path = str(tmp_path / "bundle")
    with pytest.raises(FileNotFoundError):
        K.read_bundle(spark, path)
    a, b = spark.range(3), spark.range(5).withColumn("x", F.lit("y"))
    assert K.write_bundle({"a": a, "b": b}, path) == 1
    broken = spark.range(4).withColumn("x", F.raise_error(F.lit("second table fails")))
    with pytest.raises(Exception, match="second table fails"):
        K.write_bundle({"a": spark.range(9), "b": broken}, path)
    old = K.read_bundle(spark, path)
    assert {n: d.count() for n, d in old.items()} == {"a": 3, "b": 5}
    assert K.write_bundle({"a": spark.range(7)}, path) == 2
    assert {n: d.count() for n, d in K.read_bundle(spark, path).items()} == {"a": 7}
    assert set(K.read_bundle(spark, path, 1)) == {"a", "b"}


def test_ticker_files_have_bounded_rows(spark, tmp_path):
    from equiflow.sources import sinks as K

    df = spark.range(1000).select(F.when(F.col("id") < 900, 1).when(F.col("id") < 990, F.col("id")).cast("long").alias("ticker"), "id")
    path = K.write_per_ticker(df, str(tmp_path / "t"), rows=100)
    files = [f for f in (tmp_path / "t").rglob("part-*.csv")]
    assert (tmp_path / "t" / "file=1_DCF_Analysis").is_dir() and (tmp_path / "t" / "file=null_DCF_Analysis").is_dir()
    assert all(len(f.read_text().splitlines()) <= 101 for f in files)
    assert len([f for f in files if f.parent.name == "file=1_DCF_Analysis"]) >= 9 and len([f for f in files if f.parent.name == "file=950_DCF_Analysis"]) == 1
    back, bad = K.read_csv(spark, path, "ticker BIGINT, id BIGINT")
    assert sorted(r.id for r in back.collect()) == list(range(1000)) and bad.count() == 0


def test_one_bad_row_takes_out_its_ticker_alone(spark):
    from equiflow.operators import isolation as I

    a = spark.createDataFrame([(1, 5, 1.0), (1, 4, -1.0), (1, 3, -2.0), (2, 1, 1.0), (None, 1, -1.0), (3, 1, None)], "ticker int, day int, v double")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, "x"), (None, "x")], "ticker int, name string")
    broken = I.broken_keys([I.Rule("negative", a, F.col("v") < 0, "day"), I.Rule("no name", b, F.col("name").isNull())])
    assert sorted(map(tuple, broken.collect()), key=str) == sorted([(1, "negative", "3"), (None, "negative", "1"), (2, "no name", None)], key=str)
    assert [tuple(r) for r in I.without(a, broken).collect()] == [(3, 1, None)]


def test_union_fills_missing_columns(spark):
    from equiflow.operators import clean as C

    got = C.union_all([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int"), spark.createDataFrame([(5,)], "b int")])
    assert got.columns == ["a", "b", "c"] and sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, None), (4, None, 3), (None, 5, None)], key=str)


def test_bullets_are_carried_down_without_a_shuffle(spark):
    from equiflow.operators import text_render as TR
    from equiflow.plans.text_plans import ROW3

    text = "| Symbol | Name | Why |\n|---|---|---|\n| | | orphan |\n| AB | Co A | one |\n| | | two |\n| CD | | three |\nprose\n| AB | Co X | four |\n| | | |"
    got = TR.bullet_groups(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "|---|")], "reply_id int, text string"), ["reply_id"], ROW3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, None, None, ["orphan"]), (1, "AB", "Co A", ["one", "two", "four"]), (1, "CD", "Co A", ["three"])], key=str)
    assert "Exchange" not in TR.explode_bullets(got, ["reply_id"])._jdf.queryExecution().executedPlan().toString()


def test_large_tables_come_in_blocks(spark):
    from equiflow.operators import text_render as TR

    df = spark.range(3500).select(F.lit(1).alias("g"), "id", F.concat(F.lit("v"), F.col("id")).alias("v")).unionByName(spark.createDataFrame([(None, 0, "x")], "g int, id long, v string"))
    for render, head in ((TR.render_table, "    v"), (TR.render_pipe_table, "| v     |\n|-------|")):
        whole = {r.g: r.text for r in render(df, ["g"], "id", ["v"]).collect()}
        parts = render(df, ["g"], "id", ["v"], blocks=True)
        assert "Window" not in parts._jdf.queryExecution().optimizedPlan().toString()
        rows = sorted((r.block, r.text) for r in parts.where("g = 1").collect())
        assert len(rows) == 4 and "\n".join(t for _, t in rows) == whole[1] and whole[1].startswith(head) and whole[1].count("\n") in (3500, 3501)
        assert "x" in whole[None]


def test_request_placeholders_are_checked_and_set_once(spark):
    from equiflow.operators import requests as RQ

    params = spark.createDataFrame([(1, "a {b} c"), (2, None)], "ticker int, name string")
    values = {"ticker": F.col("ticker").cast("string"), "name": F.coalesce("name", F.lit("?")), "b": F.lit("never")}
    table = spark.createDataFrame([(1, "x  y\n1  2")], "ticker int, text string")
    got = {(r.ticker, r.template): r.request for r in RQ.request_texts(params, {"t": table}, {"one": ("{ticker}: {name}", "{t}"), "two": ("{b}",)}, values).collect()}
    assert got == {(1, "one"): "1: a {b} c\nx  y\n1  2", (2, "one"): "2: ?\nNOT PROVIDED", (1, "two"): "never", (2, "two"): "never"}
    with pytest.raises(ValueError, match="one: nothing"):
        RQ.request_texts(params, {}, {"one": ("{nothing}",)}, values)
