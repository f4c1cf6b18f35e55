import hashlib
import re
from collections import defaultdict

from equiflow.llm.exact_dedup import exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, lang string, keep_id string, digest string"


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = []
    for norm, members in groups.items():
        best = max(members, key=lambda r: (len(r[1] or ""), r[0] is not None, -(r[0] or 0)))
        for r in members:
            kept = len(r[1] or "") == len(best[1] or "") and r[0] == best[0]
            out.append((r[0], best[0], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(1, "a b", "en", "x", "y"), (2, "ab", "en", "x", "y"), (3, "a  b\x0b", None, None, None), (4, None, "en", None, None), (5, "", "en", None, None), (6, " \t\n", "en", None, None),
         (7, "a\xa0b", "en", None, None), (8, "é" * 3, "fr", None, None), (9, " é é é", "fr", None, None), (None, "zz", None, None, None), (10, "zz", None, None, None),
         (11, "w " * 50_000, "en", None, None), (12, "w" * 50_000, "en", None, None), (13, "q", "en", None, None), (13, "q", "en", None, None), (-4, "neg", "en", None, None), (4, "neg", "en", None, None)]


def test_groups_equal_brute_force(spark):
    df = spark.createDataFrame(CASES + [(100 + i, "hot text", "en", None, None) for i in range(300)], SCHEMA).repartition(7)
    got = sorted(map(tuple, exact_groups(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)
    assert got == brute(CASES + [(100 + i, "hot text", "en", None, None) for i in range(300)])


def test_dedup_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([3, 6, 7, 9, 10, 11, 13, -4], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).count() == 0 and exact_dedup(df).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame(CASES, SCHEMA)
    plan = exact_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
