import random
import re

import pytest

from equiflow.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines string, gone string, th string"


def spark_hashes(spark, values):
    """xxhash64 of strings, as Spark computes it."""
    from pyspark.sql import functions as F

    return dict(spark.createDataFrame([(v,) for v in values], "v string").select("v", F.xxhash64("v").alias("h")).collect()) if values else {}


def gram_hashes(spark, grams):
    from pyspark.sql import functions as F

    return {tuple(r.g): r.h for r in spark.createDataFrame([(list(g),) for g in grams], "g array<bigint>").select("g", F.xxhash64("g").alias("h")).collect()} if grams else {}


def brute(spark, rows, gram, window):
    keys = {(i, t) for i, t in rows if t is not None}
    line_hash = spark_hashes(spark, {x for _, t in keys for x in t.split("\n")})
    text_hash = spark_hashes(spark, {t for _, t in keys})
    docs = {(i, text_hash[t]): [line_hash[x] for x in t.split("\n")] for i, t in keys}
    hashed = gram_hashes(spark, {tuple(h[k : k + gram]) for h in docs.values() for k in range(len(h) - gram + 1)})
    order = lambda key: (key[0] is not None, key[0] or 0, key[1])
    marks, first = [], {}
    for key in sorted(docs, key=order):
        g = [hashed[tuple(docs[key][k : k + gram])] for k in range(len(docs[key]) - gram + 1)]
        chosen = set()
        for k in range(max(1, len(g) - window + 1)) if g else ():
            part = g[k : k + window]
            chosen.add(k + max(j for j, x in enumerate(part) if x == min(part)))
        for p in sorted(chosen):
            first.setdefault(g[p], (key, p))
            marks.append((key, p, g[p]))
    gone = {key: set() for key in docs}
    for key, p, fp in marks:
        there, q = first[fp]
        if (there, q) == (key, p):
            continue
        a, b, d = docs[key], docs[there], p - q
        on = [x for x in range(max(0, d), min(len(a), len(b) + d))]
        equal = {x for x in on if a[x] == b[x - d]}
        for x in equal:
            if all(x + k in equal for k in range(gram)):
                gone[key].update(x + k for k in range(gram))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, 0, 0, None))
            continue
        lines, drop = t.split("\n"), gone[i, text_hash[t]]
        out.append((i, len(lines), len(drop), "\n".join(x for k, x in enumerate(lines) if k not in drop)))
    return sorted(out, key=str)


def corpus(seed, n=90):
    r = random.Random(seed)
    pool = [[f"line {r.randrange(10**6)}" for _ in range(r.randrange(2, 9))] for _ in range(6)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(0, 6)):
            kind = r.randrange(4)
            lines += r.choice(pool) if kind == 0 else [f"own {r.randrange(10**9)}" for _ in range(r.randrange(3))] if kind == 1 else ["common"] * r.randrange(4) if kind == 2 else r.choice(pool)[1:4]
        rows.append((n - i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n\n\n\n"), (None, "\n".join(pool[0])), (503, "\n".join(pool[1])), (503, "\n".join(pool[1])), (503, "other\ntext")]


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3), (3, 4)])
def test_equals_brute_force(spark, gram, window):
    rows = corpus(gram)
    df = spark.createDataFrame([(*x, "n", "g", "t") for x in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, L.line_dedup(df, gram=gram, window=window).collect()), key=str) == brute(spark, rows, gram, window)


def test_a_copied_run_goes_from_the_later_document(spark):
    r = random.Random(4)
    own = lambda n: [f"own {r.randrange(10**9)}" for _ in range(n)]
    run = own(12)
    rows = [(1, "\n".join(own(5) + run + own(4))), (2, "\n".join(own(3) + run + own(6))), (3, "\n".join(own(30)))]
    out = {x.doc_id: x for x in L.line_dedup(spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA)).collect()}
    assert (out[1].n_removed, out[2].n_removed, out[3].n_removed) == (0, 12, 0)
    assert not set(run) & set(out[2].text.split("\n")) and out[1].text == rows[0][1]


def test_long_text_and_empty_table(spark):
    rows = [(1, "\n".join(f"l{i}" for i in range(3000))), (2, "\n".join(f"l{i}" for i in range(500, 2500)))]
    df = spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA)
    out = {x.doc_id: x for x in L.line_dedup(df).collect()}
    assert out[1].n_removed == 0 and out[2].n_removed == 2000 and out[2].text == ""
    assert L.line_dedup(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = L.line_dedup(spark.createDataFrame([(1, "a\nb", None, None, None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_long_passages_between_unshared_lines_go(spark):
    r = random.Random(5)
    own = lambda n: [f"own {r.randrange(10**9)}" for _ in range(n)]
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    line, short, han = words(60), words(49), "".join(chr(0x4E00 + r.randrange(9000)) for _ in range(60))
    pairs = [[words(30), words(30)] for _ in range(40)]  # two lines each, whose gram need not be the least of its window
    rows = [(1, "\n".join([*own(3), line, *own(2), short, *own(1), han])), (2, "\n".join([*own(2), line, *own(1), short, *own(4), han, *own(1), line])), (3, line), (3, line)]
    rows += [(k, "\n".join(x for p in pairs for x in [*own(2), *p])) for k in (4, 5)]
    out = {}
    for x in L.line_dedup(spark.createDataFrame([(*x, None, None, None) for x in rows], SCHEMA)).collect():
        out.setdefault(x.doc_id, []).append(x)
    assert [[x.n_removed for x in out[k]] for k in (1, 2, 3, 4, 5)] == [[0], [3], [1, 1], [0], [80]]
    kept = out[2][0].text.split("\n")
    assert line not in kept and han not in kept and short in kept and out[3][0].text == ""
