import functools
import random
import zlib

import numpy as np
import pytest

from equiflow.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string, label string"
WORDS = {"aa": ["the", "and", "with", "house", "river"], "bb": ["où", "été", "leçon", "garçon", "maïs"], "cc": ["für", "über", "straße", "schön", "mädchen"]}


@pytest.fixture
def short_training(monkeypatch):
    monkeypatch.setattr(L, "train", functools.partial(L.train, steps=60))


def corpus(n=600):
    r = random.Random(2)
    langs = list(WORDS)
    return [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randrange(5, 60))), k if i % 11 else None, None, "x") for i in range(n) for k in [langs[i % 3 if i % 7 else 0]]]


def test_gradients_equal_finite_differences():
    net = L.ByteGru(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y, mask = r.integers(0, 256, (5, 4)), np.array([0, 1, 2, 1]), np.ones((5, 4))
    mask[3:, 1] = 0
    _, g = net.gradients(x, mask, y)
    for k in net.p:
        i = (x[1, 2], 4) if k.startswith("in") else tuple(r.integers(s) for s in net.p[k].shape)
        net.p[k][i] += 1e-4
        up, _ = net.gradients(x, mask, y)
        net.p[k][i] -= 2e-4
        down, _ = net.gradients(x, mask, y)
        net.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][i]) < 1e-3 * max(1e-2, abs(g[k][i]))


def test_held_out_accuracy_and_whole_texts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r for r in L.predict_languages(df, L.fit(df)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[2]]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.95
    # a long text whose start is of another language
    net = L.fit(df)
    text = "the river " * 20 + "für über schön mädchen " * 3000
    (label,), (score,) = L.identify(net, [text])
    assert label == "cc" and 0.5 < score <= 1


def test_edge_cases(spark, short_training):
    df = spark.createDataFrame(corpus(90), SCHEMA)
    net = L.fit(df)
    odd = spark.createDataFrame([(1, None, None, "s", None), (2, "", "aa", None, None), (3, "12 34 $%", "aa", None, None), (None, "river house", None, None, None), (4, "the river", "zz", None, None), (4, "the river", "zz", None, None)], SCHEMA)
    out = L.predict_languages(odd, net).collect()
    assert [(r.doc_id, r.lang_pred) for r in out][:3] == [(1, "und"), (2, "und"), (3, "und")] and all(r.score == 0 for r in out[:3])
    assert out[3].doc_id is None and not out[3].held_out and out[4] == out[5] and all(0 <= r.score <= 1 for r in out)
    kept = L.keep_identified(odd, net)
    assert kept.columns == odd.columns and kept.count() == 3
    none = spark.createDataFrame([(1, "the river", None, None, None)], SCHEMA)
    assert [tuple(r) for r in L.predict_languages(none, L.fit(none)).collect()] == [(1, False, "und", 0.0)]
    assert L.predict_languages(df.limit(0), L.fit(df.limit(0))).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark, short_training):
    rows = corpus(150)
    held = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1}
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame([(i, t, "zz" if i in held else k, s, x) for i, t, k, s, x in rows], SCHEMA)
    assert sorted(map(tuple, L.predict_languages(a, L.fit(a)).collect())) == sorted(map(tuple, L.predict_languages(b, L.fit(b)).collect()))


def test_copies_of_a_text_count_once_in_the_sample(spark, monkeypatch):
    rows = [r for r in corpus(300) if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    texts = {k: {t for _, t, x, *_ in rows if x == k} for k in WORDS}
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    least = df.where("lang = 'aa'").orderBy(F.xxhash64("text")).first().text  # sorts first, so its copies would fill the sample
    ids = [i for i in range(1000, 5000) if zlib.crc32(str(i).encode()) % 3 != 1][: len(rows)]
    df = df.union(spark.createDataFrame([(i, least, "aa", None, None) for i in ids], SCHEMA)).repartition(4)
    seen = []
    monkeypatch.setattr(L, "train", lambda samples: seen.extend(samples) or L.ByteGru([]))
    L.fit(df, per_label=20)
    starts = {k: {t[: L.STEPS] for t in texts[k]} & {w for w, x in seen if x == k} for k in WORDS}
    assert all(len(starts[k]) == 20 for k in WORDS)
