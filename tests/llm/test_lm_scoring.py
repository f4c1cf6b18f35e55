import random
import zlib
from collections import Counter

import numpy as np
import pytest

from equiflow.llm import lm_scoring as M

SCHEMA = "doc_id long, text string, word string, uid string, score string"


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def brute_base(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1, len(x), sum(c[w] > 0 for w in x), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, t in rows for x in [tokens(t)]}


def corpus(n=400):
    r = random.Random(6)
    a, b = [f"a{i}n" for i in range(60)], [f"q{i}zz" for i in range(60)]
    rows = [(i, " ".join((r.choice(v) if r.random() < 0.9 else f"Rare{r.randrange(10**6)},") for _ in range(r.randrange(3, 80)))) for i in range(n) for v in [(a, b)[i % 2]]]
    return rows + [(n + 1, None), (n + 2, ""), (n + 3, " \n"), (n + 4, "A0N a0n\x0ba0n " * 3000), (n + 5, "Ünseen only here"), (None, "a1n q1zz")]


@pytest.mark.parametrize("dictionary", [50, 100_000])
def test_base_equals_brute_force_and_model_beats_it(spark, monkeypatch, dictionary):
    monkeypatch.setattr(M, "DICTIONARY", dictionary)
    rows = corpus()
    df = spark.createDataFrame([(*x, "w", "u", None) for x in rows], SCHEMA).repartition(4)
    out, want = M.lm_scores(df).collect(), brute_base(rows)
    assert len(out) == len(rows)
    for r in out:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_of_all_outcomes_sum_to_one(spark):
    df = spark.createDataFrame([(*x, "w", "u", None) for x in corpus(120)], SCHEMA)
    others, lexicon, net, totals = M.fit(df)
    before = np.random.default_rng(1).integers(0, lexicon.classes, (M.CONTEXT, 20))
    p = np.array([10 ** net.log_probability(before, np.full(20, k)) for k in range(lexicon.classes)])
    assert np.allclose(p.sum(0), 1)
    left = [(bytes(r.word), r.c) for r in others.collect()]
    mass = np.bincount(lexicon.cls, 10**lexicon.log, minlength=lexicon.classes)
    if left:
        mass += np.bincount(lexicon.spelled([w for w, _ in left]), [c + 0.5 for _, c in left], minlength=lexicon.classes)
    mass[lexicon.first_spelled :] += 0.5
    assert np.allclose(mass[1:], 10 ** lexicon.log_mass[1:])


def test_noise_contrastive_estimation_learns_a_bigram():
    r, k = np.random.default_rng(0), 6
    net = M.LogBilinear(np.ones(k))
    square = {n: np.full_like(v, 1e-4) for n, v in net.p.items()}
    for _ in range(400):
        prev = r.integers(0, k, 512)
        before = np.stack([prev, *(r.integers(0, k, 512) for _ in range(M.CONTEXT - 1))])
        net.learn(before, (prev + 1) % k, square, r, 0.1)
    before = np.stack([np.arange(k), *(np.zeros((M.CONTEXT - 1, k), np.int64))])
    assert (10 ** net.log_probability(before, (np.arange(k) + 1) % k) > 0.6).all()


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.lm_scores(none).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (row,) = M.lm_scores(spark.createDataFrame([(held, "never seen", "w", "u", None)], SCHEMA)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    twice = M.lm_scores(spark.createDataFrame([(3, "same text", "w", "u", None)] * 2, SCHEMA)).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
