import random
import re

from equiflow.llm import jaccard_join as J

SCHEMA = "doc_id long, text string, n string, root string, component_id string"


def brute(rows, width=5):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same and 100 * same >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


def corpus(seed, docs=260):
    """Groups of copies with a few edits each (a chain too), a passage that many share, and short texts."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(40)]
    rows, at = [], 0

    def add(words):
        nonlocal at
        rows.append((at, " ".join(words)))
        at += 1

    while at < docs:
        size = r.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 30, 60, 150, 400])
        base = [r.choice(vocab) for _ in range(size)]
        if r.random() < 0.5:
            k = r.randrange(len(base) + 1)
            base = base[:k] + passage + base[k:]
        add(base)
        for _ in range(r.choice([0, 0, 1, 2, 8])):
            x = list(base)
            for _ in range(r.choice([0, 1, 1, 2, max(1, len(x) // 40), max(1, len(x) // 25)])):
                k = r.randrange(len(x))
                x[k : k + r.choice([0, 1])] = [r.choice(vocab)] * r.choice([0, 1, 1])
                x = x or ["w0"]
            add(x)
            if r.random() < 0.5:
                base = x
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*x, "a", "b", None) for x in rows], SCHEMA).repartition(6)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}


def test_components_equal_brute_force(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows)


def test_one_large_group_with_a_common_passage(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(220):
        x = list(base)
        for _ in range(r.randrange(7)):
            x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(x)))
    rows += [(2000 + i, " ".join(base[:40] + [f"o{r.randrange(10**6)}" for _ in range(60)])) for i in range(120)]
    assert run(spark, rows) == brute(rows)


def test_any_allocation_finds_every_pair():
    """Signatures alone: whatever the frequencies say, a linking pair shares a segment within its allowance."""
    import numpy as np

    r = np.random.default_rng(3)
    for trial in range(400):
        n = int(r.integers(1, 90))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        cut = int(r.integers(0, len(a) // 5 + 1))
        b = np.unique(np.r_[r.permutation(a)[cut:], r.integers(0, 2**63, int(r.integers(0, len(a) // 5 + 1)), dtype=np.uint64)])
        same = len(np.intersect1d(a, b))
        if not same or 100 * same < 80 * (len(a) + len(b) - same):
            continue
        often = np.sort(r.permutation(np.union1d(a, b))[: int(r.integers(0, n + 1))])
        s = J._Signer(often, r.integers(3, 10_000, len(often)))
        roles = []
        for x in (a, b):
            k, _ = s.signatures([x])
            roles.append({})
            for key in k.tolist():
                roles[-1][key >> 4] = roles[-1].get(key >> 4, 0) | (15 - (key & 15))

        def hit(p, i):
            return any(k in i and ((v & J.PROBE and i[k] & (J.INDEX | J.INDEX_DELETED)) or (v & J.PROBE_DELETED and i[k] & J.INDEX)) for k, v in p.items())

        large, small = (0, 1) if len(a) >= len(b) else (1, 0)
        assert hit(roles[large], roles[small]), (trial, len(a), len(b))


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "x " * 30_000), (7, "X\x0b" * 30_000), (8, "é a b c d e"), (9, "É a b c d e")]
    assert run(spark, rows) == brute(rows) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (2, 8), 9: (2, 9)}
    df = spark.createDataFrame([(None, "a b c", None, None, None), (3, "a b c", None, None, None), (3, "a b c", None, None, None), (None, "lone", None, None, None)], SCHEMA)
    assert sorted(map(tuple, J.jaccard_components(df).collect()), key=str) == [(3, 1, 3), (3, 1, 3), (None, 1, 3), (None, 1, None)]
    kept = J.near_dedup(spark.createDataFrame([(x[0], x[1], "a", "b", "c") for x in rows], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8, 9] and kept.columns == df.columns
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_unlinked_rows_of_one_bucket_in_small_blocks(spark, monkeypatch):
    """A group whose members are near the threshold, with blocks of four rows."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 4)
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(120):
        x = list(base)
        for _ in range(r.randrange(2, 9)):
            k = r.randrange(len(x))
            x[k : k + 1] = [f"e{r.randrange(40)}"] * r.choice([0, 1, 2])
        rows.append((i, " ".join(x)))
    assert run(spark, rows) == brute(rows)


def test_links_do_not_depend_on_ids(spark):
    """Null ids, and ids that repeat with other texts: every row links by its own text."""
    a, z, lone = (" ".join(f"{c}{i}" for i in range(60)) for c in "azl")
    docs = [(7, a), (7, z), (9, a + " more"), (5, z + " more"), (None, a + " end"), (None, lone), (None, lone + " more"), (11, "q r s"), (None, None)]
    df = spark.createDataFrame([(*x, "a", "b", None) for x in docs], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 56, 7), (7, 56, 5), (9, 57, 7), (5, 57, 5), (None, 57, 7), (None, 56, None), (None, 57, None), (11, 1, 11), (None, 0, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in J.near_dedup(df).collect()), key=str)
    assert kept == sorted([(7, a), (5, z + " more"), (None, lone), (None, lone + " more"), (11, "q r s"), (None, None)], key=str)


def test_long_words_that_a_polynomial_would_confuse(spark):
    morse = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    rows = [(1, morse), (2, morse.translate(str.maketrans("ab", "ba"))), (3, "a"), (4, "a\0"), (5, "abcdefgh"), (6, "abcdefgh\0"), (7, "x" * 16), (8, "x" * 17), (9, morse)]
    assert run(spark, rows) == brute(rows) == {i: (1, 1 if i == 9 else i) for i in range(1, 10)}
