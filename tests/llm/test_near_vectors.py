import math

import numpy as np

from equiflow.llm import near_vectors as N
from tests.llm.test_components import brute as union_find
from tests.conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<float>, label int, NODE string"


def brute(rows, threshold=0.95):
    """Rows of the result, all pairs compared."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    v = np.array([np.array(rows[k][1], np.float32).astype(float) for k in good])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= threshold
    np.fill_diagonal(near, False)
    links = {k: int(n) for k, n in zip(good, near.sum(axis=1))}
    root = union_find([(good[a], good[b]) for a, b in np.argwhere(near)])
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root.get(k, k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [x for x in least[root.get(k, k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, links.get(k, 0), c, None if i is None or c is None else i == c))
    return out


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def families(seed=1):
    """Single vectors, pairs, a family larger than a list, two large families that only link with each other, copies."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    near = lambda base, far: unit(base + far * unit(r.normal(size=16)))
    vecs = [unit(r.normal(size=16)) for _ in range(300)]
    vecs += [near(vecs[k], 0.15) for k in range(40)]
    vecs += [near(vecs[50], 0.1) for _ in range(60)]
    side = unit(r.normal(size=16))
    other = unit(side + 0.28 * unit(r.normal(size=16)))
    vecs += [near(side, 0.02) for _ in range(40)] + [near(other, 0.02) for _ in range(40)]
    vecs += [vecs[3]] * 25 + [vecs[50]] * 25
    return [(k, [float(c) for c in 3 * v]) for k, v in enumerate(vecs)]


def test_families_against_all_pairs(spark):
    rows = families()
    got = N.near_vectors(spark.createDataFrame([(a, b, 0, "") for a, b in rows], SCHEMA), block=32)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert plain(got.collect()) == plain(brute(rows))


def test_whole_table_against_all_pairs(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    assert plain(N.op13_near_vectors(spark, SF_CHECK).collect()) == plain(brute(rows))


def test_odd_vectors_ids_and_repeated_rows(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(5, a), (5, a), (None, b), (7, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (None, [-1.0, 0.0, 0.0]), (8, [1e30, 2e30, 3e30]), (4, [3.0, 0.0, 0.0])]
    odd = [(1, None), (1, [1.0, None, 1.0]), (2, [0.0, 0.0, 0.0]), (3, [float("nan"), 1.0, 1.0]), (9, []), (None, None)]
    got = N.near_vectors(spark.createDataFrame([(x, y, 0, "") for x, y in rows + odd], SCHEMA))
    assert plain(got.collect()) == plain(brute(rows + odd))
    short = N.near_vectors(spark.createDataFrame([(1, a, 0, ""), (2, b, 0, ""), (3, [1.0], 0, ""), (4, [1.0], 0, ""), (6, [2.0], 0, "")], SCHEMA).where("vec_id != 6"))
    assert plain(short.collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False)]


def test_empty_table(spark):
    assert N.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_sees_what_is_missing(spark):
    unit = spark.createDataFrame([(k, 1, [1.0, 0.001 * k]) for k in range(10)], "node long, n long, unit array<double>")
    counts = spark.createDataFrame([(k, 9, 9 if k < 5 else 0) for k in range(10)], "node long, links long, others long")
    assert N.audit(counts, unit, 0.95, 100) == 0.5
