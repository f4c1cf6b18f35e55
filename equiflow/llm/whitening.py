"""Embedding whitening by spectral divide and conquer on polar decompositions.

1. ``fit_list``: each entry c becomes the integer floor(64 c) + 1000000; every distinct integer vector once
   (an aggregate, so copies are combined in the map tasks), written as a table.
2. ``fit``: exact sums per dimension, then the covariance, centred before multiplying.  Tasks send one partial row per
   matrix row, and the partial rows of a matrix row are added up where they meet; only the d x d matrix goes to the
   driver (d is the dimension of the vectors, whatever their number).
3. ``spectral_split``: the polar factor U of V - s I (QDWH: dynamically weighted Halley steps) is the matrix sign; (U + I) / 2
   projects on the eigenvalues above s.  Bases of its range and of the complement split V into two smaller symmetric
   matrices, which are split again down to single components.
4. ``whiten``: the d x 16 matrix of scaled components goes to the tasks; no row is shuffled.

Edge cases: rows with a null vector, or with null or non-finite entries, are left out; so are rows with an entry of
2**40 or more in size (no exact integers) and rows whose length differs from the most frequent one (of equally frequent
lengths the longest; empty vectors count as malformed).  Components with an eigenvalue of zero to double precision are not
returned, as nothing can be divided by it: a table of one distinct vector, or an empty one, gives no rows.  Equal
eigenvalues leave their components free within the common subspace; any basis of it is returned, the same for all
rows.  Repeated rows and null ids are returned row by row.  A ``deviation`` beyond 63 bits is null.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import discard, partition_bound, shared_folder, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LIMIT = float(1 << 40)
_EPS = np.finfo(float).eps


def usable(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``id, x``: the rows that remain, x as an array of longs."""
    vec = F.col(vec_col).cast("array<double>")
    good = F.col(vec_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    rows = df.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def fit_list(rows: DataFrame) -> DataFrame:
    return rows.select("x").distinct()


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, exact sums, eigenvalues and components (columns), trace, and the error of whitening."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _centring(n: int, sums: tuple[int, ...]):
    """x - S/n with one rounding: whole and broken part of the mean are taken off one after the other."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(np.float64) - rest


def _sums(fitted: DataFrame) -> tuple[int, tuple[int, ...]]:
    def partial(batches):
        total, n = None, 0
        for batch in batches:
            for part in (_matrix(batch)[at:at + 4096] for at in range(0, batch.num_rows, 4096)):
                add = [int(v) for v in part.sum(axis=0)]  # below 2**46 * 2**12
                total, n = add if total is None else [a + b for a, b in zip(total, add)], n + len(part)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": list(range(len(total))), "total": [str(v) for v in total], "n": [n] * len(total)},
                                             pa.schema([("dim", pa.int32()), ("total", pa.string()), ("n", pa.int64())]))

    parts = fitted.mapInArrow(partial, "dim int, total string, n long")
    got = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).orderBy("dim").collect()
    return (int(got[0]["n"]) if got else 0), tuple(int(r["total"]) for r in got)


def _gram(fitted: DataFrame, made) -> np.ndarray:
    """The sum of z' z over the rows z = made(x): partial rows by task, added up row by row of the matrix."""

    def partial(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                z = made(_matrix(batch)[at:at + 4096])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "row": list(total)}, schema)

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), _matrix(batch, "row")):
                held[i] = held[i] + row if i in held else row.copy()
        if held:
            yield pa.RecordBatch.from_pydict({"i": np.array(list(held), dtype=np.int32), "row": list(held.values())}, schema)

    schema = pa.schema([("i", pa.int32()), ("row", pa.list_(pa.float64()))])
    spec = "i int, row array<double>"
    parts = fitted.mapInArrow(partial, spec).repartition(partition_bound(fitted), "i").mapInArrow(added, spec)
    return np.array([r["row"] for r in sorted(parts.collect(), key=lambda r: r["i"])])


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix (its matrix sign) by dynamically weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x)) * (1 + n * _EPS))
    except np.linalg.LinAlgError:
        low = _EPS
    low = min(max(low if np.isfinite(low) else _EPS, _EPS), 1.0)
    eye = np.eye(n)
    for _ in range(40):
        sq = low * low
        d = np.cbrt(4 * (1 - sq) / (sq * sq))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - sq) / (sq * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # far from orthogonal: the step by QR is stable
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * sq) / (1 + wc * sq), 1.0)
        if moved < np.cbrt(_EPS) * np.linalg.norm(x) and 1 - low < 1e-8 or moved < 10 * _EPS * n:
            break
    return x


def _split(a: np.ndarray, shift: float, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Bases of the invariant subspaces above and below the shift, and how far they are from invariant; None if one is empty."""
    n = len(a)
    above = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    k = int(round(np.trace(above)))
    if not 0 < k < n:
        return None
    q, _ = np.linalg.qr(above @ start[:, :k], mode="complete")
    q, _ = np.linalg.qr(above @ q[:, :k], mode="complete")
    return q[:, :k], q[:, k:], float(np.linalg.norm(q[:, :k].T @ a @ q[:, k:]))


def spectral_split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix."""
    values, vectors = [], []
    rng = np.random.default_rng(7)
    size = np.linalg.norm(a)
    todo = [((a + a.T) / 2, np.eye(len(a)))]
    while todo:
        part, basis = todo.pop()
        n = len(part)
        mean = np.trace(part) / n
        if n == 1 or np.linalg.norm(part - mean * np.eye(n)) <= 2 * _EPS * size:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        diagonal = np.diag(part)
        spread = np.linalg.norm(part - mean * np.eye(n)) / np.sqrt(n)  # of the eigenvalues around their mean
        # The median of the diagonal halves most spectra; the mean always has eigenvalues on both sides.
        shifts = [np.median(diagonal), mean, *(mean + spread * rng.uniform(-0.3, 0.3, 6))]
        best = None
        for shift in shifts:
            got = _split(part, shift, rng.standard_normal((n, n)))
            if got and (best is None or got[2] < best[2]):
                best = got
            if best and best[2] <= 4 * n * _EPS * size:
                break
        if best is None:  # rounding alone tells these eigenvalues apart
            values += list(diagonal)
            vectors += list(basis.T)
            continue
        for q in best[:2]:
            low = q.T @ part @ q
            todo.append(((low + low.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")
    v = np.array(vectors)[order].T if vectors else np.zeros((0, 0))
    return np.einsum("ij,ij->j", v, a @ v) if len(v) else np.zeros(0), v


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of the distinct vectors of ``rows`` (``usable``), or None where there are none."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "whitening-fit")
    fit_list(rows).write.parquet(folder)
    fitted = spark.read.schema("x array<bigint>").parquet(folder)
    try:
        n, sums = _sums(fitted)
        if not n:
            return None
        centred = _centring(n, sums)
        cov = _gram(fitted, centred) / n
        values, vectors = spectral_split(cov)
        keep = values > 4 * len(values) * _EPS * max(values[0], 0.0)
        found = Fit(n, sums, values[keep][:components], vectors[:, keep][:, :components], float(np.trace(cov)))
        if not len(found.values):
            return None
        w = found.scaled
        # x - S/n has mean zero over the fit list, so its projections are centred before they are multiplied.
        error = np.abs(_gram(fitted, lambda x: centred(x) @ w) / n - np.eye(w.shape[1])).max()
        return Fit(found.n, found.sums, found.values, found.vectors, found.trace, float(error))
    finally:
        discard(spark, folder)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """The sum over dimensions of (n x - S)**2 of each row, exact; None beyond 63 bits."""
    near = np.array([s // n for s in sums], dtype=np.int64)
    size = n * (float(np.abs(x - near).max(initial=0)) + 1)
    if size * size * len(sums) < 2.0**62:
        away = n * (x - near) - np.array([s % n for s in sums], dtype=np.int64)
        return [int(v) for v in (away * away).sum(axis=1)]
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x)
    return [v if v < 2**63 else None for v in exact]


SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``df`` and component: ``<id_col>, component, n, deviation, whitened, explained, identity_error``."""
    rows = usable(df, vec_col, id_col)
    found = fit(rows, components)
    if found is None:
        return df.sparkSession.createDataFrame([], SCHEMA).withColumnRenamed("id", id_col)
    n, sums, w, centred = found.n, found.sums, found.scaled, _centring(found.n, found.sums)
    k, share, error = w.shape[1], found.values / found.trace, found.identity_error
    schema = pa.schema([("id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def project(batches):
        for batch in batches:
            for part in (batch.slice(at, 2048) for at in range(0, batch.num_rows, 2048)):
                x, m = _matrix(part), part.num_rows
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(_deviations(x, n, sums), pa.int64()).take(each), pa.array((centred(x) @ w).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], schema=schema)

    return rows.mapInArrow(project, SCHEMA).withColumnRenamed("id", id_col)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
