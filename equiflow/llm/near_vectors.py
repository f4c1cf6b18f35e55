"""Near-duplicate embeddings by NN-descent: links of cosine >= threshold, link counts and components.

1. ``classes``: rows of equal vectors are one class with a count (an aggregate, so a hot vector is combined in the map
   tasks); all further work is on classes.
2. ``start``: classes are sorted by the signs of random projections, and each block of neighbours in that order is
   compared; the ``k`` best of a few such orders are the first neighbour lists.
3. ``descend``: what lists a common neighbour meets there (neighbours of neighbours, both directions, at most ``reach`` of
   the reverse ones a round, drawn anew each round), is compared if one of the two is new there, and the better ones go
   into the lists, until a round finds next to no new link.
4. A list is saturated when all its ``k`` entries are links.  It is then enlarged to its whole group: all classes that
   links connect, after further orders looked for bridges between groups (``bridges``).  Such groups are compared
   completely in blocks of ``block`` classes; tasks send counts by class, never pairs.
5. ``audit``: a bounded sample of classes is compared with all others; under ``recall`` of their links, the descent starts
   anew from the lists it has and further orders.

Lists hold half-precision vectors; every link is checked in double precision afterwards.

Edge cases: vectors that are null, empty, zero or hold null or non-finite entries link with nothing (each row is its own
component); a vector of another length than the most frequent one (of equally frequent ones the longest) links only with
its equals; a null id is never the smallest of a component, so a component of null ids alone has a null ``component_id`` and
null ``kept``; rows that repeat an id are rows of their own, whatever their vectors; an empty table gives an empty
result; other columns are ignored.

A group of m classes that all link with each other costs m * m / 2 comparisons in numpy, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed, partition_bound, shared_folder, table, trimmed
from equiflow.llm.components import components

THRESHOLD = 0.95
K, REACH = 12, 8
ORDERS, LEAF, BITS = 3, 64, 60
ROUNDS, RESTARTS = 8, 3
BLOCK = 2048
SAMPLE, RECALL = 1024, 0.98
#: Half-precision entries of unit vectors are off by a 2**-11th at most, so cosines by less than this.
MARGIN = 0.002

STATE = "node long, vec binary, nbrs array<long>, sims array<float>, fresh array<boolean>"
_STATE = pa.schema([("node", pa.int64()), ("vec", pa.binary()), ("nbrs", pa.list_(pa.int64())), ("sims", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])


def classes(df: DataFrame, vec_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``id, node`` of each row (node null where the vector links with nothing) and ``node, n, unit`` of each class, both written."""
    spark = df.sparkSession
    vec = F.col("v")
    good = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(vec, lambda c: c != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("v", F.when(F.coalesce(good, F.lit(False)), vec))
    folder = shared_folder(spark, "vector-classes")
    known = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id())
    known.write.parquet(folder)
    known = spark.read.schema(known.schema).parquet(folder)
    usual = known.groupBy(F.size("v").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = usual["d"] if usual else 0

    def scaled(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, d)
            v = v / np.abs(v).max(axis=1, keepdims=True)  # no square overflows
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), d).cast(pa.list_(pa.float64()))], names=["node", "n", "unit"])

    unit = known.where(F.size("v") == d).mapInArrow(scaled, "node long, n long, unit array<double>")
    placed = rows.join(known.select("v", "node", "n"), "v", "left").select("id", "node", "n")
    return placed, unit


def _binary(column: pa.Array, kind) -> np.ndarray:
    """Equally long binary values as rows of a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches sorted by ``key``, cut anew so that no key is in two of them."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        keys = now.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        held = now.slice(cut)
        if cut:
            yield now.slice(0, cut).combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _best(own: np.ndarray, other: np.ndarray, sims: np.ndarray, fresh: np.ndarray, k: int):
    """The ``k`` most similar different others of each own, sorted by own; an entry known before stays known."""
    order = np.lexsort((fresh, other, own))
    own, other, sims, fresh = own[order], other[order], sims[order], fresh[order]
    first = np.r_[True, (own[1:] != own[:-1]) | (other[1:] != other[:-1])] if len(own) else np.zeros(0, bool)
    own, other, sims, fresh = own[first], other[first], sims[first], fresh[first]
    order = np.lexsort((other, -sims, own))
    own, other, sims, fresh = own[order], other[order], sims[order], fresh[order]
    start = np.searchsorted(own, own)
    keep = np.arange(len(own)) - start < k
    return own[keep], other[keep], sims[keep], fresh[keep]


def _lists(nodes: np.ndarray, vecs: pa.Array, own, other, sims, fresh) -> pa.RecordBatch:
    """State rows of ``nodes`` (sorted) from entries sorted by own."""
    at = pa.array(np.r_[np.searchsorted(own, nodes), len(own)].astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(nodes, pa.int64()), vecs, pa.ListArray.from_arrays(at, pa.array(other, pa.int64())),
        pa.ListArray.from_arrays(at, pa.array(sims, pa.float32())), pa.ListArray.from_arrays(at, pa.array(fresh, pa.bool_()))], schema=_STATE)


def _proposals(own, other, sims, k: int) -> pa.RecordBatch:
    own, other, sims, fresh = _best(own, other, sims, np.ones(len(own), bool), k)
    nodes = np.unique(own)
    return _lists(nodes, pa.nulls(len(nodes), pa.binary()), own, other, sims, fresh)


def _planes(seed: int, d: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, BITS)).astype(np.float32)


def _ordered(state: DataFrame, seed: int, parts: int, *more: str) -> DataFrame:
    """``node, vec`` and ``more``, sorted by the signs of random projections in range partitions; equal signs are spread."""

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                v = _binary(batch.column("vec"), np.float16).astype(np.float32)
                code = ((v @ _planes(seed, v.shape[1])) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=[*batch.schema.names, "code"])

    rows = state.select("node", "vec", *more)
    spec = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", code long"
    order = ["code", F.xxhash64("node", F.lit(seed))]
    return rows.mapInArrow(coded, spec).repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _leaves(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, LEAF):
            part = batch.slice(at, LEAF)
            v = _binary(part.column("vec"), np.float16).astype(np.float32)
            sims = v @ v.T
            np.fill_diagonal(sims, -2)
            yield part, sims


def _first_lists(state: DataFrame, seeds, parts: int, k: int) -> DataFrame:
    """Proposals from blocks of neighbours in random orders."""

    def near(batches):
        for part, sims in _leaves(batches):
            node = part.column("node").to_numpy()
            m = min(k, len(node) - 1)
            if m > 0:
                best = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                yield _proposals(np.repeat(node, m), node[best].ravel(), np.take_along_axis(sims, best, 1).ravel(), k)

    out = None
    for seed in seeds:
        one = _ordered(state, seed, parts).mapInArrow(near, STATE)
        out = one if out is None else out.unionByName(one)
    return out


def _merged(state: DataFrame, proposals: DataFrame, k: int) -> DataFrame:
    """Lists with the proposals taken in; entries they held before count as known."""

    def merge(batches):
        for t in _whole(batches, "node"):
            nodes, inverse = np.unique(t.column("node").to_numpy(), return_inverse=True)
            vec = t.column("vec").combine_chunks()
            row = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
            lists = t.column("nbrs").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            own = nodes[np.repeat(inverse, sizes)]
            proposed = np.repeat(~vec.is_valid().to_numpy(zero_copy_only=False), sizes)
            entries = _best(own, lists.flatten().to_numpy(), t.column("sims").combine_chunks().flatten().to_numpy(), proposed, k)
            yield _lists(nodes, vec.take(pa.array(row)), *entries)

    both = state.unionByName(proposals).repartition(partition_bound(state), "node").sortWithinPartitions("node")
    return checkpointed(both.mapInArrow(trimmed(merge), STATE))


def _round(state: DataFrame, seed: int, k: int, reach: int) -> DataFrame:
    """Proposals: what meets at a common neighbour, compared there."""
    listed = state.select(F.col("node").alias("src"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("e")).select("src", F.col("e.nbrs").alias("dst"), F.col("e.fresh").alias("fresh"))
    drawn = Window.partitionBy("dst").orderBy(F.desc("fresh"), F.xxhash64("src", "dst", F.lit(seed)))
    back = listed.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= reach).drop("r")
    both = back.unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "fresh"))
    least = F.when(F.size("sims") >= k, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float")
    sent = both.join(state.select(F.col("node").alias("src"), "vec", least.alias("least")), "src")

    def compare(batches):
        for t in _whole(batches, "dst"):
            for at in range(0, t.num_rows, 1 << 14):
                yield from meet(t, at, min(t.num_rows, at + (1 << 14)))

    def meet(t, at, upto):
        keys = t.column("dst").to_numpy()
        at, upto = (int(np.searchsorted(keys, keys[x])) if x < len(keys) else x for x in (at, upto))  # whole groups
        if at == upto:
            return
        t, keys = t.slice(at, upto - at), keys[at:upto]
        src, fresh, least = (t.column(c).to_numpy() for c in ("src", "fresh", "least"))
        order = np.lexsort((~fresh, src, keys))
        order = order[np.r_[True, (keys[order][1:] != keys[order][:-1]) | (src[order][1:] != src[order][:-1])]]
        keys, src, fresh, least = keys[order], src[order], fresh[order], least[order]
        vec = _binary(t.column("vec").combine_chunks().take(pa.array(order)), np.float16).astype(np.float32)
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
        held, width = np.full((len(size), size.max()), -1), int(size.max())
        held[group, place] = np.arange(len(keys))
        found = []
        for g in range(0, len(size), 1024):
            h = held[g:g + 1024]
            v = vec[h] * (h >= 0)[:, :, None]
            sims = v @ v.transpose(0, 2, 1)
            there = (h >= 0)[:, :, None] & (h >= 0)[:, None, :] & ~np.eye(width, dtype=bool)
            there &= fresh[h][:, :, None] | fresh[h][:, None, :]
            a, i, j = np.nonzero(there & (sims > least[h][:, :, None]))
            found.append((src[h[a, i]], src[h[a, j]], sims[a, i, j]))
        own, other, sims = (np.concatenate(x) for x in zip(*found))
        if len(own):
            yield _proposals(own, other, sims, k)

    return sent.repartition(partition_bound(state), "dst").sortWithinPartitions("dst").mapInArrow(trimmed(compare), STATE)


def _near(state: DataFrame, least: float, fresh_only: bool = False) -> DataFrame:
    """``a, b`` (a < b) of list entries of this similarity or more."""
    e = state.select("node", F.explode(F.arrays_zip("nbrs", "sims", "fresh")).alias("e")).where(F.col("e.sims") >= least)
    e = e.where("e.fresh") if fresh_only else e
    return e.select(F.least("node", "e.nbrs").alias("a"), F.greatest("node", "e.nbrs").alias("b"))


def descend(state: DataFrame, threshold: float, k: int, reach: int, rounds: int, seed: int) -> DataFrame:
    for r in range(rounds):
        state = _merged(state, _round(state, seed + r, k, reach), k)
        news, links = _near(state, threshold - MARGIN, True).count(), _near(state, threshold - MARGIN).count()
        if r and news * 1000 <= links:
            break
    return state


def _cosine(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _verified(pairs: DataFrame, unit: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of this cosine in double precision."""
    left = unit.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
    right = unit.select(F.col("node").alias("b"), F.col("unit").alias("ub"))
    return pairs.distinct().join(left, "a").join(right, "b").where(_cosine("ua", "ub") >= threshold).select("a", "b")


def _bridges(state: DataFrame, labels: DataFrame, threshold: float, seeds, parts: int) -> DataFrame:
    """Links between classes of different groups that lie in one block of a random order."""

    def across(batches):
        for part, sims in _leaves(batches):
            node, label = (part.column(c).to_numpy() for c in ("node", "label"))
            a, b = np.nonzero(np.triu((sims >= threshold - MARGIN) & (label[:, None] != label[None, :])))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    marked = checkpointed(state.select("node", "vec").join(labels.select("node", F.col("root").alias("r")), "node", "left").select("node", "vec", F.coalesce("r", "node").alias("label")))
    out = None
    for seed in seeds:
        one = _ordered(marked, seed, parts, "label").mapInArrow(across, "a long, b long")
        out = one if out is None else out.unionByName(one)
    return out


def _group_counts(unit: DataFrame, labels: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node, links, others`` of all classes of ``groups``, each group compared completely in blocks."""
    inside = labels.join(groups, "root").select("node", "root")
    sizes = inside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = inside.join(sizes, "root").join(unit, "node").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = checkpointed(members.groupBy("root", "blocks", "i").agg(F.collect_list(F.struct("node", "n", "unit")).alias("cell")))  # about ``block`` classes each
    left = cells.withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    right = cells.select("root", F.col("i").alias("j"), F.col("cell").alias("other"))
    pairs = left.join(right, ["root", "j"]).select((F.col("i") == F.col("j")).alias("own"), "cell", "other").repartition(partition_bound(unit))

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("own")[k].as_py()
                (na, ca, a), (nb, cb, b) = (parts(batch.column(c)[k].values) for c in ("cell", "other"))
                near = a @ b.T >= threshold
                if own:
                    np.fill_diagonal(near, False)
                yield counted(na, near, cb)
                if not own:
                    yield counted(nb, near.T, ca)

    def parts(cell):
        node, n, unit_ = (cell.field(x) for x in range(3))
        return node.to_numpy(), n.to_numpy(), unit_.flatten().to_numpy().reshape(len(node), -1)

    def counted(node, near, n):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(near @ n), pa.array(near.sum(axis=1))], names=["node", "links", "others"])

    return pairs.mapInArrow(trimmed(compare), "node long, links long, others long").groupBy("node").agg(F.sum("links").alias("links"), F.sum("others").alias("others"))


def audit(counts: DataFrame, unit: DataFrame, threshold: float, sample: int) -> float:
    """The share of all links of a sample of classes (compared with every class) that ``counts`` has."""
    asked = unit.orderBy(F.xxhash64("node", F.lit(11)), "node").limit(sample).join(counts, "node", "left").select("node", "unit", F.coalesce("others", F.lit(0)).alias("others")).collect()
    if not asked:
        return 1.0
    v = np.array([r["unit"] for r in asked])
    have = {r["node"]: r["others"] for r in asked}
    nodes = np.array([r["node"] for r in asked])

    def compare(batches):
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                total += (v @ part.column("unit").flatten().to_numpy().reshape(part.num_rows, -1).T >= threshold).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "n"])

    true = {r["node"]: r["n"] - 1 for r in unit.select("unit").mapInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    return sum(min(have[x], true[x]) for x in true) / max(sum(true.values()), 1)


def near_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, k: int = K, reach: int = REACH,
                 rounds: int = ROUNDS, restarts: int = RESTARTS, block: int = BLOCK, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, n_links, component_id, kept``."""
    spark = df.sparkSession
    placed, unit = classes(df, vec_col, id_col)
    folder = shared_folder(spark, "vector-units")
    unit.write.parquet(folder)
    unit = spark.read.schema(unit.schema).parquet(folder)

    def halved(batches):
        for batch in batches:
            v = batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float16) if batch.num_rows else []
            empty = np.zeros(0, np.int64)
            node = batch.column("node").to_numpy()
            yield _lists(node, pa.array([x.tobytes() for x in v], pa.binary()), empty, empty, empty.astype(np.float32), empty.astype(bool))

    parts = min(partition_bound(unit), unit.count() // (8 * LEAF) + 1)  # ranges of several blocks
    state = unit.select("node", "unit").mapInArrow(halved, STATE)
    for start in range(restarts + 1):
        seed = 1000 * start
        state = _merged(state, _first_lists(state, range(seed, seed + ORDERS), parts, k), k)
        state = descend(state, threshold, k, reach, rounds, seed)
        links = checkpointed(_verified(_near(state, threshold - MARGIN), unit, threshold))
        roots = components(links)
        full = state.where((F.size("sims") >= k) & (F.array_min("sims") >= threshold - MARGIN)).select("node")
        if not full.isEmpty():
            found = _verified(_bridges(state, roots, threshold, range(seed + 500, seed + 500 + ORDERS), parts), unit, threshold)
            links = checkpointed(links.union(found).distinct())
            roots = components(links)
        labels = checkpointed(roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root")).distinct())
        groups = checkpointed(full.join(labels, "node").select("root").distinct())
        size = unit.select("node", "n")
        ends = links.union(links.select("b", "a")).toDF("node", "o")
        inside = labels.join(groups, "root", "left_semi").select("node")
        simple = ends.join(inside, "node", "left_anti").join(size.withColumnsRenamed({"node": "o"}), "o").groupBy("node").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("others"))
        counts = checkpointed(simple.unionByName(_group_counts(unit, labels, groups, threshold, block)))
        if audit(counts, unit, threshold, sample) >= recall:
            break

    root = F.coalesce("root", "node")
    known = placed.join(labels, "node", "left").join(counts.select("node", "links"), "node", "left").select(
        "id", F.when(F.col("node").isNotNull(), root).alias("root"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).cast("long").alias("n_links"))
    folder = shared_folder(spark, "vector-rows")
    known.write.parquet(folder)
    known = spark.read.schema(known.schema).parquet(folder)
    least = known.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    return known.join(least, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))).select(
        F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op13_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
