r"""Exact n-gram Jaccard self-join by universe partitioning.

A document's set is its distinct ``width``-word shingles (with fewer words the
whole sequence is one).  Two documents link when 100 |A n B| >= 80 |A u B|.

Method.  Sets fall into bands by size.  In a band the universe of shingles is
hashed into ``m`` segments, so a set becomes ``m`` segment subsets.  A pair with
sizes r >= s that links differs in at most H = floor((r + s) / 9) shingles, so
if the larger set spends H + 1 units on segments (none: skip; one: the subsets
are equal; two: they differ by one shingle at most), some segment it spent on
matches within its allowance.  Each set indexes, in its own band, the hash of
every subset and, for the first segments, its one-deletion neighbourhood; it
probes, in its own band and each lower band that can hold a partner, the
subsets its allocation chose.  The allocation is by cost: the units go to the
subsets with the fewest expected matches (document frequencies of frequent
shingles; a subset without a rare shingle or without any is dear).  Costs steer
work only; any allocation of H + 1 units is exact, as empty subsets are indexed
too and can be bought when nothing else is left.

Rows with one segment hash meet in a partition, sorted, probers first, and are
read as a stream: each row is paired with the first of its bucket, never all
with all, and a bucket is never held.  Pairs are verified on the words of both
texts.  Links give components; only buckets that still hold two components are
read again, in blocks of bounded size: rows of different components are compared
by sketches whose distance is never more than the sets' (so no link is lost).  Of the
pairs left open first a spanning forest is verified, then, between components that are
still apart, every one.  Pairs that are neither linked nor close never become rows,
and a large group of copies costs one comparison per member and bucket head.
Documents with equal sets are one class before all this, with a number of its own, so
links do not depend on ids.

Edge cases: null or empty text has no shingles, is linked with nothing and is
its own component; a row with a null id links as any other and gets the smallest id
that it reaches, or null where it reaches none; rows that repeat an id are compared by
their own texts, each with its own component; other columns
are ignored by ``jaccard_components`` and passed through by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed, free_name, partition_bound, table, trimmed
from equiflow.llm.components import components
from equiflow.llm.words import ODD, blocks, hashes, lowered, mix, spans

WIDTH = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
BAND_RATIO = 1.5
#: Segments of a band with an indexed one-deletion neighbourhood.
DELETION_SEGMENTS = 6
#: Shingles counted as frequent at most (steers costs only, no result depends on it): one MB to broadcast.
FREQUENT = 65_536
#: Bits of the map that tells which texts verification needs: 4 MB whatever the input; when it fills up it only filters less.
NEEDED_BITS = 1 << 25
INDEX, INDEX_DELETED, PROBE, PROBE_DELETED = 1, 2, 4, 8

#: Bits of the difference sketch of a set (the parity of its shingles in each of so many classes).
SKETCH_BITS = 1024
#: Shingles of texts kept for the next pairs of a task.
SHINGLES_KEPT = 100_000
#: Rows of a bucket that one task compares with as many others at a time.
BLOCK_ROWS = 4096

def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at [\\x20\\x09-\\x0D] (what bytes.lower and bytes.split do)."""
    return lowered(text).split()


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    data, starts, ends, counts = spans(texts)
    w = hashes(data, starts, ends)
    rolled = w[: max(0, len(w) - width + 1)].copy()
    for k in range(1, width):
        rolled = rolled * ODD + w[k : k + len(rolled)]
    rolled, out, at = mix(rolled), [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            x = np.full(1, n, np.uint64)
            for k in range(n):
                x = mix(x * ODD + w[at + k])
            out.append(x)
        else:
            out.append(w[:0])
        at += n
    return out


def bands_upto(size: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band, as far as ``size``; the same for every input."""
    out, low = [], 1
    while low <= size:
        high = max(low, int(low * BAND_RATIO) - 1) if low > 2 else low
        out.append((low, high))
        low = high + 1
    return out


def segments_of(high: int) -> int:
    """Segments of a band: what its largest partner may need (differences plus one), and a few to skip."""
    m = (high * 100 // PERCENT + high) * (100 - PERCENT) // (100 + PERCENT) + 1
    return m + 1 + m // 16


class _Signer:
    """Signatures of sets; the document frequencies of frequent shingles steer which ones a set probes."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent, self.counts = frequent, counts
        self.bands = bands_upto(64)

    def df(self, h: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.ones(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        return np.where(self.frequent[at] == h, self.counts[at], 1)

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Packed (hash, role) of non-empty sets, and the set of each: own band and the lower bands a set probes."""
        sizes = np.array([len(h) for h in sets], np.int64)
        if sizes.max() > self.bands[-1][1]:
            self.bands = bands_upto(2 * int(sizes.max()))
        df = np.split(self.df(np.concatenate(sets)), np.cumsum(sizes)[:-1])
        least = -(-sizes * PERCENT // 100)
        keys, of = [], []
        for k, (low, high) in enumerate(self.bands):
            here = np.flatnonzero((high >= least) & (low <= sizes))
            if len(here):
                key, at = self._band(np.concatenate([sets[i] for i in here]), np.concatenate([df[i] for i in here]), sizes[here], k, high)
                keys.append(key)
                of.append(here[at])
        return np.concatenate(keys), np.concatenate(of)

    def _band(self, h: np.ndarray, df: np.ndarray, sizes: np.ndarray, band: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        m, own = segments_of(high), sizes <= high
        need = (sizes + np.minimum(sizes, high)) * (100 - PERCENT) // (100 + PERCENT) + 1
        salt = np.uint64((band + 1) * int(ODD) & 0xFFFFFFFFFFFFFFFF)
        g = mix(h ^ salt)
        cell = np.repeat(np.arange(len(sizes)) * m, sizes) + (g % np.uint64(m)).astype(np.int64)  # (set, segment)
        order = np.argsort(cell << 20 | np.minimum(df, (1 << 20) - 1))
        cell, g, df = cell[order], mix(g[order]), df[order]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        full, count = cell[starts], np.diff(np.r_[starts, len(cell)])
        sums = np.zeros(len(sizes) * m, np.uint64)
        sums[full] = np.add.reduceat(g, starts)
        base = mix(np.arange(m, dtype=np.uint64) * ODD + salt)
        # units by cost: equal subsets, then one-deletion of the same, empty subsets last
        cost = np.full(len(sums), 1e18)
        cost[full] = df[starts] * (1 + 1 / count)
        near = np.flatnonzero((full % m < DELETION_SEGMENTS) & (count >= 2))
        dear = np.maximum(df[starts[near] + 1] * (count[near] + 1.0), cost[full[near]])
        unit_cell = np.r_[np.arange(len(sums)), full[near]]
        unit_set = unit_cell // m
        kind = np.r_[np.zeros(len(sums), np.int8), np.ones(len(near), np.int8)]
        ranked = np.lexsort((kind, np.r_[cost, dear], unit_set))
        first = np.searchsorted(unit_set[ranked], np.arange(len(sizes)))
        bought = np.zeros(len(ranked), bool)
        bought[ranked] = np.arange(len(ranked)) - first[unit_set[ranked]] < need[unit_set[ranked]]
        role = np.where(np.repeat(own, m), INDEX, 0) | np.where(bought[: len(sums)], PROBE, 0)
        some = np.flatnonzero(role)
        keys, roles, cells = [mix(sums[some] + base[some % m])], [role[some]], [some]
        gone = np.where(own[full[near] // m] & (count[near] >= 3), INDEX_DELETED, 0) | np.where(bought[len(sums) :], PROBE_DELETED, 0)
        near, gone = near[gone > 0], gone[gone > 0]
        if len(near):
            at = np.repeat(starts[near] - np.r_[0, np.cumsum(count[near])[:-1]], count[near]) + np.arange(count[near].sum())
            keys.append(mix(sums[cell[at]] - g[at] + base[cell[at] % m]))
            roles.append(np.repeat(gone, count[near]))
            cells.append(cell[at])
        key = (np.concatenate(keys) & np.uint64(0xFFFFFFFFFFFFFFF0)).view(np.int64) | (15 - np.concatenate(roles))
        return key, np.concatenate(cells) // m


def _describe(width: int):
    """kind 0: a row's set size and the two halves of its set's hash; kind 1: a frequent shingle and its documents here."""
    schema = pa.schema([("kind", pa.int32())] + [(c, pa.int64()) for c in ("doc_id", "th", "n", "hi", "lo")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo = [], [], []
            for sets in (_shingles(x, width) for x in blocks(x.as_py() for x in batch.column("text"))):
                n += [len(h) for h in sets]
                for h in sets:
                    key = xxhash.xxh3_128_intdigest(h.tobytes())
                    hi.append(_signed(key >> 64) if len(h) else None)
                    lo.append(_signed(key & (2**64 - 1)) if len(h) else None)
                values, counts = _frequent(sets)
                none = pa.nulls(len(values), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), none, none, pa.array(counts), pa.array(values.view(np.int64)), none], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], schema=schema)

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than one of 256 of the sets at hand (three at least)."""
    all_of = np.sort(np.concatenate(sets))
    if not len(all_of):
        return all_of, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, all_of[1:] != all_of[:-1]])
    counts = np.diff(np.r_[starts, len(all_of)])
    often = counts >= max(3, len(sets) // 256)
    return all_of[starts][often], counts[often].astype(np.int64)


def _sign(width: int, frequent: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen = _Signer(frequent, counts), set()
        for batch in batches:
            for sets in (_shingles(x, width) for x in blocks(x.as_py() for x in batch.column("text"))):
                fresh, sids = [], []
                for h in sets:
                    sid = _signed(xxhash.xxh3_128_intdigest(h.tobytes()) >> 64)
                    if len(h) and sid not in seen:  # else an equal set of this task has written them
                        if len(seen) < 1_000_000:
                            seen.add(sid)
                        fresh.append(h)
                        sids.append(sid)
                if fresh:
                    key, of = signer.signatures(fresh)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(sids, np.int64)[of])], ["key", "sid"])

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, sid) rows: each row of a bucket whose head is a prober, with the head; one bucket runs over many batches."""
    last = None  # (bucket, head sid, head role)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = batch.column("key").to_numpy(), batch.column("sid").to_numpy()
        bucket, role = key >> 4, 15 - (key & 15)
        first = np.r_[True, bucket[1:] != bucket[:-1]]
        heads = np.flatnonzero(first)
        at = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(key)]))
        head, head_role = sid[heads], role[heads]
        if last is not None and last[0] == bucket[0]:
            head[0], head_role[0] = last[1:]
        last = (bucket[-1], head[-1], head_role[-1])
        keep = (head_role[at] >= PROBE) & (sid != head[at])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (bucket, sid, role.astype(np.int32), head[at], head_role[at].astype(np.int32))], ["bucket", "sid", "role", "head", "head_role"])


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts link, by their words."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def shingles(text: str) -> frozenset:
        w = words_of(text)
        return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        held = 0

        def of(node, text):
            nonlocal held
            if node not in kept:
                if held > SHINGLES_KEPT:
                    kept.clear()
                    held = 0
                kept[node] = shingles(text.as_py())
                held += len(kept[node])
            return kept[node]

        for x in batches:
            ok = []
            for b, ta, tb in zip(x.column("b").to_pylist(), x.column("text_a"), x.column("text_b")):
                sa, sb = shingles(ta.as_py()), of(b, tb)
                same = len(sa & sb)
                ok.append(same > 0 and 100 * same >= PERCENT * (len(sa) + len(sb) - same))
            yield x.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(run), "a long, b long")


def _likely(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose hash ``k`` of id and text is among those of ``needed``, and few others, so that a join moves few texts.

    The hashes are marked in a map of fixed size, made in Spark from pieces of 4 KB.
    """
    place = F.col("k").bitwiseAND(NEEDED_BITS - 1) + 1
    marked = needed.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(NEEDED_BITS >> 3, np.uint8)
    for r in marked.collect():
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("k").to_numpy() & (NEEDED_BITS - 1)
            yield batch.filter(pa.array(bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0))

    return docs.select("doc_id", "text", "th", F.xxhash64("doc_id", "th").alias("k")).mapInArrow(trimmed(run), "doc_id long, text string, th long, k long")


def _sketches(texts: DataFrame, width: int) -> DataFrame:
    """``node, sketch``: parities of a set's shingles by class; two sets differ in as many shingles as bits, or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sets in (_shingles(x, width) for x in blocks(batch["text"])):
                for h in sets:
                    odd = np.bincount((mix(h) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                    out.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pd.DataFrame({"node": batch["node"], "sketch": out})

    return texts.mapInPandas(trimmed(run), "node long, sketch binary")


def _across(forest: bool):
    """Of sorted rows of cells (two blocks of a bucket, or one): pairs of different components that probe and may link.

    Each pair is compared once in a cell, in numpy, and only those that sizes and
    sketches leave open become rows; with ``forest`` only as many of them as connect the
    components that they connect.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            where = rest[["bucket", "cell"]].to_numpy()
            cuts = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1]
            if len(cuts) > 1:
                yield _open_pairs(rest.iloc[: cuts[-1]], cuts, forest)
                rest = rest.iloc[cuts[-1] :]
        if rest is not None and len(rest):
            yield _open_pairs(rest, np.array([0, len(rest)]), forest)

    return run


def _open_pairs(rows: pd.DataFrame, cuts: np.ndarray, forest: bool) -> pd.DataFrame:
    node, n, role, root, block = (rows[c].to_numpy() for c in ("node", "n", "role", "root", "block"))
    sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    cuts = np.r_[cuts[cuts < len(rows)], len(rows)]
    end = np.repeat(cuts[1:], np.diff(cuts))
    whole = (rows["cell_first"] == rows["cell_last"]).to_numpy()
    hit = lambda a, b: ((a & PROBE > 0) & (b & (INDEX | INDEX_DELETED) > 0)) | ((a & PROBE_DELETED > 0) & (b & INDEX > 0))
    found, left = [], np.arange(len(rows))
    for step in range(1, len(rows)):  # each row with the row so many places on in its cell
        left = left[left + step < end[left]]
        if not len(left):
            break
        keep = left[(root[left] != root[left + step]) & (whole[left] | (block[left] != block[left + step]))]
        i, j = keep, keep + step
        near = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * PERCENT
        i, j = i[near], j[near]
        up = hit(role[j], role[i])
        down = hit(role[i], role[j])
        may = np.where(n[i] == n[j], up | down, np.where(n[j] > n[i], up, down))
        i, j = i[may], j[may]
        differ = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
        open_ = differ * (100 + PERCENT) <= (n[i] + n[j]) * (100 - PERCENT)
        found.append(np.column_stack([i[open_], j[open_]]))
    at = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if forest:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        joins = []
        for k, (x, y) in enumerate(zip(root[at[:, 0]].tolist(), root[at[:, 1]].tolist())):
            x, y = top(x), top(y)
            if x != y:
                above[x] = y
                joins.append(k)
        at = at[joins]
    return pd.DataFrame(np.unique(np.sort(node[at], axis=1), axis=0), columns=["a", "b"])


def jaccard_links(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, classes, links)``: ``doc_id, th, n, hi, lo`` of each row (th: hash of its text); ``hi, lo, node, n, rep,
    rep_th`` of each distinct set (node: a number; rep, rep_th: its smallest id, null only if it has none, and a text of that
    id); ``a, b`` between nodes, enough links to connect all that link."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    base = checkpointed(docs.mapInArrow(trimmed(_describe(width)), "kind int, doc_id long, th long, n long, hi long, lo long"))
    rows = base.where("kind = 0").select("doc_id", "th", "n", "hi", "lo")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = rows.where("n > 0").groupBy("hi", "lo").agg(first_row.alias("r"), F.max("n").alias("n"))
    classes = checkpointed(classes.select("hi", "lo", F.monotonically_increasing_id().alias("node"), "n", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("rep_th")))
    least = max(16, rows.count() // 1024)
    often = base.where("kind = 1").groupBy("hi").agg(F.sum("n").alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "hi").limit(FREQUENT).toPandas()
    values = often["hi"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    values, counts = values[order], often["c"].to_numpy(np.int64)[order]

    parts = partition_bound(df)
    signed = docs.select("text").mapInArrow(trimmed(_sign(width, values, counts)), "key long, sid long")
    met = signed.repartition(parts, F.shiftright("key", 4)).sortWithinPartitions("key", "sid")
    met = checkpointed(met.mapInArrow(trimmed(_heads), "bucket long, sid long, role int, head long, head_role int"))

    nodes = classes.select(F.col("hi").alias("sid"), "node", "n")
    shared = nodes.alias("x").join(nodes.alias("y"), "sid").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))  # sets whose short ids clash
    pairs = (
        met.select("sid", "head").distinct()
        .join(nodes.select("sid", F.col("node").alias("a"), F.col("n").alias("na")), "sid")
        .join(nodes.select(F.col("sid").alias("head"), F.col("node").alias("b"), F.col("n").alias("nb")), "head")
        .where(f"least(na, nb) * 100 >= greatest(na, nb) * {PERCENT} and a != b").select("a", "b").union(shared))
    pairs = checkpointed(pairs.select("a", "b").distinct())
    needed = met.select("sid").union(met.select("head")).distinct().join(nodes, "sid").select("node").union(shared.select("a")).union(shared.select("b")).distinct()
    needed = checkpointed(needed.join(classes, "node").select("node", "rep", "rep_th", F.xxhash64("rep", "rep_th").alias("k")))
    same_row = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))
    by_key = _likely(docs, needed).join(needed, "k").groupBy("k", "node")  # one dealing of the texts, by k
    texts = checkpointed(by_key.agg(F.max(F.when(same_row, F.col("text"))).alias("text")).select("node", "text"))
    first = checkpointed(_verified(pairs, texts, width))

    # what a bucket head could not tell: rows of one bucket that are in different components by now; first
    # pairs that would connect all components, then, with those verified, every pair left open
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    members = met.select("bucket", "sid", "role").union(met.select("bucket", F.col("head").alias("sid"), F.col("head_role").alias("role")).distinct()).join(nodes, "sid").drop("sid")
    links = first
    for forest in (True, False):
        roots = components(links)
        more = checkpointed(_cells(members, roots, texts, width, parts).mapInPandas(trimmed(_across(forest)), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"))
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(checkpointed(_verified(more, texts, width)))
        tried = tried.union(more)
    return rows, classes, links


def _cells(members: DataFrame, roots: DataFrame, texts: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows of the buckets that hold two components, dealt to cells of two blocks (or one) of their bucket, sorted."""
    members = members.join(roots, "node", "left").select("bucket", "node", "n", "role", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")).where("x != y").select("bucket", "blocks")
    rows = members.join(mixed, "bucket").join(_sketches(texts, width), "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "node", "n", "role", "root", "sketch", "block", F.least("block", "other").alias("cell_first"), F.greatest("block", "other").alias("cell_last"))
    cells = cells.withColumn("cell", F.col("cell_first").cast("long") * (1 << 31) + F.col("cell_last"))
    return cells.repartition(parts, "bucket", "cell").sortWithinPartitions("bucket", "cell")


def _components(df: DataFrame, text_col: str, id_col: str, width: int) -> DataFrame:
    """``doc_id, th, n, component`` of each row."""
    rows, classes, links = jaccard_links(df, text_col, id_col, width)
    roots = components(links)
    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(classes, "node").groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select("node", "least")
    named = checkpointed(classes.join(linked, "node", "left").select("hi", "lo", F.coalesce("least", "rep").alias("component")))
    return rows.join(named, ["hi", "lo"], "left").select("doc_id", "th", "n", F.coalesce("component", "doc_id").alias("component"))


def jaccard_components(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, n_shingles, component_id``."""
    return _components(df, text_col, id_col, width).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def near_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """The rows of ``df`` that hold the smallest id of their component, with all columns.

    Rows without id go where their component has one, and stay where it has none.
    """
    root, text = free_name(df, "root"), free_name(df, "text")
    gone = _components(df, text_col, id_col, width).where(~F.col("doc_id").eqNullSafe(F.col("component")))
    gone = gone.select(F.col("doc_id").alias(root), F.col("th").alias(text)).distinct()
    return df.join(gone, df[id_col].cast("long").eqNullSafe(gone[root]) & (F.xxhash64(df[text_col]) == gone[text]), "left_anti")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
