r"""Resampling towards a target distribution by n-gram importance weights.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case; features are all runs of 1 to 3
consecutive words, joined by one space, with repeats.  A feature's bucket is the crc32 of its bytes modulo ``buckets``;
a bucket's gain is the log ratio of its smoothed shares in the target and in the corpus; a document's weight is the sum
of the gains of its features, and its score adds a Gumbel number that depends on the id alone.

1. Corpus and target are counted by bucket inside the tasks (``GramTable``): a task sends at most one row per bucket.
2. The gains (one number per bucket) go to the tasks, which count nothing but sum gains by document.
3. The documents with enough words are numbered by score with range partitions (``operators.numbering``): no rank needs
   all rows in one place, and rows of equal score and id are told apart by a stored row number.

``GramTable`` interns the features of one block of texts: xxhash64 of the bytes gives the first place, places are tried
one after the other, and a place is taken for the same feature only if the bytes agree.  Places hold the bucket and
the count; the occurrences keep the place they were given and look up gains with it.  A block has about ``BLOCK`` bytes:
longer texts are cut between words, with the two words before the cut read again as context.

Edge cases: a null or empty text, or one without a word, has no feature: weight 0, never drawn (it has under
``min_words`` words); a null id draws the number of the empty text and comes last among equal scores; repeated rows are
drawn each by itself, in any order among themselves; an empty corpus gives no row, an empty target only its
smoothing; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import shared_folder, table, trimmed
from equiflow.operators.numbering import numbered

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
BLOCK = 1 << 17
#: Slices beyond this many bytes are hashed and compared one at a time.
LONG = 255

_U = np.uint64
#: The five primes of xxhash64.
P1, P2, P3, P4, P5 = map(_U, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _is_word(b: int) -> bool:
    return b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A


#: Lower case, and every byte that is in no word as a space.
_CLEAN = bytes(x if _is_word(x) else 0x20 for x in (b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _view(data: np.ndarray, kind: str) -> np.ndarray:
    """The ``kind`` that starts at each byte of ``data`` (which ends in 8 spare bytes)."""
    return np.ndarray(shape=(len(data) - 7,), dtype=kind, buffer=data, strides=(1,))


def xxh64(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of many slices of ``data``, which ends in 8 spare bytes."""
    wide, half = _view(data, "<u8"), _view(data, "<u4")
    h = P5 + lens.astype(_U)
    at = np.flatnonzero((lens >= 32) & (lens <= LONG))
    if len(at):
        acc = [np.full(len(at), _U(v % 2**64)) for v in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        stripes = lens[at] // 32
        for s in range(int(stripes.max())):
            on = np.flatnonzero(stripes > s)
            first = starts[at[on]] + 32 * s
            for j in range(4):
                acc[j][on] = _round(acc[j][on], wide[first + 8 * j])
        joined = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            joined = (joined ^ _round(_U(0), a)) * P1 + P4
        h[at] = joined + lens[at].astype(_U)
    rest = np.where(lens > LONG, 0, lens & 31)
    place = starts + (lens - rest)
    for j in range(3):
        on = np.flatnonzero(rest >= 8 * (j + 1))
        if len(on):
            h[on] = _rotl(h[on] ^ _round(_U(0), wide[place[on] + 8 * j]), 27) * P1 + P4
    place, rest = place + (rest & ~7), rest & 7
    on = np.flatnonzero(rest >= 4)
    h[on] = _rotl(h[on] ^ half[place[on]].astype(_U) * P1, 23) * P2 + P3
    place, rest = place + (rest & 4), rest & 3
    for j in range(3):
        on = np.flatnonzero(rest > j)
        h[on] = _rotl(h[on] ^ data[place[on] + j].astype(_U) * P5, 11) * P1
    h ^= h >> _U(33)
    h *= P2
    h ^= h >> _U(29)
    h *= P3
    h ^= h >> _U(32)
    for i in np.flatnonzero(lens > LONG):
        h[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + lens[i]].data)
    return h


@cache
def _advance() -> np.ndarray:
    """By length, byte place and byte: what a crc32 becomes when so many bytes follow (before they are added)."""
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], dtype=np.uint32)
    one = one ^ one[0]  # linear part
    t = np.empty((LONG + 1, 4, 256), np.uint32)
    t[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(LONG):
        t[n + 1] = (t[n] >> 8) ^ one[t[n] & 255]
    return t


def _followed(crc: np.ndarray, lens: np.ndarray, then: np.ndarray) -> np.ndarray:
    """crc32 of A + B from those of A and B and the length of B."""
    t, n = _advance().reshape(-1), lens.astype(np.int64) * 1024
    out = then.copy()
    for k in range(4):
        out ^= t[n + 256 * k + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class GramTable:
    """The features of one block: an open-addressed table with bucket and count slots, and the slot of each occurrence.

    ``pieces`` are (cleaned text, number of words at its start that are context only).
    """

    def __init__(self, pieces: list[tuple[bytes, int]], buckets: int):
        raw = np.frombuffer(b" ".join([t for t, _ in pieces]) + b" ", np.uint8)
        space = raw == 0x20
        before = np.r_[True, space[:-1]]
        first_place = np.cumsum([0] + [len(t) + 1 for t, _ in pieces])
        words = np.diff(np.searchsorted(np.flatnonzero(~space & before), first_place))
        self.data = np.r_[raw[~(space & before)], np.zeros(8, np.uint8)]  # words with one space after each
        space = self.data[:-8] == 0x20
        self.ends = np.flatnonzero(space)
        self.begins = np.r_[0, self.ends[:-1] + 1] if len(self.ends) else self.ends
        n = len(self.ends)
        self.owner = np.repeat(np.arange(len(pieces)), words)
        inside = np.arange(n) - np.repeat(np.cumsum(words) - words, words)  # place in the piece
        new = inside >= np.repeat(np.array([c for _, c in pieces], dtype=np.int64), words)
        two, three = np.flatnonzero(new & (inside > 0)), np.flatnonzero(new & (inside > 1))
        self.last = np.r_[np.arange(n), two, three]
        self.order = np.repeat(np.array([1, 2, 3], dtype=np.int8), [n, len(two), len(three)])
        self.counted = np.r_[new, np.ones(len(two) + len(three), bool)]
        self.starts = self.begins[self.last - (self.order - 1)]
        self.lens = self.ends[self.last] - self.starts
        self._intern(xxh64(self.data, self.starts, self.lens))
        self._fill(buckets)

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether slices agree byte by byte (a, b: occurrence numbers)."""
        wide = _view(self.data, "<u8")
        la, sa, sb = self.lens[a], self.starts[a], self.starts[b]
        ok = la == self.lens[b]
        on = np.flatnonzero(ok & (la < 8))
        mask = (_U(1) << (8 * la[on]).astype(_U)) - _U(1)
        ok[on] = ((wide[sa[on]] ^ wide[sb[on]]) & mask) == 0
        on = np.flatnonzero(ok & (la >= 8) & (la <= LONG))
        ok[on] = wide[sa[on] + la[on] - 8] == wide[sb[on] + la[on] - 8]
        j = 0
        while len(on := on[ok[on] & (la[on] >= 8 * (j + 1))]):
            ok[on] = wide[sa[on] + 8 * j] == wide[sb[on] + 8 * j]
            j += 1
        for i in np.flatnonzero(ok & (la > LONG)):
            ok[i] = np.array_equal(self.data[sa[i]:sa[i] + la[i]], self.data[sb[i]:sb[i] + la[i]])
        return ok

    def _intern(self, keys: np.ndarray) -> None:
        m = len(keys)
        size = 1 << max(4, int(2 * m).bit_length())
        self.holder = np.full(size, -1, np.int64)  # the occurrence whose bytes a slot holds
        self.slot = np.empty(m, np.int64)
        at = (keys & _U(size - 1)).astype(np.int64)
        todo = np.arange(m)
        while len(todo):
            held = self.holder[at]
            free = held < 0
            if free.any():
                self.holder[at[free]] = todo[free]
                held = self.holder[at]
            mine = held == todo
            mine |= (keys[held] == keys[todo])
            check = np.flatnonzero(mine & (held != todo))
            mine[check] = self._same(todo[check], held[check])
            self.slot[todo[mine]] = at[mine]
            todo, at = todo[~mine], (at[~mine] + 1) & (size - 1)

    def _fill(self, buckets: int) -> None:
        size, n = len(self.holder), len(self.ends)
        self.count = np.bincount(self.slot[self.counted], minlength=size)
        crc = np.zeros(size, np.uint32)
        used = np.flatnonzero(self.holder >= 0)
        rep = self.holder[used]
        kind = np.where((self.lens[rep] > LONG) | (self.order[rep] == 1), 0, self.order[rep])
        for s in used[kind == 0]:
            i = self.holder[s]
            crc[s] = zlib.crc32(self.data[self.starts[i]:self.starts[i] + self.lens[i]].data)
        word = crc[self.slot[:n]]  # of each word
        size_of = self.ends - self.begins
        blank = np.full(1, zlib.crc32(b" "), np.uint32)
        for order in (2, 3):
            at = used[kind == order]
            last = self.last[self.holder[at]]
            made = word[last - order + 1]
            for back in range(order - 2, -1, -1):
                w = last - back
                made = _followed(_followed(made, np.ones(len(w), np.int64), blank.repeat(len(w))), size_of[w], word[w])
            crc[at] = made
        self.bucket = (crc % np.uint32(buckets)).astype(np.int64)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.bucket, weights=self.count, minlength=buckets).astype(np.int64)

    def sums(self, gains: np.ndarray, pieces: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By piece: words, features, and the sum of the features' gains."""
        owner = self.owner[self.last[self.counted]]
        gained = gains[self.bucket][self.slot[self.counted]]
        features = np.bincount(owner, minlength=pieces)
        words = np.bincount(self.owner[self.counted[:len(self.ends)]], minlength=pieces)
        return words, features, np.bincount(owner, weights=gained, minlength=pieces).astype(np.int64)


def _pieces(texts: Iterator[bytes | None], block: int) -> Iterator[tuple[list[int], list[tuple[bytes, int]]]]:
    """Blocks of (numbers of texts, pieces of them); longer texts are cut between words, two words before a cut are context."""
    owners, held, total = [], [], 0
    for k, text in enumerate(texts):
        clean, at, context = (text or b"").translate(_CLEAN), 0, []
        while True:
            cut = clean.find(b" ", at + block) if len(clean) - at > block else -1
            part = clean[at:cut] if cut >= 0 else clean[at:]
            owners.append(k)
            held.append((b" ".join([*context, part]), len(context)))
            total += len(part) + 1
            if total >= block:
                yield owners, held
                owners, held, total = [], [], 0
            if cut < 0:
                break
            at, context = cut, (context + part.rsplit(None, 2)[-2:])[-2:]
    if held:
        yield owners, held


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes | None]:
    return (v.as_py() for v in batch.column(column).cast(pa.binary()))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, block: int = BLOCK) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def partial(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in _pieces(_texts(batch, "text"), block):
                total += GramTable(held, buckets).bucket_counts(buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": on.astype(np.int32), "n": total[on]}, pa.schema([("bucket", pa.int32()), ("n", pa.int64())]))

    parts = df.select(F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(trimmed(partial), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket."""
    s_all, t_all, m = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + m)) / ((s + 1.0) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighed(df: DataFrame, gains: np.ndarray, text_col: str = "text", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """``id, n_words, n_features, weight`` of each row."""
    buckets = len(gains)
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    def score(batches):
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for owners, held in _pieces(_texts(batch, "text"), block):
                for total, more in zip(out, GramTable(held, buckets).sums(gains, len(held))):
                    np.add.at(total, owners, more)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, out)], schema=schema)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(trimmed(score), "id long, n_words long, n_features long, weight long")


def importance_scores(df: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text",
                      percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, n_features, weight, score, rank``; rank (1, 2, ...) where it is drawn.

    ``percent`` of the documents with ``min_words`` words or more are drawn: those with the highest scores, of equal
    scores the smaller ids.
    """
    spark = df.sparkSession
    gains = bucket_gains(bucket_counts(df, text_col, buckets), bucket_counts(target, target_col, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed(df, gains, text_col, id_col).withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("spread", F.xxhash64(F.monotonically_increasing_id()))
    folder = shared_folder(spark, "importance-scores")
    scored.write.parquet(folder)
    scored = spark.read.schema(scored.schema).parquet(folder)
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(enough).count() // 100
    places = numbered(scored.where(enough), [F.desc("score"), F.asc_nulls_last("id"), F.col("spread")], "rank", start=1)
    ranked = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resampled(df: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``df`` whose id is drawn, with all their columns."""
    ids = importance_scores(df, target, text_col, id_col, **parameters).where("rank IS NOT NULL").select(F.col(id_col).alias("__drawn")).distinct()
    return df.join(ids, df[id_col].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return importance_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
