r"""Packing by minimum bin slack over the histogram of remaining lengths.

Documents become token ids (the ids of a public tokenizer, then an end id), cut
into items: as many whole windows as fit, and one remainder.  Packing needs the
lengths only, and there are at most ``window`` different ones: the driver sees one
count per length, whatever the corpus holds.  Over that multiset a bounded
subset-sum program, kept as the bits of an integer, finds the lengths that fill
a window closest to its capacity; the chosen counts are read back from the stored
bits, and the pattern is used as often as the counts allow.  When no remaining
multiset fills a window exactly, the items left are cut into pieces whose lengths
are powers of two, and the same program packs those; the last window is closed
as sequences of powers of two, which need no padding.  So no sequence is padded.

The ranks of items of one length are counted inside each task; offsets of the
tasks per length are sums over (length, task) rows.  A pattern is a range of
ranks per length, so every item finds its sequence and offset by one lookup in a
table whose size is bounded by the number of patterns, not by the corpus.

Checksums of an item and of its power-of-two pieces are taken when it is
tokenised, so no ids are stored or shuffled.

Edge cases: null or empty text is one token, the end id; very long texts are many
windows and a remainder; rows with equal or null ids are packed apart, each on
its own; an empty table gives an empty result; other columns are ignored by
``packed_pieces``.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed, table, trimmed

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"


_MARKS = frozenset(b".,;:!?")


class WordIds(dict):
    """Bytes of the ids (little-endian, 32 bits) of a piece of text without white space; tokenised once, then kept.

    The tokenizer drops white space and no token spans it, so a text's ids are the
    ids of its pieces in turn.  It lower-cases too, and a lone sentence mark after a letter
    or digit is a token of its own, so those forms are put together from the plain word.
    A word of lower-case Latin letters passes its normaliser and splitter unchanged; its
    bytes, as the letters the vocabulary writes them with, go to the model at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {k: written(chr(k))[0][0] for k in range(0x80, 0x250)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 500_000:
            self.clear()
        if b"<" not in word and (low := word.lower()) != word:  # special tokens are looked up before case is dropped
            return self[low]
        if word.isalpha():  # ASCII letters
            ids = self._plain(word.decode())
        elif word[-1] in _MARKS and word[-2:-1].isalnum():
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode()
            if text.isalpha() and text.islower() and max(text) < "\u0250":
                ids = self._plain(text.translate(self.letters))
            else:
                ids = array("I", self.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def _plain(self, letters: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode()
        return b"".join(map(self.__getitem__, (data if b"<" in data else data.lower()).split()))


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One table of word ids for each Python worker, kept between its tasks."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def powers(length: int) -> list[tuple[int, int]]:
    """(start, size) of the power-of-two pieces of an item, large ones first."""
    out, at = [], 0
    for k in range(length.bit_length() - 1, -1, -1):
        if length >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each) whose sum comes closest to ``capacity``, as length -> count.

    Bit ``s`` of ``reach`` says that some multiset sums to ``s``.  Larger lengths are
    tried first; the first bits that hold the capacity end the search.
    """
    full, mask = 1 << capacity, (1 << capacity + 1) - 1
    reach, steps = 1, []  # steps: (length, copies in one step, bits before it)
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left > 0 and not reach & full:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left, copies = left - copies, copies * 2
        if reach & full:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            at -= length * copies
            chosen[length] += copies
    return dict(chosen)


def plan(histogram: dict[int, int], window: int = WINDOW) -> tuple[pd.DataFrame, dict[int, int]]:
    """``(ranges, first_cut)``: rows (kind, length, first, last, copies, sequence, offset) and, per length, the rank
    from which items are cut into powers of two (kind 0: whole items, 1: pieces of cut items)."""
    left, rows, sequences = dict(histogram), [], 0
    used: Counter = Counter()

    def take(kind, chosen, times):
        nonlocal sequences
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            rows.append((kind, length, used[kind, length], used[kind, length] + copies * times, copies, sequences, offset))
            used[kind, length] += copies * times
            offset += length * copies
        sequences += times

    def pack(kind, left):
        while left:
            chosen = best_fill(left, window)
            if sum(k * v for k, v in chosen.items()) < window:
                return left
            times = min(left[k] // v for k, v in chosen.items())
            take(kind, chosen, times)
            left = {k: n for k, c in left.items() if (n := c - chosen.get(k, 0) * times)}
        return left

    left = pack(0, left)
    first_cut = {k: histogram[k] - left.get(k, 0) for k in histogram}
    cut: Counter = Counter()
    for length, n in left.items():
        for _, size in powers(length):
            cut[size] += n
    rest = pack(1, dict(cut))
    # less than a window is left, all powers of two: sequences of the powers of two of its total
    total = sum(k * v for k, v in rest.items())
    for k in range(total.bit_length() - 1, -1, -1):
        if total >> k & 1:
            chosen = best_fill(rest, 1 << k)
            take(1, chosen, 1)
            rest = {size: n for size, c in rest.items() if (n := c - chosen.get(size, 0))}
    return pd.DataFrame(rows, columns=["kind", "length", "first", "last", "copies", "sequence", "offset"]), first_cut


def _itemise(path: str, end_id: int, window: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ranks, part = word_ids(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = ids.of(text.as_py()) + end
                tokens = len(data) // 4
                for start in range(0, tokens, window):
                    item = data[4 * start : 4 * (start + window)]
                    n = len(item) // 4
                    sums = [zlib.crc32(item)] + ([zlib.crc32(item[4 * a : 4 * (a + size)]) for a, size in powers(n)] if n < window else [])
                    rows.append((doc_id, start, n, tokens, part, ranks[n], sums))
                    ranks[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), ITEM.types)], schema=ITEM)
        ids.clear()  # idle workers hold no words

    return run


ITEM = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("k", pa.int64()), ("sums", pa.list_(pa.int64()))])


def packed_pieces(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = checkpointed(docs.mapInArrow(
        trimmed(_itemise(path or tokenizer_path(), end_id, window)),
        "doc_id long, start long, length int, doc_tokens long, part int, k long, sums array<long>"))
    tasks = items.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``window`` rows
    ranges, first_cut = plan(histogram, window)

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tasks.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    cut = spark.createDataFrame([(int(k), int(v)) for k, v in first_cut.items()], "length int, first_cut long")
    ranked = (
        items.join(offsets, ["length", "part"])
        .join(F.broadcast(cut), "length")
        .select("*", (F.col("before") + F.col("k")).alias("rank")))

    whole = ranked.where("rank < first_cut").select(
        "doc_id", "start", "length", "doc_tokens", F.col("sums")[0].alias("ids_crc32"), F.lit(0).alias("kind"), "rank")
    # pieces of one size are numbered by (length of the cut item, its rank among the cut ones)
    seen: Counter = Counter()
    pieces = []
    for length in sorted(histogram):
        n = histogram[length] - first_cut[length]
        for i, (at, size) in enumerate(powers(length)) if n else ():
            pieces.append((length, i, at, size, seen[size]))
            seen[size] += n
    pieces = spark.createDataFrame(pieces, "length int, i int, at long, size int, base long")
    parts = ranked.where("rank >= first_cut").join(F.broadcast(pieces), "length").select(
        "doc_id", (F.col("start") + F.col("at")).alias("start"), F.col("size").alias("length"), "doc_tokens",
        F.when(F.col("length") == window, F.col("sums")[0]).otherwise(F.get("sums", F.col("i") + 1)).alias("ids_crc32"), F.lit(1).alias("kind"),
        (F.col("base") + F.col("rank") - F.col("first_cut")).alias("rank"))

    places = spark.createDataFrame(ranges, "kind int, length int, first long, last long, copies long, sequence long, offset long")
    at = F.col("rank") - F.col("first")
    return (
        whole.union(parts).join(F.broadcast(places), ["kind", "length"]).where("rank >= first and rank < last")
        .select(F.col("doc_id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
                (F.col("sequence") + F.floor(at / F.col("copies"))).alias("sequence_id"), (F.col("offset") + at % F.col("copies") * F.col("length")).alias("offset")))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))
