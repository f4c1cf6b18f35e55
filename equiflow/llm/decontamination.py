r"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: case and outer punctuation go; numbers, names
(capitalised words) and units (after a number) become typed placeholders,
neighbouring names one together.  A capitalised word that opens a sentence may be
a name or not, so there are two templates: one takes openers as words, the other
as names.  Windows of ``width`` tokens of the plain words and of both templates of
the benchmark are a table of hashes; the windows of all whole documents meet it in
an equi-join, and the slots of each template window travel along.  Per document and
item the windows are judged: a template window counts only if at least half of it
is literal words (checked in the benchmark) and if its slots are consistent with the
windows taken before: each benchmark name, number or unit stands for one value in
the document, and no two names or units for the same.  That catches questions asked
again with other numbers and names, and leaves texts alone that only share a sentence
frame.  A document holds an item if the windows that count cover at least
``min_coverage`` of the item's tokens on one diagonal or on diagonals that follow
each other in both texts and are at most ``width`` tokens apart (a slot that is
longer in the document shifts what follows).

Before the join a bit map of the benchmark's hashes (two bits a hash, ``MAP_BITS``
bits or 64 MB at most, whatever the benchmark's size) leaves out document windows that
cannot match.  The table of benchmark windows is broadcast up to
``broadcast_windows`` rows; beyond, both sides are dealt by hash and a frequent
window is split by Spark's skew join.  Only windows that meet are dealt by document
and item, copies of a row counted before.  Documents are read once and never shuffled by
``contaminated_pairs``; ``drop_contaminated`` reads them again against the digests of
the texts to go.

Edge cases: null and empty texts hold nothing; an item with fewer than
``MIN_TOKENS`` tokens is never matched; one shorter than a window is one window;
equal items are reported each; rows that repeat an id are reported each; null ids are
reported as null; an empty benchmark or table gives an empty result; other columns
are ignored by ``contaminated_pairs`` and passed through by ``drop_contaminated``.
Column names are found as Spark finds them.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed, free_name, table, trimmed

WIDTH = 8
MIN_TOKENS = 4
MIN_COVERAGE = 0.5
MAP_BITS = 29
BROADCAST_WINDOWS = 400_000
WORDS_AT_ONCE = 150_000
#: Units that may follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ton tons ounce ounces pound pounds "
    "ml l litre litres liter liters gallon gallons second seconds s minute minutes min hour hours h day days week weeks "
    "month months year years percent % $ € £ dollar dollars cent cents euro euros degree degrees °c °f w kw watt watts "
    "v volt volts hz khz mhz ghz b kb mb gb tb byte bytes km/h mph m/s"
).split()

LITERAL, NUMBER, NAME, UNIT, NOTHING = range(5)
_P = np.uint64(0x9E3779B97F4A7C15)
_TYPED = np.array([0, 0xA1, 0xA2, 0xA3], np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"[+-]?\d[\d.,/:]*")
_SENTENCE_END = re.compile(r"[.!?:][\"')\]]*$")


class _Words(dict):
    """word -> place in two arrays: hash of the plain word; kind, whether a sentence ends after it (8) and whether punctuation follows (16)."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.clear()
        self.plain, self.flags = array("Q"), array("B")

    def __missing__(self, word: str) -> int:
        last = word[-1]
        if word.isalpha():
            core, flags = word, 0
        elif last in ".,;:!?" and word[:-1].isalpha():
            core, flags = word[:-1], 16 if last in ",;" else 24
        else:
            core = word if word.lower() in _UNITS else _OUTER.sub("", word)
            flags = 8 * bool(_SENTENCE_END.search(word)) + 16 * (not last.isalnum())
        low = core.lower()
        if not low:
            flags |= NOTHING
        elif low in _UNITS:
            flags |= UNIT
        elif core[0].isupper() and not core.isupper():
            flags |= NAME
        elif _NUMBER.match(low) and _NUMBER.fullmatch(low):
            flags |= NUMBER
        self.plain.append(xxhash.xxh64_intdigest(low.encode("utf-8", "replace")))
        self.flags.append(flags)
        self[word] = at = len(self.plain) - 1
        return at


_UNITS = frozenset(UNITS)


class _Sequence:
    """Tokens of several texts at one level: text, plain hash, kind, hash at the level, first raw token and the one after the last, whether a sentence's opener is in it as a name."""

    def __init__(self, of, plain, kind, typed, first, after, opener):
        self.of, self.plain, self.kind, self.typed, self.first, self.after, self.opener = of, plain, kind, typed, first, after, opener

    def windows(self, sizes: Iterable[int], template: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, hash, place) of the windows that lie in one text."""
        rolled = np.zeros(len(self.of), np.uint64)
        for k in range(max(sizes, default=0)):
            rolled = rolled[: max(len(self.of) - k, 0)] * _P + self.typed[k:]
            if k + 1 in sizes and len(rolled):
                h = (rolled + np.uint64(2 * k + template)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                yield k + 1, h ^ (h >> np.uint64(29)), np.flatnonzero(self.of[: len(h)] == self.of[k:])


def _template(of: np.ndarray, plain: np.ndarray, kind: np.ndarray, apart: np.ndarray, opener: np.ndarray) -> _Sequence:
    """The tokens with neighbouring names as one; ``apart`` says that a token is set off from the next."""
    n = len(of)
    joined = np.zeros(n, bool)
    joined[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (of[1:] == of[:-1]) & ~apart[:-1]
    first = np.flatnonzero(~joined)
    after = np.r_[first[1:], n][: len(first)]
    place = np.arange(n) - np.repeat(first, after - first)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(place.max(initial=0), _P)])
    merged = np.add.reduceat(plain * power[place], first) if n else plain
    of, kind = of[first], kind[first]
    opens = np.logical_or.reduceat(opener, first) if n else opener
    return _Sequence(of, merged, kind, np.where(kind == LITERAL, merged, _TYPED[np.minimum(kind, UNIT)]), first, after, opens)


def _sequences(docs: list[list[str]], words: _Words) -> tuple[_Sequence, _Sequence, _Sequence]:
    """The texts as plain words, as a template with openers as words, and as one with openers as names."""
    ids = np.fromiter((words[w] for doc in docs for w in doc), np.int64, sum(map(len, docs)))
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    plain, flags = np.array(words.plain, np.uint64)[ids], np.array(words.flags, np.uint8)[ids]
    kind, ends, apart = (flags & 7).astype(np.int8), flags & 8 > 0, flags & 16 > 0
    start = np.r_[True, ends[:-1] | (of[1:] != of[:-1])][: len(ids)]
    real = kind != NOTHING
    apart[:-1] |= ~real[1:]
    of, plain, kind, start, apart = of[real], plain[real], kind[real], start[real], apart[real]
    after_number = np.r_[False, (kind[:-1] == NUMBER) & (of[1:] == of[:-1])][: len(of)]
    kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
    opener = (kind == NAME) & start
    at, none = np.arange(len(of)), np.zeros(len(of), bool)
    return (
        _Sequence(of, plain, kind, plain, at, at + 1, none),
        _template(of, plain, np.where(opener, LITERAL, kind), apart, none),
        _template(of, plain, kind, apart, opener),
    )


def _with_opener(seq: _Sequence, n: int, at: np.ndarray) -> np.ndarray:
    """Those of the windows of ``n`` tokens that hold an opener taken as a name."""
    upto = np.r_[0, np.cumsum(seq.opener)]
    return at[upto[at + n] > upto[at]]


def _bits(values: np.ndarray, n: int, at: np.ndarray) -> list[bytes]:
    return [values[a : a + n].tobytes() for a in at.tolist()]


def _item_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of items (key, text): hash, place and length in plain tokens, kinds and plain hashes of a template window."""
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            levels = _sequences([text.split()], _Words())
            total = len(levels[0].of)
            for level, seq in enumerate(levels):
                n = min(width, len(seq.of))
                if n < MIN_TOKENS:
                    continue
                for _, h, at in seq.windows({n}, min(level, 1)):
                    if level:
                        at = at[2 * np.convolve(seq.kind == LITERAL, np.ones(n, int), "valid")[at] >= n]
                    if level == 2:
                        at = _with_opener(seq, n, at)
                    k, none = len(at), [b""] * len(at)
                    yield pa.RecordBatch.from_pydict({
                        "item": pa.array([key] * k, pa.string()), "total": pa.array([total] * k, pa.int64()),
                        "h": pa.array(h[at].view(np.int64)), "n": pa.array([n] * k, pa.int64()),
                        "q": pa.array(seq.first[at], pa.int64()), "r": pa.array(seq.after[at + n - 1] - seq.first[at], pa.int64()),
                        "kinds": pa.array(_bits(seq.kind, n, at) if level else none, pa.binary()),
                        "here": pa.array(_bits(seq.plain, n, at) if level else none, pa.binary()),
                    })


class WindowMap:
    """Two bits for each hash of the benchmark, in 64-bit words; what it leaves out is not in the benchmark."""

    def __init__(self, windows: DataFrame, bits: int):
        self.bits = bits
        two = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned(F.shiftleft("h", bits), 64 - bits)))
        words = windows.select(two.alias("i")).groupBy(F.shiftright("i", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(i & 63 as int)))").alias("b")).toArrow()
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)

    def among(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        for left in (0, self.bits):
            i = (h[at] << np.uint64(left)) >> np.uint64(64 - self.bits)
            at = at[(self.words[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1]
        return at


def _document_windows(batches: Iterator[pa.RecordBatch], maybe: WindowMap, sizes: set[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows that the map does not leave out, of rows (keys..., text): keys, hash, place and plain hashes of a template window.  Texts are read whole, some hundred thousand words at a time."""
    words, texts, keys, count = _Words(), [], [], 0

    def flush():
        levels = _sequences(texts, words)
        begin = np.searchsorted(levels[0].of, np.arange(len(texts)))
        for level, seq in enumerate(levels):
            for n, h, at in seq.windows(sizes, min(level, 1)):
                at = maybe.among(h, at)
                if level == 2:
                    at = _with_opener(seq, n, at)
                if not len(at):
                    continue
                of = seq.of[at]
                columns = [[keys[d][c] for d in of.tolist()] for c in range(len(schema) - 3)]
                columns += [h[at].view(np.int64), seq.first[at] - begin[of], _bits(seq.plain, n, at) if level else [b""] * len(at)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        *named, body = (batch.column(c) for c in range(batch.num_columns))
        for r in range(batch.num_rows):
            text = body[r].as_py()
            if text:
                texts.append(text.split())
                keys.append([c[r].as_py() for c in named])
                count += len(texts[-1])
                if count >= WORDS_AT_ONCE:
                    yield from flush()
                    texts, keys, count = [], [], 0
                    if len(words) > 200_000:
                        words.reset()
    yield from flush()


def _consistent(windows: list[dict]) -> tuple[int, bool]:
    """Tokens of the item that windows with consistent slots cover, and whether any slot differs; verbatim windows first."""
    covered, there, back, changed = set(), {}, {}, False
    for w in sorted(windows, key=lambda w: (len(w["here"]) > 0, w["p"], w["q"], w["kinds"])):
        mine, its = np.frombuffer(w["here"], np.uint64).tolist(), np.frombuffer(w["there"], np.uint64).tolist()
        slots = [(k, a, b) for k, a, b in zip(w["kinds"], mine, its) if k != LITERAL]
        fits = all(there.get((k, a), b) == b and (k == NUMBER or back.get((k, b), a) == a) for k, a, b in slots)
        pairs = {(k, a): b for k, a, b in slots}
        names = {(k, b): a for k, a, b in slots if k != NUMBER}
        if not fits or any(pairs[k, a] != b or (k != NUMBER and names[k, b] != a) for k, a, b in slots):
            continue
        there |= pairs
        back |= names
        changed |= any(a != b for _, a, b in slots)
        covered.update(range(w["q"], w["q"] + w["r"]))
    return len(covered), changed


def judge(total: int, hits: list[dict], min_coverage: float, width: int) -> tuple[int, bool]:
    """Best coverage (tokens, whether a slot differs) of an item of ``total`` tokens by windows ``p, q, r, kinds, here, there``."""
    diagonals = defaultdict(list)
    for w in hits:
        diagonals[w["p"] - w["q"]].append(w)
    best = (0, False)
    runs = []  # place in the document, offset, offset after the last, diagonal, windows
    for d, windows in diagonals.items():
        best = max(best, _consistent(windows))
        for w in sorted(windows, key=lambda w: w["p"]):
            if runs and runs[-1][3] == d and w["q"] <= runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], w["q"] + w["r"])
                runs[-1][4].append(w)
            else:
                runs.append([w["p"], w["q"], w["q"] + w["r"], d, [w]])
    if best[0] >= total or len(diagonals) == 1:
        return best
    runs.sort(key=lambda x: x[:4])
    score, before, low = [], [], 0
    for j, (p, q, end, d, _) in enumerate(runs):
        score.append(end - q)
        before.append(-1)
        while runs[low][0] < p - 2 * total - width:
            low += 1
        for i in range(low, j):
            gain = score[i] + end - max(q, runs[i][2])
            if runs[i][1] < q and runs[i][2] < end and abs(runs[i][3] - d) <= width and gain > score[j]:
                score[j], before[j] = gain, i
    for j in sorted(range(len(runs)), key=lambda j: -score[j]):
        if score[j] < max(min_coverage * total, best[0] + 1):
            break
        if before[j] >= 0:
            chain, at = [], j
            while at >= 0:
                chain += runs[at][4]
                at = before[at]
            best = max(best, _consistent(chain))
    return best


def _items(benchmark: DataFrame, text_col: str, id_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").select("item_id", "text", _digest("text").alias("item"))


def _digest(text_col: str) -> Column:
    return F.md5(F.col(text_col).cast("binary"))


def _held(docs: DataFrame, items: DataFrame, min_coverage: float, width: int, broadcast_windows: int) -> DataFrame:
    """``docs`` (key columns..., text) against ``items``: keys, item, covered, total, changed, copies of each key and item that it holds."""
    spark = docs.sparkSession
    keys = docs.columns[:-1]
    key_schema = ", ".join(f"{c} {t}" for c, t in docs.dtypes[:-1])
    windows = checkpointed(
        items.groupBy("item").agg(F.any_value("text").alias("text")).mapInArrow(trimmed(lambda b: _item_windows(b, width)), "item string, total long, h long, n long, q long, r long, kinds binary, here binary")
    )
    count, sizes = windows.agg(F.count("*"), F.collect_set("n")).first()
    schema = f"{key_schema}, item string, total long, covered long, changed boolean, copies long"
    if not count:
        return spark.createDataFrame([], schema)
    maybe = WindowMap(windows, min(max(20, int(64 * count).bit_length()), MAP_BITS))
    arrow = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in docs.dtypes[:-1]] + [("h", pa.int64()), ("p", pa.int64()), ("there", pa.binary())])
    sizes = set(sizes)
    found = docs.where("text <> ''").mapInArrow(trimmed(lambda b: _document_windows(b, maybe, sizes, arrow)), f"{key_schema}, h long, p long, there binary")
    met = found.join(F.broadcast(windows) if count <= broadcast_windows else windows.hint("merge"), "h")
    window = ["p", "q", "r", "kinds", "here", "there"]
    counted = met.groupBy(*keys, "item", "total", *window).agg(F.count("*").alias("copies"))
    hits = counted.groupBy(*keys, "item", "total").agg(F.min("copies").alias("copies"), F.collect_list(F.struct(*window)).alias("hits"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [judge(t.as_py(), h.as_py(), min_coverage, width) for t, h in zip(batch["total"], batch["hits"])]
            out = [batch[c] for c in (*keys, "item", "total")] + [pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.bool_()), batch["copies"]]
            yield pa.RecordBatch.from_arrays(out, names=[*keys, "item", "total", "covered", "changed", "copies"])

    return hits.mapInArrow(trimmed(judged), schema).where(F.col("covered") >= min_coverage * F.col("total"))


def contaminated_pairs(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_coverage: float = MIN_COVERAGE, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """One row per document and item it holds: ``<id_col>, item_id, covered_tokens, item_tokens, coverage, reparameterised``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), _digest(text_col).alias("key"), F.col(text_col).alias("text"))
    items = _items(benchmark, text_col, "item_id")
    held = _held(docs, items, min_coverage, width, broadcast_windows)
    named = items.select("item", "item_id")
    return (
        held.join(F.broadcast(named) if named.limit(broadcast_windows + 1).count() <= broadcast_windows else named, "item")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(F.col("doc_id").alias(id_col), "item_id", F.col("covered").alias("covered_tokens"), F.col("total").alias("item_tokens"), (F.col("covered") / F.col("total")).alias("coverage"), F.col("changed").alias("reparameterised"))
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", min_coverage: float = MIN_COVERAGE, width: int = WIDTH, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``df`` that hold no item, with all columns."""
    docs = df.select(_digest(text_col).alias("key"), F.col(text_col).alias("text"))
    name = free_name(df, "digest")
    gone = checkpointed(_held(docs, _items(benchmark, text_col, "item_id"), min_coverage, width, broadcast_windows).select(F.col("key").alias(name)).distinct())
    few = gone.limit(broadcast_windows + 1).count() <= broadcast_windows
    return df.withColumn(name, _digest(text_col)).join(F.broadcast(gone) if few else gone, name, "left_anti").drop(name)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
