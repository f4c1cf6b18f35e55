r"""Scoring of texts by a log-bilinear language model trained with noise-contrastive estimation.

Tokens: words ``[^\x20\x09-\x0D]+`` of the text with A-Z in lower case, then one end.
The probability of a word is P(class | the classes of the words before) times
(c + 0.5) / Z, its share in its class.  The most frequent words are classes of
their own; all others fall into classes by spelling (means of letter pairs, found
by k-means over frequent words), which any word has, seen or not.  Each class of that
kind also holds one outcome "a word never seen" with weight 0.5, so the
probabilities of all outcomes sum to one.

P(class | context) is a log-bilinear network: each class has a context vector and a
target vector; the context vectors of the ``CONTEXT`` classes before, each weighted
elementwise by its distance, are added, and the product with the target vectors plus a
bias is the score.  It is trained in numpy by noise-contrastive estimation against
the class frequencies.  All training texts are read once, in rounds that grow: in a
round each task goes on from the shared weights over its own texts, and the weights
are averaged in Spark, weighted by tokens.  Scores are normalised: one product
with all target vectors gives the log probability of each class for a block of tokens.

Counts cover all training texts.  The words of the dictionary that is sent to the
tasks are those with at least a count that leaves ``DICTIONARY`` words or fewer;
the others stay in Spark and join by the word.

Edge cases: null and empty texts are one token, the end; a null id counts as the empty
text in the split; rows that repeat an id are scored each; without any training
text every token is unseen (N = 0) and base_score is 0; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import checkpointed, id_remainder, table
from equiflow.llm.words import blocks, hashes, spans

CONTEXT = 4
WIDTH = 16
SINGLE = 143
SPELLED = 48
DICTIONARY = 100_000
#: Letter pairs are hashed into so many features.
PAIRS = 96
NOISE = 48
BATCH = 4096
#: Tokens scored at a time: their scores over all classes stay in the processor's cache.
SCORED = 1024
#: Share of the training texts read up to the end of each round.
ROUNDS = (1 / 64, 1 / 8, 1.0)


def _pair_features(words: list[bytes]) -> np.ndarray:
    """Unit vectors of the hashed letter pairs of words, edges included."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    pair = (data[:-1] * 7919 + data[1:] * 104729) % 1000003 % PAIRS
    inside = of[:-1] == of[1:]
    x = np.bincount(of[:-1][inside] * PAIRS + pair[inside], minlength=len(words) * PAIRS).reshape(-1, PAIRS).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spelling_classes(words: list[bytes], counts: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids (k, PAIRS) of the words' letter pairs, weighted by the root of the counts."""
    x, weight = _pair_features(words), np.sqrt(counts).astype(np.float32)
    r = np.random.default_rng(seed)
    centre = x[r.choice(len(words), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        total = np.zeros((k, PAIRS), np.float32)
        np.add.at(total, near, x * weight[:, None])
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.maximum(norm, 1e-9), centre)
    return centre


class Lexicon:
    """Class and log10(c + 0.5) of the dictionary's words by their hash; the class of any other word by spelling."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        single = min(SINGLE, len(words))
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        words, counts = [words[i] for i in order], np.asarray(counts, np.float64)[order]
        rest = words[single:]
        k = min(SPELLED, len(rest))
        self.centre = spelling_classes(rest, counts[single:], k) if k else np.zeros((1, PAIRS), np.float32)
        self.first_spelled = 1 + single  # class 0 is the end
        self.classes = self.first_spelled + len(self.centre)
        cls = np.r_[np.arange(1, 1 + single), self.spelled(rest)].astype(np.int64)
        self.mass = np.bincount(cls, counts + 0.5, minlength=self.classes).astype(float)  # of the dictionary; the others are added later
        keys = hashes(*spans(words)[:3]) if words else np.zeros(0, np.uint64)
        at = np.argsort(keys)
        self.keys, self.cls, self.log = keys[at], cls[at], np.log10(counts[at] + 0.5)
        slots = np.searchsorted(self.keys >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))
        self.slot, self.most = slots.astype(np.int32), int(np.diff(slots).max())
        self.log_mass = np.zeros(self.classes)

    def spelled(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        return self.first_spelled + (_pair_features(words) @ self.centre.T).argmax(1)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Row of each hash among the keys, -1 where the word is not in the dictionary."""
        slot = (keys >> np.uint64(44)).astype(np.int64)
        at, end = self.slot[slot], self.slot[slot + 1]
        row = np.full(len(keys), -1, np.int64)
        for k in range(self.most):
            here = at + k < end
            here[here] = self.keys[at[here] + k] == keys[here]
            row[here] = at[here] + k
        return row


class _Speller:
    """Spelled classes of words outside the dictionary, kept between texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        self.known.update(zip(new, self.lexicon.spelled(new).tolist()))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _read(texts: list[bytes], lexicon: Lexicon, speller: _Speller):
    """Of lower-cased texts: class of each token (an end after each text), its text, its place in the text, the
    dictionary row of each word, and the texts and words outside the dictionary."""
    data, starts, ends, counts = spans(texts)
    row = lexicon.look_up(hashes(data, starts, ends))
    out = np.flatnonzero(row < 0)
    strange = [data[a:b] for a, b in zip(starts[out].tolist(), ends[out].tolist())]
    cls = np.where(row >= 0, lexicon.cls[row] if len(lexicon.cls) else 0, 0)
    cls[out] = speller(strange)
    word_text = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)
    cls = np.insert(cls, last, 0)
    of = np.repeat(np.arange(len(texts)), counts + 1)
    place = np.arange(len(cls)) - np.repeat(np.cumsum(counts + 1) - counts - 1, counts + 1)
    return cls, of, place, row, word_text, word_text[out], strange


def _contexts(cls: np.ndarray, place: np.ndarray) -> np.ndarray:
    """(CONTEXT, tokens): the classes before each token; the end where the text has not begun."""
    out = np.zeros((CONTEXT, len(cls)), np.int64)
    for k in range(1, CONTEXT + 1):
        out[k - 1, k:] = np.where(place[k:] >= k, cls[:-k], 0)
    return out


class LogBilinear:
    """Log-bilinear network over classes; parameters in one dict of float32 arrays."""

    def __init__(self, noise: np.ndarray, seed: int = 3):
        r, k = np.random.default_rng(seed), len(noise)
        self.noise = np.maximum(noise / noise.sum(), 1e-7)
        self.p = {
            "context": (r.standard_normal((k, WIDTH)) * 0.1).astype(np.float32), "target": (r.standard_normal((k, WIDTH)) * 0.1).astype(np.float32),
            "place": np.ones((CONTEXT, WIDTH), np.float32), "bias": np.log(self.noise).astype(np.float32)}

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return sum(self.p["context"][before[k]] * self.p["place"][k] for k in range(CONTEXT))

    def log_probability(self, before: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 P(class | context), normalised over all classes.

        One product gives the scores of a block, biases included, less a bound on each
        row's largest (|hidden| times the longest target vector), so no score overflows.
        """
        p, k = self.p, len(self.noise)
        targets = np.ascontiguousarray(np.vstack([p["target"].T, p["bias"], np.ones((1, k), np.float32)]))
        longest, top = np.sqrt((p["target"] ** 2).sum(1)).max(), p["bias"].max()
        out, one, scores = np.empty(len(cls)), np.ones(k, np.float32), np.empty((SCORED, k), np.float32)
        for a in range(0, len(cls), SCORED):
            c = cls[a : a + SCORED]
            h = np.empty((len(c), WIDTH + 2), np.float32)
            h[:, :WIDTH] = self.hidden(before[:, a : a + SCORED])
            h[:, WIDTH] = 1
            h[:, WIDTH + 1] = -(np.sqrt((h[:, :WIDTH] ** 2).sum(1)) * longest + top)
            s = np.matmul(h, targets, out=scores[: len(c)])
            mine = s[np.arange(len(c)), c]
            total = np.exp(s, out=s) @ one
            if total.min() < 1e-30:  # the bound was far from the largest score
                s = np.matmul(h, targets, out=s)
                most = s.max(1, keepdims=True)
                mine, total = mine - most[:, 0], np.exp(s - most) @ one
            out[a : a + SCORED] = mine - np.log(total)
        return out / np.log(10)

    def learn(self, before: np.ndarray, cls: np.ndarray, square: dict[str, np.ndarray], r: np.random.Generator, rate: float) -> None:
        """One step of noise-contrastive estimation on a batch; the noise classes are shared in the batch."""
        p, n = self.p, len(cls)
        drawn = r.choice(len(self.noise), NOISE, p=self.noise)
        log_noise = np.log(NOISE * self.noise)
        h = self.hidden(before)
        q = p["target"][cls]
        up = (h * q).sum(1) + p["bias"][cls] - log_noise[cls]
        down = h @ np.ascontiguousarray(p["target"][drawn].T) + (p["bias"][drawn] - log_noise[drawn]).astype(np.float32)
        du = (1 / (1 + np.exp(np.clip(up, -30, 30)))).astype(np.float32) / n  # 1 - sigmoid
        dd = (-1 / (1 + np.exp(np.clip(-down, -30, 30)))).astype(np.float32) / n
        dh = du[:, None] * q + dd @ p["target"][drawn]
        g = {"target": _rows_added(cls, du[:, None] * h, len(self.noise)), "bias": np.bincount(cls, du, minlength=len(self.noise)).astype(np.float32),
             "place": np.zeros_like(p["place"]), "context": np.zeros_like(p["context"])}
        np.add.at(g["target"], drawn, dd.T @ h)
        np.add.at(g["bias"], drawn, dd.sum(0))
        for k in range(CONTEXT):
            c = p["context"][before[k]]
            g["place"][k] = (dh * c).sum(0)
            g["context"] += _rows_added(before[k], dh * p["place"][k], len(self.noise))
        for name, value in g.items():
            square[name] += value * value
            p[name] += rate * value / (np.sqrt(square[name]) + 1e-6)


def _rows_added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(at.astype(np.int16), kind="stable")  # classes are few; short keys sort by radix
    key = at[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[key[starts]] = np.add.reduceat(rows[order], starts)
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over the column ``text``; each task sends a word once for some hundred thousand different ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for block in blocks(batch["text"]):
                counts.update(b" ".join(block).split())
                if len(counts) > 400_000:
                    yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})
                    counts = Counter()
        if counts:
            yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    return texts.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, Lexicon, LogBilinear, dict]:
    """``(words outside the dictionary with counts, lexicon, network, totals)`` from the rows that are not held out."""
    texts = df.where(id_remainder(F.col(id_col), 5) != 1).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = checkpointed(word_counts(texts))
    ends = texts.count()
    by_count = sorted((r.c, r.n) for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect())
    words, tokens = sum(n for _, n in by_count), sum(c * n for c, n in by_count)
    least, taken = None, 0
    for c, n in reversed(by_count):
        taken += n
        if taken > DICTIONARY:
            break
        least = c
    chosen = counts.where(F.col("c") >= (least if least is not None else 1 << 62)).toPandas()
    lexicon = Lexicon([bytes(w) for w in chosen["word"]], chosen["c"].to_numpy())
    others = counts.where(F.col("c") < (least if least is not None else 1 << 62))

    def masses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, lexicon.classes))
        for batch in batches:
            cls = lexicon.spelled([bytes(w) for w in batch["word"]])
            total[0] += np.bincount(cls, batch["c"] + 0.5, minlength=lexicon.classes)
        yield pd.DataFrame({"cls": np.arange(lexicon.classes), "mass": total[0]})

    for r in others.mapInPandas(masses, "cls long, mass double").groupBy("cls").agg(F.sum("mass").alias("mass")).collect():
        lexicon.mass[r.cls] += r.mass
    lexicon.mass[0] = ends + 0.5
    noise = lexicon.mass.copy()
    lexicon.mass[lexicon.first_spelled :] += 0.5  # the outcome "a word never seen"
    lexicon.log_mass = np.log10(np.maximum(lexicon.mass, 0.5))
    lexicon.log_mass[0] = np.log10(ends + 0.5)
    net = LogBilinear(np.maximum(noise, 0.5))
    totals = {"tokens": tokens + ends, "types": words + bool(ends), "ends": ends}
    if tokens:
        low = 0.0
        for step, high in enumerate(ROUNDS):
            _train_round(texts, lexicon, net, low, high, 0.1 if step == 0 else 0.05)
            low = high
    return others, lexicon, net, totals


def _train_round(texts: DataFrame, lexicon: Lexicon, net: LogBilinear, low: float, high: float, rate: float) -> None:
    """Each task goes on from the shared weights over its texts of this share; the weights become their mean by tokens."""
    names = sorted(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = LogBilinear(net.noise)
        mine.p = {k: v.copy() for k, v in net.p.items()}
        square = {k: np.full_like(v, 1e-4) for k, v in mine.p.items()}
        r, speller, seen = np.random.default_rng(TaskContext.get().partitionId()), _Speller(lexicon), 0
        for batch in batches:
            for block in blocks(batch["text"]):
                cls, _, place, *_ = _read(block, lexicon, speller)
                before = _contexts(cls, place)
                order = r.permutation(len(cls))
                for a in range(0, len(cls), BATCH):
                    pick = order[a : a + BATCH]
                    mine.learn(before[:, pick], cls[pick], square, r, rate)
                seen += len(cls)
        if seen:
            flat = np.concatenate([mine.p[k].ravel() for k in names]).astype(np.float64)
            yield pd.DataFrame({"at": np.arange(len(flat)), "value": flat * seen, "seen": seen})

    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20)
    part = texts.where((share >= low) & (share < high)).mapInPandas(run, "at long, value double, seen long")
    mean = part.groupBy("at").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas().sort_values("at")
    at = 0
    for k in names if len(mean) else ():
        size = net.p[k].size
        net.p[k] = mean["value"].to_numpy()[at : at + size].astype(np.float32).reshape(net.p[k].shape)
        at += size


def lm_scores(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    others, lexicon, net, totals = fit(df, text_col, id_col)
    end_log = float(np.log10(totals["ends"] + 0.5))
    end_known = int(totals["ends"] > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, row_no, speller = TaskContext.get().partitionId(), 0, _Speller(lexicon)
        for batch in batches:
            ids, held_out, at = batch["doc_id"].astype("Int64"), batch["held_out"], 0
            for block in blocks(batch["text"]):
                cls, of, place, row, word_text, strange_text, strange = _read(block, lexicon, speller)
                n = len(block)
                p = net.log_probability(_contexts(cls, place), cls) - lexicon.log_mass[cls]
                known = row >= 0
                uid = (part << 36) + row_no + np.arange(n)
                here = slice(at, at + n)
                yield pd.DataFrame({
                    "uid": uid, "word": [b" %d" % u for u in uid.tolist()], "tf": 0, "doc_id": ids.iloc[here].array, "held_out": held_out.iloc[here].array,
                    "n_tokens": np.bincount(of, minlength=n), "n_known": np.bincount(word_text[known], minlength=n) + end_known,
                    "logs": np.bincount(word_text[known], lexicon.log[row[known]], minlength=n) + end_log, "model": np.bincount(of, p, minlength=n)})
                if strange:
                    pairs = Counter(zip(strange_text.tolist(), strange))
                    yield pd.DataFrame({
                        "uid": uid[np.fromiter((t for t, _ in pairs), np.int64, len(pairs))], "word": [w for _, w in pairs], "tf": list(pairs.values()),
                        "doc_id": pd.array([None] * len(pairs), "Int64"), "held_out": False, "n_tokens": 0, "n_known": 0, "logs": 0.0, "model": 0.0})
                at, row_no = at + n, row_no + n

    # a text is one row under a key that no word has, and one row per word outside the dictionary
    schema = "uid long, word binary, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double"
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), 5) == 1).alias("held_out"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    joined = rows.join(others, "word", "left")
    c = F.coalesce("c", F.lit(0))
    per = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.col("tf") * F.log10(c + 0.5)).alias("logs"), F.sum("model").alias("model"))
    whole = float(np.log10(totals["tokens"] + 0.5 * (totals["types"] + 1)))
    return per.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * whole).alias("base_score"), (F.col("logs") + F.col("model")).alias("score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
