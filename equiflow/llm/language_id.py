r"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on the
bytes of the lower-cased text.  Each
position of a text gets a probability per language from the forward and backward
states at that byte; a document's probabilities are the mean over its letter
positions.  Whole texts are read, in chunks of ``STEPS`` bytes, a few thousand
chunks at a time, so memory does not depend on a text's length.

Training reads a bounded sample: of each language the ``per_label`` documents
with the smallest hash of their text (only rows whose crc32(id) mod 3 is not 1 and
whose label is not null), and of each ``WINDOWS`` windows spread over the whole
text.  The sample is found with a limit per language inside each map task, so no
task holds a whole language; what reaches the driver is bounded by
languages x per_label x WINDOWS x STEPS characters.  Everything else covers all rows.

Edge cases: null text and text without any letter: ``und`` with score 0; no
labelled row at all: ``und`` with score 0 for every row; ids may repeat or be null
(a null id is not held out); an empty table gives an empty result; other columns are
ignored by ``predict_languages`` and passed through by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiflow.llm.common import id_remainder, table, trimmed

STEPS = 64
WINDOWS = 8
HIDDEN = 8
PER_LABEL = 400
CHUNKS_AT_ONCE = 4096
#: Rejected in the pipeline: undetermined, or a pooled probability under this.
MIN_SCORE = 0.4
_LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Two gated recurrent layers, one from each end, and a softmax over their states at each byte."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        size = (lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32))
        self.p = {"out": size(2 * hidden, len(labels)), "bias": np.zeros(len(labels), np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": size(256, 3 * hidden), f"rec_{d}": size(hidden, 3 * hidden)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (steps, rows, hidden) of one direction; x and mask: (steps, rows).  ``keep`` gets what backpropagation needs."""
        n, table, rec = self.hidden, self.p[f"in_{d}"], self.p[f"rec_{d}"]
        states = np.empty((*x.shape, n), np.float32)
        h = np.zeros((x.shape[1], n), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a, u = table[x[t]], h @ rec
            zr = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            c = np.tanh(a[:, 2 * n :] + zr[:, n:] * u[:, 2 * n :])
            new = c + zr[:, :n] * (h - c)
            if not mask[t].all():
                new *= mask[t][:, None]
            if keep is not None:
                keep.append((t, h, zr, c, u[:, 2 * n :]))
            states[t] = h = new
        return states

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities (steps, rows, labels) of each position."""
        s = self._run(x, mask, "f") @ self.p["out"][: self.hidden] + self._run(x, mask, "b") @ self.p["out"][self.hidden :] + self.p["bias"]
        s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(-1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions in ``mask`` and its gradients, by backpropagation through time."""
        n, kept = self.hidden, {"f": [], "b": []}
        states = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], -1)
        s = states @ self.p["out"] + self.p["bias"]
        s -= s.max(-1, keepdims=True)
        prob = np.exp(s)
        prob /= prob.sum(-1, keepdims=True)
        weight = (mask / max(mask.sum(), 1)).astype(np.float32)
        rows = np.arange(x.shape[1])
        loss = -float((np.log(prob[:, rows, y] + 1e-9) * weight).sum())
        prob[:, rows, y] -= 1
        ds = prob * weight[..., None]
        g = {"out": np.einsum("trh,trl->hl", states, ds), "bias": ds.sum((0, 1))}
        back = ds @ self.p["out"].T
        for i, d in enumerate("fb"):
            rec, g_in, g_rec = self.p[f"rec_{d}"], np.zeros((256, 3 * n), np.float32), np.zeros((n, 3 * n), np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, zr, c, un in reversed(kept[d]):
                dh = (dh + back[t, :, i * n : (i + 1) * n]) * mask[t][:, None]
                z, r = zr[:, :n], zr[:, n:]
                da_c = dh * (1 - z) * (1 - c * c)
                da_z = dh * (h - c) * z * (1 - z)
                da_r = da_c * un * r * (1 - r)
                da = np.concatenate([da_z, da_r, da_c], 1)
                du = np.concatenate([da_z, da_r, da_c * r], 1)
                np.add.at(g_in, x[t], da)
                g_rec += h.T @ du
                dh = dh * z + du @ rec.T
            g |= {f"in_{d}": g_in, f"rec_{d}": g_rec}
        return loss, g


def _chunks(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and lengths of chunks, and the text of each: (chunks, STEPS) uint8, (chunks,), (chunks,)."""
    n = np.array([-(-len(d) // STEPS) for d in data], np.int64)
    flat = np.frombuffer(b"".join(d.ljust(k * STEPS, b"\0") for d, k in zip(data, n.tolist())), np.uint8).reshape(-1, STEPS)
    of = np.repeat(np.arange(len(data)), n)
    first = np.cumsum(n) - n
    length = np.minimum(STEPS, np.array([len(d) for d in data], np.int64)[of] - (np.arange(len(of)) - first[of]) * STEPS)
    return flat, length, of


def train(samples: list[tuple[str, str]], steps: int = 260, rows: int = 256, seed: int = 7) -> ByteGru:
    """A network fitted to (window, label) pairs with Adam; each label is drawn equally often."""
    labels = sorted({label for _, label in samples})
    net = ByteGru(labels, seed=seed)
    if len(labels) < 2:
        return net
    flat, length, of = _chunks([text.lower().encode("utf-8", "replace")[:STEPS] or b" " for text, _ in samples])
    y = np.array([labels.index(label) for _, label in samples])[of]
    pools = [np.flatnonzero(y == k) for k in range(len(labels))]
    r = np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.array([pools[k][i % len(pools[k])] for k, i in zip(r.integers(len(labels), size=rows), r.integers(1 << 30, size=rows))])
        mask = (np.arange(STEPS)[:, None] < length[pick]).astype(np.float32)
        _, g = net.gradients(flat[pick].T.astype(np.int64), mask, y[pick])
        norm = float(np.sqrt(sum((w.astype(np.float64) ** 2).sum() for w in g.values())))
        rate = 0.02 * min(1, step / 10) * (1 - 0.9 * step / steps)
        for k, w in g.items():
            w = w * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * w
            v[k] = 0.99 * v[k] + 0.01 * w * w
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def identify(net: ByteGru, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Label and pooled probability of each text; whole texts."""
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not net.labels:
        return labels, scores
    held, size = [], 0

    def flush():
        data = [texts[i].lower().encode("utf-8", "replace") for i in held]
        flat, length, of = _chunks(data)
        total = np.zeros((len(held), len(net.labels)))
        for a in range(0, len(flat), CHUNKS_AT_ONCE):
            x = np.ascontiguousarray(flat[a : a + CHUNKS_AT_ONCE].T)
            mask = (np.arange(STEPS)[:, None] < length[a : a + CHUNKS_AT_ONCE]).astype(np.float32)
            prob = net.positions(x, mask)
            here = (mask * _LETTER[x])[..., None]
            np.add.at(total, of[a : a + CHUNKS_AT_ONCE], (prob * here).sum(0))
        total /= total.sum(1, keepdims=True)
        for i, row in zip(held, total):
            k = int(row.argmax())
            labels[i], scores[i] = net.labels[k], float(min(1.0, row[k]))

    for i, text in enumerate(texts):
        if text and any(map(str.isalpha, text)):
            held.append(i)
            size += len(text)
            if size >= CHUNKS_AT_ONCE * STEPS:
                flush()
                held, size = [], 0
    if held:
        flush()
    return labels, scores


def fit(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "lang", per_label: int = PER_LABEL) -> ByteGru:
    """The network trained on the sample that the module's text describes."""
    text, label = F.col(text_col), F.col(label_col)
    span = F.greatest(F.length("text") - STEPS, F.lit(0)) / (WINDOWS - 1)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.floor(i * span).cast("int") + 1))
    rows = df.where(id_remainder(F.col(id_col), 3) != 1).where(label.isNotNull() & (label != "") & text.isNotNull()).select(label.alias("label"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = Window.partitionBy("label").orderBy("h")
    # copies of a text are one row, so the bound holds for different texts
    taken = rows.select("label", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_label).select("label", "h")
    sample = rows.join(taken, ["label", "h"]).select("label", "h", F.transform(pieces, lambda p: F.col("text").substr(p, F.lit(STEPS))).alias("windows"))
    sample = sample.groupBy("label", "h").agg(F.min("windows").alias("windows"))
    got = sorted((r.label, r.h, *r.windows) for r in sample.collect())
    samples = [(w, label) for label, _, *windows in got for w in windows if any(map(str.isalpha, w))]
    return train(samples) if samples else ByteGru([])


def predict_languages(df: DataFrame, net: ByteGru, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, held_out, lang_pred, score`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            labels, scores = identify(net, batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": labels, "score": scores})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (id_remainder(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInPandas(trimmed(run), "doc_id long, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def keep_identified(df: DataFrame, net: ByteGru, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``df`` whose language is determined with ``min_score`` at least, with all columns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = identify(net, batch.column(at).to_pylist())
            yield batch.filter(pa.array([x != "und" and s >= min_score for x, s in zip(labels, scores)], pa.bool_()))

    return df.mapInArrow(trimmed(run), df.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit(docs))
