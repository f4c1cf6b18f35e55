import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from equiflow.llm import importance_resampling as R
from tests.conftest import SF_SMALL

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").encode().lower())
    return len(w), [b" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, bench, percent=5, least=20, buckets=10000):
    bucket = lambda f: zlib.crc32(f) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in docs], bench))
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for i, x in docs:
        n, f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_whole_tables_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = R.op12_importance_resampling(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert plain(got.collect()) == plain(brute(docs, bench))


def test_nulls_ties_repeated_rows_and_clashing_names(spark):
    text = "Straße und 日本語, the 3 quick\x00 foxes JUMP over a lazy dog " * 4
    docs = [(1, None), (2, ""), (3, " .,;!"), (4, text), (4, text), (None, text), (None, text), (5, "x" * 700 + " y " + "x" * 700), (6, text.upper())]
    docs += [(100 + k, text + f" {k}") for k in range(60)]
    bench = ["lazy dog over a", None, ""]
    df = spark.createDataFrame([(a, b, 0, "") for a, b in docs], "doc_id long, text string, weight int, `RANK` string")
    got = R.importance_scores(df, spark.createDataFrame([(b,) for b in bench], "text string"), percent=50)
    assert plain(got.collect()) == plain(brute(docs, bench, percent=50))
    assert R.resampled(df, spark.createDataFrame([(b,) for b in bench], "text string"), percent=50).columns == df.columns


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.importance_scores(none, none).count() == 0
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert [tuple(r) for r in R.importance_scores(some, none, percent=100).collect()] == brute([(1, "a b " * 20)], [], 100)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 18])
def test_blocks_do_not_change_sums(block):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abé1") for _ in range(r.choice([1, 2, 9, 40, 300]))) for _ in range(r.randrange(40))) + r.choice(["", "  ", "."]) for _ in range(60)]
    gains = np.arange(97) - 40
    got = np.zeros((3, len(texts)), np.int64)
    counts = np.zeros(97, np.int64)
    for owners, held in R._pieces(iter([t.encode() for t in texts]), block):
        table = R.GramTable(held, 97)
        counts += table.bucket_counts(97)
        for total, more in zip(got, table.sums(gains, len(held))):
            np.add.at(total, owners, more)
    want = [features(t) for t in texts]
    assert got.T.tolist() == [[n, len(f), sum(int(gains[zlib.crc32(x) % 97]) for x in f)] for n, f in want]
    assert counts.tolist() == np.bincount([zlib.crc32(x) % 97 for _, f in want for x in f], minlength=97).tolist()


def test_hash_is_xxhash64():
    data = np.frombuffer(random.Random(2).randbytes(5000) + bytes(8), np.uint8)
    lens = np.array([*range(0, 130), 254, 255, 256, 257, 1000] * 3)
    starts = np.arange(len(lens)) * 3
    assert R.xxh64(data, starts, lens).tolist() == [xxhash.xxh64_intdigest(data[s:s + n].tobytes()) for s, n in zip(starts, lens)]


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(R, "xxh64", lambda data, starts, lens: np.zeros(len(lens), np.uint64))
    words = [b"w%d" % k for k in range(30)] * 2
    table = R.GramTable([(b" ".join(words), 0)], 1000)
    assert table.bucket_counts(1000).tolist() == np.bincount([zlib.crc32(x) % 1000 for x in features(b" ".join(words).decode())[1]], minlength=1000).tolist()
