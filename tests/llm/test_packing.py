import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equiflow.llm import packing as P

SCHEMA = "doc_id long, text string, sequence_id string, length string, offset string"


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [2]


def verify(rows, docs, window):
    """Every id in one piece, checksums right, sequences gapless, within the window, and without padding."""
    want = [ids_of(t) for _, t in docs]
    assert sum(r.length for r in rows) == sum(map(len, want))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for (doc_id, _), ids in zip(docs, want):
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize("window", [64, 4096])
def test_pieces_of_a_corpus(spark, window):
    r = random.Random(3)
    words = ["the", "River,", "café", "naïve!", "don't", "x1y2", "漢字", "...", "<|endoftext|>", "A.", "QUICK", "é", "12345", "​"]
    docs = [(i, " \n".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 300, 4000])))) for i in range(180)] + [(1000, None), (1001, ""), (1002, " \t")]
    df = spark.createDataFrame([(*d, "a", None, None) for d in docs], SCHEMA).repartition(5)
    rows = P.packed_pieces(df, window=window).collect()
    verify(rows, docs, window)


def test_equal_lengths_and_repeated_rows(spark):
    docs = [(i, "the river " * 20) for i in range(50)]
    df = spark.createDataFrame([(*d, "a", None, None) for d in docs], SCHEMA)
    verify(P.packed_pieces(df, window=64).collect(), docs, 64)
    twice = P.packed_pieces(spark.createDataFrame([(None, "a b", "x", "y", "z")] * 2, SCHEMA)).collect()
    assert sum(r.length for r in twice) == 6 and all(r.doc_id is None for r in twice)
    assert P.packed_pieces(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 3), max_size=6), st.integers(1, 40))
def test_best_fill_equals_brute_force(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = P.best_fill(counts, capacity)
    assert all(v <= counts[k] for k, v in chosen.items())
    assert sum(k * v for k, v in chosen.items()) == max(s for s in sums if s <= capacity)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**6), max_size=30))
def test_plan_places_every_item_once(histogram):
    ranges, first_cut = P.plan(histogram, 64)
    whole = Counter()
    for r in ranges[ranges.kind == 0].itertuples():
        whole[r.length] += r.last - r.first
    assert all(whole[k] == first_cut[k] for k in histogram)
    pieces = Counter()
    for k, n in histogram.items():
        for _, size in P.powers(k):
            pieces[size] += n - first_cut[k]
    placed = Counter()
    for r in ranges[ranges.kind == 1].itertuples():
        placed[r.length] += r.last - r.first
    assert placed == +pieces
