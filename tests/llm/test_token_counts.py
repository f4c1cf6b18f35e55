import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from equiflow.llm import token_counts as T

SCHEMA = "doc_id long, text string, n_tokens string"


def reference(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def public():
    pieces = T.vocabulary()
    return T.Counts(pieces), reference(pieces)


def test_equals_the_tokenizer_on_documents(spark, public):
    counts, want = public
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).collect():
        assert counts.of(r.text) == want(r.text or "")


def test_equals_the_tokenizer_on_odd_texts(public):
    counts, want = public
    r = random.Random(2)
    parts = ["a", "the", "The", " ", "  ", "\n", "\t", "é", "ß", "漢字", "😀", "▁", "<0x41>", "</s>", "1", "42", "#$%", "ing", "̀", "\x00", "​", "x" * 30]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert counts.of(text) == want(text), text


def test_ties_follow_the_tokenizer():
    """Small vocabularies with many equal scores."""
    r = random.Random(5)
    for _ in range(150):
        pieces = {"<unk>": 0.0} | {f"<0x{b:02X}>": 0.0 for b in range(256)}
        for _ in range(r.randrange(3, 25)):
            pieces["▁" * r.randrange(2) + "".join(r.choice("abc") for _ in range(r.randrange(1, 5)))] = float(-r.randrange(1, 4))
        pieces = list(pieces.items())
        counts, want = T.Counts(pieces), reference(pieces)
        assert counts.by_word
        for _ in range(25):
            text = "".join(r.choice("abcd é") for _ in range(r.randrange(1, 16)))
            assert counts.of(text) == want(text), (text, pieces[257:])


def test_edge_cases(spark, public):
    counts, want = public
    rows = [(1, None, None), (2, "", None), (None, "a b", "x"), (3, "same", None), (3, "same", None), (4, "nospace" * 3000, None)]
    got = [tuple(r) for r in T.token_counts(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(i, want(t) if t else 0) for i, t, _ in rows]
    assert T.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
