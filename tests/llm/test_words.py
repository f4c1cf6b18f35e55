import random

from equiflow.llm import words as W


def test_word_hashes_follow_the_words():
    r = random.Random(8)
    for _ in range(300):
        texts = ["".join(r.choice(["a", "b", "A", "é", " ", " ", "\n", "\x0b", "\x1c", "\xa0", "😀"]) for _ in range(r.randrange(30))) for _ in range(r.randrange(1, 6))]
        low = [W.lowered(t) for t in texts]
        data, starts, ends, counts = W.spans(low)
        words = [w for t in low for w in t.split()]
        assert [data[a:b] for a, b in zip(starts, ends)] == words and counts.tolist() == [len(t.split()) for t in low]
        keys = W.hashes(data, starts, ends).tolist()
        assert len(set(zip(words, keys))) == len(set(words)) == len(set(keys))


def test_blocks_keep_every_text():
    texts = [None, "", "A b", "x" * 50, None, "É"]
    assert [t for b in W.blocks(texts, 10) for t in b] == [W.lowered(t) for t in texts]
