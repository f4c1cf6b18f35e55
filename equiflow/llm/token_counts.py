r"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick automaton of the vocabulary finds all pieces that end at each
character; dynamic programming carries the best score and its number of pieces.
The rules are the tokenizer's: scores are added from the left; of equal scores the
earlier start (the longer last piece) stays; a character without a piece of its own may
be unknown at the lowest score minus ten; unknown characters become one token per
UTF-8 byte.  Spaces become ``▁`` and one is put in front unless the text begins with one.

No piece of the vocabulary goes on after a word into a ``▁`` (checked when it is
read), so a text's count is the sum of its words' counts, and a word's count is kept.

There is no unigram model among the public tokenizers at hand; the pieces and scores
of ``piece_bpe_32k.model`` are read as one, and tests hold the counts against
``tokenizers.models.Unigram`` over the same pieces.

Edge cases: null and empty texts have no token; long texts, also without any space,
are read whole; null or repeated ids are reported row by row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model."""
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counts(dict):
    """word (with its ``▁``) -> number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece, _ in pieces)

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = self.count(word)
        return n

    def count(self, word: str) -> int:
        """Tokens of the best path through ``word``."""
        score, tokens = [0.0] + [None] * len(word), [0] * (len(word) + 1)
        at, single = 0, False
        for end, (length, value) in self.automaton.iter(word):  # by end; of one end, long pieces first
            while at < end + 1:
                if at:
                    self._unknown(word, at, single, score, tokens)
                at, single = at + 1, False
            single |= length == 1
            new = score[at - length] + value
            if score[at] is None or new > score[at]:
                score[at], tokens[at] = new, tokens[at - length] + 1
        while at <= len(word):
            if at:
                self._unknown(word, at, single, score, tokens)
            at, single = at + 1, False
        return tokens[-1]

    def _unknown(self, word: str, at: int, single: bool, score: list, tokens: list) -> None:
        """The last candidate of an end: its character alone, unknown, if it is no piece."""
        if not single:
            new = score[at - 1] + self.unknown
            if score[at] is None or new > score[at]:
                score[at], tokens[at] = new, tokens[at - 1] + len(word[at - 1].encode("utf-8", "surrogatepass"))

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if not text.startswith(SPACE):
            text = SPACE + text
        return sum(map(self.__getitem__, _WORD.findall(text))) if self.by_word else self.count(text)


_KEPT: dict = {}


def token_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, n_tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _KEPT:  # once for each Python worker
            _KEPT[path] = Counts(vocabulary(path))
        counts = _KEPT[path]
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_tokens": [counts.of(t) for t in batch["text"]]})
        counts.clear()  # idle workers hold no words

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long").withColumnRenamed("doc_id", id_col)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
