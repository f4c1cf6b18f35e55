r"""Secret scan: three plain patterns, and dictionary-primed compression novelty.

The patterns (kinds ``assign``, ``access``, ``hex``) are matched over whole texts,
leftmost and without overlap per kind, and short matches are dropped.

The method adds kind ``novel``: a run of credential characters after a sensitive word (to the end of its line, and over
the block that the line opens) that no pattern covers is compressed by zstandard after the text around it
(``AROUND`` characters on either side), with a dictionary of common identifiers and
of the corpus's own words near sensitive words.  Its novelty is the bytes it adds over those that a random string of its
length and alphabet (hex digits, letters of one case, with digits, of both cases, with signs) needs; identifiers, words and
repeats of the text around cost little.  At ``NOVELTY`` or more it is reported.

Corpus words are counted over all documents, once for each different context and without what may be a credential
itself, so copies of a secret teach the dictionary nothing; the ``WORDS`` most frequent make the
dictionary, so it stays small whatever the input.

Edge cases: null and empty texts have no spans (their ``base_sha256`` is that of the
empty string); offsets are code points, end exclusive; texts of any length are read
whole; null or repeated ids are reported row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import table

# The patterns and least lengths of the contract.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them, that are long enough
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

SENSITIVE_WORDS = (*ASSIGN_WORDS, "pwd", "api-key", "access_key", "access-key", "accesskey", "private_key", "private-key", "auth", "bearer", "credential", "signature", "connection string")
SENSITIVE = re.compile("|".join(sorted(map(re.escape, SENSITIVE_WORDS), key=len, reverse=True)), re.A | re.I)
CANDIDATE = re.compile(r"(?=[0-9+/_=~-]*[A-Za-z])[A-Za-z0-9+/_=~-]{16,}")  # with a letter: long numbers are no credentials
#: Identifiers and words that code around credentials is made of.
IDENTIFIERS = (
    "access account admin algorithm api app application auth authorization aws azure base64 basic bearer bucket build cert certificate "
    "client code com config connection const content cookie credential credentials data database default delete description dev email "
    "enable endpoint env environment error example export false file function get github google hash header headers host html http https "
    "id identifier import index int json key kind label length license local localhost login master message method model module name new "
    "null number object option org output package param password path placeholder port post private process production profile project "
    "property provider public query region request resource response return role root schema secret self server service session set "
    "signature source staging status storage string system table target template test text this timeout token true type undefined update "
    "url user username uuid value var variable version view volume www xml your_key_here changeme abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef xxxxxxxxxxxxxxxx ---------------- ================ ________________"
)
#: Characters around a sensitive word whose words count for the dictionary.
REACH = 96
AROUND = 512
NOVELTY = 0.9
WORDS = 2000
#: What may stand between a sensitive word and the end of a line that opens a block (YAML, PEM, brackets, quotes).
OPENER = re.compile(r"""["']?(?: KEY-----)?\s*[:=]?\s*[|>({\[]?[-+]?\s*["'`\\]*\s*""")
ALPHABETS = ((re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), (re.compile(r"[a-z]+|[A-Z]+"), 26), (re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36), (re.compile(r"[A-Za-z]+"), 52), (re.compile(r"[A-Za-z0-9]+"), 62))


def random_bytes(span: str) -> float:
    """The bytes that a random string of the span's length and alphabet needs."""
    size = next((n for pattern, n in ALPHABETS if pattern.fullmatch(span)), 64)
    return len(span) * math.log2(size) / 8


def _region_end(text: str, end: int, stop: int) -> int:
    """Where the context of a sensitive word ending at ``end`` in a line ending at ``stop`` ends: there, or with the block that the line opens.

    A block's lines are indented deeper than its opener, or hold one run of credential characters each.
    """
    if stop == len(text) or not OPENER.fullmatch(text, end, stop):
        return stop
    indent = _indent(text, text.rfind("\n", 0, end) + 1)
    while stop < len(text):
        after = text.find("\n", stop + 1)
        after = len(text) if after < 0 else after
        line = text[stop + 1 : after].strip()
        if not line or not (_indent(text, stop + 1) > indent or CANDIDATE.fullmatch(line.strip("\"',;"))):
            break
        stop = after
    return stop


def _indent(text: str, start: int) -> int:
    at = start
    while at < len(text) and text[at] in " \t":
        at += 1
    return at - start


class Scanner:
    def __init__(self, words: list[str] = ()):
        content = " ".join([*reversed(words), IDENTIFIERS]).encode("utf-8", "replace")  # the end of a dictionary is the cheapest to refer to
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False).compress

    def novelty(self, text: str, start: int, end: int) -> float:
        """Bytes that the span adds to its surroundings when compressed, over those of a random string like it."""
        near = (text[max(0, start - AROUND) : start] + text[end : end + AROUND]).encode("utf-8", "replace")
        return (len(self.compress(near + text[start:end].encode())) - len(self.compress(near))) / random_bytes(text[start:end])

    def spans(self, text: str | None) -> list[tuple[str, int, int, float | None]]:
        """(kind, start, end, novelty) by start, then kind; novelty only of kind ``novel``."""
        if not text:
            return []
        low, out = text.lower(), []
        if any(w in low for w in ASSIGN_WORDS):
            out += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        if "AKIA" in text:
            out += [("access", *m.span(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
        out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
        if any(w in low for w in SENSITIVE_WORDS):
            out += self._novel(text, [x[1:3] for x in out])
        return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    def _novel(self, text: str, covered: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        found, line_end, done = [], -1, 0
        for word in SENSITIVE.finditer(text):
            if word.end() > line_end:
                line_end = text.find("\n", word.end())
                line_end = len(text) if line_end < 0 else line_end
            start, stop = max(done, word.end()), _region_end(text, word.end(), line_end)
            for m in CANDIDATE.finditer(text, start, stop):  # a region ends with a line, so no run goes beyond it
                if all(m.end() <= a or b <= m.start() for a, b in covered) and (x := self.novelty(text, *m.span())) >= NOVELTY:
                    found.append(("novel", *m.span(), x))
            done = max(start, stop)
        return found


def contexts(text: str | None) -> Iterator[str]:
    """The text around each sensitive word, without values of assignments and runs that may be credentials."""
    if not text:
        return
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return
    for m in SENSITIVE.finditer(text):
        start, end = max(0, m.start() - REACH), m.end() + REACH
        while start and RUN.match(text, start - 1) and m.start() - start < 2 * REACH:  # not into a run that was cut
            start -= 1
        tail = RUN_ON.match(text, end) if end < len(text) else None
        yield RUN.sub(" ", ASSIGN.sub(lambda x: x[0][: x.start(2) - x.start()], text[start : tail.end() if tail else end]))


#: Runs of credential characters, as long as a candidate.
RUN = re.compile(r"[A-Za-z0-9+/_=~-]{16,}")
RUN_ON = re.compile(r"[A-Za-z0-9+/_=~-]*")


def nearby_words(df: DataFrame, text_col: str = "text") -> list[str]:
    """The words near sensitive words in most different contexts, over all documents; frequent first."""

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"context": sorted({c for text in batch["text"] for c in contexts(text)})}, dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for context in batch["context"]:
                counts.update(set(re.findall(r"[A-Za-z_]{3,24}", context)))
            yield pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    different = df.select(F.col(text_col).alias("text")).mapInPandas(around, "context string").distinct()
    counts = different.mapInPandas(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return [r.word for r in counts.where("c > 1").orderBy(F.desc("c"), "word").limit(WORDS).collect()]


def secret_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: ``<id_col>, spans`` (array of kind, start, end, novelty)."""
    words = nearby_words(df, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(words)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "novelty": x} for k, a, b, x in scanner.spans(t)] for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "spans": spans})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, novelty: double>>").withColumnRenamed("doc_id", id_col)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
