r"""Line dedup by winnowing over line hashes (DataFrame functions only).

A text is its lines (split at ``\n``).  A fingerprint is the hash of ``gram`` lines in a
row; of each ``window`` neighbouring fingerprints the least is selected (of equal ones
the last), so two documents that share gram + window - 1 lines in a row select
a common fingerprint there.  A selected fingerprint is joined with its first
occurrence in the corpus, by (id, text hash, line): one partner each, never all with all.
Matches on one diagonal (line here minus line there) of a pair of documents are one
match; it is extended both ways by comparing the line hashes of both documents along the
diagonal.  Every line here that lies in a run of ``gram`` or more equal lines on it is
a later repeat and is deleted; the first occurrence stays.

Long passages do not depend on the windows: ``gram`` lines in a row with ``passage`` words
or more are always selected, and a line of ``passage`` words or more is a fingerprint by itself:
each one but its first occurrence is deleted, whatever its neighbours are.

Rows carry line hashes, not text, until the deleted line numbers meet the document
again.  First occurrences are aggregates (combined in the map task, so a line that all
documents share is one row per task), and the joins are equi-joins that Spark can split.

Edge cases: null text stays null with no lines; an empty text is one empty line;
texts of fewer than ``gram`` lines lose long lines only; a null id orders before all others; rows that
repeat id and text are one document, reported row by row, and do not delete each
other; a text may repeat its own lines, then the later run goes; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import shared_folder, table

GRAM = 2
WINDOW = 2
PASSAGE = 50
#: A word is a run of other characters than white space; scripts without spaces count by the character.
WORD = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]|[^ \t\r\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+"


def _selected(grams: Column, window: int) -> Column:
    """Places (from 0) of the window minima of an array of hashes; the last of equal ones."""
    def least(start):
        part = F.slice(grams, start + 1, window)
        return start + F.size(part) - F.array_position(F.reverse(part), F.array_min(part)).cast("int")

    starts = F.sequence(F.lit(0), F.greatest(F.size(grams) - window, F.lit(0)))
    return F.when(F.size(grams) > 0, F.array_distinct(F.transform(starts, least))).otherwise(F.array().cast("array<int>"))


def _words(line: Column, passage: int) -> Column:
    """Words of a line: its spaces and one, where they stand alone between words; else counted.  The pattern is only needed below ``passage`` and outside ASCII."""
    plain = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    blanks = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
    odd = F.contains(plain, F.lit("  ")) | F.startswith(plain, F.lit(" ")) | F.endswith(plain, F.lit(" ")) | (plain == "")
    spaced = F.when(odd, F.size(F.array_remove(F.split(plain, " "), ""))).otherwise(blanks + 1)
    return F.when((F.octet_length(line) > F.length(line)) & (blanks + 1 < passage), F.regexp_count(line, F.lit(WORD))).otherwise(spaced)


def _long_grams(gram: int, passage: int) -> Column:
    """Places (from 0) of ``gram`` lines with ``passage`` words or more."""
    part = lambda k: F.slice("words", k + 1, F.size("g"))
    total = part(0)
    for k in range(1, gram):
        total = F.zip_with(total, part(k), lambda a, b: a + b)
    return F.filter(F.transform(total, lambda n, i: F.when(n >= passage, i)), lambda i: i.isNotNull())


def _documents(df: DataFrame, text_col: str, id_col: str, gram: int, window: int, passage: int) -> DataFrame:
    """One narrow row per document, written once: ``doc, th`` (the key: id and text hash), the text's line hashes ``h``,
    ``marks`` (place and hash of each selected gram) and ``long`` (number and a 128-bit hash of each line of ``passage`` words or more).

    Texts are read here, and once more when the deleted numbers meet them.
    """
    spark = df.sparkSession
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = rows.select("doc", "th", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: _words(x, passage)).alias("words"))
    starts = F.sequence(F.lit(1), F.size("h") - gram + 1)
    grams = F.when(F.size("h") >= gram, F.transform(starts, lambda i: F.xxhash64(F.slice("h", i, gram)))).otherwise(F.array().cast("array<bigint>"))
    places = F.array_union(_selected(F.col("g"), window), _long_grams(gram, passage))
    numbered = F.transform("lines", lambda x, i: F.when(F.element_at("words", i + 1) >= passage, F.struct(i.alias("line"), F.element_at("h", i + 1).alias("a"), F.xxhash64(F.lit(gram), x).alias("b"))))
    out = rows.withColumn("g", grams).select(
        "doc", "th", "h", F.transform(places, lambda p: F.struct(p.alias("pos"), F.element_at("g", p + 1).alias("fp"))).alias("marks"), F.filter(numbered, lambda x: x.isNotNull()).alias("long"))
    folder = shared_folder(spark, "line-hashes")
    out.write.parquet(folder)
    return spark.read.schema(out.schema).parquet(folder)


def _long_lines(docs: DataFrame) -> DataFrame:
    """``doc, th, line``: the long lines that are not the first of their hash."""
    lines = docs.select("doc", "th", F.explode("long").alias("at")).select("doc", "th", "at.line", F.col("at.a").alias("fa"), F.col("at.b").alias("fb"))
    first = lines.groupBy("fa", "fb").agg(F.min(F.struct("doc", "th", "line")).alias("first"))
    return lines.join(first, ["fa", "fb"]).where(~F.struct("doc", "th", "line").eqNullSafe(F.col("first"))).select("doc", "th", "line")


def deleted_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """``doc, th, gone``: of each document (id, hash of its text) that loses lines their numbers, from 0."""
    docs = _documents(df, text_col, id_col, gram, window, passage)
    marks = docs.select("doc", "th", F.explode("marks").alias("m")).select("doc", "th", "m.pos", "m.fp")
    first = marks.groupBy("fp").agg(F.min(F.struct("doc", "th", "pos")).alias("first"))
    pairs = (
        marks.join(first, "fp").where(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first")))
        .select("doc", "th", F.col("first.doc").alias("doc2"), F.col("first.th").alias("th2"), (F.col("pos") - F.col("first.pos")).alias("diagonal")).distinct())
    hashes = docs.select("doc", "th", "h").groupBy("doc", "th").agg(F.first("h").alias("h"))
    there = hashes.select(F.col("doc").alias("doc2"), F.col("th").alias("th2"), F.col("h").alias("h2"))
    same_key = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    both = pairs.join(hashes.withColumnsRenamed({"doc": "d", "th": "t"}), same_key("doc", "d") & (F.col("th") == F.col("t"))).drop("d", "t")
    both = both.join(there.withColumnsRenamed({"doc2": "d", "th2": "t"}), same_key("doc2", "d") & (F.col("th2") == F.col("t"))).drop("d", "t")
    # lines from..to of this document lie on the diagonal; equal there or not
    both = both.withColumn("from", F.greatest(F.col("diagonal"), F.lit(0))).withColumn("count", F.least(F.size("h") - F.col("from"), F.size("h2") - F.col("from") + F.col("diagonal")))
    both = both.withColumn("equal", F.zip_with(
        F.slice("h", F.col("from") + 1, F.col("count")), F.slice("h2", F.col("from") - F.col("diagonal") + 1, F.col("count")), lambda a, b: a == b))
    runs = F.filter(F.sequence(F.lit(0), F.col("count") - gram), lambda i: F.forall(F.slice("equal", i + 1, gram), lambda x: x))
    lines = both.where(F.col("count") >= gram).select("doc", "th", "from", F.explode(runs).alias("at"))
    lines = lines.select("doc", "th", F.explode(F.sequence(F.col("from") + F.col("at"), F.col("from") + F.col("at") + gram - 1)).alias("line"))
    return lines.union(_long_lines(docs)).groupBy("doc", "th").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def line_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW, passage: int = PASSAGE) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, n_lines, n_removed, text`` (the lines that stay)."""
    gone = deleted_lines(df, text_col, id_col, gram, window, passage).withColumnsRenamed({"doc": "d", "th": "t"})
    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("raw"))
    out = rows.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    lines = F.split("raw", "\n")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get("_lines", i))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")
    return out.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines)).select(
        F.col("doc").alias(id_col), F.when(F.col("raw").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), n_removed,
        F.when(F.col("gone").isNull(), F.col("raw")).otherwise(F.array_join(stay, "\n")).alias(text_col))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
