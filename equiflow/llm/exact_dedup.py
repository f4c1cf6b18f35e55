r"""Exact dedup by skew-safe combining (DataFrame functions only).

Texts are equal when they are identical after deleting every character of
``[\x20\x09-\x0D]``.  Of equal texts the row with the most code points in the
original text stays, then the one with the smallest id.

Rows are combined in three steps, and each groups by the digest *and* by the
whole normalised text, so two texts that share a digest never merge:

1. local: the map side of the first aggregate leaves one row per text and
   partition (a task writes a text once, however many copies it read);
2. salted: those rows meet by (digest, salt, text); the salt comes from the
   map partition, so copies of one hot text are dealt over ``salts`` tasks;
3. global: the at most ``salts`` winners of a text meet by (digest, text).

A row finds its group by (digest, a second 64-bit hash, length): narrow rows,
so a hot group is an equi-join that Spark's skew handling can split, and no
list of members is ever built.

Edge cases: a null text is the empty text (all such rows are one group); a null
id loses every tie and is reported as a null ``keep_id`` only when the whole group
has null ids; rows repeated with the same id and text are all counted, all
marked kept by ``exact_groups``, and reduced to one row by ``exact_dedup``; an
empty table gives an empty result; other columns are ignored by
``exact_groups`` and passed through by ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiflow.llm.common import SPACE_CLASS, free_name, table

SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


def _digest(norm: Column) -> Column:
    """sha256 as 32 bytes; typed as never null, else the join would add a filter that computes it again."""
    return F.coalesce(F.unhex(F.sha2(norm, 256)), F.lit(b""))


def _rank(doc_id: Column, chars: Column) -> Column:
    """Larger is better: code points first, then the smaller id; a null id is last.  Fixed width, so hash aggregates hold it."""
    top = F.lit("10000000000000000000").cast("decimal(20,0)")  # above any 64-bit id
    by_id = F.coalesce(top - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (chars.cast("decimal(12,0)") * F.lit("100000000000000000000").cast("decimal(21,0)") + by_id).cast("decimal(38,0)")


def _keyed(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row per row of ``df``: id, normalised text, digest, second hash, length and rank."""
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
        .select("id", normalised(F.col("raw")).alias("norm"), F.length("raw").alias("chars"))
        .select("id", "norm", _digest(F.col("norm")).alias("digest"), F.xxhash64("norm").alias("alt"), F.length("norm").alias("size"), _rank(F.col("id"), F.col("chars")).alias("rank"))
    )


def _winners(keyed: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: its keys, the winner's id and rank, and the number of rows."""
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(salts)))
    merged = salted.groupBy("digest", "salt", "norm").agg(
        F.first("alt").alias("alt"), F.first("size").alias("size"), F.max("rank").alias("rank"), F.max_by("id", "rank").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("digest", "norm").agg(
        F.first("alt").alias("alt"), F.first("size").alias("size"), F.max("rank").alias("best"), F.max_by("keep_id", "rank").alias("keep_id"), F.sum("n").alias("group_size")
    ).drop("norm")


def exact_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: ``<id_col>, keep_id, group_size, kept, text_sha256``."""
    keyed = _keyed(df, text_col, id_col)
    won = _winners(keyed, salts)
    rows = keyed.drop("norm")
    return rows.join(won, ["digest", "alt", "size"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rank") == F.col("best")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    The rank is part of the join key, so of a hot group only the rows equal to the
    winner meet in a task; rows repeated with the winner's id and text become one.
    """
    names = {k: free_name(df, k) for k in ("digest", "alt", "size", "rank")}
    raw = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    rows = df.withColumns({
        names["digest"]: _digest(norm), names["alt"]: F.xxhash64(norm), names["size"]: F.length(norm),
        names["rank"]: _rank(F.col(id_col).cast("long"), F.length(raw))})
    won = _winners(_keyed(df, text_col, id_col), salts).select(
        F.col("digest").alias(names["digest"]), F.col("alt").alias(names["alt"]), F.col("size").alias(names["size"]), F.col("best").alias(names["rank"]))
    return rows.join(won, list(names.values()), "left_semi").dropDuplicates(list(names.values())).select(*df.columns)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
