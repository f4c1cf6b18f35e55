"""From raw documents to packed training sequences, as five Spark jobs.

Each stage works on every document its predecessor kept; its result is written
as Parquet into the shared folder of the session and read again, so a stage that
loses executors starts from files.  All stages but the last return the columns of
``documents``:

1. ``language_id``: documents without a determined language go;
2. ``exact_dedup``: of texts equal but for white space one row stays;
3. ``near_dedup``: of each group linked by n-gram Jaccard the smallest id stays;
4. ``decontamination``: documents that hold a benchmark item go;
5. ``packing``: the rest is tokenised and packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equiflow.llm.common import shared_folder, table
from equiflow.llm.decontamination import drop_contaminated
from equiflow.llm.exact_dedup import exact_dedup
from equiflow.llm.jaccard_join import near_dedup
from equiflow.llm.language_id import fit, keep_identified
from equiflow.llm.packing import packed_pieces


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No SQL: a trained network, a tokenizer and connected components are not SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "corpus-pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
