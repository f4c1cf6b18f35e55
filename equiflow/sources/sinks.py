"""Sinks (K01-K04) and the CSV/JSON readers that read them back.

Every sink takes its output path from the caller; the registered queries use
``session.scratch_folder``, which is shared storage.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> int:
    """Several tables as one version of a bundle (the two-sheet workbook as two datasets); returns the version.

    Each version's tables go to a folder of their own.  One manifest row per table (name, rows, schema, folder) is
    written last and makes the version visible: a write that fails half-way leaves the version before in force.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"{path}/data-{uuid.uuid4().hex}"
    rows = []
    for name, df in tables.items():
        df.write.format(fmt).option("header", True).save(f"{folder}/{name}")
        written = spark.read.schema(df.schema).format(fmt).option("header", True).load(f"{folder}/{name}")
        rows.append((name, written.count(), df.schema.json(), f"{folder}/{name}", fmt))
    version = max((r["version"] for r in _manifests(spark, path)), default=0) + 1
    one = spark.createDataFrame([(version, *r) for r in rows], MANIFEST).coalesce(1)
    one.write.mode("append").json(f"{path}/manifest")
    return version


MANIFEST = "version INT, name STRING, rows BIGINT, schema STRING, folder STRING, format STRING"


def _manifests(spark: SparkSession, path: str) -> list[Row]:
    """The manifest rows of all versions: a few per write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()


def read_bundle(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """K01 read back: the tables of a version (the newest), as its manifest lists them; an error where rows are missing."""
    rows = _manifests(spark, path)
    if not rows:
        raise FileNotFoundError(f"no bundle was completed in {path}")
    version = version or max(r["version"] for r in rows)
    out = {}
    for r in rows:
        if r["version"] == version:
            df = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).format(r["format"]).option("header", True).load(r["folder"])
            if (n := df.count()) != r["rows"]:
                raise OSError(f"table {r['name']} of version {version} has {n} rows, its manifest {r['rows']}")
            out[r["name"]] = df
    return out


#: Rows of one file of ``write_per_ticker``.
FILE_ROWS = 1_000_000


def write_per_ticker(df: DataFrame, path: str, key: str = "ticker", rows: int = FILE_ROWS, label: str = "DCF_Analysis") -> str:
    """CSV files per ticker, in a folder ``file={ticker}_DCF_Analysis`` each, of at most ``rows`` rows.

    Rows are counted per ticker first.  A ticker of up to ``rows`` rows stays whole in one file; a larger one is dealt over
    as many tasks as it needs files, by the hash of the whole row.  A null ticker's folder is ``file=null_DCF_Analysis``.
    """
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    salted = df.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.col("_parts")))
    salted = salted.withColumn("file", F.concat_ws("_", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(label)))
    out = salted.repartition("file", "_salt").drop("_k", "_parts", "_salt")
    out.write.mode("overwrite").partitionBy("file").option("header", True).option("maxRecordsPerFile", rows).csv(path)
    return path


def write_text(df: DataFrame, path: str, col: str = "text") -> str:
    """Plain text lines."""
    df.select(F.col(col).cast("string")).write.mode("overwrite").text(path)
    return path


def reply_json(df: DataFrame, col: str = "reply") -> DataFrame:
    """``{"reply": ...}`` JSON records."""
    return df.select(F.to_json(F.struct(F.col(col).alias("reply"))).alias("json"))


CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of CSV files with a declared schema (no inference pass).

    A record that does not fit the schema is in ``rejects`` only, as its text in ``_corrupt``.
    """
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    declared = StructType([*fields.fields, StructField(CORRUPT, StringType())])
    both = spark.read.option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(declared).csv(path)
    # true for every row: Spark reads no CSV for the corrupt column alone, as a count of either side would
    both = both.where(F.xxhash64(*fields.fieldNames()) >= F.lit(-(2**63)))
    return both.where(F.col(CORRUPT).isNull()).drop(CORRUPT), both.where(F.col(CORRUPT).isNotNull())
