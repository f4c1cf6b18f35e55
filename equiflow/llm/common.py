"""Small helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or the caller set on the context.

    Only where there is none and driver and executors are one process, as in tests, a folder of this machine is set; on a
    cluster other executors would not see its files, so there it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="equiflow-"))
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder of the session, lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of the session, for tables that a later job reads again."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder that ``shared_folder`` named and that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(run):
    """``run`` (batches in, batches out) that hands the memory it freed back to the system when its task ends.

    Spark keeps idle Python workers, and each would hold on to its largest task's memory.
    """

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def id_remainder_py(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % modulus


def partition_bound(df: DataFrame, least: int = 8) -> int:
    """Shuffle partitions of the session, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
