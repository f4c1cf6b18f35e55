"""Session for tests, benches and local runs.

On a cluster the session comes from the platform.  Operators never set session
configuration and never touch the checkpoint folder; queries that write and read
back (sinks, streams) ask ``scratch_folder`` for a place below shared storage.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def build_session(cpus: str | int = "*", shuffle_partitions: int | None = None,
                  app: str = "equiflow", config: dict[str, str] | None = None) -> SparkSession:
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map=config or {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: below ``spark.checkpoint.dir``, or where that is unset below the warehouse.

    Both are settings of the session that are only read here.  A warehouse on the driver's own disk is no shared
    place: on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir")
        if top.startswith("file:") and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{top.rstrip('/')}/equiflow-{name}-{uuid.uuid4().hex}"
