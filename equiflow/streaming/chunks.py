"""Reply-chunk assembly (S12) and its streaming form.

Batch: chunks of a request are ordered by ``seq`` and joined, block by block.  Streaming: JSON lines are decoded, lines
sent twice are dropped inside the watermark, and chunks are grouped by (key, ``session_window``), so state is bounded
and closed sessions are written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Consecutive chunks that are joined in one place before the request is.
CHUNK_BLOCK = 256


def assemble_chunks(chunks: DataFrame, key: str = "request_id", seq: str = "seq", text: str = "response",
                    sep: str = "", block: int = CHUNK_BLOCK) -> DataFrame:
    """Ordered concatenation of a request's chunks: ``key, n_chunks, n_missing, n_repeated, text``.

    Chunks of one ``seq`` are reduced to the least text first (``n_repeated`` counts the others), then each block of
    consecutive ``seq`` is joined where it meets, and only joined blocks meet by request.  ``n_missing`` counts the
    numbers between the first and the last ``seq`` that no chunk has.  A chunk without ``seq`` comes first.
    """
    once = chunks.groupBy(F.col(key).alias("k"), F.col(seq).cast("long").alias("s")).agg(F.min(text).alias("t"), F.count(F.lit(1)).alias("n"))
    in_order = F.array_sort(F.collect_list(F.struct("s", "t")))
    blocks = once.groupBy("k", F.floor(F.col("s") / block).alias("b")).agg(
        in_order.alias("c"), F.sum("n").alias("n"), F.count("s").alias("placed"), F.count(F.lit(1)).alias("kept"), F.min("s").alias("low"), F.max("s").alias("high"))
    blocks = blocks.withColumn("t", F.array_join(F.transform("c", lambda x: x["t"]), sep)).withColumn("some", F.exists("c", lambda x: x["t"].isNotNull()))
    whole = blocks.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("b", F.when(F.col("some"), F.col("t")).alias("t")))).alias("c"), F.sum("n").alias("n"), F.sum("kept").alias("kept"),
        (F.max("high") - F.min("low") + 1 - F.sum("placed")).alias("missing"))
    return whole.select(F.col("k").alias(key), F.col("n").alias("n_chunks"), F.coalesce("missing", F.lit(0)).alias("n_missing"), (F.col("n") - F.col("kept")).alias("n_repeated"),
                        F.array_join(F.transform("c", lambda x: x["t"]), sep).alias("text"))


def session_chunks(stream: DataFrame, key: str, ts: str, seq: str, text: str, gap: str = "30 minutes",
                   watermark: str | None = "1 hour", sep: str = " ") -> DataFrame:
    """Per (key, session) ordered text, bounded state through watermark + session window.

    ``watermark=None`` for a stream that already has one.
    """
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark) if watermark else stream
    agg = s.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"),
                                             F.col(text).alias("x")))).alias("_c"))
    return agg.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n",
                      F.array_join(F.transform("_c", lambda x: x["x"]), sep).alias("text"))


def decode_chunks(lines: DataFrame, schema: str, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """``(chunks, rejects)`` of JSON lines; a malformed line is in ``rejects`` only."""
    parsed = lines.withColumn("_j", F.from_json(col, f"{schema}, _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_j").isNull() | F.col("_j._corrupt").isNotNull()
    return parsed.where(~bad).drop(col).select("*", "_j.*").drop("_j", "_corrupt"), parsed.where(bad).drop("_j")


@dataclass
class StreamCounts:
    """What the runs of a stream read and left out."""

    lines: int = 0
    rejects: int = 0
    duplicates: int = 0
    late: int = 0

    def add(self, query) -> None:
        for p in query.recentProgress:
            self.lines += p.numInputRows
            for op in p.stateOperators:
                self.late += op.numRowsDroppedByWatermark
                self.duplicates += op.customMetrics.get("numDroppedDuplicateRows", 0)


def run_line_stream(spark: SparkSession, src_dir: str, schema: str, out_dir: str, checkpoint: str, key: str, ts: str, seq: str, text: str,
                    gap: str = "30 minutes", watermark: str = "1 hour", sep: str = " ", counts: StreamCounts | None = None) -> DataFrame:
    """One ``availableNow`` run over the JSON-line files in ``src_dir`` that earlier runs of ``checkpoint`` have not read.

    Sessions are appended to ``out_dir/sessions`` once the watermark has passed their end, malformed lines and lines
    without a time to ``out_dir/rejects``; a (key, seq) that comes again inside the watermark is dropped, and so is a line
    older than the watermark.  Open sessions stay in the checkpoint for the next run: send a line without key and with
    a late time to close them (it belongs to no session).  Returns all sessions written so far.
    """
    lines = spark.readStream.schema("value STRING").text(src_dir).withColumnRenamed("value", "line")
    stamped = lines.select("line", F.from_json("line", f"{ts} STRING").getField(ts).try_cast("timestamp").alias("_at"))
    good, bad = decode_chunks(stamped, schema)
    timed = good.where("_at IS NOT NULL").drop(ts).withColumnRenamed("_at", ts).withWatermark(ts, watermark)
    sessions = session_chunks(timed.dropDuplicatesWithinWatermark([key, seq]), key, ts, seq, text, gap, None, sep)
    unread = bad.select("line").union(decode_chunks(stamped.withColumn("_line", F.col("line")), schema)[0].where("_at IS NULL").select(F.col("_line").alias("line")))

    def start(df: DataFrame, name: str):
        return (df.writeStream.outputMode("append").format("parquet").option("path", f"{out_dir}/{name}")
                .option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start())

    main, rejects = start(sessions, "sessions"), start(unread, "rejects")
    main.awaitTermination()
    rejects.awaitTermination()
    if counts:
        counts.add(main)
        counts.rejects = spark.read.schema(unread.schema).parquet(f"{out_dir}/rejects").count()
    return spark.read.schema(sessions.schema).parquet(f"{out_dir}/sessions").where(F.col(key).isNotNull())


def run_session_stream(spark: SparkSession, src_dir: str, schema: StructType | str, out_dir: str, checkpoint: str,
                       key: str, ts: str, seq: str, text: str, glob: str | None = None, mode: str = "append", **kw) -> DataFrame:
    """G01 over parquet files in ``src_dir`` with ``availableNow``, written as parquet to ``out_dir``; returns what lies there.

    Append mode: a session is written once the watermark has passed its end, then its
    state goes.  Sessions still open at the end of the input stay in the checkpoint for the next run.
    Complete mode (bounded runs): all sessions, the open ones too, replace ``out_dir`` after each batch.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = session_chunks(reader.parquet(src_dir), key, ts, seq, text, **kw)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        q = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out_dir)).start()
    else:
        q = writer.format("parquet").option("path", out_dir).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(out_dir)
