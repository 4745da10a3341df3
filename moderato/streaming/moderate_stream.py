"""The same ``moderate`` function on a streaming DataFrame.

The transform is stateless (one comment in, one verdict out), so it needs
no watermark or state store; per-micro-batch flag counts go through
``foreachBatch``.  Checkpoints live under the cluster's shared checkpoint
folder so a restarted query resumes from its last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderato.operators.score import batch_summary, moderate
from moderato.session import scratch_path

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def read_stream(spark: SparkSession, directory: str, schema: T.StructType = DOCUMENT_SCHEMA,
                fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over ``directory`` (optionally only files matching ``glob``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def moderate_stream(stream: DataFrame, text_col: str = "text", language: str = "auto", **kw) -> DataFrame:
    """The batch transform, unchanged, on a streaming DataFrame."""
    return moderate(stream, text_col, language=language, **kw)


def run_to_table(spark: SparkSession, stream: DataFrame, out_path: str | None = None,
                 checkpoint: str | None = None) -> str:
    """Drain a stream (``availableNow``) into Parquet; returns the path."""
    out_path = out_path or scratch_path(spark, "stream-out")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (stream.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path


def flag_counts_per_batch(spark: SparkSession, moderated_stream: DataFrame, out_path: str | None = None,
                          checkpoint: str | None = None) -> str:
    """``(total, flagged_count)`` of every micro-batch, under its own
    ``batch_id=`` partition; a replayed batch overwrites its earlier row."""
    out_path = out_path or scratch_path(spark, "batch-counts")
    checkpoint = checkpoint or scratch_path(spark, "batch-counts-ckpt")

    def write(batch: DataFrame, batch_id: int):
        batch_summary(batch).select("total", "flagged_count").write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = (moderated_stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return out_path
