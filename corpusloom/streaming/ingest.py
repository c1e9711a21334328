"""Incremental ingest and windowed counts as structured streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream with the columns of like."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def window_counts(events: DataFrame, ts: str, by: Sequence[str], length: str, late: str) -> DataFrame:
    """start, by, n and total of value per tumbling window; events later than late are left out by the
    watermark, and state goes with it. Works on streams and tables."""
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    out = seen.groupBy(F.window(ts, length), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def first_of_key(events: DataFrame, key: Sequence[str], ts: str, late: str) -> DataFrame:
    """Each key once within the watermark; state does not outgrow it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(key))


def append_new(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the target lacks, in the batches that are there now.

    A batch writes its own folder, overwriting what a failed try of it left, so a restart from the
    checkpoint gives the same rows once."""
    spark = stream.sparkSession

    def one(batch: DataFrame, n: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(target)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.parquet(target).where(F.col("batch") != n).select(key)
            fresh = fresh.join(held, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
