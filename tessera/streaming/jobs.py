"""Streams: files as they come, deduplicated or counted; a stream and a batch end with the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T


def read_stream(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def dedup_stream(df: DataFrame, column: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First arrival of each text; with a watermark (column, delay) state is dropped behind it."""
    keyed = df.withColumn("text_hash", T.text_hash(column))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["text_hash"])
    return keyed.dropDuplicates(["text_hash"])


def crawl_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("method").agg(F.count(F.lit(1)).alias("n_urls"), F.count_if("success").alias("n_success"))


def windowed_counts(df: DataFrame, at: str = "ts", size: str = "1 hour", slide: str | None = None, delay: str | None = None, *keys: str) -> DataFrame:
    """Tumbling windows, or sliding ones with `slide`; late rows beyond the delay are dropped in a stream."""
    df = df.withWatermark(at, delay) if delay and df.isStreaming else df
    w = F.window(at, size, slide) if slide else F.window(at, size)
    counted = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(df: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    df = df.withWatermark(at, delay) if delay and df.isStreaming else df
    counted = df.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once, as Parquet."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def roll_over_batches(df: DataFrame, folder: str, checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Each micro-batch as a folder of its own; a batch that is retried overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").format(kind).save(f"{folder}/crawled_p{number + 1}")

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
