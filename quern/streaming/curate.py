"""Streams: the curator's flush-as-you-go shape, and windowed statistics (an extension; the reference has no engine for streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def curate(spark: SparkSession, source: str, schema: str | StructType, out: str, checkpoint: str, by: str = "context") -> StreamingQuery:
    """Groups prompts and responses by context within each micro-batch and appends them: equal contexts of different batches stay apart.

    A batch is written under its number, so a replay after a failure replaces it.
    """

    def flush(batch: DataFrame, number: int) -> None:
        g = batch.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "prompt", "response"))).alias("l"))
        g.select(by, F.col("l.pos").alias("pos"), F.col("l.prompt").alias("prompts"), F.col("l.response").alias("responses")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(source)
    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stats(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count, mean and maximum by event type and window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"))
