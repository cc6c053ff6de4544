"""Extensions beyond the batch operators: windows over event streams and incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators.graph import upserted


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, time: str, kind: str, value: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) by tumbling or sliding windows; on a stream, rows later than the watermark are left out."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    grouped = timed.groupBy(F.window(time, length, slide) if slide else F.window(time, length), kind)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of events of a user without a longer gap."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    grouped = timed.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once_each(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Events without those that repeat a key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def upsert_into(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Keeps the latest row of each key under folder/v<batch>. A batch that comes again writes the same version again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = upserted(batch.limit(0), batch, keys, order)
        if number:
            new = upserted(spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}"), batch, keys, order)
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
