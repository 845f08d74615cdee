"""A stream's view of task state: latest status, stale tasks, one delivery for each job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import scratch


def events_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def latest_status(events: DataFrame) -> DataFrame:
    """Status by the last event of each user (SM07)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("event_id").alias("last_event"))


def deliveries(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, whatever is delivered again within the watermark (SM10)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def drained(stream: DataFrame, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what there is and give its result, from the shared folder: a batch's rows
    are written under the batch's number, so one that runs twice replaces itself."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    place = checkpoint or f"{path}/checkpoint"
    stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
