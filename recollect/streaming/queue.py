"""The ingest queue as a stream: each message once, late ones within a watermark, broken ones aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def messages(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event messages from a Parquet file or a folder of them."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may name a single file, which a stream doesn't take otherwise.
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return events.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("cost"))


def once(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Each message once, as long as its repetition comes within the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def drain(stream: DataFrame, folder: str, good: str = "session is not null and ts is not null") -> tuple[str, str]:
    """Write what is there to folder/applied, broken messages to folder/dead, and stop.

    The checkpoint in folder/checkpoint makes a restart go on where it stopped; a batch that is run again replaces
    its own files.
    """

    def apply(batch: DataFrame, number: int) -> None:
        for name, rows in (("applied", batch.where(good)), ("dead", batch.where(f"not ({good})"))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/applied", f"{folder}/dead"


def heartbeats(stream: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """session, window, n: activity of each session in windows that end after a gap."""
    return stream.withWatermark("ts", delay).groupBy("session", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))
