"""Registered ingestion queries: queue, chunks, values."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.extract import VALUE, chunk, values
from recollect.operators.graph import shared_folder
from recollect.plans.registry import query
from recollect.sources.tables import memories
from recollect.streaming import queue


@query("select event_type tool, count(distinct event_id) n, round(sum(value), 4) total from events where user_id is not null and ts is not null group by event_type")
def queue_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages applied from the queue, by tool."""
    applied, _ = queue.drain(queue.once(queue.messages(spark, f"{sf_dir}/events.parquet"), "60 days"), f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}")
    return spark.read.parquet(applied).groupBy("tool").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("total"))


@query()
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every memory."""
    return chunk(memories(spark, sf_dir))


@query(f"select anchor, value, count(*) n, count(distinct doc_id) memories from (select doc_id, lower(regexp_extract(m, '{VALUE}', 1)) anchor, regexp_extract(m, '{VALUE}', 2) as value from (select doc_id, unnest(regexp_extract_all(text, '{VALUE}')) m from documents)) group by all")
def value_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that follow an anchor word, and the memories that hold them."""
    rows = memories(spark, sf_dir).select("memory_id", F.explode(values(F.col("content"))).alias("v"))
    return rows.groupBy(F.col("v.anchor").alias("anchor"), F.col("v.value").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"))
