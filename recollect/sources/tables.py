"""The logical tables (memories, turns, tape, triplets) as views of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id, kind, realm, content."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("memory_id"), F.col("lang").alias("kind"), F.col("source").alias("realm"), F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding (doubles), label."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, turn, role, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, session, tool, entity, failed (0/1), ts, cost: the event tape."""
    events = table(spark, sf_dir, "events")
    entity = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("tool"), entity.alias("entity"), (F.col("event_type") == "error").cast("int").alias("failed"), "ts", F.col("value").alias("cost"))


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, weight: the star schema's foreign keys as a graph; nodes are prefixed by their kind."""
    customer, nation, supplier = (table(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))

    def edge(df: DataFrame, subject: F.Column, predicate: str, object_: F.Column) -> DataFrame:
        return df.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), F.lit(1.0).alias("weight"))

    node = lambda prefix, c: F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))
    return (
        edge(customer, node("customer", "c_custkey"), "in_nation", node("nation", "c_nationkey"))
        .unionByName(edge(supplier, node("supplier", "s_suppkey"), "in_nation", node("nation", "s_nationkey")))
        .unionByName(edge(nation, node("nation", "n_nationkey"), "in_region", node("region", "n_regionkey")))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, status, valid_from, valid_to, order_id: bi-temporal order statuses of each customer."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"), F.col("o_orderkey").alias("order_id"))
