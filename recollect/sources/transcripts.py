"""Transcripts as JSON lines, whose content is a string or an array of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCKS = "array<struct<type:string,text:string>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, line, type, role, text of every turn; lines that aren't JSON are dropped, reminders of the system stripped.

    Lines are numbered in each file by their place in it. Files are read in splits: a line's number is its place in
    its split and the lines of the splits before, of which there is one row each.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = rows.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block")) - F.col("n")
    splits = splits.select("path", "block", "first", before.alias("before"))
    rows = rows.join(F.broadcast(splits), ["path", "block"])
    return parse(rows.select("path", (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("line"), "value"))


def parse(rows: DataFrame) -> DataFrame:
    """rows (path, line, value) parsed."""
    get = lambda p: F.get_json_object("value", p)
    content = get("$.message.content")
    blocks = F.from_json(content, _BLOCKS)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    text = F.when(content.startswith("["), joined).otherwise(content)
    text = F.trim(F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", ""))
    parsed = rows.select("path", "line", get("$.type").alias("type"), get("$.message.role").alias("role"), text.alias("text"))
    return parsed.where(F.col("type").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0))
