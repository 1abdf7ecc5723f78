"""Code navigation over Python sources: symbols, calls, unique-name resolution, enclosing symbols."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _found(path: str, source: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield path, "class" if isinstance(node, ast.ClassDef) else "function", node.name, node.lineno, node.end_lineno
        elif isinstance(node, ast.Call) and isinstance(node.func, (ast.Name, ast.Attribute)):
            yield path, "call", node.func.id if isinstance(node.func, ast.Name) else node.func.attr, node.lineno, node.lineno


def index(files: DataFrame) -> DataFrame:
    """path, kind (function, class, call), name, start, end of files (path, source); files that don't parse give none."""

    def parsed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [x for p, s in zip(part["path"], part["source"], strict=True) if s for x in _found(p, s)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "start", "end"])

    return files.select("path", "source").mapInPandas(parsed, "path string, kind string, name string, start int, end int")


def enclosing(indexed: DataFrame) -> DataFrame:
    """path, name, line, caller of every call: the smallest symbol around its line, null at the top."""
    calls = indexed.where("kind = 'call'").select("path", "name", F.col("start").alias("line"))
    symbols = indexed.where("kind <> 'call'").select("path", F.col("name").alias("caller"), "start", "end")
    around = calls.join(symbols, "path").where("line between start and end")
    innermost = around.groupBy("path", "name", "line").agg(F.min_by("caller", F.struct(F.col("end") - F.col("start"), F.col("start"))).alias("caller"))
    return calls.distinct().join(innermost, ["path", "name", "line"], "left")


def resolve(indexed: DataFrame) -> DataFrame:
    """path, name, line, caller, resolution, target: calls with the one symbol of their name, in their own file if it has one."""
    calls = enclosing(indexed)
    defined = indexed.where("kind <> 'call'").select("name", F.col("path").alias("target"))
    counts = defined.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("only"))
    own = defined.groupBy("name", F.col("target").alias("path")).agg(F.count("*").alias("here"))
    rows = calls.join(counts, "name", "left").join(own, ["name", "path"], "left")
    resolution = F.when(F.col("n").isNull(), "unresolved").when((F.col("n") == 1) | (F.col("here") == 1), "unique_name").otherwise("ambiguous")
    target = F.when(F.col("here") == 1, F.col("path")).when(F.col("n") == 1, F.col("only"))
    return rows.select("path", "name", "line", "caller", resolution.alias("resolution"), target.alias("target"))


def overview(indexed: DataFrame, n: int = 5) -> DataFrame:
    """The n most called names."""
    return indexed.where("kind = 'call'").groupBy("name").agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), "name").limit(n)


def latest(indexed: DataFrame) -> DataFrame:
    """The last definition of every name in each file."""
    w = Window.partitionBy("path", "name").orderBy(F.desc("start"))
    return indexed.where("kind <> 'call'").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
