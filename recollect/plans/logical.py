"""Queries that are SQL on both sides: one text over the logical tables, run by Spark and by the SQL that checks it.

A text names logical tables in braces and parameters by a colon. Spark gets the tables as DataFrames and the
parameters as arguments, so plans are pushed down and pruned like any others; a caller may pass other parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.plans.registry import ORACLE_SQL, QUERIES
from recollect.sources import tables


def _tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.tape(spark, sf_dir)
    return t.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = tables.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id"), "quality", "toxic")
    used = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").cast("long").alias("access"))
    rows = tables.memories(spark, sf_dir).join(labels, "memory_id", "left").join(used, "memory_id", "left")
    status = F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 0, "archived").otherwise("active")
    return rows.select("memory_id", "kind", "realm", "content", status.alias("status"), F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"), "access")


#: Logical tables: as a DataFrame, and as a subquery of the SQL that checks.
LOGICAL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "tape": (_tape, "(select event_id, user_id as session, event_type as tool, (props->>'$.k')::int as entity, (event_type = 'error')::int as failed, value as cost, epoch_us(ts) as us from events)"),
    "shelf": (_shelf, "(select d.doc_id as memory_id, lang as kind, source as realm, text as content, case when toxic = 1 then 'contradicted' when quality = 0 then 'archived' else 'active' end as status, coalesce(quality::double, 0.5) as confidence, e.label::bigint as access from documents d left join labels l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id)"),
    "memories": (tables.memories, "(select doc_id as memory_id, lang as kind, source as realm, text as content from documents)"),
    "turns": (tables.turns, "(select conv_id as session, turn, role, text from conversations)"),
    "triplets": (
        tables.triplets,
        "(select 'customer:' || c_custkey as subject, 'in_nation' as predicate, 'nation:' || c_nationkey as object, 1.0::double as weight from customer union all "
        "select 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, 1.0 from supplier union all select 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey, 1.0 from nation)",
    ),
    "marks": (lambda spark, sf_dir: tables.table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label")), "(select vec_id, label::bigint as label from embeddings)"),
    "orders": (lambda spark, sf_dir: tables.table(spark, sf_dir, "orders"), "orders"),
    "lineitem": (lambda spark, sf_dir: tables.table(spark, sf_dir, "lineitem"), "lineitem"),
    "part": (lambda spark, sf_dir: tables.table(spark, sf_dir, "part"), "part"),
    "customer": (lambda spark, sf_dir: tables.table(spark, sf_dir, "customer"), "customer"),
    "pages": (lambda spark, sf_dir: tables.table(spark, sf_dir, "pages"), "pages"),
}


def _literal(value: object) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def sql(name: str, about: str, text: str, **defaults: object) -> Callable[..., DataFrame]:
    """Register a query (spark, sf_dir, **params) given by one text, under its name."""
    # Numbers with a point are doubles on both sides; Spark would read them as decimals.
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)
    used = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark: SparkSession, sf_dir: str, **params: object) -> DataFrame:
        return spark.sql(text, args={**defaults, **params}, **{t: LOGICAL[t][0](spark, sf_dir) for t in used})

    run.__name__, run.__doc__ = name, about
    checked = text.format(**{t: LOGICAL[t][1] for t in used})
    for key in sorted(defaults, key=len, reverse=True):
        checked = re.sub(rf"(?<!:):{key}\b", lambda m, k=key: _literal(defaults[k]), checked)
    QUERIES[name], ORACLE_SQL[name] = run, checked
    return run
