"""Registered graph, temporal and conflict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators import graph
from recollect.plans.registry import query
from recollect.sources.tables import facts, memories, table, triplets

DAY = "1996-06-01"
LEAST_DEALT, LINES_OF_A_TASK = 8, 250_000  #: partitions at least that lines are dealt to, lines of each

_T = """(select 'customer:' || c_custkey subject, 'in_nation' predicate, 'nation:' || c_nationkey object, 1.0::double weight from customer union all
  select 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey, 1.0 from supplier union all
  select 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey, 1.0 from nation)"""
_FACTS = "(select o_custkey customer, o_orderstatus status, o_orderdate valid_from, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) valid_to, o_orderkey order_id from orders)"


@query(f"select subject, object from {_T} where predicate = 'in_region'")
def triplet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets of one predicate."""
    return triplets(spark, sf_dir).where("predicate = 'in_region'").select("subject", "object")


@query(f"select customer, status, order_id from {_FACTS} where valid_from <= '{DAY}' and (valid_to is null or valid_to > '{DAY}')")
def triplets_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every customer's orders valid at a day."""
    return graph.as_of(facts(spark, sf_dir), DAY).select("customer", "status", "order_id")


@query("select o_custkey customer, o_orderkey order_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) previous, o_orderstatus status from orders")
def triplet_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of each customer's status with the one before."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_id"), F.row_number().over(w).cast("long").alias("version"), F.lag("o_orderstatus").over(w).alias("previous"), F.col("o_orderstatus").alias("status"))


@query("select order_id, status, coalesce(next_order, -1) next_order, case when next_order is null then 'active' else 'superseded' end state from (select o_orderkey order_id, o_orderstatus status, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) next_order from orders)")
def memory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's status was superseded by a later one of its customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.lead("o_orderkey").over(w).alias("next_order"))
    return rows.withColumn("state", F.when(F.col("next_order").isNull(), "active").otherwise("superseded")).fillna({"next_order": -1})


@query("select o_custkey customer, first(o_orderkey order by o_orderdate, o_orderkey) root, last(o_orderkey order by o_orderdate, o_orderkey) current_, count(*) length from orders group by o_custkey")
def supersession_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and current order of each customer's chain of statuses."""
    key = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("o_orderkey", key).alias("root"), F.max_by("o_orderkey", key).alias("current_"), F.count("*").alias("length"))


@query("select o_custkey customer, count(distinct o_orderstatus) statuses, count(*) n from orders group by o_custkey having count(distinct o_orderstatus) > 1")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that hold different objects under one predicate."""
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.countDistinct("o_orderstatus").alias("statuses"), F.count("*").alias("n"))
    return by.where("statuses > 1")


_BOTH = f"(select subject a, object b from {_T} union select object, subject from {_T})"


@query(f"with recursive r(node, hop) as (select 'region:1', 0 union select b, hop + 1 from r join {_BOTH} on a = node where hop < 3) select node, min(hop)::int hop from r group by node")
def bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within three hops of a region."""
    return graph.bfs(triplets(spark, sf_dir), "region:1", hops=3)


def _pagerank_sql(iterations: int) -> str:
    sql = f"with recursive b as (select a, b from {_BOTH}), d as (select a, count(*) degree from b group by a), n as (select count(*) n from d), r0 as (select a node, 1.0::double / n score from d, n)"
    for i in range(1, iterations + 1):
        sql += f", r{i} as (select b.b node, 0.15::double / max(n.n) + 0.85::double * sum(score / degree) score from b join d using (a) join r{i - 1} on node = b.a, n group by b.b)"
    return sql + f" select node, round(score, 8) score from r{iterations}"


@query(_pagerank_sql(8))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank of the graph's nodes after 8 iterations."""
    return graph.pagerank(triplets(spark, sf_dir), iterations=8).select("node", F.round("score", 8).alias("score"))


@query(f"select t.object answer, t.predicate, t.weight from {_T} t where t.subject = 'customer:2' and t.predicate in (select predicate from {_T} where subject = 'customer:1' and object = (select 'nation:' || c_nationkey from customer where c_custkey = 1))")
def analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer:1 is to its nation as customer:2 is to what?"""
    edges = triplets(spark, sf_dir)
    # The example's object is looked up: one row.
    nation = table(spark, sf_dir, "customer").where("c_custkey = 1").select("c_nationkey").first()
    return graph.analogy(edges, "customer:1", f"nation:{nation[0]}" if nation else "", "customer:2")


@query(f"select a.subject, b.object region from {_T} a join {_T} b on a.object = b.subject where a.predicate = 'in_nation' and b.predicate = 'in_region'")
def query_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """in_nation, then in_region, of every subject."""
    t = triplets(spark, sf_dir)
    first = t.where("predicate = 'in_nation'").select("subject", F.col("object").alias("via"))
    second = t.where("predicate = 'in_region'").select(F.col("subject").alias("via"), F.col("object").alias("region"))
    return first.join(second, "via").select("subject", "region")


@query(f"select predicate, count(*) n, count(distinct subject) subjects, count(distinct object) objects from {_T} group by predicate")
def assoc_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, subjects and objects of each predicate."""
    return triplets(spark, sf_dir).groupBy("predicate").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


@query(f"select node, count(*) degree from (select subject node from {_T} union all select object from {_T}) group by node order by degree desc, node limit 5")
def god_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nodes of highest degree."""
    t = triplets(spark, sf_dir)
    nodes = t.select(F.col("subject").alias("node")).unionByName(t.select(F.col("object").alias("node")))
    return nodes.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(5)


@query("select a.l_partkey part, b.l_partkey other, count(*) n from (select distinct l_orderkey, l_partkey from lineitem) a join (select distinct l_orderkey, l_partkey from lineitem) b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey group by all having count(*) >= 2")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that occur together in two orders or more; an order has a handful of lines, which bounds its pairs."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    # So many partitions that a task's share doesn't grow with the table. Pairs hardly repeat within a task, so they are counted after they are dealt out only.
    n = max(LEAST_DEALT, -(-rows.count() // LINES_OF_A_TASK))
    lines = rows.repartition(n, "l_orderkey").distinct()
    pairs = lines.alias("a").join(lines.alias("b"), F.expr("a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey"))
    pairs = pairs.select(F.col("a.l_partkey").alias("part"), F.col("b.l_partkey").alias("other")).repartition(n, "part", "other")
    return pairs.groupBy("part", "other").agg(F.count("*").alias("n")).where("n >= 2")


@query(f"with s as (select object node, 1.0::double w from {_T} where subject = 'customer:1'), h as (select t.subject node, sum(s.w * 0.5 * t.weight) w from s join {_T} t on t.object = s.node group by t.subject), g as (select t.object node, sum(s.w * 0.5 * t.weight) w from s join {_T} t on t.subject = s.node group by t.object) select node, round(sum(w), 6) activation from (select * from s union all select * from h union all select * from g) group by node")
def spreading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activation that spreads from a customer's objects over one more hop, halved."""
    t = triplets(spark, sf_dir)
    seeds = t.where("subject = 'customer:1'").select(F.col("object").alias("node"), F.lit(1.0).alias("w"))
    back = t.join(seeds, F.col("object") == F.col("node")).groupBy(F.col("subject").alias("to")).agg(F.sum(F.col("w") * 0.5 * F.col("weight")).alias("w"))
    ahead = t.join(seeds, F.col("subject") == F.col("node")).groupBy(F.col("object").alias("to")).agg(F.sum(F.col("w") * 0.5 * F.col("weight")).alias("w"))
    return seeds.unionByName(back.withColumnRenamed("to", "node")).unionByName(ahead.withColumnRenamed("to", "node")).groupBy("node").agg(F.round(F.sum("w"), 6).alias("activation"))


@query("select md5(text) content_md5, min(doc_id) kept, count(*) copies from documents group by text having count(*) > 1")
def consolidate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of the same content, and the one that stays."""
    return memories(spark, sf_dir).groupBy(F.md5("content").alias("content_md5")).agg(F.min("memory_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("select lang kind, count(*) n, round(avg(coalesce(quality, 0.5)), 6) confidence, sum(case when toxic = 1 then 1 else 0 end)::bigint flagged from documents left join labels using (doc_id) group by lang")
def memory_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of each kind, their mean confidence and how many are flagged."""
    rows = memories(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "memory_id"), "memory_id", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("quality").cast("double"), F.lit(0.5))), 6).alias("confidence"), F.sum(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("flagged"))


@query("select doc_id memory_id, case when toxic = 1 then 'contradicted' when quality = 0 then 'archived' else 'active' end status from documents left join labels using (doc_id)")
def list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle status of every memory from its tags."""
    rows = memories(spark, sf_dir).join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "memory_id"), "memory_id", "left")
    return rows.select("memory_id", F.when(F.col("toxic") == 1, "contradicted").when(F.col("quality") == 0, "archived").otherwise("active").alias("status"))


@query("select doc_id memory_id from documents where doc_id in (select doc_id from labels where toxic = 1) and doc_id not in (select doc_id from labels where quality = 0)")
def tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with one tag and without another."""
    labels = table(spark, sf_dir, "labels")
    ids = memories(spark, sf_dir).select("memory_id")
    with_tag = labels.where("toxic = 1").select(F.col("doc_id").alias("memory_id"))
    without = labels.where("quality = 0").select(F.col("doc_id").alias("memory_id"))
    return ids.join(with_tag, "memory_id", "left_semi").join(without, "memory_id", "left_anti")
