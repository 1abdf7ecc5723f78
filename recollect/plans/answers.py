"""Registered queries that answer from fused lanes: hybrid, lanes, lenses, conflicts, contexts; near duplicates, paths, compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import fusion, graph, lexical, similar, vector
from recollect.operators import transcript as tr
from recollect.plans import retrieval as R
from recollect.plans.graphs import _BOTH, _T
from recollect.plans.logical import LOGICAL
from recollect.plans.registry import ORACLE_SQL, query
from recollect.sources.tables import memories, table, triplets, turns, vectors

_SHELF = LOGICAL["shelf"][1]
_BEST = R.top_sql(R._rrf_sql(), 20)


def _shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LOGICAL["shelf"][0](spark, sf_dir)


def _best(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE, n: int = 20) -> DataFrame:
    return lexical.top(fusion.rrf(R._lanes(spark, sf_dir, R.DEPTH, question, probe)), n)


@query(R.top_sql(f"select memory_id, round(sum(case lane when 'semantic' then 0.6::double else 0.4 end / (60 + rank)), 9) score from ({R._LANES}) l left join (select vec_id, score cos from ({R.knn_sql()})) v on v.vec_id = memory_id and lane = 'semantic' where not (coalesce(cos, 1) > 0 and coalesce(cos, 1) < 0.10) group by memory_id", 20))
def hybrid_recall(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE, weights: tuple[float, float] = (0.6, 0.4), floor: float = 0.10) -> DataFrame:
    """Weighted fusion of vectors and words; a likeness above 0 and below the floor doesn't count."""
    lanes = R._lanes(spark, sf_dir, R.DEPTH, question, probe)
    semantic = lanes["semantic"].where(~((F.col("score") > 0) & (F.col("score") < floor)))
    return lexical.top(fusion.rrf({"semantic": semantic, "keyword": lanes["keyword"]}, {"semantic": weights[0], "keyword": weights[1]}).select("memory_id", "score"), 20)


_LANE_LIMITS = {"semantic": 6, "keyword": 3, "hybrid": 5}


@query(f"select lane, memory_id, rank from ({R._LANES}) where rank <= case lane when 'semantic' then 6 else 3 end union all select 'hybrid', memory_id, rank from ({R.top_sql(R._rrf_sql(), 5)})")
def recall_lanes(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE) -> DataFrame:
    """The lanes of a prompt, each with its own limit."""
    lanes = R._lanes(spark, sf_dir, R.DEPTH, question, probe)
    lanes["hybrid"] = lexical.top(fusion.rrf(lanes), 5)
    rows = [lane.where(F.col("rank") <= _LANE_LIMITS[name]).select(F.lit(name).alias("lane"), "memory_id", "rank") for name, lane in lanes.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_TIMED = "select (props->>'$.k')::bigint memory_id, max(epoch_us(ts)) score from events where (props->>'$.k')::bigint in (select doc_id from documents) group by 1"


@query(f"select memory_id, round(sum(1.0::double / (60 + rank)), 9) score, string_agg(lens, '' order by lens) lenses from (select memory_id, rank, case lane when 'keyword' then 'F' else 'C' end lens from ({R._LANES}) where rank <= 20 union all select memory_id, rank, 'T' from ({R.top_sql(_TIMED, 20)})) group by memory_id")
def structured_recall(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE) -> DataFrame:
    """Three lenses fused: facts (words), context (vectors) and time (spoken of last), with the lenses that saw each memory."""
    lanes = R._lanes(spark, sf_dir, 20, question, probe)
    spoken = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("memory_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("score"))
    spoken = lexical.top(spoken.join(memories(spark, sf_dir).select("memory_id"), "memory_id", "left_semi"), 20)
    rows = None
    for lens, lane in (("F", lanes["keyword"]), ("C", lanes["semantic"]), ("T", spoken)):
        part = lane.select("memory_id", (1.0 / (fusion.RRF_K + F.col("rank"))).alias("part"), F.lit(lens).alias("lens"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("memory_id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("lens")), "").alias("lenses"))


@query(f"select memory_id, score, rank from ({_BEST})")
def explore_recall(spark: SparkSession, sf_dir: str, **asked: object) -> DataFrame:
    """Ids and scores alone."""
    return _best(spark, sf_dir, **asked).select("memory_id", "score", "rank")


@query(f"select b.memory_id, b.rank, s.status, s.confidence, (select count(*) - 1 from documents c where md5(c.text) = md5(s.content)) partners from ({_BEST}) b join {_SHELF} s using (memory_id)")
def conflict_inspector(spark: SparkSession, sf_dir: str, **asked: object) -> DataFrame:
    """Status of each hit and how many others hold the same content."""
    copies = memories(spark, sf_dir).groupBy(F.md5("content").alias("h")).agg((F.count("*") - 1).alias("partners"))
    # Twenty hits.
    hits = _shelf(spark, sf_dir).join(F.broadcast(_best(spark, sf_dir, **asked).select("memory_id", "rank")), "memory_id")
    return copies.join(F.broadcast(hits.withColumn("h", F.md5("content"))), "h").select("memory_id", "rank", "status", "confidence", "partners")


@query(f"select b.memory_id, b.score, s.realm source, s.status, s.status = 'archived' stale, s.confidence from ({_BEST}) b join {_SHELF} s using (memory_id) where s.confidence >= 0.5")
def what_do_i_know_about(spark: SparkSession, sf_dir: str, least: float = 0.5, **asked: object) -> DataFrame:
    """Claims on a topic with where they come from, whether they are stale, and how sure they are."""
    hits = _shelf(spark, sf_dir).join(F.broadcast(_best(spark, sf_dir, **asked).select("memory_id", "score")), "memory_id").where(F.col("confidence") >= least)
    return hits.select("memory_id", "score", F.col("realm").alias("source"), "status", (F.col("status") == "archived").alias("stale"), "confidence")


@query(f"select memory_id, spent from (select b.memory_id, sum(floor(length(s.content) / 4)) over (order by b.rank rows unbounded preceding)::bigint spent from ({_BEST}) b join {_SHELF} s using (memory_id)) where spent <= 8000")
def smart_context(spark: SparkSession, sf_dir: str, budget: int = 8000, **asked: object) -> DataFrame:
    """Hits, best first, while a quarter of their characters fits a budget."""
    hits = memories(spark, sf_dir).join(F.broadcast(_best(spark, sf_dir, **asked).select("memory_id", "rank")), "memory_id")
    # A window over twenty rows.
    spent = F.sum(F.floor(F.length("content") / 4)).over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("spent", spent).where(F.col("spent") <= budget).select("memory_id", "spent")


_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
@query(f"select a.vec_id a, b.vec_id b, round({_COS}, 6) score from embeddings a join embeddings b on a.vec_id < b.vec_id where {_COS} >= 0.9")
def find_near_duplicates(spark: SparkSession, sf_dir: str, threshold: float = 0.9) -> DataFrame:
    """Pairs of vectors of a cosine at the threshold or above, by an index of random hyperplanes."""
    return similar.near_pairs(vectors(spark, sf_dir), threshold)


@query(f"select label, round(avg(score), 3) mean_score, count(*) n, round(1 - max(score), 3) quality from (select vec_id, score, label from ({R.knn_sql()}) join (select vec_id, label from embeddings) using (vec_id)) group by label order by mean_score desc, label limit 1")
def behavioral_dominant(spark: SparkSession, sf_dir: str, probe: int = R.PROBE) -> DataFrame:
    """The class most like the probe, and how far its best exemplar is."""
    v = vectors(spark, sf_dir)
    scored = vector.knn(v, probe, "label").groupBy("label").agg(F.round(F.avg("score"), 3).alias("mean_score"), F.count("*").alias("n"), F.round(1 - F.max("score"), 3).alias("quality"))
    return scored.orderBy(F.desc("mean_score"), "label").limit(1)


_POOL = "list_transform(generate_series(0, 31), lambda i: (e[2 * i + 1] + e[2 * i + 2]) / 2)"


@query(f"select vec_id, list_sum(list_transform(p, lambda x: greatest(-127, least(127, round(x / (m / 127))))))::bigint code_sum, round(m / 127, 9) scale from (select vec_id, p, list_max(list_transform(p, lambda x: abs(x))) m from (select vec_id, {_POOL} p from (select vec_id, embedding::double[] e from embeddings)))")
def query_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors pooled to 32 dimensions in int8: scale and checksum of the codes."""
    s = vectors(spark, sf_dir).select("vec_id", vector.sketch("embedding").alias("s"))
    return s.select("vec_id", F.aggregate("s.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"), F.round("s.scale", 9).alias("scale"))


def _hopfield_sql(beta: float, steps: int) -> str:
    sql = f"with x as (select vec_id, embedding::double[] e from embeddings), s0 as (select e s from x where vec_id = {R.PROBE})"
    for i in range(1, steps + 1):
        sql += f""", w{i} as (select e, exp({beta} * (list_dot_product(e, s) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(s, s)) - 1)) w from x, s{i - 1}),
        d{i} as (select k, sum(w * v) / sum(w) v from (select w, unnest(e) v, generate_subscripts(e, 1) k from w{i}) group by k),
        s{i} as (select list(v / n order by k) s from d{i}, (select sqrt(sum(v * v)) n from d{i}))"""
    return sql + f" select k - 1 as dim, round(v, 5) as value from (select unnest(s) v, generate_subscripts(s, 1) k from s{steps})"


@query(_hopfield_sql(8.0, 3))
def hopfield_recall(spark: SparkSession, sf_dir: str, probe: int = R.PROBE, beta: float = 8.0, steps: int = 3) -> DataFrame:
    """A query's state after some updates of a modern Hopfield network over all vectors: one aggregation a step."""
    return vector.hopfield(vectors(spark, sf_dir), probe, beta, steps)


def _personal_sql(seed: str, iterations: int) -> str:
    sql = f"with recursive b as (select a, b from {_BOTH}), d as (select a, count(*) degree from b group by a), r0 as (select a node, case when a = '{seed}' then 1.0::double else 0.0 end score from d)"
    for i in range(1, iterations + 1):
        sql += f", r{i} as (select b.b node, case when b.b = '{seed}' then 0.15::double else 0.0 end + 0.85::double * sum(score / degree) score from b join d using (a) join r{i - 1} on node = b.a group by b.b)"
    return sql + f" select node, round(score, 8) score from r{iterations} order by score desc, node limit 20"


@query(_personal_sql("nation:3", 8))
def personal_pagerank(spark: SparkSession, sf_dir: str, seed: str = "nation:3", iterations: int = 8, limit: int = 20) -> DataFrame:
    """The nodes that matter most to one."""
    ranks = graph.pagerank(triplets(spark, sf_dir), iterations=iterations, seed=seed)
    return ranks.select("node", F.round("score", 8).alias("score")).orderBy(F.desc("score"), "node").limit(limit)


@query(f"with recursive f(node, hop) as (select 'customer:1', 0 union select b, hop + 1 from f join {_BOTH} on a = node where hop < 4), g(node, hop) as (select 'supplier:1', 0 union select b, hop + 1 from g join {_BOTH} on a = node where hop < 4), ff as (select node, min(hop) hop from f group by node), gg as (select node, min(hop) hop from g group by node), m as (select min(ff.hop + gg.hop) n from ff join gg using (node)) select node, ff.hop::int hop from ff join gg using (node), m where ff.hop + gg.hop = n")
def shortest_path(spark: SparkSession, sf_dir: str, start: str = "customer:1", end: str = "supplier:1", hops: int = 4) -> DataFrame:
    """Nodes on the shortest undirected connections of two nodes, with their distance from the first."""
    return graph.shortest(triplets(spark, sf_dir), start, end, hops)


def _compact_sql(budget: int) -> str:
    lex = R._LEX
    return f"""with recursive t as (select conv_id session, turn, role, {lex} tokens, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::double)::bigint cost, count(*) over (partition by conv_id) n, row_number() over (partition by conv_id order by turn) - 1 i from conversations),
    q as (select session, arg_max(tokens, turn) asked from t where role = 'user' group by session),
    s as (select t.*, (case when role = 'user' then 1.1 else 1.0 end)::double * (0.65 * case when len(asked) > 0 then len(list_intersect(tokens, asked)) / len(asked)::double else 0 end + 0.25 * (0.2 + 0.8 * case when n > 1 then i / (n - 1)::double else 1 end) + 0.10) score from t join q using (session)),
    m as (select session, median(score) med from s group by session), d as (select session, median(abs(score - med)) mad from s join m using (session) group by session),
    o as (select session, turn, i, n, cost, round(score, 9) score, score >= med + 0.5 * mad good from s join m using (session) join d using (session)),
    best as (select *, sum(cost) over (partition by session order by score desc, i rows unbounded preceding) spent from o where good),
    base as (select session, coalesce(sum(cost), 0) spent, list(i) kept from (select * from best where spent <= {budget}) group by session),
    steps as (select session, i, cost, most, row_number() over (partition by session order by phase, rank_) step from (
      select session, i, cost, {budget}::double most, 1 phase, row_number() over (partition by session order by score desc, i) rank_ from o where not good union all select session, i, cost, {budget} * 1.2::double, 2, i from o where i >= n - 2)),
    walk(session, step, spent, kept) as (select session, 0::bigint, coalesce(b.spent, 0)::double, coalesce(kept, []) from (select distinct session from o) left join base b using (session)
      union all select w.session, s.step, case when not list_contains(w.kept, s.i) and w.spent + s.cost <= s.most then w.spent + s.cost else w.spent end, case when not list_contains(w.kept, s.i) and w.spent + s.cost <= s.most then list_append(w.kept, s.i) else w.kept end from walk w join steps s on s.session = w.session and s.step = w.step + 1),
    fin as (select session, arg_max(kept, step) kept from walk group by session)
    select session, turn, round(score, 6) score, cost, good from o join fin using (session) where list_contains(kept, i)"""


@query(_compact_sql(300))
def trajectory_compact(spark: SparkSession, sf_dir: str, budget: int = 300, k: float = 0.5) -> DataFrame:
    """The turns of each session that stay within a token budget: the best of those above median + k MAD, others that still fit, the last two."""
    return tr.compact(turns(spark, sf_dir), budget, k)


def _labels_sql(iterations: int) -> str:
    sql = f"with recursive b as (select a, b from {_BOTH}), l0 as (select distinct a node, a label from b)"
    for i in range(1, iterations + 1):
        sql += f", l{i} as (select node, label from (select b.a node, label, count(*) n from b join l{i - 1} on node = b.b group by all) qualify row_number() over (partition by node order by n desc, label) = 1)"
    return sql + f" select node, label from l{iterations}"


@query(_labels_sql(6))
def label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graph by six rounds of label propagation."""
    return graph.label_propagation(triplets(spark, sf_dir))


@query(f"select round(max(greatest(1 / (1 + exp(-(3.27 * score - 0.85))), {R._overlap_sql(R.QUESTION)})), 6) max_rel, case when count(*) = 0 then 'empty' when max(greatest(1 / (1 + exp(-(3.27 * score - 0.85))), {R._overlap_sql(R.QUESTION)})) < 0.45 then 'weak' else 'ok' end status from ({R.top_sql(R._SEMANTIC, 10)}) join documents on doc_id = memory_id")
def abstain_gate(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE) -> DataFrame:
    """Whether the best hits are good enough to answer with, by likeness or by words."""
    from recollect.operators.recall import confidence

    best = R._lanes(spark, sf_dir, 10, question, probe)["semantic"]
    hits = memories(spark, sf_dir).join(F.broadcast(best.select("memory_id", "score")), "memory_id")
    return confidence(hits, F.col("score"), lexical.term_overlap(F.col("content"), question))


_NAMES = ",".join(f"'{w}'" for w in T.QUESTION_WORDS)


@query(f"select w entity, count(*) n, count(distinct doc_id) memories from (select doc_id, unnest(list_filter(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][a-z]+)\\b', 1)), lambda w: not list_contains([{_NAMES}], w))) w from documents) group by w")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories that name each entity."""
    rows = memories(spark, sf_dir).select("memory_id", F.explode(T.entities(F.col("content"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"))


@query(f"with recursive f(node, hop) as (select 'nation:1', 0 union select b, hop + 1 from f join {_BOTH} on a = node where hop < 3), g(node, hop) as (select 'nation:6', 0 union select b, hop + 1 from g join {_BOTH} on a = node where hop < 3), ff as (select node, min(hop) hop from f group by node), gg as (select node, min(hop) hop from g group by node), m as (select min(ff.hop + gg.hop) n from ff join gg using (node)) select node, ff.hop::int hop from ff join gg using (node), m where ff.hop + gg.hop = n")
def code_path(spark: SparkSession, sf_dir: str, start: str = "nation:1", end: str = "nation:6") -> DataFrame:
    """The shortest undirected connection of two uniquely named nodes."""
    return graph.shortest(triplets(spark, sf_dir), start, end, 3)


@query("select vec_id, i - 1 dim, round(x, 6) as value from (select vec_id, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings where vec_id in (1, 2, 3))")
def get_embeddings(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The components of some vectors; the filter reaches the scan."""
    v = vectors(spark, sf_dir).where(F.col("vec_id").isin(*ids))
    return v.select("vec_id", F.posexplode("embedding").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def _resonance_sql(k: int) -> str:
    near = "select x.vec_id, list_cosine_similarity(x.e, s) score from x, {s} where x.vec_id <> " + str(R.PROBE)
    sql = f"with x as (select vec_id, embedding::double[] e from embeddings), s0 as (select e s from x where vec_id = {R.PROBE})"
    for i in (1, 2):
        best = f"select vec_id from ({near.format(s=f's{i - 1}')}) order by round(score, 6) desc, vec_id limit {k}"
        sql += f""", d{i} as (select k, avg(v) m from (select unnest(e) v, generate_subscripts(e, 1) k from x where vec_id in ({best})) group by k),
        u{i} as (select k, 0.7::double * q.v + 0.3::double * m v from d{i} join (select unnest(s) v, generate_subscripts(s, 1) k from s0) q using (k)),
        s{i} as (select list(v / n order by k) s from u{i}, (select sqrt(sum(v * v)) n from u{i}))"""
    return sql + f" select vec_id, round(score, 5) score from ({near.format(s='s2')}) order by round(score, 6) desc, vec_id limit {k}"


@query(_resonance_sql(10))
def full_resonate(spark: SparkSession, sf_dir: str, probe: int = R.PROBE, k: int = 10) -> DataFrame:
    """The vectors nearest to a question that two passes moved towards the mean of what they found."""
    return vector.resonate(vectors(spark, sf_dir), probe, k, 2)


@query(ORACLE_SQL["hybrid_recall"])
def smart_recall(spark: SparkSession, sf_dir: str, question: str = R.QUESTION, probe: int = R.PROBE) -> DataFrame:
    """Keyword lane for what looks like code, all lanes for the rest."""
    if any(c in question for c in "()_/#.") or "::" in question or "->" in question:
        return R.keyword_bm25(spark, sf_dir, question)
    return hybrid_recall(spark, sf_dir, question, probe)


@query(R.top_sql(R.bm25_sql(R.QUESTION), 20))
def routed_recall(spark: SparkSession, sf_dir: str, route: str = "keyword", **asked: object) -> DataFrame:
    """A structured request, sent to its lane."""
    lanes = {"keyword": R.keyword_bm25, "hybrid": hybrid_recall, "lenses": structured_recall, "recall": R.recall}
    return lanes[route](spark, sf_dir, **asked)


@query(f"select memory_id, round(sum(1.0::double / (60 + rank)), 9) score from ({R._LANES} union all select memory_id, rank, 'time' from ({R.top_sql(_TIMED, 20)})) group by memory_id")
def recall_smart(spark: SparkSession, sf_dir: str, **asked: object) -> DataFrame:
    """Lanes of meaning, words and time fused; the planner is a rule."""
    spoken = table(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("memory_id")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("score"))
    spoken = lexical.top(spoken.join(memories(spark, sf_dir).select("memory_id"), "memory_id", "left_semi"), 20)
    return fusion.rrf({**R._lanes(spark, sf_dir, R.DEPTH, **asked), "time": spoken}).select("memory_id", "score")


@query(f"select 'memory ' || b.memory_id || ' (' || s.kind || ', ' || s.status || ')' as line, b.rank from ({_BEST}) b join {_SHELF} s using (memory_id) where b.rank <= 5")
def ask(spark: SparkSession, sf_dir: str, **asked: object) -> DataFrame:
    """An answer by template from the five best hits."""
    hits = _shelf(spark, sf_dir).join(F.broadcast(_best(spark, sf_dir, **asked).where("rank <= 5").select("memory_id", "rank")), "memory_id")
    return hits.select(F.format_string("memory %d (%s, %s)", "memory_id", "kind", "status").alias("line"), "rank")
