"""Registered retrieval queries: text functions, keyword, vector and fused recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import dates
from recollect.functions import text as T
from recollect.operators import fusion, lexical, vector
from recollect.operators import lookup as lookups
from recollect.operators import recall as recalls
from recollect.plans import notes
from recollect.plans.registry import query
from recollect.sources.tables import memories, table, triplets, turns, vectors

QUESTION = "apache license version token"
PROBE = 0  #: vec_id of the probe vector
DEPTH = 40  #: rows of a lane

_STOP = ",".join(f"'{w}'" for w in T.LEX_STOP)
_LEX = f"""list_filter(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9_-]+'),
  flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9_-]+'), lambda t: regexp_split_to_array(t, '[-_]'))))),
  lambda t: length(t) >= 3 and not list_contains([{_STOP}], t))"""


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.index(memories(spark, sf_dir), table=table(spark, sf_dir, "documents"))


def bm25_sql(question: str) -> str:
    terms = ",".join(f"'{t}'" for t in sorted(set(T.python_words(question))))
    return f"""select doc_id memory_id, round(sum(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len/a))),6) score from (
      select doc_id, term, len(list_filter(w, lambda x: x = term)) tf, len(w) len from (select doc_id, regexp_extract_all(lower(text),'[a-z0-9]+') w from documents), (select unnest([{terms}]) term)) tf
      join (select term, count(*) df from (select unnest(list_distinct(regexp_extract_all(lower(text),'[a-z0-9]+'))) term from documents) group by term) using (term),
      (select count(*) n, avg(len(regexp_extract_all(lower(text),'[a-z0-9]+'))) a from documents) where tf > 0 group by doc_id"""


def knn_sql(probe: int = PROBE) -> str:
    return f"""select e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6) score from embeddings e, embeddings q where q.vec_id = {probe} and e.vec_id <> {probe}"""


def top_sql(scored: str, n: int, id_: str = "memory_id") -> str:
    return f"select *, row_number() over (order by score desc, {id_}) as rank from ({scored}) qualify rank <= {n}"


@query(f"select doc_id memory_id, len(t) n_tokens, md5(list_aggregate(list_sort(t), 'string_agg', ' ')) tokens_md5 from (select doc_id, {_LEX} t from documents) where len(t) > 0")
def tokens_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lexical tokens of every memory that has any."""
    # Out of an array of one: a filter on a plain column would be pushed below it and find the tokens a second time.
    rows = memories(spark, sf_dir).select("memory_id", F.explode(F.array(T.lex_tokens("content"))).alias("t")).where(F.size("t") > 0)
    return rows.select("memory_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.sort_array("t"), " ")).alias("tokens_md5"))


@query("select doc_id memory_id, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::double)::bigint tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of every memory."""
    return memories(spark, sf_dir).select("memory_id", T.token_estimate(F.col("content")).alias("tokens"))


@query("select conv_id session, turn, case " + " ".join(f"when regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in T.SPEECH_ACTS) + " else 'episode' end kind from conversations")
def speech_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech act of every turn."""
    return turns(spark, sf_dir).select("session", "turn", F.coalesce(T.speech_act(F.col("text")), F.lit("episode")).alias("kind"))


@query(
    "select kind, count(*) n from (select case "
    + " ".join("when " + " or ".join([f"contains(lower(text), '{p}')" for p in ps] + (["regexp_matches(lower(text), '" + T.MONTHS + "')"] if k == "as_of" else [])) + f" then '{k}'" for k, ps in T.TEMPORAL)
    + " else 'none' end kind from conversations) group by kind"
)
def intent_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each temporal subtype."""
    return turns(spark, sf_dir).groupBy(T.temporal_subtype(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("select conv_id session, turn, coalesce(nullif(list_aggregate(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')), lambda w: w <> '' and not list_contains([" + ",".join(f"'{w}'" for w in T.EXPAND_STOP) + "], w)), 'string_agg', ' '), ''), text) lex from conversations where role = 'user'")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical variant of every user turn taken as a query."""
    return turns(spark, sf_dir).where("role = 'user'").select("session", "turn", T.expand(F.col("text")).alias("lex"))


@query("select term, count(*) df, sum(tf)::bigint cf from (select doc_id, term, count(*) tf from (select doc_id, unnest(regexp_extract_all(lower(text),'[a-z0-9]+')) term from documents) group by all) group by term")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term."""
    return lexical.frequencies(_index(spark, sf_dir))


@query(top_sql(bm25_sql(QUESTION), 20))
def keyword_bm25(spark: SparkSession, sf_dir: str, question: str = QUESTION, limit: int = 20) -> DataFrame:
    """The best memories by BM25."""
    return lexical.top(lexical.bm25(_index(spark, sf_dir), question), limit)


@query(f"select doc_id memory_id, round(len(list_filter({_LEX}, lambda t: list_contains(['apache','license','token','version'], t))) / 4.0::double, 6) score from documents where len(list_filter({_LEX}, lambda t: list_contains(['apache','license','token','version'], t))) > 0")
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the question's tokens in every memory that has any."""
    return memories(spark, sf_dir).select("memory_id", F.round(lexical.term_overlap(F.col("content"), QUESTION), 6).alias("score")).where("score > 0")


@query(top_sql(knn_sql(), 20, "vec_id"))
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to the probe."""
    return lexical.top(vector.knn(vectors(spark, sf_dir), PROBE), 20, "vec_id")


_SPARSE = "list_sort(list_transform(list_slice(list_sort(list_transform(generate_series(1, len(embedding)), lambda i: {'m': -round(abs(embedding[i]::double), 9), 'i': i - 1})), 1, greatest(floor(len(embedding) * 0.05), 1)::int), lambda s: s.i))"


@query(f"with c as (select vec_id, {_SPARSE} code from embeddings) select c.vec_id, round(len(list_intersect(c.code, q.code)) / len(list_distinct(list_concat(c.code, q.code)))::double, 6) score from c, c q where q.vec_id = {PROBE} and c.vec_id <> {PROBE}")
def sparse_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of every vector's sparse code with the probe's."""
    codes = vectors(spark, sf_dir).select("vec_id", vector.sparse_code("embedding").alias("code"))
    probe = codes.where(F.col("vec_id") == PROBE).select(F.col("code").alias("q")).limit(1)
    return codes.where(F.col("vec_id") != PROBE).join(F.broadcast(probe)).select("vec_id", F.round(vector.overlap(F.col("code"), F.col("q")), 6).alias("score"))


@query("select vec_id, round((hi-lo)/254, 9) scale, round((hi+lo)/2, 9) middle, list_sum(list_transform(e, lambda x: greatest(-127, least(127, round((x-(hi+lo)/2)/((hi-lo)/254))))))::bigint code_sum from (select vec_id, embedding::double[] e, list_min(embedding::double[]) lo, list_max(embedding::double[]) hi from embeddings)")
def quantize_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, offset and checksum of every vector's int8 codes."""
    q = vectors(spark, sf_dir).select("vec_id", vector.quantised("embedding").alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.round("q.offset", 9).alias("middle"), F.aggregate("q.codes", F.lit(0).cast("long"), lambda s, x: s + x).alias("code_sum"))


_CENTROIDS = "select label, list(x order by i) c, max(n) n from (select label, i, avg(x) x, count(*) n from (select label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) i from embeddings) group by all) group by label"


@query(f"select label, n, round(list_cosine_similarity(c, q), 4) score from ({_CENTROIDS}), (select embedding::double[] q from embeddings where vec_id = {PROBE})")
def theme_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every class centroid to the probe."""
    v = vectors(spark, sf_dir)
    probe = v.where(F.col("vec_id") == PROBE).select(F.col("embedding").alias("q")).limit(1)
    return vector.centroids(v).join(F.broadcast(probe)).select("label", "n", F.round(vector.cosine("centroid", "q"), 4).alias("score"))


@query(f"select label, count(*) n, round(avg(score), 3) mean_score, max(score) best from (select vec_id, score, label from ({knn_sql()}) join (select vec_id, label from embeddings) using (vec_id)) group by label")
def behavioral_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and best similarity to the probe of each class."""
    v = vectors(spark, sf_dir)
    scored = vector.knn(v, PROBE, "label")
    return scored.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean_score"), F.max("score").alias("best"))


@query("select source realm, count(*) n, count(vec_id) embedded, round(count(vec_id) / count(*)::double, 6) coverage from documents left join embeddings on vec_id = doc_id group by source")
def embed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each realm's memories that have a vector."""
    rows = memories(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id"), F.col("memory_id") == F.col("vec_id"), "left")
    return rows.groupBy("realm").agg(F.count("*").alias("n"), F.count("vec_id").alias("embedded")).withColumn("coverage", F.round(F.col("embedded") / F.col("n"), 6))


def _lanes(spark: SparkSession, sf_dir: str, depth: int = DEPTH, question: str = QUESTION, probe: int = PROBE, found: lexical.Index | None = None) -> dict[str, DataFrame]:
    semantic = vector.knn(vectors(spark, sf_dir), probe).withColumnRenamed("vec_id", "memory_id")
    semantic = semantic.join(memories(spark, sf_dir).select("memory_id"), "memory_id", "left_semi")
    return {"keyword": lexical.top(lexical.bm25(found or _index(spark, sf_dir), question), depth), "semantic": lexical.top(semantic, depth)}


_SEMANTIC = f"select vec_id memory_id, score from ({knn_sql()}) where vec_id in (select doc_id from documents)"
_LANES = f"select memory_id, rank, 'keyword' lane from ({top_sql(bm25_sql(QUESTION), DEPTH)}) union all select memory_id, rank, 'semantic' lane from ({top_sql(_SEMANTIC, DEPTH)})"


def _rrf_sql(weights: str = "1.0") -> str:
    return f"select memory_id, round(sum({weights}::double / (60 + rank)), 9) score, count(*) lanes from ({_LANES}) group by memory_id"


@query(_rrf_sql())
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the keyword and the semantic lane."""
    return fusion.rrf(_lanes(spark, sf_dir))


@query(top_sql(_rrf_sql("(case lane when 'keyword' then 0.3 else 0.5 end)"), 20))
def weighted_rrf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup: fusion weighted for a question without a particular intent."""
    return lexical.top(fusion.rrf(_lanes(spark, sf_dir), {"semantic": 0.5, "keyword": 0.3}), 20)


@query(f"select memory_id, score, rank from ({top_sql(f'select memory_id, round(score / max(score) over () + 0.8 * overlap, 6) score from ({_rrf_sql()}) join (select doc_id memory_id, len(list_filter({_LEX}, lambda t: list_contains([' + repr('apache') + ',' + repr('license') + ',' + repr('token') + ',' + repr('version') + f'], t))) / 4.0::double overlap from documents) using (memory_id)', 10)})")
def recall_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship recall: lanes, reciprocal-rank fusion, term-overlap rescoring, the 10 best."""
    fused = fusion.normalised(fusion.rrf(_lanes(spark, sf_dir)).drop("lanes"))
    # Lanes leave at most two depths of rows: they are broadcast against the memories.
    rows = memories(spark, sf_dir).join(F.broadcast(fused), "memory_id")
    scored = rows.select("memory_id", F.round(F.col("score") + 0.8 * lexical.term_overlap(F.col("content"), QUESTION), 6).alias("score"))
    return lexical.top(scored, 10)


_TAGS = {"flagged": "toxic = 1", "good": "quality = 1"}

def _overlap_sql(question: str) -> str:
    terms = "[" + ",".join(f"'{t}'" for t in T.python_lex_tokens(question)) + "]"
    return f"len(list_filter({_LEX}, lambda t: list_contains({terms}, t))) / {float(len(T.python_lex_tokens(question)))}::double"


def recall_sql(question: str, probe: int, limit: int, tag: str | None, window: tuple[int, int] | None) -> str:
    asked = recalls.Asked(question, limit, window, tag)
    keyword = top_sql(bm25_sql(question), asked.depth)
    semantic = top_sql(f"select vec_id memory_id, score from ({knn_sql(probe)}) where vec_id in (select doc_id from documents)", asked.depth)
    seen = f"and created >= {window[0]} and created < {window[1]}" if window else ""
    tagged = f"select * from h0 where memory_id in (select doc_id from labels where {_TAGS[tag]}) union all select * from (select m.memory_id, content, realm, kind, status, access, 1.0::double score, 0.0::double boost from m join labels l on l.doc_id = m.memory_id where {_TAGS[tag]} and not starts_with(content, '[gap]') {seen} and not exists (select 1 from h0 where memory_id in (select doc_id from labels where {_TAGS[tag]})) order by m.memory_id limit {limit})" if tag else "select * from h0"

    def partners(anchors: str, most: int) -> str:
        return f"""(select * from (select o.memory_id anchor, p.memory_id, any_value(n) n, round(sum(ln(n / df::double)), 9) w from (select distinct a.* from atoms a where memory_id in ({anchors})) o
          join atoms p on p.class = o.class and p.atom = o.atom and p.memory_id <> o.memory_id join df on df.class = o.class and df.atom = o.atom, n group by o.memory_id, p.memory_id) qualify row_number() over (partition by anchor order by w desc, memory_id) <= {most})"""

    return f"""with fused as (select memory_id, round(sum(w / (60 + rank)), 9) score from (select memory_id, rank, 1.0::double w from ({keyword}) union all select memory_id, rank, 2.0 from ({semantic})) group by memory_id),
    atoms as (select distinct memory_id, class, atom from {notes.spans_sql(notes.DOCUMENTS)}), n as (select count(*) n from documents), df as (select class, atom, count(*) df from atoms group by class, atom),
    w as (select *, row_number() over (partition by anchor order by w desc, memory_id) place from {partners(f"select memory_id from fused order by score desc, memory_id limit {recalls.ANCHORS}", recalls.PARTNERS)}),
    partners as (select memory_id, sum(1 / (60.0::double + place)) added, max(least(1.0, w / ln(n + 1))) boost from w group by memory_id),
    both_ as (select coalesce(f.memory_id, p.memory_id) memory_id, round(coalesce(score, 0) + coalesce(added, 0), 9) score, coalesce(boost, 0) boost from fused f full join partners p on f.memory_id = p.memory_id),
    created as (select (props->>'$.k')::bigint memory_id, min(epoch_us(ts)) created from events group by all),
    last_ as (select md5(text) h, max(doc_id) newest from documents group by all),
    m as (select d.doc_id memory_id, text content, source realm, lang kind, e.label access, created, case when newest <> d.doc_id then 'superseded' when l.quality = 0 then 'archived' else 'active' end status from documents d join last_ on h = md5(text) left join labels l on l.doc_id = d.doc_id left join embeddings e on e.vec_id = d.doc_id left join created c on c.memory_id = d.doc_id where length(text) > 0),
    pool as (select m.*, score, boost from both_ join m on m.memory_id = both_.memory_id where true {seen} order by score desc, m.memory_id desc limit {asked.depth}),
    h0 as (select memory_id, content, realm, kind, status, access, score / (select max(score) from pool) score, boost from pool where not starts_with(content, '[gap]')),
    h as ({tagged}),
    s as (select h.* exclude (score), {_overlap_sql(question).replace('lower(text)', 'lower(content)')} overlap, case when n >= 5 then score * (1 - 0.25 * least(1.0, coalesce(access, 0) / 10.0)) * (1 + least(0.3, sqrt(ln(n + 1) / (coalesce(access, 0) + 1)))) else score end d, count(*) over () hits from h, n),
    r as (select *, round(case when hits > 1 then d + 0.8 * overlap + 0.4 * boost else d end, 6) fin from s),
    k as (select *, row_number() over (order by fin desc, memory_id) place, max(fin) over () most from r),
    near as (select distinct memory_id from {partners(f"select memory_id from k where place <= {recalls.HEAD}", recalls.NEIGHBOURS)}),
    kk as (select *, row_number() over (order by place) taken from k where hits <= {max(limit, asked.budget)} or place <= {limit} or overlap > 0 or memory_id in (select memory_id from near) or (fin >= most / 2 and (realm, kind) in (select (realm, kind) from k where place <= 5)))
    select memory_id, fin score, row_number() over (order by fin desc, status = 'archived', place) as rank from kk where (taken <= {max(asked.budget, limit)} or hits <= {max(limit, asked.budget)}) and status <> 'superseded' qualify rank <= {limit}"""


def _store(spark: SparkSession, sf_dir: str, found: lexical.Index) -> recalls.Store:
    """Memories, and what is known of few of them: their status, how often they were recalled, and when they were first spoken of."""
    atoms = notes.atom_index(spark, sf_dir)

    def describe(rows: DataFrame) -> DataFrame:
        ids = F.broadcast(rows.select("memory_id"))
        prints = F.broadcast(rows.select(F.unhex(F.md5("content")).alias("print")).distinct())
        newest = found.prints.join(prints, "print").groupBy("print").agg(F.max("memory_id").alias("newest"))
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("memory_id"), "quality").join(ids, "memory_id")
        access = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").alias("access")).join(ids, "memory_id")
        events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("memory_id"), "ts").join(ids, "memory_id")
        created = events.groupBy("memory_id").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("created"))
        told = rows.withColumn("print", F.unhex(F.md5("content"))).join(newest, "print").join(labels, "memory_id", "left").join(access, "memory_id", "left").join(created, "memory_id", "left")
        status = F.when(F.col("newest") != F.col("memory_id"), "superseded").when(F.col("quality") == 0, "archived").otherwise("active")
        return told.select(*rows.columns, status.alias("status"), "access", "created")

    n = found.stats.select("n")
    return recalls.Store(memories(spark, sf_dir), describe, lambda anchors, most: atoms.partners(anchors, n, most, "documents"), n)


def _recall(
    spark: SparkSession, sf_dir: str, question: str = QUESTION, probe: int = PROBE, limit: int = 10, tag: str | None = None, window: tuple[int, int] | None = None,
    realm: str | None = None, strategy: str | None = None, now: int | None = None, graph: bool = False, separate: bool = False,
) -> DataFrame:
    if now is not None and window is None:
        # A question that mentions a date asks for that time; one that doesn't, for all.
        meant = dates.resolve(dates.mention(F.lit(question)), F.lit(now))
        window = (F.coalesce(meant["start"], F.lit(-(1 << 62))), F.coalesce(meant["until"], F.lit(1 << 62)))
    asked = recalls.Asked(question, limit, window, tag, realm, graph=graph, separate=separate)
    found = _index(spark, sf_dir)
    lanes = _lanes(spark, sf_dir, asked.depth, question, probe, found)
    # The question as it is counts twice.
    parts = [(lanes["semantic"], 2.0), (lanes["keyword"], 1.0)] if recalls.multi_lane(question) else [(lanes["semantic"], 1.0)]
    parts = [(lanes["keyword"], 1.0)] if strategy == "keyword" else parts
    tagged = None if tag is None else table(spark, sf_dir, "labels").where(_TAGS[tag]).select(F.col("doc_id").alias("memory_id")).distinct()
    sure = lanes["semantic"].select("memory_id", F.col("score").alias("cosine")) if graph else None
    return recalls.recall(asked, _store(spark, sf_dir, found), parts, tagged, sure)


WINDOW = 1704067200000000, 1705276800000000  #: 1 to 15 January 2024


@query(recall_sql(QUESTION, PROBE, 10, None, None))
def recall(spark: SparkSession, sf_dir: str, **params: object) -> DataFrame:
    """The whole recall of a question (parameters: question, probe, limit, tag, window, realm, strategy, now, graph, separate)."""
    return _recall(spark, sf_dir, **params)


@query(recall_sql(QUESTION, PROBE, 10, "good", None))
def recall_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall among the memories that carry a tag."""
    return _recall(spark, sf_dir, tag="good")


@query(recall_sql("Zzyzx-unheard of", PROBE, 5, "flagged", (0, 1)))
def recall_window_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall within a window that no hit lies in."""
    return _recall(spark, sf_dir, question="Zzyzx-unheard of", limit=5, tag="flagged", window=(0, 1))


@query(recall_sql(QUESTION, PROBE, 10, None, WINDOW))
def recall_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall among memories of a time window."""
    return _recall(spark, sf_dir, window=WINDOW)


_WHEN, _NOW = "apache license token, last 10 days", 1705276800000000


@query(recall_sql(_WHEN, PROBE, 10, None, (_NOW - 10 * dates.DAY, _NOW)))
def recall_when(spark: SparkSession, sf_dir: str, question: str = _WHEN, now: int = _NOW) -> DataFrame:
    """Recall among memories of the time that the question mentions."""
    return _recall(spark, sf_dir, question=question, now=now)


@query()
def recall_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with the memories that the graph of shared atoms reaches."""
    return _recall(spark, sf_dir, graph=True)


@query()
def recall_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall with likenesses among the hits held against them."""
    return _recall(spark, sf_dir, separate=True)


_ACCESS = "(select vec_id memory_id, label access from embeddings)"


@query(f"select memory_id, round(score * (1 - 0.25 * least(1.0, access / 10.0)) * (1 + least(0.3, sqrt(ln(n + 1) / (access + 1)))), 6) score from ({_rrf_sql()}) join {_ACCESS} using (memory_id), (select count(*) n from documents)")
def drift_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores weighed by how often a memory was recalled."""
    rows = _with_access(spark, sf_dir)
    return rows.select("memory_id", F.round(fusion.drifted(F.col("score"), F.col("access"), F.col("n")), 6).alias("score"))


@query(f"select memory_id, round(score + 1.414 * sqrt(ln(n + 1) / (access + 1)), 6) score from ({_rrf_sql()}) join {_ACCESS} using (memory_id), (select count(*) n from documents)")
def ucb1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores with an exploration bonus."""
    rows = _with_access(spark, sf_dir)
    return rows.select("memory_id", F.round(fusion.ucb1(F.col("score"), F.col("access"), F.col("n")), 6).alias("score"))


def _with_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    access = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("label").alias("access"))
    n = memories(spark, sf_dir).agg(F.count("*").alias("n"))
    return access.join(F.broadcast(fusion.rrf(_lanes(spark, sf_dir))), "memory_id").join(F.broadcast(n))


@query(f"with r as ({top_sql(bm25_sql(QUESTION), DEPTH)}), x as (select r.*, d.source realm, d.lang kind, len(list_filter({_LEX}, lambda t: list_contains(['apache','license','token','version'], t))) >= 2 lexical from r join documents d on d.doc_id = memory_id), h as (select distinct realm, kind from x where rank <= 5) select memory_id, rank, row_number() over (order by rank) place from x where rank <= 10 or lexical or (score >= (select max(score) from x) / 2 and (realm, kind) in (select (realm, kind) from h)) qualify place <= 24")
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits worth rescoring."""
    mem = memories(spark, sf_dir)
    ranked = mem.join(F.broadcast(lexical.top(lexical.bm25(_index(spark, sf_dir), QUESTION), DEPTH)), "memory_id")
    ranked = ranked.withColumn("lexical", lexical.term_overlap(F.col("content"), QUESTION) >= 0.5).select("memory_id", "rank", "score", "realm", "kind", "lexical", F.lit(False).alias("near"))
    return fusion.prefilter(ranked, 10, 24).select("memory_id", "rank", "place")


@query(f"select source realm, round(1 - exp(sum(ln(1 - least(score / 10, 0.99)))), 6) score, count(*) evidence, max(score) best from ({bm25_sql(QUESTION)}) join documents on doc_id = memory_id group by source")
def session_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each realm's memories combined by noisy-or."""
    mem = memories(spark, sf_dir)
    hits = lexical.bm25(_index(spark, sf_dir), QUESTION).join(mem.select("memory_id", "realm"), "memory_id")
    p = F.least(F.col("score") / 10, F.lit(0.99))
    return hits.groupBy("realm").agg(F.round(1 - F.exp(F.sum(F.log(1 - p))), 6).alias("score"), F.count("*").alias("evidence"), F.max("score").alias("best"))


_FIVE = {"who": "apache", "what": "license", "when": "version", "where": "token", "why": "token license"}


@query("select memory_id, max(score) score, string_agg(dim, ',' order by dim) dims from (" + " union all ".join(f"select memory_id, score, '{d}' dim from ({top_sql(bm25_sql(q), 20)})" for d, q in _FIVE.items()) + ") group by memory_id")
def five_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score over the who, what, when, where and why searches, and which of them hit."""
    hits = lexical.bm25_all(_index(spark, sf_dir), _FIVE).withColumnRenamed("query", "dim")
    best = Window.partitionBy("dim").orderBy(F.desc("score"), "memory_id")
    rows = hits.withColumn("place", F.row_number().over(best)).where("place <= 20")
    return rows.groupBy("memory_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_list("dim")), ",").alias("dims"))


@query()
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most relevant and different of the keyword lane's hits."""
    mem = memories(spark, sf_dir)
    hits = mem.join(F.broadcast(lexical.top(lexical.bm25(_index(spark, sf_dir), QUESTION), DEPTH)), "memory_id")
    return fusion.diversify(hits.select(F.lit(QUESTION).alias("query"), "memory_id", "score", T.lex_tokens("content").alias("tokens")), 10).select("memory_id", "place")


@query(f"select memory_id, score, spent from (select memory_id, score, sum(tokens) over (order by score desc, memory_id rows unbounded preceding)::bigint spent from ({top_sql(bm25_sql(QUESTION), DEPTH)}) join (select doc_id memory_id, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::double)::bigint tokens from documents) using (memory_id)) where spent <= 4000")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword hits, best first, while their tokens fit a budget."""
    mem = memories(spark, sf_dir)
    hits = mem.join(F.broadcast(lexical.top(lexical.bm25(_index(spark, sf_dir), QUESTION), DEPTH)), "memory_id").select("memory_id", "score", T.token_estimate(F.col("content")).alias("tokens"))
    # A window over one lane's rows.
    w = Window.orderBy(F.desc("score"), "memory_id").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("spent", F.sum("tokens").over(w)).where("spent <= 4000").select("memory_id", "score", "spent")


@query("select label, count(*) n, round(-sum(p * log2(p)), 6) entropy from (select label, score / sum(score) over (partition by label) p from (select label, score from (" + knn_sql() + ") join (select vec_id, label from embeddings) using (vec_id) where score > 0)) group by label")
def score_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the similarity scores in each class."""
    v = vectors(spark, sf_dir)
    scored = vector.knn(v, PROBE, "label").where("score > 0")
    p = scored.withColumn("p", F.col("score") / F.sum("score").over(Window.partitionBy("label")))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


_ASKED = "nation3 license"
_TERMS = ["nation3", "license"]  # of 4 letters or digits at least, three at most, up to the first shorter one
_TRIPLETS = (
    "(select 'customer:' || c_custkey s, 'in_nation' p, 'nation:' || c_nationkey o from customer union all select 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey from supplier "
    "union all select 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey from nation)"
)


def _lookup_sql(question: str, terms: list[str], limit: int) -> str:
    weights = ",".join(f"('{i}','{b}',{w}::double)" for i, ws in lookups.WEIGHTS.items() for b, w in zip(lookups.BACKENDS, ws, strict=True))
    return f"""with w(intent, backend, weight) as (values {weights}), d as (select doc_id, text, 'memory:' || doc_id id from documents), named as (select * from (values {",".join(f"({i}, '{t}')" for i, t in enumerate(terms))}) n(place, term)),
    kw as (select id, rank, text from ({top_sql(bm25_sql(question), limit)}) join d on doc_id = memory_id), sem as (select id, rank, text from ({top_sql(_SEMANTIC, limit)}) join d on doc_id = memory_id),
    tri as (select s id, row_number() over (order by place, s, p, o) as rank, s || ' ' || p || ' ' || o as text from {_TRIPLETS} join named on regexp_replace(s, '[^A-Za-z0-9]', '', 'g') = term qualify rank <= {limit}),
    seen as (select (props->>'$.k')::bigint k, min(epoch_us(ts)) us from events where ts is not null group by 1), ends as (select max(us) us from (select epoch_us(ts) us from events where ts is not null)),
    tmp as (select id, row_number() over (order by seen.us desc, doc_id) as rank, text from seen join d on doc_id = k, ends where seen.us >= ends.us - 2592000000000 and seen.us < ends.us qualify rank <= {limit}),
    sym as (select 'sym:' || p_partkey id, row_number() over (order by p_partkey) as rank, p_type || ' ' || p_name || ' @ ' || p_brand as text from part where {" or ".join(f"contains(lower(p_name), '{t}')" for t in T.python_words(question))} qualify rank <= {limit}),
    r as (select 'keyword' backend, * from kw union all select 'semantic', * from sem union all select 'triplet', * from tri union all select 'temporal', * from tmp union all select 'code', * from sym),
    sure as (select coalesce(max({_overlap_sql(question)}), 0) s from kw where rank = 1),
    b as (select intent, id, sum(weight / (60 + rank)) s, count(distinct backend) backends, bool_or(contains(lower(text), '{question}')) whole from r join w using (backend), sure where weight > 0 and (backend <> 'temporal' or intent = 'temporal') and (backend = 'keyword' or sure.s < 0.9) group by intent, id),
    f as (select intent, id, round(s + case when backends >= 2 then 0.1::double else 0 end + case when whole then 0.15::double else 0 end, 9) score, backends from b)
    select intent, id, score, row_number() over (partition by intent order by score desc, id) as rank, backends, max(score) over (partition by intent) < 0.55 as escalate from f qualify rank <= {limit}"""


@query(_lookup_sql(_ASKED, _TERMS, 20))
def lookup(spark: SparkSession, sf_dir: str, question: str = _ASKED, probe: int = PROBE, limit: int = 20, intents: tuple[str, ...] = tuple(lookups.WEIGHTS)) -> DataFrame:
    """The best of five backends for a question, for each intent that it may have."""
    found = _index(spark, sf_dir)
    mem = memories(spark, sf_dir).select("memory_id", F.concat(F.lit("memory:"), F.col("memory_id").cast("string")).alias("id"), F.col("content").alias("text"))
    with_text = lambda lane: mem.join(F.broadcast(lane.select("memory_id", "rank")), "memory_id")
    lanes = {k: with_text(v) for k, v in _lanes(spark, sf_dir, limit, question, probe, found).items()}
    lanes["keyword"] = lanes["keyword"].withColumn("sure", lexical.term_overlap(F.col("text"), question))
    terms: list[str] = []
    for word in question.split():
        plain = "".join(c for c in word if c.isascii() and c.isalnum()).lower()
        if len(plain) < 3 or plain in T.TERM_STOP:
            continue
        if len(plain) < 4 or len(terms) == 3:
            break
        terms.append(plain)
    named = spark.createDataFrame(list(enumerate(terms)) or [(0, "")], "place int, term string")
    facts = triplets(spark, sf_dir).join(F.broadcast(named), F.regexp_replace("subject", "[^A-Za-z0-9]", "") == F.col("term"))
    best = facts.orderBy("place", "subject", "predicate", "object").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("place", "subject", "predicate", "object")))
    lanes["triplet"] = best.select(F.col("subject").alias("id"), "rank", F.concat_ws(" ", "subject", "predicate", "object").alias("text"))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").where("ts is not null").select(F.get_json_object("props", "$.k").cast("long").alias("memory_id"), at.alias("us"))
    ends = events.agg(F.max("us").alias("end"))
    recent = events.groupBy("memory_id").agg(F.min("us").alias("us")).join(F.broadcast(ends)).where((F.col("us") >= F.col("end") - 30 * dates.DAY) & (F.col("us") < F.col("end")))
    recent = recent.join(mem.select("memory_id"), "memory_id", "left_semi").orderBy(F.desc("us"), "memory_id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("us"), "memory_id")))
    lanes["temporal"] = with_text(recent)
    named_so = F.lit(False)
    for w in T.python_words(question):
        named_so = named_so | F.lower("p_name").contains(w)
    parts = table(spark, sf_dir, "part").where(named_so).orderBy("p_partkey").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("p_partkey")))
    lanes["code"] = parts.select(F.concat(F.lit("sym:"), F.col("p_partkey").cast("string")).alias("id"), "rank", F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" @ "), F.col("p_brand")).alias("text"))
    return lookups.lookup(lanes, question, limit, intents)
