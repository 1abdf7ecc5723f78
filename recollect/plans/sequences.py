"""Registered queries of folds, motifs, lineage, likeness, binding, resampling, retry loops and lanes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators import binding, lineage, motifs, resample, saddles, similar
from recollect.operators.graph import settled, shared_folder
from recollect.operators.tape import micros, order
from recollect.plans.registry import query
from recollect.sources.tables import memories, table, tape, triplets, vectors
from recollect.streaming import folds, lanes, queue

_TAPE = "(select event_id, user_id session, event_type tool, (props->>'$.k')::int entity, epoch_us(ts) us, value cost from events where user_id is not null and ts is not null)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tape as a stream: session, us, seq, tool, cost, ts."""
    rows = queue.messages(spark, f"{sf_dir}/events.parquet").where("session is not null and ts is not null")
    return rows.withColumn("us", F.unix_micros("ts")).withColumn("seq", F.col("event_id"))


def _drained(stream: DataFrame) -> DataFrame:
    return folds.drain(stream, f"{shared_folder(stream.sparkSession)}/fold-{uuid.uuid4().hex}")


@query(
    f"""with b as (select *, case when lag(us) over w is null or us - lag(us) over w >= 43200000000 then 1 else 0 end fresh from {_TAPE} window w as (partition by session order by us, event_id)),
    g as (select *, sum(fresh) over (partition by session order by us, event_id) generation from b), m as (select max(us) // 1000 * 1000 seen from {_TAPE})
    select session, generation::bigint generation, min(us) acquired, max(us) as "last", max(us) + 43200000000 expired from g, m group by session, generation, seen having max(us) + 43200000000 <= seen"""
)
def lease_expiry(spark: SparkSession, sf_dir: str, hours: int = 12) -> DataFrame:
    """Leases of sessions that heartbeats no longer renewed, from a stream with timers."""
    return _drained(folds.folded(_stream(spark, sf_dir), folds.Lease(hours * 3600), "session"))


@query(f"select session, us, event_id seq, 2 + sum((tool <> 'error')::int) over w + 0.0::double alpha, 2 + sum((tool = 'error')::int) over w + 0.0::double beta from {_TAPE} window w as (partition by session order by us, event_id rows unbounded preceding)")
def posterior_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta posterior of each session's success after every event, from a stream."""
    rows = _stream(spark, sf_dir).withColumn("good", F.col("tool") != "error").withColumn("weight", F.lit(1.0))
    return _drained(folds.folded(rows, folds.Posterior(), "session"))


@query(
    f"""with s as (select session, us, event_id, tool z, lag(tool) over w x, row_number() over w rn from {_TAPE} window w as (partition by session order by us, event_id)),
    f as (select session, x, z y, min(rn) since from s where x is not null group by all),
    o as (select s.session, s.x, y, us, event_id, rn, (z = y)::int good from s join f on f.session = s.session and f.x = s.x and s.rn >= since),
    c as (select *, sum(good) over w support, sum(1 - good) over w contradict from o window w as (partition by session, x, y order by rn rows unbounded preceding)),
    k as (select *, case when contradict > 0.4 * (support + contradict) then 1 when contradict < 0.2 * (support + contradict) then 0 end mark from c),
    t as (select *, coalesce(last_value(mark ignore nulls) over (partition by session, x, y order by rn rows unbounded preceding), 0) status from k),
    p as (select *, lag(status, 1, 0) over (partition by session, x, y order by rn) before_ from t)
    select session, x antecedent, y consequent, us, event_id seq, status = 1 refuted, support::bigint support, contradict::bigint contradict from p where status <> before_"""
)
def refutation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time that a session's rule (after one tool comes another) is refuted or reinstated, from a stream."""
    return _drained(folds.folded(_stream(spark, sf_dir).withColumn("symbol", F.col("tool")), folds.Refutation(), "session"))


_DEPTH, _RATE = 5, 0.5
_GRAMS = f"""t as (select session, tool, us, event_id, case when tool = 'error' then -1.0 else 1.0 end r, row_number() over w place, lead(tool) over w after from {_TAPE} window w as (partition by session order by us, event_id)),
    h as (select session, place, r, after, list(tool) over (partition by session order by place rows between {_DEPTH - 1} preceding and current row) last_ from t),
    g as (select session, place, r, after, n, array_to_string(list_slice(last_, len(last_) - n + 1, len(last_)), '>') gram from h, range(1, {_DEPTH + 1}) k(n) where place >= n),
    c as (select gram, n, count(*) size from g group by gram, n having count(*) >= 2),
    longer as (select substr(gram, strpos(gram, '>') + 1) gram, n - 1 n, max(size) held from c where n > 1 group by 1, 2),
    s as (select c.* from c left join longer l using (gram, n) where held is null or held < size),
    o as (select gram, n, size, r, after, row_number() over (partition by gram order by session, place) i from g join s using (gram, n)),
    v as (select gram, n, size, sum(r * ({_RATE} / size) * pow(1 - {_RATE} / size, size - i)) q from o group by all),
    a as (select * from (select gram, after, count(*) support from o where after is not null group by all) qualify row_number() over (partition by gram order by support desc, after) = 1)"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tape(spark, sf_dir).where("session is not null and ts is not null")
    reward = F.when(F.col("tool") == "error", -1.0).otherwise(1.0)
    return t.select("session", F.row_number().over(order()).cast("long").alias("place"), F.col("tool").alias("symbol"), reward.alias("reward"))


@query(f"with {_GRAMS} select gram context, n::int n, size, round(q, 6) q, round((q + 1) / 2, 6) score, after, support from v left join a using (gram)")
def motif_states(spark: SparkSession, sf_dir: str, depth: int = _DEPTH, rate: float = _RATE) -> DataFrame:
    """The recurring contexts of the tape, and what outcome each leads one to expect."""
    return motifs.states(motifs.occurrences(_places(spark, sf_dir), depth), rate)


@query(f"with {_GRAMS} select gram context, n::int n, size, round((q + 1) / 2, 6) score, after, support from v left join a using (gram) where gram = 'view' or starts_with(gram, 'view>') order by round(q, 6) desc, n, gram limit 10")
def recall_motif_value(spark: SparkSession, sf_dir: str, prefix: str = "view", k: int = 10) -> DataFrame:
    """The states that a context leads to, best first, with the action that most often follows."""
    found = motifs.states(motifs.occurrences(_places(spark, sf_dir), _DEPTH), _RATE)
    reached = found.where((F.col("context") == prefix) | F.col("context").startswith(prefix + motifs.SEPARATOR))
    return reached.orderBy(F.desc("q"), "n", "context").limit(k).drop("q")


def _successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """older, newer: memories of the same text, each with the next one. Only ids and fingerprints are dealt out."""
    same = Window.partitionBy("print").orderBy("memory_id")
    rows = memories(spark, sf_dir).select("memory_id", F.md5(F.coalesce("content", F.lit(""))).alias("print"))
    return rows.select(F.col("memory_id").alias("older"), F.lead("memory_id").over(same).alias("newer")).where("newer is not null")


_LINKS = "(select * from (select doc_id older, lead(doc_id) over (partition by coalesce(text, '') order by doc_id) newer from documents) where newer is not null)"


@query(f"with recursive l as (select * from {_LINKS}), c(start, id, position) as (select min(older), min(older), 0 from l union all select start, newer, position + 1 from c join l on older = id) select start, id, position::int as position from c")
def what_superseded(spark: SparkSession, sf_dir: str, memory_id: int | None = None) -> DataFrame:
    """What superseded a memory (the first one that was), and what that, to the end."""
    links = settled(_successors(spark, sf_dir))
    start = links.agg(F.min("older").alias("id")) if memory_id is None else spark.range(1).select(F.lit(memory_id).cast("long").alias("id"))
    return lineage.chain(links, start)


@query(f"with m as (select doc_id id, max(doc_id) over w head, row_number() over (partition by coalesce(text, '') order by doc_id desc) - 1 steps from documents window w as (partition by coalesce(text, ''))) select id, head, steps from m where steps > 0")
def supersession_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every superseded memory what stands at the end of its chain."""
    return lineage.heads(_successors(spark, sf_dir))


_UP = "(select 'customer:' || c_custkey s, 'nation:' || c_nationkey o from customer union select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier union select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation)"


@query(f"with recursive u as (select * from {_UP}), a(node, ancestor, depth) as (select s, o, 1 from u union select node, o, depth + 1 from a join u on s = ancestor) select node, ancestor, min(depth)::int depth from a group by all")
def type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds above every node, with how far above."""
    return lineage.ancestors(triplets(spark, sf_dir))


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, and beside each fifth one a likeness with every eighth component half as large."""
    v = vectors(spark, sf_dir).select("vec_id", "embedding")
    twin = F.transform("embedding", lambda x, i: F.when(i % 8 == 0, x / 2).otherwise(x))
    return v.unionByName(v.where("vec_id % 5 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), twin.alias("embedding")))


_TWINS = "(select vec_id, embedding::double[] e from embeddings union all select vec_id + 1000000000, list_transform(embedding::double[], lambda x, i: case when (i - 1) % 8 = 0 then x / 2 else x end) from embeddings where vec_id % 5 = 0)"
_PAIRS = f"(select a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.e, b.e), 6) score from {_TWINS} a join {_TWINS} b on a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9)"


@query(f"select * from {_PAIRS}")
def near_twins(spark: SparkSession, sf_dir: str, threshold: float = 0.9) -> DataFrame:
    """Pairs of vectors and likenesses of a cosine at the threshold or above."""
    return similar.near_pairs(_twins(spark, sf_dir), threshold)


@query(f"with p as {_PAIRS}, e as (select a id, score, a, b from p union all select b, score, a, b from p), f as (select id, arg_min((a, b), (-score, a, b)) best from e group by id) select p.a, p.b, p.score from p join f x on x.id = p.a join f y on y.id = p.b where x.best = (p.a, p.b) and y.best = (p.a, p.b)")
def consolidate_first(spark: SparkSession, sf_dir: str, threshold: float = 0.9) -> DataFrame:
    """The pairs that greedy consolidation takes in its first round: each the best of both its ends."""
    return similar.consolidate(similar.near_pairs(_twins(spark, sf_dir), threshold)).where("round = 1").select("a", "b", "score")


@query()
def consolidate_similar(spark: SparkSession, sf_dir: str, threshold: float = 0.9) -> DataFrame:
    """Greedy consolidation of vectors and likenesses by descending cosine."""
    return similar.consolidate(similar.near_pairs(_twins(spark, sf_dir), threshold))


@query()
def recall_hdcbind(spark: SparkSession, sf_dir: str, known: str = "outcome", value: str = "fail", asked: str = "tool") -> DataFrame:
    """What fills a role, given another's filler, by hypervectors: tools that fail (roles: tool, entity, outcome)."""
    t = tape(spark, sf_dir).select("tool", F.col("entity").cast("string").alias("entity"), F.when(F.col("failed") == 1, "fail").otherwise("ok").alias("outcome"))
    return binding.recall(t, known, value, asked)


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str, resamples: int = 1000) -> DataFrame:
    """Mean cost of each tool with its bootstrap interval."""
    return resample.intervals(tape(spark, sf_dir), "tool", "event_id", "cost", resamples)


@query()
def fuzzy_retries(spark: SparkSession, sf_dir: str, least: int = 2, reach: int = 8, alike: float = 0.8) -> DataFrame:
    """Stretches of sessions in which a failing command is tried again in nearly the same words."""
    t = tape(spark, sf_dir).where("session is not null and ts is not null and entity is not null")
    target = F.element_at(F.array(*map(F.lit, ("parser", "parsers", "lexer", "docs"))), F.col("entity") % 4 + 1)
    command = F.concat(F.lit("make "), target, F.lit(" --id "), F.col("event_id").cast("string"))
    code = F.when(F.col("tool") == "error", 2).when(F.col("tool").isin("purchase", "signup"), 0)
    seq = F.row_number().over(order()).cast("long")
    events = t.select("session", seq.alias("seq"), command.alias("command"), code.alias("exit_code"), ((F.col("tool") == "click") & (F.col("cost") > 60)).alias("likely_fail"), F.when(F.col("tool") == "view", F.col("event_id")).alias("injected"))
    return saddles.saddles(events, least, reach, alike)


@query("select case when event_type in ('error', 'purchase') then 'fast' else 'slow' end lane, event_type tool, count(*) n from events where user_id is not null and ts is not null group by all")
def queue_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that each lane of the queue applied."""
    rows, urgent = queue.messages(spark, f"{sf_dir}/events.parquet"), F.col("tool").isin("error", "purchase")
    found = lanes.drain_lanes({"fast": rows.where(urgent), "slow": rows.where(~urgent)}, f"{shared_folder(spark)}/lanes-{uuid.uuid4().hex}", "session is not null and ts is not null")
    parts = [spark.read.parquet(path).select(F.lit(name).alias("lane"), "tool") for name, path in found.items()]
    return parts[0].unionByName(parts[1]).groupBy("lane", "tool").agg(F.count("*").alias("n"))


_TICKS = (43_200, 86_400, 129_600)  #: seconds after the first day's beginning at which the jobs are looked at
_BEGIN = 1_704_067_200_000_000


@query(
    f"""with w(job, since, until) as (values ('hygiene', 0, 43200), ('hygiene', 43200, 86400), ('hygiene', 86400, 129600), ('promotion', 0, 43200), ('promotion', 43200, 86400), ('promotion', 86400, 129600), ('staleness', 0, 43200), ('staleness', 43200, 129600))
    select job, since::bigint since, until::bigint until, count(ts) n from w left join events on epoch_us(ts) >= {_BEGIN} + since * 1000000::bigint and epoch_us(ts) < {_BEGIN} + until * 1000000::bigint group by all"""
)
def periodic_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run of three periodic jobs worked on in a day and a half, looked at every twelve hours."""
    at, done = micros(F.col("ts")), []
    events = table(spark, sf_dir, "events")

    def work(name: str):
        def run(since: int, until: int) -> None:
            part = events.where((at >= since) & (at < until)).agg(F.count("*").alias("n"))
            seconds = lambda us: F.lit((us - _BEGIN) // 1_000_000).cast("long")
            done.append(part.select(F.lit(name).alias("job"), seconds(since).alias("since"), seconds(until).alias("until"), "n"))

        return run

    jobs = lanes.Jobs(spark, f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}", _BEGIN)
    for tick in _TICKS:
        jobs.run([lanes.Job(n, lanes.PERIODS[n], work(n)) for n in ("hygiene", "promotion", "staleness")], _BEGIN + tick * 1_000_000)
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found
