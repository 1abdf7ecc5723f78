"""Registered event-sequence, transcript, extraction and ledger queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.text import token_estimate
from recollect.operators.threads import THREAD_STOP, fingerprints, match
from recollect.operators import tape as ops
from recollect.plans.registry import query
from recollect.sources.tables import memories, table, tape, turns

_TAPE = "(select event_id, user_id session, event_type tool, (props->>'$.k')::int entity, (event_type = 'error')::int failed, ts, value cost from events)"
_W = "partition by session order by ts, event_id"


def _wilson_sql(s: str, n: str, z: float) -> str:
    return f"case when {n} = 0 then 0.0 else ({s}::double/{n} + {z * z}/(2*{n}) - {z}*sqrt({s}::double/{n}*(1-{s}::double/{n})/{n} + {z * z}/(4.0*{n}*{n})))/(1+{z * z}/{n}) end"


@query(f"select session, tool, event_id from (select *, row_number() over (partition by session, tool order by ts desc, event_id desc) r from {_TAPE}) where r <= 3")
def last_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three occurrences of every tool in each session."""
    w = Window.partitionBy("session", "tool").orderBy(F.desc("ts"), F.desc("event_id"))
    return tape(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("session", "tool", "event_id")


_BI = f"(select *, lag(tool) over ({_W}) before from {_TAPE})"


@query(f"select before, tool, n, round(ln(n * sum(n) over () / sum(n) over (partition by before) / sum(n) over (partition by tool)), 6) pmi from (select before, tool, count(*)::double n from {_BI} where before is not null group by all)".replace("select before, tool, n,", "select before, tool, n::bigint n,", 1))
def causal_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools that precede a tool, by pointwise mutual information."""
    return ops.pmi(tape(spark, sf_dir))


_C3 = f"(select *, row_number() over ({_W}) place, concat_ws('>', lag(tool, 3) over ({_W}), lag(tool, 2) over ({_W}), lag(tool) over ({_W})) context from {_TAPE})"


def _failing_sql(ratio: float) -> str:
    return f"select context, count(*) n, sum(failed)::bigint fails, round(sum(failed) / count(*)::double, 6) fail_ratio from {_C3} where place > 3 group by context having sum(failed) >= 3 and sum(failed) / count(*)::double > {ratio}"


def _failing(spark: SparkSession, sf_dir: str, ratio: float, least: int = 3) -> DataFrame:
    by = ops.contexts(tape(spark, sf_dir), 3).groupBy("context").agg(F.count("*").alias("n"), F.sum("failed").alias("fails"))
    return by.withColumn("fail_ratio", F.round(F.col("fails") / F.col("n"), 6)).where((F.col("fails") >= least) & (F.col("fails") / F.col("n") > ratio))


@query(_failing_sql(0.6))
def failure_pattern(spark: SparkSession, sf_dir: str, ratio: float = 0.6) -> DataFrame:
    """Contexts of three tools after which failures are frequent."""
    return _failing(spark, sf_dir, ratio)


@query(_failing_sql(0.22))
def failure_pattern_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at a lower bound, which a tape of chance reaches."""
    return _failing(spark, sf_dir, 0.22)


_C2 = f"(select *, row_number() over ({_W}) place, concat_ws('>', lag(tool, 2) over ({_W}), lag(tool) over ({_W})) context from {_TAPE})"


def _counterfactual_sql(n: int, support: int) -> str:
    context = ", ".join(f"lag(tool, {i}) over ({_W})" for i in range(n, 0, -1))
    by = f"select context, entity, count(*) n, sum(failed)::bigint fails from (select *, row_number() over ({_W}) place, concat_ws('>', {context}) context from {_TAPE}) where place > {n} group by all having count(*) >= {support}"
    best = f"select *, row_number() over (partition by context order by fails / n::double, {_wilson_sql('(n - fails)', 'n', 1.645)} desc, entity) r from ({by})"
    return f"with b as ({best}) select a.context, a.entity taken, c.entity alternative, round(a.fails / a.n::double - c.fails / c.n::double, 6) delta from b a join b c on a.context = c.context and c.r = 1 where a.fails / a.n::double > c.fails / c.n::double"


def _counterfactual(spark: SparkSession, sf_dir: str, n: int, support: int) -> DataFrame:
    return ops.best_sibling(ops.contexts(tape(spark, sf_dir), n), support)


@query(_counterfactual_sql(4, 5))
def counterfactual(spark: SparkSession, sf_dir: str, n: int = 4, support: int = 5) -> DataFrame:
    """For each context of four tools and entity, the sibling that fails least (ties by Wilson's bound, then by id)."""
    return _counterfactual(spark, sf_dir, n, support)


@query(_counterfactual_sql(2, 5))
def counterfactual_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after two tools, which a short tape repeats."""
    return _counterfactual(spark, sf_dir, 2, 5)


@query(f"select before, tool, count(*) support, round(avg(1 - 2 * failed), 6) avg_outcome, min(event_id) first_event, max(event_id) last_event from {_BI} where before is not null group by all having count(*) >= 5")
def bigram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool bigrams seen five times or more, their outcome and range on the tape."""
    by = ops.bigrams(tape(spark, sf_dir)).where("before is not null").groupBy("before", "tool")
    return by.agg(F.count("*").alias("support"), F.round(F.avg(1 - 2 * F.col("failed")), 6).alias("avg_outcome"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).where("support >= 5")


@query(f"select before, tool, round(n / sum(n) over (partition by before)::double, 6) p from (select before, tool, count(*) n from {_BI} where before is not null group by all)")
def markov_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of the next tool."""
    by = ops.bigrams(tape(spark, sf_dir)).where("before is not null").groupBy("before", "tool").agg(F.count("*").alias("n"))
    return by.select("before", "tool", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("before")), 6).alias("p"))


@query(f"select event_id, round(list_reduce(list_concat([0.0::double], list_reverse(list(case when failed = 1 then -0.2::double else 0.1::double end) over ({_W} rows between current row and 15 following))), lambda s, r: s * 0.9::double + r), 6) credit from {_TAPE}")
def td_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted rewards of every event over the 16 events from it on."""
    return ops.credit(tape(spark, sf_dir))


_OUT = f"(select *, case when tool = 'purchase' then 0 when tool = 'error' and entity % 2 = 0 then -9 when tool = 'error' then 1 end exit_code, tool = 'click' and cost > 95 flagged from {_TAPE} where tool in ('purchase', 'error', 'click'))"


@query(
    f"""with v as (select a.event_id, a.entity, count(b.event_id) filter (b.exit_code is not null) known, count(*) filter (b.exit_code <> 0) worst, coalesce(bool_or(b.flagged), false) flagged
    from (select * from {_TAPE} where tool = 'view') a left join {_OUT} b on a.session = b.session and b.ts >= a.ts and b.ts <= a.ts + interval 6 hour group by a.event_id, a.entity),
    c as (select entity item, count(*) injections, count(*) filter (known + flagged::int > 0 and worst = 0 and not flagged) successes, count(*) filter (worst > 0 or flagged) failures from v group by entity)
    select item, injections, successes, failures, round(greatest(0.0, {_wilson_sql('successes', '(successes + failures)', 1.96)}), 6) score from c"""
)
def outcome_credit(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """One verdict for each injection (view) of an item from the outcomes within some hours: purchases exit with 0, errors with 1 or by a signal, clicks without a code."""
    t = tape(spark, sf_dir)
    killed = F.when(F.col("entity") % 2 == 0, -9).otherwise(1)
    known = F.when(F.col("tool") == "purchase", 0).when(F.col("tool") == "error", killed)
    outcomes = t.where("tool in ('purchase', 'error', 'click')").select("session", "ts", known.alias("exit_code"), ((F.col("tool") == "click") & (F.col("cost") > 95)).alias("flagged"))
    return ops.outcomes(t.where("tool = 'view'").withColumn("item", F.col("entity")), outcomes, hours * 3600)


@query(f"select tool, round(2 + sum(1 - failed), 6)::double alpha, round(2 + sum(failed), 6)::double beta, round((2 + sum(1 - failed)) / (4.0 + count(*)), 6) mean from {_TAPE} group by tool")
def beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta posterior of each tool's success from a (2, 2) prior."""
    by = tape(spark, sf_dir).groupBy("tool").agg(F.sum(1 - F.col("failed")).alias("good"), F.sum("failed").alias("bad"), F.count("*").alias("n"))
    return by.select("tool", (2.0 + F.col("good")).alias("alpha"), (2.0 + F.col("bad")).alias("beta"), F.round((2 + F.col("good")) / (4.0 + F.col("n")), 6).alias("mean"))


@query(f"select event_id, round(case when failed = 1 then -1.0 else 1.0 end - 0.001 * cost - 0.00001 * entity, 6) utility from {_TAPE} where cost is not null and entity is not null")
def regret_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward of every event less its costs."""
    t = tape(spark, sf_dir).where("cost is not null and entity is not null")
    return t.select("event_id", F.round(F.when(F.col("failed") == 1, -1.0).otherwise(1.0) - 0.001 * F.col("cost") - 0.00001 * F.col("entity"), 6).alias("utility"))


@query(f"with c as (select context, count(*) n, avg(failed) f from {_C2} where place > 2 group by context), b as (select avg(failed) f from {_TAPE}) select context, n, round(b.f - c.f, 6) lift from c, b where n >= 20 and b.f - c.f > 0.15")
def policy_promotion(spark: SparkSession, sf_dir: str, lift: float = 0.15, least: int = 20) -> DataFrame:
    """Contexts with enough events that fail less than the tape on the whole."""
    t = tape(spark, sf_dir)
    base = t.agg(F.avg("failed").alias("base"))
    by = ops.contexts(t, 2).groupBy("context").agg(F.count("*").alias("n"), F.avg("failed").alias("f")).where(F.col("n") >= least)
    # One row.
    return by.join(F.broadcast(base)).where(F.col("base") - F.col("f") > lift).select("context", "n", F.round(F.col("base") - F.col("f"), 6).alias("lift"))


@query(f"select before, tool, round(avg(refuted), 6) ratio, case when avg(refuted) > 0.4 then 'refuted' when avg(refuted) < 0.2 then 'standing' else 'open' end state from (select before, tool, failed refuted from {_BI} where before is not null) group by all")
def refutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the rule that a tool leads to another's success, from the share of failures."""
    by = ops.bigrams(tape(spark, sf_dir)).where("before is not null").groupBy("before", "tool").agg(F.avg("failed").alias("r"))
    return by.select("before", "tool", F.round("r", 6).alias("ratio"), F.when(F.col("r") > 0.4, "refuted").when(F.col("r") < 0.2, "standing").otherwise("open").alias("state"))


@query(f"select event_id, round(-ln(n / sum_n::double), 6) surprisal from (select b.event_id, b.before, b.tool from {_BI} b where before is not null) join (select before, tool, n, sum(n) over (partition by before) sum_n from (select before, tool, count(*) n from {_BI} where before is not null group by all)) using (before, tool) where -ln(n / sum_n::double) > 2.0")
def surprisal_gate(spark: SparkSession, sf_dir: str, nats: float = 2.0) -> DataFrame:
    """Events whose tool is surprising after the one before."""
    b = ops.bigrams(tape(spark, sf_dir)).where("before is not null").select("event_id", "before", "tool")
    counts = b.groupBy("before", "tool").agg(F.count("*").alias("n"))
    p = counts.select("before", "tool", (-F.log(F.col("n") / F.sum("n").over(Window.partitionBy("before")))).alias("s"))
    # One row for each pair of tools; Spark broadcasts them where they are few.
    return b.join(p, ["before", "tool"]).where(F.col("s") > nats).select("event_id", F.round("s", 6).alias("surprisal"))


@query(f"select session, count(*) episodes, max(n) longest from (select session, episode, count(*) n from (select *, sum(new) over ({_W} rows unbounded preceding) episode from (select *, case when lag(ts) over ({_W}) is null or ts - lag(ts) over ({_W}) > interval 12 hour then 1 else 0 end new from {_TAPE})) group by all) group by session")
def pause_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of each session: stretches without a pause of more than twelve hours."""
    gap = ops.micros(F.col("ts")) - ops.micros(F.lag("ts").over(ops.order()))
    t = tape(spark, sf_dir).withColumn("new", F.when(gap.isNull() | (gap > 12 * 3600 * 1_000_000), 1).otherwise(0))
    t = t.withColumn("episode", F.sum("new").over(ops.order().rowsBetween(Window.unboundedPreceding, 0)))
    by = t.groupBy("session", "episode").agg(F.count("*").alias("n"))
    return by.groupBy("session").agg(F.count("*").alias("episodes"), F.max("n").alias("longest"))


@query(f"select session, md5(string_agg(tool, '>' order by ts, event_id)) fingerprint, count(*) n from {_TAPE} group by session")
def tool_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each session's sequence of tools."""
    tools = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "tool"))), lambda s: s["tool"])
    return tape(spark, sf_dir).groupBy("session").agg(F.md5(F.array_join(tools, ">")).alias("fingerprint"), F.count("*").alias("n"))


_RETRY = f"""with b as (select *, row_number() over ({_W}) place from {_TAPE}),
    a as (select *, place - lag(place) over (partition by session, entity order by place) gap, lag(tool) over (partition by session, entity order by place) last_ from b),
    i as (select *, sum(case when gap is null or gap > 8 or last_ = 'purchase' then 1 else 0 end) over (partition by session, entity order by place rows unbounded preceding) island from a)
    select session, entity, min(place) opened, count(*) filter (tool = 'error') fails, bool_or(tool = 'purchase') escaped, count(*) filter (tool = 'view') injections
    from i group by session, entity, island having count(*) filter (tool = 'error') >= {{least}}"""


@query(_RETRY.replace("{least}", "3"))
def saddle_episodes(spark: SparkSession, sf_dir: str, least: int = 3, reach: int = 8) -> DataFrame:
    """Retry loops: the same command (entity) failing again within eight events of the session, until it succeeds (purchase)."""
    return ops.retries(tape(spark, sf_dir), least, reach)


@query(_RETRY.replace("{least}", "1"))
def saddle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from one failure on, which a tape of chance has."""
    return ops.retries(tape(spark, sf_dir), 1, 8)


_TERMS = """(select session, turn, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{2,}')), lambda w: not list_contains([""" + ",".join(f"'{w}'" for w in THREAD_STOP) + """], w))) term from (select conv_id session, turn, text from conversations where role = 'user'))"""
_PRINT = f"(select session, term, df / sum(df) over (partition by session) * (ln((n + 1) / (df + 1)::double) + 1) weight from (select session, term, count(*)::double df from {_TERMS} group by all) join (select conv_id session, count(*) n from conversations where role = 'user' group by all) using (session))"


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(turns(spark, sf_dir).where("role = 'user'"))


@query(f"select session, term, round(weight, 6) weight from {_PRINT}")
def thread_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms of each session's user turns."""
    return _prints(spark, sf_dir).select("session", "term", F.round("weight", 6).alias("weight"))


@query(f"with p as (select * from {_PRINT}), l as (select session, sqrt(sum(weight * weight)) norm from p group by session), d as (select b.session, sum(a.weight * b.weight) dot from p a join p b using (term) where a.session = 0 and b.session <> 0 group by b.session) select d.session, round(dot / l.norm / q.norm, 6) score, case when dot / l.norm / q.norm >= 0.55 then 'strong' when dot / l.norm / q.norm >= 0.30 then 'weak' else 'none' end match from d join l using (session), (select norm from l where session = 0) q")
def thread_match(spark: SparkSession, sf_dir: str, session: int = 0) -> DataFrame:
    """How much each other thread is like one: sparse cosine of their fingerprints."""
    return match(_prints(spark, sf_dir), session)


@query("select conv_id session, count(*) n, sum(length(text))::bigint chars, count(*) filter (role = 'user') asked, max(turn) last_turn from conversations group by conv_id")
def read_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each session's transcript."""
    return turns(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"))


@query("select conv_id session, turn, role, left(text, 80) head from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def get_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two turns of each session."""
    w = Window.partitionBy("session").orderBy(F.desc("turn"))
    return turns(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 2").select("session", "turn", "role", F.substring("text", 1, 80).alias("head"))


@query("select conv_id session, turn from conversations where contains(lower(text), 'the ') and role <> 'system'")
def transcript_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold a phrase."""
    return turns(spark, sf_dir).where(F.lower("text").contains("the ") & (F.col("role") != "system")).select("session", "turn")


_SCORES = "(select conv_id session, turn, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.3::double)::bigint tokens, (case when role = 'user' then 1.1 else 1.0 end)::double * (0.25 * (0.2 + 0.8 * case when n > 1 then i / (n - 1)::double else 1 end) + 0.1) score from (select *, count(*) over (partition by conv_id) n, row_number() over (partition by conv_id order by turn) - 1 i from conversations))"


@query(f"select session, turn, tokens, round(score, 6) score, round(m, 6) threshold, score >= m kept from (select *, median(score) over (partition by session) m from {_SCORES})")
def trajectory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction scores of turns by role and recency, against their session's median."""
    w = Window.partitionBy("session")
    t = turns(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("turn")) - 1)
    place = F.when(F.col("n") > 1, F.col("i") / (F.col("n") - 1)).otherwise(1.0)
    score = F.when(F.col("role") == "user", 1.1).otherwise(1.0) * (0.25 * (0.2 + 0.8 * place) + 0.1)
    t = t.select("session", "turn", token_estimate(F.col("text")).alias("tokens"), score.alias("s"))
    t = t.join(t.groupBy("session").agg(F.percentile("s", 0.5).alias("m")), "session")
    return t.select("session", "turn", "tokens", F.round("s", 6).alias("score"), F.round("m", 6).alias("threshold"), (F.col("s") >= F.col("m")).alias("kept"))


_ATOMS = {"url": r"https?://[a-z0-9./_-]+", "hex": r"[0-9a-f]{12,40}", "email": r"[a-z0-9._]+@[a-z0-9.-]+[a-z]", "key": r"AKIA[A-Z0-9]{16}"}


@query(" union all ".join(f"select class, atom, count(*) n, count(distinct doc_id) memories from (select doc_id, '{c}' class, unnest(regexp_extract_all(text, '{p}')) atom from documents) group by all" for c, p in _ATOMS.items()))
def span_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim atoms (urls, hex strings, addresses, keys) and the memories that hold them."""
    found = F.concat(*(F.transform(F.regexp_extract_all("content", F.lit(p), F.lit(0)), _as(c)) for c, p in _ATOMS.items()))
    rows = memories(spark, sf_dir).select("memory_id", F.explode(found).alias("a"))
    return rows.groupBy(F.col("a.class").alias("class"), F.col("a.atom").alias("atom")).agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("memories"))


def _as(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("class"), x.alias("atom"))


@query("select conv_id session, md5(string_agg(role || ': ' || text, chr(10) order by turn)) pair_md5, count(*) turns from conversations where role in ('user', 'assistant') group by conv_id having count(*) >= 2")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions as training dialogues."""
    rows = turns(spark, sf_dir).where("role in ('user', 'assistant')").withColumn("line", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"])
    return rows.groupBy("session").agg(F.md5(F.array_join(lines, "\n")).alias("pair_md5"), F.count("*").alias("turns")).where("turns >= 2")


@query("select event_type status, date_trunc('day', ts)::date::varchar as day, count(*) n, round(avg(value), 6) mean from events group by all")
def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows of each status and day."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"select session, event_id, tool from (select *, row_number() over (partition by session order by ts desc, event_id desc) r from {_TAPE} where tool in ('signup', 'error') and event_id not in (select event_id from {_TAPE} where tool = 'error' and cost < 10)) where r <= 5")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest messages of each session that weren't acknowledged."""
    t = tape(spark, sf_dir)
    acked = t.where("tool = 'error' and cost < 10").select("event_id")
    w = Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.where("tool in ('signup', 'error')").join(acked, "event_id", "left_anti").withColumn("r", F.row_number().over(w)).where("r <= 5").select("session", "event_id", "tool")


@query(f"select session, max(ts)::varchar as heartbeat, case when max(ts) >= (select max(ts) from {_TAPE}) - interval 1 day then 'held' else 'expired' end lease from {_TAPE} group by session".replace("max(ts)::varchar", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def lease_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last heartbeat of each session and whether its lease of a day still holds."""
    t = tape(spark, sf_dir)
    by = t.groupBy("session").agg(F.max("ts").alias("last"))
    now = t.agg(F.max("ts").alias("now"))
    return by.join(F.broadcast(now)).select("session", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("heartbeat"), F.when(F.col("last") >= F.col("now") - F.expr("interval 1 day"), "held").otherwise("expired").alias("lease"))


@query("select floor(quality_p * 5)::int bin, count(*) n, round(avg(quality_p), 6) predicted, round(avg(quality), 6) observed from (select least(n_chars / 4000.0, 0.999)::double quality_p, quality from documents join labels using (doc_id)) group by bin")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against observed quality in five bins."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.withColumn("p", F.least(F.col("n_chars") / 4000.0, F.lit(0.999)))
    return rows.groupBy(F.floor(F.col("p") * 5).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("quality"), 6).alias("observed"))
