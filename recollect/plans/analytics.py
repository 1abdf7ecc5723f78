"""Registered queries of scoring, intents, dates, event motifs and evaluation, each one text for Spark and the checking SQL."""

from __future__ import annotations

from recollect.plans.logical import sql

DAY_US = 86_400_000_000

# Words that tell the intent of a question, in the order in which intents are looked for.
META = "how many|count|stats|statistics|health|memory health|status|memory status|total memories|memory count".split("|")
CODE = "find function|find class|find symbol|where is|definition of|defined|callers of|callees of|who calls|what calls|implementations of|usages of|references to".split("|")
RELATION = r"how\s+does?\s+.+?\s+relate\s+to\s+.+|what\s+connects?\s+.+?\s+(and|to|with)\s+.+|relation(ship)?\s+between\s+.+?\s+(and|to|with)\s+.+|.+?\s+to\s+.+?\s+connection|link\s+between\s+.+?\s+(and|to|with)\s+.+"
ASPECTS = {"preferences": "likes", "corrections": "corrections|correction|mistakes|mistake|wrong|errors", "insights": "insights|insight|learned|patterns|pattern", "failures": "failures|failure|didn't work|didnt work|failed", "decisions": "decisions|decision|decided|chose|choice"}
TIMES = r"last\s+\d+\s+(day|week|month|year)s?|\d+\s+(day|week|month|year)s?\s+ago|yesterday|today|this\s+(morning|afternoon|evening|week|month|year)|last\s+(week|month|year)|january|february|march|april|may|june|july|august|september|october|november|december|[0-9][0-9][0-9][0-9]|since\s+.+|before\s+.+|after\s+.+|from\s+.+?\s+to\s+.+"
EXPLORE = "browse|explore|show me|list|recent|latest|all|everything".split("|")


def _any(words: list[str], column: str = "q") -> str:
    quoted = (w.replace("'", "''") for w in words)
    return "(" + " or ".join(f"{column} like '%{w}%'" for w in quoted) + ")"


def _regex(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def both(spark_text: str, other: str, name: str, about: str, **defaults: object) -> None:
    """Register a query whose two texts differ in a function's name or an escape."""
    from recollect.plans.registry import ORACLE_SQL

    sql(name, about, other, **defaults)
    checked = ORACLE_SQL[name]
    sql(name, about, spark_text, **defaults)
    ORACLE_SQL[name] = checked


# A backslash in a string is doubled for Spark only.
_INTENT = (
    "select session, turn, case when {meta} then 'meta' when {code} then 'code' when {match}(q, {relation}) then 'relationship' when {aspect} then 'aspect' when {match}(q, {times}) then 'temporal' when {explore} then 'exploratory' else 'entity' end as intent, "
    "case when {meta} then 0.9 when {code} or {match}(q, {relation}) then 0.85 when {aspect} then 0.8 when {match}(q, {times}) then 0.85 when {explore} then 0.7 else 0.6 end as confidence from (select session, turn, lower(text) as q from {{turns}} where role = 'user') t"
)
_PARTS = {"meta": _any(META), "code": _any(CODE), "aspect": _any([w for x in ASPECTS.values() for w in x.split("|")]), "explore": _any(EXPLORE)}
both(
    _INTENT.format(match="regexp_like", relation=_regex(RELATION), times=_regex(TIMES), **_PARTS),
    _INTENT.format(match="regexp_matches", relation="'" + RELATION + "'", times="'" + TIMES + "'", **_PARTS),
    "intent_classify",
    "Intent of every user turn, the first of seven that fits, with its confidence.",
)
_CODE_LIKE = "select session, turn from (select session, turn, trim(text) as q from {turns}) t where length(q) > 0 and not (lower(q) like 'how %' or lower(q) like 'why %' or lower(q) like 'what %' or lower(q) like 'where %' or lower(q) like 'explain %' or lower(q) like 'describe %' or lower(q) like 'find %' or lower(q) like 'show %') and (q like '%::%' or q like '%->%' or q like '%(%' or q like '%)%' or contains(q, '_') or q like '%/%' or q like '%#%' or q like '%.%')"
sql("looks_like_code", "Turns that look like a question about code.", _CODE_LIKE)
sql("route_select", "Route of every user turn: code-looking ones by keyword, others by the words they hold.", "select session, turn, case when q like '%(%' or q like '%::%' or contains(q, '_') then 'keyword' when q like '%yesterday%' or q like '%last week%' then 'temporal' when q like '%file%' then 'artifact' when length(q) > 200 then 'full' when length(q) > 60 then 'hybrid' else 'semantic' end as route from (select session, turn, lower(text) as q from {turns} where role = 'user') t")
sql("expand_query_forms", "The notations of every user turn taken as a query: as it is, and as a memory about it.", "select session, turn, text as vec, '[memory about] ' || text as hyde from {turns} where role = 'user'")
sql("utf8_truncated", "Heads of memories that never split a character.", "select memory_id, substring(content, 1, :n) as head, length(substring(content, 1, :n)) as n_chars from {memories}", n=40)
sql("content_hash", "Hash of every memory's content and whether a copy has it too.", "select memory_id, md5(content) as h, count(*) over (partition by md5(content)) > 1 as copied from {memories}")

# Events: motifs, binding, refutation, posteriors over sessions.
_SEQ = "(select session, event_id, us, tool, entity, failed, cost, lag(tool) over (partition by session order by us, event_id) as before, lag(tool, 2) over (partition by session order by us, event_id) as before2, lead(failed) over (partition by session order by us, event_id) as f1, lead(failed, 2) over (partition by session order by us, event_id) as f2, lead(failed, 3) over (partition by session order by us, event_id) as f3 from {tape})"
sql("motif_q", "Value of motifs of three tools: discounted rewards of the next three events, as (q + 1) / 2.", f"select before2 || '>' || before || '>' || tool as motif, count(*) as n, round((avg((1 - 2 * f1 + 0.9 * (1 - 2 * f2) + 0.81 * (1 - 2 * f3)) / 2.71) + 1) / 2, 6) as score from {_SEQ} s where before2 is not null and f3 is not null group by before2 || '>' || before || '>' || tool")
sql("hdc_binding", "Pairs of role fillers (tool, entity) bound together: joint counts against those of each alone.", "select tool, entity, count(*) as n, round(count(*) / cast(t.n as double) - (x.n / cast(t.n as double)) * (y.n / cast(t.n as double)), 9) as binding from {tape} b join (select tool as tool_x, count(*) as n from {tape} group by tool) x on x.tool_x = b.tool join (select entity as entity_y, count(*) as n from {tape} group by entity) y on y.entity_y = b.entity cross join (select count(*) as n from {tape}) t group by tool, entity, t.n, x.n, y.n")
sql("refutation_fold", "Rules by session day: share of failures so far (cumulative), refuted above 0.4, reinstated below 0.2.", f"select before, tool, day, round(bad / cast(n as double), 6) as ratio, case when bad / cast(n as double) > 0.4 then 'refuted' when bad / cast(n as double) < 0.2 then 'standing' else 'open' end as state from (select before, tool, day, sum(bad) over (partition by before, tool order by day rows between unbounded preceding and current row) as bad, sum(n) over (partition by before, tool order by day rows between unbounded preceding and current row) as n from (select before, tool, cast(floor(us / {DAY_US}) as bigint) as day, sum(failed) as bad, count(*) as n from {_SEQ} s where before is not null group by before, tool, cast(floor(us / {DAY_US}) as bigint)) d) c")
sql("unknown_aware_failures", "Events with an unknown outcome count as failed only where the amount flags them.", "select event_id, case when tool in ('purchase', 'error') then failed when cost > 95 then 1 else 0 end as failed from {tape}")
sql("tool_graph_degree", "Distinct tools and entities that each session joins.", "select session, count(distinct tool) as tools, count(distinct entity) as entities from {tape} group by session")

# Scoring and evaluation.
sql("kind_priors", "Confidence of every memory weighed by its kind's prior.", "select m.memory_id, round(least(1.0, m.confidence * coalesce(p.prior, 1.0)), 6) as score from {shelf} m left join (values ('en', 1.3), ('fr', 1.1), ('de', 1.05), ('es', 0.8)) as p(kind, prior) on p.kind = m.kind")
sql("two_band_confidence", "Memories known (0.81 or more) or unknown, the three surest of each realm ignited.", "select memory_id, case when confidence >= 0.81 then 'KNOWN' else 'UNKNOWN' end as band, place <= 3 as ignited from (select memory_id, confidence, row_number() over (partition by realm order by confidence desc, memory_id) as place from {shelf}) s")
sql("softmax_entropy", "Entropy in nats of the softmax of each realm's confidences.", "select realm, round(-sum(p * ln(p)), 6) as entropy from (select realm, exp(confidence) / sum(exp(confidence)) over (partition by realm) as p from {shelf}) s group by realm")
sql("display_percent", "Whole percent of a clamped score.", "select memory_id, cast(floor(100 * greatest(0.0, least(1.0, confidence))) as int) as percent from {shelf}")
sql("ndcg", "nDCG at 10 of each realm's memories in the order of their ids, gain 1 for active ones.", "select realm, round(sum(case when active = 1 then 1 / log2(place + 1.0) else 0.0 end) / sum(case when ideal <= hits then 1 / log2(ideal + 1.0) else 0.0 end), 6) as ndcg from (select realm, active, place, place as ideal, sum(active) over (partition by realm) as hits from (select realm, case when status = 'active' then 1 else 0 end as active, row_number() over (partition by realm order by memory_id) as place from {shelf}) a where place <= 10) b where hits > 0 group by realm")
sql("noise_band", "Mean, sample deviation and accepted band of amounts by tool.", "select tool, count(*) as n, round(avg(cost), 6) as mean, round(stddev_samp(cost), 6) as sd, round(avg(cost) - 2 * stddev_samp(cost), 6) as low, round(avg(cost) + 2 * stddev_samp(cost), 6) as high from {tape} group by tool")
_WILSON = "(p + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)"
sql("condition_summary", "Success of each condition (tool) with its Wilson interval, mean amount and difference from all.", "select tool, cast(n as bigint) as n, round(p, 6) as success, round(" + _WILSON.format(sign="-") + ", 6) as low, round(" + _WILSON.format(sign="+") + ", 6) as high, round(cost, 6) as tokens, round(cost - total, 6) as delta from (select tool, cast(count(*) as double) as n, avg(1.0 - failed) as p, avg(cost) as cost from {tape} group by tool) c cross join (select avg(cost) as total from {tape}) t")
sql("utility_credit", "Memories whose use (a view in a session that bought) pays: a session without the view failed, or spent 1.5 times as much.", "select w.entity as memory, count(*) filter (where o.failed = 1) as lifts, count(*) filter (where o.failed = 0 and o.cost >= 1.5 * w.cost) as costs from (select distinct entity, session, cost from {tape} where tool = 'purchase') w join (select session, max(failed) as failed, avg(cost) as cost from {tape} group by session) o on o.session = w.session group by w.entity")
sql("idea_ranking", "Ideas (entities) by gain over effort and an exploration bonus.", "select entity as idea, round(abs(avg(1.0 - failed) - 0.5) * 0.8 / (1 + avg(cost)) + sqrt(ln(t.n + 1) / (count(*) + 1)), 6) as score, count(*) as tries from {tape} cross join (select count(*) as n from {tape}) t group by entity, t.n")
sql("token_cost_ledger", "Price of each session's tokens: input, cached, written to the cache, output.", "select session, round((sum(case when tool = 'view' then cost else 0.0 end) * 3 + sum(case when tool = 'click' then cost else 0.0 end) * 0.3 + sum(case when tool = 'signup' then cost else 0.0 end) * 3.75 + sum(case when tool in ('purchase', 'error') then cost else 0.0 end) * 15) / 1000000, 9) as price, count(*) as requests from {tape} where cost is not null group by session")
sql("learning_dedup", "Memories that repeat an earlier one of the same realm, or of another.", "select memory_id, case when realm = first_realm then 'in_realm' else 'cross_realm' end as how from (select memory_id, realm, first_value(realm) over (partition by md5(content) order by memory_id) as first_realm, row_number() over (partition by md5(content) order by memory_id) as place from {memories}) d where place > 1")
sql("prompt_admission", "Memories admitted to a prompt: sure enough, each head once, lanes (realms) in turn, three at most.", "select memory_id, realm as lane, turn_ from (select memory_id, realm, round_, row_number() over (order by round_, realm, memory_id) as turn_ from (select memory_id, realm, row_number() over (partition by realm order by confidence desc, memory_id) as round_ from (select memory_id, realm, confidence, row_number() over (partition by md5(substring(content, 1, 80)) order by memory_id) as copy from {shelf}) c where copy = 1 and confidence >= 0.3) l) a where turn_ <= 3")
sql("context_weights", "Weight of every turn of a transcript for compaction: its role and how recent it is.", "select session, turn, round(case role when 'system' then 2.0 when 'user' then 1.0 when 'assistant' then 0.8 when 'tool' then 0.5 else 0.6 end * (0.3 * (0.1 + 0.9 * case when n > 1 then i / cast(n - 1 as double) else 0.0 end) + 0.3), 6) as weight from (select session, turn, role, row_number() over (partition by session order by turn) - 1 as i, count(*) over (partition by session) as n from {turns}) t")
sql("task_status_windows", "Sessions' events by day, and how many days they were away before.", f"select session, day, n, day - lag(day) over (partition by session order by day) as away from (select session, day, count(*) as n from (select session, cast(floor(us / {DAY_US}) as bigint) as day from {{tape}}) d group by session, day) g")
sql("spectral_drift", "Change of each realm's mean length against all.", "select realm, round(avg(length(content)) - t.mean, 4) as drift from {memories} cross join (select avg(length(content)) as mean from {memories}) t group by realm, t.mean")
sql("theme_stats", "Size of every theme and its share.", "select label, count(*) as n, round(count(*) / cast(t.n as double), 6) as share from {marks} cross join (select count(*) as n from {marks}) t group by label, t.n")
sql("metric_utility", "Reward less costs by tool.", "select tool, round(avg(1.0 - 2.0 * failed) - 0.001 * avg(cost), 6) as utility from {tape} group by tool")
