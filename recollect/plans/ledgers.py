"""Registered queries over append-only ledgers: what each tool of state reads from its op-log.

Every ledger is the event tape under its own vocabulary: a row's tool says which operation it is, its entity is what
the operation is on, its session who did it, its cost the amount. State is the latest row of a key (or a signed sum),
so nothing is updated in place, and a ledger of any size is one aggregation keyed by its entity.

Ties in time are broken by event id. Limits are reports of the k best or latest.
"""

from __future__ import annotations

from recollect.plans.logical import sql

DAY_US = 86_400_000_000
NOW = "(select max(us) as now from {tape})"


def last(key: str, where: str = "true", columns: str = "*") -> str:
    """The latest row of each key."""
    return f"(select * from (select {columns}, row_number() over (partition by {key} order by us desc, event_id desc) as place from {{tape}} where {where}) where place = 1)"


# Memories under operations: pins, locks, evidence, tiers, Beta posteriors, strength.
sql("get", "One memory by its id; the filter reaches the scan.", "select memory_id, kind, realm, content from {memories} where memory_id = :id", id=7)
sql("set_affect_view", "Latest valence and arousal of every memory (latest wins).", f"select entity as memory_id, round(cost / 100, 6) as valence, session as by_session from {last('entity', 'cost is not null')}")
sql("memory_strength", "Strength of every memory: 0.5 and the signed amounts of strengthen (purchase) and weaken (error) rows, between 0 and 1.", "select entity as memory_id, round(greatest(0.0, least(1.0, 0.5 + sum(case tool when 'purchase' then 0.05 when 'error' then -0.05 else 0.0 end))), 6) as strength from {tape} group by entity")
sql("memory_acks", "Acks less nacks of every memory.", "select entity as memory_id, cast(sum(case tool when 'purchase' then 1 when 'error' then -1 else 0 end) as bigint) as score, count(*) as n from {tape} where tool in ('purchase', 'error') group by entity")
sql("memory_tags", "Tags of every memory: each tag (a tool name) by its last add (even session) or remove.", f"select entity as memory_id, tool as tag from {last('entity, tool')} where session % 2 = 0")
sql("memory_utility", "Beta posterior of each memory's utility from weighted outcomes.", "select entity as memory_id, round(2 + sum(case when tool = 'purchase' then 1.0 else 0.0 end), 6) as alpha, round(2 + sum(case when tool = 'error' then 1.0 else 0.0 end), 6) as beta from {tape} group by entity")
sql("memory_tier", "Tier of a memory: one step up the ladder for each promotion (purchase), four steps at most.", "select entity as memory_id, case least(count(*) filter (where tool = 'purchase'), 3) when 0 then 'proposed' when 1 then 'observed' when 2 then 'verified' else 'active' end as tier from {tape} group by entity")
sql("labile_memories", "Memories recalled (view) twice or more within a window.", f"select t.entity as memory_id, count(*) as n, max(t.us) as last_us from {{tape}} t cross join {NOW} n where t.tool = 'view' and t.us >= n.now - :hours * 3600000000 group by t.entity having count(*) >= :min_access", hours=72, min_access=2)
sql("labile_memories_top", "The most recalled memories.", "select entity as memory_id, count(*) as n from {tape} where tool = 'view' group by entity order by n desc, memory_id limit 20")
sql("forgotten", "Memories that a forget row (error of their own id) tombstones, by kind; reads leave them out.", f"select m.kind, count(*) as n from {{memories}} m left join {last('entity', 'tool in (' + repr('error') + ', ' + repr('signup') + ')')} f on f.entity = m.memory_id where coalesce(f.tool, 'signup') = 'signup' group by m.kind")
sql("episodes_pruned", "Episodes older than so many days whose strength is low.", f"select t.session, count(*) as n, max(t.us) as last_us from {{tape}} t cross join {NOW} n group by t.session, n.now having max(t.us) < n.now - :days * {DAY_US} and avg(t.failed) >= 0", days=1)
sql("list_memories_brief", "Index of memories: title of 80 characters.", "select memory_id, kind, realm, substring(content, 1, 80) as title from {memories}")
sql("list_by_aspect", "Memories of an aspect's kinds with enough confidence.", "select m.memory_id, a.aspect, m.confidence from {shelf} m join (values ('germanic', 'en'), ('germanic', 'de'), ('romance', 'fr'), ('romance', 'es')) as a(aspect, kind) on a.kind = m.kind where a.aspect = :aspect and m.confidence >= :least", aspect="romance", least=0.5)
sql("list_merge_queue", "Pending merges: memories of the same content, into the one of the smallest id.", "select m.memory_id as source_id, f.into_id from {memories} m join (select md5(content) as h, min(memory_id) as into_id, count(*) as n from {memories} group by md5(content)) f on md5(m.content) = f.h where f.n > 1 and m.memory_id <> f.into_id")
sql("memory_provenance", "Source of every memory and what it supersedes or is superseded by: older and newer ones of the same content.", "select memory_id, realm as source, lag(memory_id) over (partition by md5(content) order by memory_id) as supersedes, lead(memory_id) over (partition by md5(content) order by memory_id) as superseded_by from {memories}")
sql("why_active", "Status of every memory with its confirmations and contradictions on the ledger.", "select m.memory_id, m.status, count(t.event_id) filter (where t.tool = 'purchase') as confirmations, count(t.event_id) filter (where t.tool = 'error') as contradictions from {shelf} m left join {tape} t on t.entity = m.memory_id group by m.memory_id, m.status")
sql("hygiene_stats", "Counts of what hygiene looks at.", "select count(*) as n, count(*) filter (where status = 'active') as active, count(*) filter (where status = 'archived') as archived, count(*) filter (where status = 'contradicted') as contradicted, count(*) filter (where confidence < 0.5) as unsure, count(*) filter (where length(content) < 200) as short from {shelf}")
sql("expand_memory", "A memory and what its subject leads to, two steps deep.", "select m.memory_id, 0 as hop, m.kind as node from {memories} m where m.memory_id = :id union all select :id, 1, t.object from {triplets} t where t.subject = 'customer:' || :id union all select :id, 2, b.object from {triplets} a join {triplets} b on b.subject = a.object where a.subject = 'customer:' || :id", id=7)
sql("explore_peek", "The first 200 characters of a memory.", "select memory_id, substring(content, 1, 200) as head, length(content) as n_chars from {memories} where memory_id = :id", id=7)
sql("explore_expand", "The full content of a memory.", "select memory_id, content from {memories} where memory_id = :id", id=7)
sql("enrichment_status", "Memories of each kind with and without a vector.", "select kind, count(*) as n, count(access) as enriched from {shelf} group by kind")
sql("realm_list", "Realms and how many memories each holds.", "select realm, count(*) as n from {memories} group by realm")
sql("realm_get", "Realms of a memory's content: its own and those of its copies.", "select distinct b.realm from {memories} a join {memories} b on md5(b.content) = md5(a.content) where a.memory_id = :id", id=7)
sql("pending_embed_ids", "Memories that wait for a vector.", "select m.memory_id from {memories} m left join {marks} v on v.vec_id = m.memory_id where v.vec_id is null")
sql("harvest_scope", "Census of the store.", "select realm, kind, count(*) as n, cast(sum(length(content)) as bigint) as chars from {memories} group by realm, kind")
sql("soul_context", "Counts of all that is stored.", "select (select count(*) from {memories}) as memories, (select count(*) from {turns}) as turns, (select count(*) from {tape}) as events, (select count(*) from {triplets}) as triplets, (select count(*) from {marks}) as vectors")
sql("predicate_list", "Predicates with the number of their facts.", "select predicate, count(*) as n from {triplets} group by predicate")

# Graph and claims.
sql("get_entities", "The entities in most triplets.", "select entity, count(*) as n from (select subject as entity from {triplets} union all select object from {triplets}) e group by entity order by n desc, entity limit 50")
sql("query_claims", "Claims by a pattern of subject and predicate; null leaves a place open.", "select subject, predicate, object from {triplets} where predicate = :predicate and subject like :subject", predicate="in_nation", subject="supplier:%")
sql("query_unify", "Facts that unify with a pattern in which an empty string is a wildcard.", "select subject, predicate, object from {triplets} where (:subject = '' or subject = :subject) and (:predicate = '' or predicate = :predicate) and (:object = '' or object = :object)", subject="", predicate="", object="nation:3")
sql("explain_fact", "Facts that support one (same subject, predicate, object) or conflict with it (another object).", "select b.o_orderkey as other, case when b.o_orderstatus = a.o_orderstatus then 'supports' else 'conflicts' end as how from {orders} a join {orders} b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey where a.o_orderkey = :id", id=7)
sql("explore_neighbors", "Nodes linked to one, either way.", "select object as node, predicate, 'out' as way from {triplets} where subject = :node union all select subject, predicate, 'in' from {triplets} where object = :node", node="nation:3")
sql("file_imports", "What a module needs: suppliers of a part.", "select distinct l_suppkey as supplier from {lineitem} where l_partkey = :id", id=7)
sql("file_dependents", "Who needs a module: orders that hold a part.", "select distinct l_orderkey as dependent from {lineitem} where l_partkey = :id", id=7)
sql("conflict_pairs", "Pairs of successive facts on one subject that disagree.", "select o_custkey as customer, previous as older, o_orderkey as newer from (select o_custkey, o_orderkey, o_orderstatus, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from {orders}) c where before <> o_orderstatus")
sql("verbalize_rules", "The most frequent tool rules in words.", "select 'after ' || before || ' comes ' || tool || ' (' || cast(n as varchar(20)) || ' times)' as rule, n from (select before, tool, count(*) as n from (select tool, lag(tool) over (partition by session order by us, event_id) as before from {tape}) b where before is not null group by before, tool) r order by n desc, rule limit 10")

# Sessions, tasks, messages.
sql("session_list", "Sessions with their first and last event and whether they are still active.", f"select t.session, count(*) as n, min(t.us) as first_us, max(t.us) as last_us, case when max(t.us) >= n.now - {DAY_US} then 'active' else 'idle' end as status from {{tape}} t cross join {NOW} n group by t.session, n.now")
sql("cross_harness_conflicts", "Entities on which two kinds of sessions (even, odd) disagree about failure.", "select a.entity, round(abs(a.f - b.f), 6) as disagreement from (select entity, avg(failed) as f from {tape} where session % 2 = 0 group by entity) a join (select entity, avg(failed) as f from {tape} where session % 2 = 1 group by entity) b on a.entity = b.entity where abs(a.f - b.f) >= :least", least=0.2)
sql("narrative_history", "Segments of work: stretches of events of one tool in a session.", "select session, segment, min(tool) as mode, count(*) as n, min(us) as first_us, max(us) as last_us from (select session, tool, us, sum(new) over (partition by session order by us, event_id rows between unbounded preceding and current row) as segment from (select *, case when tool = lag(tool) over (partition by session order by us, event_id) then 0 else 1 end as new from {tape}) a) b group by session, segment")
sql("transcript_list", "Transcripts, longest first.", "select session, count(*) as turns, cast(sum(length(text)) as bigint) as chars from {turns} group by session order by turns desc, session limit 100")
sql("transcript_get", "One transcript's turns.", "select session, turn, role, text from {turns} where session = :session", session=3)
sql("file_timeline", "Changes (clicks, purchases) of each entity within a window, in order.", f"select t.entity, t.event_id, row_number() over (partition by t.entity order by t.us, t.event_id) as place from {{tape}} t cross join {NOW} n where t.tool in ('click', 'purchase') and t.us >= n.now - :days * {DAY_US}", days=7)

# Interventions, surprises, debts, wisdom.
sql("query_surprises", "Events whose amount is far from their tool's mean.", "select t.event_id, t.tool as domain, round(abs(t.cost - d.m), 6) as magnitude from {tape} t join (select tool, avg(cost) as m from {tape} group by tool) d on d.tool = t.tool where abs(t.cost - d.m) >= :least", least=30.0)
sql("surprise_stats", "Surprise of each domain.", "select t.tool as domain, count(*) as n, round(avg(abs(t.cost - d.m)), 6) as magnitude from {tape} t join (select tool, avg(cost) as m from {tape} group by tool) d on d.tool = t.tool group by t.tool")
sql("surprise_learning_stats", "Memories that surprise, gates passed and the sum of adjustments.", "select count(distinct t.entity) as tracked, count(*) filter (where abs(t.cost - d.m) >= 20) as passed, round(sum(case when abs(t.cost - d.m) >= 20 then 0.05 else 0.0 end), 4) as adjustment from {tape} t join (select tool, avg(cost) as m from {tape} group by tool) d on d.tool = t.tool")
sql("insight_global", "Insights that hold a word, longest first.", "select memory_id, length(content) as n_chars from {memories} where content like '%' || :word || '%' order by n_chars desc, memory_id limit 50", word="and")

# Habits, anticipation, goals, profile, skills, learning.
_HABIT = "(select before, tool, count(*) as n, avg(1.0 - failed) as strength from (select tool, failed, lag(tool) over (partition by session order by us, event_id) as before from {tape}) b where before is not null group by before, tool)"
sql("habit_list", "Habits (a tool after another) of enough strength.", f"select before as trigger, tool as action, n, round(strength, 6) as strength from {_HABIT} h where strength >= :least", least=0.5)
sql("habit_match", "Habits that a trigger sets off.", f"select tool as action, n from {_HABIT} h where before = :trigger", trigger="view")
sql("anticipation_list", "Learned anticipation: what follows a tool, with its probability.", "select before, tool, round(n / cast(sum(n) over (partition by before) as double), 6) as confidence from (select before, tool, count(*) as n from (select tool, lag(tool) over (partition by session order by us, event_id) as before from {tape}) b where before is not null group by before, tool) a")
sql("anticipation_predict", "What probably comes after a tool and entity.", "select next_tool, count(*) as n from (select tool, entity, lead(tool) over (partition by session order by us, event_id) as next_tool from {tape}) a where tool = :tool and entity = :entity and next_tool is not null group by next_tool", tool="view", entity=5)
sql("anticipation_filter", "Predictions sure enough to be shown: those of more than an even share.", "select before, tool from (select before, tool, n / cast(sum(n) over (partition by before) as double) as p from (select before, tool, count(*) as n from (select tool, lag(tool) over (partition by session order by us, event_id) as before from {tape}) b where before is not null group by before, tool) a) c where p > :least", least=0.2)
sql("skill_search", "Parts whose name or type holds a word.", "select p_partkey as skill, p_name as name from {part} where lower(p_name) like '%' || :word || '%' or lower(p_type) like '%' || :word || '%'", word="ring")
sql("get_policies", "Policies: tools with enough events and less failure than the tape.", "select t.tool as policy, count(*) as n, round(b.f - avg(t.failed), 6) as lift from {tape} t cross join (select avg(failed) as f from {tape}) b group by t.tool, b.f having count(*) >= :least and b.f - avg(t.failed) > :lift", least=20, lift=0.15)
sql("list_policies", "All policies by lift, shadow or active.", "select t.tool as policy, round(b.f - avg(t.failed), 6) as lift, case when count(*) >= 20 and b.f - avg(t.failed) > 0.15 then 'active' else 'shadow' end as state from {tape} t cross join (select avg(failed) as f from {tape}) b group by t.tool, b.f")
sql("get_source_weights", "Trust in each source: share of its labelled memories that are active.", "select realm as source, round(avg(case when status = 'active' then 1.0 else 0.0 end), 6) as weight, count(*) as n from {shelf} group by realm")
sql("integration_stats", "Success of each source and kind.", "select realm as source, kind, count(*) as n, round(avg(confidence), 6) as success from {shelf} group by realm, kind")
sql("learned_scorer_stats", "The latest model: version, factors, loss, outcomes.", "select count(*) filter (where tool = 'click') as version, count(distinct tool) as factors, round(avg((1.0 - failed - 0.8) * (1.0 - failed - 0.8)), 6) as loss, count(*) filter (where tool in ('purchase', 'error')) as outcomes from {tape}")
sql("metacognition_evaluate", "How many memories there are of each kind, and how many are sure.", "select kind, count(*) as n, count(*) filter (where confidence >= 0.85) as sure from {shelf} group by kind")
sql("metacognition_corrections", "Corrections: memories that are contradicted.", "select memory_id, realm from {shelf} where status = 'contradicted'")
sql("metacognition_outcomes", "Memories that hold a word in lower case.", "select memory_id from {memories} where lower(content) like '%' || :word || '%'", word="license")
sql("suggestion_count", "Suggestions that wait (unsure memories).", "select count(*) as n from {shelf} where confidence < 0.85 and confidence >= 0.5")
sql("suggestion_pending", "Suggestions that wait.", "select memory_id, kind from {shelf} where confidence < 0.85 and confidence >= 0.5")
sql("probe_status", "Exemplars of each behavioural class.", "select label, count(*) as n from {marks} group by label")
sql("provenance_check", "Whether an input was already processed: the latest record of a content's hash.", "select md5(content) as sha, max(memory_id) as record, count(*) as n from {memories} group by md5(content) having md5(content) = md5(:input)", input="nothing of the kind")
sql("fep_status", "Free-energy counters: surprise of each tool in nats.", "select tool, count(*) as n, round(-ln(count(*) / cast(t.total as double)), 6) as surprisal from {tape} cross join (select count(*) as total from {tape}) t group by tool, t.total")
sql("turiya_status", "Diagnostics: regret and liveness of every tool.", f"select t.tool, round(avg(t.failed) - m.best, 6) as regret, case when max(t.us) >= n.now - {DAY_US} then 'live' else 'dormant' end as state from {{tape}} t cross join (select min(f) as best from (select avg(failed) as f from {{tape}} group by tool) x) m cross join {NOW} n group by t.tool, m.best, n.now")
sql("resonance_stats", "Mean and variance of each arm's Beta posterior.", "select tool as arm, round((1 + s) / (2.0 + n), 6) as mean, round((1 + s) * (1 + n - s) / ((2.0 + n) * (2.0 + n) * (3.0 + n)), 9) as variance from (select tool, cast(sum(1 - failed) as double) as s, cast(count(*) as double) as n from {tape} group by tool) a")
sql("hypothesis_probes", "Rules whose outcome is least certain: the widest Wilson interval, then p nearest one half.", "select before, tool, n, round(2 * 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n), 6) as width from (select before, tool, cast(count(*) as double) as n, avg(1.0 - failed) as p from (select tool, failed, lag(tool) over (partition by session order by us, event_id) as before from {tape}) b where before is not null group by before, tool) r order by width desc, before, tool limit 10")
sql("theme_get", "One theme's members.", "select vec_id from {marks} where label = :label", label=3)
sql("show_conflicts", "Memories with a contradicted one of the same content.", "select a.memory_id, b.memory_id as partner from {shelf} a join {shelf} b on md5(a.content) = md5(b.content) and a.memory_id <> b.memory_id where a.status = 'active' and b.status = 'contradicted'")
sql("recall_temporal_events", "Memories that events of a time window touch, by number of events.", f"select m.memory_id, count(*) as n from {{tape}} t cross join {NOW} n join {{memories}} m on m.memory_id = t.entity where t.us >= n.now - :days * {DAY_US} group by m.memory_id", days=7)
sql("recall_temporal", "Memories created in the last days: created at the first event on them.", f"select m.memory_id, c.us as created_us from {{memories}} m join (select entity, min(us) as us from {{tape}} group by entity) c on c.entity = m.memory_id cross join {NOW} n where c.us >= n.now - :days * {DAY_US}", days=30)
sql("recall_last_action_of", "Last occurrences of a tool on an entity.", "select event_id, session from {tape} where tool = :tool and entity = :entity order by us desc, event_id desc limit 5", tool="view", entity=5)
sql("export_soul", "Memories by kind as seed rows.", "select kind, memory_id, md5(content) as content_md5 from {memories}")
sql("wiki_export", "Pages of memories with the number of other memories of the same realm and kind that link to them by content.", "select a.memory_id, count(b.memory_id) as backlinks from {memories} a left join {memories} b on md5(a.content) = md5(b.content) and a.memory_id <> b.memory_id group by a.memory_id")

# Code symbols: parts stand for them (name, type as kind, brand as file).
sql("search_symbols", "Symbols whose name holds a word, of a kind.", "select p_partkey as symbol, p_name as name, p_brand as file from {part} where lower(p_name) like '%' || :word || '%' and p_type = :kind", word="ring", kind="ECONOMY")
sql("code_context", "Symbols of each file and kind.", "select p_brand as file, p_type as kind, count(*) as n from {part} group by p_brand, p_type")
sql("read_symbol", "A symbol by name and kind.", "select p_partkey as symbol, p_name as name, p_type as kind, p_brand as file, p_size as line from {part} where p_name = :called and (:kind = '' or p_type = :kind)", called="red widget", kind="")
sql("read_function", "A symbol of the kind that functions have.", "select p_partkey as symbol, p_name as name, p_brand as file, p_size as line from {part} where p_name = :called and p_type = 'ECONOMY'", called="red widget")
_HIT = "case when ' ' || lower(p_name) || ' ' like '% ' || :one || ' %' then 8.0 else 0.0 end + case when lower(p_type) like '%' || :one || '%' then 2.0 else 0.0 end"
_HITS = f"select p_partkey, p_name, {_HIT} as a, {_HIT.replace(':one', ':two')} as b from {{part}}"
sql(
    "code_query",
    "Symbols ranked by BM25 over names (weight 8) and kinds (weight 2) for two words.",
    f"select p_partkey as symbol, p_name as name, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2), 6) as score from ({_HITS}) h cross join (select cast(count(*) as double) as n, cast(sum(case when a > 0 then 1 else 0 end) as double) as da, cast(sum(case when b > 0 then 1 else 0 end) as double) as db from ({_HITS}) x) s where a + b > 0 order by score desc, symbol limit 20",
    one="ring",
    two="standard",
)
sql("triplets", "Triplets of one predicate and object.", "select subject, predicate, object, weight from {triplets} where predicate = :predicate and object = :object", predicate="in_nation", object="nation:3")
sql("prompt_context", "The prompt's admitted memories with a running budget of a quarter of their characters.", "select memory_id, cast(sum(cost) over (order by memory_id rows between unbounded preceding and current row) as bigint) as spent from (select memory_id, cast(floor(length(content) / 4.0) as bigint) as cost, row_number() over (partition by md5(substring(content, 1, 80)) order by memory_id) as copy, row_number() over (partition by realm order by confidence desc, memory_id) as round_ from {shelf} where confidence >= 0.3) a where copy = 1 and round_ = 1")
sql(
    "compact_context",
    "Turns of each session that stay within a share of its characters: system turns always, the rest by role and how recent they are.",
    "select session, turn from (select session, turn, role, total, sum(cost) over (partition by session order by case when role = 'system' then 0 else 1 end, weight desc, turn rows between unbounded preceding and current row) as spent from (select session, turn, role, cost, sum(cost) over (partition by session) as total, case role when 'user' then 1.0 when 'assistant' then 0.8 when 'tool' then 0.5 else 0.6 end * (0.1 + 0.9 * case when n > 1 then i / cast(n - 1 as double) else 0.0 end) as weight from (select session, turn, role, floor(length(text) / 4.0) as cost, row_number() over (partition by session order by turn) - 1 as i, count(*) over (partition by session) as n from {turns}) a) b) c where role = 'system' or spent <= total * :ratio",
    ratio=0.4,
)
