"""Registered queries over journal texts: dates in words, distilled notation, the atom index."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import dates, notation
from recollect.functions import text as T
from recollect.functions.pages import page_text
from recollect.operators.atoms import CLASSES, SECRET, AtomIndex
from recollect.operators.graph import shared_folder
from recollect.plans.registry import query
from recollect.sources import journal
from recollect.sources.tables import memories, table

_EVENT = "event_id, coalesce(user_id, -1) u, event_type t, (props->>'$.k')::int k, ts"
_UNIT = "['day', 'week', 'month', 'year'][event_id % 4 + 1]"
_D = "(ts::date - coalesce(k, 0) * 7)"
_SAID = f"""(select event_id, epoch_us(ts) anchor, case event_id % 11 when 0 then 'yesterday' when 1 then ' Today ' when 2 then 'over the last ' || (k % 9 + 1) || ' ' || {_UNIT} || 's'
  when 3 then 'Last ' || ['week', 'month', 'year'][event_id % 3 + 1] when 4 then (k % 9 + 1) || ' ' || {_UNIT} || 's ago' when 5 then strftime({_D}, '%Y-%m-%d') when 6 then strftime({_D}, '%d-%b-%Y')
  when 7 then strftime({_D}, '%B %-d, %Y') when 8 then strftime({_D}, '%Y%m%d') when 9 then strftime({_D}, '%b %d %Y') when 10 then t || ' some day' end expression, k, {_D} d
  from (select {_EVENT} from events where ts is not null))"""


@query(
    f"""with s as (select *, event_id % 11 form, (k % 9 + 1) * [1, 7, 30, 365][event_id % 4 + 1] back, [7, 30, 365][event_id % 3 + 1] unit from {_SAID}),
    a as (select *, case when form = 0 then anchor - 86400000000 when form = 1 then anchor when form in (2, 4) then anchor - back * 86400000000 when form = 3 then anchor - unit * 86400000000 when form < 10 then epoch_us(d::timestamp) end at_ from s)
    select event_id, expression, at_::bigint as "at", (case when form in (2, 3) then at_ else at_ // 86400000000 * 86400000000 end)::bigint as "start",
    (case when form in (2, 3) and at_ is not null then anchor else at_ // 86400000000 * 86400000000 + 86400000000 end)::bigint as "until", case when at_ is not null then form in (0, 2, 3, 4) end approximate from a"""
)
def temporal_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every dated note means at the time it was written."""
    rows = journal.said(spark, sf_dir).withColumn("r", dates.resolve(F.col("expression"), F.col("anchor")))
    return rows.select("event_id", "expression", "r.at", "r.start", "r.until", "r.approximate")


@query(f"select form, count(*) n, count(distinct expression) expressions from (select case when form in (0, 1) then 'day' when form in (2, 3, 4) then 'span' else 'date' end form, lower(trim(expression)) expression from (select *, event_id % 11 form from {_SAID}) where form not in (8, 10) and expression is not null) group by form")
def temporal_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that notes mention within a sentence, by their form."""
    sentence = F.concat(F.lit("We met ("), F.trim("expression"), F.lit("), I think."))
    rows = journal.said(spark, sf_dir).select("expression", dates.mention(sentence).alias("m"))
    low = F.lower("m")
    form = F.when(low.isin("yesterday", "today"), "day").when(low.rlike("(day|week|month|year)"), "span").otherwise("date")
    whole = F.when(form == "span", F.lower(F.trim("expression"))).otherwise(low)
    return rows.where("m is not null").groupBy(form.alias("form")).agg(F.count("*").alias("n"), F.countDistinct(whole).alias("expressions"))


_NOTED = f"(select event_id, u, t, k, epoch_us(ts) anchor, event_id % 6 form from (select {_EVENT} from events) where t is not null and k is not null)"
_LEARNED = "event_id, {line} line, 'learning' kind, '{type}' as type, '{category}' category, {content} as content, null subject, null predicate, null as object, null::bigint valid_from, {valence}::double valence, {arousal}::double arousal, '{flags}' flags, '{refs}' refs, {cited} citations"
_LINKED = "event_id, {line} line, 'triplet' kind, null as type, null category, null as content, {s} subject, '{p}' predicate, {o} as object, {at}::bigint valid_from, null valence, null arousal, null flags, null refs, null citations"
_BROKEN = "event_id, {line} line, 'broken' kind, null as type, null category, {content} as content, null subject, null predicate, null as object, null::bigint valid_from, null valence, null arousal, null flags, null refs, null citations"


def _expected() -> str:
    """What the notes say, stated from how they are written and not from their text."""
    kk, plain = "'k' || k", {"valence": 0, "arousal": 0, "flags": "", "refs": "", "cited": "''"}
    rows = [
        (0, _LEARNED.format(line=1, type="PATTERN", category="pattern", content="'[hooks] ' || t || '->k' || k || '→session' || u || chr(10) || '[ε] do_not_parse→code' || event_id", valence=0.3, arousal=0.2, flags="CORE,PIVOT", refs="architecture", cited="'src/k' || k || '.py:' || event_id || ':why,architecture:0:'")),
        (0, _LINKED.format(line=1, s="t", p="leads_to", o=kk, at="null")), (0, _LINKED.format(line=1, s=kk, p="leads_to", o="'session' || u", at="null")),
        (1, _LEARNED.format(line=1, type="GOTCHA", category="gotcha", content="t || ' => {retry, k' || k || '}' || chr(10) || 'more of it'", **{**plain, "valence": -0.5, "arousal": 1})),
        (1, _LINKED.format(line=1, s="t", p="causes", o="'retry'", at="null")), (1, _LINKED.format(line=1, s="t", p="causes", o=kk, at="null")),
        (2, _LEARNED.format(line=1, type="DECISION", category="decision", content="'k' || k || '→k' || (k + 1) || '|cheaper'", **{**plain, "valence": 0.5, "arousal": 0.4})),
        (2, _LINKED.format(line=1, s=kk, p="chosen_over", o="'k' || (k + 1)", at="null")),
        (3, _LINKED.format(line=1, s="'session:' || u", p="%t%", o=kk, at="(anchor - 86400000000)").replace("'%t%'", "t")),
        (4, _BROKEN.format(line=1, content="'[TRIPLET] ' || t")), (4, _BROKEN.format(line=2, content="'[UNKNOWN] ' || k")), (4, _BROKEN.format(line=3, content="'stray'")),
        (5, _LEARNED.format(line=1, type="INSIGHT", category="wisdom", content="'narrow $\\rightarrow$ k' || k", **plain)), (5, _LINKED.format(line=1, s="'narrow'", p="leads_to", o=kk, at="null")),
        (5, _LEARNED.format(line=3, type="SOLUTION", category="solution", content="'look at @src/k' || k || '.py:7'", **{**plain, "cited": "'src/k' || k || '.py:7:'"})),
        (5, _LINKED.format(line=4, s=kk, p="in", o="'all of it'", at="null")),
    ]
    return " union all ".join(f"select {columns} from {_NOTED} where form = {form}" for form, columns in rows)


@query(_expected())
def ssl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnings, facts and broken lines of notes in distilled notation, dates resolved at the time of the note."""
    when = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("anchor"))
    rows = notation.parsed(journal.notation(spark, sf_dir).join(when, "event_id"), anchor=F.col("anchor"))
    cited = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["file"], c["line"].cast("string"), c["context"])), ",")
    return rows.select("event_id", "line", "kind", F.when(F.col("kind") == "learning", F.col("type")).alias("type"), "category", "content", "subject", "predicate", "object", "valid_from", "valence", "arousal", F.array_join("flags", ",").alias("flags"), F.array_join("refs", ",").alias("refs"), cited.alias("citations"))


@query(
    """select conv_id session, turn, case when starts_with(text, '[') and contains(text, ']') or contains(text, '→') or regexp_matches(text, ' G:[0-4]') then text
    when strpos(text, chr(10)) between 1 and 80 then '[' || role || '] ' || text[:strpos(text, chr(10)) - 1] || ' @' || conv_id || text[strpos(text, chr(10)):]
    when length(text) > 80 then '[' || role || '] ' || text[:80] || '... @' || conv_id || chr(10) || text else '[' || role || '] ' || text || ' @' || conv_id end converted from conversations"""
)
def ssl_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn in bracketed notation, with its role and session."""
    turns = table(spark, sf_dir, "conversations")
    found = None
    for role in ("user", "assistant", "system"):
        part = turns.where(F.col("role") == role).select(F.col("conv_id").alias("session"), "turn", notation.bracketed(F.col("text"), role, F.col("conv_id").cast("string")).alias("converted"))
        found = part if found is None else found.unionByName(part)
    return found


def atom_index(spark: SparkSession, sf_dir: str) -> AtomIndex:
    """The index of a data folder's journal and documents, brought up to date."""
    found = AtomIndex(spark, f"{shared_folder(spark)}/atoms-{hashlib.md5(sf_dir.encode()).hexdigest()}")
    found.update("journal", f"{sf_dir}/events.parquet", journal.log)
    found.update("documents", f"{sf_dir}/documents.parquet", lambda t: t.select(F.col("doc_id").alias("memory_id"), F.col("source").alias("realm"), "text", "_file"))
    return found


_LOG = f"""(select event_id memory_id, 'session:' || u realm, case event_id % 6 when 0 then '$ make k' || k || ' token=' || t || chr(10) || t || ' done'
  when 1 then 'see /srv/app' || u || '/k' || k || '.py:' || (k + 1) || ' and' || chr(10) || '/srv/app' || u || '/k' || k || '.py' when 2 then 'open https://example.org/' || t || '/' || k || ' for #' || k
  when 3 then 'run ' || c[:8] || '-' || c[9:12] || '-' || c[13:16] || '-' || c[17:20] || '-' || c[21:] when 4 then 'ValueError: k' || k || ' is missing' || chr(10) || 'at commit ' || c else 'nothing of note about ' || t end as text
  from (select *, md5(t || k) c from (select {_EVENT} from events)))"""


def spans_sql(source: str) -> str:
    """class, atom, memory_id, realm, line of every mention, by the patterns."""
    of = lambda name: f"select memory_id, realm, line, '{name}' class, unnest(regexp_extract_all(said, '{CLASSES[name][0].replace(chr(39), chr(39) * 2)}', {1 if re.search(r'[(](?![?])', CLASSES[name][0]) else 0})) atom from lines"
    texts = f"select memory_id, realm, unnest(string_split(text, chr(10))) said, generate_subscripts(string_split(text, chr(10)), 1) line from {source}"
    secret = SECRET.replace("'", "''")
    return f"(with lines as ({texts}), raw as ({' union all '.join(map(of, CLASSES))}) select memory_id, realm, line, class, regexp_replace(atom, '{secret}', '\\1[redacted]', 'g') atom, regexp_matches(atom, '{secret}') redacted from raw)"


DOCUMENTS = "(select doc_id memory_id, coalesce(source, '') realm, text from documents)"


@query(
    f"""with s as (select * from {spans_sql(_LOG)} where contains(lower(atom), 'k17.py') or regexp_matches(lower(atom), '(^|[^a-z0-9])k17([^a-z0-9]|$)')),
    newest as (select * from (select class, atom, memory_id, any_value(realm) realm, min(line) line from s group by class, atom, memory_id) qualify row_number() over (partition by class, atom order by memory_id desc) = 1)
    select class, atom, count(*) as "count", n.realm as session, n.line, n.memory_id from s join newest n using (class, atom) group by class, atom, n.realm, n.line, n.memory_id order by 3 desc, n.memory_id desc, class, atom limit 6"""
)
def span_query(spark: SparkSession, sf_dir: str, asked: str = "k17.py", realm: str | None = None, k: int = 6) -> DataFrame:
    """Verbatim atoms of the journal that hold what is asked for."""
    return atom_index(spark, sf_dir).query(asked, realm, k, "journal").withColumn("line", F.col("line").cast("long"))


@query(
    f"""select class, count(*) atoms, sum(n)::bigint mentions, sum(octet_length(atom::blob))::bigint bytes, sum(redacted)::bigint redacted from
    (select class, atom, count(*) n, count(*) filter (redacted) redacted from (select * from {spans_sql(_LOG)} union all select * from {spans_sql(DOCUMENTS)}) group by all) group by class"""
)
def span_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct atoms of each class in the journal and the memories, with their mentions, bytes and what was struck out."""
    return atom_index(spark, sf_dir).stats()


@query(f"select source realm, class, count(distinct doc_id) memories from documents join (select distinct memory_id, class from {spans_sql(DOCUMENTS)}) on memory_id = doc_id group by all")
def span_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories of each realm that hold atoms of each class, by the index."""
    held = atom_index(spark, sf_dir).rows("documents", "by_memory").select("memory_id", "class").distinct()
    return memories(spark, sf_dir).select("memory_id", "realm").join(held, "memory_id").groupBy("realm", "class").agg(F.countDistinct("memory_id").alias("memories"))


_PAGE = """(select page_id, url, case when contains(html, '<html') or contains(html, '<HTML') then regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?(?:</script[^>]*>|\\z)', '', 'g'), '(?is)<style.*?(?:</style[^>]*>|\\z)', '', 'g'), '<[^>]*>?', '', 'g'), '>', ''), '[ \\n\\r\\t]+', ' ', 'g') else html end as text from pages)"""


@query(f"select page_id, case when starts_with(url, 'http://') or starts_with(url, 'https://') then 'url' else 'file' end as kind, length(text) n_chars, md5(text) text_md5 from {_PAGE}")
def page_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", page_text(F.col("html")).alias("text"))
    kind = F.when(F.col("url").startswith("http://") | F.col("url").startswith("https://"), "url").otherwise("file")
    return pages.select("page_id", kind.alias("kind"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _listed(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


@query(f"select item_id, len(t) n_terms, array_to_string(t, ' ') terms from (select item_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(regexp_replace(w, '[^A-Za-z0-9]', '', 'g'))), lambda w: length(w) >= 3 and not list_contains({_listed(T.TERM_STOP)}, w)) t from benchmark)")
def extract_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every benchmark passage taken as a query."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.extract_terms(F.col("text")).alias("t"))
    return rows.select("item_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


_PARTED = "regexp_replace(regexp_replace(regexp_replace(text, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"
_STEM = "case when length(w) > 5 and ends_with(w, 'ing') then w[:-4] when length(w) > 4 and ends_with(w, 'ed') then w[:-3] when length(w) > 4 and ends_with(w, 's') then w[:-2] else w end"


@query(
    f"""with w as (select unnest(list_transform(regexp_split_to_array({_PARTED}, '[^A-Za-z0-9]+'), lambda x: lower(x))) w from {_LOG}),
    s as (select {_STEM} w from w where length(w) > 1 and not list_contains({_listed(T.CODE_STOP)}, w)) select case when length(w) > 4 and ends_with(w, 'e') then w[:-2] else w end word, count(*) n from s group by 1"""
)
def code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the identifiers that the journal names."""
    rows = journal.log(table(spark, sf_dir, "events")).select(F.explode(T.code_words(F.col("text"))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("n"))


@query(
    """with t as (select conv_id, turn, role, regexp_extract_all(lower(text), '[a-z0-9]+') w from conversations), p as (select a.conv_id, a.turn, a.w a, u.w b from t a join t u on u.conv_id = a.conv_id and u.turn = a.turn - 1 where a.role = 'assistant' and u.role = 'user'),
    c as (select conv_id, turn, sum(least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w)))) n from (select *, unnest(list_distinct(a)) w from p) group by all)
    select p.conv_id session, p.turn, round(case when coalesce(n, 0) > 0 then 2.0::double * n / (len(a) + len(b)) else 0 end, 6) f1 from p left join c on c.conv_id = p.conv_id and c.turn = p.turn"""
)
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a question's words its answer takes up, and the other way round."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    both = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return both.select(F.col("conv_id").alias("session"), "turn", F.round(T.token_f1("text", "asked"), 6).alias("f1"))
