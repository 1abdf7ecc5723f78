"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.secrets import secrets

    return secrets(read(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.lines import line_report

    return line_report(read(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.topk import top_k

    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), shingle=4, percent=80)


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.suffix import repeated_passages

    return repeated_passages(read(spark, sf_dir, "documents"), min_words=50)


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.embed import near_vectors

    return near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.packing import pack, with_crc

    return with_crc(pack(read(spark, sf_dir, "documents"), tokenizer_path()))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.pii import pii

    return pii(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.bpe import round_trip

    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.audit import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.chat import as_parts, chat_report

    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql("select * from values (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return chat_report(as_parts(said.unionByName(planted)))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.align import alignment

    return alignment(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_lines, op3_topk, op4_minhash, op5_suffix, op6_embedding, op7_packing, op8_pii, op9_bpe, op10_toxicity, op11_audit, op12_chat, op13_align)}
_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 5
"""

_REACH = """
both_ as (select a, b from links union all select b, a from links),
reach(id, r) as (select id, id from nodes union select reach.id, b from reach join both_ on a = r),
component as (select id, min(r) component_id from reach group by id)
"""

_NEAR = f"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents where text is not null),
sh as (select doc_id, unnest(list_distinct(case when len(w) >= 4 then list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
  when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) s from w),
n as (select doc_id, count(*) n from sh group by doc_id),
links as (select p.a, p.b from (select x.doc_id a, y.doc_id b, count(*) k from sh x join sh y on x.s = y.s and x.doc_id < y.doc_id group by all) p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
nodes as (select doc_id id from documents), {_REACH}
select doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept from documents join component on id = doc_id left join n using (doc_id)
"""

_COSINE = f"""
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select x.vec_id a, y.vec_id b from v x join v y on x.vec_id < y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.9),
nodes as (select vec_id id from embeddings), {_REACH}
select vec_id, (select count(*) from both_ where a = vec_id) n_links, component_id, vec_id = component_id kept from embeddings join component on id = vec_id
"""

_AUDIT = """
with filters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (select [a.f, b.f, c.f, d.f, e.f] o, [a.bit, b.bit, c.bit, d.bit, e.bit] bits from filters a, filters b, filters c, filters d, filters e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (select array_to_string(o, '') filter_order, k::int step, bits[k] bit, coalesce(list_sum(bits[1:k - 1]), 0)::int before_ from orders, range(1, 6) r(k)),
w as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
m as (select part, doc_id, (case when len(w) < 50 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end) mask from w),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
c as (select part, mask, count(*) n, coalesce(sum(good), 0) good, coalesce(sum(toxic), 0) toxic from m left join l using (doc_id) group by all)
select part, filter_order, step,
  sum(case when mask & (before_ | bit) = 0 then n else 0 end)::bigint kept,
  sum(case when mask & before_ = 0 and mask & bit <> 0 then n else 0 end)::bigint removed,
  sum(case when mask & before_ <> 0 and mask & bit <> 0 then n else 0 end)::bigint redundant,
  sum(case when mask = bit then n else 0 end)::bigint unique_fails,
  sum(case when mask & before_ = 0 and mask & bit <> 0 then good else 0 end)::bigint good_lost,
  sum(case when mask & before_ = 0 and mask & bit <> 0 then toxic else 0 end)::bigint toxic_lost,
  (select sum(case when d.mask & steps.bit <> 0 and d.mask & s.before_ = 0 and s.bit = steps.bit then d.n else 0 end) from c d, steps s where d.part = c.part)::bigint shapley
from c, steps group by part, filter_order, step, bit, before_
"""

_CHAT = """
with t as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, k, ['user', 'assistant'][k + 1], '</s>[INST] ok [/INST]' from range(0, 2) s(k)),
n as (select *, len(regexp_extract_all(r || chr(10) || x, '[<\\[]\\\\*(\\|[A-Za-z_]+\\|>|/?s>|/?INST\\])')) controls from t)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  coalesce(sum(length(x)) filter (r = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(length(r) + length(x) + controls + length('<|im_start|><|im_sep|><|im_end|>'))::bigint formatted_chars, 0::bigint n_attachments, 0::bigint attachment_tokens
from n group by conv_id
"""

ORACLE_SQL: dict[str, str] = {"op3_topk": _TOP_K, "op4_minhash": _NEAR, "op6_embedding": _COSINE, "op11_audit": _AUDIT, "op12_chat": _CHAT}
