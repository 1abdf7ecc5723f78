"""Secrets in whole texts, with multipart credentials linked; DataFrame functions only.

Base spans are the matches of three patterns. The weak candidates are parts that mean little alone: other access
identifiers, opaque strings and endpoints. They are interval-joined with complementary parts of the same document (the scope)
over buckets of positions, and reported only where the parts co-occur: an identifier with a secret nearby, a
secret with an identifier nearby, an endpoint with both.

Positions come from splitting a text at the matches: matches and the stretches between them alternate, so running
sums of their lengths give every start and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import cut

NEAR = 400  #: characters between two parts of one credential at most

# The patterns of the base spans; an assignment's value is group 2.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
# Weak parts: identifiers of temporary or other keys and of clients, opaque strings, endpoints.
WEAK_ID = r"(?<![A-Z0-9])A(?:SIA|ROA|IDA|GPA)[A-Z0-9]{16,}+|(?i:(?<![a-z0-9])(?:client|account|access_?key|user)_?(?:id|name)?[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9._@-]{4,}+)"
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/=_-])"
WEAK_ENDPOINT = r"(?i:https?|jdbc|amqp|ftp|mongodb|postgres(?:ql)?|redis|mysql)://[^\s\"'<>]{4,}+|(?<![A-Za-z0-9.-])(?:[a-z0-9-]+\.)+(?:amazonaws\.com|windows\.net|googleapis\.com)"
BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
KINDS = (*BASE, *WEAK)


def _matches(text: str, pattern: str, when: Column) -> Column:
    """The matches of a pattern, leftmost and non-overlapping; none where a cheap test rules them out."""
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _parts(text: str, found: str, pattern: str, kind: int, good: Column | None = None) -> Column:
    """array<struct<kind, i, gap, size, good>> of the matches in column found, in their order."""
    between = F.split(F.col(text), pattern, -1)
    ok = (lambda m: F.lit(True)) if good is None else good
    one = lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(m).alias("size"), ok(m).alias("good"))
    with_gap = lambda x, g: x.withField("gap", F.length(g))
    none = F.array().cast("array<struct<kind:int,i:int,size:int,good:boolean,gap:int>>")
    return F.when(F.size(found) == 0, none).otherwise(F.zip_with(F.transform(found, one), F.slice(between, 1, F.size(found)), with_gap))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_id and parts: the matches of all patterns with the lengths of the stretches between them."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    assigned = text.contains("=") | text.contains(":")
    rows = rows.withColumn("a", _matches("text", ASSIGN, assigned)).withColumn("k", _matches("text", ACCESS, text.contains("AKIA"))).withColumn("h", _matches("text", HEX, F.lit(True)))
    # Weak parts complete each other only where something looks like an identifier; elsewhere none counts.
    rows = rows.withColumn("wi", _matches("text", WEAK_ID, assigned | text.rlike("A(SIA|ROA|IDA|GPA)[A-Z0-9]{16}")))
    identified = (F.size("wi") > 0) | (F.size("k") > 0)
    rows = rows.withColumn("ws", _matches("text", WEAK_SECRET, identified))
    rows = rows.withColumn("we", _matches("text", WEAK_ENDPOINT, identified & (text.contains("://") | text.contains(".com") | text.contains(".net"))))
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    opaque = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    parts = F.concat(
        _parts("text", "a", ASSIGN, 0, value), _parts("text", "k", ACCESS, 1, lambda m: F.length(m) >= 20), _parts("text", "h", HEX, 2),
        _parts("text", "wi", WEAK_ID, 3), _parts("text", "ws", WEAK_SECRET, 4, opaque), _parts("text", "we", WEAK_ENDPOINT, 5),
    )
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("text_id"), parts.alias("parts"))


def positions(found: DataFrame) -> DataFrame:
    """doc_id, text_id, kind, start, end of the matches that count; rows repeating id and text give them once."""
    rows = found.where(F.size("parts") > 0).dropDuplicates(["doc_id", "text_id"]).select("doc_id", "text_id", F.explode("parts").alias("p")).select("doc_id", "text_id", "p.*")
    so_far = Window.partitionBy("doc_id", "text_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(so_far))
    return rows.where("good").select("doc_id", "text_id", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(spans: DataFrame) -> DataFrame:
    """The weak candidates among spans that complementary parts complete."""
    part = spans.withColumn("role", F.when(F.col("kind").isin(1, 3), "id").when(F.col("kind") == 5, "endpoint").otherwise("secret"))
    # Of two parts that are near, one begins where the other's reach ends at most: a candidate probes the buckets before
    # its start and behind its end, and a part lies in those of its own start and end. So the interval join is an
    # equi-join on buckets, which no document of many parts makes quadratic, and the interval condition alone decides.
    bucket = lambda c: F.floor(c / NEAR).cast("long")
    start, end = F.col("start"), F.col("end")
    probed = F.array(bucket(start) - 1, bucket(start), bucket(end), bucket(end) + 1)
    weak = part.where("kind >= 3").withColumn("bucket", F.explode(F.array_distinct(probed)))
    l, r = weak.alias("l"), part.where("role <> 'endpoint'").withColumn("bucket", F.explode(F.array_distinct(F.array(bucket(start), bucket(end))))).alias("r")
    near = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_id") == F.col("r.text_id")) & (F.col("l.bucket") == F.col("r.bucket"))
    near &= (F.col("l.role") != F.col("r.role")) & (F.col("r.start") <= F.col("l.end") + NEAR) & (F.col("r.end") >= F.col("l.start") - NEAR)
    near &= (F.col("r.start") >= F.col("l.end")) | (F.col("r.end") <= F.col("l.start"))
    met = l.join(r, near).groupBy("l.doc_id", "l.text_id", "l.kind", "l.start", "l.end", "l.role").agg(F.max((F.col("r.role") == "id").cast("int")).alias("id"), F.max((F.col("r.role") == "secret").cast("int")).alias("secret"))
    return met.where("role <> 'endpoint' or (id = 1 and secret = 1)").select("doc_id", "text_id", "kind", "start", "end")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of every row.

    A null text is empty. Spans are kind:start:end in code points, sorted by start and then by kind. Rows that
    repeat id and text are each returned. One document's spans meet in one row, as its text does.
    """
    found = cut(scan(docs))
    spans = cut(positions(found))
    reported = spans.where("kind < 3").unionByName(linked(spans))
    reported = reported.groupBy(F.col("doc_id").alias("its_doc"), F.col("text_id").alias("its_text")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = found.select("doc_id", "text_id").join(reported, (F.col("text_id") == F.col("its_text")) & F.col("doc_id").eqNullSafe(F.col("its_doc")), "left")
    rows = rows.select("doc_id", F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"] < 3))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_linked"))
