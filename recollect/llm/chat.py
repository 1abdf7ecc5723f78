"""Chat formatting with typed content parts; DataFrame functions only.

A visitor flattens the parts of a turn in their order: texts are escaped, attachments become placeholders and leave a
reference with the number of tokens that the placeholder expands to. Turns are written between marks, and everything
else that looks like a mark is escaped, so the output reads back exactly: parts, roles and the loss mask.

Rows of a conversation are combined in each task before the shuffle, so a conversation of very many turns costs a row
a task; its text meets in one row, as the output has it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template, and the forms of control strings (these marks, placeholders, and those of other
# public templates) behind their first character.
TURN, HEAD, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(?=\|[A-Za-z_]+\|>|/?s>|/?INST\])"
PLACE = r"<\|([A-Za-z_]+)\|>"

PATCH = 28  #: pixels of an image patch, a token each
RATE = 25  #: tokens of a second of sound
PAGE = 256  #: tokens of a page
BLOCK = 1024  #: turns of a block in prefix sums

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"

#: Tokens that a placeholder expands to, by the type of the part; other types that aren't text count none.
VISITORS: dict[str, Callable[[Column], Column]] = {
    "image": lambda p: F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH),
    "audio": lambda p: F.ceil(p["seconds"] * RATE),
    "document": lambda p: p["pages"].cast("long") * PAGE,
}


def escape(text: Column) -> Column:
    """A backslash behind the first character of whatever looks like a control string, escaped ones included."""
    return F.when(text.contains("<") | text.contains("["), F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2")).otherwise(text)


def visit(part: Column, visitors: dict[str, Callable[[Column], Column]] = VISITORS) -> Column:
    """struct<piece, kind, ref, tokens> of a part: kind is null for texts. A part without a type is text."""
    tokens, kind = F.lit(0).cast("long"), F.lit("attachment")
    for name, count in visitors.items():
        tokens = F.when(part["type"] == name, F.coalesce(count(part).cast("long"), F.lit(0).cast("long"))).otherwise(tokens)
        kind = F.when(part["type"] == name, F.lit(name)).otherwise(kind)
    is_text = F.coalesce(part["type"], F.lit("text")) == "text"
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("piece"),
        F.when(~is_text, kind).alias("kind"), F.when(~is_text, part["ref"]).alias("ref"), F.when(is_text, F.lit(0).cast("long")).otherwise(tokens).alias("tokens"),
    )


def as_parts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, content of a table with a column of texts."""
    none = F.lit(None)
    one = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"))
    return conversations.select("conv_id", "turn", "role", F.array(one).alias("content"))


def turns(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, piece, attachments of every message: piece is its stretch of the output."""
    seen = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.transform(F.coalesce("content", F.array().cast(PARTS)), lambda p: visit(p)).alias("seen"))
    body = F.array_join(F.transform("seen", lambda x: x["piece"]), "")
    attached = F.transform(F.filter("seen", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return seen.select("conv_id", "turn", "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(HEAD), body, F.lit(END)).alias("piece"), attached.alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, attachments, attachment_tokens of every conversation.

    messages: conv_id, turn, role, content (PARTS), in rows by turn; rows of equal turns stand by role and text as written. A null role,
    text or content is empty, a null turn stands first, a null conv_id is a conversation, repeated rows are turns each.
    The i-th attachment is that of the i-th placeholder.
    """
    found = turns(messages).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "piece", "attachments"))).alias("all"))
    attachments = F.flatten(F.col("all")["attachments"])
    tokens = F.aggregate(attachments["tokens"], F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join(F.col("all")["piece"], "").alias("formatted"), attachments.alias("attachments"), tokens.alias("attachment_tokens"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, texts, places>> of a formatted conversation: the texts around the placeholders of each turn."""
    marked = F.split(formatted, TURN.replace("|", r"\|"))

    def turn(x: Column) -> Column:
        body = F.substring_index(F.substring_index(x, HEAD, -1), END, 1)
        return F.struct(unescape(F.substring_index(x, HEAD, 1)).alias("role"), F.transform(F.split(body, PLACE), unescape).alias("texts"), F.regexp_extract_all(body, F.lit(PLACE), F.lit(1)).alias("places"))

    return F.transform(F.filter(marked, lambda x: x != ""), turn)


def loss_spans(chats: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, turn, start, end (code points of the output) of the bodies under the loss mask.

    Offsets are prefix sums by blocks of turns, so no task gets all turns of a long conversation.
    """
    pieces = F.filter(F.split("formatted", TURN.replace("|", r"\|")), lambda x: x != "")
    rows = chats.select("conv_id", F.posexplode(pieces).alias("turn", "x")).withColumn("block", (F.col("turn") / BLOCK).cast("long"))
    head = F.substring_index("x", HEAD, 1)
    rows = rows.select("conv_id", "turn", "block", head.alias("role"), (F.length(head) + len(TURN) + len(HEAD)).cast("long").alias("before"), (F.length("x") + len(TURN)).cast("long").alias("size"))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("size").alias("total"))
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("conv_id").alias("its_conv"), F.col("block").alias("its_block"), F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(base, F.col("conv_id").eqNullSafe(F.col("its_conv")) & (F.col("block") == F.col("its_block")))
    start = F.col("base") + F.col("at")
    return rows.where(F.col("role") == role).select("conv_id", "turn", (start + F.col("before")).alias("start"), (start + F.col("size") - len(END)).alias("end"))


def chat_report(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens, read from the output."""
    chats = format_chats(messages).withColumn("back", read_back(F.col("formatted")))
    text = lambda t: F.array_join(t["texts"], "")
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), text(t), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("back", lambda t: t["role"] == "assistant"), text), "")
    chats = chats.withColumn("loss", loss)
    return chats.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens",
    )
