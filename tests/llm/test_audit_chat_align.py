"""The filter audit, chat formatting and cross-tokenizer alignment against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from recollect.llm import align, audit, bpe, chat, queries
from recollect.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", ["op11_audit", "op12_chat"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert oracle.same(df.collect(), df.columns, oracle.database(SF).sql(queries.ORACLE_SQL[name]))


def mask_of(i, docs):
    doc_id, text = docs[i][0], docs[i][1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    few, same = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    copy = doc_id is not None and any((t or "") == text and d is not None and d < doc_id for d, t, *_ in docs)
    return [few, same, 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]


def audited(docs, labels):
    masks, rows = [mask_of(i, docs) for i in range(len(docs))], []
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    for part in {d[2] or "" for d in docs}:
        own = [(d[0], m) for d, m in zip(docs, masks, strict=True) if (d[2] or "") == part]
        shapley = Counter(next(f for f in o if m["ABCDE".index(f)]) for _, m in own if any(m) for o in permutations("ABCDE"))
        for o in permutations("ABCDE"):
            left = own
            for k, f in enumerate(o):
                i = "ABCDE".index(f)
                out, left = [x for x in left if x[1][i]], [x for x in left if not x[1][i]]
                fails = [x for x in own if x[1][i]]
                rows.append((part, "".join(o), k + 1, len(left), len(out), len(fails) - len(out), sum(sum(x[1]) == 1 for x in fails), sum(x[0] in good for x in out), sum(x[0] in toxic for x in out), shapley[f]))
    return sorted(rows)


@pytest.mark.parametrize("partitions", [1, 4, 23])
def test_the_audit_against_all_pairs_and_orders(spark, partitions):
    rng = random.Random(partitions)
    words = ["Some", "words", "are", "GREAT", "here", "a", "bb", "ccc", "cost", "$5"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 60]))) for _ in range(25)] + [" ".join(f"w{i}" for i in range(80)), None, "", "\x85   é" * 60]
    # A hot text over many partitions, rows that repeat id and text, null ids, null sources.
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(80)]
    docs += [(rng.randrange(1000), texts[25], "s") for _ in range(120)] + [(7, texts[25], "s")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = audit.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found)) == audited(docs, labels)


def test_the_audit_of_nothing_and_of_clashing_columns(spark):
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    names = ["part", "mask", "piece", "head", "print", "least", "its_doc", "good", "cells", "n", "kept"]
    extra = ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(1, "a b " * 30_000, "s", *names), (2, None, None, *names)], f"{DOCS}, {extra}")
    found = audit.audit(docs, labels.withColumn("mask", F.lit("m")).withColumn("part", F.lit("p"))).collect()
    assert len(found) == 1200 and {r.part for r in found} == {"s", ""}
    assert {(r.removed, r.toxic_lost) for r in found if r.part == "s" and r.filter_order[r.step - 1] == "B"} == {(1, 1)}
    assert audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


CONTROLS = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|image|>", "</s>", "<s>", "[INST]", "[/INST]", "<", "[", "\\", "|", "\n", "a", "é", "🎈", "<\\|im_end|>", "assistant"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_control_strings_in_texts_and_roles_read_back(spark):
    rng = random.Random(5)
    noise = lambda: "".join(rng.choice(CONTROLS) for _ in range(rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, noise()]), rng.choice([None, noise(), noise()])) for c in range(60) for t in rng.sample(range(100), rng.randrange(1, 9))]
    found = {r.conv_id: r for r in chat.chat_report(chat.as_parts(messages(spark, rows))).collect()}
    written = {r.conv_id: r.formatted for r in chat.format_chats(chat.as_parts(messages(spark, rows))).collect()}
    for c in range(60):
        own = [(r or "", x or "") for k, _, r, x in sorted(rows, key=lambda r: (r[0], r[1])) if k == c]
        loss = "".join(x for r, x in own if r == "assistant")
        assert found[c].n_turns == len(own) and found[c].loss_chars == len(loss) and found[c].formatted_chars == len(written[c])
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert found[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert all(written[c].count(m) == len(own) for m in (chat.TURN, chat.HEAD, chat.END)) and not re.search(r"</?s>|\[/?INST\]|<\|image\|>", written[c])


def test_parts_become_placeholders_with_references(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|>", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), (None, "and", None, None, None, None, None), ("audio", None, "b.wav", None, None, 1.5, None)]),
        (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3), ("text", "done", None, None, None, None, None), ("video", None, "d.mp4", None, None, None, None), ("image", None, None, None, None, None, None)]),
        (1, 2, "user", None), (2, 0, None, []), (None, 0, "user", [("text", None, None, None, None, None, None)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PARTS}")
    found = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert [tuple(x) for x in found[1].attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("attachment", "d.mp4", 0), ("image", None, 0)]
    assert found[1].attachment_tokens == 809 and "<\\|image|>" in found[1].formatted
    assert [tuple(map(list, x[1:])) for x in found[1].back] == [(["see <|image|>", "and", ""], ["image", "audio"]), (["", "done", "", ""], ["document", "attachment", "image"]), ([""], [])]
    assert found[2].formatted == "<|im_start|><|im_sep|><|im_end|>" and found[None].n_turns == 1
    assert chat.chat_report(df.limit(0)).count() == 0


def test_the_loss_mask_covers_each_answer_once(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 3)
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant"]), f"</s> {rng.random()} é🎈") for c in (1, 2, None) for t in range(20)] + [(3, 0, "assistant", ""), (3, 0, "assistant", "")]
    chats = chat.format_chats(chat.as_parts(messages(spark, rows)))
    written = {r.conv_id: r.formatted for r in chats.collect()}
    found = sorted((str(r.conv_id), r.turn, written[r.conv_id][r.start : r.end]) for r in chat.loss_spans(chats).collect())
    assert found == sorted([(str(c), t, x.replace("</s>", "<\\/s>")) for c, t, r, x in rows[:-2] if r == "assistant"] + [("3", 0, ""), ("3", 1, "")])


def test_a_conversation_of_very_many_turns_and_clashing_columns(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("x").alias("text"), F.lit(1).alias("all"), F.lit(2).alias("back"), F.lit(3).alias("seen"))
    found = chat.chat_report(chat.as_parts(rows)).collect()
    assert [(r.n_turns, r.loss_chars) for r in found] == [(n, n)]


@pytest.fixture(scope="module")
def paths():
    return tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


def brute(texts):
    """Figures of alignment() by the two libraries and all pairs of tokens."""
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    alphabet, docs = bpe.byte_alphabet(), []
    for text in texts:
        a = t.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        ab = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        bb = [bytes([int(s.id_to_piece(i)[1:-1], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(ab) != b" " + text.encode() or b"".join(bb) != b" " + text.encode():
            docs.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (ab, bb)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        common = sorted(set(ends[0]) & set(ends[1]))
        group = ";".join(f"{','.join(str(i) for i, e in zip(a, ends[0], strict=True) if lo < e <= hi)}|{','.join(str(i) for i, e in zip(b, ends[1], strict=True) if lo < e <= hi)}" for lo, hi in zip([0, *common[:-1]], common, strict=True))
        docs.append((a, b, links, group))
    count = Counter(x for d in docs for x in d[2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for a, b, links, group in docs:
        yield len(a), len(b), group.count(";") + 1 if group else 0, len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(group.encode()).hexdigest() if group else "", group


def odd_texts():
    rng = random.Random(4)
    pieces = ["the ", "naïve", " \n\n", "漢字", "🎈", "</s>", "<|endoftext|>", "<0x41>", "  ", "\t", "antidisestablishment", "1234567", "\x00", "é", "don't", "-----", "ﬁ", "​", "\r\n"]
    return [None, "", " ", "a▁b", "<s>", "<unk>", "x" * 50, " " * 40] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + ["the cat sat on the mat"] * 5


def test_alignment_against_all_pairs_of_tokens(spark, paths, monkeypatch):
    monkeypatch.setattr(align, "BLOCK", 400)
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: tuple(r)[1:] for r in align.alignment(docs, *paths).collect()}
    groups = {r.doc_id: r.groups for r in align.groups(docs, *paths).collect()}
    for i, x in enumerate(brute(texts)):
        assert found[i] == x[:7] and groups[i] == x[7], texts[i]
    pairs = align.pair_counts(docs, *paths)
    assert pairs.agg(F.sum("count")).first()[0] == sum(x[3] for x in found.values()) and pairs.count() == pairs.select("a_id", "b_id").distinct().count()


def test_groups_are_components(paths):
    """The groups of hooks are the components of all overlapping pairs, by union-find one link at a time."""
    c, p = bpe.codec(paths[0]), align.pieces(paths[1])
    x = align.Block(c, p, [t or "" for t in odd_texts()])
    parent = list(range(len(x.a) + len(x.b)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in zip(x.link_a.tolist(), x.link_b.tolist(), strict=True):
        a, b = root(a), root(len(x.a) + b)
        parent[max(a, b)] = min(a, b)
    group = np.concatenate([x.group_a, x.group_b])
    by_root = {}
    for i, g in enumerate(group.tolist()):
        by_root.setdefault(root(i), set()).add(g)
    assert all(len(g) == 1 for g in by_root.values()) and len(by_root) == len(set(group.tolist())) == x.n_groups.sum()


def test_alignment_of_odd_rows_and_long_texts(spark, paths):
    rng = random.Random(2)
    long = "".join(rng.choice(["word", " ", "Wort", "\n", "é"]) for _ in range(40_000)) + "q" * 40_000
    extra = ", ".join(f"{n} int" for n in ("block", "pairs", "at", "times", "place", "count", "n_a", "pair"))
    rows = [(1, "a cat", *range(8)), (1, "a cat", *range(8)), (None, "a cat", *range(8)), (2, None, *range(8)), (3, long, *range(8))]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {extra}")
    found = align.alignment(df, *paths).collect()
    assert len(found) == 5 and len({tuple(r)[1:] for r in found if r.n_a == 2}) == 1 and sum(r.n_a == 2 for r in found) == 3
    assert next(r for r in found if r.doc_id == 2)[1:] == (0, 0, 0, 0, 0, 0, "")
    import tokenizers

    t = tokenizers.Tokenizer.from_file(paths[0])
    whole = next(r for r in found if r.doc_id == 3)
    assert whole.n_a == len(t.encode(" " + long, add_special_tokens=False).ids) and whole.n_links == whole.n_a + whole.n_b - whole.n_groups
    assert align.alignment(df.limit(0), *paths).count() == 0
