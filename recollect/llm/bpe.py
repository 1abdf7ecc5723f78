"""Byte-level BPE encoding and decoding by tree concatenation, and its vocabulary.

Text longer than a leaf is cut in halves again and again; the leaves are encoded in parallel as Spark rows, and
neighbouring encodings are concatenated pairwise. Around each join two things are settled:

* The split into pieces. The left side's pieces are final except the last, which touches the join; re-splitting
  starts there and goes on until a piece border coincides with one of the right side's own. Splitting never looks
  back, so both sides agree from there on.
* A piece that spans the join (text without any split). A window of tokens on both sides is encoded again and
  doubled until its first token is the left side's and its last token the right side's. A token sequence is the
  BPE encoding of a piece exactly when every two neighbours are, so the spliced sequence is the exact encoding.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import row_key, values

LEAF = 32_768  #: characters of a leaf
WINDOW = 8  #: tokens on each side of a join that are encoded again at first

# The pattern that splits text before the merges, as the vocabulary was made with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Node:
    """An encoded stretch: its text, ids, and where its last piece starts (in characters)."""

    __slots__ = ("ids", "last", "text")

    def __init__(self, text: str, ids: np.ndarray, last: int):
        self.text, self.ids, self.last = text, ids, last


class Codec:
    """Encoder and decoder of one tokenizer file; made once in each Python worker."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max([*ranks.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for token, i in ranks.items():
            self.token[i] = token
        for token, i in self.special.items():
            self.token[i] = token.encode()
        self.width = np.array([len(x) for x in self.token], dtype=np.int64)
        self.pieces = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.border = regex.compile(r"(?r)(?<=\p{L}) (?=\p{L})")  # searched from the end

    def _plain(self, text: str) -> bytes:
        """Ids, little-endian, of a text without special tokens."""
        return array("I", self.bpe.encode_ordinary(text)).tobytes()

    def split(self, text: str) -> list[tuple[str, bool]]:
        """The text around its special tokens: (part, whether it is one)."""
        if not self.parts or not any(s in text for s in self.special):
            return [(text, False)]
        return [(x, x in self.special) for x in self.parts.split(text) if x]

    def leaf(self, text: str) -> Node:
        """The encoding of a stretch without special tokens."""
        start = m.start() if (m := self.border.search(text)) else 0
        last = start
        for m in self.pieces.finditer(text, start):
            last = m.start()
        return Node(text, np.frombuffer(self._plain(text), dtype="<u4"), last)

    def _piece(self, piece: str | bytes) -> list[int]:
        return self.bpe._encode_single_piece(piece)

    def _spanning(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of one piece from those of its two halves."""
        n = WINDOW
        while True:
            a, b = left[-n:], right[:n]
            new = self._piece(b"".join(self.token[i] for i in (*a.tolist(), *b.tolist())))
            whole_left, whole_right = n >= len(left), n >= len(right)
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]):
                return np.concatenate([left[: len(left) - len(a)], np.array(new, dtype="<u4"), right[len(b) :]])
            n *= 2

    def join(self, left: Node, right: Node) -> Node:
        """The encoding of two neighbouring stretches together."""
        if not left.text or not right.text:
            return right if not left.text else left
        text, cut = left.text[left.last :] + right.text, len(left.text) - left.last
        own = (m.end() + cut for m in self.pieces.finditer(right.text))
        true = ((m.start(), m.end()) for m in self.pieces.finditer(text))
        spans, owns, end = [], 0, -1
        for span in true:
            spans.append(span)
            while end < span[1]:
                end = next(own)
                owns += 1
            if end == span[1]:
                break
        kept = int(np.searchsorted(np.cumsum(self.width[left.ids]), len(left.text[: left.last].encode()), side="right"))
        gone = int(np.searchsorted(np.cumsum(self.width[right.ids]), len(right.text[: end - cut].encode()), side="right"))
        if len(spans) == 1 and owns == 1 and kept < len(left.ids):
            middle = self._spanning(left.ids[kept:], right.ids[:gone])
        else:
            middle = np.array([i for a, b in spans for i in self._piece(text[a:b])], dtype="<u4")
        ids = np.concatenate([left.ids[:kept], middle, right.ids[gone:]])
        last = right.last + len(left.text) if end - cut <= right.last else spans[-1][0] + left.last
        return Node(left.text + right.text, ids, last)

    def tree(self, nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [self.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def encode(self, text: str, leaf: int = LEAF) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        out = []
        for part, special in self.split(text):
            if special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            elif len(part) <= leaf:
                out.append(self._plain(part))
            else:
                out.append(self.tree([self.leaf(x) for x in halves(part, leaf)]).ids.astype("<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace")


def halves(text: str, leaf: int) -> list[str]:
    """The text cut in halves until none is longer than a leaf."""
    if len(text) <= leaf:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], leaf) + halves(text[mid:], leaf)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digest(c: Codec, ids: bytes) -> tuple[int, str, str]:
    found = np.frombuffer(ids, dtype="<u4").tolist()
    csv = hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
    return len(found), csv, hashlib.sha256(c.decode(found).encode()).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _rows(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def encode_documents(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, text, ids (binary, little-endian unsigned 32-bit), n_tokens of every row.

    Null texts count as empty (no ids). Ids may be null or repeat; rows repeating id and text are each returned.
    Texts longer than a leaf are encoded in parts by several tasks and joined again; one text's ids meet in one row.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, text string, ids binary, n_tokens long"
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary()), ("n_tokens", pa.int64())])

    def short(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t, leaf) for t in values(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], schema=out)

    return rows.where(F.length("text") <= leaf).mapInArrow(short, schema).unionByName(_long(rows.where(F.length("text") > leaf), path, leaf, schema))


def _long(rows: DataFrame, path: str, leaf: int, schema: str) -> DataFrame:
    parts_schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32()), ("leaf", pa.int32()), ("special", pa.bool_()), ("text", pa.string())])
    node_schema = "key long, doc_id long, part int, leaf int, special boolean, text string, ids binary, last int, copies long"

    def cut_up(batches):
        c = codec(path)
        for batch in batches:
            for key, doc_id, text in zip(batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cuts = [(i, j, special, x) for i, (part, special) in enumerate(c.split(text)) for j, x in enumerate(halves(part, leaf))]
                yield _rows({"key": [key] * len(cuts), "doc_id": [doc_id] * len(cuts), "part": [x[0] for x in cuts], "leaf": [x[1] for x in cuts], "special": [x[2] for x in cuts], "text": [x[3] for x in cuts]}, parts_schema)

    def encode(batches):
        c = codec(path)
        for batch in batches:
            nodes = [_leaf(c, t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("special").to_pylist(), strict=True)]
            columns = [batch.column(n) for n in ("key", "doc_id", "part", "leaf", "special", "text")]
            names = ["key", "doc_id", "part", "leaf", "special", "text", "ids", "last", "copies"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[0] for x in nodes], pa.binary()), pa.array([x[1] for x in nodes], pa.int32()), batch.column("copies")], names=names)

    def joined(table: pa.Table) -> pa.Table:
        c = codec(path)
        found = table.sort_by([("part", "ascending"), ("leaf", "ascending")]).to_pylist()
        out, text, group = [], [], []
        for i, x in enumerate(found):
            text.append(x["text"])
            if x["special"]:
                out.append(x["ids"])
                continue
            group.append(Node(x["text"], np.frombuffer(x["ids"], dtype="<u4"), x["last"]))
            if i + 1 == len(found) or found[i + 1]["part"] != x["part"]:
                out.append(c.tree(group).ids.astype("<u4").tobytes())
                group = []
        ids, n = b"".join(out), found[0]["copies"]
        return pa.table({"doc_id": pa.array([found[0]["doc_id"]] * n, pa.int64()), "text": pa.array(["".join(text)] * n, pa.string()), "ids": pa.array([ids] * n, pa.binary()), "n_tokens": pa.array([len(ids) // 4] * n, pa.int64())})

    keyed = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    leaves = keyed.mapInArrow(cut_up, "key long, doc_id long, part int, leaf int, special boolean, text string")
    # Rows repeating id and text share a key: their leaves are encoded once and the result is returned for each.
    leaves = leaves.groupBy("key", "doc_id", "part", "leaf", "special", "text").agg(F.count("*").alias("copies"))
    return leaves.mapInArrow(encode, node_schema).groupBy("key", "doc_id").applyInArrow(joined, schema)


def _leaf(c: Codec, text: str, special: bool) -> tuple[bytes, int]:
    if special:
        return np.array([c.special[text]], dtype="<u4").tobytes(), 0
    node = c.leaf(text)
    return node.ids.tobytes(), node.last


def round_trip(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of every document's ids (decimal, comma-joined) and of the text decoded from them."""
    encoded = encode_documents(docs, path, leaf).select("doc_id", "ids")
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batches):
        c = codec(path)
        for batch in batches:
            found = [_digest(c, x) for x in batch.column("ids").to_pylist()]
            yield _rows({"doc_id": batch.column("doc_id").to_pylist(), "n_tokens": [x[0] for x in found], "ids_sha256": [x[1] for x in found], "decoded_sha256": [x[2] for x in found]}, out)

    return encoded.mapInArrow(digest, "doc_id long, " + DIGEST)
