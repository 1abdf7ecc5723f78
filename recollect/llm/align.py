"""Alignment of two tokenizers' encodings of the same text.

Tokens of both are nodes, overlapping tokens are linked, and the components of that bipartite graph, by union-find, are
the minimal groups: the stretches between the places where tokens of both sides end. Every token but a group's first one
is hooked to the token of the other side that holds its first byte; these hooks are exactly the links, since of two
tokens that overlap one begins inside the other. Compression by doubling the paths then gives each node its root.

Pair counts are corpus-wide: documents are taken in blocks of bounded size, a block gives each of its id pairs once with its
number of links, Spark adds the blocks up, and what the pairs came to goes back to the blocks that hold them. So the rows
that meet at a pair are blocks, not links, and a block's documents and pairs fit a task whatever the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.bpe import LEAF, Codec, codec, halves
from recollect.llm.common import cut, values

BLOCK = 2 << 20  #: characters of a block of documents; a longer text is a block of its own


class Pieces:
    """Encoder of a sentencepiece model and its tokens' bytes; made once in each Python worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.token = [self._bytes(i) for i in range(self.size)]
        self.width = np.array([len(x) for x in self.token], dtype=np.int64)

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def ordinary(c: Codec, text: str) -> np.ndarray:
    """Ids of a text in which the strings of special tokens are plain text; long ones by their halves."""
    if len(text) <= LEAF:
        return np.frombuffer(c._plain(text), dtype="<u4")
    return c.tree([c.leaf(x) for x in halves(text, LEAF)]).ids


def roots(parent: np.ndarray) -> np.ndarray:
    """The root of every node of a forest given by parents (roots are their own)."""
    while True:
        further = parent[parent]
        if np.array_equal(further, parent):
            return parent
        parent = further


class Block:
    """Documents aligned at once: their tokens stand end to end, as ends of documents are ends of tokens on both sides."""

    def __init__(self, c: Codec, p: Pieces, texts: list[str]):
        first, second = [], []
        for text, b in zip(texts, p.encode(texts), strict=True):
            raw, a = b" " + text.encode(), ordinary(c, " " + text) if text else ()
            b = np.array(b, dtype=np.int64)
            same = text and b"".join(map(c.token.__getitem__, a.tolist())) == raw and b"".join(map(p.token.__getitem__, b.tolist())) == raw
            first.append(a if same else np.empty(0, dtype=np.int64))
            second.append(b if same else np.empty(0, dtype=np.int64))
        count = lambda x: np.array([len(y) for y in x], dtype=np.int64)
        self.n_a, self.n_b = count(first), count(second)
        self.a, self.b = (np.concatenate([*x, np.empty(0, dtype=np.int64)]).astype(np.int64) for x in (first, second))
        end_a, end_b = np.cumsum(c.width[self.a]), np.cumsum(p.width[self.b])
        start_a, start_b = end_a - c.width[self.a], end_b - p.width[self.b]
        n = len(self.a)
        holds_b = np.searchsorted(end_a, start_b, side="right")  # the A token that holds the first byte of each B token
        holds_a = np.searchsorted(end_b, start_a, side="right")
        first_of_group = start_b[holds_a] == start_a if n else np.empty(0, dtype=bool)
        parent = np.concatenate([np.where(first_of_group, np.arange(n), n + holds_a), holds_b])
        root = roots(parent)
        number = np.cumsum(first_of_group) - 1
        self.group_a, self.group_b = number[root[:n]], number[root[n:]]
        hooked = np.flatnonzero(~first_of_group)
        self.link_a, self.link_b = np.concatenate([holds_b, hooked]), np.concatenate([np.arange(len(self.b)), holds_a[hooked]])
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_groups = np.bincount(self.doc_a[first_of_group], minlength=len(texts))
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=len(texts))

    def written(self, names: list[bytes], size_a: int, size_b: int) -> list[bytes]:
        """The groups of each document as a1,a2|b1;a3|b2,b3; names are those of _names()."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (self.group_a, self.group_b))
        which = np.concatenate([self.a + size_a * last_a, self.b + 2 * size_a + size_b * last_b])
        order = np.argsort(np.concatenate([2 * self.group_a, 2 * self.group_b + 1]), kind="stable")
        token = list(map(names.__getitem__, which[order].tolist()))
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(token[i:j])[:-1] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def pairs(self, size_b: int, bits: int) -> tuple[np.ndarray, ...]:
        """Distinct (document, pair) in their order with their links, and the block's distinct pairs with theirs."""
        key = self.doc_a[self.link_a] << bits | self.a[self.link_a] * size_b + self.b[self.link_b]
        key, times = np.unique(key, return_counts=True)
        pair, at = np.unique(key & (1 << bits) - 1, return_inverse=True)
        total = np.bincount(at, weights=times, minlength=len(pair)).astype(np.int64)
        return np.searchsorted(key >> bits, np.arange(len(self.n_a) + 1)), at, times, pair, total


def _names(size_a: int, size_b: int) -> list[bytes]:
    """Decimal ids with the sign behind them: A inside and at the end of a group, then B likewise."""
    return [b"%d%s" % (i, sign) for size, signs in ((size_a, (b",", b"|")), (size_b, (b",", b";"))) for sign in signs for i in range(size)]


def _blocks(texts: Iterator[str | None]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _narrow(x: np.ndarray) -> bytes:
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, dtype="<u2" if len(x) == 2 * n else "<u4").astype(np.int64)


FIGURES = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
ALIGNED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("block", pa.int64()),
    ("n_pairs", pa.int32()), ("at", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64())),
])


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document with its pairs, as places in its block's list; a block's first row carries that list."""

    def run(batches):
        c, p = codec(path_a), pieces(path_b)
        names, bits = _names(c.size, p.size), (c.size * p.size).bit_length()
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, done = batch.column("doc_id").cast(pa.int64()), 0
            for texts in _blocks(values(batch.column("text"))):
                found, n = Block(c, p, texts), len(texts)
                digests = [hashlib.sha256(x).hexdigest() if x else "" for x in found.written(names, c.size, p.size)]
                cuts, at, times, pair, total = found.pairs(p.size, bits)
                spans = [slice(i, j) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                once = lambda x, n=n: pa.array([x.tolist()] + [None] * (n - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    ids[done : done + n], pa.array(found.n_a), pa.array(found.n_b), pa.array(found.n_groups), pa.array(found.n_links), pa.array(digests), pa.array([block] * n, pa.int64()),
                    pa.array(np.diff(cuts), pa.int32()), pa.array([_narrow(at[s]) for s in spans], pa.binary()), pa.array([_narrow(times[s]) for s in spans], pa.binary()), once(pair), once(total),
                ], schema=ALIGNED)
                done, block = done + n, block + 1

    return docs.select("doc_id", "text").mapInArrow(run, f"{FIGURES}, groups_sha256 string, block long, n_pairs int, at binary, times binary, pairs array<long>, totals array<long>")


def _block_pairs(rows: DataFrame) -> DataFrame:
    return rows.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("n"))


def _sizes(path_a: str, path_b: str) -> tuple[int, int]:
    return codec(path_a).size, pieces(path_b).size


def _counted(rows: DataFrame) -> DataFrame:
    return _block_pairs(rows).groupBy("pair").agg(F.sum("n").alias("count"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, count: how many links of the corpus hold each pair of ids."""
    size_b = _sizes(path_a, path_b)[1]
    return _counted(_aligned(docs, path_a, path_b)).select(F.expr(f"pair div {size_b}").alias("a_id"), F.expr(f"pair % {size_b}").alias("b_id"), "count")


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups of every row: its minimal groups, written a1,a2|b1;a3|b2,b3; empty without tokens."""

    def run(batches):
        c, p = codec(path_a), pieces(path_b)
        names = _names(c.size, p.size)
        for batch in batches:
            ids, done = batch.column("doc_id").cast(pa.int64()), 0
            for texts in _blocks(values(batch.column("text"))):
                found = Block(c, p, texts).written(names, c.size, p.size)
                yield pa.RecordBatch.from_arrays([ids[done : done + len(texts)], pa.array([x.decode() for x in found], pa.string())], names=["doc_id", "groups"])
                done += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, groups string")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    A is a byte-level vocabulary, which reads a space and the text; B is a sentencepiece model, which adds that space itself.
    Texts that are null or empty, or that either side's tokens don't spell byte for byte, have no tokens: zeros and an empty
    string. Ids may be null or repeat: each row gets its own figures, and counts once in the corpus. An empty table gives none.
    """
    rows = cut(_aligned(docs, path_a, path_b))
    size_b = _sizes(path_a, path_b)[1]
    counted = _counted(rows)
    # A row for each id of B's vocabulary at most: broadcast whatever the corpus.
    most = counted.groupBy(F.expr(f"pair % {size_b}").alias("b_id")).agg(F.max("count").alias("most"))
    scored = counted.join(F.broadcast(most), F.expr(f"pair % {size_b}") == F.col("b_id")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    looked = _block_pairs(rows).join(scored, "pair").select(F.col("block").alias("its_block"), "place", "count", "best")
    out = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(pairs.num_rows, dtype=np.int64), np.zeros(pairs.num_rows, dtype=np.int64)
        place = pairs.column("place").to_numpy()
        count[place], best[place] = pairs.column("count").to_numpy(), pairs.column("best").to_numpy()
        sums: list[tuple[int, int]] = []
        for n, at, times in zip(*(docs.column(k).to_pylist() for k in ("n_pairs", "at", "times")), strict=True):
            at, times = _wide(at, n), _wide(times, n)
            sums.append((int(times @ best[at]), int(times @ count[at])))
        figures = [docs.column(f.name).combine_chunks() for f in out if f.name in docs.column_names]
        return pa.Table.from_arrays([*figures[:5], pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.int64()), figures[5]], schema=out)

    kept = rows.drop("pairs", "totals")
    return kept.groupBy("block").cogroup(looked.groupBy("its_block")).applyInArrow(summed, f"{FIGURES}, n_best long, count_sum long, groups_sha256 string")
