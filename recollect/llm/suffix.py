"""Repeated passages by a sparse suffix array over words.

Suffixes are kept only where content selects them: each window of min_words words is given to the place of the
smallest fingerprint of 8 words among the 16 that begin first in it. Equal windows thus select the same place. The
suffix of a place begins with 35 words (of 50) that all its windows hold; to the left of it, up to 15 words more.

1. The suffixes, as fingerprints of their first 35 words and of all that their windows hold, are dealt out by the
   first and sorted, so equal ones are neighbours. Two neighbours equal in both have all their windows in common.
2. Runs of neighbours that begin alike but differ in what surrounds it (to the left or right) are extended to both
   sides: one member of each kind has all its windows of min_words words compared, a window for each number of words to
   the left. Comparing with the next neighbour alone would miss partners that differ from it to the left.
3. The stretches of a text are merged. Every window belongs to one place, so a passage of min_words words or more is
   reported if and only if it repeats, from its first word to its last.

A task tells which of its suffixes (or windows) are equal within a stretch of text; only the first of them goes to the
partition of its fingerprint, so passages that very many texts share don't fill one partition. Texts that occur
several times are handled once and reported as repeated from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut, release, sieved
from recollect.llm.words import blocks, mix, odd_multipliers, power_tables, words

GRAM, AMONG = 8, 16  #: words of a fingerprint, successive fingerprints of which the smallest is selected
MIN_WORDS = 50
_HELD = 1 << 16  #: rows of one fingerprint that are held until its next ones come
_ALONE, _FIRST, _FURTHER = 0, 1, 2  #: whether equals were met within a stretch of text
_DOC, _WHOLE, _OPEN = 0, 1, 2  #: rows of the sorted suffixes: a document, a stretch that repeats, a place to be extended


class _Stretch:
    """The words of a block of texts, with fingerprints of any of their runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hashes, _, _, first = words(data, offsets)
        self.first = np.append(first[:-1], len(self.hashes))
        power, self._inverse = power_tables(len(self.hashes) + 1)
        self._sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * power[: len(self.hashes)], out=self._sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._inverse[begin] + (end - begin).astype(np.uint64)).view(np.int64)

    def places(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first window, number of windows, place) of the selected places, in words of the block."""
        n = len(self.hashes) - min_words + 1
        none = np.zeros(0, dtype=np.int64)
        if n < 1:
            return none, none, none, none
        grams = np.zeros(len(self.hashes) - GRAM + 1, dtype=np.uint64)
        for j, m in enumerate(odd_multipliers(GRAM, 31)):
            grams += self.hashes[j : j + len(grams)] * m
        grams = mix(grams)
        starts = np.arange(n)
        text = np.searchsorted(self.first, starts, side="right") - 1
        inside = starts + min_words <= self.first[text + 1]
        place = starts + np.lib.stride_tricks.sliding_window_view(grams, AMONG)[:n].argmin(axis=1)
        starts, text, place = starts[inside], text[inside], place[inside]
        if not len(starts):
            return none, none, none, none
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        return text[new], starts[new], np.diff(np.append(new, len(starts))), place[new]


def _met_here(key: np.ndarray, tid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, each place once; whether others have the same key) of a block."""
    order = np.lexsort((at, tid, key))
    key, tid, at = key[order], tid[order], at[order]
    again = np.concatenate([[False], (key[1:] == key[:-1]) & (tid[1:] == tid[:-1]) & (at[1:] == at[:-1])])[: len(key)]
    order, key = order[~again], key[~again]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    more = np.concatenate([~new[1:], [False]])[: len(key)]
    return order, np.where(new, np.where(more, _FIRST, _ALONE), _FURTHER).astype(np.int8)


def _suffixes(rows: DataFrame, min_words: int) -> DataFrame:
    """h, big, tid, at, local of every place: at is the first window times 256 plus the number of windows; -1 less the words for a document's own row, big its id."""
    need = min_words - AMONG + 1

    def made(batches):
        for batch in batches:
            ids, tids = batch.column("doc_id"), batch.column("tid").to_numpy()
            for i, data, offsets in blocks(batch.column("text")):
                seen = _Stretch(data, offsets)
                text, lo, n, place = seen.places(min_words)
                h, big = seen.of(place, place + need), seen.of(lo, lo + n - 1 + min_words)
                tid, at = tids[text + i], (lo - seen.first[text]) << 8 | n
                keep, local = _met_here(big, tid, at)
                size = len(offsets) - 1
                own = pa.array(tids[i : i + size])
                yield pa.RecordBatch.from_arrays([own, ids.slice(i, size), own, pa.array(-1 - np.diff(seen.first)), pa.array(np.full(size, _FURTHER, dtype=np.int8))], names=["h", "big", "tid", "at", "local"])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[keep], big[keep], tid[keep], at[keep], local)], names=["h", "big", "tid", "at", "local"])

    return rows.mapInArrow(made, "h long, big long, tid long, at long, local byte")


def _runs(min_words: int):
    """A pass over sorted suffixes that tells documents, stretches that repeat and places to be extended (kind, tid, x, y)."""

    def rows(kind: int, tid, x, y) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tid), kind, dtype=np.int8)), pa.array(tid), pa.array(x), pa.array(y)], names=["kind", "tid", "x", "y"])

    def whole(tid, at) -> pa.RecordBatch:
        lo, n = at >> 8, at & 255
        return rows(_WHOLE, tid, lo, lo + n - 1 + min_words)

    def told(h, big, tid, at, local, known: bool) -> Iterator[pa.RecordBatch]:
        """known: the first fingerprint's run has had another kind before."""
        if not len(h):
            return
        kind = np.concatenate([[True], (h[1:] != h[:-1]) | (big[1:] != big[:-1])])
        start = np.flatnonzero(kind)
        of = np.cumsum(kind) - 1
        place = np.concatenate([[True], (of[1:] != of[:-1]) | (tid[1:] != tid[:-1]) | (at[1:] != at[:-1])])
        equal = (np.add.reduceat(place.astype(np.int64), start) > 1) | (np.maximum.reduceat(local, start) > 0)
        repeats = np.flatnonzero(equal[of] & place)
        yield whole(tid[repeats], at[repeats])
        run = np.concatenate([[True], h[start][1:] != h[start][:-1]])
        first = np.flatnonzero(run)
        several = np.diff(np.append(first, len(start))) > 1
        several[0] |= known
        opened = start[several[np.cumsum(run) - 1]]
        yield rows(_OPEN, tid[opened], at[opened], equal[of[opened]].astype(np.int64))

    def passed(batches):
        held, known = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.int8)], False
        for batch in batches:
            doc = np.asarray(batch.column("at")) < 0
            if doc.any():
                docs = batch.filter(pa.array(doc))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), _DOC, dtype=np.int8)), docs.column("tid"), pa.array(-1 - docs.column("at").to_numpy()), docs.column("big")], names=["kind", "tid", "x", "y"])
            batch = batch.filter(pa.array(~doc))
            h, big, tid, at, local = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("h", "big", "tid", "at", "local"))
            away = local == _FURTHER
            if away.any():
                yield whole(tid[away], at[away])
            held = [np.concatenate([a, b[~away]]) for a, b in zip(held, (h, big, tid, at, local), strict=True)]
            if not len(held[0]):
                continue
            cut_at = int(np.searchsorted(held[0], held[0][-1]))
            if cut_at:
                yield from told(*(x[:cut_at] for x in held), known)
                held, known = [x[cut_at:] for x in held], False
            if len(held[0]) > _HELD:  # a long run goes on: all kinds but the last are told, of the last one place stays
                last = len(held[1]) - 1 - int(np.argmax((held[1] != held[1][-1])[::-1])) if (held[1] != held[1][-1]).any() else -1
                if last >= 0:
                    known = True
                    yield from told(*(x[: last + 1] for x in held), True)
                    held = [x[last + 1 :] for x in held]
                if len(held[0]) > _HELD:
                    yield whole(held[2], held[3])
                    held = [x[:1] for x in held]
                    held[4] = np.full(1, _FIRST, dtype=np.int8)
        yield from told(*held, known)

    return passed


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """w, tid, at, local of the windows of the places that are extended: at is twice the window's first word, plus 1 if it is known to repeat."""

    def made(batches):
        for batch in batches:
            tids, places = batch.column("tid").to_numpy(), batch.column("at")
            for i, data, offsets in blocks(batch.column("text")):
                seen = _Stretch(data, offsets)
                own = places.slice(i, len(offsets) - 1)
                packed = own.flatten().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths()))
                settled, n, lo = packed & 1, packed >> 1 & 255, packed >> 9
                which = np.repeat(np.arange(len(packed)), n)
                begin = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = begin + seen.first[text[which]]
                w, tid, at = seen.of(start, start + min_words), tids[text[which] + i], begin << 1 | settled[which]
                keep, local = _met_here(w, tid, at)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w[keep], tid[keep], at[keep], local)], names=["w", "tid", "at", "local"])

    return texts.mapInArrow(made, "w long, tid long, at long, local byte")


def _same_windows(min_words: int):
    """A pass over sorted windows that tells those that occur at another place too (tid, x, y)."""

    def stretches(tid, at) -> pa.RecordBatch:
        new = (at & 1) == 0
        return pa.RecordBatch.from_arrays([pa.array(tid[new]), pa.array(at[new] >> 1), pa.array((at[new] >> 1) + min_words)], names=["tid", "x", "y"])

    def told(w, tid, at, local):
        if not len(w):
            return
        start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        of = np.cumsum(np.concatenate([[True], w[1:] != w[:-1]])) - 1
        place = np.concatenate([[True], (of[1:] != of[:-1]) | (tid[1:] != tid[:-1]) | (at[1:] >> 1 != at[:-1] >> 1)])
        equal = (np.add.reduceat(place.astype(np.int64), start) > 1) | (np.maximum.reduceat(local, start) > 0)
        yield stretches(tid[equal[of]], at[equal[of]])

    def passed(batches):
        held = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int8)]
        for batch in batches:
            w, tid, at, local = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("w", "tid", "at", "local"))
            away = local == _FURTHER
            if away.any():
                yield stretches(tid[away], at[away])
            held = [np.concatenate([a, b[~away]]) for a, b in zip(held, (w, tid, at, local), strict=True)]
            if not len(held[0]):
                continue
            cut_at = int(np.searchsorted(held[0], held[0][-1]))
            yield from told(*(x[:cut_at] for x in held))
            held = [x[cut_at:] for x in held]
            if len(held[0]) > _HELD and ((held[1] != held[1][0]) | (held[2] >> 1 != held[2][0] >> 1) | (held[3] > 0)).any():
                yield stretches(held[1], held[2])
                held = [x[:1] for x in held]
                held[3] = np.full(1, _FIRST, dtype=np.int8)
        yield from told(*held)

    return passed


def _merged(min_words: int):
    """A pass that makes spans (from, to) of the stretches of each text, packed as from * 2^32 + to."""
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def merged(batches):
        for batch in batches:
            out = []
            for packed in batch.column("stretches"):
                x = np.unique(packed.values.to_numpy(zero_copy_only=False))
                begin, end = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                last = np.append(new[1:], len(x)) - 1
                out.append([{"from": a, "to": b} for a, b in zip(begin[new].tolist(), end[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(out, kind)], names=["tid", "spans"])

    return merged


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_spans, repeated_words, spans of every row.

    Spans are start:end in words (runs without space and \\x09-\\x0D, A-Z lower-cased; end exclusive), comma-joined:
    all passages of min_words words or more that occur elsewhere too, in the same text or another, joined where they
    touch. Null and empty texts have no words; rows that repeat a text, with the same id or not, are copies of each other.
    """
    if min_words - AMONG + 1 < GRAM:
        raise ValueError(f"min_words must be {GRAM + AMONG - 1} at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.xxhash64("text"))
    suffixes = _suffixes(rows, min_words)
    # Rows that were settled in their task go to any partition.
    dealt = suffixes.repartition(F.when(F.col("local") == _FURTHER, F.xxhash64("tid", "at")).otherwise(F.col("h"))).sortWithinPartitions("h", "big", "tid", "at")
    found = cut(dealt.mapInArrow(_runs(min_words), "kind byte, tid long, x long, y long"))
    of_docs = found.where(F.col("kind") == _DOC).select(F.col("y").alias("doc_id"), "tid", F.col("x").alias("n_words"))
    texts = cut(of_docs.groupBy("tid").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))

    packed = F.shiftleft("x", 1).bitwiseOR(F.col("y"))
    opened = found.where(F.col("kind") == _OPEN).groupBy("tid").agg(F.collect_list(packed).alias("at"))
    opened = cut(opened.join(texts, "tid").select(F.col("tid").alias("its_tid"), "rep", "at"))
    holding = sieved(rows, F.col("tid"), opened, "its_tid", "held").where("held")
    holding = holding.join(opened, (F.col("tid") == F.col("its_tid")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("tid", "text", "at")
    windows = _windows(holding, min_words)
    dealt = windows.repartition(F.when(F.col("local") == _FURTHER, F.xxhash64("tid", "at")).otherwise(F.col("w"))).sortWithinPartitions("w", "tid", "at")
    extended = cut(dealt.mapInArrow(_same_windows(min_words), "tid long, x long, y long"))
    release(opened)

    stretches = found.where(F.col("kind") == _WHOLE).select("tid", "x", "y").unionByName(extended)
    stretches = stretches.groupBy("tid").agg(F.collect_list(F.shiftleft("x", 32).bitwiseOR(F.col("y"))).alias("stretches"))
    spans = cut(stretches.mapInArrow(_merged(min_words), "tid long, spans array<struct<`from`:int,`to`:int>>"))
    of_docs = cut(of_docs)
    release(found, extended)

    result = of_docs.join(texts.select("tid", "copies").join(spans, "tid", "left"), "tid")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("to")))
    none = F.array().cast("array<struct<from:int,to:int>>")
    spans = F.when((F.col("copies") > 1) & (F.col("n_words") >= min_words), whole).otherwise(F.coalesce("spans", none))
    result = result.select("doc_id", "n_words", spans.alias("s"))
    length = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    written = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["from"].cast("string"), x["to"].cast("string"))), ",")
    return result.select("doc_id", "n_words", F.size("s").cast("long").alias("n_spans"), length.alias("repeated_words"), written.alias("spans"))
