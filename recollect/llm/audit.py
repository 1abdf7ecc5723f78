"""How document filters interact: what each removes first, removes too, or would remove alone, in every order.

Five filters read a whole text; the last one, exact duplicates, needs the table. Rows are range-sorted by text
fingerprint, text and doc_id, and each is compared with its predecessor. Copies of one text lie next to each other
and may fill any number of partitions: bounds are drawn over fingerprint and doc_id, so a text that a third of
all rows repeat is split like any other stretch. Only the first run of a partition can continue its predecessor's; the
run at each end of a partition gives one record, and records of the same text tell the smallest doc_id of such a run.

Failures become a bit mask, and counts of (part, mask) are additive: at most 32 of them in a part. All orders are
read from those.
"""

from __future__ import annotations

import json
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut, release, values

FILTERS = "ABCDE"  #: few words, few different words, many capitals, odd signs, copy of a smaller doc_id
FEW_WORDS = 50  #: A: fewer words than this
DIFFERENT = 65  #: B: fewer different words than this share of the words, in hundredths
CAPITALS = 5  #: C: more capitals than this share of the code points, in hundredths
SIGNS = b"#$%&*|"  #: D: any of these
UPPER = bytes(range(65, 91))
NEVER = np.iinfo(np.int64).max


def text_failures(text: str) -> int:
    """Bits of the filters A to D that a text fails. bytes.split() parts words at exactly \\x20 and \\x09-\\x0D."""
    raw = text.encode()
    words = raw.split()
    n, capitals = len(words), len(raw) - len(raw.translate(None, UPPER))
    few, same = n < FEW_WORDS, 100 * len(set(words)) < DIFFERENT * n
    return few | same << 1 | (100 * capitals > CAPITALS * len(text)) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3


ROWS = pa.schema([("part", pa.string()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("piece", pa.int32()), ("head", pa.bool_()), ("print", pa.binary()), ("least", pa.int64())])


def _compared(batches):
    """Masks of sorted rows, and the records of the first and the last run of this partition."""
    piece, held, least, head, first = TaskContext.get().partitionId(), None, NEVER, True, None
    seen = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text, ids = batch.column("text"), batch.column("doc_id").cast(pa.int64())
        known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        numbers = pc.fill_null(ids, NEVER).to_numpy(zero_copy_only=False)
        begins = np.ones(n, dtype=bool)
        begins[0] = held is None or not pc.equal(text[0], held).as_py()
        begins[1:] = ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        run = np.cumsum(begins)
        smallest = np.concatenate([[least], numbers[begins]])  # ids rise within a run, so its first is its smallest
        copy = known & (numbers > smallest[run])
        if held is None:
            heads = run == 1
        else:
            heads = (run == 0) & head
        if head and run[-1] > (held is None):
            first, head = (seen, least) if held is not None else (batch.column("print")[0].as_py(), int(smallest[1])), False
        held, least, seen = text[n - 1], int(smallest[-1]), batch.column("print")[n - 1].as_py()
        mask = np.fromiter(map(text_failures, values(text)), dtype=np.int32, count=n) | copy.astype(np.int32) << 4
        yield pa.RecordBatch.from_arrays([batch.column("part"), ids, pa.array(mask, pa.int32()), pa.array([piece] * n, pa.int32()), pa.array(heads), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=ROWS)
    if held is not None:
        ends = [(first or (seen, least), True), ((seen, least), False)]
        known = [None if x[1] == NEVER else x[1] for x, _ in ends]
        yield pa.RecordBatch.from_arrays([pa.nulls(2, pa.string()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32()), pa.array([piece] * 2, pa.int32()), pa.array([x for _, x in ends]), pa.array([x[0] for x, _ in ends], pa.binary()), pa.array(known, pa.int64())], schema=ROWS)


def failures(docs: DataFrame, part: str = "source") -> DataFrame:
    """part, doc_id, mask of every row: bit i is set where the row fails filter i of FILTERS.

    A null text is empty and a null part the empty string. A row is a copy (E) where another row has its text and a
    smaller doc_id; rows that repeat id and text don't make each other copies, and null ids neither are copies nor
    make any.
    """
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.unhex(F.sha2("text", 256)))
    # Bounds are sampled over forty bytes a row: the driver never sees texts.
    dealt = rows.repartitionByRange("print", F.asc_nulls_last("doc_id")).sortWithinPartitions("print", "text", F.asc_nulls_last("doc_id"))
    found = cut(dealt.mapInArrow(_compared, "part string, doc_id long, mask int, piece int, head boolean, print binary, least long"))
    ends = found.where("mask is null")
    # One record for each partition at most: bounded by their number, so it may be broadcast.
    least = ends.groupBy(F.col("print").alias("its_print")).agg(F.min("least").alias("its_least"))
    first = ends.where("head").join(least, F.col("print") == F.col("its_print")).select(F.col("piece").alias("its_piece"), "its_least")
    rows = found.where("mask is not null").join(F.broadcast(first), F.col("head") & (F.col("piece") == F.col("its_piece")), "left")
    late = F.when(F.col("doc_id") > F.col("its_least"), 16).otherwise(0)
    rows = rows.select("part", "doc_id", F.col("mask").bitwiseOR(late).alias("mask"))
    rows.written_to = found.written_to
    return rows


def counters(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: additive counts, to be summed over any split of the rows.

    A row is good (toxic) where any label row of its id has quality (toxic) 1.
    """
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("its_doc")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = failed.join(marks, F.col("doc_id") == F.col("its_doc"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return marked.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from the counters of counters().

    Columns: part, filter_order, step, and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    steps = [
        {"filter_order": "".join(o), "step": k + 1, "bit": 1 << filters.index(f), "before": sum(1 << filters.index(x) for x in o[:k])}
        for o in permutations(filters) for k, f in enumerate(o)
    ]
    orders = 1
    for k in range(2, len(filters) + 1):
        orders *= k
    cells = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2 ** len(filters) cells at most
    each = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = cells.select("part", "cells", F.inline(each))
    add = lambda what, when: F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({when}, {what}, 0L))")
    fails, gone = "(c.mask & bit) <> 0", "(c.mask & before) <> 0"
    here = f"{fails} and not {gone}"
    # In every order exactly one of the filters that a row fails removes it, and each of them equally often.
    return rows.select(
        "part", "filter_order", "step",
        add("c.n", f"not {gone} and not {fails}").alias("kept"), add("c.n", here).alias("removed"), add("c.n", f"{fails} and {gone}").alias("redundant"),
        add("c.n", "c.mask = bit").alias("unique_fails"), add("c.good", here).alias("good_lost"), add("c.toxic", here).alias("toxic_lost"),
        add(f"c.n * {orders} div greatest(bit_count(c.mask), 1)", fails).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of FILTERS over whole texts, by source: 600 rows a part, none for an empty table."""
    failed = failures(docs)
    counted = cut(counters(failed, labels))
    release(failed)
    return interactions(counted)
