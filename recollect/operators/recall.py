"""The whole recall of one question: lanes, fusion, bridge over shared atoms, filters, drift, overlap, graph lane, prefilter, anchors,
separation, limit.

Lanes give at most some hundred ids. These are joined with the memories first, so texts are read for them alone and
never shuffled; statuses, partners and the newest copies of a text come from tables keyed by id, atom or fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import fusion, lexical
from recollect.operators.atoms import extract, weighed
from recollect.operators.graph import settled

ANCHORS, PARTNERS = 5, 16  #: best hits that bridge, partners of each
HEAD, NEIGHBOURS = 3, 32  #: first hits whose neighbours pass the prefilter, neighbours of each
SEEDS, REACHED, PROTECTED = 5, 15, 0.55  #: of the graph lane: hits it starts from, memories it adds, how sure a hit is that keeps its place
# Words that name something even in a short question.
DOMAIN = frozenset("cluster node ssh kerberos slurm cmake build compile chaos bge embed".split())


@dataclass(frozen=True)
class Asked:
    question: str
    limit: int = 10
    window: tuple[Column | int, Column | int] | None = None  #: microseconds, from and before
    tag: str | None = None
    realm: str | None = None
    pool: int = 60  #: rows that the prefilter looks at
    budget: int = 24
    graph: bool = False  #: whether memories join that only the graph of shared atoms reaches
    separate: bool = False  #: whether likenesses among the hits count against them

    @property
    def depth(self) -> int:
        depth = max(min(max(20, 2 * self.limit), 160), min(self.pool, 160))
        return max(8 * self.limit, depth) if self.tag else depth


@dataclass
class Store:
    """What a recall reads beside the lanes."""

    memories: DataFrame  #: memory_id, kind, realm, content
    describe: Callable[[DataFrame], DataFrame]  #: adds status, access, created (microseconds) to rows with memory_id and content
    partners: Callable[[DataFrame, int], DataFrame]  #: anchors (memory_id), how many: anchor, memory_id, w, place
    n: DataFrame  #: one row: the number of memories


def plain_store(memories: DataFrame) -> Store:
    """A store of memories that have status, access and created themselves; their atoms are found when they are asked for."""
    n = memories.agg(F.count("*").alias("n"))
    atoms = extract(memories.select("memory_id", F.col("content").alias("text"))).select("memory_id", "class", "atom")

    def partners(anchors: DataFrame, most: int) -> DataFrame:
        own = atoms.join(F.broadcast(anchors.select("memory_id")), "memory_id").select(F.col("memory_id").alias("anchor"), "class", "atom")
        return weighed(own, atoms, n, most)

    own = memories.select("memory_id", "status", "access", "created")
    return Store(memories.select("memory_id", "kind", "realm", "content"), lambda rows: rows.join(own, "memory_id"), partners, n)


def multi_lane(question: str, domain: frozenset[str] = DOMAIN) -> bool:
    """Whether a question names enough to be asked in several lanes."""
    low = question.lower()
    return len(question) >= 8 and (len(question) > 15 or "-" in question or any(c.isupper() for c in question) or any(w in low for w in domain))


def _hits(asked: Asked, store: Store, fused: DataFrame) -> DataFrame:
    """The memories of fused ids that may be answers, with what is known of them."""
    # Few ids against all memories: texts of the others don't leave the scan.
    found = store.describe(settled(store.memories.join(F.broadcast(fused), "memory_id").where(F.length("content") > 0)))
    if asked.window is not None:
        found = found.where((F.col("created") >= asked.window[0]) & (F.col("created") < asked.window[1]))
    return found if asked.realm is None else found.where(F.col("realm") == asked.realm)


def _bridged(fused: DataFrame, store: Store) -> DataFrame:
    """fused with the partners of its best: each anchor ranks its partners as a lane of its own; the rarer the shared atoms, the larger the boost."""
    best = fused.orderBy(F.desc("score"), "memory_id").limit(ANCHORS)
    met = store.partners(best, PARTNERS).join(F.broadcast(store.n))
    added = met.groupBy("memory_id").agg(F.sum(1 / (fusion.RRF_K + F.col("place"))).alias("added"), F.max(F.least(F.lit(1.0), F.col("w") / F.log(F.col("n") + 1))).alias("boost"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return fused.join(added, "memory_id", "full").select("memory_id", F.round(zero(F.col("score")) + zero(F.col("added")), 9).alias("score"), zero(F.col("boost")).alias("boost"))


def _graphed(asked: Asked, store: Store, hits: DataFrame, sure: DataFrame) -> DataFrame:
    """hits with those that the graph of shared atoms reaches from the first ones; hits that are sure enough keep their place ahead.

    sure is memory_id, cosine. The graph has SEEDS nodes, their partners and the partners of these: bounded, so its ranks are
    worked out in one task.
    """
    seeds = hits.where(F.col("rank") <= SEEDS)
    near = settled(store.partners(seeds, PARTNERS))
    far = store.partners(near.select("memory_id").distinct().join(seeds, "memory_id", "left_anti"), PARTNERS)
    edges = near.unionByName(far).select("anchor", "memory_id", "w", F.lit(0.0).alias("seed"))
    rows = edges.unionByName(seeds.select(F.col("memory_id").alias("anchor"), "memory_id", F.lit(0.0).alias("w"), F.greatest("score", F.lit(1e-6)).alias("seed")))

    def ranks(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*rows["anchor"], *rows["memory_id"]})
        at = {x: i for i, x in enumerate(nodes)}
        weight = [[0.0] * len(nodes) for _ in nodes]
        start = [0.0] * len(nodes)
        for a, b, w, seed in rows[["anchor", "memory_id", "w", "seed"]].itertuples(index=False):
            weight[at[a]][at[b]] = weight[at[b]][at[a]] = max(w, weight[at[a]][at[b]])
            start[at[a]] += seed
        out, total = [sum(x) for x in weight], sum(start)
        start = [x / total for x in start]
        score = list(start)
        for _ in range(30):
            lost = sum(s for s, o in zip(score, out, strict=True) if o == 0)
            score = [0.15 * start[j] + 0.85 * (lost * start[j] + sum(score[i] * weight[i][j] / out[i] for i in range(len(nodes)) if weight[i][j])) for j in range(len(nodes))]
        lane = sorted(range(len(nodes)), key=lambda i: (-round(score[i], 9), nodes[i]))[:REACHED]
        return pd.DataFrame({"memory_id": [nodes[i] for i in lane], "place": range(1, len(lane) + 1)})

    lane = settled(rows.groupBy().applyInPandas(ranks, "memory_id long, place int"))
    new = _hits(asked, store, lane.join(hits, "memory_id", "left_anti").select("memory_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("boost"))).where("content not like '[gap]%'")
    new = new.withColumn("overlap", lexical.term_overlap(F.col("content"), asked.question)).withColumn("rank", F.lit(None).cast("long"))
    every = hits.unionByName(new.select(hits.columns)).join(F.broadcast(lane), "memory_id", "left").join(F.broadcast(sure), "memory_id", "left")
    part = lambda c: F.coalesce(1.0 / (fusion.RRF_K + F.col(c)), F.lit(0.0))
    every = every.withColumn("score", F.round(part("rank") + part("place"), 9)).withColumn("ahead", F.coalesce(fusion.calibrated(F.col("cosine")) >= PROTECTED, F.lit(False)) & F.col("rank").isNotNull())
    order = Window.orderBy(F.desc("ahead"), F.when(F.col("ahead"), F.col("rank")), F.desc("score"), F.desc("memory_id"))
    return every.withColumn("rank", F.row_number().over(order).cast("long")).select(hits.columns)


def recall(asked: Asked, store: Store | DataFrame, lanes: list[tuple[DataFrame, float]], tagged: DataFrame | None = None, sure: DataFrame | None = None) -> DataFrame:
    """memory_id, score, rank: the answer to a question.

    Lanes are (memory_id, rank) with their weight; tagged holds the ids with the tag asked for; sure (memory_id, cosine) tells
    the graph lane which hits keep their place. Windows are over one question's hits.
    """
    store = store if isinstance(store, Store) else plain_store(store)
    rows = None
    for lane, weight in lanes:
        part = lane.select("memory_id", (F.lit(float(weight)) / (fusion.RRF_K + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = settled(rows.groupBy("memory_id").agg(F.round(F.sum("part"), 9).alias("score")))
    every = Window.partitionBy(F.lit(0))
    pool = _hits(asked, store, _bridged(fused, store)).orderBy(F.desc("score"), F.desc("memory_id")).limit(asked.depth)
    most = F.max("score").over(every)
    hits = pool.withColumn("score", F.when(most > 0, F.col("score") / most).otherwise(F.col("score"))).where("content not like '[gap]%'")
    if tagged is not None:
        hits = settled(hits.join(tagged, "memory_id", "left_semi"))
        # Without a hit that has the tag, memories with it are taken as they are.
        none = hits.agg((F.count("*") == 0).alias("none"))
        direct = _hits(asked, store, tagged.select("memory_id", F.lit(1.0).alias("score"), F.lit(0.0).alias("boost"))).where("content not like '[gap]%'").orderBy("memory_id").limit(asked.limit)
        hits = hits.unionByName(direct.join(F.broadcast(none)).where("none").select(hits.columns))
    hits = hits.join(F.broadcast(store.n)).withColumn("hits", F.count("*").over(every)).withColumn("overlap", lexical.term_overlap(F.col("content"), asked.question))
    drifted = F.when(F.col("n") >= 5, fusion.drifted(F.col("score"), F.coalesce("access", F.lit(0)), F.col("n"))).otherwise(F.col("score"))
    score = F.when(F.col("hits") > 1, drifted + 0.8 * F.col("overlap") + 0.4 * F.col("boost")).otherwise(drifted)
    hits = hits.withColumn("score", F.round(score, 6)).drop("n", "hits")
    hits = settled(hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "memory_id")).cast("long")))
    if asked.graph and sure is not None and not hits.isEmpty():
        hits = settled(_graphed(asked, store, hits, sure))
    near = store.partners(hits.where(F.col("rank") <= HEAD), NEIGHBOURS).select("memory_id").distinct().withColumn("near", F.lit(True))
    told = hits.join(F.broadcast(near), "memory_id", "left").withColumn("near", F.coalesce("near", F.lit(False))).withColumn("lexical", F.col("overlap") > 0).withColumn("hits", F.count("*").over(every))
    kept = fusion.prefilter(told, asked.limit, max(asked.budget, asked.limit), F.col("hits") > max(asked.limit, asked.budget)).where("status <> 'superseded'")
    order = Window.orderBy(F.col("rank")) if asked.graph else Window.orderBy(F.desc("score"), F.col("status") == "archived", "rank")
    kept = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    if asked.separate:
        chosen = fusion.diversify(kept.select(F.lit(0).alias("query"), "memory_id", "score", lexical.terms(F.col("content")).alias("tokens")), asked.limit, key="int")
        return chosen.join(kept.select("memory_id", "score"), "memory_id").select("memory_id", "score", F.col("place").cast("long").alias("rank"))
    return kept.where(F.col("rank") <= asked.limit).select("memory_id", "score", "rank")


def confidence(best: DataFrame, cosine: Column, overlap: Column) -> DataFrame:
    """max_rel, status of the best hits: how sure the surest of them is, by likeness or by words."""
    sure = F.greatest(fusion.calibrated(cosine), overlap)
    found = best.agg(F.max(sure).alias("m"), F.count("*").alias("n"))
    return found.select(F.round("m", 6).alias("max_rel"), F.when(F.col("n") == 0, "empty").when(F.col("m") < 0.45, "weak").otherwise("ok").alias("status"))
