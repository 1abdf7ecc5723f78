"""Links between similar items that meet in buckets, without listing all pairs of a large bucket.

In a bucket of many items one leads, and each member is compared with it: one pair a member. The leader is the item
that shares most with others over all its buckets, so usually the original of a group of copies. Components of the
confirmed links then show which buckets are settled; the others get another leader from outside the first one's
component. In what is still open after the last round, members outside the largest leader's component are compared
with those of other components; in buckets of few items, all that aren't in one component yet. So every pair that
shares a bucket was either compared or lies in one component already: components are those that comparing all
pairs would give.

Components grow by what is new: links found later join the components found so far, and only those that they touch
are worked on again. Tables of a round are removed when the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from recollect.llm.common import LINKS, components, cut, release, sieved

MANY = 8  #: items from which on a bucket gets a leader
ROUNDS = 5  #: leaders that a bucket gets at most before the rest is compared member by member
FIRST = 2  #: times that one pair of each item is confirmed, before all that still join two components are
SETTLING = 4  #: near members of which one at least is a link, for another leader to be worth it
FEW = 20_000_000  #: comparisons of sketches that are few enough to be made without another leader


def in_buckets(items: DataFrame) -> DataFrame:
    """band, rep of items (rep, bands) whose bucket holds another item too.

    Buckets are counted first (combined before the shuffle), and the join that follows can be split where one is large;
    most of the others stay behind a sieve and aren't shuffled for it.
    """
    banded = items.select("rep", F.explode("bands").alias("band"))
    repeated = cut(banded.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("band"))
    held = sieved(banded, F.col("band"), repeated, "band", "held").where("held").drop("held")
    shared = cut(held.join(repeated, "band").select("band", "rep"))
    release(repeated)
    return shared


def in_parts(pairs: DataFrame, n: int, most: int) -> list[DataFrame]:
    """n pairs (a, b) in parts of about so many at most, each pair in one: those of an item a stay together."""
    parts = -(-n // most) or 1
    return [pairs] if parts == 1 else [pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i) for i in range(parts)]


def link(shared: DataFrame, items: DataFrame, near: Callable[[str, str], Column], confirm: Callable[[DataFrame], DataFrame], differ: Callable[[str, str], Column] | None = None, bounds: tuple[int, ...] = ()) -> DataFrame | None:
    """Components (id, component) of the confirmed links between items, or None without any.

    shared has the buckets (band, rep, each once) that hold two items or more; items has what near needs by rep, and
    may have the item's buckets (bands).
    near(l, r) is a cheap condition on the aliases of two items that keeps every pair that may be confirmed;
    confirm takes pairs (a, b) and returns those that are links.
    differ(l, r), a whole number, tells how far two items seem to be apart. With it, pairs of up to the first of the
    bounds are confirmed first, then those of up to the next, in the end all others; pairs that are in one component
    by then aren't made.
    """
    sizes = shared.groupBy("band").agg(F.count("*").alias("members"))
    watched = Observation()
    sized = cut(shared.join(sizes, "band"), watched, F.count("*").alias("n"), F.count_if(F.col("members") > MANY).alias("many"))
    if not watched.get["n"]:
        release(sized)
        return None
    found, open_ = None, None
    if watched.get["many"]:
        found, open_ = _led(sized.where(F.col("members") > MANY), items, near, confirm)

    rest = labelled(sized.where(F.col("members") <= MANY).select("band", "rep"), found).withColumn("main", F.lit(None).cast("long"))
    if open_ is not None:
        rest = rest.unionByName(labelled(shared.join(open_, "band"), found).select(rest.columns))
    # What near needs goes along with the buckets, so that the join gives no pairs but near ones.
    rest = cut(rest.join(items, "rep"))
    release(sized, open_)
    least = None
    for most in (*bounds, None) if differ else (None,):
        if least is not None:
            former, rest = rest, cut(_moved(rest, found))
            release(former)
        pairs = _met(rest, "bands" in items.columns, near, differ, least, most)
        if least is None:
            found = _first(pairs, found, confirm, FIRST if differ is None else 1)
        else:
            found = _more(found, confirm(pairs))
        least = most
    release(rest)
    return found


def _met(rest: DataFrame, first: bool, near: Callable, differ: Callable | None, least: int | None, most: int | None) -> DataFrame:
    """Near pairs (a, b, far), a < b, of different components that meet in a bucket and differ by more than least and most at most."""
    l, r = rest.where("coalesce(component <> main, true)").alias("l"), rest.alias("r")
    meet = (F.col("l.band") == F.col("r.band")) & (F.col("l.component") != F.col("r.component")) & ((F.col("r.component") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep"))) & near("l", "r")
    far = F.lit(0) if differ is None else differ("l", "r")
    if least is not None:
        meet &= far > least
    if most is not None:
        meet &= far <= most
    pairs = l.join(r, meet)
    if first:  # pairs that share several buckets are taken from the first
        pairs = pairs.where(F.element_at(F.array_intersect("l.bands", "r.bands"), 1) == F.col("l.band"))
    return pairs.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"), far.alias("far")).distinct()


def _moved(rest: DataFrame, found: DataFrame | None) -> DataFrame:
    """rest with the components that its items and its main components belong to by now."""
    if found is None:
        return rest
    now = labelled(rest.drop("component"), found)
    main = found.select(F.col("id").alias("main"), F.col("component").alias("now"))
    return now.join(main, "main", "left").withColumn("main", F.coalesce("now", "main")).select(rest.columns)


def _first(pairs: DataFrame, found: DataFrame | None, confirm: Callable, times: int) -> DataFrame | None:
    """found with the links of all pairs (a, b, far). One pair of each item is confirmed first, the nearest: most pairs
    that are near are links, and then the others of a group needn't be confirmed."""
    pairs = cut(pairs)
    for _ in range(times):
        firsts = cut(pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select("m.a", "b"))
        found = _more(found, confirm(firsts))
        ends = pairs if found is None else _between(pairs, found)
        watched = Observation()
        former, pairs = pairs, cut(ends.join(firsts, ["a", "b"], "left_anti"), watched, F.count("*").alias("n"))
        release(former, firsts)
        if not watched.get["n"]:
            release(pairs)
            return found
    found = _more(found, confirm(pairs))
    release(pairs)
    return found


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b, far) whose items aren't in one component yet."""
    a, b = (found.select(F.col("id").alias(x), F.col("component").alias(f"own_{x}")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(own_a, a) <> coalesce(own_b, b)").select(pairs.columns)


def _nearby(pairs: DataFrame, items: DataFrame, near: Callable[[str, str], Column]) -> DataFrame:
    """The pairs (a, b) that meet the cheap condition."""
    both = pairs.join(items.alias("l"), F.col("a") == F.col("l.rep")).join(items.alias("r"), F.col("b") == F.col("r.rep"))
    return both.where(near("l", "r")).select("a", "b")


def labelled(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    """shared with a column component: the one found for its rep, or the rep itself."""
    if found is None:
        return shared.withColumn("component", F.col("rep"))
    return shared.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _led(sized: DataFrame, items: DataFrame, near: Callable, confirm: Callable) -> tuple[DataFrame | None, DataFrame]:
    """(components, buckets that are still open with their main component) of buckets of many items."""
    weights = sized.groupBy("rep").agg(F.sum("members").alias("weight"))
    known = cut(sized.join(weights, "rep"))
    open_, found = known.withColumn("component", F.col("rep")), None
    for _ in range(ROUNDS):
        # The most central member outside the component of the last leader.
        outside = open_ if found is None else open_.where("component <> main")
        leader = F.max(F.struct("weight", (-F.col("rep")).alias("id"), F.col("component").alias("own"))).alias("m")
        leads = outside.groupBy("band").agg(leader).select("band", (-F.col("m.id")).alias("lead"), "m.own")
        star = open_.join(leads, "band").where("component <> own")
        tried, met = Observation(), Observation()
        star = cut(_nearby(star.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct(), items, near), tried, F.count("*").alias("n"))
        links = cut(confirm(star), met, F.count("*").alias("n"))
        found = _more(found, links)
        release(star, links)
        placed = labelled(known, found)
        main = F.max(F.struct("weight", "component")).alias("m")
        buckets = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), main).where("lo <> hi").select("band", F.col("m.component").alias("main"))
        watched = Observation()
        cost = F.sum(F.when(F.col("component") != F.col("main"), F.col("members"))).alias("pairs")
        former, open_ = open_, cut(placed.join(buckets, "band"), watched, cost)
        release(former)
        # Leaders of groups are confirmed with most members that are near; others settle nothing, and the rest is compared anyway.
        if (watched.get["pairs"] or 0) <= FEW or SETTLING * met.get["n"] < tried.get["n"]:
            break
    left = cut(open_.select("band", "main").distinct())
    release(known, open_)
    return found, left


def _more(found: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """The components found, with new links (a, b) added; nothing is computed anew where they join nothing."""
    between = new if found is None else _ends(new, found)
    watched = Observation()
    between = cut(between, watched, F.count("*").alias("n"))
    if not watched.get["n"]:
        release(between)
        return found
    joined = components(between, at_once=LINKS)
    release(between)
    if found is None:
        return joined
    moved = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    moved = moved.select("id", F.coalesce("to", "component").alias("component"))
    grown = cut(moved.unionByName(joined.join(found.select("id"), "id", "left_anti")))
    release(found, joined)
    return grown


def _ends(new: DataFrame, found: DataFrame) -> DataFrame:
    """The links between components that new links make: (a, b), each once."""
    a, b = (found.select(F.col("id").alias(x), F.col("component").alias(f"own_{x}")) for x in "ab")
    ends = new.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("own_a", "a").alias("a"), F.coalesce("own_b", "b").alias("b"))
    return ends.where("a <> b").distinct()
