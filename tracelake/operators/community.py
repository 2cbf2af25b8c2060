"""Communities by modularity: moves of nodes in rounds, contraction, and again until nothing is gained.

Strengths and links are whole numbers (millionths of confidence), so gains don't depend on the order of
sums. In a round every node looks for the community that its move would gain most by. Moves that are
made at once may cross, so a round first lets half of the nodes move, by a seeded hash that changes
with the round. If modularity doesn't rise, the round is taken back and fewer move: of nodes that are
linked only the one that gains most, and if that doesn't help either only moves that share no community,
each of which gains exactly what it promises. A level keeps to the narrower choice once it was needed.
Modularity thus never falls.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.centrality import dealt_links, undirected
from tracelake.scratch import cut, release

#: Least gain in modularity for which a further level is made, and a further round of one.
TOLERANCE, ROUND = 1e-7, 5e-4

#: Ends of links up to which they are joined to labels; more are dealt over blocks once a level.
FEW = 1 << 20


def linked_to(links: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, community, linked): the weight of every node's links into each community, loops aside. links: node, to, weight; labels: node, community."""
    at = labels.select(F.col("node").alias("to"), "community")
    return links.filter("node <> to").join(at, "to").groupBy("node", "community").agg(F.sum("weight").alias("linked"))


def linked_in_blocks(links: DataFrame, homes: DataFrame, labels: DataFrame) -> DataFrame:
    """As `linked_to`, by links that `dealt_links` has dealt over blocks: labels go to the links, which stay as they are, and a block sums before the shuffle."""
    states = homes.join(labels.select("node", "community"), "node").select(F.explode("places").alias("block"), "node", "community")
    kind = labels.schema["node"].dataType.simpleString()
    told = links.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(block_sums, f"node {kind}, community {kind}, linked long")
    return told.groupBy("node", "community").agg(F.sum("linked").alias("linked"))


def block_sums(links: pa.Table, states: pa.Table) -> pa.Table:
    """The weight of the links of each node of one block into each community."""
    names = ["node", "community", "linked"]
    if not links.num_rows:  # a node's home without links of it
        return pa.table([states.column(c).slice(0, 0) for c in names[:2]] + [pa.array([], pa.int64())], names)
    ends = links.column("nodes").combine_chunks().flatten()
    own = states.column("community").combine_chunks().dictionary_encode()
    community = np.empty(len(ends), "i8")
    at = pc.index_in(states.column("node"), value_set=ends)
    there = at.is_valid().to_numpy()
    community[at.drop_null().to_numpy()] = own.indices.to_numpy()[there]
    a, b = (np.frombuffer(links.column(c)[0].as_py(), "i4").astype("i8") for c in ("a", "b"))
    weight = np.frombuffer(links.column("length")[0].as_py(), "i8")
    many = len(own.dictionary)
    pair = np.concatenate((a * many + community[b], b * many + community[a]))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    begin = np.flatnonzero(np.diff(pair, prepend=-1))
    linked = np.add.reduceat(np.concatenate((weight, weight))[order], begin)
    return pa.table([ends.take(pa.array(pair[begin] // many)), own.dictionary.take(pa.array(pair[begin] % many)), pa.array(linked)], names)


def modularity(linked: DataFrame, labels: DataFrame, loops: int, whole: int) -> float:
    """Modularity of a partition from what nodes are linked to, the weight of all loops (each once, with twice its weight) and that of all ends."""
    inside = linked.join(labels.select("node", "community"), ["node", "community"]).agg(F.coalesce(F.sum("linked"), F.lit(0)).alias("inside"))
    total = labels.groupBy("community").agg(F.sum("strength").alias("total"))
    square = total.agg(F.coalesce(F.sum(F.col("total").cast("double") * F.col("total")), F.lit(0.0)).alias("square"))
    got = inside.crossJoin(square).first()  # a row each
    return (got["inside"] + loops) / whole - got["square"] / whole**2


def wishes(links: DataFrame, labels: DataFrame, whole: int, linked: DataFrame | None = None) -> DataFrame:
    """(node, old, new, gain): the best move of each node that gains by one; gain in modularity times half the whole weight. labels: node, community, strength;
    linked: what `linked_to` gives, if it is there."""
    total = labels.groupBy("community").agg(F.sum("strength").alias("total"))
    linked = linked_to(links, labels) if linked is None else linked
    own = labels.select("node", F.col("community").alias("old"), "strength")
    choice = linked.join(own, "node").union(own.select("node", F.col("old").alias("community"), F.lit(0).cast("long").alias("linked"), "old", "strength"))  # one may stay without links
    choice = choice.groupBy("node", "community", "old", "strength").agg(F.sum("linked").alias("linked")).join(total, "community")
    stays = F.col("community") == F.col("old")
    rest = F.col("total") - F.when(stays, F.col("strength")).otherwise(0)
    scored = choice.withColumn("value", F.col("linked") - F.col("strength").cast("double") * rest / whole)
    best = scored.groupBy("node", "old").agg(F.max(F.when(stays, F.col("value"))).alias("here"), F.max(F.struct("value", (-F.xxhash64("community")).alias("tie"), F.col("community").alias("new"))).alias("b"))
    return best.filter((F.col("b.new") != F.col("old")) & (F.col("b.value") > F.col("here") + TOLERANCE)).select("node", "old", F.col("b.new").alias("new"), (F.col("b.value") - F.col("here")).alias("gain"))


def apart(wanted: DataFrame, links: DataFrame, seed: int) -> DataFrame:
    """The moves whose node gains more than all linked nodes that would move as well; equal gains are ordered by a seeded hash."""
    order = F.struct(F.round("gain", 6).alias("gain"), F.xxhash64(F.lit(seed), "node").alias("hash"), F.col("node").alias("last"))
    own = wanted.withColumn("order", order)
    rival = own.select(F.col("node").alias("to"), F.col("order").alias("rival"))
    most = links.filter("node <> to").join(rival, "to").groupBy("node").agg(F.max("rival").alias("rival"))
    return own.join(most, "node", "left").filter(F.col("rival").isNull() | (F.col("order") > F.col("rival"))).drop("order", "rival")


def disjoint(wanted: DataFrame, seed: int) -> DataFrame:
    """The moves that gain most among all that leave or enter one of their two communities."""
    own = wanted.withColumn("order", F.struct(F.round("gain", 6).alias("gain"), F.xxhash64(F.lit(seed), "node").alias("hash"), F.col("node").alias("last")))
    sides = own.select(F.col("old").alias("c"), "order").union(own.select("new", "order"))
    top = sides.groupBy("c").agg(F.max("order").alias("top"))
    for side in ("old", "new"):
        own = own.join(top.select(F.col("c").alias(side), F.col("top").alias(f"top_{side}")), side)
    return own.filter("order = top_old AND order = top_new").select("node", "old", "new", "gain")


def half(wanted: DataFrame, seed: int) -> DataFrame:
    """The moves of about half of the nodes."""
    return wanted.filter(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2)) == 0)


def moved(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return labels.join(moves.select("node", "new"), "node", "left").select("node", F.coalesce("new", "community").alias("community"), "strength")


def level(links: DataFrame, seed: int, rounds: int) -> tuple[DataFrame, list[float]]:
    """Labels (node, community, strength) of one level that starts with every node by itself, and modularity at the start and after every round.

    The links are gone over once for each partition: what nodes are linked to in it gives its modularity and, if it is kept, the wishes of the next round."""
    labels = cut(links.groupBy("node").agg(F.sum("weight").alias("strength")).select("node", F.col("node").alias("community"), "strength"))
    whole = labels.agg(F.sum("strength")).first()[0] or 1
    n, loops = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("node") == F.col("to"), F.col("weight"))), F.lit(0))).first()
    dealt = dealt_links(links.filter("node <> to").withColumnRenamed("weight", "length"), 1) if n > FEW else ()
    into = lambda of: cut(linked_in_blocks(*dealt, of) if dealt else linked_to(links, of))
    linked = into(labels)
    course, narrow = [modularity(linked, labels, loops, whole)], 0
    for turn in range(rounds):
        wanted = cut(wishes(links, labels, whole, linked))
        if wanted.isEmpty():
            release(wanted)
            break
        for narrow in range(narrow, 3):
            moves = (lambda: half(wanted, seed + turn), lambda: apart(wanted, links, seed + turn), lambda: disjoint(wanted, seed + turn))[narrow]()
            new = cut(moved(labels, moves))
            heard = into(new)
            value = modularity(heard, new, loops, whole)
            if value > course[-1]:
                break
            release(new, heard)
        release(wanted)
        if value <= course[-1]:
            break
        release(labels, linked)
        labels, linked, rise = new, heard, value - course[-1]
        course.append(value)
        if rise < ROUND:
            break
    release(linked, *dealt)
    return labels, course


def louvain(edges: DataFrame, seed: int = 42, levels: int = 20, rounds: int = 60, weight: str = "weight", course: list[float] | None = None) -> DataFrame:
    """(node, community): community is the least node of it. edges: src, dst, weight (a confidence; parallel edges count by the surest). `course`, if given,
    gets the modularity at the start and after each level. Nodes without links, or with loops only, are communities of their own; null ends join nothing."""
    links = cut(undirected(edges, weight))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).filter("node is not null").distinct()
    home = cut(nodes.select("node", F.col("node").alias("community")))
    last = None
    for depth in range(levels):
        labels, values = level(links, seed + 1000 * depth, rounds)
        if course is not None:
            course += values[:1] if not course else []
            course.append(values[-1])
        if last is not None and values[-1] - last < TOLERANCE or len(values) == 1:
            release(labels)
            break
        last = values[-1]
        of = labels.select("node", F.col("community").alias("new"))
        home = cut(home.join(of.toDF("community", "new"), "community", "left").select("node", F.coalesce("new", "community").alias("community")), home)
        ends = links.join(of, "node").join(of.toDF("to", "other"), "to")
        links = cut(ends.groupBy(F.col("new").alias("node"), F.col("other").alias("to")).agg(F.sum("weight").alias("weight")), links, labels)
    least = home.groupBy("community").agg(F.min("node").alias("least"))
    return cut(home.join(least, "community").select("node", F.col("least").alias("community")), home, links)


def signals(communities: DataFrame, least: int = 3) -> DataFrame:
    """(community, members) of the communities with at least `least` members."""
    return communities.groupBy("community").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)
