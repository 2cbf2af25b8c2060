"""Merges of records that are the same: a log that is only ever added to, and the network as the log has it.

Nothing is rewritten when two records are merged or a merge is undone. The log says what holds, pointers to the kept records are doubled until they
reach the last one, and edges are seen through these. So undoing one merge leaves all others as they are, earlier and later ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.scratch import cut, release


def admit(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """The log without merges that are refused: of a node with itself, of nodes that aren't there, of nodes with different labels. log: version (distinct),
    action (merge or unmerge), kept, absorbed; nodes: node, label."""
    label = nodes.filter("node is not null").groupBy("node").agg(F.min("label").alias("label"))
    kept, absorbed = label.select(F.col("node").alias("kept"), F.col("label").alias("a")), label.select(F.col("node").alias("absorbed"), F.col("label").alias("b"))
    merges = log.filter("action = 'merge' and kept <> absorbed").join(kept, "kept").join(absorbed, "absorbed").filter(F.col("a").eqNullSafe(F.col("b")))
    return merges.select("version", "action", "kept", "absorbed").union(log.filter("action = 'unmerge' and absorbed is not null").select("version", "action", "kept", "absorbed"))


def parents(log: DataFrame, version: int | None = None) -> DataFrame:
    """(node, kept, version): the merges that hold, as of a version or the last one. The last entry of an absorbed node says whether it is merged, and into what."""
    if version is not None:
        log = log.filter(F.col("version") <= version)
    last = log.groupBy("absorbed").agg(F.max(F.struct("version", "action", "kept")).alias("e"))
    return last.filter("e.action = 'merge'").select(F.col("absorbed").alias("node"), "e.kept", "e.version")


def resolve(merged: DataFrame) -> DataFrame:
    """(node, root) of every merged node: the record that stands for it in the end. Of merges in a ring the latest doesn't hold.

    Pointers double, so a chain of n merges takes log n rounds. After as many rounds as the longest chain could ask for, what still moves stands on a ring, and
    has met the latest merge of it."""
    merged = cut(merged.select("node", "kept", "version"))
    most = max(1, merged.count()).bit_length() + 1
    at, rounds = cut(merged.select("node", F.col("kept").alias("root"), F.col("version").alias("latest"))), 0
    while True:
        further = at.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("latest").alias("later"))
        step = cut(at.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.greatest("latest", "later").alias("latest"), F.col("next").isNotNull().alias("moved")))
        release(at)
        at, rounds = step.drop("moved"), rounds + 1
        moved = not step.filter("moved").isEmpty()
        if not moved or rounds > most:
            break
    if not moved:
        return at.select("node", "root")
    ring = step.filter("moved").select(F.col("root").alias("node")).distinct()
    closing = at.join(ring, "node", "left_semi").select("node", F.col("latest").alias("version"))
    return resolve(merged.join(closing, ["node", "version"], "left_anti"))


def rewire(edges: DataFrame, roots: DataFrame, rel: str = "rel") -> DataFrame:
    """Edges between the records that stand for their ends: one for each kind, source and target, with a key of its own, occurrences added up. An edge that merging
    turns into a loop goes; one that was a loop stays. edges: src, dst, occurrences and the kind; null ends stay null."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    seen = edges.groupBy(rel, "src", "dst").agg(F.sum("occurrences").alias("occurrences")).join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    src, dst = F.coalesce("src_root", "src"), F.coalesce("dst_root", "dst")
    kept = seen.filter(~F.coalesce((src == dst) & (F.col("src") != F.col("dst")), F.lit(False))).select(rel, src.alias("src"), dst.alias("dst"), "occurrences")
    key = F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (rel, "src", "dst"))), 256), 1, 40)
    return kept.groupBy(rel, "src", "dst").agg(F.sum("occurrences").alias("occurrences")).withColumn("edge_key", key)


def aliases(names: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, alias): what a record is also called, the names of all that were merged into it but its own. names: node, name; a row each, so that a record with
    many aliases is no larger than another."""
    own = names.filter("node is not null and name is not null").select("node", "name").distinct()
    taken = own.join(roots, "node").select(F.col("root").alias("node"), "name").distinct()
    return taken.join(own, ["node", "name"], "left_anti").withColumnRenamed("name", "alias")


def same_names(records: DataFrame, label: str) -> DataFrame:
    """(kept, absorbed): records of a label that were derived from a name alone, where just one described record bears that name (in any case and spacing).
    Two described ones of one name were told apart, so nothing is folded into either. records: label, node, derived, name; names are counted, not gathered."""
    name = F.lower(F.trim(F.regexp_replace("name", r"\s+", " ")))
    of = records.filter(F.col("label") == label).select("node", "derived", name.alias("name")).filter("name <> ''").distinct()
    one = of.filter("not derived").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("kept")).filter("n = 1")
    return of.filter("derived").join(one, "name").select("kept", F.col("node").alias("absorbed"))
