"""Evidence: bands, case networks, paths between two nodes, phases, quarantine and review statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band(n: Column, high: float, medium: float) -> Column:
    return F.when(n >= high, "high").when(n >= medium, "medium").otherwise("low")


def suppressed_hubs(links: DataFrame, cap: int) -> DataFrame:
    """(entity, members) of the entities that link more than `cap` members; pair operators leave these out."""
    return links.groupBy("entity").agg(F.countDistinct("member").alias("members")).filter(F.col("members") > cap)


def strength(shared: Column, related: Column, evidence: Column) -> Column:
    strong = (shared >= 3) | ((shared >= 2) & (related >= 2)) | (evidence >= 5)
    return F.when(strong, "STRONG").when((shared >= 2) | (related >= 1) | (evidence >= 2), "MODERATE").otherwise("WEAK")


def case_network(links: DataFrame, cap: int | None = None) -> DataFrame:
    """Pairs of cases (a < b) with shared entities and the evidence for these, from links (case_id, entity), one per record. Entities of
    the same set of cases are counted first, so that hubs with one set make its pairs once. Entities of more than `cap` cases are left out, if it is given."""
    per = links.groupBy("entity", "case_id").agg(F.count(F.lit(1)).alias("evidence"))
    of = per.groupBy("entity").agg(F.count(F.lit(1)).alias("cases"), F.sha2(F.to_json(F.sort_array(F.collect_set("case_id"))), 256).alias("set"))
    of = of.filter(F.col("cases") >= 2 if cap is None else F.col("cases").between(2, cap))
    per = per.join(of.select("entity", "set"), "entity").groupBy("set", "case_id").agg(F.count(F.lit(1)).alias("shared"), F.sum("evidence").alias("evidence"))
    other = per.select("set", F.col("case_id").alias("b"), F.col("evidence").alias("more"))
    pairs = per.withColumnRenamed("case_id", "a").join(other, "set").filter("a < b")
    out = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum(F.col("evidence") + F.col("more")).alias("evidence"))
    return out.withColumn("strength", strength(F.col("shared"), F.lit(0), F.col("evidence")))


def sufficiency(docs: Column, hops: Column, confidence: Column, contradicted: Column) -> Column:
    """FACT, INFERENCE, HYPOTHESIS or UNKNOWN; a contradiction makes a fact an inference."""
    fact = (docs >= 2) & (hops == 1) & (confidence >= 0.85)
    inference = (docs >= 1) & (((hops <= 2) & (confidence >= 0.65)) | ((hops <= 3) & (confidence >= 0.5)))
    return F.when(fact & ~contradicted, "FACT").when(fact | inference, "INFERENCE").when((docs >= 1) & (hops <= 4), "HYPOTHESIS").otherwise("UNKNOWN")


def shortest_paths(edges: DataFrame, start: int, end: int, most: int = 2) -> DataFrame:
    """The shortest simple paths of three hops at most between two nodes (path, hops), by hops and then path. Both ends' neighbours meet,
    by an edge or at once, so no paths that lead elsewhere are made."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    near = both.filter((F.col("src") == start) & (F.col("dst") != end)).select(F.col("dst").alias("p"))
    far = both.filter((F.col("src") == end) & (F.col("dst") != start)).select(F.col("dst").alias("q"))
    one = both.filter((F.col("src") == start) & (F.col("dst") == end)).select(F.array("src", "dst").alias("nodes"))
    two = near.join(far, F.col("p") == F.col("q")).select(F.array(F.lit(start), "p", F.lit(end)).alias("nodes"))
    middle = both.join(near, F.col("src") == F.col("p")).join(far, F.col("dst") == F.col("q"))
    three = middle.select(F.array(F.lit(start), "p", "q", F.lit(end)).alias("nodes"))
    nodes = one.union(two).union(three).select(F.col("nodes").cast("array<string>").alias("nodes"))
    return nodes.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("hops")).orderBy("hops", "path").limit(most)


def phase(day: Column, incident: Column) -> Column:
    return F.when(day < incident, "before").when(day == incident, "incident").when(day > incident, "after")


def with_reason(rows: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Rows with the first reason to reject them (null: accepted); a predicate that is null doesn't reject."""
    return rows.withColumn("reason", F.coalesce(*(F.when(p, F.lit(r)) for r, p in reasons.items())))


def rejected_share(rows: DataFrame) -> DataFrame:
    """Rows and their share per reason, from with_reason's rows."""
    n = rows.groupBy(F.coalesce("reason", F.lit("ACCEPTED")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row per reason


def write_quarantine(rows: DataFrame, key: str, path: str) -> None:
    """Adds rejected rows to a Parquet table; a row that lies there already (same key and reason) isn't added again."""
    bad = rows.filter("reason is not null").dropDuplicates([key, "reason"])
    try:
        known = rows.sparkSession.read.parquet(path).select(key, "reason")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        bad = bad.join(known, [key, "reason"], "left_anti")
    bad.write.mode("append").parquet(path)


def dismissal_rates(findings: DataFrame, kind: str, dismissed: Column, least: int = 3, flag: float = 0.7) -> DataFrame:
    out = findings.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.count_if(dismissed).alias("dismissed"))
    out = out.withColumn("rate", F.round(F.col("dismissed") / F.col("n"), 6))
    return out.withColumn("recalibrate", (F.col("n") >= least) & (F.col("dismissed") / F.col("n") >= flag))
