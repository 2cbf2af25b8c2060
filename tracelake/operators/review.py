"""Review of evidence: corroboration, contradictions, convergence, neighbours, queues, logs, cross-case entities and pages.

Everything is grouped before it is compared, so a subject with many records makes one row a group and never pairs of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.sources import dealt


def contradictions(claims: DataFrame, minutes: int = 60) -> DataFrame:
    """Per subject, dimension and bucket of time: the values and records of claims that can't hold together. claims: subject, dimension,
    micros, value, document. Two values and two documents are enough: some two claims then differ in both. Null values claim nothing."""
    bucket = F.col("micros") - F.pmod("micros", F.lit(minutes * 60_000_000))
    per = claims.filter("value is not null").groupBy("subject", "dimension", bucket.alias("bucket"))
    out = per.agg(F.countDistinct("value").alias("n_values"), F.countDistinct("document").alias("documents"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    return out.filter("n_values > 1 and documents > 1")


#: Role classes of which a person has one only, and the families that statuses belong to.
ROLE_CLASSES = ("ADVERSE", "NEUTRAL", "OFFICIAL")
STATUS_FAMILIES = {
    "OPEN": "ACTIVE", "PENDING": "ACTIVE", "UNDER_INVESTIGATION": "ACTIVE", "IN_PROGRESS": "ACTIVE", "ACTIVE": "ACTIVE", "UNRESOLVED": "ACTIVE",
    "CLOSED": "CONCLUDED", "CONCLUDED": "CONCLUDED", "COMPLETED": "CONCLUDED", "DISPOSED": "CONCLUDED", "FINAL_REPORT_FILED": "CONCLUDED",
    "CHARGES_FILED": "CHARGED", "CHARGE_SHEET_FILED": "CHARGED", "CHARGESHEET_FILED": "CHARGED", "PROSECUTED": "CHARGED",
}
CONFLICTS = {
    "LOCATION": "LOCATION_CONFLICT", "EVENT": "EVENT_DESCRIPTION_CONFLICT", "AMOUNT": "AMOUNT_CONFLICT", "ROLE": "IDENTITY_ROLE_CONFLICT", "STATUS": "STATUS_CONFLICT",
    "RELATIONSHIP": "RELATIONSHIP_CONFLICT",
}


def conflicts(claims: DataFrame, minutes: int = 60, about: int = 0) -> DataFrame:
    """(subject, dimension, bucket, target, type, conflicts, values, documents): how many pairs of claims of different documents contradict each other, by the rule of
    their dimension. claims: subject, dimension, micros, value, category, polarity, document.

    Places and events: any two values in one bucket of time (without a time: in one of their own). Amounts: the same, with times only. Roles: two classes that exclude
    each other. Statuses: two families on one day, with times only. Relations (`kind:target`): different values with one target and different polarity. Other
    dimensions have no rule. Of a document's claims of one class the first counts (by micros, nulls first, then polarity). Null documents and values take no part.

    Pairs are counted and never made: of all pairs those alike in value, in document or in polarity are taken off by inclusion and exclusion, so a subject with many
    claims costs a row for each of them. `about`: how many claims there are; many are dealt over as many tasks as they need."""
    is_ = lambda *names: F.col("dimension").isin(*names)
    width = F.when(is_("LOCATION", "EVENT"), F.lit(minutes)).when(is_("AMOUNT"), F.lit(60)).when(is_("STATUS"), F.lit(1440)).cast("long") * 60_000_000
    families = F.create_map(*(F.lit(x) for pair in STATUS_FAMILIES.items() for x in pair))
    class_ = F.when(is_("ROLE"), F.when(F.col("category").isin(*ROLE_CLASSES), F.col("category"))).when(is_("STATUS"), families[F.upper("value")]).otherwise(F.col("value"))
    rows = claims.filter(is_(*CONFLICTS) & F.col("value").isNotNull() & F.col("document").isNotNull() & (~is_("AMOUNT", "STATUS") | F.col("micros").isNotNull()))
    target = F.when(is_("RELATIONSHIP"), F.element_at(F.split("value", ":"), -1))
    rows = rows.select("subject", "dimension", (F.col("micros") - F.pmod("micros", width)).alias("bucket"), target.alias("target"), class_.alias("class"), "document", "micros", F.coalesce("polarity", F.lit(0)).alias("polarity"))
    group = ["subject", "dimension", "bucket", "target"]
    points = dealt(rows.filter("class is not null"), about, *group, "class", "document").groupBy(*group, "class", "document").agg(F.min(F.struct("micros", "polarity")).getField("polarity").alias("polarity"))
    alike = lambda sign, *by: F.struct(F.lit(sign).alias("sign"), *((F.col(c).cast("string") if c in by else F.lit(None).cast("string")).alias(f"by_{c}") for c in ("class", "document", "polarity")))
    sets = [alike(1), alike(-1, "class"), alike(-1, "document")]
    related = [alike(-1, "polarity"), alike(1, "class", "polarity"), alike(1, "document", "polarity")]
    each = points.select(*group, F.inline(F.when(is_("RELATIONSHIP"), F.array(*sets, *related)).otherwise(F.array(*sets))))
    alike_by = ["sign", "by_class", "by_document", "by_polarity"]
    n = dealt(each, 3 * about, *group, *alike_by).groupBy(*group, *alike_by).agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.count_if(F.col(f"by_{c}").isNotNull() & (F.col("sign") == -1))
    out = n.groupBy(*group).agg(F.sum(F.col("sign") * F.expr("n * (n - 1) div 2")).alias("conflicts"), of("class").alias("values"), of("document").alias("documents"))
    kinds = F.create_map(*(F.lit(x) for pair in CONFLICTS.items() for x in pair))
    return out.filter("conflicts > 0").select(*group, kinds[F.col("dimension")].alias("type"), "conflicts", "values", "documents")


def identity(claims: DataFrame) -> DataFrame:
    """Claims with what they assert: `value` in lower case, of letters, digits and + only, with single spaces (null: empty; accents are kept), and whether it is `negated` (by a polarity below 0, if there is one)."""
    negated = F.coalesce(F.col("polarity") < 0, F.lit(False)) if "polarity" in claims.columns else F.lit(False)
    squashed = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("value").cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}+]+", " "))
    return claims.withColumns({"value": squashed, "negated": negated})


def contradicted(claims: DataFrame, minutes: int = 60) -> DataFrame:
    """(subject, dimension, value, negated) of the claims that another one contradicts within a bucket of time: only what is claimed there, not every value of
    the dimension. In a bucket with two values and two documents each value meets another value of another document."""
    bucket = F.col("micros") - F.pmod("micros", F.lit(minutes * 60_000_000))
    rows = claims.filter("value is not null").withColumn("bucket", bucket)
    return identity(rows.join(contradictions(claims, minutes).select("subject", "dimension", "bucket"), ["subject", "dimension", "bucket"], "left_semi")).select("subject", "dimension", "value", "negated").distinct()


def corroboration(claims: DataFrame, contradicted: DataFrame | None = None, least: int = 1) -> DataFrame:
    """Per assertion (subject, dimension, normalised value, negated or not; not its time): distinct documents, kinds of evidence, first and last time, status.
    A document counts once, by its first claim (micros, then kind). claims: subject, dimension, value, document, kind, micros and maybe polarity;
    contradicted: subject, dimension, value, negated."""
    key = ["subject", "dimension", "value", "negated"]
    first = identity(claims).groupBy(*key, "document").agg(F.min(F.struct("micros", "kind")).alias("c"))
    out = first.groupBy(*key).agg(F.count(F.lit(1)).alias("support"), F.countDistinct("c.kind").alias("kinds"), F.min("c.micros").alias("first"), F.max("c.micros").alias("last"))
    out = out.filter(F.col("support") >= max(1, least))
    if contradicted is None:
        out = out.withColumn("against", F.lit(None).cast("boolean"))
    else:
        out = out.join(contradicted.select(*key).distinct().withColumn("against", F.lit(True)), key, "left")
    many = F.col("support") >= 2
    status = F.when(F.col("against"), "CONFLICTED").when(many & (F.col("kinds") >= 2), "MULTI_TYPE_CORROBORATED").when(many, "MULTI_SOURCE_SUPPORTED").otherwise("SINGLE_SOURCE")
    return out.withColumn("status", status).drop("against")


def convergence(kinds: Column, documents: Column) -> Column:
    """Class of the evidence by its distinct kinds of source and distinct documents."""
    both = (kinds >= 2) & (documents >= 2)
    return F.when(both & (kinds >= 3), "INDEPENDENT_SOURCE_CONVERGENCE").when(both, "MULTI_SOURCE").when(documents >= 2, "MULTI_RECORD").when(documents == 1, "SINGLE_SOURCE").otherwise("NONE")


def top_neighbours(edges: DataFrame, k: int = 5) -> DataFrame:
    """Per node its `k` neighbours of the greatest weight, either way of an edge; ties by neighbour, then outgoing first. Spark cuts each
    partition to the first `k` of a node before the shuffle, so a hub doesn't travel whole."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", F.lit(0).alias("way"))
    both = out.union(edges.select("dst", "src", "weight", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other", "way"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("node", F.col("rank").cast("long").alias("rank"), "other", F.round("weight", 3).alias("weight"))


def queue_summary(items: DataFrame, pending: Column, age_hours: Column, sla: float = 48) -> DataFrame:
    """One row: pending items, those over the agreed time, and the age of the oldest (0 if none is pending)."""
    age = F.when(pending, age_hours)
    return items.agg(F.count_if(pending).alias("pending"), F.count_if(age > sla).alias("breached"), F.round(F.coalesce(F.max(age), F.lit(0.0)), 4).alias("oldest_hours"))


def log_alerts(rows: DataFrame, failed: Column, export: Column, denied: Column) -> DataFrame:
    """One row: counts of a log's window and whether each reaches its fixed limit (10 failures, 20 exports, 5 denials)."""
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures"), F.count_if(export).alias("exports"), F.count_if(denied).alias("denials"))
    return out.withColumns({"alert_failures": F.col("failures") >= 10, "alert_exports": F.col("exports") >= 20, "alert_denials": F.col("denials") >= 5})


def cross_case_entities(links: DataFrame, least: int = 2) -> DataFrame:
    """Entities in `least` or more cases, with these in order. links: entity, case_id, one per record."""
    per = links.select("entity", "case_id").filter("case_id is not null").distinct().groupBy("entity")
    out = per.agg(F.count(F.lit(1)).alias("cases"), F.array_join(F.sort_array(F.collect_list("case_id")).cast("array<string>"), ",").alias("case_ids"))
    return out.filter(F.col("cases") >= least)


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order; only offset + limit rows of a partition travel."""
    return rows.orderBy(*order).offset(offset).limit(limit)
