"""Queries on keyed merges: what all records say of a user, and of a contact between two known ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import entities as E
from tracelake.plans.catalog import CALLS, query
from tracelake.sources import calls, table

USER = {"label": "last", "origin": "first", "confidence": "max", "since": "min", "active": "all", "contacts": "union", "kinds": "union"}
CONTACT = {"calls": "sum", "duration_s": "sum", "first_ts": "min", "last_ts": "max", "confidence": "max", "kind": "last", "documents": "union"}


@query(f"""WITH {CALLS}, one AS (SELECT src AS node, arg_max(event_type, evidence) AS label, arg_min(event_type, evidence) AS origin, max(duration) AS confidence, min(micros) AS since, bool_and(event_type <> 'error' OR duration > 1) AS active FROM calls WHERE src IS NOT NULL GROUP BY src),
    c AS (SELECT src, dst::VARCHAR AS item, min(evidence) AS seq FROM calls WHERE dst IS NOT NULL GROUP BY src, dst), k AS (SELECT src, event_type AS item, min(evidence) AS seq FROM calls GROUP BY src, event_type),
    cs AS (SELECT src AS node, count(*) AS contacts, arg_min(item, seq) AS first_contacts, arg_max(item, seq) AS last_contacts FROM c GROUP BY src), ks AS (SELECT src AS node, count(*) AS kinds, arg_min(item, seq) AS first_kinds, arg_max(item, seq) AS last_kinds FROM k GROUP BY src)
    SELECT one.*, coalesce(contacts, 0) AS contacts, first_contacts, last_contacts, coalesce(kinds, 0) AS kinds, first_kinds, last_kinds FROM one LEFT JOIN cs USING (node) LEFT JOIN ks USING (node)""")
def merged_entities(spark, d):
    """Every user as its events leave it: what was said last and first, the surest, any word against it, and the lists in order of arrival."""
    kind, sure = F.col("event_type"), F.col("duration")
    said = calls(spark, d).select(F.col("src").alias("node"), F.col("evidence").alias("seq"), kind.alias("label"), kind.alias("origin"), sure.alias("confidence"), F.col("micros").alias("since"), ((kind != "error") | (sure > 1)).alias("active"), F.array("dst").alias("contacts"), F.array(kind).alias("kinds"))
    return E.merged(said, ["node"], "seq", USER)


@query(f"""WITH {CALLS}, known AS (SELECT c_custkey AS k FROM customer WHERE c_mktsegment <> 'BUILDING'), e AS (SELECT * FROM calls WHERE src IN (SELECT k FROM known) AND dst IN (SELECT k FROM known)),
    m AS (SELECT src, dst, count(*) AS calls, CAST(sum(CAST(floor(duration) AS BIGINT)) AS BIGINT) AS duration_s, min(micros) AS first_ts, max(micros) AS last_ts, max(duration) AS confidence, arg_max(event_type, evidence) AS kind FROM e GROUP BY src, dst),
    i AS (SELECT src, dst, (evidence // 4)::VARCHAR AS item, min(evidence) AS seq FROM e GROUP BY ALL), s AS (SELECT src, dst, count(*) AS documents, arg_min(item, seq) AS first_documents, arg_max(item, seq) AS last_documents FROM i GROUP BY src, dst)
    SELECT m.*, documents, first_documents, last_documents FROM m JOIN s USING (src, dst)""")
def merged_edges(spark, d):
    """Contacts between customers outside one segment, each pair once: counts and durations summed, first and last times, the documents they come from."""
    long, sure = F.lit(1).cast("long"), F.col("duration")
    said = calls(spark, d).select("src", "dst", F.col("evidence").alias("seq"), long.alias("calls"), F.floor(sure).cast("long").alias("duration_s"), F.col("micros").alias("first_ts"), F.col("micros").alias("last_ts"), sure.alias("confidence"), F.col("event_type").alias("kind"), F.array(F.expr("evidence div 4")).alias("documents"))
    known = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")
    return E.merged(E.with_endpoints(said, known, "c_custkey"), ["src", "dst"], "seq", CONTACT)
