"""Queries on identities: proposals of aliases, the contact network seen through a log of merges, and records that contradict each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import identity as I
from tracelake.operators import merges as M
from tracelake.operators import review as R
from tracelake.plans.catalog import CALLS, query
from tracelake.sources import calls, table

#: Names as several hands write them: words turned round, left out or spelled by ear; a quarter have an alias.
NAMES = """written AS (SELECT p_brand AS case_id, p_partkey AS person, CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type || ', ' || p_name ELSE p_name || ' ' || p_type END AS name FROM part),
    named AS (SELECT case_id, person, CASE WHEN person % 7 = 0 THEN replace(name, 'i', 'ee') ELSE name END AS name, false AS alias FROM written
    UNION ALL SELECT p_brand, p_partkey, p_name || ' of ' || p_size, true FROM part WHERE p_partkey % 4 = 0)"""

#: Of every user the last entry that is a sign-up (merged into the partner, if that has a smaller number) or an error (undone) holds.
MERGED = f"""{CALLS}, nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls),
    entry AS (SELECT src AS node, dst AS kept, event_type, evidence FROM calls WHERE (event_type = 'signup' AND dst < src) OR event_type = 'error'),
    held AS MATERIALIZED (SELECT node, kept FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY evidence DESC) AS k FROM entry) WHERE k = 1 AND event_type = 'signup'),
    walk AS (SELECT node, kept AS root FROM held UNION ALL SELECT walk.node, held.kept FROM walk JOIN held ON held.node = walk.root),
    roots AS MATERIALIZED (SELECT node, min(root) AS root FROM walk GROUP BY node)"""


@query(f"""WITH {NAMES}, n AS MATERIALIZED (SELECT DISTINCT case_id, person, trim(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g')) AS key, alias FROM named),
    words AS (SELECT DISTINCT case_id, key, list_filter(string_split_regex(key, ' +'), lambda x: x <> '') AS words FROM n),
    k AS MATERIALIZED (SELECT *, array_to_string(list_sort(words), ' ') AS ordered, regexp_replace(key, '[aeiou ]', '', 'g') AS bones FROM words),
    g AS MATERIALIZED (SELECT *, list_distinct(list_transform(range(1, len(key) + 2), lambda i: substr('  ' || key || ' ', i, 3))) AS t, list_distinct(list_transform(range(1, len(ordered) + 2), lambda i: substr('  ' || ordered || ' ', i, 3))) AS o FROM k),
    c AS (SELECT a.case_id, a.key, b.key AS other, len(list_intersect(a.t, b.t)) AS it, len(a.t) + len(b.t) AS nt, len(list_intersect(a.o, b.o)) AS io, len(a.o) + len(b.o) AS no,
        a.ordered = b.ordered AS same, list_has_all(a.words, b.words) OR list_has_all(b.words, a.words) AS part, a.bones = b.bones AND a.bones <> '' AS bones FROM g a JOIN g b USING (case_id)),
    s AS MATERIALIZED (SELECT case_id, key, other, CASE WHEN key = other THEN 1.0 ELSE round(greatest(it / (nt - it), CASE WHEN same THEN 0.99 ELSE io / (no - io) END, CASE WHEN part OR bones THEN 0.9 ELSE 0 END), 4) END AS score FROM c),
    p AS (SELECT a.person, b.person AS target, score, a.alias OR b.alias AS by_alias FROM s JOIN n a USING (case_id, key) JOIN n b ON b.case_id = s.case_id AND b.key = s.other
        WHERE score >= 0.85 AND a.person <> b.person AND NOT (a.alias AND b.alias)),
    r AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY score DESC, target, by_alias) AS k FROM p)
    SELECT person, target, CAST(score AS DOUBLE) AS score, CASE WHEN by_alias THEN 'ALIAS_CO_MENTION' ELSE 'NAME_FUZZY' END AS basis FROM r WHERE k = 1""")
def name_alias_candidates(spark, d):
    """For every part, taken as a person of the case of its brand, the other one whose name is most like its own."""
    part, n = table(spark, d, "part"), F.col("p_partkey")
    by_hand = F.when(n % 5 == 0, F.col("p_name")).when(n % 3 == 1, F.concat("p_type", F.lit(", "), "p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type"))
    by_hand = F.when(n % 7 == 0, F.replace(by_hand, F.lit("i"), F.lit("ee"))).otherwise(by_hand)
    named = part.select(F.col("p_brand").alias("case_id"), n.alias("person"), by_hand.alias("name"), F.lit(False).alias("alias"))
    also = part.filter(n % 4 == 0).select("p_brand", n, F.concat("p_name", F.lit(" of "), F.col("p_size").cast("string")), F.lit(True))
    named = named.union(also)
    return I.alias_candidates(named, named)


def roots(spark, d):
    rows = calls(spark, d)
    nodes = rows.select(F.col("src").alias("node")).union(rows.select("dst")).distinct().withColumn("label", F.lit("PHONE"))
    kind = F.when((F.col("event_type") == "signup") & (F.col("dst") < F.col("src")), "merge").when(F.col("event_type") == "error", "unmerge")
    log = rows.select(F.col("evidence").alias("version"), kind.alias("action"), F.col("dst").alias("kept"), F.col("src").alias("absorbed"))
    return M.resolve(M.parents(M.admit(log, nodes)))


@query(f"WITH RECURSIVE {MERGED} SELECT * FROM roots")
def merged_phones(spark, d):
    """Every phone that the log has merged, with the one that stands for it."""
    return roots(spark, d)


@query(f"""WITH RECURSIVE {MERGED}, one AS (SELECT event_type AS rel, src, dst, count(*) AS n FROM calls GROUP BY ALL),
    seen AS (SELECT rel, coalesce(a.root, src) AS src, coalesce(b.root, dst) AS dst, src <> dst AS apart, n FROM one LEFT JOIN roots a ON a.node = src LEFT JOIN roots b ON b.node = dst)
    SELECT rel, src, dst, CAST(sum(n) AS BIGINT) AS occurrences, substr(sha256(concat(rel, '|', src, '|', dst)), 1, 40) AS edge_key FROM seen WHERE NOT (apart AND src = dst) GROUP BY rel, src, dst""")
def merged_contacts(spark, d):
    """The contacts of each kind between the phones that stand for others."""
    per = calls(spark, d).select(F.col("event_type").alias("rel"), "src", "dst", F.lit(1).cast("long").alias("occurrences"))
    return M.rewire(per, roots(spark, d))


@query(f"""WITH {CALLS}, claim AS (SELECT 'c' || o_custkey AS subject, 'STATUS' AS dimension, epoch_us(o_orderdate) AS micros, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'charges_filed' END AS value, NULL AS category, 0 AS polarity, o_orderkey AS document FROM orders
    UNION ALL SELECT 's' || l_suppkey, 'ROLE', NULL, l_shipdate::VARCHAR, CASE l_returnflag WHEN 'A' THEN 'ADVERSE' WHEN 'N' THEN 'NEUTRAL' WHEN 'R' THEN 'ASSOCIATE' END, 0, l_orderkey FROM lineitem
    UNION ALL SELECT 'u' || src, 'LOCATION', micros, dst::VARCHAR, NULL, 0, evidence // 2 FROM calls UNION ALL SELECT 'u' || src, 'AMOUNT', CASE WHEN evidence % 9 > 0 THEN micros END, duration::INTEGER::VARCHAR, NULL, 0, evidence // 2 FROM calls
    UNION ALL SELECT 'u' || src, 'RELATIONSHIP', micros, event_type || ':' || dst, NULL, CASE WHEN duration < 10 THEN -1 ELSE 1 END, evidence // 500 FROM calls UNION ALL SELECT 'u' || src, 'OTHER', micros, event_type, NULL, 0, evidence FROM calls),
    one AS (SELECT *, CASE dimension WHEN 'STATUS' THEN micros - micros % 86400000000 WHEN 'LOCATION' THEN micros - micros % 3600000000 WHEN 'AMOUNT' THEN micros - micros % 3600000000 END AS bucket,
        CASE WHEN dimension = 'RELATIONSHIP' THEN split_part(value, ':', 2) END AS target,
        CASE dimension WHEN 'ROLE' THEN category WHEN 'STATUS' THEN CASE upper(value) WHEN 'OPEN' THEN 'ACTIVE' WHEN 'CLOSED' THEN 'CONCLUDED' ELSE 'CHARGED' END ELSE value END AS class FROM claim WHERE dimension <> 'OTHER' AND (dimension NOT IN ('AMOUNT', 'STATUS') OR micros IS NOT NULL)),
    p AS MATERIALIZED (SELECT subject, dimension, bucket, target, class, document, polarity FROM one WHERE NOT (dimension = 'ROLE' AND (category IS NULL OR category = 'ASSOCIATE'))
        QUALIFY row_number() OVER (PARTITION BY subject, dimension, bucket, target, class, document ORDER BY micros NULLS FIRST, polarity) = 1),
    pairs AS (SELECT a.subject, a.dimension, a.bucket, a.target, count(*) AS conflicts FROM p a JOIN p b ON a.subject = b.subject AND a.dimension = b.dimension AND a.bucket IS NOT DISTINCT FROM b.bucket AND a.target IS NOT DISTINCT FROM b.target
        AND a.document < b.document AND a.class <> b.class AND (a.dimension <> 'RELATIONSHIP' OR a.polarity <> b.polarity) GROUP BY ALL),
    n AS (SELECT subject, dimension, bucket, target, count(DISTINCT class) AS values, count(DISTINCT document) AS documents FROM p GROUP BY ALL)
    SELECT n.subject, n.dimension, n.bucket, n.target, CASE n.dimension WHEN 'ROLE' THEN 'IDENTITY_ROLE' ELSE n.dimension END || '_CONFLICT' AS type, conflicts, values, documents
    FROM pairs JOIN n ON n.subject = pairs.subject AND n.dimension = pairs.dimension AND n.bucket IS NOT DISTINCT FROM pairs.bucket AND n.target IS NOT DISTINCT FROM pairs.target""")
def claim_conflicts(spark, d):
    """What orders, lines and events claim of customers, suppliers and users: contradictions by the rule of each dimension."""
    c, o, li = calls(spark, d), table(spark, d, "orders"), table(spark, d, "lineitem")
    none, text, at = F.lit(None).cast("string"), lambda x: F.col(x).cast("string"), F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    row = lambda df, subject, dimension, micros, value, category, polarity, document: df.select(subject.alias("subject"), F.lit(dimension).alias("dimension"), micros.cast("long").alias("micros"), value.alias("value"), category.alias("category"), polarity.alias("polarity"), document.cast("long").alias("document"))
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "P", "charges_filed")
    flag, user, two = F.col("l_returnflag"), F.concat(F.lit("u"), text("src")), F.expr("evidence div 2")
    role = F.when(flag == "A", "ADVERSE").when(flag == "N", "NEUTRAL").when(flag == "R", "ASSOCIATE")
    claims = row(o, F.concat(F.lit("c"), text("o_custkey")), "STATUS", at, status, none, F.lit(0), F.col("o_orderkey"))
    claims = claims.union(row(li, F.concat(F.lit("s"), text("l_suppkey")), "ROLE", F.lit(None), text("l_shipdate"), role, F.lit(0), F.col("l_orderkey")))
    claims = claims.union(row(c, user, "LOCATION", F.col("micros"), text("dst"), none, F.lit(0), two)).union(row(c, user, "AMOUNT", F.when(F.col("evidence") % 9 > 0, F.col("micros")), F.rint("duration").cast("int").cast("string"), none, F.lit(0), two))
    claims = claims.union(row(c, user, "RELATIONSHIP", F.col("micros"), F.concat_ws(":", "event_type", text("dst")), none, F.when(F.col("duration") < 10, -1).otherwise(1), F.expr("evidence div 500")))
    about = o.count() + li.count() + 3 * table(spark, d, "events").count()
    return R.conflicts(claims.union(row(c, user, "OTHER", F.col("micros"), F.col("event_type"), none, F.lit(0), F.col("evidence"))), about=about)
