"""Review operators on small tables, JSON lines, and a stream that is really run."""

from pyspark.sql import functions as F

from tracelake.operators import graph as G
from tracelake.operators import review as R
from tracelake.sources import read_json_lines
from tracelake.streaming import on_changes

H = 3_600_000_000


def test_contradictions_need_two_values_and_two_documents(spark):
    rows = [("a", "place", 1, "x", 1), ("a", "place", 2, "y", 2), ("a", "place", H, "z", 3), ("b", "place", 1, "x", 1), ("b", "place", 2, "y", 1), ("c", "place", 1, "x", 1), ("c", "place", 1, None, 2), ("d", "place", 1, "x", 1), ("d", "place", 1, "x", 2)]
    claims = spark.createDataFrame(rows, "subject string, dimension string, micros long, value string, document int")
    assert [tuple(r) for r in R.contradictions(claims).collect()] == [("a", "place", 0, 2, 2, "x", "y")]


def test_corroboration_counts_a_document_once(spark):
    rows = [("a", "d", 1, "cdr", 5), ("a", "d", 1, "bank", 9), ("b", "d", 1, "cdr", 1), ("b", "d", 2, "bank", 2), ("c", "d", 1, "cdr", 1), ("c", "d", 2, "cdr", 2), ("e", "d", 1, "cdr", 1), ("e", "d", 2, "cdr", 2)]
    claims = spark.createDataFrame(rows, "subject string, dimension string, document int, kind string, micros long").withColumn("value", F.lit(" At  Home"))
    against = spark.createDataFrame([("e", "d", "at home", False), ("e", "d", "at home", False), ("b", "d", "at home", True)], "subject string, dimension string, value string, negated boolean")
    got = {r.subject: (r.support, r.status) for r in R.corroboration(claims, against).collect()}
    assert got == {"a": (1, "SINGLE_SOURCE"), "b": (2, "MULTI_TYPE_CORROBORATED"), "c": (2, "MULTI_SOURCE_SUPPORTED"), "e": (2, "CONFLICTED")}
    assert {r.subject for r in R.corroboration(claims, least=2).collect()} == {"b", "c", "e"}


def test_corroboration_is_of_one_value(spark):
    """Different values, and a value and its denial, support each other in nothing; a conflict taints what is claimed in its hour only."""
    hour, day = 3_600_000_000, 86_400_000_000
    rows = [("s", "status", "open", 1, 1, "cdr", 0), ("s", "status", "closed", 1, 2, "bank", 11 * day), ("s", "status", " Open. ", 1, 3, "bank", 12 * day), ("s", "status", "open", -1, 4, "bank", 13 * day),
        ("t", "place", "x", 1, 1, "cdr", 0), ("t", "place", "y", 1, 2, "cdr", hour // 2), ("t", "place", "z", 1, 3, "cdr", 5 * day), ("t", "place", "z", 1, 4, "cdr", 6 * day), ("t", "place", None, 1, 5, "cdr", 0)]
    claims = spark.createDataFrame(rows, "subject string, dimension string, value string, polarity int, document int, kind string, micros long")
    got = {(r.subject, r.value, r.negated): (r.support, r.status) for r in R.corroboration(claims, R.contradicted(claims)).collect()}
    assert got == {("s", "open", False): (2, "MULTI_TYPE_CORROBORATED"), ("s", "closed", False): (1, "SINGLE_SOURCE"), ("s", "open", True): (1, "SINGLE_SOURCE"),
        ("t", "x", False): (1, "CONFLICTED"), ("t", "y", False): (1, "CONFLICTED"), ("t", "z", False): (2, "MULTI_SOURCE_SUPPORTED"), ("t", "", False): (1, "SINGLE_SOURCE")}


def test_convergence(spark):
    rows = spark.createDataFrame([(3, 2), (2, 2), (1, 2), (3, 1), (0, 0)], "k int, d int").select("k", "d", R.convergence(F.col("k"), F.col("d")).alias("c"))
    assert [r.c for r in rows.collect()] == ["INDEPENDENT_SOURCE_CONVERGENCE", "MULTI_SOURCE", "MULTI_RECORD", "SINGLE_SOURCE", "NONE"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "subject string, dimension string, micros long, value string, document int, kind string")
    assert R.contradictions(none).count() == R.corroboration(none).count() == 0
    q = R.queue_summary(none, F.col("value") == "open", F.col("micros").cast("double")).first()
    assert tuple(q) == (0, 0, 0.0)


def test_shared_pairs_leave_hubs_out(spark):
    links = spark.createDataFrame([(p, "hub") for p in range(13)] + [(1, "e"), (2, "e"), (2, "e"), (3, "f")], "person int, entity string")
    assert [tuple(r) for r in G.shared_pairs(links).collect()] == [(1, 2, 1)]


def test_read_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b": 1, "a": "x"}\nbroken {\n[1]\n\n{"a": null, "c": {"d": [1, 2]}}\n')
    got = read_json_lines(spark, str(tmp_path / "a.jsonl"))
    assert got.columns == ["a", "b", "c"]
    assert sorted(tuple(r) for r in got.collect()) == [("", "", '{"d":[1,2]}'), ("x", "1", "")]


def test_a_stream_checks_only_changed_keys(spark, tmp_path):
    schema, src, out = "user long, n long", str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1), (2, 1)], schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    detect = lambda rows: rows.groupBy("user").agg(F.sum("n").alias("n")).filter("n >= 2")
    q = on_changes(stream, lambda: spark.read.schema(schema).parquet(src), detect, ["user"], lambda found, number: found.withColumn("batch", F.lit(number)).write.mode("append").parquet(out), str(tmp_path / "state"))
    try:
        q.processAllAvailable()
        spark.createDataFrame([(2, 1)], schema).coalesce(1).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.user, r.n) for r in spark.read.schema("user long, n long, batch int").parquet(out).collect()} == {(2, 2)}


def test_conflicts_by_the_rule_of_each_dimension(spark):
    """Against all pairs of random claims, and the cases that the rules name."""
    import itertools
    import random

    hour, day = 3_600_000_000, 86_400_000_000
    rng = random.Random(5)
    values = {"LOCATION": "abc", "EVENT": "ab", "AMOUNT": "123", "ROLE": "xy", "STATUS": ["open", "PENDING", "Closed", "PROSECUTED", "lost"], "RELATIONSHIP": ["knows:a", "owns:a", "knows:b"], "OTHER": "ab"}
    rows = []
    for _ in range(600):
        d = rng.choice(list(values))
        rows.append((rng.choice("st"), d, rng.choice([None, 0, hour - 1, hour, day, 2 * day]), rng.choice([*values[d], None]), rng.choice(["ADVERSE", "NEUTRAL", "OFFICIAL", "LEAD", None]) if d == "ROLE" else None, rng.choice([-1, 1]), rng.choice([1, 2, 3, 4, 5, None])))
    family = {"OPEN": "ACTIVE", "PENDING": "ACTIVE", "CLOSED": "CONCLUDED", "PROSECUTED": "CHARGED"}
    groups = {}
    for s, d, m, v, c, p, doc in rows:
        if v is None or doc is None or d == "OTHER" or d in ("AMOUNT", "STATUS") and m is None:
            continue
        class_ = {"ROLE": c if c in ("ADVERSE", "NEUTRAL", "OFFICIAL") else None, "STATUS": family.get(v.upper())}.get(d, v)
        width = {"LOCATION": hour, "EVENT": hour, "AMOUNT": hour, "STATUS": day}.get(d)
        if class_:
            at = groups.setdefault((s, d, None if m is None or not width else m - m % width, v.split(":")[-1] if d == "RELATIONSHIP" else None), {})
            at[class_, doc] = min(at.get((class_, doc), (9e18, 9)), (-1 if m is None else m, p))
    want = {}
    for g, at in groups.items():
        n = sum(a[0] != b[0] and a[1] != b[1] and (g[1] != "RELATIONSHIP" or at[a][1] != at[b][1]) for a, b in itertools.combinations(at, 2))
        if n:
            want[g] = (n, len({a[0] for a in at}), len({a[1] for a in at}))
    df = spark.createDataFrame(rows, "subject string, dimension string, micros long, value string, category string, polarity int, document long")
    got = {(r.subject, r.dimension, r.bucket, r.target): (r.conflicts, r["values"], r.documents) for r in R.conflicts(df).collect()}
    assert got == want and len({g[1] for g in got}) == 6
    assert R.conflicts(df.limit(0)).count() == 0
