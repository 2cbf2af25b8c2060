"""Cases that the driver tables don't hold."""

from pyspark.sql import functions as F

from tracelake.operators import evidence as E


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, 3), (3, 2), (1, 4), (4, 5), (2, 5), (6, 6)], "src long, dst long")
    assert [tuple(r) for r in E.shortest_paths(edges, 1, 2, 5).collect()] == [("1>3>2", 2), ("1>4>5>2", 3)]
    assert not E.shortest_paths(edges, 1, 6).collect()


def test_sufficiency(spark):
    rows = [(2, 1, 0.9, False), (2, 1, 0.9, True), (1, 2, 0.65, False), (1, 3, 0.5, False), (1, 4, 0.9, False), (0, 1, 0.9, False), (1, 5, 1.0, False)]
    got = spark.createDataFrame(rows, "d long, h long, c double, x boolean").select(E.sufficiency(F.col("d"), F.col("h"), F.col("c"), F.col("x")))
    assert [r[0] for r in got.collect()] == ["FACT", "INFERENCE", "INFERENCE", "INFERENCE", "HYPOTHESIS", "UNKNOWN", "UNKNOWN"]


def test_case_network_leaves_hubs_out(spark):
    links = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (1, "hub"), (2, "hub"), (3, "hub"), (None, "x")], "case_id long, entity string")
    assert [tuple(r) for r in E.case_network(links.dropna(), 2).collect()] == [(1, 2, 1, 3, "MODERATE")]


def test_quarantine_is_idempotent(spark, tmp_path):
    rows = E.with_reason(spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "")], "id long, text string"), {"NULL": F.col("text").isNull(), "EMPTY": F.col("text") == ""})
    for _ in range(2):
        E.write_quarantine(rows, "id", str(tmp_path / "q"))
    assert sorted((r.id, r.reason) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [(2, "NULL"), (3, "EMPTY")]
    assert {(r.reason, r.n) for r in E.rejected_share(rows).collect()} == {("NULL", 2), ("EMPTY", 1), ("ACCEPTED", 1)}


def test_case_network_counts_hubs(spark):
    links = spark.createDataFrame([(c, e) for e in ("x", "y") for c in range(60)] + [(0, "z"), (1, "z")], "case_id long, entity string")
    got = {(r.a, r.b): (r.shared, r.evidence) for r in E.case_network(links).collect()}
    assert len(got) == 60 * 59 // 2 and got.pop((0, 1)) == (3, 6) and set(got.values()) == {(2, 4)}
