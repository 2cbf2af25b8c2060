"""Operators on small hand-made tables."""

import numpy as np
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators import graph as G
from tracelake.operators import patterns as P
from tracelake.operators import search as V
from tracelake.plans import catalog
from tracelake.sources import read_csv


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_identifiers(spark):
    assert one(spark, "+91 98765-43210", S.normalize_phone) == "+919876543210"
    assert one(spark, "12345", S.normalize_phone) is None
    assert one(spark, "mh 12 ab 3456", S.normalize_plate) == "MH12AB3456"
    assert one(spark, "sbin0001234", S.normalize_ifsc) == "SBIN0001234"
    assert one(spark, "1234", S.normalize_account) is None
    assert one(spark, "₹1.5 lakh", S.parse_amount) == 150000.0
    assert one(spark, "Mr. A. Kumar", S.normalize_name) == "a kumar"
    assert one(spark, " Smt: Devi's  O'Neil-Rao s/o X", S.normalize_name) == "devi oneil rao x"
    assert one(spark, None, S.normalize_name) == one(spark, None, S.mask_account) == ""


def test_similarity_and_distance(spark):
    df = spark.createDataFrame([("abc", "abd")], "a string, b string")
    assert df.select(S.jaccard(S.trigrams(F.col("a")), S.trigrams(F.col("b")))).first()[0] == 2 / 6
    d = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    assert abs(d.select(S.haversine_km(*map(F.col, "abcd"))).first()[0] - 111.19) < 0.01


def test_structuring_takes_first_window(spark):
    t = spark.createDataFrame([(1, 2, 40.0, 0, 1, 1), (1, 2, 45.0, 86400, 2, 1), (1, 2, 500.0, 2 * 86400, 3, 1), (3, 2, 40.0, 0, 4, 1)], "src long, dst long, amount double, seconds long, evidence long, line int")
    got = P.structuring(t, 2, 30, 50, 500).collect()
    assert [(r.src, r.small_transfers, r.window_total, r.seconds) for r in got] == [(1, 2, 585.0, 0)]


def test_speed(spark):
    t = spark.createDataFrame([("a", 1, 0, 0.0, 0.0), ("a", 2, 1800, 0.0, 1.0), ("a", 3, 36000, 0.0, 1.1)], "person string, id int, at int, lat double, lon double")
    got = P.implied_speed(t, "person", F.col("at"), "lat", "lon").collect()
    assert [(r.from_id, r.to_id) for r in got] == [(1, 2)] and abs(got[0].kmh - 222.39) < 0.01


def test_pagerank_adds_up_and_components(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0)], "src long, dst long, weight double")
    assert abs(sum(r["rank"] for r in G.pagerank(e, 6).collect()) - 1) < 1e-9
    assert {(r.node, r.component) for r in G.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def plain_pagerank(edges, turns=100, damping=0.85, tolerance=1e-6):
    weight = {}
    for a, b, w in edges:
        if a is not None and b is not None:
            weight[a, b] = weight.get((a, b), 0) + (w or 0)
    nodes = {v for e in weight for v in e}
    gives = {v: sum(w for (a, _), w in weight.items() if a == v) for v in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for turn in range(turns):
        loose = sum(rank[v] for v in nodes if gives[v] <= 0) / len(nodes)
        new = {v: (1 - damping) / len(nodes) + damping * loose + damping * sum(rank[a] * w / gives[a] for (a, b), w in weight.items() if b == v and gives[a] > 0) for v in nodes}
        moved, rank = sum(abs(new[v] - rank[v]) for v in nodes), new
        if moved < tolerance * len(nodes):
            break
    return turn, {v: r / sum(rank.values()) for v, r in rank.items()}


def test_pagerank_like_a_loop(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(24), rng.choice([0, rng.randrange(30)]), rng.choice([0.01, 0.5, 1.0, 0.0, None])) for _ in range(120)] + [(40, 41, 0.0), (42, 42, 1.0), (None, 1, 1.0), (1, None, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    turn, want = plain_pagerank(edges)
    got = {r.node: r["rank"] for r in G.pagerank(df).collect()}
    assert 3 < turn < 99 and got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    _, short = plain_pagerank(edges, 2)
    assert all(abs(r["rank"] - short[r.node]) < 1e-12 for r in G.pagerank(df, 2).collect())
    assert G.pagerank(df.limit(0)).count() == 0


def test_chain_flags_the_edited_row_only(spark):
    z = "0" * 64
    rows = spark.createDataFrame([("c", 1, z, "a", "a"), ("c", 2, "a", "x", "b"), ("c", 3, "x", "c", "c")], "chain string, n int, prev string, own string, want string")
    assert [r.n for r in G.verify_chain(rows, "n", "prev", "own", F.col("want")).collect()] == [2]


def test_read_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id;name;name\n1; x ;y\n2;z\n")
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert got == [("1", "x", "y"), ("2", "z", "")]


def test_burner_phones_read_all_calls(spark, tmp_path):
    rows = [(1, 1, "signup", "2024-01-01", 8), (2, 1, "login", "2024-01-02", 9), (3, 200, "signup", "2024-01-01", 8), (4, 200, "signup", "2024-01-02", 9), (5, 200, "login", "2024-06-01", 9)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string, k int")
    events = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.format_string('{"k": %d}', "k").alias("props"), F.lit(1.0).alias("value"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted((r.phone, r.counterparties, r.calls) for r in catalog.QUERIES["burner_phones"](spark, str(tmp_path)).collect()) == [(1, 2, 2), (8, 2, 2)]


def test_components_and_shared_pairs_read_all_rows(spark, tmp_path):
    """Part 1 has 13 persons, so no pair; part 2 joins suppliers 1 and 2 outside the slices."""
    lines = [(i, 1, 1, 1.0, 0.0) for i in range(1, 14)] + [(1, 2, 1, 50.0, 0.1), (2, 2, 2, 1.0, 0.0), (3, 3, 3, 1.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, 100 + i) for i in range(1, 14)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.node: r.component for r in catalog.QUERIES["components"](spark, str(tmp_path)).collect()}
    assert got == {"A1": "A1", "A2": "A1", "B1": "A1", "B2": "A1", "A3": "A3", "B3": "A3"}
    assert [tuple(r) for r in catalog.QUERIES["shared_pairs"](spark, str(tmp_path)).collect()] == [(101, 102, 1)]


def test_temporal_paths_of_four_hops(spark):
    rows = [(1, 3, 1), (3, 4, 2), (4, 5, 3), (2, 5, 4), (3, 2, 0), (3, 2, 2), (1, 2, 9), (5, 6, 3), (6, 2, 5), (4, 2, 1), (1, 5, 4), (7, 7, 1)]
    got = sorted(tuple(r.path) for r in G.temporal_paths_between(spark.createDataFrame(rows, "src long, dst long, at long"), 1, 2).collect())

    def walk(path, at):
        if path[-1] == 2:
            return [path]
        steps = [(y, t) for a, b, t in rows for x, y in ((a, b), (b, a)) if x == path[-1] and y not in path and t >= at] if len(path) < 5 else []
        return [p for y, t in steps for p in walk((*path, y), t)]

    assert got == sorted(walk((1,), -1)) and (1, 3, 4, 5, 2) in got


def test_cosine_answers_every_query(spark):
    v = np.random.default_rng(4).normal(size=(200, 6))
    v[120:140] = v[100]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(250, None), (300, [0.0] * 6), (350, [float("nan")] * 6), (400, [1.0] * 5)]
    got = sorted((r.query_id, r.rank, r.vec_id) for r in V.cosine_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, block=32).collect())
    u = v / np.sqrt((v * v).sum(1))[:, None]
    c = np.round(u @ u.T, 9)
    want = {q: sorted((-c[q, i], i) for i in range(200) if i != q and c[q, i] >= 0.05)[:8] for q in (0, 50, 100, 150)}
    assert got == [(q, k, i) for q, best in want.items() for k, (_, i) in enumerate(best, 1)]


def test_temporal_path_counts(spark):
    """Ways that meet in blocks and by the join are the paths made one by one, many times over the same links."""
    import random

    r = random.Random(21)
    rows = [(r.randrange(9), r.randrange(9), r.randrange(30)) for _ in range(220)] + [(3, 4, 5)] * 6 + [(None, 4, 1), (3, None, 1)]
    e = spark.createDataFrame(rows, "src long, dst long, at long")
    want = {}
    for x in G.temporal_paths_between(e, 1, 2).collect():
        n, first = want.get(tuple(x.path), (0, 1 << 60))
        want[tuple(x.path)] = n + 1, min(first, x.start)
    for crowd, block in ((0, 3), (0, 1024), (40, 5), (1 << 20, 1024)):
        got = [((1, *(v for v in (x.a, x.b, x.c) if v is not None), 2), (x.times, x["first"])) for x in G.temporal_path_counts(e, 1, 2, crowd, block).collect()]
        assert len(got) == len(dict(got)) and dict(got) == want
    assert {len(p) for p in want} == {2, 3, 4, 5}


def test_temporal_path_counts_send_no_way_once_per_block(spark, monkeypatch):
    """In crowded middle nodes a block of ways is one row, and ways that meet are read, not shuffled."""
    rows = [(u, v, t) for t in range(12) for u, v in ((1, 3 + t % 4), (3 + t % 4, 20), (20, 30 + t % 3), (30 + t % 3, 2))]
    e = spark.createDataFrame(rows, "src long, dst long, at long")
    plans, sizes, met = [], [], G.B.met
    monkeypatch.setattr(G.B, "met", lambda x, y, *a: plans.append((out := met(x, y, *a))._jdf.queryExecution().executedPlan().toString()) or sizes.extend((x.count(), y.count())) or out)
    got = {(x.a, x.b, x.c): x.times for x in G.temporal_path_counts(e, 1, 2, crowd=0, block=2).collect() if x.c is not None}
    want = {}
    for x in G.temporal_paths_between(e, 1, 2).collect():
        if len(x.path) == 5:
            want[tuple(x.path[1:4])] = want.get(tuple(x.path[1:4]), 0) + 1
    assert got == want and len(want) >= 12
    assert len(plans) == 1 and "Exchange" not in plans[0] and max(sizes) < 40


def test_components_broadcast_nothing(spark, monkeypatch):
    """No table of nodes goes through the driver, however small its files are."""
    plans = []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda df, *spent: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *spent))[1])
    got = {r.node: r.component for r in G.components(spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(10)} | {20: 20, 21: 20}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)


def test_transfers_are_dealt_over_more_tasks(spark, monkeypatch):
    """What a task holds is bounded by rows, not by the session's number of shuffle partitions; results stay."""
    from tracelake import sources

    d = "/root/testdata/sf0.001"
    names = ("transfer_pairs", "repeated_combination", "use_vs_ownership", "suppressed_hubs")
    get = lambda name: catalog.QUERIES[name](spark, d)
    before = {name: sorted(map(tuple, get(name).collect())) for name in names}
    monkeypatch.setattr(sources, "TASK_ROWS", 500)
    for name in names:
        assert sorted(map(tuple, get(name).collect())) == before[name]
        assert "REPARTITION_BY_NUM" in get(name)._jdf.queryExecution().executedPlan().toString()
    held = get("transfer_pairs").rdd.glom().map(lambda rows: sum(r.n for r in rows)).collect()
    assert len(held) == 12 and max(held) < 1500
