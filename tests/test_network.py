"""Betweenness, communities and bridging paths against plain loops on random graphs."""

import heapq
import random
from collections import defaultdict

import pytest

from tracelake.operators import centrality as C
from tracelake.operators import community as M
from tracelake.operators import graph as G
from tracelake.plans import network as N

SCHEMA = "src long, dst long, weight double"


def random_edges(r, n, m, weights=(0.2, 0.4, 0.6, 1.0, None)):
    out = [(r.randrange(n), r.randrange(n), r.choice(weights)) for _ in range(m)]
    return out + [out[0], (5, 5, 0.3), (n + 1, n + 1, 0.5), (n + 2, n + 3, 0.5)]


def links_of(edges, length):
    w = {}
    for a, b, x in edges:
        if a != b:
            k = (min(a, b), max(a, b))
            w[k] = max(w.get(k, 0), round(max(0.01, min(1.0, 1.0 if x is None else x)) * 10**6))
    out = defaultdict(dict)
    for (a, b), x in w.items():
        out[a][b] = out[b][a] = length(x)
    return out


def dijkstra(links, root):
    """Distances, orders, numbers of shortest paths, nodes before and the smallest node before."""
    d, heap, order, done = {root: 0}, [(0, root)], [], set()
    while heap:
        x, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        order.append(u)
        for v, w in links[u].items():
            if x + w < d.get(v, 1 << 60):
                d[v] = x + w
                heapq.heappush(heap, (d[v], v))
    before = {v: sorted(u for u, w in links[v].items() if u in d and d[u] + w == d[v]) for v in order}
    return d, order, before


def plain_betweenness(edges, sources=None):
    links = links_of(edges, lambda x: x)
    nodes = {x for e in edges for x in e[:2]}
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes if sources is None else sources:
        _, order, before = dijkstra(links, s)
        paths, owed = {s: 1}, defaultdict(float)
        for v in order[1:]:
            paths[v] = sum(paths[u] for u in before[v])
        for v in reversed(order):
            for u in before[v]:
                owed[u] += paths[u] / paths[v] * (1 + owed[v])
            if v != s:
                total[v] += owed[v]
    n = len(nodes)
    k = n if sources is None else len(sources)
    return {v: x / ((n - 1) * (n - 2)) * n / k for v, x in total.items()}


def test_betweenness(spark):
    edges = random_edges(random.Random(1), 30, 55)
    got = {r.node: r.betweenness for r in C.betweenness(spark.createDataFrame(edges, SCHEMA), block=20).collect()}
    assert got == pytest.approx(plain_betweenness(edges))
    assert max(got.values()) > 0


def test_betweenness_of_sampled_sources(spark):
    edges = random_edges(random.Random(3), 30, 60)
    frame = spark.createDataFrame(edges, SCHEMA)
    got = {r.node: r.betweenness for r in C.betweenness(frame.repartition(5), exact=10, sample=8, seed=7).collect()}
    nodes = spark.createDataFrame([(x,) for x in {x for e in edges for x in e[:2]}], "node long")
    sources = [r.node for r in nodes.orderBy(C.F.xxhash64(C.F.lit(7), "node"), "node").limit(8).collect()]
    assert got == pytest.approx(plain_betweenness(edges, sources))


def test_betweenness_keeps_no_row_per_source_and_node(spark, monkeypatch):
    """Over many blocks, with a node of many links in several, and names as nodes: no written table has more rows than links."""
    r = random.Random(2)
    edges = random_edges(r, 36, 70) + [(0, v, r.choice((0.2, 0.4))) for v in range(1, 36)]
    want = plain_betweenness(edges)
    frame = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", w) for a, b, w in edges], "src string, dst string, weight double")
    sizes, kept, cut, dealt = [], [], C.cut, C.dealt_links

    def counted(df, *spent):
        out = cut(df, *spent)
        sizes.append(out.count())
        return out

    def in_small_blocks(both, width):
        out = dealt(both, width, rows=32)
        kept.extend(x.places for x in out[1].collect())
        return out

    monkeypatch.setattr(C, "cut", counted)
    monkeypatch.setattr(C, "dealt_links", in_small_blocks)
    got = {x.node: x.betweenness for x in C.betweenness(frame).collect()}
    assert got == pytest.approx({f"n{v:02}": x for v, x in want.items()})
    assert max(map(len, kept)) > 3 and max(sizes) <= C.undirected(frame).count()


def test_betweenness_of_little(spark):
    one = lambda rows: {r.node: r.betweenness for r in C.betweenness(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert one([]) == {} and one([(1, 2, 0.5)]) == {1: 0, 2: 0} and one([(None, 2, 0.5)]) == {2: 0}
    assert one([(1, 2, 0.5), (2, 3, 0.5)]) == {1: 0, 2: 1, 3: 0}


def test_bridging_paths(spark):
    r = random.Random(4)
    edges = random_edges(r, 25, 45, (0.1, 0.25, 0.5, 1.0))
    nodes = sorted({x for e in edges for x in e[:2]})
    community = {v: v % 6 for v in nodes}
    links = links_of(edges, lambda x: (10**12 + x // 2) // x)
    got = defaultdict(dict)
    roots = [0, 3, 7, 11, 26]
    for x in C.bridging_paths(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame(list(community.items()), "node long, community long"), spark.createDataFrame([(v,) for v in roots], "node long")).collect():
        got[x.root][x["rank"]] = (x.community, x.target, x.length, x.path)
    for root in roots:
        d, _, before = dijkstra(links, root)
        first = {}
        for v in sorted(d, key=lambda v: (d[v], v)):
            if community[v] != community[root]:
                first.setdefault(community[v], v)
        want = {}
        for rank, (c, v) in enumerate(sorted(first.items(), key=lambda x: (d[x[1]], x[1]))[:3], 1):
            path = [v]
            while path[0] != root:
                path.insert(0, before[path[0]][0])
            want[rank] = (c, v, d[v], path)
        assert got[root] == want
    assert any(len(x[3]) > 2 for g in got.values() for x in g.values())


def test_bridging_paths_keep_no_row_per_root_and_node(spark):
    """Every node is a root: the lists that travel hold a few communities a node, not all nodes reached."""
    r = random.Random(14)
    edges = random_edges(r, 40, 90, (0.1, 0.25, 0.5, 1.0))
    nodes = sorted({x for e in edges for x in e[:2]})
    community = {v: v % 9 for v in nodes}
    links = links_of(edges, lambda x: (10**12 + x // 2) // x)
    both = spark.createDataFrame([(a, b, x) for a, to in links.items() for b, x in to.items()], "node long, to long, length long")
    got = C.nearest_communities(both, spark.createDataFrame(list(community.items()), "node long, community long"), 3).collect()
    assert len(got) <= 3 * len(nodes)
    for v in nodes:
        d = dijkstra(links, v)[0]
        first = {}
        for u in sorted(d, key=lambda u: (d[u], u)):
            first.setdefault(community[u], (d[u], u))
        assert sorted((x.d, x.target) for x in got if x.node == v) == sorted(first.values())[:3]


def plain_modularity(edges, label):
    links = links_of(edges, lambda x: x)
    whole = sum(sum(x.values()) for x in links.values())
    inside, total = defaultdict(int), defaultdict(int)
    for a, to in links.items():
        for b, w in to.items():
            total[label[a]] += w
            inside[label[a]] += w * (label[a] == label[b])
    return sum(inside[c] / whole - (total[c] / whole) ** 2 for c in total)


def test_louvain_finds_planted_groups(spark):
    r = random.Random(6)
    edges = [(a, b, 1.0) for a in range(40) for b in range(a) if (a // 10 == b // 10 and r.random() < 0.7) or r.random() < 0.02]
    edges += [(100, 100, 1.0), (5, 5, 1.0)]
    course = []
    frame = spark.createDataFrame(edges, SCHEMA)
    got = {x.node: x.community for x in M.louvain(frame, course=course).collect()}
    assert got == {v: v // 10 * 10 for v in range(40)} | {100: 100}
    assert course == sorted(course) and course[-1] == pytest.approx(plain_modularity(edges, got))
    assert got == {x.node: x.community for x in M.louvain(frame.repartition(7)).collect()}
    labels = spark.createDataFrame(list(got.items()), "node long, community long")
    assert {x.community: x.members for x in M.signals(labels).collect()} == {0: 10, 10: 10, 20: 10, 30: 10}


def test_louvain_never_falls(spark):
    """A star and dense random links, where many nodes want into one community at once."""
    r = random.Random(8)
    edges = [(0, i, 0.5) for i in range(1, 12)] + random_edges(r, 24, 60)
    course = []
    got = {x.node: x.community for x in M.louvain(spark.createDataFrame(edges, SCHEMA), course=course).collect()}
    assert all(b >= a for a, b in zip(course, course[1:])) and course[-1] == pytest.approx(plain_modularity(edges, got))
    assert course[-1] >= 0.9 * max(plain_modularity(edges, got), 0) and all(c in got and got[c] == c for c in got.values())
    assert M.louvain(spark.createDataFrame([], SCHEMA)).collect() == []


def test_louvain_goes_over_links_once_a_partition(spark, monkeypatch):
    """Links dealt over many blocks make the same communities, and a round joins no row per link."""
    r = random.Random(12)
    edges = [(a, b, r.choice((0.2, 1.0))) for a in range(40) for b in range(a) if (a // 10 == b // 10 and r.random() < 0.7) or r.random() < 0.05] + [(0, v, 0.1) for v in range(1, 40)]
    frame = spark.createDataFrame(edges, SCHEMA)
    want = {x.node: x.community for x in M.louvain(frame).collect()}
    links = M.undirected(frame)
    labels = spark.createDataFrame([(v, c) for v, c in want.items()], "node long, community long")
    plain = {(x.node, x.community): x.linked for x in M.linked_to(links, labels).collect()}
    dealt, homes = C.dealt_links(links.withColumnRenamed("weight", "length"), 1, rows=40)
    assert dealt.count() > 4 and homes.filter("size(places) > 4").count() > 0
    assert {(x.node, x.community): x.linked for x in M.linked_in_blocks(dealt, homes, labels).collect()} == plain
    monkeypatch.setattr(M, "FEW", 0)
    monkeypatch.setattr(M, "dealt_links", lambda links, width: C.dealt_links(links, width, rows=64))
    monkeypatch.setattr(M, "linked_to", None)
    assert {x.node: x.community for x in M.louvain(frame).collect()} == want


def test_disjoint_moves_gain_what_they_promise(spark):
    r = random.Random(9)
    edges = [(a, b, 1.0) for a in range(20) for b in range(a) if r.random() < 0.2]
    links = M.undirected(spark.createDataFrame(edges, SCHEMA))
    labels = links.groupBy("node").agg(M.F.sum("weight").alias("strength")).select("node", M.F.col("node").alias("community"), "strength")
    whole = labels.agg(M.F.sum("strength")).first()[0]
    moves = M.disjoint(M.wishes(links, labels, whole), 1).collect()
    assert moves and len({x.old for x in moves} | {x.new for x in moves}) == 2 * len(moves)
    before = plain_modularity(edges, {v: v for v in range(20)})
    after = plain_modularity(edges, {v: next((x.new for x in moves if x.node == v), v) for v in range(20)})
    assert after - before == pytest.approx(sum(x.gain for x in moves) * 2 / whole)


def test_pagerank_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [(a, b, 1.0) for a, b in ((1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (2, 1))]
    edges = spark.createDataFrame(rows, SCHEMA).mapInArrow(count, SCHEMA)
    got = {x.node: x["rank"] for x in G.pagerank(edges).collect()}
    assert made.value == len(rows) and sum(got.values()) == pytest.approx(1) and set(got) == {1, 2, 3, 4, 5}


def test_rules_on_centrality(spark):
    scores = spark.createDataFrame([(i, i / 100) for i in range(40)], "node long, betweenness double")
    communities = spark.createDataFrame([(i, i % 4) for i in range(40)], "node long, community long")
    near = spark.createDataFrame([(39, 1), (39, 2), (38, 2), (38, 6), (37, 0), (2, 3), (2, 1)], "node long, other long")
    assert [(x.node, x.touched, x.percentile) for x in C.network_bridges(scores, communities, near, 95).collect()] == [(39, 2, 98.75)]
    degree = spark.createDataFrame([(39, 2), (38, 3), (37, 9), (3, 9)], "node long, degree long")
    assert sorted(x.node for x in C.connectors(scores, degree).collect()) == [37, 38]
    ranks = G.pagerank(near.select(M.F.col("node").alias("src"), M.F.col("other").alias("dst"), M.F.lit(1.0).alias("weight")))
    assert [x.node for x in C.hubs(scores, ranks, 3).orderBy("place").collect()] == [39, 38, 37]


def test_hub_findings_make_the_contacts_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(N, "contacts", lambda s, d, f=N.contacts: made.append(f(s, d)) or made[-1])
    got = N.hub_findings(spark, "/root/testdata/sf0.001").collect()
    assert len(made) == 1 and [r.place for r in sorted(got, key=lambda r: (-r.betweenness, -r["rank"], r.node))] == list(range(1, len(got) + 1)) and got


def test_betweenness_of_many_nodes_takes_all_sources(spark):
    """Beyond 1,200 nodes no source is left out: two stars, joined, whose leaves differ or are alike."""
    m = 640
    edges = [(c, 10 * i + c, (0.5 if c == 1 else (i % 90 + 10) / 100)) for c in (1, 2) for i in range(1, m + 1)] + [(1, 2, 1.0)]
    got = {r.node: r.betweenness for r in C.betweenness(spark.createDataFrame(edges, SCHEMA)).collect()}
    n = 2 * m + 2
    want = (m * (m - 1) + 2 * m * (m + 1)) / ((n - 1) * (n - 2))
    assert len(got) == n > 1200 and got[1] == pytest.approx(want) and got[2] == pytest.approx(want)
    assert all(x == 0 for v, x in got.items() if v > 2)


def test_betweenness_of_nodes_alike(spark):
    """Nodes with the same links are one row each way, also as ends of paths between two of them, in one block of sources and in many."""
    r = random.Random(31)
    edges = [(v, r.randrange(6), r.choice((0.2, 0.4))) for v in range(10, 22) for _ in range(3)] + [(0, 1, 0.2), (2, 3, 0.4)]
    edges += [(v + 100 * c, k, w) for c in (1, 2, 3) for v, k, w in edges if 10 <= v < 17] + [(50, 51, 0.2), (50, 52, 0.2), (60, 60, 1.0)]
    frame = spark.createDataFrame(edges, SCHEMA)
    both = C.undirected(frame).withColumnRenamed("weight", "length")
    links = links_of(edges, lambda x: x)
    groups = defaultdict(list)
    for v in links:
        groups[tuple(sorted(links[v].items()))].append(v)
    assert {(x.node, x.of, x.size) for x in C.alike(both).collect()} == {(v, min(g), len(g)) for g in groups.values() for v in g}
    assert sum(len(g) >= 4 for g in groups.values()) >= 5
    want = plain_betweenness(edges)
    for block in (600, 7):
        assert {x.node: x.betweenness for x in C.betweenness(frame, block=block).collect()} == pytest.approx(want)


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    """Calls of 1,264 phones, more than there were sources: 1, 2 and 3 with 300, 420 and 540 others each, and 0 between them; the share of paths through these four."""
    calls, ends, sizes = [(0, c) for c in (1, 2, 3) for _ in range(9)], 10, {1: 300, 2: 420, 3: 540}
    for c, m in sizes.items():
        calls += [(v, c) for v in range(ends, ends + m)]
        ends += m
    d = str(tmp_path_factory.mktemp("stars"))
    rows = [(i, v, f'{{"k": {k}}}', "signup", 1.0) for i, (v, k) in enumerate(calls)]
    spark.createDataFrame(rows, "event_id long, user_id long, props string, event_type string, value double").withColumn("ts", M.F.lit("2024-01-01").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    n = sum(sizes.values()) + 4
    branches = {0: [m + 1 for m in sizes.values()]} | {c: [n - 1 - m, *[1] * m] for c, m in sizes.items()}
    return d, {v: round(((n - 1) ** 2 - sum(x * x for x in b)) / ((n - 1) * (n - 2)), 9) for v, b in branches.items()}


def test_connectors_of_many_phones(spark, stars):
    d, want = stars
    got = {x.node: x.betweenness for x in N.connectors(spark, d).collect()}
    assert got == {v: x for v, x in want.items() if x >= max(want.values()) / 2} and len(got) > 2


def test_hub_findings_of_many_phones(spark, stars):
    d, want = stars
    assert {x.node: x.betweenness for x in N.hub_findings(spark, d).collect()} == want


def test_network_bridges_of_many_phones(spark, stars):
    d, want = stars
    assert {x.node: (x.betweenness, x.touched) for x in N.network_bridges(spark, d).collect()} == {0: (want[0], 2)}
