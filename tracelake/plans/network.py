"""Queries on the contact network as a whole: who stands between others, communities, bridges and the paths across them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.operators import centrality as C
from tracelake.operators import community as M
from tracelake.operators import graph as G
from tracelake.operators import review as R
from tracelake.plans.catalog import CALLS, query
from tracelake.scratch import cut
from tracelake.sources import calls

#: Confidence of a contact: a tenth for each call one way, 1 at most.
CONTACTS = f"""{CALLS}, one AS (SELECT src, dst, CAST(least(10, count(*)) * 100000 AS BIGINT) AS w FROM calls WHERE src <> dst GROUP BY src, dst),
    und AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM one GROUP BY ALL), e AS MATERIALIZED (SELECT a AS node, b AS nxt, w FROM und UNION ALL SELECT b, a, w FROM und),
    nodes AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)"""


def contacts(spark, d):
    per = calls(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return per.select("src", "dst", F.least(F.lit(1.0), F.col("n") / 10).alias("weight"))


def betweenness_sql(rounds: int = 6) -> str:
    """Common tables up to `bet` (node, betweenness), with every round of the recursions as a step: all nodes as sources, and `rounds`
    is more than the links of any shortest path."""
    dist = "".join(f"d{k} AS MATERIALIZED (SELECT s, node, min(d) AS d FROM (SELECT * FROM d{k - 1} UNION ALL SELECT s, nxt, d + w FROM d{k - 1} JOIN e USING (node)) GROUP BY s, node), " for k in range(1, rounds + 1))
    wave = lambda name, a, b: "".join(f"{name}{k} AS MATERIALIZED (SELECT st.s, st.{b} AS node, sum(x) AS x FROM st JOIN {name}{k - 1} p ON p.s = st.s AND p.node = st.{a} GROUP BY ALL), " for k in range(1, rounds + 1))
    every = lambda name: " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(rounds + 1))
    return f"""WITH {CONTACTS}, d0 AS (SELECT node AS s, node, CAST(0 AS BIGINT) AS d FROM nodes WHERE node IS NOT NULL), {dist}
    st AS MATERIALIZED (SELECT u.s, u.node AS a, v.node AS b FROM d{rounds} u JOIN e USING (node) JOIN d{rounds} v ON v.s = u.s AND v.node = e.nxt AND v.d = u.d + e.w),
    p0 AS (SELECT s, node, 1.0::DOUBLE AS x FROM d0), {wave("p", "a", "b")} paths AS MATERIALIZED (SELECT s, node, sum(x) AS x FROM ({every("p")}) GROUP BY ALL),
    q0 AS (SELECT s, node, 1 / x AS x FROM paths), {wave("q", "b", "a")} back AS (SELECT s, node, sum(x) AS g FROM ({every("q")}) GROUP BY ALL),
    through AS (SELECT node, sum(greatest(0.0, x * g - 1)) AS t FROM paths JOIN back USING (s, node) WHERE s <> node GROUP BY node), n AS (SELECT count(node) AS n FROM nodes),
    bet AS (SELECT node, round(coalesce(t, 0) / ((n - 1) * (n - 2)), 9) AS betweenness FROM nodes LEFT JOIN through USING (node), n WHERE node IS NOT NULL)"""


def scores(spark, d, edges=None):
    return C.betweenness(contacts(spark, d) if edges is None else edges).select("node", F.round("betweenness", 9).alias("betweenness"))


@query(f"{betweenness_sql()} SELECT * FROM bet")
def betweenness(spark, d):
    """Over the shortest paths from all nodes, however many there are."""
    return scores(spark, d)


@query(f"""{betweenness_sql()}, deg AS (SELECT node, count(*) AS degree FROM e GROUP BY node)
    SELECT node, betweenness, degree FROM bet JOIN deg USING (node) WHERE degree >= 3 AND betweenness >= 0.5 * (SELECT max(betweenness) FROM bet) AND betweenness > 0""")
def connectors(spark, d):
    """Nodes of at least half the greatest betweenness with three links or more."""
    degree = C.undirected(contacts(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return C.connectors(scores(spark, d), degree, 0.5)


@query()
def communities(spark, d):
    """Every phone with its community and the community's size; equal to no SQL, so the tests hold the operator against planted groups and modularity."""
    found = M.louvain(contacts(spark, d))
    return found.join(M.signals(found, 1), "community")


@query()
def network_bridges(spark, d):
    """Phones of the top 5 % by betweenness whose eight surest contacts lie in two other communities or more."""
    e = contacts(spark, d)
    return C.network_bridges(scores(spark, d), M.louvain(e), R.top_neighbours(e, 8))


@query()
def bridging_paths(spark, d):
    """From every phone whose number is divisible by 50 the surest paths into the three nearest other communities."""
    e = contacts(spark, d)
    roots = e.select(F.col("src").alias("node")).union(e.select("dst")).filter("node % 50 = 0").distinct()
    out = C.bridging_paths(e, M.louvain(e), roots)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query()
def hub_findings(spark, d):
    """The five phones that most paths lead through."""
    e = cut(contacts(spark, d))  # read by both, several times each
    return C.hubs(scores(spark, d, e), G.pagerank(e), 5).withColumn("rank", F.round("rank", 8))
