"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt into cells by median splits fitted on a bounded sample (`FIT` rows, `CELLS` cells at
most), and a cell into as many shards of bounded size as its rows need. Each shard builds a KD-tree by
median splits (of the widest dimension) whose nodes, inner ones too, have tight bounding boxes; it is
built once and stored. A box bounds the inner product of a query with any vector inside: each component
takes the box's end that suits its sign.

A query starts at the cell whose box has the best bound. Its kth score there goes with it to the next
best cells, and from those to all others; a cell whose bound is under the kth score isn't visited. Within
a shard a query descends best first: it opens the node with the best bound, scores a leaf's vectors, and
ends at the first node whose bound is under its kth score. Only nodes strictly under it are left out, so
ties aren't lost. The cells' boxes are taken over all vectors, so the sample decides no result.

A task holds one shard's tree and one group of queries, both of bounded size. A shard returns at most k
rows per query, and the last step keeps the best k.

- A vector that is null or empty or holds a null or non-finite component takes no part; vectors are only
  compared with those of equal length.
- Components are floor(256 * x), at most 2^62 in absolute value; a score that a long can't hold is
  reported (and ordered) as the nearest long but its least value.
- Repeated rows: all rows with a query's vec_id are its own rows, one of them (the least vector) asks;
  other repeated rows are candidates each.
- A null vec_id is no query. As a candidate it is reported as null, after all ids on ties.
- Empty tables give no row; a query without candidates gives none. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: Rows of a shard, queries of a group, rows of a leaf, cells and rows that these are fitted on, and the cells visited in each round (None: all that are left).
SHARD, GROUP, LEAF, CELLS, FIT, ROUNDS = 4096, 2048, 128, 256, 16384, (1, 8, None)
NONE = -(1 << 63)
FOUND = "query_id long, vec_id long, score long"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, dim and integer components of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    most = float(1 << 62)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * 256))).cast("long"))
    rows = embeddings.filter((F.size("embedding") > 0) & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), whole.alias("v"))


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where no sum can lose a bit, by int64, or by Python's integers, held within a long."""
    most = max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) * max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))) * a.shape[1]
    if most < 1 << 53:
        return (a.astype("f8") @ b.T.astype("f8")).astype("i8")
    if most < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), NONE + 1, (1 << 63) - 1).astype("i8")


def bound(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and box, a score that no vector in the box exceeds."""
    up, down = exact_dot(np.maximum(queries, 0), high).astype("f8"), exact_dot(np.minimum(queries, 0), low).astype("f8")
    if max(np.abs(up).max(initial=0), np.abs(down).max(initial=0)) < 1 << 52:
        return (up + down).astype("i8")
    exact = np.maximum(queries, 0).astype(object) @ high.T.astype(object) + np.minimum(queries, 0).astype(object) @ low.T.astype(object)
    return np.clip(exact, NONE + 1, (1 << 63) - 1).astype("i8")


class Tree:
    """A shard's vectors, ordered so that each leaf is a stretch of them; nodes have boxes, children (none: a leaf) and their stretch."""

    def __init__(self, ids: np.ndarray, unnamed: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.children, self.stretch = [], [], [], []
        stack = [(0, len(ids), -1)]
        while stack:
            i, j, parent = stack.pop()
            node, part = len(self.low), vectors[order[i:j]]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            self.stretch.append((i, j))
            if parent >= 0:
                self.children[parent].append(node)
            width = high.astype("f8") - low
            if j - i > leaf and width.max():
                by = np.argsort(part[:, int(width.argmax())], kind="stable")
                order[i:j] = order[i:j][by]
                middle = (i + j) // 2
                stack += [(middle, j, node), (i, middle, node)]
        self.ids, self.unnamed, self.vectors = ids[order], unnamed[order], vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """The best k of the shard per query: (query's place, id, whether it has none, score); floor: a score that the kth overall isn't under.
        All queries descend together, each to its own best open node; those that open the same node share its products."""
        n = len(queries)
        kth = floor.copy()
        score, ids, unnamed = np.full((n, k), NONE), np.zeros((n, k), "i8"), np.ones((n, k), bool)
        open_ = np.full((n, len(self.low)), NONE)
        open_[:, 0] = bound(queries, self.low[:1], self.high[:1])[:, 0]
        every = np.arange(n)
        while True:
            best = open_.argmax(1)
            value = open_[every, best]
            going = np.flatnonzero((value > NONE) & (value >= kth))
            if not len(going):
                break
            for node in np.unique(best[going]):
                q = going[best[going] == node]
                open_[q, node] = NONE
                if self.children[node]:
                    inside = self.children[node]
                    open_[np.ix_(q, inside)] = bound(queries[q], self.low[inside], self.high[inside])
                    continue
                i, j = self.stretch[node]
                own = (self.ids[i:j] == query_ids[q, None]) & ~self.unnamed[i:j]
                s = np.concatenate([score[q], np.where(own, NONE, exact_dot(queries[q], self.vectors[i:j]))], 1)
                x = np.concatenate([ids[q], np.broadcast_to(self.ids[i:j], own.shape)], 1)
                u = np.concatenate([unnamed[q], np.broadcast_to(self.unnamed[i:j], own.shape)], 1)
                top = np.lexsort((x, u, ~s))[:, :k]  # ~s falls as s rises
                score[q], ids[q], unnamed[q] = (np.take_along_axis(z, top, 1) for z in (s, x, u))
                kth[q] = np.maximum(kth[q], score[q, k - 1])
        q, at = np.nonzero(score > NONE)
        return q, ids[q, at], unnamed[q, at], score[q, at]


def splits(sample: np.ndarray, cells: int) -> list[tuple[int, int, int, int]]:
    """Inner nodes (dimension, threshold, left, right) of a tree with `cells` leaves at most; a child is a node, or a cell as -1 - its number. Values up to the threshold go left."""
    nodes: list[tuple[int, int, int, int]] = []
    number = 0

    def grow(part: np.ndarray, room: int) -> int:
        nonlocal number
        width = part.max(0).astype("f8") - part.min(0) if len(part) else np.zeros(1)
        if room < 2 or len(part) < 2 or not width.max():
            number += 1
            return -number
        d = int(width.argmax())
        column = np.sort(part[:, d])
        at = int(column[(len(column) - 1) // 2])
        if at == column[-1]:
            at = int(column[column < at].max())
        me = len(nodes)
        nodes.append((d, at, 0, 0))
        left = grow(part[part[:, d] <= at], room // 2)
        nodes[me] = (d, at, left, grow(part[part[:, d] > at], room - room // 2))
        return me

    grow(sample, cells)
    return nodes


def cells_of(vectors: np.ndarray, nodes: list[tuple[int, int, int, int]]) -> np.ndarray:
    at = np.zeros(len(vectors), "i8") if nodes else np.full(len(vectors), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        for node in np.unique(at[inner]):
            rows = inner[at[inner] == node]
            d, threshold, left, right = nodes[node]
            at[rows] = np.where(vectors[rows, d] <= threshold, left, right)
    return -1 - at


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "i8") for v in column])


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, shard: int = SHARD, group: int = GROUP, cells: int = CELLS, fit: int = FIT) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score; ties to the smaller vec_id."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings)
    total = vectors.count()
    cells = max(1, min(cells, 2 * total // shard))
    routes = {}
    if cells > 1:
        first = vectors.orderBy(F.xxhash64("v", F.lit(1)), "vec_id").limit(fit).toPandas()  # bounded by `fit`
        routes = {int(d): splits(matrix(x["v"]), cells) for d, x in first.groupby("dim")}
    shared = spark.sparkContext.broadcast(routes)  # bounded by `cells` for each of the sample's lengths

    def route(batches):
        for b in batches:
            out = np.zeros(len(b), "i4")
            for d, rows in b.reset_index(drop=True).groupby("dim").groups.items():
                out[rows] = cells_of(matrix(b["v"].iloc[rows]), shared.value.get(int(d), []))
            yield b.assign(cell=out)

    routed = cut(vectors.withColumn("row", F.monotonically_increasing_id()).mapInPandas(route, "vec_id long, dim int, v array<long>, row long, cell int"))
    sizes = routed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = routed.join(sizes, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unnamed = rows["vec_id"].isna().to_numpy()
        tree = Tree(rows["vec_id"].fillna(0).to_numpy("i8"), unnamed, matrix(rows["v"]))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "shard": [key[2]], "low": [tree.low[0]], "high": [tree.high[0]], "tree": [pickle.dumps(tree)]})

    trees = cut(dealt.groupBy("dim", "cell", "shard").applyInPandas(build, "dim int, cell int, shard int, low array<long>, high array<long>, tree binary"))
    ends = trees.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dim", "cell", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes = ends.groupBy("dim", "cell").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box"))  # as many entries as a vector has components

    asks = routed.filter(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select(F.col("vec_id").alias("query_id"), "x.dim", "x.v")
    asks = cut(asks)
    asks_of = asks.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(asks.count() // group + 1)))

    def plan(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each query its cells by falling bound."""
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "cell": [], "place": [], "bound": []})
        low, high = (np.array([[e[x] for e in box] for box in right["box"]], "i8") for x in ("low", "high"))
        got = bound(matrix(left["v"]), low, high)
        order = np.argsort(~got, axis=1, kind="stable")
        n, m = got.shape
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), m), "cell": right["cell"].to_numpy()[order].ravel(), "place": np.tile(np.arange(m), n), "bound": np.take_along_axis(got, order, 1).ravel()})

    batches = asks_of.select("dim", "batch").distinct()
    held = cut(boxes.join(batches, "dim"))  # at most `cells` boxes for each batch of queries
    visits = cut(asks_of.groupBy("dim", "batch").cogroup(held.groupBy("dim", "batch")).applyInPandas(plan, "query_id long, cell int, place int, bound long"))

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"vec_id": "Int64"})
        names = right["query_id"].to_numpy()
        q, ids, unnamed, score = pickle.loads(left["tree"].iloc[0]).search(names, matrix(right["v"]), right["floor"].to_numpy(), k)
        return pd.DataFrame({"query_id": names[q], "vec_id": pd.arrays.IntegerArray(ids, unnamed), "score": score})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found, start = None, 0
    for step in ROUNDS:
        if found is None:
            asking = asks_of.withColumn("floor", F.lit(NONE))
        else:
            kth = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            asking = asks_of.join(kth, "query_id", "left").withColumn("floor", F.coalesce("kth", F.lit(NONE))).drop("kth")
        now = visits.filter(F.col("place") >= start) if step is None else visits.filter((F.col("place") >= start) & (F.col("place") < start + step))
        sent = asking.join(now, "query_id").filter(F.col("bound") >= F.col("floor")).drop("place", "bound").join(trees.select("dim", "cell", "shard"), ["dim", "cell"])
        keys = ("dim", "cell", "shard", "batch")
        pairs = sent.select(*keys).distinct()
        wanted = trees.select("dim", "cell", "shard", "tree").join(pairs, ["dim", "cell", "shard"]).select(*(F.col(x).alias(f"of_{x}") for x in keys), "tree")
        got = wanted.groupBy(*(f"of_{x}" for x in keys)).cogroup(sent.groupBy(*keys)).applyInPandas(search, FOUND)
        every = got if found is None else found.select("query_id", "vec_id", "score").unionByName(got)
        ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = cut(ranked.select("query_id", "rank", "vec_id", "score"), *([found] if found is not None else []))
        start += step or 0
        if step is None or start >= cells:
            break
    release(routed, trees, visits, asks, held)
    return found
