"""Vector code compression: product codes whose codebooks are learned in whole numbers.

A vector is cut into equal parts; each part position has a codebook, and a vector's code is the number
of the nearest entry for each part. Codebooks start as parts of the vectors with the smallest ids. In
each round the driver builds a kd-tree per codebook and broadcasts these (`entries` points a part, so
of bounded size); tasks find every part's nearest entry by branch and bound and send back integer sums
per entry, which are added up where they are counted and again in the shuffle; the driver gets one row
per entry and component and divides.

Search: a node is left out only if its bounding box is farther than the best distance so far. Nodes at
an equal distance are visited, so that of equally near entries the one with the lowest index is found.
All parts of a batch descend together.

- Nulls: rows with a null vector, or one that holds null or non-finite components, take no part. Null
  ids come last in the start; null labels are one label.
- The length of the vectors is that of the smallest kept id's; it has to be a multiple of `parts`, or
  the trailing components, too few for a part each, aren't coded. Vectors of another length, and empty
  ones, take no part.
- Components are held within ± LIMIT after scaling, so that a vector's error is a long; sums over
  vectors are exact at any size, and an error of a label beyond a long is given as the greatest long.
- Empty tables give no row. With fewer than `entries` vectors there are as many entries.
- Repeated rows are vectors of their own; of equal ids those with the smaller vector start first.
- Other columns are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Greatest magnitude of a scaled component; less in vectors of over 1,024, so that the sum of squared distances is always a long.
LIMIT = 1 << 25
#: Labels whose error sums are broadcast; more are joined by a shuffle.
FEW = 100_000


@dataclass
class Tree:
    """A kd-tree over the entries of one codebook: tight boxes, median splits, the entries of a node in `order[a:b]`."""

    points: np.ndarray
    order: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    span: list[tuple[int, int]]
    children: list[tuple[int, int] | None]

    @staticmethod
    def build(points: np.ndarray, leaf: int = 2) -> Tree:
        tree = Tree(points, np.arange(len(points)), [], [], [], [])

        def node(a: int, b: int) -> int:
            own, at = points[tree.order[a:b]], len(tree.low)
            low, high = own.min(0), own.max(0)
            tree.low.append(low)
            tree.high.append(high)
            tree.span.append((a, b))
            tree.children.append(None)
            if b - a > leaf and (high - low).max(initial=0) > 0:
                by = own[:, int((high - low).argmax())]
                tree.order[a:b] = tree.order[a:b][np.argsort(by, kind="stable")]
                middle = (a + b) // 2
                tree.children[at] = (node(a, middle), node(middle, b))
            return at

        node(0, len(points))
        return tree

    def bound(self, node: int, x: np.ndarray) -> np.ndarray:
        """Squared distance from points to a node's box."""
        away = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0)
        return np.einsum("ij,ij->i", away, away)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance of every point; the lowest index on ties."""
        best, at = np.full(len(x), np.iinfo("i8").max), np.zeros(len(x), "i8")

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if (inside := self.children[node]) is None:
                a, b = self.span[node]
                for entry in self.order[a:b]:
                    away = x[rows] - self.points[entry]
                    d = np.einsum("ij,ij->i", away, away)
                    won = (d < best[rows]) | ((d == best[rows]) & (entry < at[rows]))
                    best[rows[won]], at[rows[won]] = d[won], entry
                return
            left, right = (self.bound(child, x[rows]) for child in inside)
            first = left <= right
            for child, other, mine, far in ((*inside, first, right), (*inside[::-1], ~first, left)):
                visit(child, rows[mine])
                visit(other, rows[mine][far[mine] <= best[rows[mine]]])  # equal bounds are visited

        visit(0, np.arange(len(x)))
        return at, best


def components(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype("i8", copy=False)
    return values.reshape(len(column), -1)


def whole_vectors(rows: DataFrame, vector: str, key: str, scale: int) -> DataFrame:
    """(key, label, v): vectors of finite components only, scaled, floored and held within LIMIT."""
    v = F.col(vector)
    x = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(x(c)) | (F.abs(x(c)) == float("inf"))
    most = F.least(F.lit(float(LIMIT)), F.floor(F.sqrt(F.lit(2.0**60) / F.size(v))).cast("double"))
    held: Column = F.transform(v, lambda c: F.floor(F.greatest(-most, F.least(most, x(c) * scale))).cast("int"))
    good = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    return rows.filter(good).select(F.col(key).cast("long").alias("vec_id"), F.col("label"), held.alias("v"))


def sums(vectors: DataFrame, trees: list[Tree], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to the number of its vectors' parts and their sums: one row per entry and component comes back."""
    shared = vectors.sparkSession.sparkContext.broadcast(trees)  # entries of each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        most = max(len(t.points) for t in trees)
        n, total = np.zeros((len(trees), most), "i8"), np.zeros((len(trees), most, width), "i8")
        for b in batches:
            x = components(b.column("v"))
            for k, tree in enumerate(trees):
                part = x[:, k * width : (k + 1) * width]
                at, _ = tree.nearest(part)
                n[k] += np.bincount(at, minlength=most)
                np.add.at(total[k], at, part)
        k, entry = np.nonzero(n)
        if len(k):
            at = np.repeat(np.arange(len(k)), width)
            columns = [k[at], entry[at], np.tile(np.arange(width), len(k)), n[k, entry][at], total[k, entry].ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "n", "total"])

    rows = vectors.select("v").mapInArrow(run, "part long, entry long, place long, n long, total long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")]
    got = rows.groupBy("part", "entry", "place").agg(*whole).collect()  # entries times components
    shared.destroy()
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in got:
        out.setdefault((r["part"], r["entry"]), (int(r["n"]), [0] * width))[1][r["place"]] = int(r["total"])
    return out


def learn(vectors: DataFrame, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebooks, one per part: entries by components. Vectors are of one length."""
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    matrix = np.array([r["v"] for r in start], "i8")
    width = matrix.shape[1] // parts
    books = [matrix[:, k * width : (k + 1) * width].copy() for k in range(parts)]
    for _ in range(rounds):
        for (part, entry), (n, total) in sums(vectors, [Tree.build(b) for b in books], width).items():
            books[part][entry] = [t // n for t in total]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, and the squared distances' sum."""
    trees = [Tree.build(b) for b in books]
    shared = vectors.sparkSession.sparkContext.broadcast(trees)  # entries of each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        digits = np.array([f"{i:02x}" for i in range(max(len(t.points) for t in trees))])
        for b in batches:
            x = components(b.column("v"))
            code, error = np.full(len(x), "", f"U{2 * len(trees)}"), np.zeros(len(x), "i8")
            for k, tree in enumerate(trees):
                width = tree.points.shape[1]
                at, far = tree.nearest(x[:, k * width : (k + 1) * width])
                code, error = np.char.add(code, digits[at]), error + far
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error (over equal labels) and a digest of the final codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits per part")
    every = cut(whole_vectors(rows, vector, key, scale))
    first = every.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("n")).collect()
    length = first[0]["n"] if first else parts
    vectors = every.filter(F.size("v") == length)
    books = learn(vectors, parts, entries, rounds) if first else [np.zeros((1, 1), "i8")] * parts
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry.tolist()).encode()).hexdigest()
    coded = cut(encode(vectors, books))
    coded_by = coded.withColumn("__name", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("__none", F.col("label").isNull())
    per = coded_by.groupBy("__name", "__none").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    per = cut(per)
    if per.count() <= FEW:
        per = F.broadcast(per)  # checked; more labels meet by a shuffle, where a hot one is split
    out = cut(coded_by.join(per, ["__name", "__none"]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
    release(every, coded)
    return out
