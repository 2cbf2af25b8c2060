"""Exact search by cosine: blocks of queries against blocks of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine_top_k(vectors: DataFrame, is_query: Column, k: int = 8, least: float = 0.05, block: int = 2048) -> DataFrame:
    """Per query row the best `k` other rows (query_id, rank, vec_id, cosine) with a cosine of `least` or more, from (vec_id, embedding).
    Equal cosines (to 12 places) go by vec_id. Vectors that are null, empty, zero or not finite have no cosine; lengths must agree.
    A pair of blocks leaves k rows per query, so pairs of vectors are never rows."""
    e = vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "is_query").filter("vec_id is not null and size(v) > 0")
    e = e.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    n, m = e.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, asked = max(1, -(-n // block)), max(1, -(-m // block))
    own = F.xxhash64("vec_id")
    left = e.filter("is_query").withColumn("i", F.pmod(own, F.lit(asked))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).drop("is_query")
    right = e.withColumn("j", F.pmod(own, F.lit(blocks))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))).drop("is_query")

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        v = np.array(t.column("v").to_pylist(), "f8")
        return t.column("vec_id").to_numpy(), v / np.sqrt((v * v).sum(1))[:, None]

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
        if x.num_rows and y.num_rows:
            (a, p), (b, q) = matrix(x), matrix(y)
            for i, query in enumerate(p):
                cosine = np.round(q @ query, 12)
                at = np.flatnonzero((cosine >= least) & (b != a[i]))
                at = at[np.lexsort((b[at], -cosine[at]))[:k]]
                found.append((np.full(len(at), a[i]), b[at], cosine[at]))
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "cosine"])

    keys = ("dim", "i", "j")
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("cosine", 4).alias("cosine"))
