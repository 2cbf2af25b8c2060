"""Best-fit packing of token pieces into sequences, by the linear grouping scheme.

A document's ids, ended by one end id, are cut only if longer than a sequence: pieces of full length,
after a shorter first one where the length isn't a multiple. The scheme then works on the histogram of
piece lengths, which has as many entries as a sequence has tokens, on the driver:

1. pieces over a share of the sequence are large; sorted, they are dealt into groups of equal
   cardinality, and each is rounded up to its group's largest length;
2. the few rounded sizes are packed by configurations: a linear programme over them, solved by column
   generation, is rounded down;
3. actual lengths take the slots of their group, longest first;
4. what is left and the small pieces fill the gaps, longest first, each into the tightest gap.

Equal sequences are planned as runs, so the plan's size depends on the sequence length and not on the
number of documents. Pieces find their place by their rank among those of their length; ranks are
counted in buckets that the pieces are dealt into evenly, so one hot length doesn't meet in one task.

Null text counts as empty: one piece with the end id alone. Repeated rows are packed each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Shared, coder_of
from .common import cut

BUCKETS = 4096


def pieces(docs: DataFrame, tokenizer: str, size: int, end: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and the bucket that they are dealt to in turn."""
    shared = Shared(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = coder_of(shared, fast=True), int(end).to_bytes(4, "little")
        place = count((TaskContext.get().partitionId() * 2654435761) % BUCKETS)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
                out += [(doc, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), next(place) % BUCKETS) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "bucket"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int")


def grouped(hist: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Deals (length, count), longest first, into groups of equal cardinality; a length may be in several."""
    total, out, room = sum(c for _, c in hist), [], 0
    for k, (length, c) in enumerate(hist):
        while c:
            if not room:
                room = -(-total * (len(out) + 1) // groups) - total * len(out) // groups if groups < total else 1
                out.append([])
            take = min(c, room)
            out[-1].append((length, take))
            c, room = c - take, room - take
    return out


def configurations(sizes: list[int], counts: list[int], size: int) -> list[tuple[np.ndarray, int]]:
    """Multisets of rounded sizes with how often each is used: column generation over basic solutions, rounded down."""
    k = len(sizes)
    demand = np.array(counts, float)
    columns = np.diag([size // s for s in sizes]).astype(float)
    weights = np.array(sizes)
    for _ in range(40 * k + 100):
        duals = np.linalg.solve(columns.T, np.ones(k))
        best, took = np.zeros(size + 1), np.full(size + 1, -1)
        for c in range(int(weights.min()), size + 1):  # the most valuable multiset that fits
            gain = np.where(weights <= c, best[np.maximum(c - weights, 0)] + duals, -1.0)
            j = int(gain.argmax())
            best[c], took[c] = (gain[j], j) if gain[j] > best[c - 1] else (best[c - 1], -2)
        if best[size] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), size
        while c > 0 and took[c] != -1:
            if took[c] == -2:
                c -= 1
            else:
                column[took[c]] += 1
                c -= weights[took[c]]
        now, change = np.linalg.solve(columns, demand), np.linalg.solve(columns, column)
        ratio = np.where(change > 1e-12, np.maximum(now, 0) / np.where(change > 1e-12, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = column
    times = np.floor(np.linalg.solve(columns, demand) + 1e-9).astype(int)
    return [(columns[:, j].astype(int), int(times[j])) for j in range(k) if times[j] > 0]


def plan(histogram: dict[int, int], size: int, share: float = 0.125, groups: int = 24) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end of ranks, first sequence, offset, pieces of it per sequence); ranks count from 0 within a length."""
    hist = sorted(((n, c) for n, c in histogram.items() if c), reverse=True)
    if any(n < 1 or n > size for n, _ in hist):
        raise ValueError("lengths are 1 to the sequence's size")
    bins: list[list] = []  # [count, gap, [(length, pieces of it per sequence)]]
    bins += [[c, 0, [(n, 1)]] for n, c in hist if n == size]
    large = [(n, c) for n, c in hist if size * share < n < size]
    rest = defaultdict(int, {n: c for n, c in hist if n <= size * share})
    queues = grouped(large, groups)
    if queues:
        for slots, times in configurations([q[0][0] for q in queues], [sum(c for _, c in q) for q in queues], size):
            runs: list[list[tuple[int, int]]] = []
            for k, repeat in enumerate(slots):
                for _ in range(repeat):
                    taken, need = [], times
                    while need and queues[k]:
                        n, c = queues[k][0]
                        take = min(c, need)
                        taken.append((n, take))
                        need -= take
                        queues[k][0] = (n, c - take)
                        if c == take:
                            queues[k].pop(0)
                    runs.append([*taken, (0, need)] if need else taken)
            left = [[list(x) for x in r] for r in runs]
            while times:  # stretches in which all slots keep their length
                m = min(r[0][1] for r in left)
                lengths = [r[0][0] for r in left if r[0][0]]
                bins.append([m, size - sum(lengths), [(n, 1) for n in lengths]])
                times -= m
                for r in left:
                    r[0][1] -= m
                    if not r[0][1]:
                        r.pop(0)
    for q in queues:
        for n, c in q:
            rest[n] += c
    by_gap: list[list[list]] = [[] for _ in range(size + 1)]
    for b in bins:
        by_gap[b[1]].append(b)
    for n in sorted(rest, reverse=True):
        need, gap = rest[n], n
        while need:
            while gap <= size and not by_gap[gap]:
                gap += 1
            if gap > size:
                per = size // n
                bins.append(run := [-(-need // per), size, []])
            else:
                run, per = by_gap[gap].pop(), gap // n
            fit = min(run[0], need // per)
            parts = [(fit, per)] if fit else []
            if fit < run[0] and need - fit * per and need - fit * per < per:
                parts.append((1, need - fit * per))
            untouched = run[0] - sum(m for m, _ in parts)
            shape, gap_was = run[2], run[1]
            for i, (m, p) in enumerate(parts):
                b = run if i == 0 else [0, 0, []]
                b[:] = [m, gap_was - p * n, [*shape, (n, p)]]
                if i:
                    bins.append(b)
                by_gap[b[1]].append(b)
                need -= m * p
            if untouched:
                bins.append(b := [untouched, gap_was, shape])
                by_gap[gap_was].append(b)
            gap = n
    ranks: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for times, _, shape in bins:
        if not shape:
            continue
        offset = 0
        for n, p in shape:
            rows.append((n, ranks[n], ranks[n] + times * p, first, offset, p))
            ranks[n] += times * p
            offset += n * p
        first += times
    return rows


def sequences(rows: list[tuple[int, int, int, int, int, int]]) -> int:
    return max((first - (low - end) // per for _, low, end, first, _, per in rows), default=0)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, shares: tuple[float, ...] = (0.5, 0.25, 0.125), groups: int = 24) -> DataFrame:
    """Packs all documents: one row per piece with its sequence and place. Of the shares over which a piece is large, the one with the fewest sequences is taken."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer, size, end))
    hist = {r["length"]: r["count"] for r in cutup.groupBy("length").count().collect()}  # at most `size` rows
    rows = sorted(min((plan(hist, size, share, groups) for share in shares), key=sequences))
    table = spark.sparkContext.broadcast(np.array(rows or np.empty((0, 6)), "i8").reshape(-1, 6))
    before = cutup.groupBy("bucket", "length").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (
        cutup.withColumn("at", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece")) - 1)
        .join(before.select("bucket", "length", F.coalesce("before", F.lit(0)).alias("before")), ["bucket", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("at") + F.col("before")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, _, first, offset, per = table.value.T
        keys = length << 44 | low
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(keys, n << 44 | rank, side="right") - 1
            at = rank - low[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[i] + at // per[i]), pa.array(offset[i] + at % per[i] * n)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
