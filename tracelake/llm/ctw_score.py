"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with the bits before it as a prefix. For every prefix there is a
context tree over the bytes before: the node of the last d bytes counts the decision's zeros and ones.
A node's Krichevsky-Trofimov estimate depends on the counts only, so the weighted probability of a
subtree, half its node's estimate plus half the product of its children's, is computed from counts
gathered over all training texts. A decision is then predicted by mixing the estimates of all depths,
each weighted by the posterior of stopping there; a context never seen is left to the depth before it.
The logs of a text's bytes and of its end add up to its score.

Counts are gathered in blocks of documents: a block counts its n-grams once and sends them, packed, to
as many parts as the last two context bytes hash to. A part adds up the blocks' counts and builds all
trees below depth two; the trees' tops have as many nodes as there are bytes and prefixes (65,536 at
most) and go through the driver. Parts answer each block with the logs of its n-grams. Word counts, for
the base score, are gathered the same way. What is gathered grows with the corpus; nothing of it is
broadcast but the tops.

Texts are lower-cased in A to Z. Null text counts as empty. With no training text every bit costs one.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder

DEPTH = 5
#: Bytes of text in a block, on average.
BLOCK = 32 << 20
END = b"\xff"  # never a byte of UTF-8
STEP = 1 << 21  # bytes that are worked on at once


def lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series at x + 8, taken back."""
    y, below = x + 8.0, np.ones_like(x, float)
    for i in range(8):
        below = below * (x + i)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(below)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


def windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of depth + 1 bytes, the last of which is predicted, for all bytes and ends of all texts; the texts' starts among them."""
    pad = END * depth
    data = np.frombuffer(b"".join(pad + t + END for t in texts), "u1")
    lengths = np.array([len(t) + 1 for t in texts])
    at = np.arange(lengths.sum()) + np.repeat(np.arange(1, len(texts) + 1) * depth, lengths)
    code = np.zeros(len(at), "u8")
    for j in range(depth, -1, -1):
        code = code << np.uint64(8) | data[at - j]
    return code, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def in_steps(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t) + 1
        if size >= STEP:
            yield part
            part, size = [], 0
    if part:
        yield part


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not codes:
        return np.empty(0, "u8"), np.empty(0, "i8")
    got, where = np.unique(np.concatenate(codes), return_inverse=True)
    return got, np.bincount(where, np.concatenate(counts), len(got)).astype("i8")


def packed(codes: np.ndarray) -> bytes:
    """Ordered codes as their steps, which compress well."""
    return np.diff(codes, prepend=np.uint64(0)).tobytes()


def unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, "u8"), dtype="u8")


def ngrams(texts: list[bytes], train: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their counts in training texts (0 for those only elsewhere)."""
    codes, counts = [], []
    for kind in (True, False):
        for part in in_steps([t for t, x in zip(texts, train, strict=True) if x is kind]):
            got, n = np.unique(windows(part, depth)[0], return_counts=True)
            codes.append(got)
            counts.append(n if kind else np.zeros(len(got), "i8"))
    return summed(codes, counts)


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds the trees of the last two context bytes."""
    last = (codes >> np.uint64(8) & np.uint64(0xFFFF)).astype("i8")
    return (last * 40503 + (last >> 7)) % 65521 % parts


class Trees:
    """The nodes from depth two on, over all n-grams of a part."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, symbol = depth, (codes & np.uint64(255)).astype("i8")
        k = np.arange(8)
        self.prefix = (1 << k | symbol[:, None] >> 8 - k).ravel()
        self.bit = (symbol[:, None] >> 7 - k & 1).ravel()
        weight = np.repeat(counts, 8)
        context = np.repeat((codes >> np.uint64(8)).astype("i8"), 8)
        self.nodes = {}
        below = None
        for d in range(depth, 1, -1):
            keys, where = np.unique((context & (1 << 8 * d) - 1) << 8 | self.prefix, return_inverse=True)
            ones = np.bincount(where, weight * self.bit, len(keys))
            zeros = np.bincount(where, weight, len(keys)) - ones
            own = estimate(zeros, ones)
            if below is None:
                whole = own
            else:
                under = np.bincount(self.parent(where, below[0]), below[1], len(keys))
                whole = np.where(zeros + ones > 0, math.log(0.5) + np.logaddexp(own, under), 0.0)
            self.nodes[d] = (where, zeros, ones, own, whole)
            below = (where, whole)
        self.keys = keys

    @staticmethod
    def parent(where: np.ndarray, child: np.ndarray) -> np.ndarray:
        """For each child node, its parent."""
        out = np.zeros(child.max(initial=-1) + 1, "i8")
        out[child] = where
        return out

    def tops(self) -> pd.DataFrame:
        """Depth-two nodes, by last byte and prefix."""
        _, zeros, ones, _, whole = self.nodes[2]
        return pd.DataFrame({"byte": self.keys >> 8 & 255, "prefix": self.keys & 255, "zeros": zeros, "ones": ones, "whole": whole})

    def logs(self, top: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
        """log10 of the predicted probability of each n-gram's last byte."""
        p = None
        for d in range(self.depth, -1, -1):
            if d > 1:
                where, zeros, ones, own, whole = (x if i == 0 else x[self.nodes[d][0]] for i, x in enumerate(self.nodes[d]))
            else:
                at = (np.repeat((codes >> np.uint64(8) & np.uint64(255)).astype("i8"), 8), self.prefix) if d else self.prefix
                zeros, ones, own, whole = (top[f"{x}{d}"][at] for x in ("zeros", "ones", "own", "whole"))
            n = zeros + ones
            here = (np.where(self.bit > 0, ones, zeros) + 0.5) / (n + 1.0)
            if p is None:
                mixed = here
            else:
                stop = np.exp(np.minimum(math.log(0.5) + own - whole, 0.0))
                mixed = np.where(seen, stop * here + (1 - stop) * p, here)
            p, seen = mixed, n > 0
        return np.log10(p).reshape(-1, 8).sum(1)


def tops_of(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """Depths one and zero, from the sums over depth-two nodes."""
    top = {f"{x}{d}": np.zeros((256, 256) if d else 256) for x in ("zeros", "ones", "own", "whole") for d in (0, 1)}
    at = (rows["byte"].to_numpy("i8"), rows["prefix"].to_numpy("i8"))
    under = np.zeros((256, 256))
    top["zeros1"][at], top["ones1"][at], under[at] = rows["zeros"], rows["ones"], rows["whole"]
    for d in (1, 0):
        zeros, ones = top[f"zeros{d}"], top[f"ones{d}"]
        top[f"own{d}"] = estimate(zeros, ones)
        top[f"whole{d}"] = np.where(zeros + ones > 0, math.log(0.5) + np.logaddexp(top[f"own{d}"], under), 0.0)
        if d:
            top["zeros0"], top["ones0"], under = zeros.sum(0), ones.sum(0), top["whole1"].sum(0)
    return top


def tokens(text: bytes) -> list[bytes]:
    return text.split()  # at ASCII white space, as bytes do


def packed_blocks(rows: DataFrame) -> DataFrame:
    """(block, docs): rows of a block that stand together in a batch, lower-cased and compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            where: dict[int, list[int]] = {}
            for i, block in enumerate(b.column("block").to_pylist()):
                where.setdefault(block, []).append(i)
            ids, learn, text = b.column("doc_id").to_pylist(), b.column("learn").to_pylist(), b.column("text").to_pylist()
            out = [pack(pickle.dumps(([ids[i] for i in at], [learn[i] for i in at], [text[i].encode().lower() for i in at]))) for at in where.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(where), pa.int64()), pa.array(out, pa.binary())], ["block", "docs"])

    return rows.mapInArrow(run, "block long, docs binary")


def opened(docs: pd.Series) -> tuple[list, list[bool], list[bytes]]:
    """Ids, whether they teach, and texts of a block's documents."""
    unpack = zstandard.ZstdDecompressor().decompress
    out: tuple[list, list, list] = ([], [], [])
    for x in docs:
        for have, more in zip(out, pickle.loads(unpack(x)), strict=True):
            have += more
    return out


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """Scores all documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if depth < 2:
        raise ValueError("the depth is 2 or more")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block + 1
    parts = int(min(65521, max(32, blocks)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))

    def count(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        _, train, texts = opened(docs["docs"])
        codes, n = ngrams(texts, train, depth)
        part, out = part_of(codes, parts), []
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        words: Counter = Counter()
        others: set[bytes] = set()
        for t, x in zip(texts, train, strict=True):
            if x:
                words.update(tokens(t))
            else:
                others.update(tokens(t))
        for w in others:
            words.setdefault(w, 0)
        dealt: list[list] = [[] for _ in range(parts)]
        for w in words:
            dealt[zlib.crc32(w) % parts].append(w)
        for p in range(parts):
            i = order[ends[p] : ends[p + 1]]
            out.append((key[0], p, packed(codes[i]), n[i].astype("u4").tobytes(), b" ".join(dealt[p]), np.array([words[w] for w in dealt[p]], "u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "part", "codes", "n", "words", "c"])

    packed_docs = packed_blocks(rows)
    gathered = cut(packed_docs.groupBy("block").applyInPandas(count, "block long, part int, codes binary, n binary, words binary, c binary"))

    def trees(docs: pd.DataFrame) -> tuple[Trees, np.ndarray, list[np.ndarray]]:
        lists = [unpacked(x) for x in docs["codes"]]
        codes, n = summed(lists, [np.frombuffer(x, "u4") for x in docs["n"]])
        return Trees(codes, n, depth), codes, lists

    def word_counts(docs: pd.DataFrame) -> tuple[Counter, list[list[bytes]]]:
        c: Counter = Counter()
        split = [x.split(b" ") if x else [] for x in docs["words"]]
        for words, n in zip(split, docs["c"], strict=True):
            for w, x in zip(words, np.frombuffer(n, "u4").tolist(), strict=True):
                c[w] += x
        return c, split

    def top(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        c = word_counts(docs)[0]
        whole = pd.DataFrame({"byte": [-1], "prefix": [-1], "zeros": [float(sum(x > 0 for x in c.values()))], "ones": [float(sum(c.values()))], "whole": [0.0]})
        return pd.concat([trees(docs)[0].tops(), whole])

    keyed = gathered.groupBy("part").applyInPandas(top, "byte int, prefix int, zeros double, ones double, whole double")
    sums = keyed.groupBy("byte", "prefix").agg(*(F.sum(x).alias(x) for x in ("zeros", "ones", "whole"))).toPandas()  # 65,537 rows at most
    tops = docs.sparkSession.sparkContext.broadcast(tops_of(sums[sums["byte"] >= 0]))
    overall = sums[sums["byte"] < 0]
    ends = rows.filter("learn").count()
    total = int(overall["ones"].sum()) + ends
    vocabulary = int(overall["zeros"].sum()) + (ends > 0)

    def answer(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        tree, codes, lists = trees(docs)
        logs = tree.logs(tops.value, codes).astype("f4")
        c, split = word_counts(docs)
        return pd.DataFrame({"block": docs["block"], "codes": docs["codes"], "logs": [logs[np.searchsorted(codes, x)].tobytes() for x in lists], "words": docs["words"], "c": [np.array([c[w] for w in x], "i8").tobytes() for x in split]})

    answers = gathered.groupBy("part").applyInPandas(answer, "block long, codes binary, logs binary, words binary, c binary")
    scale = total + 0.5 * (vocabulary + 1)

    def finish(key: tuple, docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([unpacked(x) for x in got["codes"]])
        logs = np.concatenate([np.frombuffer(x, "f4") for x in got["logs"]]).astype("f8")
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        value = {w: math.log10((x + 0.5) / scale) for words, c in zip(got["words"], got["c"], strict=True) if words for w, x in zip(words.split(b" "), np.frombuffer(c, "i8").tolist(), strict=True) if x}
        unseen, end = math.log10(0.5 / scale), math.log10((ends + 0.5) / scale)
        ids, learned, texts = opened(docs["docs"])
        n, known, base, scores = [], [], [], []
        for t in texts:
            words = tokens(t)
            hits = [x for x in map(value.get, words) if x is not None]
            n.append(len(words) + 1)
            known.append(len(hits) + (ends > 0))
            base.append(math.fsum(hits) + (len(words) - len(hits)) * unseen + end)
        for step in in_steps(texts):
            code, starts = windows(step, depth)
            distinct, where = np.unique(code, return_inverse=True)
            scores.append(np.add.reduceat(logs[np.searchsorted(codes, distinct)][where], starts))
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": [not x for x in learned], "n_tokens": n, "n_known": known, "train_tokens": total, "base_score": base, "score": np.concatenate(scores)})

    return packed_docs.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame) -> DataFrame:
    """All documents, learning from those whose fold isn't 1."""
    return score(docs, remainder("doc_id", 5) != 1)
