"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

Documents are read in blocks. A block holds its distinct pre-tokens once and, per document, the places
of its pre-tokens in that list with their frequencies. The pre-tokens of all blocks meet by a shuffle
and are sorted, so that each distinct one is split into pieces by the library once (again only where a
batch of rows begins, or where a hot partition is split) and every block that has it gets the number. A
document's count is the sum of frequency times pieces. No token id is ever made.

Blocks are bounded by the length of their texts, so a frequent pre-token is one row per block, not one
per document, and no row grows with the corpus. Blocks are written to the checkpoint folder before
they are joined, so all later steps see the same blocks if executors are lost.

Special strings of the tokenizer inside a text count as one token each, as the library does by default.

- Nulls: a null text is empty and has 0 bytes and 0 tokens; a null doc_id is kept.
- Empty tables give no row; empty texts and texts of white space have 0 tokens.
- Very long texts are read whole; one that is longer than a block is a block of its own.
- Repeated rows are counted each. There are no ties.
- Other columns are ignored, so none can clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Characters of text in a block (a longer text makes a block of its own), and documents in it.
BLOCK, BLOCK_ROWS = 1 << 23, 10_000
#: Words whose numbers of pieces a task holds before it sends them back by block.
HELD = 1_000_000
#: The pattern of pre-tokens at which `Splitter.by_chunk` holds, and what it matches in ASCII; fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")

BLOCKS = "block long, doc_id array<long>, n_bytes array<long>, special array<long>, sizes array<int>, places binary, times binary, words array<string>"


class Splitter:
    """Splits texts into the pre-tokens of a tokenizer file; keeps the pre-tokens of chunks, which are what lies between white space."""

    def __init__(self, path: str, cached: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] is None:
            raise ValueError("only tokenizers with pre-tokens, which are split each by itself, are covered")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError("added tokens with stripping, word bounds or normalization aren't covered")
        specials = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        normalizers = (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"]] if spec["normalizer"] else [])
        self.lower = any(n["type"] == "Lowercase" for n in normalizers)
        self.by_chunk = self.cuts_at_space(spec, normalizers) and not any(re.search(r"\s", s) for s in specials)
        self.cached, self.known = cached, {}

    @staticmethod
    def cuts_at_space(spec: dict, normalizers: list[dict]) -> bool:
        """Whether pre-tokens never hold white space and don't depend on what is beyond it: ASCII white space composes with nothing, and no branch of the pattern matches it."""
        first, *rest = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        plain = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ") for n in normalizers)
        words = first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed" and first["pattern"] == {"Regex": PATTERN}
        return plain and words and all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in rest)

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special strings."""
        parts = self.special.split(text) if self.special else [text]
        normal, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        out: list[str] = []
        for part in parts:
            if self.by_chunk and part.isascii() and part.isprintable() and " " not in part:
                out += ASCII.findall(part.lower() if self.lower else part)  # these characters stand for themselves
            elif part:
                out += [w for w, _ in pre.pre_tokenize_str(normal.normalize_str(part) if normal else part)]
        return out, len(parts) - 1

    def chunk(self, chunk: str) -> tuple[list[str], int]:
        got = self.known.get(chunk)
        if got is None:
            if len(self.known) >= self.cached:
                self.known.clear()
            got = self.known[chunk] = self.split(chunk)
        return got

    def frequencies(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, then (text, place of the pre-token, frequency) in that order, and the number of special strings per text."""
        words: dict[str, int] = {}
        if self.by_chunk:
            lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
            chunks = pc.list_flatten(lists).dictionary_encode()
            n = max(len(chunks.dictionary), 1)
            pair, times = np.unique(pc.list_parent_indices(lists).to_numpy().astype("i8") * n + chunks.indices.to_numpy(), return_counts=True)
            row, unit = pair // n, pair % n
            split = [self.chunk(c) if c else ([], 0) for c in chunks.dictionary.to_pylist()]
        else:
            split = [self.split(t) for t in texts]
            row = unit = np.arange(len(texts))
            times = np.ones(len(texts), "i8")
        place = np.fromiter((words.setdefault(w, len(words)) for got, _ in split for w in got), "i8")
        size = np.fromiter((len(got) for got, _ in split), "i8", len(split))
        special = np.bincount(row, np.fromiter((k for _, k in split), "f8", len(split))[unit] * times, len(texts)).astype("i8")
        ends, of = np.cumsum(size), size[unit]
        at = np.repeat(ends[unit] - of, of) + np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)
        n = max(len(words), 1)
        key, back = np.unique(np.repeat(row, of) * n + place[at], return_inverse=True)
        total = np.bincount(back, np.repeat(times, of), len(key)).astype("i8")
        return list(words), key // n, key % n, total, special


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed by bytes of equal weight."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view("u1").reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 4 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, n).T).view("<u4").ravel().astype("i8")


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    """Blocks of documents: distinct pre-tokens once, and all documents' places in that list (as differences) and frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter, number = Splitter(path), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            words, row, place, times, special = splitter.frequencies([r[2] for r in rows])
            first = np.diff(row, prepend=-1) != 0
            columns = [[number], [[r[0] for r in rows]], [[r[1] for r in rows]], [special], [np.bincount(row, minlength=len(rows))], [packed(np.where(first, place, np.diff(place, prepend=0)))], [packed(times)], [words]]
            kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "doc_id", "n_bytes", "special", "sizes", "places", "times", "words"])

        for b in batches:
            for i, n_bytes, text in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                if rows and (held + len(text) > BLOCK or len(rows) >= BLOCK_ROWS):
                    yield block()
                    rows, held, number = [], 0, number + 1
                rows.append((i, n_bytes, text))
                held += len(text)
        if rows:
            yield block()

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def pieces(words: DataFrame, path: str) -> DataFrame:
    """(block, places, pieces) of rows (block, place, word): words meet, sorted, and each is split into the pieces of the tokenizer's model once. Several rows
    may come back for a block."""

    def by_block(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        block, place, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((place, block))
        first = np.flatnonzero(np.diff(block[order], prepend=block[order[0]] - 1))
        ends = pa.array([*first, len(order)], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(block[order[first]]), *(pa.ListArray.from_arrays(ends, pa.array(c[order])) for c in (place, n))], ["block", "places", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenize = Tokenizer.from_file(path).model.tokenize
        held, rows = [], 0
        for b in batches:
            word = b.column("word").dictionary_encode()
            n = np.fromiter((len(tokenize(w)) for w in word.dictionary.to_pylist()), "i4", len(word.dictionary))
            held.append((b.column("block").to_numpy(), b.column("place").to_numpy(), n[word.indices.to_numpy()]))
            rows += b.num_rows
            if rows >= HELD:
                yield by_block(held)
                held, rows = [], 0
        if rows:
            yield by_block(held)

    return words.hint("rebalance", "word").sortWithinPartitions("word").mapInArrow(run, "block long, places array<int>, pieces array<int>")


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the sum of frequency times pieces, and special strings."""
    for b in batches:
        for r in range(b.num_rows):
            x = {c: b.column(c)[r] for c in b.schema.names}
            sizes = x["sizes"].values.to_numpy().astype("i8")
            n, total = int(sizes.sum()), np.zeros(len(sizes), "i8")
            if n:
                jump, times = (unpacked(x[c].as_py(), n) for c in ("places", "times"))
                ends = np.cumsum(sizes)
                run = np.cumsum(jump)
                before = np.concatenate([[0], run])[ends - sizes]  # what earlier documents add to the running sum
                place, got = (x["of"].values.field(c).flatten().to_numpy() for c in ("places", "pieces"))
                pieces = np.empty(len(place), "i8")  # every place of the block comes back once
                pieces[place] = got
                each = pieces[run - np.repeat(before, sizes)] * times
                total = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends])])
            yield pa.RecordBatch.from_arrays([x["doc_id"].values, x["n_bytes"].values, pa.array(total + x["special"].values.to_numpy(), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens)."""
    blocks = cut(blocks_of(docs, path))
    got = pieces(blocks.select("block", F.posexplode("words").alias("place", "word")), path)
    of = got.groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("of"))  # a block's words are bounded by its texts
    each = blocks.drop("words").join(of, "block", "left").mapInArrow(sums, "doc_id long, n_bytes long, n_tokens long")  # blocks of empty texts have no words
    out = cut(each.withColumn("over_limit", F.col("n_tokens") > limit))
    release(blocks)
    return out
