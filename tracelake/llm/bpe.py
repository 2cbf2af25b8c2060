"""BPE encoding and decoding by a tokenization automaton.

The automaton reads token labels. It starts as one state that loops on every byte; each merge
(u, v) -> w then applies one gadget: the state t that u-labelled arcs enter is copied to t' without
its v-arc, the u-arcs are redirected to t', and every state with a u-arc gets a w-arc to where v led.
After all merges its arc sequences are exactly the BPE segmentations, so each byte string has one
accepting path, and every prefix of that path is the path of a prefix of the string.

All arcs of one label enter one state, and a copy differs from its origin by one removed arc. So the
state after label x lacks the arcs that x's own merges removed, those that x's right part had lost
before x was made, and so on. It is stored as the right and left parts, the times at which labels were
made and one table of removed arcs, linear in the number of merges; a label younger than a removal has
the arc if its left part had it.

Encoding reads bytes from left to right and follows an arc of the longest label first; where no arc
leads on it steps back. A position is tried once at most, as a prefix has one path only. Decoding
emits the labels of the arcs.

Words are independent, so bounded caches keep the results of frequent ones.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema_with

#: Unicode White_Space without what Python adds to it; fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The byte-level pre-splitter's pattern; fixed value.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Marks a chunk that has no space before it; texts that hold this character aren't cut into chunks.
RAW = "\x02"
#: A full stop or comma that the pre-splitter joins to what is before it.
STOPS = re.compile(r"(?:[^\w\s]|_)[.,][ \n]")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Tables of the tokenization automaton. Build with `compile_automaton`."""

    def __init__(self, labels: dict[int, bytes], specials: dict[str, int]):
        top = max([*labels, *specials.values()]) + 1
        self.labels = [labels.get(i, b"") for i in range(top)]
        self.specials = specials
        for text, i in specials.items():
            self.labels[i] = text.encode()
        self.left, self.right = [-1] * top, [-1] * top  # parts of a merged label
        self.born = [-1] * top  # the merge that made the label: 0 for bytes, -1 if nothing leads to it
        self.removed: dict[int, int] = {}  # (label before, label) to the merge that removed the arc

    def allows(self, last: int, label: int) -> bool:
        """Whether the state that `last` leads to (-1: the start) has an arc for `label`."""
        removed, born, before = self.removed, self.born, 1 << 60
        while last >= 0:
            part, until = label, 1 << 60
            while part >= 0:
                time = removed.get(last << 20 | part)
                if time is not None and time < before and born[part] < time <= until:
                    return False
                part, until = self.left[part], born[part]
            last, before = self.right[last], born[last]
        return True

    def merge(self, u: int, v: int, w: int, time: int) -> None:
        """One merge gadget."""
        if self.born[u] < 0 or self.born[v] < 0 or self.born[w] >= 0 or not self.allows(u, v):
            return  # the pair can't occur: the merge never fires
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.removed[u << 20 | v] = time


def compile_automaton(path: str) -> Automaton:
    """Compiles the merges of a byte-level tokenizer file. Raises ValueError for what the automaton doesn't cover."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("only byte-level BPE without normalizer or prefix space is covered")
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
        raise ValueError("added tokens with stripping, word bounds or normalization aren't covered")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    specials = {a["content"]: a["id"] for a in spec["added_tokens"]}
    a = Automaton({i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in specials}, specials)
    for char in alphabet:
        if char in vocab:
            a.born[vocab[char]] = 0
    for time, pair in enumerate(model["merges"], 1):
        u, v = pair.split(" ") if isinstance(pair, str) else pair
        a.merge(vocab[u], vocab[v], vocab[u + v], time)
    return a


class Coder:
    """Encodes and decodes whole texts. Caches are emptied when full, so memory is bounded."""

    def __init__(self, automaton: Automaton, cached: int = 400_000, fast: bool = False):
        """fast: words go through tiktoken's merge loop over the same labels, for callers that only need the ids."""
        self.a, self.cached = automaton, cached
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.arcs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.specials, key=len, reverse=True))) + ")") if automaton.specials else None
        self.trie: list[dict[int, int]] = [{}]
        self.ends = [-1]
        for i, label in enumerate(automaton.labels):
            if automaton.born[i] >= 0:
                node = 0
                for b in label:
                    nxt = self.trie[node].get(b)
                    if nxt is None:
                        nxt = self.trie[node][b] = len(self.trie)
                        self.trie.append({})
                        self.ends.append(-1)
                    node = nxt
                self.ends[node] = i
        if fast:
            import tiktoken

            self.of_rank = sorted((i for i, time in enumerate(automaton.born) if time >= 0), key=automaton.born.__getitem__)
            ranks = {automaton.labels[i]: rank for rank, i in enumerate(self.of_rank)}
            self.merge_loop = tiktoken.Encoding("own", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
            self.word = self.word_fast

    def word_fast(self, word: str) -> bytes:
        return array("I", map(self.of_rank.__getitem__, self.merge_loop(word.encode()))).tobytes()

    def word(self, word: str) -> bytes:
        """A pre-split word's ids, as little-endian unsigned 32-bit integers: the automaton's one path over its bytes."""
        data, trie, ends, arcs = word.encode(), self.trie, self.ends, self.arcs
        n, at, path, dead, waiting, fresh = len(data), 0, [], set(), [], True
        while at < n:
            if fresh:  # the labels that start here, the longest last
                node, found = 0, []
                for j in range(at, n):
                    node = trie[node].get(data[j], -1)
                    if node < 0:
                        break
                    if ends[node] >= 0:
                        found.append((ends[node], j + 1))
                waiting.append(found)
            found, last = waiting[-1], path[-1][0] if path else -1
            fresh = False
            while found:
                label, to = found.pop()
                if to in dead:
                    continue
                ok = arcs.get(key := (last + 1) << 20 | label)
                if ok is None:
                    if len(arcs) > 4 * self.cached:
                        arcs.clear()
                    ok = arcs[key] = self.a.allows(last, label)
                if ok:
                    path.append((label, at))
                    at, fresh = to, True
                    break
            if not fresh:
                if not path:
                    raise ValueError(f"a byte of {word[:50]!r} isn't in the vocabulary")
                dead.add(at)
                waiting.pop()
                at = path.pop()[1]
        return array("I", [label for label, _ in path]).tobytes()

    def keep(self, cache: dict[str, bytes], key: str, ids: bytes) -> bytes:
        """Adds to a cache; when it is full, the older half goes."""
        if len(key) < 64:
            if len(cache) >= self.cached:
                for old in list(islice(cache, self.cached // 2)):
                    del cache[old]
            cache[key] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, by the pre-splitter."""
        words = self.split(text)
        known = list(map(self.words.get, words))
        if None in known:
            for i, ids in enumerate(known):
                if ids is None:
                    known[i] = self.keep(self.words, words[i], self.word(words[i]))
        return b"".join(known)

    def chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk of `section`; None where the pre-splitter looks further."""
        body = chunk[1:] if chunk[:1] == RAW else chunk
        if body == "\n" and body is not chunk:
            return self.keep(self.chunks, chunk, self.word(body))
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        text = body if body is not chunk else " " + body
        return self.keep(self.chunks, chunk, self.word(text) if body.isalpha() else self.plain(text))

    def section(self, text: str) -> bytes:
        """The pre-splitter never joins what a single space or line end between other characters parts, nor a letter and the
        full stop or comma after it, so what stands between them is looked up whole. RAW marks chunks without a space before them."""
        if not text or text[0].isspace() or RAW in text:
            return self.plain(text)
        t = text.replace("\n", f" {RAW}\n {RAW}")
        if not STOPS.search(text):
            t = t.replace(". ", f" {RAW}. ").replace(", ", f" {RAW}, ")
        parts = (RAW + t).split(" ")
        out = list(map(self.chunks.get, parts))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None and (ids := self.chunk(parts[i])) is None:
                    return self.plain(text)
                out[i] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.section(text)
        specials = self.a.specials
        return b"".join(np.uint32(specials[s]).tobytes() if s in specials else self.section(s) for s in self.special.split(text) if s)

    def decode(self, ids: np.ndarray) -> str:
        """Emits the labels of the arcs."""
        return b"".join(map(self.a.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


_coders: dict[tuple, Coder] = {}


def coder_of(shared: Shared, fast: bool = False) -> Coder:
    """A worker keeps one coder, with its caches, over the tasks that it runs for a tokenizer."""
    if (shared.id, fast) not in _coders:
        _coders.clear()
        _coders[shared.id, fast] = Coder(shared.value, fast=fast)
    return _coders[shared.id, fast]


class Shared:
    """A broadcast automaton (bounded by the vocabulary) under an id."""

    def __init__(self, spark, path: str):
        automaton = compile_automaton(path)
        self.value_ = spark.sparkContext.broadcast(automaton)
        self.id = hashlib.sha256(repr((automaton.labels, automaton.left, automaton.specials)).encode()).hexdigest()

    @property
    def value(self) -> Automaton:
        return self.value_.value


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids` (array<int>) to all rows. A null text counts as empty and gives no ids. A column of this name is replaced."""
    docs = docs.drop(ids)
    shared, schema = Shared(docs.sparkSession, tokenizer), schema_with(docs, {ids: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for b in batches:
            got = [np.frombuffer(coder.encode(t or ""), "<i4") for t in b.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype("i4")
            values = np.concatenate(got) if got else np.empty(0, "i4")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))], [*b.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the decoded text to rows with ids; null ids give a null text. A column of this name is replaced."""
    rows = rows.drop(text)
    shared, schema = Shared(rows.sparkSession, tokenizer), schema_with(rows, {text: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for b in batches:
            got = [None if x is None else coder.decode(np.array(x, "i8")) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, text])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the decoded text. Encodes and decodes in one pass without holding id lists as rows."""
    shared = Shared(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = coder_of(shared), hashlib.sha256
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text"):
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(sha(ids).hexdigest())
                text_sha.append(sha(coder.decode(np.frombuffer(ids, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
