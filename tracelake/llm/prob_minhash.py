"""Near-duplicate classes by ProbMinHash.

ProbMinHash simulates a Poisson process per shingle (five words, lower-cased), with its weight as rate,
from the shingle's own random stream: every arrival hits one of the signature's places, and a place keeps
the shingle with the earliest arrival. Two signatures agree in a place with the probability Jaccard
similarity of the weighted shingles. All weights are 1 here, however often a shingle occurs, so that this
is the Jaccard similarity of the sets, by which links are decided.
First arrivals of all shingles are drawn, then second ones and so on; a shingle stops early, once its
arrivals are later than what all places hold. Words stand between white space; in scripts that are
written without it (Han, kana, Thai, Lao, Khmer, Burmese) each character is a word.

1. Documents with the same shingles collapse to one representative; only representatives go on.
2. Signatures are cut into bands; representatives that share a band meet in a bucket.
3. Buckets are compared by signature, so that rows that allowed pairs join, directly or over others, are
   linked to the least of them. The components of these links are families; whatever agreement doesn't
   rule out lies within one. `screen=False` rules nothing out by agreement.
4. Families are compared with their texts: pairs whose sizes and signatures allow it and which aren't
   linked yet get their exact similarity (Jaccard of the sets of shingles).

Buckets and families are compared in blocks of bounded size, so pairs are never rows. A large one is
first compared within its blocks, each of which also holds a copy of its head (the least row). Rows that
this joins to the head are joined to one another; only the others are then compared across blocks, with
all rows. So a group of n rows of which m aren't joined to its head costs about n and m * n, not n * n.

Classes are the components of all links.

- Nulls: null text counts as empty; a null doc_id loses against any other.
- Empty and short texts: a text shorter than a shingle is one shingle; texts without a word stand alone.
- Very long texts are read whole; a block holds few of them.
- Repeated rows and ties fall into one class, whose id is the least doc_id.
- Empty tables give no row. Of the columns only doc_id and text are read; `survivors` keeps all columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

WORDS, LEAST, PLACES, ROWS = 5, 0.8, 80, 4
#: Rows and shingles of a block.
BLOCK, SHINGLES = 4096, 500_000
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]\p{M}*")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def stepped(n: int) -> np.uint64:
    """n golden steps, modulo 2^64."""
    return np.uint64(int(GOLDEN) * n & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, cached: int = 400_000):
        self.cached, self.known = cached, {}

    def words(self, words: list[str]) -> np.ndarray:
        got = list(map(self.known.get, words))
        if None in got:
            for i, x in enumerate(got):
                if x is None:
                    if len(self.known) >= self.cached:
                        self.known.clear()
                    got[i] = self.known[words[i]] = int.from_bytes(hashlib.blake2b(words[i].encode(), digest_size=8).digest(), "little")
        return np.array(got, "u8")

    def shingles(self, text: str, words: int = WORDS) -> np.ndarray:
        """Hashes of all shingles of a text, in order; one of the whole text if it is shorter."""
        found = text.lower().split()
        if not found:
            return np.empty(0, "u8")
        h = self.words(found)
        n = max(1, len(h) - words + 1)
        out = np.zeros(n, "u8")
        for j in range(min(words, len(h))):
            out = mixed(out + GOLDEN) ^ h[j : j + n]
        return mixed(out)


def spaced(text: str) -> str:
    """A text in lower case with blanks around the characters of scripts that are written without them."""
    text = text.lower()
    return text if text.isascii() else UNSPACED.sub(r" \g<0> ", text)


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """ProbMinHash signatures of n weighted sets at once; (owner, element) pairs are distinct."""
    best = np.full(n * places, np.inf)
    sig = np.zeros(n * places, "u8")
    time, turn = np.zeros(len(elements)), 0
    while len(elements):
        stream = mixed(elements + stepped(2 * turn + 1))
        time = time - np.log(((stream >> np.uint64(11)) + np.uint64(1)).astype("f8") / 2.0**53) / weights
        at = owner * places + (mixed(elements + stepped(2 * turn + 2)) % np.uint64(places)).astype("i8")
        np.minimum.at(best, at, time)
        won = best[at] == time
        sig[at[won]] = elements[won]
        latest = best.reshape(n, places).max(1)
        going = time < latest[owner]
        owner, elements, weights, time = owner[going], elements[going], weights[going], time[going]
        turn += 1
    return sig.reshape(n, places)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band."""
    n, places = sig.shape
    cutup = sig.reshape(n, places // rows, rows)
    out = np.broadcast_to(np.arange(places // rows, dtype="u8") + np.uint64(1), cutup.shape[:2]) * GOLDEN
    for j in range(rows):
        out = mixed(out ^ cutup[:, :, j])
    return out


def sketch(docs: DataFrame, words: int, places: int, rows: int) -> DataFrame:
    """doc_id, the digest of its set of shingles (null: no word), its size, band keys, signature (a byte a place) and the packed text; `number` too, if docs has it."""
    numbered = "number" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, pack = Hasher(), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                b = batch.slice(start, 500)
                texts = [spaced(t or "") for t in b.column("text").to_pylist()]
                sets = [np.unique(hasher.shingles(t, words)) for t in texts]
                sizes = np.array([len(x) for x in sets])
                sig = signatures(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), np.ones(sizes.sum()), len(sets), places)
                bands = band_keys(sig, rows).view("i8")
                digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *([b.column("number")] if numbered else []), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(list(bands), pa.list_(pa.int64())), pa.array([(x & np.uint64(0xFF)).astype("u1").tobytes() for x in sig], pa.binary()), pa.array([pack(" ".join(t.split()).encode()) for t in texts], pa.binary())],
                    ["doc_id", *(["number"] if numbered else []), "digest", "size", "bands", "sig", "packed"],
                )

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["number"] if numbered else []))
    return rows_.mapInArrow(run, f"doc_id long, {'number long, ' * numbered}digest binary, size long, bands array<long>, sig binary, packed binary")


def agreements(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places each signature of x agrees with each of y."""
    if len(x) * len(y) < 4096:
        return (x[:, None] == y[None, :]).sum(2)
    out = np.zeros((len(x), len(y)), "u1" if x.shape[1] < 256 else "u4")
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        out += p[:, None] == q[None, :]
    return out


def allowed(size: np.ndarray, sig: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, screen: bool = True) -> np.ndarray:
    """Whether sizes and agreement allow the least similarity of rows x with rows y. With `screen`, agreement over 5.5 standard deviations under it rules a pair out."""
    one, other = size[x].astype("f8")[:, None], size[y].astype("f8")[None, :]
    open_ = (least * one <= other + 1e-6) & (least * other <= one + 1e-6)
    if screen:
        places = sig.shape[1]
        open_ &= agreements(sig[x], sig[y]) >= (least - 5.5 * (least * (1 - least) / places) ** 0.5) * places
    return open_


def roots(rep: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row the least row of its label; rows come by rep."""
    _, first, of = np.unique(label, return_index=True, return_inverse=True)
    return rep[first[of]]


def joined(open_: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, same: bool) -> np.ndarray:
    """A label for each of n rows, equal for those that allowed pairs of rows x and y join."""
    label, seen_x, seen_y = np.arange(n), np.zeros(len(x), bool), np.zeros(len(y), bool)
    across = np.ascontiguousarray(open_.T)
    for start in np.flatnonzero(open_.sum(1) > same):  # with itself a row is always allowed
        if seen_x[start]:
            continue
        seen_x[start], front = True, np.array([start])
        while len(front):
            label[x[front]] = x[start]
            heard = open_[front].any(0) & ~seen_y
            seen_y |= heard
            label[y[heard]] = x[start]
            heard = across[heard].any(0) & ~seen_x
            seen_x |= heard
            front = np.flatnonzero(heard)
    return label


def alike(size: np.ndarray, sig: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool, least: float, screen: bool = True) -> np.ndarray:
    """A label for each row, equal for those that allowed pairs of rows x and y join."""
    return joined(allowed(size, sig, x, y, least, screen), x, y, len(size), same)


def proven(size: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, same: bool, least: float, screen: bool = True) -> np.ndarray:
    """A label for each row, equal for those that pairs of exact similarity `least` or more of rows x and y join; rows that such pairs already join aren't compared again."""
    open_ = allowed(size, sig, x, y, least, screen)
    vocabulary, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(z) for z in sets])
    ids = np.split(inverse, ends[:-1])
    group, marked = np.arange(len(size)), np.zeros(len(vocabulary), bool)
    for k, i in enumerate(x):
        js = y[open_[k]]
        js = js[(group[js] != group[i]) & ((js > i) | (not same))]
        if not len(js):
            continue
        marked[ids[i]] = True
        both = np.add.reduceat(marked[np.concatenate([ids[j] for j in js])], np.r_[0, np.cumsum(size[js])[:-1]], dtype="i8")
        marked[ids[i]] = False
        for j in js[both >= least * (size[i] + size[js] - both) - 1e-9]:
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
    return group


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], numbers: tuple[str, ...], binaries: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each key, from sorted batches; holds one key's rows and a batch."""
    carry: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in (*keys, *numbers)}
        for c in binaries:
            now[c] = np.empty(batch.num_rows, object)
            now[c][:] = batch.column(c).to_pylist()
        carry = now if carry is None else {c: np.concatenate([carry[c], now[c]]) for c in now}
        ends = 1 + np.flatnonzero(np.logical_or.reduce([carry[c][1:] != carry[c][:-1] for c in keys]))
        for start, end in zip(np.r_[0, ends[:-1]], ends, strict=False):
            yield {c: v[start:end] for c, v in carry.items()}
        if len(ends):
            carry = {c: v[ends[-1] :] for c, v in carry.items()}
    if carry is not None:
        yield carry


def signed(run: dict[str, np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(run["sig"]), "u1").reshape(len(run["sig"]), -1)


def roots_frame(key: str, out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z), pa.int64()) for z in zip(*out, strict=True)], [key, "rep", "root"])


def within_blocks(rows: DataFrame, key: str, columns: list[str], label) -> DataFrame:
    """(key, rep, root): each row and the least row that it is joined to among its block and its key's head. The rows have `blocks` and `head`
    (the number of blocks and the least rep of their key); `label(run, x, y, same)` labels rows that pairs of rows x and y join."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    where = F.when(F.col("rep") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    placed = rows.withColumn("i", F.explode(where)).select(key, "i", "rep", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        for r in runs(batches, (key, "i"), ("rep", "size"), tuple(c for c in columns if c != "size")):
            every = np.arange(len(r["rep"]))
            out.append((r[key], r["rep"], roots(r["rep"], label(r, every, every, True))))
            if len(out) >= 1000:
                yield roots_frame(key, out)
                out = []
        if out:
            yield roots_frame(key, out)

    return placed.repartition(key, "i").sortWithinPartitions(key, "i", "rep").mapInArrow(run, f"{key} long, rep long, root long")


def across_blocks(rows: DataFrame, key: str, columns: list[str], label) -> DataFrame:
    """(key, rep, root): as within_blocks, by pairs of the rows that are `far` with all rows of their key. Far rows lie in `far_blocks` blocks i, all rows in
    `blocks` blocks j; a block pair holds the far rows of i and all rows of j."""
    i = F.pmod(F.xxhash64("rep"), F.col("far_blocks")).cast("int")
    j = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    left = rows.filter("far").withColumn("i", i).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    right = rows.withColumn("j", j).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("far_blocks") - 1))).withColumn("side", F.lit(1))
    placed = left.unionByName(right).select(key, "i", "j", "side", "rep", *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in runs(batches, (key, "i", "j"), ("side", "rep", "size"), tuple(c for c in columns if c != "size")):
            got = label(r, np.flatnonzero(r["side"] == 0), np.flatnonzero(r["side"] == 1), False)
            yield roots_frame(key, [(r[key], r["rep"], roots(r["rep"], got))])

    return placed.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "rep").mapInArrow(run, f"{key} long, rep long, root long")


def group_links(rows: DataFrame, counts: DataFrame, key: str, columns: list[str], label, block: int) -> DataFrame:
    """Links (a, b) that join what pairs within keys join, from rows (key, rep, size, ...) and counts (key, n, head, blocks)."""
    counts = counts.filter("n > 1").select(key, "head", F.col("blocks").cast("int").alias("blocks"))
    near = cut(within_blocks(rows.join(counts, key), key, columns, label))
    links = near.filter("root <> rep").select(F.col("root").alias("a"), F.col("rep").alias("b"))
    large = cut(counts.filter("blocks > 1"))
    far = cut(near.join(large, key).filter("root <> head").select(key, "rep").distinct())
    if far.isEmpty():
        return links
    sizes = far.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("far_blocks"))
    marked = rows.join(large.join(sizes, key), key).join(far.withColumn("far", F.lit(True)), [key, "rep"], "left").withColumn("far", F.coalesce("far", F.lit(False)))
    more = across_blocks(marked, key, columns, label).filter("root <> rep")
    return links.union(more.select(F.col("root").alias("a"), F.col("rep").alias("b")))


def bucket_links(members: DataFrame, reps: DataFrame, least: float, block: int = BLOCK, screen: bool = True) -> DataFrame:
    """Links (a, b) that join what allowed pairs within buckets (band, rep) join."""

    def label(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
        return alike(r["size"], signed(r), x, y, same, least, screen)

    counts = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).withColumn("blocks", F.ceil(F.col("n") / block))
    return group_links(members.join(reps.select("rep", "size", "sig"), "rep"), counts, "band", ["size", "sig"], label, block).distinct()


def family_links(family: DataFrame, reps: DataFrame, words: int, least: float, block: int = BLOCK, shingles: int = SHINGLES, screen: bool = True) -> DataFrame:
    """Links (a, b) that join what links within families (rep, family) join. A block has about `block` members or `shingles` shingles at most."""
    worker: dict = {}

    def label(r: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, same: bool) -> np.ndarray:
        if not worker:
            worker["hasher"], worker["unpack"] = Hasher(), zstandard.ZstdDecompressor().decompress
        sets = [np.unique(worker["hasher"].shingles(worker["unpack"](p).decode(), words)) for p in r["packed"]]
        return proven(r["size"], signed(r), sets, x, y, same, least, screen)

    rows = family.join(reps, "rep")
    counts = family.join(reps.select("rep", "size"), "rep").groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head"), F.sum("size").alias("all"))
    counts = counts.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, F.col("all") / shingles)))
    return group_links(rows, counts, "family", ["size", "sig", "packed"], label, block)


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, component) for all nodes: the least rep that links lead to. In each round a node takes the name of the least lesser
    neighbour, or that one's; links then go between names, and those within a name go."""
    edges = cut(links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a <> b").distinct())
    labels = nodes.select("rep", F.col("rep").alias("component"))
    while not edges.isEmpty():
        up = cut(edges.groupBy("b").agg(F.min("a").alias("a")))
        named = up.select(F.col("b").alias("a"), F.col("a").alias("further"))
        names = cut(up.join(named, "a", "left").select(F.col("b").alias("node"), F.coalesce("further", "a").alias("name")), up)
        labels = cut(labels.join(names, F.col("component") == F.col("node"), "left").select("rep", F.coalesce("name", "component").alias("component")), labels)
        upper = edges.join(names.select(F.col("node").alias("b"), F.col("name").alias("p")), "b")
        both = upper.join(names.select(F.col("node").alias("a"), F.col("name").alias("q")), "a", "left").withColumn("q", F.coalesce("q", "a"))
        edges = cut(both.select(F.greatest("p", "q").alias("b"), F.least("p", "q").alias("a")).filter("a <> b").distinct(), edges, names)
    release(edges)
    return labels


def classes(docs: DataFrame, words: int = WORDS, least: float = LEAST, places: int = PLACES, rows: int = ROWS, screen: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, kept (whether it is the row of its class
    that stays)."""
    sketched = cut(sketch(docs.select("doc_id", "text"), words, places, rows).withColumn("number", F.monotonically_increasing_id()))
    return of_sketches(sketched, words, least, screen, block).drop("number")


def survivors(docs: DataFrame, words: int = WORDS, least: float = LEAST, places: int = PLACES, rows: int = ROWS) -> DataFrame:
    """The rows that stay, with their columns."""
    numbered = cut(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*docs.columns).alias("row")))
    texts = numbered.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "number")
    sketched = cut(sketch(texts, words, places, rows))
    kept = of_sketches(sketched, words, least).filter("kept").select("number")
    return numbered.join(kept, "number", "left_semi").select("row.*")


def of_sketches(sketched: DataFrame, words: int, least: float, screen: bool = True, block: int = BLOCK) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")
    named = sketched.filter("digest is not null")
    firsts = named.groupBy("digest").agg(F.min(order).alias("first")).select("digest", F.col("first.number").alias("rep"))
    heads = firsts.select(F.col("rep").alias("number"))
    reps = named.join(heads, "number", "left_semi").select(F.col("number").alias("rep"), "bands", "size", "sig", "packed")
    banded = reps.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").count().filter("count > 1").select("band")
    members = cut(banded.join(shared, "band"))  # buckets of two or more
    met = cut(members.select("rep").distinct())
    reps = cut(reps.select("rep", "size", "sig", "packed").join(met, "rep", "left_semi"))
    families = components(met, bucket_links(members, reps, least, block, screen))
    component = components(met, family_links(families.withColumnRenamed("component", "family"), reps, words, least, block, screen=screen))
    release(members, reps, families)
    return finished(sketched, firsts, component)


def finished(sketched: DataFrame, firsts: DataFrame, component: DataFrame) -> DataFrame:
    of_rep = firsts.join(component, "rep", "left").select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    rows = sketched.select("doc_id", "digest", "number").join(of_rep, "digest", "left").withColumn("component", F.coalesce("component", "number")).withColumn("rep", F.coalesce("rep", "number"))
    rows = cut(rows.select("doc_id", "number", "rep", "component"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")
    heads = rows.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(heads, "component").select("number", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("number") == F.col("first.number")).alias("kept"))
