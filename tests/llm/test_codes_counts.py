"""Vector codes, token counts and the divergence audit against plain loops and the library, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracelake.llm import divergence, token_counts, vector_codes

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """rows: (vec_id, vector, label), already without bad vectors."""
    v = {k: [int(np.floor(scale * float(x))) for x in vec] for k, (_, vec, _) in enumerate(rows)}
    width = len(v[0]) // parts
    part = lambda k, p: v[k][p * width : (p + 1) * width]
    first = sorted(v, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, v[k]))[:entries]
    books = [[part(k, p) for k in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: {(k, p): min((far(part(k, p), e), i) for i, e in enumerate(books[p])) for k in v for p in range(parts)}
    for _ in range(rounds):
        members = defaultdict(list)
        for (k, p), (_, i) in assign().items():
            members[p, i].append(part(k, p))
        for (p, i), m in members.items():
            books[p][i] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    last = assign()
    error = {k: sum(last[k, p][0] for p in range(parts)) for k in v}
    by_label = Counter()
    for k in v:
        by_label[rows[k][2]] += error[k]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((rows[k][0], "".join(f"{last[k, p][1]:02x}" for p in range(parts)), error[k], by_label[rows[k][2]], digest) for k in v)


def test_vector_codes(spark):
    """Coarse values, so that entries and distances tie often; repeated rows, a null id, null labels."""
    r = random.Random(2)
    good = [(i, [r.randrange(-3, 3) / 2 for _ in range(16)], r.choice((1, 2, None))) for i in range(120)]
    good += [(5, good[5][1], 1), (3, good[9][1], 2), (None, good[0][1], None), (200, [-8000.0] * 16, 7), (201, [1e-5] * 16, 7)]
    bad = [(1, None, 1), (2, [None] * 16, 1), (3, [float("nan")] * 16, 1), (4, [1.0] * 15 + [float("-inf")], None), (6, [], 2), (7, [1.0] * 8, 2)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("code", "error", "v", "entry")}).repartition(3)
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_codes(good)
    few = [(i, x, lab) for i, x, lab in good[:5]]
    assert Counter(map(tuple, vector_codes.compress(spark.createDataFrame(few, "vec_id long, embedding array<float>, label int")).collect())) == plain_codes(few)
    assert vector_codes.compress(df.limit(0)).collect() == []
    assert vector_codes.compress(df.filter("embedding is null")).collect() == []


def test_vector_codes_of_huge_components(spark):
    df = spark.createDataFrame([(i, [3e38 * (-1) ** i] * 64, None) for i in range(40)], "vec_id long, embedding array<float>, label string")
    assert vector_codes.compress(df).count() == 40


def test_labels_beyond_the_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7)] * 8, str(i % 3) if i % 5 else None) for i in range(50)], "vec_id long, embedding array<double>, label string")
    want = sorted(map(tuple, vector_codes.compress(df).collect()))
    monkeypatch.setattr(vector_codes, "FEW", 0)
    assert sorted(map(tuple, vector_codes.compress(df).collect())) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=40), st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=30))
def test_tree_finds_the_lowest_of_equally_near_entries(points, queries):
    p, q = np.array(points, "i8"), np.array(queries, "i8")
    at, far = vector_codes.Tree.build(p).nearest(q)
    d = ((q[:, None] - p[None]) ** 2).sum(2)
    assert far.tolist() == d.min(1).tolist() and at.tolist() == d.argmin(1).tolist()


def test_tree_leaves_far_nodes_out():
    """Clustered entries: fewer distances than all are computed."""
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(0, 10, (16, 4)) + 10_000 * k for k in range(16)])
    tree, seen = vector_codes.Tree.build(points), []
    points_of = vector_codes.np.einsum
    try:
        vector_codes.np.einsum = lambda *a: (seen.append(len(a[1])), points_of(*a))[1]
        tree.nearest(points + 1)
    finally:
        vector_codes.np.einsum = points_of
    assert sum(seen) < len(points) ** 2 / 4


SPECIAL = "<|startoftext|>a<|endoftext|> <|ENDOFTEXT|> x<|endoftext|><|endoftext|>"
MIXED = "Don't  WE'LL it's 12 345 éé İstanbul ΣΟΣ straße 日本語 \U0001f600‍\U0001f600 a b c\x1cd\x85e ́x ... ?!\n\tq"
WORDS = [None, "", "   \n", SPECIAL, MIXED, "a" * 5000, "ab " * 900_000, "The the THE", "x" * 300 + " " * 20]


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_token_counts(spark, path):
    r = random.Random(9)
    alphabet = "aAbB'stT 12.,<|>\n\t ́éİ日\U0001f600\x1c\x85​" + "etaoin shrdlu" * 3
    texts = WORDS + ["".join(r.choice(alphabet) for _ in range(r.randrange(200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, MIXED), (4, MIXED)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "words", "pieces", "n_tokens", "special")}).repartition(3)
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    got = token_counts.counts(df, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, got.collect())) == want


def test_token_counts_in_small_blocks(spark, monkeypatch):
    """Blocks of a few documents give the same counts; a chunk is split as it is within its text."""
    texts = [f"the {i % 7} cats{i % 3} and <|endoftext|> dogs" for i in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, token_counts.counts(df, WORD_BPE).collect()))
    monkeypatch.setattr(token_counts, "BLOCK_ROWS", 3)
    assert sorted(map(tuple, token_counts.counts(df, WORD_BPE).collect())) == want
    assert token_counts.counts(df.limit(0), WORD_BPE).collect() == []
    assert token_counts.counts(df.filter("text is null"), WORD_BPE).collect()[0].n_tokens == 0


def test_frequencies_of_chunks_are_those_of_texts():
    splitter, r = token_counts.Splitter(WORD_BPE), random.Random(3)
    texts = ["".join(r.choice("aAb'st2. ,<|>\n\t\x0b\x0c\r\x1c\x85 \u0301é\u2028İ日") for _ in range(r.randrange(60))) for _ in range(400)] + [SPECIAL, MIXED, ""]
    words, row, place, times, special = splitter.frequencies(texts)
    got = [(Counter(), int(n)) for n in special]
    for i, w, n in zip(row, place, times, strict=True):
        got[i][0][words[w]] += int(n)
    assert got == [(Counter(w), n) for t in texts for w, n in [splitter.split(t)]]
    assert list(zip(row, place)) == sorted(set(zip(row, place)))
    values = np.array([0, 1, 70_000, 2**32 - 1])
    assert token_counts.unpacked(token_counts.packed(values), 4).tolist() == values.tolist()


def plain_audit(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))) for t, lang, source in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w in df if df[w] >= least)
        sources = sorted({s for _, s, _ in own})
        n = {s: Counter(w for _, x, ws in own if x == s for w in ws if df[w] >= least) for s in sources}
        every = sum(n.values(), Counter())
        share = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: share(n[s]) for s in sources}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if n[s][w] and p[s][w] > q[w])[:top]
            out.update((lang, s, part, item, -value, k) for part, of in (("pair", pairs), ("term", terms)) for k, (value, _, item) in enumerate(of, 1))
    return out


def test_divergence(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = ["the", "The", "café", "CAFÉ", "日本", "\U0001f600x", "it", "s", "a1b", "o'clock", "zz", "Ä", "x" * 50]
    rows = [(" ".join(r.choices(vocabulary, k=r.randrange(30))), r.choice(["en", "de", None]), r.choice(["hot", "hot", "b", "", None, "c"])) for _ in range(300)]
    rows += [(None, "en", "only nulls"), ("", "empty", "a"), ("12 34", "empty", "b"), ("the " * 5000, "en", "long"), ("once", "fr", "alone"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("doc_id", "term", "n", "by", "rank", "item", "value", "salt")}).repartition(4)
    got = divergence.audit(df, 10, 4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = plain_audit(rows, 10, 4)
    assert Counter(map(tuple, got.collect())) == want
    assert any(k[0] == "empty" and k[2] == "pair" and k[4] == 0 for k in want)
    monkeypatch.setattr(divergence, "SLICE", 64)  # texts in parts, in the local process
    batch = df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source"))).toArrow().combine_chunks().to_batches()
    totals = Counter()
    for b in divergence.counted(iter(batch)):
        for x in b.to_pylist():
            totals[x["lang"], x["source"], x["term"]] += x["n"]
    assert totals["en", "long", "the"] == 5000 and len(set(k[2] for k in totals)) == len({w for _, _, w in totals})
    assert divergence.audit(df.limit(0)).collect() == []


def test_shares_are_exact_beyond_a_long(spark):
    rows = [(3, 10, 4), (10**13, 10**15 + 7, 10**6), (0, 0, 1), (2 * 10**9, 2 * 10**9, 1)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").select(divergence.share(F.col("n"), F.col("total"), F.col("terms")))
    assert [x[0] for x in df.collect()] == [1 + 10**9 * (n + 2) // (total + 2 * v) for n, total, v in rows]
