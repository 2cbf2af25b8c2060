"""Whole operators and the pipeline against plain versions of what they have to find."""

import hashlib
import math
import random
import zlib
import re

import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import bpe, ctw_score, exact_dedup, kd_topk, language_id, packing, pii, prob_minhash, secret_scan, sharding
from tracelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_pii(text):
    """The contract's four patterns as they stand."""
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        return kind == "email" or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15

    return [(m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if good(KINDS[k], m.group())]


def test_pii_base(spark):
    r = random.Random(3)
    parts = ["bob", "x.y", "@", ".", "-", " ", "+", "1", "255", "192.168.0.1", "4539578763621486", "+49 171 5550123", "(017)", "a@b.co", "é", "🎉", "\n", "at", "dot"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(1500)]
    rows += [(2000, None), (2001, "x " * 50_000 + "a@b.co")]
    got = {x.doc_id: x for x in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        want = sorted(base_pii(text or ""))
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert [got[i][f"n_{k}"] for k in KINDS] == [sum(x[1] == j for x in want) for j in range(4)], text
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert set(joined.split(",")) - {""} <= set(got[i].spans.split(",")), text


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_classes(rows):
    """doc_id to the least doc_id of its class, by all pairs."""
    sets, label = {i: shingles(t or "") for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


@pytest.mark.parametrize("screen", [True, False])
def test_near_classes_in_blocks(spark, screen):
    """Families with parts replaced, copies, a much repeated line and empty texts, in blocks so small that families lie in many."""
    r = random.Random(6)
    bases = [[f"w{r.randrange(10**6)}" for _ in range(150)] for _ in range(3)]
    rows = [(0, None), (1, ""), (2, "a b")]
    for i in range(3, 90):
        words = list(bases[i % 3])
        for at in r.sample(range(150), r.choice((0, 1, 2, 3, 4, 5, 6))):
            words[at] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(words + ["again and again and again"] * (i % 4) * 8)))
    got = prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), screen=screen, block=8)
    assert {x.doc_id: x.class_id for x in got.collect()} == near_classes(rows)


def test_exact_dedup_with_clashing_identifiers(spark):
    """An identifier of four values only: contents that share one are still told apart."""
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abdegh") for _ in range(700 + i % 3)), i % 5) for i in range(40)]
    rows += [(100 + i, " " + t, n) for i, t, n in rows[:10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    weak = exact_dedup.mark(docs, lambda c: F.unhex(F.substring(F.md5(c), 1, 2)))
    key = lambda x: x.doc_id
    assert sorted(weak.collect(), key=key) == sorted(exact_dedup.mark(docs).collect(), key=key)
    assert weak.filter("kept").count() == 40


def test_slot_map_is_stored_and_edited(spark, tmp_path):
    """A second run keeps the stored map; one with more shards moves rows to the new shard only."""
    folder = str(tmp_path / "map")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 101).cast("int") + F.col("id").cast("int") % 7).alias("text"), F.lit(1).alias("slot"))

    def shards(n):
        return {x.doc_id: x.shard for x in sharding.shard(docs.withColumn("text", F.concat("text", F.col("doc_id"))), n, folder).collect()}

    first, again = shards(8), shards(8)
    assert first == again and sharding.last_version(spark, folder).version == 1
    more = shards(9)
    assert sharding.last_version(spark, folder).version == 2
    assert all(more[i] in (first[i], 8) for i in first) and 8 in more.values()


def test_hot_groups_keep_to_the_map(spark, tmp_path):
    """A text of an eighth of the bytes that must be spread when a shard is added: rows move to the new shard only. Then sizes drift, and shards go."""
    folder = str(tmp_path / "map")
    docs = spark.range(4000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.when(F.col("id") % 25 < 3, F.lit("hot" * 33)).otherwise(F.concat(F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 190).cast("int")))).alias("text"))

    def run(rows, n):
        got = sharding.shard(rows, n, folder).collect()
        loads, places = [0] * n, {}
        for x in got:
            loads[x.shard] += x["size"]
            places.setdefault(x.shard, []).append(x.slot)
        assert max(loads) <= 1.03 * sum(loads) / n and all(sorted(p) == list(range(len(p))) for p in places.values())
        return {x.doc_id: x.shard for x in got if x.doc_id is not None}

    first, again = run(docs, 8), run(docs, 8)
    assert first == again
    more = run(docs, 9)
    assert all(more[i] in (first[i], 8) for i in first) and 8 in more.values()
    most = run(docs, 12)
    assert all(most[i] == more[i] or most[i] > 8 for i in first)
    spread = sharding.last_version(spark, folder).spread
    assert spread == [hashlib.md5(("hot" * 33).encode()).hexdigest()]
    drifted = docs.union(spark.range(5000, 6500).select("id", F.lit("drift" * 20)))
    run(drifted, 12)
    assert sharding.last_version(spark, folder).spread[0] == spread[0]
    kept = sharding.last_version(spark, folder).shards
    less = run(drifted, 10)
    assert set(less.values()) == set(range(10))
    now = sharding.last_version(spark, folder).shards
    assert sum(a == b for a, b in zip(kept, now)) > 0.7 * len(kept)


OPERATORS = {
    "secrets": secret_scan.digests, "redact": secret_scan.redact, "ctw": ctw_score.scores, "language": language_id.identify, "keep": language_id.keep_identified,
    "pii": pii.digests, "shard": sharding.shard, "bpe": lambda d: bpe.digests(d, tokenizer_path()), "exact": exact_dedup.mark, "exact kept": exact_dedup.survivors,
    "pack": lambda d: packing.pack(d, tokenizer_path(), 2048, 0), "near": prob_minhash.classes, "near kept": prob_minhash.survivors,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_empty_vectors(spark):
    assert kd_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_pipeline(spark, tmp_path):
    """The stages' decisions against plain rules: no letters go, equal texts and near copies leave one row, no secret is left, all tokens are packed."""
    r = random.Random(4)
    words = {"en": "the house and garden with this river window under morning paper".split(), "de": "das haus und der garten mit dieser fluss fenster unter morgen".split()}
    rows = []
    for i in range(40):
        lang = "de" if i % 2 else "en"
        rows.append([i, " ".join(r.choice(words[lang]) + r.choice(("", "", "s")) for _ in range(60)), lang, "hot", 0])
    rows[3][1] += " password = 'hunter22x'"
    rows += [[50, rows[4][1].replace(" ", "  "), "en", "hot", 0], [51, rows[6][1] + " garden", "en", "hot", 0], [52, rows[8][1], "en", "hot", 0], [53, None, "en", "s", 0], [54, "12 34", "de", "s", 0]]
    docs = spark.createDataFrame([tuple(x) for x in rows], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, "")
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in rows} - {53, 54}
    once = stages["exact_dedup"](spark, kept, "")
    assert {x.doc_id for x in once.collect()} == set(range(40)) - {4} | {50, 51}
    left = [(x[0], x[1]) for x in rows if x[0] in set(range(40)) - {4} | {50, 51}]
    single = stages["near_dedup"](spark, once, "")
    assert {x.doc_id for x in single.collect()} == set(near_classes(left).values())
    clean = stages["secret_scan"](spark, single, "")
    assert clean.columns == docs.columns and clean.count() == single.count()
    texts = {x.doc_id: x.text for x in clean.collect()}
    assert "hunter22x" not in texts[3] and all(texts[i] == t for i, t in left if i in texts and i != 3)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = {x.doc_id: x.n_tokens + 1 for x in bpe.digests(clean, tokenizer_path()).collect()}
    sums = {}
    for x in packed:
        sums[x.doc_id] = sums.get(x.doc_id, 0) + x.length
    assert sums == tokens


def plain_model(rows, longest=4):
    """Counts of words (length 0) and n-grams by language."""
    counts = {}
    for lang, text in rows:
        own = counts.setdefault(lang, [{} for _ in range(longest + 1)])
        for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
            own[0][w] = own[0].get(w, 0) + 1
            t = f"^{w}$"
            for k in range(1, longest + 1):
                for i in range(len(t) - k + 1):
                    own[k][t[i : i + k]] = own[k].get(t[i : i + k], 0) + 1
    return counts


def plain_prediction(counts, text, longest=4, sharpness=4.0):
    langs = sorted(counts)
    total = {(lang, k): sum(counts[lang][k].values()) for lang in langs for k in range(longest + 1)}
    log = lambda lang, k, unit: math.log(counts[lang][k][unit] / total[lang, k] if unit in counts[lang][k] else 0.5 / (total[lang, k] + 1))
    score, n = dict.fromkeys(langs, 0.0), 0
    known = lambda k, unit: any(unit in counts[lang][k] for lang in langs)
    for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()):
        units, i, t = [], 0, f"^{w}$"
        if known(0, w):
            units = [(0, w)]
        else:
            while i < len(t):
                k = next((k for k in range(min(longest, len(t) - i), 0, -1) if known(k, t[i : i + k])), 0)
                units += [(k, t[i : i + k])] if k else []
                i += max(k, 1)
        n += len(units)
        for lang in langs:
            score[lang] += sum(log(lang, k, u) for k, u in units)
    share = {lang: math.exp((score[lang] - max(score.values())) / max(n, 1) * sharpness) for lang in langs}
    best = max(langs, key=lambda lang: (score[lang], [-ord(c) for c in lang]))
    return best, share[best] / sum(share.values())


def test_language_scores_by_brute_force(spark):
    r = random.Random(12)
    words = {"aa": "alpha beta gamma élan delta".split(), "bb": "omega beta sigma tau rho".split(), "cc": "uno dos tres quatro élan".split()}
    rows = [(i, " ".join(r.choices(words[lang], k=12)) + ".", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100, "gamm tauq ÉLAN x9 uno", None), (101, "ß qqq", None), (102, "beta " * 3000 + "omegas", None)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    counts = plain_model([(lang, t) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1])
    for i, t, _ in rows:
        want = plain_prediction(counts, t)
        assert got[i][0] == want[0] and got[i][1] == pytest.approx(want[1])


def test_language_model_is_bounded_in_bytes(spark):
    """Long texts in many languages, each text of words of its own: the model grows with the bytes allowed, not with rows or languages."""
    rows = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 30).alias("lang"), F.expr("array_join(transform(sequence(1, 3000), x -> translate(md5(concat(id, ':', x)), '0123456789', 'ghijklmnop')), ' ')").alias("text"))
    settings = language_id.Settings(total_bytes=3 << 20)
    model = language_id.fit(rows, settings)
    assert len(model.langs) == 30 and 30 * 3000 <= len(model.words) <= (3 << 20) / 33 + 30 * 3000
    assert len(model.value) == len(model.lang) == model.start[-1] <= len(model.words) + 30 * len(model.grams)  # a word of one language has one log, not 30
    hot = rows.withColumn("lang", F.lit("l0"))
    assert len(language_id.fit(hot, settings).words) <= 2 * (3 << 20) / 33
    few = language_id.fit(rows.limit(3), language_id.Settings(sample_bytes=1000))
    assert len(few.words) == 9000  # texts over the bound: one per language
