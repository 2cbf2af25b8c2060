"""Likeness of names against a plain loop over all pairs."""

import random
import re

from pyspark.sql import functions as F

from tracelake.functions import names as S
from tracelake.operators import identity as I
from tracelake.operators import merges as M

ROMAN = {"रमेश": "ramesh", "राम": "ram", "मेहता": "mehta", "सिंह": "singh", "सुनीता": "sunita", "रमेश यादव": "ramesh yadav", "फ़िरोज़": "firoz", "फ़िरोज": "firoj", "१२": "12", "राम।श्याम": "ram shyam", "चंद": "chand", "": ""}


def test_keys_across_scripts(spark):
    names = list(ROMAN) + ["Rathore-Singh", "É. Müller", "K9  x"]
    got = {r.name: r.key for r in spark.createDataFrame([(n,) for n in names], "name string").withColumn("key", S.fuzzy_key(F.col("name"))).collect()}
    assert {n: got[n] for n in ROMAN} == ROMAN
    assert got["Rathore-Singh"] == "rathore singh" and got["É. Müller"] == "m ller" and got["K9  x"] == "k9  x"
    bones = spark.createDataFrame([("rathore",), ("",)], "key string").select(S.skeleton(F.col("key")).alias("b"), S.trigrams(F.col("key")).alias("t")).collect()
    assert bones[0].b == "rthr" and bones[1].t == ["   "] and set(bones[0].t) == {"  r", " ra", "rat", "ath", "tho", "hor", "ore", "re "}


def like(a, b):
    """The rule in plain words, for different keys."""
    grams = lambda k: {f"  {k} "[i : i + 3] for i in range(len(k) + 1)}
    jac = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    if a == b:
        return 1.0
    out, wa, wb = [jac(a, b)], a.split(), b.split()
    if wa and wb:
        out.append(0.99 if sorted(wa) == sorted(wb) else jac(" ".join(sorted(wa)), " ".join(sorted(wb))))
        out.append(0.9 if set(wa) <= set(wb) or set(wb) <= set(wa) else 0)
    bones = [re.sub(r"[aeiou\s]", "", x) for x in (a, b)]
    out.append(0.9 if bones[0] and bones[0] == bones[1] else 0)
    return round(max(out), 4)


def people(n, seed):
    rng = random.Random(seed)
    words = ["ramesh", "rameesh", "suresh", "yadav", "yadava", "kumar", "singh", "rathore", "rathod", "mehta", "a", "aaaa", "aaaaa", "venkateshwaralu", "venkateshwarulu", "!!", "io"]
    return [(rng.choice(["x", "y", None]), i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) if rng.random() < 0.7 else "hot name", rng.random() < 0.2) for i in range(n)]


def brute(rows, rejected=()):
    key = lambda n: re.sub("[^a-z0-9 ]+", " ", n.lower()).strip()
    best = {}
    for c, p, n, alias in rows:
        for d, q, m, other in rows:
            if c != d or p == q or (alias and other) or (p, q) in rejected or not (n or "").strip() or not (m or "").strip():
                continue
            if (s := like(key(n), key(m))) >= 0.85:
                best[p] = min(best.get(p, (0, 0, False)), (-s, q, alias or other))
    return {p: (q, -s, "ALIAS_CO_MENTION" if a else "NAME_FUZZY") for p, (s, q, a) in best.items()}


def test_no_pair_is_lost(spark):
    rows = people(240, 3)
    rows += [(rows[3][0], 3, "also called ramesh", True), ("x", 500, None, False), ("x", 501, "  ", False), (rows[1][0], 1, "hot name", True)]
    df = spark.createDataFrame(rows + rows[:5], "case_id string, person long, name string, alias boolean").withColumn("score", F.lit(7))
    got = {r.person: (r.target, r.score, r.basis) for r in I.alias_candidates(df, df).collect()}
    assert got == brute(rows) and len(got) > 150
    told = [(p, q) for p, (q, *_) in got.items() if p % 3 == 0]
    told += [(p, min(i for _, i, n, _ in rows if n == "hot name" and i not in (p, q))) for p, q in told]
    again = {r.person: (r.target, r.score, r.basis) for r in I.alias_candidates(df, df, spark.createDataFrame(told, "person long, target long")).collect()}
    assert again == brute(rows, set(told)) and again != got
    assert I.alias_candidates(df.limit(0), df).count() == 0 and I.alias_candidates(df, df.limit(0)).count() == 0


def test_only_contained_words_make_pairs(spark):
    """Keys that share their rarest word but aren't in each other are no pair."""
    keys = spark.createDataFrame([("x", k, k.split()) for k in ("tin ring large", "tin bolt large", "tin ring", "ring tin tin", "hot ring large tin")] + [("y", "tin", ["tin"])], "case_id string, key string, words array<string>")
    got = {tuple(r) for r in I.contained_pairs(keys).collect()}
    rows = [k.split() for k in ("tin ring large", "tin bolt large", "tin ring", "ring tin tin", "hot ring large tin")]
    assert got == {("x", " ".join(min(a, b)), " ".join(max(a, b))) for a in rows for b in rows if a != b and set(a) <= set(b)} and len(got) == 6


def test_names_on_both_sides_are_made_once(spark, monkeypatch):
    written, cut = [], I.cut
    monkeypatch.setattr(I, "cut", lambda *a: written.append(a[0].columns) or cut(*a))
    df = spark.createDataFrame(people(40, 5), "case_id string, person long, name string, alias boolean")
    got = {r.person: (r.target, r.score, r.basis) for r in I.alias_candidates(df, df).collect()}
    assert got == brute(people(40, 5)) and sum("person" in c for c in written) == 1


NODES = [(i, "PERSON", f"n{i}") for i in range(12)] + [(50, "PLACE", "n50")]
EDGES = [("CALL", 1, 2, 3), ("CALL", 3, 2, 4), ("CALL", 1, 3, 5), ("CALL", 4, 4, 1), ("OWNS", 3, 2, 1), ("CALL", 5, 6, 2), (None, 7, 8, 1)]


def state(spark, log):
    log = M.admit(spark.createDataFrame(log, "version long, action string, kept long, absorbed long"), spark.createDataFrame(NODES, "node long, label string, name string"))
    roots = M.resolve(M.parents(log))
    edges = M.rewire(spark.createDataFrame(EDGES, "rel string, src long, dst long, occurrences long"), roots)
    return sorted(map(tuple, roots.collect())), sorted((tuple(r) for r in edges.select("edge_key", "rel", "src", "dst", "occurrences").collect()), key=str)


def test_a_merge_is_undone_under_later_ones(spark):
    first, second, undo = (1, "merge", 1, 3), (2, "merge", 5, 1), (3, "unmerge", 1, 3)
    assert state(spark, [first, second, undo]) == state(spark, [second])
    assert state(spark, [first, undo]) == state(spark, [(9, "unmerge", 1, 3)]) and state(spark, [first, undo])[0] == []
    roots, edges = state(spark, [first, second])
    assert roots == [(1, 5), (3, 5)]
    assert {e[1:] for e in edges} == {("CALL", 5, 2, 7), ("CALL", 4, 4, 1), ("OWNS", 5, 2, 1), ("CALL", 5, 6, 2), (None, 7, 8, 1)}  # 1 to 3 has become a loop
    assert len({e[0] for e in edges}) == 5
    again = state(spark, [first, second, undo, (4, "merge", 1, 3)])
    assert again == (roots, edges)


def test_refused_merges_rings_and_chains(spark):
    assert state(spark, [(1, "merge", 1, 50), (2, "merge", 1, 77), (3, "merge", 4, 4), (4, "merge", None, 2)])[0] == []
    ring = [(1, "merge", 2, 1), (2, "merge", 3, 2), (3, "merge", 1, 3), (4, "merge", 3, 9)]
    assert state(spark, ring)[0] == [(1, 3), (2, 3), (9, 3)]  # the merge that closed the ring doesn't hold
    chain = [(i, "merge", i - 1, i) for i in range(1, 12)]
    assert state(spark, chain)[0] == [(i, 0) for i in range(1, 12)]
    assert state(spark, [])[0] == []


def test_folded_records(spark):
    rows = [("PERSON", "p8", False, "Amit Joshi"), ("PERSON", "~h1", True, "amit  joshi"), ("PERSON", "p9", False, "Two"), ("PERSON", "p10", False, "two"), ("PERSON", "~h2", True, "Two"), ("PLACE", "~h3", True, "Amit Joshi"),
            ("PLACE", "a", False, "a"), ("PLACE", "b", False, "b"), ("PERSON", "~h4", True, None)]
    df = spark.createDataFrame(rows, "label string, node string, derived boolean, name string")
    assert sorted(map(tuple, M.same_names(df, "PERSON").collect())) == [("p8", "~h1")]
