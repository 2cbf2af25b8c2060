"""Keyed merges against a plain loop, in one go and by a stream that is stopped, restarted and sent batches again."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import entities as E
from tracelake.streaming.store import EntityStore

RULES = {"label": "last", "seen": "first", "confidence": "max", "since": "min", "active": "all", "calls": "sum", "docs": "union", "cases": "union"}
SCHEMA = "key string, seq long, label string, seen string, confidence double, since long, active boolean, calls long, docs array<string>, cases array<string>, `batch id` string"


def records(n, seed):
    rng = random.Random(seed)
    maybe = lambda v: v if rng.random() < 0.8 else None
    pick = lambda: maybe([maybe(rng.choice("abcde")) for _ in range(rng.randrange(4))])
    return [(maybe("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}"), maybe(i), maybe(rng.choice("xyz")), maybe(f"d{rng.randrange(99)}"), maybe(rng.random()), maybe(rng.randrange(99)), maybe(rng.random() < 0.9), maybe(rng.randrange(5)), pick(), pick(), "other") for i in rng.sample(range(n), n)]


def plain(rows):
    out = {}
    for key, seq, label, seen, confidence, since, active, calls, docs, cases, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[1]):
        e = out.setdefault(key, dict.fromkeys(RULES) | {"docs": [], "cases": []})
        e["label"] = e["label"] if label is None else label
        e["seen"] = seen if e["seen"] is None else e["seen"]
        for name, value, f in (("confidence", confidence, max), ("since", since, min), ("active", active, min), ("calls", calls, lambda a, b: a + b)):
            e[name] = e[name] if value is None else value if e[name] is None else f(e[name], value)
        for name, items in (("docs", docs), ("cases", cases)):
            e[name] += [x for x in dict.fromkeys(items or ()) if x is not None and x not in e[name]]
    return out


def state(values, items):
    got = {r["key"]: {n: r[n] for n in RULES if RULES[n] != "union"} | {"docs": {}, "cases": {}} for r in values.collect()}
    for r in items.collect():
        got[r["key"]][r.field][r.item] = r.seq
    return got


def expected(rows):
    want = plain(rows)
    for key, e in want.items():
        for name, at in (("docs", 8), ("cases", 9)):
            e[name] = {x: min(r[1] for r in rows if r[0] == key and r[1] is not None and x in (r[at] or ())) for x in e[name]}
    return want


def test_merged_like_a_loop(spark):
    rows = records(400, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["key"]: r for r in E.merged(df, ["key"], "seq", RULES).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for key, e in want.items():
        assert [got[key][n] for n in RULES if RULES[n] != "union"] == [e[n] for n in RULES if RULES[n] != "union"]
        assert (got[key].docs, got[key].cases) == (len(e["docs"]), len(e["cases"]))
    assert E.merged(df.limit(0), ["key"], "seq", RULES).count() == 0


def test_folding_twice_changes_nothing(spark):
    rules = {n: r for n, r in RULES.items() if r != "sum"}
    once = E.fold(E.begin(spark.createDataFrame(records(200, 2), SCHEMA), ["key"], "seq", rules), ["key"], rules)
    again = E.fold(once.union(once), ["key"], rules)
    assert sorted(map(str, once.collect())) == sorted(map(str, again.collect()))


def test_a_stream_stopped_and_sent_again_gives_what_a_batch_gives(spark, tmp_path):
    parts = [records(150, s) for s in (3, 4, 5, 6)]
    src, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    store = lambda: EntityStore(spark, str(tmp_path / "store"), ["key"], "seq", RULES)
    assert store().values() is None and store().items() is None and store().compact() == -1
    stream = spark.readStream.schema(SCHEMA).parquet(src) if spark.createDataFrame(parts[0], SCHEMA).coalesce(1).write.parquet(src) is None else None
    store().follow(stream, checkpoint, once=True).awaitTermination()
    assert state(store().values(), store().items()) == expected(parts[0])
    for n in (1, 2):  # each run is a new query from the old checkpoint
        spark.createDataFrame(parts[n], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        store().follow(stream, checkpoint, once=True).awaitTermination()
    want = expected(parts[0] + parts[1] + parts[2])
    assert state(store().values(), store().items()) == want
    store().add(spark.createDataFrame(parts[2], SCHEMA), 2)  # the last batch comes again
    assert state(store().values(), store().items()) == want
    assert store().compact() == 2
    store().add(spark.createDataFrame(parts[1], SCHEMA), 1)  # one that the base holds comes again
    assert state(store().values(), store().items()) == want
    store().sweep()
    spark.createDataFrame(parts[3], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    store().follow(stream, checkpoint, once=True).awaitTermination()
    assert state(store().values(), store().items()) == expected(sum(parts, []))


def test_a_batch_that_failed_half_way_doesnt_count(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"), ["key"], "seq", RULES)
    store.add(spark.createDataFrame(records(50, 7), SCHEMA), 0)
    before = state(store.values(), store.items())
    broken = spark.createDataFrame(records(50, 8), SCHEMA).withColumn("since", F.when(F.col("seq") > 20, F.raise_error(F.lit("lost"))).otherwise(F.col("since")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.add(broken, 1)
    assert state(store.values(), store.items()) == before


def test_endpoints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (None, 1), (1, 1)], "src int, dst int")
    nodes = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    assert sorted(tuple(r) for r in E.with_endpoints(edges, nodes, "id").collect()) == [(1, 1), (1, 2)]
