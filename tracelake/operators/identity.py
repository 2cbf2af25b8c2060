"""Who may be the same person: proposals of aliases by likeness of names.

Names are compared by comparison key. The likeness of two keys is the greatest of: the Jaccard similarity of their trigrams, that of their keys with words in
order, 0.99 for the same words, 0.9 for words that are all in the other name, 0.9 for equal consonants. Of unequal consonants none reaches 0.85, so at that
floor each of these is a join on equality or a set-similarity join with prefixes, and no pair is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import names as S
from tracelake.scratch import cut

LEAST = 0.85


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(case_id, key, other): pairs of sets of one case whose Jaccard similarity may reach `least`. sets: case_id, key, grams.

    With its rarest elements first, a set of n shares one of its first n - ceil(least * n) + 1 with any set that is near enough, and sizes are within that share of
    each other. Trigrams of keys have 37 letters, so the table of their frequencies has 50,653 rows at most."""
    counts = sets.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    size = F.size("grams")
    each = sets.select("case_id", "key", size.alias("size"), F.explode("grams").alias("gram")).join(F.broadcast(counts), "gram")
    order = Window.partitionBy("case_id", "key").orderBy("n", "gram")
    rare = each.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * F.lit(least) - 1e-9) + 1).select("case_id", "key", "size", "gram")
    other = rare.select("case_id", "gram", F.col("key").alias("other"), F.col("size").alias("size2"))
    near = (F.col("size2") >= F.col("size") * least - 1e-9) & (F.col("size") >= F.col("size2") * least - 1e-9)
    return rare.join(other, ["case_id", "gram"]).filter((F.col("key") < F.col("other")) & near).select("case_id", "key", "other")


def contained_pairs(keys: DataFrame) -> DataFrame:
    """(case_id, key, other): pairs of which one's words are all in the other, which then has the rarest of them. keys: case_id, key, words."""
    each = keys.withColumn("words", F.array_distinct("words")).select("case_id", "key", "words", F.explode("words").alias("word"))
    counts = each.groupBy("case_id", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(counts, ["case_id", "word"]).groupBy("case_id", "key").agg(F.min(F.struct("n", "word", "words")).alias("w")).select("case_id", F.col("key").alias("other"), F.col("w.word").alias("word"), F.col("w.words").alias("all"))
    inside = (F.size("all") <= F.size("words")) & (F.size(F.array_except("all", "words")) == 0)  # before the pairs are dealt
    return each.join(rarest, ["case_id", "word"]).filter(inside & (F.col("key") != F.col("other"))).select("case_id", F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"))


def equal_pairs(keys: DataFrame, by: str) -> DataFrame:
    """(case_id, key, other): pairs of one case that are equal `by` a column that isn't empty."""
    one = keys.filter(F.col(by) != "").select("case_id", by, "key")
    return one.join(one.withColumnRenamed("key", "other"), ["case_id", by]).filter("key < other").select("case_id", "key", "other")


def likeness(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The likeness of two keys that aren't equal, to four digits, as far as it reaches 0.85."""
    inside = lambda x, y: F.size(F.array_except(x, y)) == 0
    worded = (F.size(a["words"]) > 0) & (F.size(b["words"]) > 0)
    zero = F.lit(0.0)
    same = F.when(worded & (a["ordered"] == b["ordered"]), 0.99).otherwise(F.when(worded, S.jaccard(a["ordered_grams"], b["ordered_grams"])).otherwise(zero))
    subset = F.when(worded & (inside(a["words"], b["words"]) | inside(b["words"], a["words"])), 0.9).otherwise(zero)
    bones = F.when((a["bones"] != "") & (a["bones"] == b["bones"]), 0.9).otherwise(zero)
    return F.round(F.greatest(S.jaccard(a["grams"], b["grams"]), same, subset, bones), 4)


def similar_keys(keys: DataFrame, least: float = LEAST) -> DataFrame:
    """(case_id, key, other, score), key < other: all pairs of different keys of one case with a likeness of `least`, 0.85 or more. keys: case_id, key, distinct."""
    if least < LEAST:
        raise ValueError(f"likeness is found from {LEAST} on")
    full = keys.withColumns({"words": S.tokens(F.col("key")), "ordered": S.sorted_key(F.col("key")), "bones": S.skeleton(F.col("key")), "grams": S.trigrams(F.col("key"))})
    full = cut(full.withColumn("ordered_grams", S.trigrams(F.col("ordered"))))
    grams = least - 5e-5  # what rounds to it
    pairs = prefix_pairs(full.select("case_id", "key", "grams"), grams).union(prefix_pairs(full.select("case_id", "key", F.col("ordered_grams").alias("grams")), grams))
    pairs = pairs.union(contained_pairs(full)).union(equal_pairs(full, "ordered")).union(equal_pairs(full, "bones")).distinct()
    parts = ("words", "ordered", "bones", "grams", "ordered_grams")
    left = full.select("case_id", "key", F.struct(*parts).alias("l"))
    right = full.select("case_id", F.col("key").alias("other"), F.struct(*parts).alias("r"))
    score = likeness({p: F.col(f"l.{p}") for p in parts}, {p: F.col(f"r.{p}") for p in parts})
    return pairs.join(left, ["case_id", "key"]).join(right, ["case_id", "other"]).select("case_id", "key", "other", score.alias("score")).filter(F.col("score") >= least)


def alias_candidates(new: DataFrame, existing: DataFrame, rejected: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """(person, target, score, basis): for each new person the existing one of its case whose name is most like its own, if it reaches `least`; ties to the smaller
    target, then to names over aliases. new and existing: case_id, person, name, alias (whether the name is one; two aliases aren't compared). rejected: person,
    target, pairs that are never proposed again.

    Equal keys are one class, so names that a third of all persons bear make two rows and no pairs: a class is known by its two least targets, of which one isn't
    the person itself. Only where a class holds targets that were rejected for a person is it looked through for that person. Null persons and blank or null names take no
    part; a null case is a case of its own. Repeated rows count once."""
    ready = lambda df: df.filter("person is not null and trim(name) <> ''").select(F.coalesce(F.col("case_id").cast("string"), F.lit("\0")).alias("case_id"), "person", S.fuzzy_key(F.col("name")).alias("key"), F.coalesce("alias", F.lit(False)).alias("alias")).distinct()
    same = new is existing
    new = cut(ready(new))
    existing = new if same else cut(ready(existing))
    group = ["case_id", "key", "alias"]
    mine = new.select(*group).distinct().withColumn("mine", F.lit(True))
    first = existing.groupBy(*group).agg(F.min("person").alias("first"))
    second = existing.join(first, group).filter("person > first").groupBy(*group).agg(F.min("person").alias("second"))
    classes = first.join(second, group, "left")
    keys = existing.select("case_id", "key").union(new.select("case_id", "key")).distinct()
    found = cut(similar_keys(keys, least))
    both = found.union(found.select("case_id", "other", "key", "score")).union(keys.select("case_id", "key", F.col("key").alias("other"), F.lit(1.0)))
    links = mine.join(both, ["case_id", "key"]).join(classes.select("case_id", F.col("key").alias("other"), F.col("alias").alias("other_alias"), "first", "second"), ["case_id", "other"]).filter("not (alias and other_alias)")
    offers = new.join(links, group).select("case_id", "person", "other", "other_alias", "score", (F.col("alias") | F.col("other_alias")).alias("by_alias"), F.when(F.col("first") != F.col("person"), F.col("first")).otherwise(F.col("second")).alias("target"))
    if rejected is not None:
        told = rejected.select("person", F.col("target")).distinct()
        hit = told.join(existing.select("case_id", F.col("person").alias("target"), F.col("key").alias("other"), F.col("alias").alias("other_alias")), "target").select("person", "case_id", "other", "other_alias").distinct()
        at = ["person", "case_id", "other", "other_alias"]
        again = offers.join(hit, at, "left_semi").drop("target").join(existing.select("case_id", F.col("key").alias("other"), F.col("alias").alias("other_alias"), F.col("person").alias("target")), ["case_id", "other", "other_alias"])
        again = again.join(told, ["person", "target"], "left_anti").filter("person <> target").select(*offers.columns)
        offers = offers.join(hit, at, "left_anti").unionByName(again)
    best = offers.filter("target is not null").groupBy("case_id", "person").agg(F.min(F.struct((-F.col("score")).alias("less"), "target", "by_alias")).alias("b"))
    return best.select("person", F.col("b.target").alias("target"), (-F.col("b.less")).alias("score"), F.when(F.col("b.by_alias"), "ALIAS_CO_MENTION").otherwise("NAME_FUZZY").alias("basis"))
