"""Keyed merge of records that come in any order and in parts: what a part leaves can be folded again with what other parts leave.

A rule per column says how records of one key go together:

====== ==========================================================
last   the value of the record with the greatest `seq`
first  the value of the record with the least `seq`
max    the greatest value
min    the least value
all    true only if no record says false
sum    the sum; a record must be folded once only
union  an array: its different items, in order of their first `seq`
====== ==========================================================

Nulls say nothing, also within arrays; rows without a key or seq are left out, a key whose records say nothing of a column has null there.
Of two values with one seq the greater is the last and the less is the first. Items stay rows, so a key may have any number of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = {"last": F.max, "first": F.min, "max": F.max, "min": F.min, "all": F.min, "sum": F.sum}


def begin(records: DataFrame, keys: list[str], seq: str, rules: dict[str, str]) -> DataFrame:
    """Each record in the shape that `fold` takes and gives: values with their seq where the order counts."""

    def shaped(name: str, rule: str) -> Column:
        col = F.col(name)
        return F.when(col.isNotNull(), F.struct(F.col(seq).alias("seq"), col.alias("value"))) if rule in ("last", "first") else col.cast("boolean") if rule == "all" else col

    kept = records.dropna(subset=[*keys, seq])
    return kept.select(*keys, *(shaped(n, r).alias(n) for n, r in rules.items() if r != "union"))


def fold(parts: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """One row per key; folding again changes nothing but sums over parts. Combined before the shuffle, so a hot key costs a row per task."""
    return parts.groupBy(*keys).agg(*(FOLDS[r](n).alias(n) for n, r in rules.items() if r != "union"))


def finish(folded: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """The values alone."""
    return folded.select(*keys, *((F.col(n)["value"] if r in ("last", "first") else F.col(n)).alias(n) for n, r in rules.items() if r != "union"))


def begin_items(records: DataFrame, keys: list[str], seq: str, rules: dict[str, str]) -> DataFrame:
    """The items of all arrays as rows (keys, field, item, seq)."""
    names = [n for n, r in rules.items() if r == "union"]
    kept = records.dropna(subset=[*keys, seq])
    none = F.array().cast("array<string>")

    def named(n: str) -> Column:
        return F.transform(F.coalesce(F.col(n).cast("array<string>"), none), lambda x: F.struct(F.lit(n).alias("field"), x.alias("item")))

    pairs = F.flatten(F.array(*map(named, names)))
    return kept.select(*keys, F.col(seq).alias("seq"), F.explode(pairs).alias("p")).select(*keys, "p.field", "p.item", "seq").dropna(subset=["item"])


def fold_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """Each item once with its first seq; folding again changes nothing."""
    return items.groupBy(*keys, "field", "item").agg(F.min("seq").alias("seq"))


def item_summary(items: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Per key the number of a field's items (`field`), the first and the last one; equal seqs go by item."""
    at = F.struct("seq", "item")
    return items.filter(F.col("field") == field).groupBy(*keys).agg(F.count(F.lit(1)).alias(field), F.min(at)["item"].alias(f"first_{field}"), F.max(at)["item"].alias(f"last_{field}"))


def merged(records: DataFrame, keys: list[str], seq: str, rules: dict[str, str]) -> DataFrame:
    """All records at once: values per key, and of each array what `item_summary` gives (no item: 0)."""
    out = finish(fold(begin(records, keys, seq, rules), keys, rules), keys, rules)
    names = [n for n, r in rules.items() if r == "union"]
    if names:
        items = fold_items(begin_items(records, keys, seq, rules), keys)
        out = reduce(lambda df, n: df.join(item_summary(items, keys, n), keys, "left").fillna(0, [n]), names, out)
    return out


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The edges (src, dst) whose two ends are among the nodes' keys."""
    known = nodes.select(F.col(key).alias("end")).distinct()
    return edges.join(known.withColumnRenamed("end", "src"), "src", "left_semi").join(known.withColumnRenamed("end", "dst"), "dst", "left_semi").select(edges.columns)
