"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Texts are equal when identical after deleting ASCII white space. A normalised text is cut where its
content says so: after a least length, at the next of certain character pairs, or at a greatest
length. So equal passages give equal chunks wherever they stand. Chunks are deduplicated with their
contents compared: a chunk's identifier is a 128-bit hash of it, and contents that share one (none is
expected to) are told apart by a number that is added to it. So identifiers are verified: equal ones mean
equal contents. From then on a document is its recipe, the ordered list of identifiers (16 bytes for some
270 characters), and only recipes are grouped; a chunk's content moves once, at most once for each task
that holds it.

The rows that stay and the sizes come from a grouping by recipe with map-side combine; rows find
their group by an equi-join whose large partitions Spark splits, so a group may hold a third of all
rows.

- Nulls: null text counts as empty. A null doc_id loses against any other.
- Empty texts have the empty recipe and are one group. Empty tables give no row.
- Very long texts have long recipes, and never move as a whole where they are marked.
- Ties: of rows of equal length and doc_id the one first in the input stays. Repeated rows (equal doc_id
  and text) form a group like any other.
- Columns: `mark` reads doc_id and text only; `survivors` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut

#: Least and greatest chunk length, in characters, and the pairs that end a chunk.
LEAST, MOST, ENDS = 256, 4096, r"[adgjmpsvyéó147.][behknqtwzßñ258]"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE + "+", "")


def chunks(norm: str) -> Column:
    return F.regexp_extract_all(F.col(norm), F.lit(rf"(?s).{{{LEAST},{MOST - 2}}}?{ENDS}|.{{1,{MOST}}}"), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def clashes(texts: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """(id, chunk, more): all contents of identifiers that more than one content has, and the number that tells a content apart."""
    contents = texts.select(F.explode(chunks("norm")).alias("chunk")).distinct().withColumn("id", of(F.col("chunk")))
    ids = cut(contents.groupBy("id").count().filter("count > 1").select("id"))
    if ids.isEmpty():
        return ids.withColumn("chunk", F.lit("")).withColumn("more", F.lit(0))
    shared = contents.join(ids, "id")
    return cut(shared.withColumn("more", F.row_number().over(Window.partitionBy("id").orderBy("chunk"))))


def repaired(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """Rows (number, norm, recipe) with the numbers of shared identifiers added; only rows that hold one are taken apart."""
    parts = rows.select("number", F.posexplode(F.arrays_zip(chunks("norm").alias("chunk"), F.col("recipe").alias("id"))).alias("at", "x")).select("number", "at", "x.chunk", "x.id")
    found = parts.join(shared, ["id", "chunk"]).select("number", F.struct("at", "more").alias("mark"))
    marks = found.groupBy("number").agg(F.map_from_entries(F.collect_list("mark")).alias("marks"))  # of one row each
    added = F.transform("recipe", lambda x, i: F.when(F.element_at("marks", i).isNull(), x).otherwise(F.concat(x, F.encode(F.element_at("marks", i).cast("string"), "UTF-8"))))
    return rows.join(marks, "number", "left").withColumn("recipe", F.when(F.col("marks").isNull(), F.col("recipe")).otherwise(added)).drop("marks")


def recipes(docs: DataFrame, carry: list[str], of: Callable[[Column], Column] = identifier) -> DataFrame:
    """A written table of doc_id, points, text_sha256, recipe and a number for each row, with the columns to carry in a struct."""
    shared = clashes(docs.select(normalised().alias("norm")), of)
    row = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("points"), F.monotonically_increasing_id().alias("number"), row.alias("row"))
    rows = rows.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("recipe", F.transform(chunks("norm"), of))
    if not shared.isEmpty():
        rows = repaired(cut(rows), shared)
    return cut(rows.drop("norm"), shared)


def groups(rows: DataFrame) -> DataFrame:
    """One row per recipe: its size and the row that stays."""
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "number")).alias("best")
    return rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best).select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.number").alias("keep_number"))


def mark(docs: DataFrame, of: Callable[[Column], Column] = identifier) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. `of` makes identifiers of chunks; even a weak one gives the same rows."""
    rows = recipes(docs, [], of).drop("row")
    return rows.join(groups(rows), "recipe").select("doc_id", "keep_id", "group_size", (F.col("number") == F.col("keep_number")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns."""
    rows = recipes(docs, docs.columns)
    kept = groups(rows.select("recipe", "points", "doc_id", "number")).select(F.col("keep_number").alias("number"))
    return rows.select("number", "row").join(kept, "number", "left_semi").select("row.*")
