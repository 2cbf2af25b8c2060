"""Source divergence audit over wide term vectors.

Which sources of a language differ most in their words, and by which words? Every (lang, source) group
gives each kept term of its language a smoothed share p in parts of 10^9; two groups diverge by the sum
over terms of floor((p - q)^2 / (p + q)), all in whole numbers.

1. Terms are counted in each batch of documents before anything is shuffled: rows are (lang, source,
   term, occurrences, documents), so a hot source or term has one row per batch.
2. Counts meet by (lang, term), and each term that enough documents hold is pivoted into one array with
   a place for every source of the language: a wide vector.
3. Shares are computed within the array, and JVM higher-order functions emit one contribution for each
   pair of places. Contributions are summed before the shuffle, so that carries one row per task and
   pair of sources only.

The number of sources bounds the vectors; the result itself has a row for each ordered pair of a
language's sources, so it is what bounds the method. Wide vectors meet their language's sources by a
salted join, as a language may hold most terms.

- Nulls: a null text, lang or source is ''. Null ids don't matter, every row is a document.
- Empty tables give no row. A language without kept terms gives its pairs the value 0 and no terms.
- Empty texts have no terms, their group still occurs. Very long texts are read whole, in parts.
- Repeated rows are documents of their own. Ties go to the smaller item in UTF-8 order.
- Other columns are ignored, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release

#: What separates terms (RE2): ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text whose terms are held at once.
SLICE = 1 << 23
#: Salts of a language's terms in the join with its sources.
SALTS = 64
COUNTS = "lang string, source string, term string, n long, docs long"


def parts_of(text: str, size: int) -> Iterator[str]:
    """A text in parts of about `size` characters, cut where no term is (a longer term stays whole)."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not (text[end] < "\x80" and not text[end].isalpha()):
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch the occurrences and documents of each term by lang and source."""
    for b in batches:
        found = []
        texts = b.column("text")
        sizes = pc.binary_length(texts).to_pylist()
        row = 0
        while row < len(sizes):
            end, held = row + 1, sizes[row]
            while end < len(sizes) and held + sizes[end] <= SLICE:
                held += sizes[end]
                end += 1
            if held > SLICE:  # one long text
                slices = [(pa.array([row], pa.int32()), pa.array([p])) for p in parts_of(texts[row].as_py(), SLICE // 4)]
            else:
                slices = [(pa.array(range(row, end), pa.int32()), texts.slice(row, end - row))]
            for rows, part in slices:
                lists = pc.split_pattern_regex(pc.ascii_lower(part), BETWEEN)
                flat = pa.table({"row": rows.take(pc.list_parent_indices(lists)), "term": pc.list_flatten(lists)})
                found.append(flat.filter(pc.not_equal(flat["term"], "")).group_by(["row", "term"], use_threads=False).aggregate([([], "count_all")]))
            row = end
        if not found:
            continue
        once = pa.concat_tables(found).group_by(["row", "term"], use_threads=False).aggregate([("count_all", "sum")])
        named = pa.table({"lang": b.column("lang").take(once["row"]), "source": b.column("source").take(once["row"]), "term": once["term"], "n": once["count_all_sum"]})
        out = named.group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
        out = out.select(["lang", "source", "term", "n_sum", "count_all"]).rename_columns(["lang", "source", "term", "n", "docs"])
        yield from out.combine_chunks().to_batches(max_chunksize=50_000)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact at any size."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + 2 * terms))


def diverging(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def wide_terms(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, n, by): kept terms with their occurrences, overall and as a map by source."""
    per = rows.mapInArrow(counted, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by"))  # one entry per source
    return terms.filter(F.col("docs") >= least).select("lang", "term", "n", "by")


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from each other one, and its `top` most distinctive terms."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    wide = cut(wide_terms(rows, least))
    groups = rows.select("lang", "source").distinct()
    totals = wide.select("lang", F.explode("by").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = wide.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all"))
    shape = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("of"))
    shape = cut(shape.join(kept, "lang", "left").select("lang", F.col("of.source").alias("sources"), F.col("of.total").alias("totals"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all", F.lit(0)).alias("all")))

    salted = shape.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    vectors = wide.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    vectors = vectors.withColumn("counts", F.transform("sources", lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0).cast("long"))))
    vectors = vectors.select("lang", "term", "sources", "counts", F.zip_with("counts", "totals", lambda n, total: share(n, total, F.col("terms"))).alias("p"), share(F.col("n"), F.col("all"), F.col("terms")).alias("q"))

    emitted = F.flatten(F.transform("p", lambda p, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda q, j: F.struct(i.alias("a"), (i + j + 1).alias("b"), diverging(p, q).alias("f")))))
    sums = vectors.select("lang", F.inline(emitted)).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = shape.select("lang", "sources", F.posexplode("sources").alias("a", "source")).select("lang", "a", "source", F.posexplode("sources").alias("b", "item")).filter("a <> b")
    pairs = pairs.join(both, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    own = vectors.select("lang", "term", "q", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"), F.col("p").alias("p")))).filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), diverging(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = cut(pairs.withColumn("rank", F.row_number().over(order)).union(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)))  # the latter is cut before the shuffle
    release(wide, shape)
    return out
