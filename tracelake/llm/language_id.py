"""Language identification by word-first backoff.

The model holds log frequencies per language of words and of character n-grams. A word that the model
knows is scored as a whole. A word that it doesn't know is covered from left to right by the longest
known character n-grams (of the word with bounds), falling back to shorter ones; a character unknown
even alone scores the same for all languages.

The classifier is fit on a bounded sample: of every language, the first `sample` labelled training rows
by a hash of doc_id and text (all rows if there are no more), and of these no more than fill
`sample_bytes` bytes, or the language's part of `total_bytes`. Texts that alone are longer come last;
a language that has only such texts learns from one. All words and n-grams of the sample are kept, and
a unit has log frequencies for the languages that have it only, so the sample's bytes bound the model
that is sent to all tasks, whatever the number of languages. Everything is predicted.

A language's score is its share: the softmax of the mean log frequency per scored unit, times a
sharpness.

- Nulls: a null text, like one without a letter, is `und` with score 0; a null lang teaches nothing; a
  null doc_id is in the fold of the empty text.
- Empty tables: no row comes back; with no training rows at all every text is `und`.
- Very long texts are read whole, their words in steps of bounded size.
- Repeated rows are predicted each, and each counts as a row of the sample.
- Ties between languages go to the first by name.
- Columns: a column named like an output is replaced, all others are kept where rows are kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remainder, schema_with

WORDS = regex.compile(r"[\p{L}\p{M}]+").findall
LETTER = regex.compile(r"\p{L}").search


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  # training rows per language, at most
    sample_bytes: int = 8 << 20  # of their texts per language
    total_bytes: int = 64 << 20  # of all languages' texts
    longest: int = 4  # of the n-grams
    sharpness: float = 4.0


@dataclass
class Model:
    """Units as Arrow arrays, which travel and lie in a fraction of the memory of a dict; workers index them. Logs are sparse: those of unit i are at
    start[i] to start[i + 1], and a language that doesn't have the unit has the default for units of its length."""

    langs: list[str]
    words: pa.Array
    grams: pa.Array
    length: np.ndarray  # by unit (words, then n-grams): 0 for a word, else characters
    start: np.ndarray
    lang: np.ndarray
    value: np.ndarray
    default: np.ndarray  # by length and language
    settings: Settings = Settings()

    def logs(self, unit: int) -> np.ndarray:
        out = self.default[self.length[unit]].copy()
        a, b = self.start[unit], self.start[unit + 1]
        out[self.lang[a:b]] = self.value[a:b]
        return out


def crossing(sizes: DataFrame, part: str, room: Column) -> DataFrame:
    """Per language the part in which the running number of rows reaches `room` (none if it never does): lang, part, room left in it."""
    run = sizes.withColumn("upto", F.sum("count").over(Window.partitionBy("lang").orderBy(part))).withColumn("before", F.col("upto") - F.col("count"))
    return run.filter((F.col("before") < room) & (F.col("upto") >= room)).select("lang", F.col(part).alias(f"last_{part}"), (room - F.col("before")).alias("room"))


def sampled(rows: DataFrame, settings: Settings) -> DataFrame:
    """Training rows (lang, text): of every language the first `sample` by a hash of doc_id and text, or all if there are no more.

    Two levels of 4096 counts per language find the part in which the bound is reached; only that part's rows are ranked, so nothing
    is sorted as a whole, and a part of any size (equal rows) fills what room is left."""
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    spread = hashed.withColumn("bucket", F.pmod("h", F.lit(4096))).withColumn("part", F.pmod(F.shiftrightunsigned("h", 12), F.lit(4096)))
    outer = crossing(spread.groupBy("lang", "bucket").count(), "bucket", F.lit(settings.sample))
    within = spread.join(F.broadcast(outer), "lang").filter("bucket = last_bucket").groupBy("lang", "part", "last_bucket", "room").count()  # one row per language
    ends = crossing(within, "part", F.col("room")).join(outer.drop("room"), "lang")
    at_last = F.col("bucket") == F.col("last_bucket")
    inside = F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket")) | (at_last & (F.col("part") < F.col("last_part")))
    edge = at_last & (F.col("part") == F.col("last_part"))
    near = cut(spread.join(F.broadcast(ends), "lang", "left").withColumn("inside", F.coalesce(inside, F.lit(False))).filter(F.col("inside") | edge))  # one row per language
    ranked = near.filter("not inside").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text")))
    fill = ranked.filter((F.col("k") <= settings.sample) & (F.col("k") <= F.col("room")))  # the constant bound is applied before the shuffle
    return filling(near.filter("inside").select("lang", "text", "h").union(fill.select("lang", "text", "h")), settings)


def filling(rows: DataFrame, settings: Settings) -> DataFrame:
    """Of each language's rows (lang, text, h; at most `sample`) the first by hash until the bytes are reached, longer texts than that last."""
    room = min(settings.sample_bytes, settings.total_bytes // max(rows.select("lang").distinct().count(), 1))
    rows = rows.withColumn("size", F.octet_length("text").cast("long")).withColumn("at", F.struct((F.col("size") > room).alias("over"), F.col("h")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = rows.select("lang", "size", "at").withColumn("before", before).filter(F.col("before") < room).groupBy("lang").agg(F.max("at").alias("last"))
    return rows.join(F.broadcast(last), "lang").filter("at <= last").select("lang", "text")  # one row per language


def fit(rows: DataFrame, settings: Settings = Settings()) -> Model:
    """Fits the classifier on labelled rows (doc_id, lang, text)."""
    longest = settings.longest

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                totals.setdefault(lang, Counter()).update(WORDS((text or "").lower()))
        for lang, words in totals.items():
            grams: Counter = Counter()
            for w, n in words.items():
                t = f"^{w}$"
                for k in range(1, longest + 1):
                    for i in range(len(t) - k + 1):
                        grams[k, t[i : i + k]] += n
            rows = [(lang, 0, w, n) for w, n in words.items()] + [(lang, k, g, n) for (k, g), n in grams.items()]
            for i in range(0, len(rows), 50_000):
                cols = zip(*rows[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "k", "unit", "n"])

    counts = sampled(rows, settings).mapInArrow(count, "lang string, k int, unit string, n long").groupBy("lang", "k", "unit").agg(F.sum("n").alias("n"))
    kept = counts.toArrow().combine_chunks()  # bounded by the sample
    langs = sorted(pc.unique(kept["lang"]).to_pylist())
    k, n = kept["k"].to_numpy(), kept["n"].to_numpy()
    lang = pc.index_in(kept["lang"], pa.array(langs, pa.string())).to_numpy()
    words, grams = (pc.unique(kept["unit"].filter(pa.array(of))) for of in (k == 0, k > 0))
    place = [pc.fill_null(pc.index_in(kept["unit"], units), 0).to_numpy() for units in (words, grams)]
    at = np.where(k == 0, place[0], len(words) + place[1])
    totals = np.zeros((longest + 1, len(langs)))
    np.add.at(totals, (k, lang), n)
    order = np.lexsort((lang, at))
    start = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(words) + len(grams)))])
    length = np.concatenate([np.zeros(len(words), "u1"), pc.utf8_length(grams).to_numpy().astype("u1")])
    return Model(langs, words, grams, length, start, lang[order].astype("i4"), np.log(n / totals[k, lang])[order], np.log(0.5 / (totals + 1)), settings)


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")


class Scorer:
    """Scores texts in a worker; a bounded cache keeps the words' scores."""

    def __init__(self, model: Model, cached: int = 300_000):
        k = len(model.langs)
        self.model, self.cached = model, (cached := max(1000, min(cached, 4_000_000 // (k + 1))))
        self.words = {w: i for i, w in enumerate(model.words.to_pylist())}
        self.grams = {g: i for i, g in enumerate(model.grams.to_pylist(), len(self.words))}
        self.rows = np.zeros((cached + 1, k + 1))
        self.at: dict[str, int] = {}

    def unseen(self, word: str) -> tuple[np.ndarray, int]:
        """Sum of the n-grams that cover a word, and how many."""
        text, i, n = f"^{word}$", 0, 0
        total = np.zeros(len(self.model.langs))
        while i < len(text):
            for k in range(min(self.model.settings.longest, len(text) - i), 0, -1):
                if (got := self.grams.get(text[i : i + k])) is not None:
                    total += self.model.logs(got)
                    n += 1
                    break
            else:
                k = 1
            i += k
        return total, n

    def number(self, word: str) -> int:
        if len(self.at) >= self.cached:
            self.at.clear()
        known = self.words.get(word)
        total, n = (self.model.logs(known), 1) if known is not None else self.unseen(word)
        i = self.at[word] = len(self.at)
        self.rows[i, :-1], self.rows[i, -1] = total, n
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        if not text or not langs or not LETTER(text):
            return "und", 0.0
        total, units = np.zeros(len(langs)), 0.0
        words = WORDS(text.lower())
        for i in range(0, len(words), self.cached // 2):
            part = words[i : i + self.cached // 2]
            if len(self.at) + len(part) > self.cached:
                self.at.clear()
            numbers = list(map(self.at.get, part))
            if None in numbers:
                numbers = [self.at.get(w, -1) if n is None else n for w, n in zip(part, numbers, strict=True)]
                numbers = [self.at[w] if n < 0 and w in self.at else self.number(w) if n < 0 else n for w, n in zip(part, numbers, strict=True)]
            got = self.rows[numbers].sum(0)
            total, units = total + got[:-1], units + got[-1]
        shares = np.exp((total - total.max()) / max(units, 1.0) * self.model.settings.sharpness)
        best = int(total.argmax())
        return langs[best], float(shares[best] / shares.sum())


def predict(docs: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score to all rows; columns of these names are replaced."""
    docs = docs.drop(lang, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.predict(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*b.schema.names, lang, score])

    return docs.mapInArrow(run, schema_with(docs, {lang: "string", score: "double"}))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from documents whose fold isn't 1."""
    held_out = remainder("doc_id", 3) == 1
    model = fit(labelled(docs.filter(~held_out)), settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The rows whose language is identified: not `und`, and with a share of `least` or more."""
    model = fit(labelled(docs.filter(remainder("doc_id", 3) != 1)), settings)
    return predict(docs, model, "__tl_lang", "__tl_score").filter((F.col("__tl_lang") != "und") & (F.col("__tl_score") >= least)).drop("__tl_lang", "__tl_score")
