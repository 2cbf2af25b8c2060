"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold (lower-cased
ASCII). The index has, for blocks of rows, a posting list of row keys for every trigram that a query
names. Queries are answered per block by intersecting and uniting posting lists; the rows found are the
rule's candidates, and only they are verified by the regex, over the whole text. A rule without
mandatory trigrams has no query and scans all texts.

Row keys are 64-bit hashes of doc_id and text. A clash or a repeated row only adds a candidate, which
the verification then decides, so results are exact. Up to KEYS candidate keys are sent to the texts;
only beyond that are texts shuffled to meet their keys.

- Null texts count as empty and have no secrets; null ids are no matter, as rows stay where they are.
- Very long texts are scanned whole. Spans count code points, end exclusive.
- Ties (spans of several kinds with one start) are ordered by kind as listed. Repeated rows each have their spans.
- Empty tables give no row. Other columns are kept; one named as the column of spans is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, leftmost and not overlapping, whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, in this order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Kinds that are added to them; fixed values.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE
#: Rows of a block of the index, on average.
BLOCK = 4096
#: Candidate keys are sent to all texts up to this number: two longs each, so some 10 MB.
KEYS = 1 << 18

#: A query: a trigram, ("and", parts) or ("or", parts); None holds for every text.
Query = str | tuple | None


def conjunction(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def disjunction(parts: Iterable[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    needs = {p: {p} if isinstance(p, str) else set(p[1]) if p and p[0] == "and" else {p} for p in kept}
    kept = [p for p in kept if not any(needs[q] < needs[p] for q in kept)]  # a part that asks for more than another adds nothing
    return None if None in kept or not kept else kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_strings(strings: Iterable[str]) -> Query:
    return disjunction(conjunction(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The Boolean trigram query of a regex: finite sets of strings are multiplied out along concatenations as long as they have `most` members at most."""

    def walk(items) -> tuple[set[str] | None, Query]:
        """All strings that match, if few; the query for what was found before they became too many."""
        run, queries = {""}, []
        closed = True  # whether the strings in `run` are all of the match so far

        def flush() -> None:
            nonlocal run, closed
            queries.append(of_strings(run))
            run, closed = {""}, False

        for op, arg in items:
            op = str(op)
            strings: set[str] | None = None
            query: Query = None
            if op == "LITERAL":
                strings = {chr(arg).lower()}
            elif op == "IN":
                found: set[str] | None = set()
                for kind, x in arg:
                    if str(kind) == "LITERAL":
                        found.add(chr(x).lower())
                    elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                        found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        found = None
                        break
                strings = found if found and len(found) <= 8 else None
            elif op == "SUBPATTERN":
                strings, query = walk(arg[3])
            elif op == "BRANCH":
                branches = [walk(b) for b in arg[1]]
                if all(s is not None for s, _ in branches):
                    strings = set().union(*(s for s, _ in branches))
                else:
                    query = disjunction(q if s is None else of_strings(s) for s, q in branches)
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, greatest, body = int(arg[0]), int(arg[1]), arg[2]
                inner, inner_query = walk(body)
                if inner is not None and greatest <= 3 and sum(len(inner) ** n for n in range(least, greatest + 1)) <= most:
                    strings = {"".join(x) for n in range(least, greatest + 1) for x in product(sorted(inner), repeat=n)}
                elif least:
                    query = inner_query if inner is None else of_strings(inner)
            elif op == "AT":
                strings = {""}
            if strings is None or len(run) * len(strings) > most:
                flush()
                queries.append(query)
                if strings is not None:
                    run = strings
            else:
                run = {a + b for a in run for b in strings}
        if closed:
            return run, None
        return None, conjunction([*queries, of_strings(run)])

    strings, query = walk(re._parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def index(docs: DataFrame, vocabulary: list[str], block: int = BLOCK) -> DataFrame:
    """The inverted index: one row per block, `postings` maps a trigram's number to the keys of the block's rows that hold it."""
    blocks = -(-docs.count() // block) or 1
    lower = docs.select(row_key().alias("key"), F.lower("text").alias("low")).filter("low is not null")
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary))))
    pairs = lower.select(F.pmod("key", F.lit(blocks)).alias("block"), "key", F.explode(present).alias("trigram"))
    lists = pairs.distinct().groupBy("block", "trigram").agg(F.collect_list("key").alias("keys"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))


def answer(query: Query, numbers: dict[str, int]) -> Column:
    """The keys of a block that fulfil a query."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("postings", F.lit(numbers[query])), F.array().cast("array<bigint>"))
    parts = [answer(q, numbers) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def numbered(keys: Column, rule: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(1 << rule).cast("long").alias("rule")))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Row keys with the numbers of the rules that they are candidates of, as bits of a long."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    vocabulary = sorted(set().union(*map(trigrams, queries.values()))) if queries else []
    numbers = {t: i for i, t in enumerate(vocabulary)}
    found = [numbered(answer(q, numbers), i) for i, q in queries.items()]
    hits = index(docs, vocabulary).select(F.inline(F.concat(*found) if found else F.array().cast("array<struct<key:bigint,rule:bigint>>")))
    return hits.groupBy("key").agg(F.bit_or("rule").alias("rules"))


SPAN = "array<struct<start:int,rank:int,end:int>>"


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's matches: what stands between matches and the matches themselves, laid end to end."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zipped = F.arrays_zip(between.alias("between"), whole.alias("whole"), part.alias("part"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, spans: str = "secret_spans") -> DataFrame:
    """All rows with an array of (start, rank of the rule, end), ordered; a column of this name is replaced."""
    docs = docs.drop(spans)
    found = cut(candidates(docs, rules).select(F.col("key").alias("__tl_key"), F.col("rules").alias("__tl_rules")))
    if found.count() <= KEYS:
        found = F.broadcast(found)
    rows = docs.withColumn("__tl_key", row_key()).join(found, "__tl_key", "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(SPAN)
    each = []
    for i, rule in enumerate(rules):
        is_candidate = (F.coalesce("__tl_rules", F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0) if trigram_query(rule.pattern) is not None else F.lit(True)
        each.append(F.when(is_candidate & text.rlike(rule.pattern), matches(text, rule, i)).otherwise(none))
    return rows.withColumn(spans, F.array_sort(F.concat(*each))).drop("__tl_key", "__tl_rules")


def joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))

    def of_rule(i: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["rank"] == i)).cast("long")

    n = [of_rule(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(joined(base, RULES), 256).alias("base_sha256"), joined(F.col("secret_spans"), RULES).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """All rows, secrets replaced by `mask` (overlapping spans by one); n_chars follows the text where that column exists."""
    found = scan(docs, spans="__tl_spans")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__tl_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("__tl_clean", F.when(F.size("__tl_spans") > 0, clean).otherwise(F.col("text")))
    cols = [F.col("__tl_clean").alias(c) if c == "text" else F.when(F.size("__tl_spans") > 0, F.length("__tl_clean")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
