"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw_score, divergence, exact_dedup, kd_topk, language_id, packing, pii, prob_minhash, secret_scan, sharding, token_counts, vector_codes
from .common import load


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(load(spark, sf_dir, "documents"))


def op2_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score.scores(load(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(load(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(load(spark, sf_dir, "documents"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(load(spark, sf_dir, "documents"), 8, sharding.map_folder(spark, f"{sf_dir}/documents.parquet"))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), tokenizer_path())


def op7_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark(load(spark, sf_dir, "documents"))


def op8_kd_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


def op10_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(load(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(load(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_ctw_score, op3_language_id, op4_pii, op5_virtual_slots, op6_bpe_automaton, op7_chunk_recipes, op8_kd_trees, op9_linear_grouping, op10_prob_minhash, op11_vector_codes, op12_token_counts, op13_source_divergence)}


def vector_codes_sql(rounds: int = 6) -> str:
    """Each round's assignment and update as a step of its own."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, p.part, min(CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i]))) AS HUGEINT) * 16 + entry) AS m
            FROM p JOIN b{r} b ON p.part = b.part GROUP BY ALL)"""
    update = """b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.x, b.x) AS x FROM b{r} b LEFT JOIN (
                SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
                    SELECT a.part, m % 16 AS entry, i, CAST(sum(p.x[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part, LATERAL (SELECT unnest(range(1, len(p.x) + 1)) AS i) GROUP BY ALL)
                GROUP BY ALL) u ON u.part = b.part AND u.entry = b.entry)"""
    steps = ",\n        ".join(f"{near.format(r=r)},\n        {update.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
        ), p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM v, range(8) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
        {steps},
        {near.format(r=rounds)},
        c AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
        FROM c JOIN v USING (vec_id)
    """


ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        o AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(CAST((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source) AS BIGINT), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
        l AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang),
        p AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v) AS HUGEINT) AS p FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (any_value(total) + 2 * any_value(v)) AS HUGEINT) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
        f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
    "op7_chunk_recipes": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
    "op8_kd_trees": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id AND len(q.v) = len(c.v)
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
