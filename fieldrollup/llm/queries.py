"""The text operators as named queries, and the same in DuckDB SQL where that can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldrollup.llm import exact_dedup, jaccard_join, lm, mixing, pieces, quality, repeats, sharding, toxicity
from fieldrollup.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, d, "documents"))


def domain_levels() -> list[tuple[str, Column]]:
    """The tree of the test tables: a domain by the source's number, its languages, its sources."""
    number = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int")
    domain = F.when(number == 0, "hub").when(number < 10, "web").otherwise("books")
    return [("domain", domain), ("language", F.col("lang")), ("origin", F.col("source"))]


#: Target weights by path; a path that isn't named weighs 1 among its siblings.
WEIGHTS = {
    ("hub",): 0.3, ("web",): 0.4, ("books",): 0.3,
    ("hub", "en"): 0.6, ("hub", "de"): 0.15, ("hub", "fr"): 0.15, ("hub", "es"): 0.1,
    ("web", "en"): 0.55, ("web", "de"): 0.15, ("web", "fr"): 0.15, ("web", "es"): 0.15,
    ("books", "en"): 0.5, ("books", "de"): 0.2, ("books", "fr"): 0.2, ("books", "es"): 0.1,
}


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(table(spark, d, "documents"), domain_levels(), WEIGHTS)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "domain", "language", "origin", "n_tokens", "epoch")


def op3_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return pieces.token_counts(table(spark, d, "documents"))


def op6_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


def op7_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shards(table(spark, d, "documents"))


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(table(spark, d, "documents"))


def op9_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm.lm_scores(table(spark, d, "documents"))


def op10_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeats(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    found = (
        op1_ngram_jaccard_join, op2_mixing, op3_sentencepiece, op4_toxicity, op5_token_counts,
        op6_exact_dedup, op7_sharding, op8_quality_rules, op9_lm_scoring, op10_suffix_dedup,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return {
        "op6_exact_dedup": f"""
            WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '{space}', '', 'g') AS t FROM documents),
            g AS (SELECT *, count(*) OVER (PARTITION BY t) AS group_size, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id FROM n)
            SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
        "op8_quality_rules": f"""
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
            w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w,
                regexp_extract_all(translate(lower(t), '.,;:', ''), '{word}') AS lw,
                list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
            win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
            rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
            cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(5) AS r(j)) GROUP BY 1),
            c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                len(l) AS n_lines, len(list_filter(lw, lambda x: x IN ({stops}))) AS n_stop FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
            r AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
                CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_ratio,
                CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0.0 END AS stop_ratio,
                CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
                n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
            SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, mean_word_chars, symbol_ratio, stop_ratio, dup_line_ratio, base_failed,
                NOT base_failed AND n_words BETWEEN 10 AND 10000000 AND mean_word_chars BETWEEN 2.0 AND 15.0 AND symbol_ratio <= 0.2
                AND (n_words < 50 OR stop_ratio >= 0.06) AND dup_line_ratio <= 0.5 AS kept FROM r""",
    }
