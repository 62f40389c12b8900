"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import license_scan
from folioflow.llm.common import arrow_limits, docs_of
from folioflow.llm.quality_rules import STOP_WORDS


def vocabulary(name: str) -> str:
    """A public tokenizer's file; it lies at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.ngram_trie import score

    return score(docs_of(spark, sf_dir), min_count=1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.token_counts import count_tokens

    return count_tokens(docs_of(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.line_dedup import digest

    return digest(docs_of(spark, sf_dir))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.personal_data import personal_data

    return personal_data(docs_of(spark, sf_dir))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.suffix_dedup import remove_repeats

    return remove_repeats(docs_of(spark, sf_dir), keep_bytes=False)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.quality_rules import judge

    return judge(docs_of(spark, sf_dir)).drop("failed_rules")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.packing import pack

    return pack(docs_of(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.token_files import round_trip

    return round_trip(docs_of(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op9_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.minhash_forest import near_duplicates

    return near_duplicates(docs_of(spark, sf_dir), shingle=3, num=85, den=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.decontamination import contamination

    return contamination(docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.token_alignment import align

    return align(docs_of(spark, sf_dir), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.llm.hard_negatives import mine

    arrow_limits(spark)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(docs_of(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_trie": op1_ngram_trie,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_files": op8_token_files,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_decontamination": op10_decontamination,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_license_scan": op13_license_scan,
}

#: Fixed values of the contract: what is stripped from a line's ends, and upper-case letters that count as lower-case.
_SPACE, _UPPER, _LOWER = r"[\x20\x09-\x0D]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The others need a tokenizer, bytes, a trained model or similarity of all pairs; tests/llm holds them against plain versions.
SQL: dict[str, str] = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op6_quality_rules": f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_SPACE}+') IF x <> ''] AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT doc_id, i, concat_ws(' ', x, {", ".join(f"lead(x, {k}) OVER o" for k in range(1, 8))}) AS g, lead(x, 7) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, unnest(list(i)) AS i FROM windows WHERE whole GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, sum(least(8, i - before)) AS n
  FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 8) AS before FROM twice) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '!!')) AS marks,
    len([x FOR x IN w IF lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})]) AS stops, len([x FOR x IN l IF regexp_matches(x, '^[\\t\\n\\f\\r\\x0B ]*[-*•]')]) AS bullets,
    len([x FOR x IN l IF regexp_matches(x, '([.][.][.]|…)[\\t\\n\\f\\r\\x0B ]*$')]) AS ellipses
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 12.0 AND n_symbols / n_words <= 0.3 AND marks / n_words <= 0.3
  AND stops / n_words >= 0.02 AND n_repeat_words / n_words <= 0.3 AND n_dup_lines / n_lines <= 0.5 AND bullets / n_lines <= 0.9 AND ellipses / n_lines <= 0.3 AS kept
FROM b""",
    "op12_hard_negatives": """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS place FROM s WHERE same) WHERE place <= 5)
SELECT * FROM (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.place ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
WHERE rank <= 10""",
    "op13_license_scan": license_scan.twin(),
}
