"""The corpus operators as registered queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lines, packing, pii, quality_model, rules, simhash, suffix, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit_packing(docs, packing.word_count(docs["text"]))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shortest=4)


def op3_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed_passages(table(spark, sf_dir, "documents")).drop("spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"), F.col("_lines.keep").alias("keep_runs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = [op1_best_fit_packing, op2_template_decontamination, op3_crf_personal_data, op4_ftrl_quality, op5_simhash_near_duplicates, op6_quality_rules, op7_token_counts, op8_license_scan, op9_suffix_array_dedup, op10_line_dedup]
    return {f.__name__: f for f in own} | {"pipeline": run}


ORACLE = {
    "op10_line_dedup": """
        WITH each AS (
            SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM each
        ), hot AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        done AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hot.k IS NOT NULL) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256,
                list(hot.k IS NOT NULL ORDER BY pos) AS f
            FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
        ), edged AS (
            SELECT *, list_concat(list_concat(CASE WHEN f[1] THEN [0, 0] ELSE [0] END,
                list_filter(range(1, n_lines), lambda i: f[i + 1] <> f[i])), [n_lines]) AS e FROM done
        )
        SELECT doc_id, n_lines, n_dropped, kept_sha256,
            array_to_string(list_transform(range(2, len(e) + 1), lambda i: e[i] - e[i - 1]), ',') AS keep_runs
        FROM edged
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
