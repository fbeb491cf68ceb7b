"""A corpus from raw documents to packed sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplake.llm import decontam, lines, packing, rules, simhash
from steplake.llm.common import TEXT_ROWS, gathered, lasting, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep.

    Null and empty texts and those under 50 words fail the rules and go; null ids
    and repeated rows are judged like others. No documents give none.
    """
    judged = rules.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them have.

    Every row stays; a null text becomes empty, and so may one all of whose lines
    are common. Rows of one id count as one document. ``n_chars``, if there, is
    counted anew.
    """
    done = lines.line_dedup(docs)
    new = {"text": F.col("_lines.kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_lines.kept").cast("long")
    return gathered(done.withColumns(new).select(*docs.columns), docs.count(), TEXT_ROWS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of smallest id, of each group of texts whose 5-word shingles are similar to 0.8.

    Texts without words are a group; rows with a null id stay; of rows that repeat
    an id one stays.
    """
    return gathered(simhash.drop_near_duplicates(docs, 5, similarity=0.8), docs.count(), TEXT_ROWS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's template.

    Null and empty texts and rows with a null id stay; of an id that is named all
    rows go. No benchmark drops nothing.
    """
    kept = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=4)
    return gathered(kept, docs.count(), TEXT_ROWS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of permitted lengths.

    A null or empty text is one piece of no tokens; null ids and repeated rows are
    packed like others.
    """
    return packing.best_fit_packing(docs, packing.word_count(docs["text"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Contraction to components and greedy packing aren't expressed in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again, and
    deleted when the last has run."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        return lasting(STAGES[-1][1](spark, docs, sf_dir))
