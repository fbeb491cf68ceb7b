"""Matching of texts with short goals by shared words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_tokens

#: Share of a goal's words that must be met, for goals of five words and more, and shorter ones (fixed values).
LONG_GOAL, LONG_SHARE, SHORT_SHARE = 5, 0.25, 0.34


def workflow_match(queries: DataFrame, goals: DataFrame, id_col: str, text_col: str, goal_id: str, goal_text: str) -> DataFrame:
    """The best goal of each text: ``id_col, goal_id, overlap, ratio, score``.

    Texts and goals meet by an equi-join on distinct words, never pair by pair;
    counts are partial sums beside the join, and the best goal an aggregate. Ties
    go to the smaller goal id. Texts that no goal fits have no row.
    """
    q = queries.select(F.col(id_col).alias("_q"), F.explode(F.array_distinct(content_tokens(F.col(text_col)))).alias("word"))
    g = goals.select(F.col(goal_id).alias("_g"), content_tokens(F.col(goal_text)).alias("words")).withColumn("size", F.size("words"))
    g = g.select("_g", "size", F.explode(F.array_distinct("words")).alias("word"))
    met = q.join(g, "word").groupBy("_q", "_g", "size").agg(F.count("*").alias("overlap"))
    met = met.withColumn("ratio", F.col("overlap") / F.greatest("size", F.lit(1)))
    met = met.filter(F.col("ratio") >= F.when(F.col("size") >= LONG_GOAL, LONG_SHARE).otherwise(SHORT_SHARE)).withColumn("score", 2 * F.col("overlap") + F.col("ratio"))
    best = met.groupBy("_q").agg(F.min_by(F.struct("_g", "overlap", "ratio", "score"), F.struct((-F.col("score")).alias("s"), "_g")).alias("b"))
    return best.select(F.col("_q").alias(id_col), F.col("b._g").alias(goal_id), "b.overlap", "b.ratio", "b.score")
