"""Choosing rows: best, first, top, repeated, missing, requested."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that a table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def best_per_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The row of greatest value per key; of equals the first in order. NaN never wins
    over a number. An aggregate, so a large group is reduced before it moves; texts
    are ranked, which Spark limits before the exchange."""
    if dict(df.dtypes)[value] in ("string", "boolean", "date", "timestamp", "timestamp_ntz"):
        return top_k_per_key(df, key, 1, F.desc_nulls_last(value), order)
    worth = F.when(F.isnan(F.col(value).cast("double")), None).otherwise(F.col(value))
    row = F.struct(*(c for c in df.columns))
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.struct((-worth).isNull(), -worth, order)).alias("r")).select("r.*")


def top_k_per_key(df: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first k rows of each key (Spark limits each group before the exchange)."""
    n = fresh(df, "_n")
    return df.withColumn(n, F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col(n) <= k).drop(n)


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in order."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("_k")).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def duplicates(df: DataFrame, key: str, path: str) -> DataFrame:
    """Keys that repeat: ``key, n, first_path``, and all later paths, joined."""
    g = df.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col(path))).alias("p")).filter("n > 1")
    return g.select(key, "n", F.element_at("p", 1).alias("first_path"), F.array_join(F.slice("p", 2, F.size("p")), ",").alias("later"))


def missing(requested: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Requested keys that aren't available."""
    return requested.join(available.select(key).distinct(), key, "left_anti")


def in_requested_order(requested: DataFrame, available: DataFrame, key: str, pos: str, *order: str) -> DataFrame:
    """Available rows by request, repeats kept; the first available row of a key counts."""
    return requested.join(first_wins(available, key, *order), key).orderBy(pos)


def positions(df: DataFrame, key: str, name: str = "pos", descending: bool = False, *tie: str) -> DataFrame:
    """Adds each row's place, from 1, in the order of a numeric key and then of ``tie``.

    No task gets all rows: approximate percentiles cut the key into ranges, which
    are numbered apart; what precedes a range comes from the counts of at most 1,001
    ranges. Rows of one key stay in one range. Nulls stand where Spark sorts them:
    first, or last if ``descending``.
    """
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1000)
    marks = df.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 10_000)).first()[0] if parts > 1 else None
    mark = F.array(*map(F.lit, sorted(set(marks or [])))).cast(f"array<{dict(df.dtypes)[key]}>")
    b = fresh(df, "_range")
    rows = df.withColumn(b, F.size(F.filter(mark, lambda x: x < F.col(key))) * (-1 if descending else 1))
    before = W.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy(b).count().select(F.col(b).alias("_of"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(b).orderBy(F.desc(key) if descending else F.asc(key), *tie))
    numbered = rows.withColumn(name, within.cast("long"))
    out = numbered.join(F.broadcast(starts), numbered[b] == starts["_of"])
    return out.select(*(numbered[c] for c in df.columns if c != name), (numbered[name] + starts["_start"]).alias(name))
