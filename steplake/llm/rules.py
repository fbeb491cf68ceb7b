"""Quality rules: counts per document and a hashed n-gram likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Hash buckets for n-grams (words and word pairs).
BUCKETS = 1 << 16
#: Documents of the trusted target at most: the labelled-good ids of smallest hash.
MOST_TRUSTED = 20_000
#: A document is rejected whose mean log ratio per n-gram is below this: its
#: n-grams are by the factor e ** -0.08 less likely under the target.
THRESHOLD = -0.08


def held(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Select columns so that the optimizer computes each of them just once.

    Without this, expressions would be copied into the lambdas that use them and
    run again for every element.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


def words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``part`` (the text split at every white-space character) and ``row``."""
    row = F.struct(*(df[c] for c in df.columns)).alias("row")
    t = df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), row)
    return t.select("doc_id", "text", F.split("text", r"[\x20\x09-\x0D]", -1).alias("part"), "row")


def word_hashes() -> Column:
    return F.transform(F.filter("part", lambda w: w != ""), lambda w: F.xxhash64(w))


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 3-word windows that stand twice or more.

    From ``h`` (word hashes), ``s`` and ``m`` (bits of a place, and their mask).
    Only rows with a repeated window sort theirs, as hash bits above and place
    bits below; neighbours with equal upper bits are compared in full. Then the
    places found, in order, give what they cover: n log n within the row.
    """
    h, s, m, n = F.col("h"), F.col("s"), F.col("m"), F.size("h")
    window = F.transform(F.slice("h", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    rest = [c for c in df.columns if c != "h"]
    df = held(df, *rest, window.alias("k"))
    k = F.col("k")
    packed = F.sort_array(F.transform(k, lambda x, i: F.call_function("shiftleft", x, s).bitwiseOR(i.cast("long"))))
    none = F.array().cast("array<bigint>")
    df = held(df, *rest, "k", F.when(F.size(F.array_distinct(k)) < F.size(k), packed).otherwise(none).alias("q"))
    q = F.col("q")
    place = lambda x: x.bitwiseAND(m).cast("int")
    same = lambda x, y: F.coalesce((F.call_function("shiftrightunsigned", x.bitwiseXOR(y), s) == 0) & (F.get(k, place(x)) == F.get(k, place(y))), F.lit(False))
    at = F.sort_array(F.transform(F.filter(q, lambda x, j: same(x, F.get(q, j - 1)) | same(x, F.get(q, j + 1))), place))
    df = held(df, *rest, at.alias("at"))
    covers = F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), j + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x))


def pair_hashes(h: Column) -> Column:
    """Hashes of the word pairs, from word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def ratios(docs: DataFrame, trusted: DataFrame, order: int = 2) -> tuple[list[float], float]:
    """Log of target over raw probability for each bucket, and what to add to the threshold.

    The target has BUCKETS n-grams of the raw corpus mixed in, so that a bucket
    without evidence has a ratio near 0. A small sample still leaves good documents
    below 0: one half of it (by a hash of the id) has the mean c under the target
    of the other half. If c is negative, three times c is added to the threshold.

    ``docs`` has ``doc_id`` and ``part``. Counts of n-grams up to ``order`` (1 or 2)
    are over all documents; the trusted ids (bounded) are broadcast, and BUCKETS
    sums reach the driver.
    """
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("_side")
    flagged = docs.join(F.broadcast(trusted.select(F.col("doc_id").alias("_good"), side)), F.col("doc_id") == F.col("_good"), "left")
    h = F.col("h")
    each = held(flagged, word_hashes().alias("h"), F.col("_side").alias("side"))
    each = each.select(F.explode(h if order == 1 else F.concat(h, pair_hashes(h))).alias("g"), "side")
    sums = each.select(bucket(F.col("g")).alias("b"), "side").groupBy("b").agg(F.count("*").alias("n"), F.count("side").alias("good"), F.sum("side").alias("odd"))
    raw, good, odd = [0] * BUCKETS, [0] * BUCKETS, [0] * BUCKETS
    for r in sums.collect():
        raw[r.b], good[r.b], odd[r.b] = r.n, r.good, r.odd or 0
    total = sum(raw)

    def logs(counts: list[int]) -> list[float]:
        own = sum(counts)
        return [math.log((g * total / n + BUCKETS) / (own + BUCKETS)) if n else 0.0 for n, g in zip(raw, counts, strict=True)]

    even = [g - o for g, o in zip(good, odd, strict=True)]
    mean = sum(o * r for o, r in zip(odd, logs(even), strict=True)) / max(1, sum(odd))
    return logs(good), 3 * min(0.0, mean)


def quality_rules(df: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_trusted: int = MOST_TRUSTED, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``kept``, ``ratio`` and ``row`` of each row.

    ``row`` is a struct of the input's columns; it costs nothing where it isn't used.

    The target is at most ``most_trusted`` documents labelled good (a bounded,
    documented sample); the raw corpus is every document. ``ratio`` is the mean
    log ratio of a document's n-grams, words and with ``order`` 2 also word pairs
    (0 if it has none).

    A null text has no words and fails the base. Null ids stay and aren't in the
    target; repeated rows are each judged; an empty table gives an empty one;
    without good labels all ratios are 0 and the base decides; other columns are
    ignored; texts are read whole.
    """
    lab = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].alias("q")).dropna()
    trusted = lab.groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_trusted)
    docs = words_of(df, id_col, text_col)
    logs, lower = ratios(docs, trusted, order)
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in logs)), ",").cast("array<double>")
    line = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    counts = held(
        docs,
        "doc_id",
        (F.length("text") - F.size("part") + 1).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        F.transform(line, lambda x: F.xxhash64(x)).alias("line_h"),
        word_hashes().alias("h"),
        "row",
    )
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + F.get(table, bucket(x)))
    grams = F.size("h")
    if order > 1:
        total += F.aggregate(pair_hashes(F.col("h")), F.lit(0.0), lambda a, x: a + F.get(table, bucket(x)))
        grams += F.greatest(F.size("h") - 1, F.lit(0))
    places = F.length(F.bin(F.size("h").cast("long"))).cast("int")
    one = F.lit(1).cast("long")
    scored = held(
        counts,
        "doc_id", "word_chars", "n_symbols", "h", "row",
        (F.size("line_h") - F.size(F.array_distinct("line_h"))).cast("long").alias("n_dup_lines"),
        F.size("h").cast("long").alias("n_words"),
        F.round(total / F.greatest(grams, F.lit(1)), 6).alias("ratio"),
        places.alias("s"),
        (F.call_function("shiftleft", one, places) - one).alias("m"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return repeat_words(scored).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("ratio") >= threshold + lower)).alias("kept"), "ratio", "row",
    )
