"""Line deduplication with per-document bitmaps, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, gathered, lasting, scratch, written

#: Repeated keys up to this many (24 bytes each) are broadcast. Of more, those are that
#: have over one in so many lines, and so are fewer; the others are joined by a shuffle.
MOST_BROADCAST = 1 << 17


def lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def is_set(bits: Column, i: Column) -> Column:
    """Whether bit i is set in an array of 64-bit words (null: no bit is)."""
    word = F.get(bits, F.shiftright(i, 6))
    return F.coalesce(F.call_function("getbit", word, i.bitwiseAND(F.lit(63))) == 1, F.lit(False))


def runs(bits: Column, n: Column) -> Column:
    """The first n bits as run lengths, comma-joined: unset ones (0 if there are none),
    then set ones, and so on. ``bits`` is a plain column, as lambdas look it up."""
    turns = F.filter(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: is_set(bits, i) != is_set(bits, i - 1))
    begin = F.when(is_set(bits, F.lit(0)), F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))
    ends = F.concat(F.slice(begin, 2, 1), turns, F.array(n))
    return F.array_join(F.zip_with(ends, F.concat(begin, turns), lambda e, s: (e - s).cast("string")), ",")


def drop_bitmaps(df: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _h, bits, n_dropped``: a bitmap of the lines to drop, for rows that lose any.

    ``_id`` and ``_h`` (hash of the text) name a row. Line keys of ``min_chars``
    code points or more that stand in at least ``min_docs`` documents lose all
    their lines, or with ``keep_first`` all but the first (by document, then
    position). Keys travel as 128 bits of hash. They are range-partitioned with
    their document, so that a key of very many documents spreads over partitions,
    and sorted by document and position; the first line of each key in a document
    is streamed from there, and counts are summed before they are shuffled. The
    bitmap holds 64-bit words up to the last one with a bit set.
    """
    with scratch(df.sparkSession):
        return lasting(bitmaps(df, min_docs, min_chars, keep_first, id_col, text_col))


def bitmaps(df: DataFrame, min_docs: int, min_chars: int, keep_first: bool, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(df[id_col].cast("long").alias("_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("_text"))
    each = rows.select("_id", F.xxhash64("_text").alias("_h"), F.posexplode(lines(F.col("_text"))).alias("pos", "line"))
    keyed = each.select("_id", "_h", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    table = written(keyed.select("_id", "_h", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2")), "line-hashes")
    order = ["h1", "h2", "_id", "_h", "pos"]
    dealt = table.repartitionByRange("h1", "h2", "_id").sortWithinPartitions(*order)
    found = dealt.groupBy("h1", "h2", "_id").agg(F.min(F.struct("_h", "pos")).alias("first"), F.count("*").alias("n"))
    counts = found.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("lines"), F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "first._h", "first.pos")).alias("first"))
    hot = counts.filter(F.col("docs") >= min_docs).select("h1", "h2", "first", "lines")
    n = table.count()
    hot = written(gathered(hot, n), "line-keys")
    if hot.count() <= MOST_BROADCAST:
        gone = table.join(F.broadcast(hot), ["h1", "h2"])
    else:  # no key of the shuffled part has more than one in MOST_BROADCAST lines
        many = F.col("lines") > n / MOST_BROADCAST
        gone = table.join(F.broadcast(hot.filter(many)), ["h1", "h2"]).unionByName(table.join(hot.filter(~many), ["h1", "h2"]))
    if keep_first:
        gone = gone.filter(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_h") == F.col("first._h")) & (F.col("pos") == F.col("first.pos"))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(F.lit(63)))
    words = gone.groupBy("_id", "_h", F.shiftright("pos", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    maps = words.groupBy("_id", "_h").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"), F.max("w").alias("top"), F.sum(F.bit_count("b")).alias("n_dropped"))
    bits = F.transform(F.sequence(F.lit(0), F.col("top")), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return gathered(maps.select("_id", "_h", bits.alias("bits"), F.col("n_dropped").cast("long").alias("n_dropped")), n)


def line_dedup(df: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and, last, a struct ``_lines`` of ``n_lines, n_dropped, bits, keep, kept``.

    ``keep`` is the row's keep bitmap, compressed to run lengths: lines kept,
    lines dropped, lines kept, and so on. ``kept`` is the text without the lines
    that ``drop_bitmaps`` marks; it isn't made where it isn't used. Rows meet
    their bitmaps by id and hash of the text, in one join that shuffles texts once.

    A null text has one empty line and stays empty; a null id counts as one
    document; repeated rows of one id count as one document and each loses the
    same lines; an empty table gives an empty one. The name ``_lines`` (and
    ``_id``, ``_h``, ``bits``, ``n_dropped`` on the other side of the join) can't
    clash: columns are taken by reference, and an input column named ``_lines``
    is replaced.
    """
    marks = drop_bitmaps(df, min_docs, min_chars, keep_first, id_col, text_col)
    left = df.drop("_lines") if "_lines" in df.columns else df
    text = F.coalesce(left[text_col].cast("string"), F.lit(""))
    both = left.join(marks.hint("shuffle_hash"), left[id_col].cast("long").eqNullSafe(marks["_id"]) & (F.xxhash64(text) == marks["_h"]), "left")
    kept = F.when(marks["bits"].isNull(), text).otherwise(F.array_join(F.filter(lines(text), lambda _, i: ~is_set(marks["bits"], i)), "\n"))
    n = F.size(lines(text))
    keep = F.when(marks["bits"].isNull(), n.cast("string")).otherwise(runs(marks["bits"], n))
    new = F.struct(F.size(lines(text)).cast("long").alias("n_lines"), F.coalesce(marks["n_dropped"], F.lit(0)).cast("long").alias("n_dropped"), marks["bits"].alias("bits"), keep.alias("keep"), kept.alias("kept"))
    return both.select(*(left[c] for c in left.columns), new.alias("_lines"))
