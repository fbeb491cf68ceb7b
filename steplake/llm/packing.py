"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Permitted sequence lengths, in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs beside its length.
OVERHEAD = 16


def word_count(c: Column) -> Column:
    """White-space separated words, the query's unit of length."""
    return F.size(F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def greedy_fill(room: int, distinct: list[int], counts: list[int], upto: int) -> int:
    """Tokens that a room takes of the remaining pieces, largest first.

    ``distinct`` ascends; only its first ``upto`` sizes are left.
    """
    got, k = 0, bisect.bisect_right(distinct, room, 0, upto) - 1
    while k >= 0:
        n = min(counts[k], room // distinct[k])
        got += n * distinct[k]
        room -= n * distinct[k]
        k = bisect.bisect_right(distinct, room, 0, k) - 1
    return got


def pack_into(sizes: list[int], lengths: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the contents of each bin.

    ``sizes`` descend. A piece goes where the least room stays. If no open bin has
    room, the bin opens that costs least for each token it will hold at the end:
    its content is the piece and what the remaining pieces, largest first, would
    fill in, but for those that open bins have room for; its length is the
    shortest that holds that.
    """
    distinct = sorted({s for s in sizes if s})
    counts = [0] * len(distinct)
    for s in sizes:
        if s:
            counts[bisect.bisect_left(distinct, s)] += 1
    where, offset, used = [], [], []
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, list[int]] = {}  # by room
    left, free = sum(sizes), 0
    for s in sizes:
        upto = bisect.bisect_right(distinct, s)
        if s:
            counts[upto - 1] -= 1
        left -= s
        k = bisect.bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            at = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[k]
            free -= room
        else:
            best = None
            for c in lengths:
                if c < s:
                    continue
                content = s + min(greedy_fill(c - s, distinct, counts, upto), max(0, left - free))
                cost = (lengths[bisect.bisect_left(lengths, content)] + overhead) / max(content, 1)
                if best is None or cost < best[0]:
                    best = cost, c
            room = best[1]
            at = len(used)
            used.append(0)
        where.append(at)
        offset.append(used[at])
        used[at] += s
        room -= s
        free += room
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append(at)
    return where, offset, used


def pack(sizes: np.ndarray, lengths: tuple[int, ...], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and final bin length of each piece (none longer than the longest length).

    Pieces are packed, longest first, once for each set of permitted lengths that
    bins may open with (the longest is always in it), and the cheapest of these
    packings stays. At the end each bin shrinks to the shortest permitted length
    that holds its contents; a sequence costs its length and ``overhead``.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    down = sizes[order].tolist()
    best = None
    for n in range(len(lengths)):
        for some in itertools.combinations(lengths[:-1], n):
            got = pack_into(down, (*some, lengths[-1]), overhead)
            shrunk = sum(lengths[bisect.bisect_left(lengths, u)] + overhead for u in got[2])
            if best is None or shrunk < best[0]:
                best = shrunk, got
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    where[order], offset[order] = best[1][0], best[1][1]
    final = np.array(lengths)[np.searchsorted(lengths, best[1][2])] if len(sizes) else np.zeros(0, np.int64)
    return where, offset, final[where]


def best_fit_packing(df: DataFrame, length: Column, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, rows_per_shard: int = 50_000, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, n_tokens, shard, bin, offset, bin_length``, a row for each piece.

    ``length`` is the tokens of a row, an expression over ``df``. A row longer
    than the longest permitted length is cut into pieces of that length and a
    rest; an empty one is a piece of 0 tokens. Only ids and lengths are shuffled.
    Rows are dealt by a hash of id and length into shards of about
    ``rows_per_shard`` (one bin in thousands stays part empty), each packed in one
    task; ``shard`` and ``bin`` together name a sequence.

    Null lengths count as 0, null ids stay, repeated rows are each packed, an
    empty table gives an empty one, and other columns are ignored.
    """
    longest = max(lengths)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    last = F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("long")
    pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * longest).alias("n_tokens"))
    shards = max(1, -(-df.count() // rows_per_shard))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(shards)).cast("long")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        where, offset, final = pack(table.column("n_tokens").to_numpy(), lengths, overhead)
        for name, x in (("bin", where), ("offset", offset), ("bin_length", final)):
            table = table.append_column(name, pa.array(x, pa.int64()))
        return table

    out = "doc_id long, piece long, start long, n_tokens long, shard long, bin long, offset long, bin_length long"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, out)
