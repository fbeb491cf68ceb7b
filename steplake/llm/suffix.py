"""Removal of passages that an earlier document has: suffix arrays of text shards.

Documents lie in shards of 2 MB, shards in units, units in a table that is stored
once. Which byte strings of 50 bytes also start in a document with a smaller id is
settled in three passes over the units:

1. Every 50-byte string has a minimum among the hashes of its 24-byte parts.
   Equal strings have equal minima, so a value that one document alone has can't
   belong to a shared string. Units tell ranges of values which values they have,
   ranges tell units which are shared.
2. The text of each shard's strings with a shared minimum gets a suffix array
   (Larsson-Sadakane refinement) and common prefixes (Kasai): they number the
   shard's distinct strings and settle all that its own documents share. Of each
   distinct string the first place in the smallest document goes to a task for its
   range of minima. There the sorted lists of all shards are cut at sampled strings
   by binary search, the cuts merged, and equal neighbours, compared byte by byte,
   give each string's smallest document. Neighbouring strings travel as one run of
   text, so a list is put in order where it arrives: to send its order too would
   take as much room as the text.
3. Units take the bits that come back and cut their documents.

Hashes only choose what is compared and where; bytes decide. Units and ranges grow
with the square root of the input, so that what one unit tells one range stays a
list of many values. A value with very many places is dealt string by string, by a
hash of all 50 bytes, over all ranges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, pieces, scratch, stored, texts, written

#: Length of the strings, of their hashed parts, and hashes in a string.
LENGTH, PART = 50, 24
WIDTH = LENGTH - PART + 1
#: Bytes of text that get a suffix array at once (one document may be longer), and least bytes for a range of minima.
SHARD, RANGE = 2 << 20, 1 << 20
#: A unit has the square root of total * SPREAD bytes, MOST_UNIT at most: 4 MB of 1 GB, 256 MB of 4 TB and more.
SPREAD, MOST_UNIT, MOST_RANGE = 1 << 14, 256 << 20, 32 << 20
#: A value with more places than this is dealt string by string.
HOT = 4096
#: Strings merged at once, and bytes of segments put together at once.
PIECE, CHUNK = 1 << 16, 8 << 20
BLOCK = 1 << 15
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
LAST = np.iinfo(np.int64).max


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, big-endian, so that numbers sort as bytes."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), 0, (1,))


def minima(data: np.ndarray) -> np.ndarray:
    """For each place the least hash of the 24-byte parts of the 50 bytes from there,
    mixed once more (one to one): least hashes are small numbers, and ranges of them
    would be of unlike size."""
    n = max(len(data) - LENGTH + 1, 0)
    out = np.empty(n, np.uint64)
    for at in range(0, n, BLOCK):
        w = words8(data[at : at + BLOCK + LENGTH - 1]).astype(np.uint64)
        last = len(w) - PART + 8
        h = w[:last] * M1
        for k in range(8, PART, 8):
            h ^= h >> np.uint64(32)
            h = (h + w[k : last + k]) * M2
        h ^= h >> np.uint64(29)
        h *= M3
        h ^= h >> np.uint64(32)
        span = 1
        while 2 * span <= WIDTH:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        if span < WIDTH:
            h = np.minimum(h[: len(h) - WIDTH + span], h[WIDTH - span :])
        out[at : at + BLOCK] = h
    out *= M2
    out ^= out >> np.uint64(32)
    out *= M3
    return out


class Shard:
    """Runs of one shard: neighbouring strings of a document with one minimum.

    ``base`` is the place of the shard's text in its unit.
    """

    def __init__(self, ids: np.ndarray, size: np.ndarray, data: np.ndarray, base: int):
        self.ids, self.size, self.data, self.base = ids, size, data, base
        ends = np.cumsum(size)
        self.first = ends - size
        m = minima(data)
        change = np.ones(len(m), bool)
        change[1:] = m[1:] != m[:-1]
        inside = np.zeros(len(data) + 1, np.int32)
        long = size >= LENGTH
        np.add.at(inside, self.first[long], 1)
        np.add.at(inside, ends[long] - LENGTH + 1, -1)
        inside = np.cumsum(inside, dtype=np.int32)[: len(m)] > 0  # the string ends within its document
        change[self.first[long]] = True
        start = np.flatnonzero(change & inside)
        bound = np.flatnonzero(change | ~inside) if len(m) else np.zeros(0, np.int64)
        nxt = np.searchsorted(bound, start, "right")
        stop = np.append(bound, len(m))[nxt] if len(start) else start
        self.start, self.count, self.m = start, stop - start, m[start]
        self.doc = ids[np.searchsorted(ends, start, "right")]
        self.values, self.which, self.places = np.unique(self.m, return_inverse=True, return_counts=True)

    def several(self) -> np.ndarray:
        """Of each value whether runs of two documents have it."""
        low = np.full(len(self.values), LAST)
        high = np.full(len(self.values), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.doc)
        np.maximum.at(high, self.which, self.doc)
        return low < high

    def settle(self, shared: np.ndarray, hot: np.ndarray, buckets: int) -> "Settled":
        """Suffix array and common prefixes over the text of all strings with a value
        that is ``shared`` (by value, with other shards) or that two documents here have."""
        on = shared | self.several()
        at = np.flatnonzero(on[self.which])
        starts = ranges(self.start[at], self.count[at])
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.start[at], 1)
        np.add.at(edge, self.start[at] + self.count[at] + LENGTH - 1, -1)
        back = np.flatnonzero(np.cumsum(edge, dtype=np.int32) > 0)  # places of the text that is sorted
        text = self.data[back]
        begin = np.searchsorted(back, starts)
        of = np.empty(len(text), np.int32)  # run of each start
        of[begin] = np.repeat(at, self.count[at])
        sa = suffix_array(text, begin)
        new = common_prefixes(text, sa) < LENGTH
        new[:1] = True
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        place, run = back[sa], of[sa]
        doc = self.doc[run]
        own = np.minimum.reduceat(doc, head) if len(head) else doc[:0]
        mine = doc == own[group]
        rep = np.minimum.reduceat(np.where(mine, place, LAST), head) if len(head) else place[:0]
        told = shared[self.which[run[head]]]
        boiling = hot[self.which[run[head]]]
        number = np.full(len(head), -1, np.int64)  # of each string among those told
        rank = np.flatnonzero(told)
        p, m, loose = rep[rank], self.m[run[head][rank]], boiling[rank]
        if loose.any():
            m = m.copy()
            m[loose] = whole_hashes(self.data, p[loose])
        bucket = ranges_of(m, buckets)
        key = (2 * bucket + loose).astype(np.uint16 if buckets < 1 << 15 else np.int64)  # short keys sort by radix
        o = np.argsort(p)
        o = o[np.argsort(key[o], kind="stable")]
        number[rank[o]] = np.arange(len(o))
        p, loose, bucket = p[o], loose[o], bucket[o]
        cutoff = np.ones(len(p), bool)
        cutoff[1:] = (np.diff(p) != 1) | (bucket[1:] != bucket[:-1]) | loose[1:] | loose[:-1]
        first = np.flatnonzero(cutoff)
        echo = mine & (place != rep[group]) & told[group]
        return Settled(
            gone=place[~mine] + self.base,
            bucket=bucket[first],
            start=p[first] + self.base,
            count=np.diff(np.append(first, len(p))),
            doc=own[rank[o]][first],
            strings=len(o),
            echo=place[echo] + self.base,
            echo_of=number[group[echo]],
        )


class Settled:
    """What a shard's suffix array tells: places that an own smaller document has too
    (``gone``), the runs of distinct strings to ask about, the number of these strings,
    and further places of such strings in the document that asks (``echo``)."""

    def __init__(self, **parts: np.ndarray | int):
        self.__dict__.update(parts)


def whole_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the 50 bytes from each place."""
    w = words8(data)
    h = np.zeros(len(at), np.uint64)
    for k in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        h = (h ^ w[at + k].astype(np.uint64)) * M1
        h ^= h >> np.uint64(32)
    h *= M2
    return h ^ (h >> np.uint64(29))


def shards_in(ids: bytes, sizes: bytes, data: bytes, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """The shards of a unit: ids, sizes and text of neighbouring documents, and their place."""
    i, n, d = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(data, np.uint8)
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        base = int(ends[a] - n[a])
        b = max(a + 1, int(np.searchsorted(ends, base + shard, "right")))
        yield i[a:b], n[a:b], d[base : int(ends[b - 1])], base
        a = b


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], ..., start[0] + n[0] - 1, start[1], ..."""
    if not len(n) or not n.sum():
        return np.zeros(0, np.int64)
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def ranges_of(m: np.ndarray, buckets: int) -> np.ndarray:
    return (((m >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def cuts(m: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each bucket's part of a sorted array."""
    b = ranges_of(m, buckets)
    if not len(b):
        return
    edge = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), len(b)).tolist()
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        yield int(b[i]), i, j


def suffix_array(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those starts in the order of the 50 bytes from each, by Larsson-Sadakane refinement.

    Ranks by 8 bytes double to 16 and 32; 32 bytes from 18 on complete 50. Only
    groups that are still tied are sorted again.
    """
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    w = words8(padded)[: len(data)].astype(np.uint64)
    order = np.argsort(w)
    rank = np.empty(len(data) + LENGTH, np.int64)
    rank[len(data) :] = -1

    def settle(order: np.ndarray, new: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Ranks are the first place of a group; returns the places of tied groups."""
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[order] = base[first]
        tied = ~new
        tied[:-1] |= ~new[1:]
        return np.flatnonzero(tied)

    new = np.ones(len(order), bool)
    new[1:] = w[order[1:]] != w[order[:-1]]
    tied = settle(order, new, np.arange(len(order)))
    for step in (8, 16, 18):
        if not len(tied):
            break
        at = order[tied]
        both = (rank[at] << 32) | (rank[at + step] + 1)
        o = np.argsort(both)
        order[tied] = at[o]
        both = both[o]
        new = np.ones(len(tied), bool)
        new[1:] = both[1:] != both[:-1]
        if step < 18:
            tied = tied[settle(at[o], new, tied)]
    want = np.zeros(len(data), bool)
    want[starts] = True
    return order[want[order]]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common prefix (at most 64) of each suffix with the one before it in the array.

    Kasai's rule in arrays: going through the text, the next suffix shares one
    byte less with its neighbour as long as that neighbour moves along too. So
    only where it doesn't are bytes compared; the rest counts down from there.
    """
    padded = np.concatenate([data, np.zeros(80, np.uint8)])
    w = words8(padded)

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(0, 64, 8):
            x = w[a[live] + k].astype(np.uint64) ^ w[b[live] + k].astype(np.uint64)
            same = x == 0
            top = x[~same] & ~(x[~same] >> np.uint64(1))  # the highest bit stays, and none beside it
            n[live[~same]] += (64 - np.frexp(top.astype(np.float64))[1].astype(np.int64)) // 8
            live = live[same]
            n[live] += 8
        return n

    if len(sa) < 2:
        return np.zeros(len(sa), np.int64)
    phi = np.full(len(data) + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.sort(sa[1:])
    prior = phi[at - 1]
    follows = (at > 0) & (prior >= 0) & (phi[at] == prior + 1)
    base = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    value = np.zeros(len(at), np.int64)
    fresh = ~follows
    value[fresh] = compare(at[fresh], phi[at[fresh]])
    again = follows & (value[base] >= 64)
    value[again] = compare(at[again], phi[at[again]])
    down = follows & ~again
    value[down] = value[base[down]] - (at[down] - at[base[down]])
    plcp = np.zeros(len(data), np.int64)
    plcp[at] = value
    return plcp[sa] * (np.arange(len(sa)) > 0)


def strings_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 50 bytes from each place."""
    if not len(at):
        return np.zeros(0, f"S{LENGTH}")
    return np.ndarray((len(data) - LENGTH + 1,), f"S{LENGTH}", np.ascontiguousarray(data), 0, (1,))[at]


def held_elsewhere(lists: list[np.ndarray], docs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each string of some sorted lists whether a smaller document has it in another list.

    Lists are cut at sampled strings by binary search; the cuts, sorted already, are
    merged by a stable sort, and neighbours that are equal in all bytes share
    their smallest document.
    """
    out = [np.zeros(len(x), bool) for x in lists]
    total = sum(map(len, lists))
    step = max(1, PIECE // 64)
    sample = np.sort(np.concatenate([x[::step] for x in lists])) if lists else np.zeros(0, f"S{LENGTH}")
    parts = max(1, total // PIECE)
    marks = np.unique(sample[[len(sample) * k // parts for k in range(1, parts)]]) if parts > 1 else sample[:0]
    edges = [np.concatenate([[0], np.searchsorted(x, marks), [len(x)]]).astype(np.int64) for x in lists]
    for k in range(len(marks) + 1):
        some = [i for i, e in enumerate(edges) if e[k] < e[k + 1]]
        if len(some) < 2:
            continue
        c = np.concatenate([lists[i][edges[i][k] : edges[i][k + 1]] for i in some])
        d = np.concatenate([docs[i][edges[i][k] : edges[i][k + 1]] for i in some])
        order = np.argsort(c, kind="stable")
        c, d = c[order], d[order]
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        least = np.minimum.reduceat(d, np.flatnonzero(new))[np.cumsum(new) - 1]
        less = np.empty(len(c), bool)
        less[order] = d > least
        for i, x in zip(some, np.split(less, np.cumsum([edges[i][k + 1] - edges[i][k] for i in some])[:-1]), strict=True):
            out[i][edges[i][k] : edges[i][k + 1]] = x
    return out


# The passes.


def units_of(df: DataFrame, unit: int) -> DataFrame:
    """Documents in units of about so many bytes, stored once in the shared folder,
    bucketed by unit, so that later passes join small replies without moving texts."""
    spark = df.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], np.int64)
            return record(UNIT, number, np.array(ids, np.int64).tobytes(), sizes.tobytes(), b"".join(parts))

        for b in pieces(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                p = t.encode("utf-8", "surrogatepass")
                if parts and size + len(p) > unit:
                    yield row()
                    number, ids, parts, size = number + 1, [], [], 0
                ids.append(LAST if i is None else i)
                parts.append(p)
                size += len(p)
        if parts:
            yield row()

    n = min(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000)
    return stored(df.mapInArrow(run, UNIT), "text_units", n, "unit")


UNIT = "unit long, ids binary, sizes binary, data binary"
#: What a unit tells a range: the low halves of its values and how often it has each (8 * log2).
VALUES = "bucket long, unit long, low binary, often binary"
REPLY = "bucket long, unit long, bits binary"
#: Segments to compare (with a bucket), and what a unit needs later (without).
SETTLED = "bucket long, unit long, lists binary, n binary, d binary, data binary, gone binary, start binary, count binary, echo binary, echo_of binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def per_unit(units: DataFrame, replies: list[DataFrame], run, schema: str) -> DataFrame:
    """Run over each unit with its replies: bits of all buckets in order."""
    joined, n = units, len(replies)
    for k, r in enumerate(replies):
        one = r.groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias(f"r{k}")).withColumnRenamed("unit", f"u{k}")
        joined = joined.join(one.hint("shuffle_hash"), F.col("unit") == F.col(f"u{k}"), "left").drop(f"u{k}")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names if c[0] != "r"}
                got = [b"".join(x["bits"] for x in (b.column(f"r{k}")[i].as_py() or [])) for k in range(n)]
                yield from run(row, *got)

    return joined.mapInArrow(each, schema)


def record(schema: str, *cells) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c if isinstance(c, (list, np.ndarray)) else [c], kinds[k]) for c, (_, k) in zip(cells, fields, strict=True)], [n for n, _ in fields])


def unit_values(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a unit, how many places have each, and whether two shards do."""
    every = np.concatenate([*(s.values for s in shards), np.zeros(0, np.uint64)])
    values, which = np.unique(every, return_inverse=True)
    places = np.bincount(which, np.concatenate([*(s.places for s in shards), np.zeros(0)]), len(values))
    return values, places, np.bincount(which, minlength=len(values)) > 1


def shared_values(table: pa.Table, most: int) -> pa.Table:
    """Bit 1 of each value of each unit: other units have it; bit 2: very many places have it."""
    low = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
    often = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("often").to_pylist()])
    _, which, units = np.unique(np.concatenate(low), return_inverse=True, return_counts=True)
    weight = np.bincount(which, np.exp2(often / 8))
    codes = ((units > 1) | np.where(weight > most, 2, 0)).astype(np.uint8)[which]
    bits = [x.tobytes() for x in np.split(codes, np.cumsum([len(x) for x in low])[:-1])]
    return pa.table({"bucket": table.column("bucket"), "unit": table.column("unit"), "bits": pa.array(bits, pa.binary())})


def compared(table: pa.Table) -> pa.Table:
    """Of each string of each unit whether a smaller document of another shard has it."""
    lists, docs, places = [], [], []
    columns = ("lists", "n", "d", "data")
    for sizes, n, d, data in zip(*(table.column(c).to_pylist() for c in columns), strict=True):
        sizes, n, d = (np.frombuffer(x, k) for x, k in ((sizes, np.int64), (n, np.int32), (d, np.int64)))
        n = n.astype(np.int64)
        width = n + LENGTH - 1
        data = np.frombuffer(pa.decompress(data, int(width.sum()), "zstd", asbytes=True), np.uint8)
        starts, doc = ranges(np.cumsum(width) - width, n), np.repeat(d, n)
        at = 0
        for size in sizes.tolist():  # a list for each shard
            own = strings_at(data, starts[at : at + size])
            order = np.argsort(own)
            lists.append(own[order])
            docs.append(doc[at + order])
            places.append(order)
            at += size
    less = held_elsewhere(lists, docs)
    bits, k = [], 0
    for sizes in table.column("lists").to_pylist():
        part = []
        for _ in range(len(sizes) // 8):
            x = np.empty(len(less[k]), np.uint8)
            x[places[k]] = less[k]
            part.append(x)
            k += 1
        bits.append(np.concatenate(part).tobytes())
    return pa.table({"bucket": table.column("bucket"), "unit": table.column("unit"), "bits": pa.array(bits, pa.binary())})


def passages(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unit = min(max(SHARD, math.isqrt(total * SPREAD)), MOST_UNIT)
    buckets = max(1, -(-total // min(max(RANGE, unit // 4), MOST_RANGE)))
    units = units_of(docs, unit)
    shard, hot_from = SHARD, HOT

    def shards(row: dict) -> list[Shard]:
        return [Shard(*x) for x in shards_in(row["ids"], row["sizes"], row["data"], shard)]

    def tell(row: dict) -> Iterator[pa.RecordBatch]:
        values, places, _ = unit_values(shards(row))
        low, often = values.astype(np.uint32), np.minimum(np.round(8 * np.log2(np.maximum(places, 1))), 255).astype(np.uint8)
        parts = [(b, low[i:j].tobytes(), often[i:j].tobytes()) for b, i, j in cuts(values, buckets)]
        if parts:
            yield record(VALUES, [p[0] for p in parts], [row["unit"]] * len(parts), [p[1] for p in parts], [p[2] for p in parts])

    told = written(per_unit(units, [], tell, VALUES).groupBy("bucket").applyInArrow(lambda t: shared_values(t, hot_from), REPLY), "suffix-told")

    def settle(row: dict, bits: bytes) -> Iterator[pa.RecordBatch]:
        own = shards(row)
        values, _, across = unit_values(own)
        code = np.frombuffer(bits, np.uint8)
        shared, hot = (code & 1 > 0) | across, code & 2 > 0
        done = []
        for k, s in enumerate(own):
            at = np.searchsorted(values, s.values)
            done.append(s.settle(shared[at], hot[at], buckets))
            own[k] = None  # a unit may have many shards
        yield from settled_rows(row["unit"], np.frombuffer(row["data"], np.uint8), done)

    settled = written(per_unit(units, [told], settle, SETTLED), "suffix-settled")
    asked = settled.filter("bucket is not null").select("bucket", "unit", "lists", "n", "d", "data")
    answers = asked.groupBy("bucket").applyInArrow(compared, REPLY)
    kept = settled.filter("bucket is null").select(F.col("unit").alias("of"), "gone", "start", "count", "echo", "echo_of")
    return per_unit(units.join(kept.hint("shuffle_hash"), F.col("unit") == F.col("of"), "left").drop("of"), [answers], finish, OUT)


def settled_rows(unit: int, data: np.ndarray, done: list[Settled]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that a unit asks, and one for the unit itself."""
    base = np.cumsum([0, *(x.strings for x in done)])
    joined = lambda name: np.concatenate([*(getattr(x, name) for x in done), np.zeros(0, np.int64)]).astype(np.int64)
    bucket, start, count, doc = joined("bucket"), joined("start"), joined("count"), joined("doc")
    shard = np.repeat(np.arange(len(done)), [len(x.bucket) for x in done])
    o = np.lexsort((shard, bucket))  # stable: runs of a shard keep their order
    was = np.cumsum(count) - count  # of each run the number of its first string, as the shards count them
    bucket, shard, start, count, doc, was = (x[o] for x in (bucket, shard, start, count, doc, was))
    now = np.empty(base[-1], np.int64)  # of each string its number among the unit's answers
    now[ranges(was, count)] = np.arange(base[-1])
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    rows: list[tuple] = []
    size = 0
    none = [None] * 4
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        lists = np.bincount(shard[i:j] - shard[i], count[i:j]).astype(np.int64)
        text = data[ranges(start[i:j], count[i:j] + LENGTH - 1)].tobytes()
        rows.append((int(bucket[i]), unit, lists[lists > 0].tobytes(), count[i:j].astype(np.int32).tobytes(), doc[i:j].tobytes(), pa.compress(text, "zstd", asbytes=True), *[None] * 5))
        size += len(text)
        if size > CHUNK:
            yield record(SETTLED, *map(list, zip(*rows, strict=True)))
            rows, size = [], 0
    gone = np.zeros(len(data), bool)
    gone[joined("gone")] = True
    echo_of = np.concatenate([*(x.echo_of + b for x, b in zip(done, base.tolist(), strict=False)), np.zeros(0, np.int64)]).astype(np.int64)
    rows.append((None, unit, *none, np.packbits(gone).tobytes(), start.tobytes(), count.tobytes(), joined("echo").tobytes(), now[echo_of].tobytes()))
    yield record(SETTLED, *map(list, zip(*rows, strict=True)))


def finish(row: dict, bits: bytes) -> Iterator[pa.RecordBatch]:
    """The documents of a unit without the bytes that any removed string covers."""
    data = np.frombuffer(row["data"], np.uint8)
    gone = np.unpackbits(np.frombuffer(row["gone"], np.uint8), count=len(data)).astype(bool)
    start, count, echo, echo_of = (np.frombuffer(row[c], np.int64) for c in ("start", "count", "echo", "echo_of"))
    less = np.frombuffer(bits, np.uint8) > 0
    gone[ranges(start, count)[less]] = True
    gone[echo[less[echo_of]]] = True
    hit = np.flatnonzero(gone)
    cover = np.zeros(len(data) + LENGTH + 1, np.int32)
    cover[hit] += 1
    cover[hit + LENGTH] -= 1
    covered = np.cumsum(cover, dtype=np.int32)[: len(data)] > 0
    size = np.frombuffer(row["sizes"], np.int64)
    rows = []
    for i, a, n in zip(np.frombuffer(row["ids"], np.int64).tolist(), (np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
        c = covered[a : a + n]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
        spans = ",".join(f"{x}:{y}" for x, y in edge.reshape(-1, 2).tolist())
        rows.append((None if i == LAST else i, n, int(c.sum()), len(edge) // 2, hashlib.sha256(data[a : a + n][~c]).hexdigest(), spans))
    yield record(OUT, *(list(c) for c in zip(*rows, strict=True)))


def removed_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row.

    ``spans`` lists the removed byte ranges, ``begin:end`` comma-joined, from
    which the kept bytes follow.

    A null text counts as empty; texts under 50 bytes lose nothing. A null id
    counts as larger than any other. Rows that repeat an id never remove each
    other's bytes; each returns a row. An empty table gives an empty one; other
    columns are ignored; a document of any length is one piece of a shard. A very
    common passage costs each shard one entry, not one for each document. Stored
    units and replies are deleted before this returns.
    """
    with scratch(df.sparkSession):
        return lasting(passages(texts(df, id_col, text_col)))
