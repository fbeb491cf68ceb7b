"""SimHash near-duplicates, with pigeonring filtering of candidates."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, gathered, lasting, pieces, scratch, texts, written

SEED = 42
SEGMENTS = 4
#: Segments of a chain that the ring test looks at.
CHAIN = 2
#: Differing bits up to which fingerprints link; the segments above rely on it.
BITS = 3
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Groups up to this size are compared pair by pair at once, larger ones by a search.
SMALL = 24
#: Key groups of more fingerprints are dealt anew by finer keys; the finest leave 12 bits free, so at most 4096.
MOST = 4096
#: Keys of large groups up to this many (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1 << 17
ALL = (1 << 64) - 1
#: Differing bits up to which fingerprints of similar texts are compared further: at a
#: similarity of 0.8 they differ in 10 on average (12 where sets have 4 and 5 shingles,
#: with a deviation of 3); over 28 is five deviations away.
WIDE_BITS = 28
WIDE_SEGMENTS = 8
#: A similar pair is missed if none of BANDS keys of ROWS_OF_BAND least hashes is equal:
#: (1 - 0.8 ** 4) ** 20, at most one pair in 37,000.
BANDS = 20
ROWS_OF_BAND = 4
#: Slots of the sketch; its estimate of a similarity of 0.8 has a deviation of 0.025.
#: Candidates are dropped only at MARGIN (five deviations) below the similarity.
SLOTS = 256
MARGIN = 0.125
#: Hashes in a cell of a group (8 bytes each).
MOST_HASHES = 1 << 21
#: Rows that fill a partition of some MB: nodes with bands and sketch, and sets of hashes with the texts they come from.
NODE_ROWS, SET_ROWS = 1 << 14, 1 << 8


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_of(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[shingle - 1 :]
    return np.array([hash_of(line[a:b], SEED) for a, b in zip(start.tolist(), stop.tolist(), strict=False)], np.uint64)


def fingerprint(text: str, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    return simhash_of(shingle_hashes(text, shingle))


def simhash_of(hs: np.ndarray) -> int:
    if not len(hs):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hs), 65536):
        ones += np.unpackbits(hs[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hs)).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (long) of each row: lower-cased A-Z, words, ``shingle``-word shingles, XXH64."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "fp"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def within_ring(x: np.ndarray, bits: int = BITS, segments: int = SEGMENTS) -> np.ndarray:
    """The pigeonring test on differences x = a ^ b, before the full count.

    If at most ``bits`` bits differ, some segment starts a chain round the ring
    whose first l segments differ in at most bits * l / segments, for every l.
    Only chains of up to CHAIN segments are asked for: longer ones cost more than
    the full count that follows.
    """
    chain = min(CHAIN, segments)
    d = np.bitwise_count(x[..., None].view(f"u{8 // segments}").reshape(*x.shape, segments)).astype(np.int16)
    budget = bits * np.arange(1, chain + 1) // segments
    ok = np.zeros(x.shape, bool)
    for i in range(segments):
        run = d[..., i]
        good = run <= budget[0]
        for k in range(1, chain):
            run = run + d[..., (i + k) % segments]
            good &= run <= budget[k]
        ok |= good
    return ok


def linked(x: np.ndarray, bits: int = BITS, segments: int = SEGMENTS) -> np.ndarray:
    """Whether differences are of at most ``bits`` bits; the ring test prunes first."""
    near = within_ring(x, bits, segments)
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def near_bits(fp: np.ndarray) -> Near:
    return lambda i, j: linked(fp[i] ^ fp[j])


def near_similar(fp: np.ndarray, sketch: np.ndarray, similarity: float, sets: np.ndarray | None = None) -> Near:
    """Ring test and full count within WIDE_BITS, then the similarity that the sketches tell, less MARGIN.

    With ``sets`` (bytes of sorted distinct shingle hashes), pairs that pass are
    decided by their exact Jaccard similarity.
    """

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = np.broadcast_arrays(i, j)
        ok = linked(fp[i] ^ fp[j], WIDE_BITS, WIDE_SEGMENTS)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            x, y = sketch[i[part]], sketch[j[part]]
            ok[part] = ((x == y) & (x > 0)).sum(1) >= (similarity - MARGIN) * ((x | y) > 0).sum(1)
        if sets is not None:
            for k in np.flatnonzero(ok).tolist():
                ok[k] = jaccard_reaches(sets[i[k]], sets[j[k]], similarity)
        return ok

    return near


def jaccard_reaches(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets, bytes of sorted distinct hashes, have this Jaccard similarity or more."""
    least, most = sorted((len(x), len(y)))
    if least < similarity * most - 1e-6:
        return False
    both = np.frombuffer(x + y, np.uint64).copy()
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def group_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, near: Near | None = None, comp: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect all near fingerprints within each run of equal keys.

    Small groups give each near pair; a large one gives a spanning forest: every
    member is compared once with those not yet reached, so n members give fewer
    than n links however many pairs are near. Members of one ``comp`` are connected
    already and aren't compared in large groups.
    """
    near = near or near_bits(fp)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    a, b = [], []
    small = np.repeat(size <= SMALL, size)
    for d in range(1, SMALL):
        at = np.flatnonzero(small[:-d] & (key[d:] == key[:-d])) if len(key) > d else []
        if not len(at):
            break
        at = at[near(at, at + d)]
        a.append(rep[at])
        b.append(rep[at + d])
    for e, n in zip(edge[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        left, ends = np.arange(e, e + n), []
        while len(left) or ends:
            if not ends:
                ends.append(left[0])
                left = left[1:]
                if comp is not None:
                    mates = comp[left] == comp[ends[0]]
                    ends += left[mates].tolist()
                    left = left[~mates]
            at = ends.pop()
            close = near(left, at)
            met = left[close]
            if len(met):
                a.append(np.full(len(met), rep[at]))
                b.append(rep[met])
                if comp is not None:
                    close |= np.isin(comp[left], comp[met])
                ends += left[close].tolist()
                left = left[~close]
    return a, b


def whole_groups(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Arrays, sorted by the first one (the key), cut anew so that no group is divided."""
    held: list[np.ndarray] = []
    for new in parts:
        held = [np.concatenate(p) for p in zip(held, new, strict=True)] if held else new
        key = held[0]
        if len(key) and key[0] != key[-1]:
            cutoff = int(np.searchsorted(key, key[-1]))  # keys ascend
            yield [x[:cutoff] for x in held]
            held = [x[cutoff:] for x in held]
    if held:
        yield held


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``group_links`` over rows sorted by key; a group may span batches."""
    parts = ([x.column("key").to_numpy(), x.column("fp").to_numpy().view(np.uint64), x.column("rep").to_numpy()] for x in batches)
    for key, fp, rep in whole_groups(parts):
        a, b = group_links(key, fp, rep)
        if a and sum(map(len, a)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], ["a", "b"])


def first_masks() -> list[int]:
    """The bits of the 8 keys: a segment of 16 bits and one half of the next one."""
    byte = lambda k: 0xFF << (56 - 8 * (k % 8))
    return [byte(2 * i) | byte(2 * i + 1) | byte(2 * i + half) for i in range(SEGMENTS) for half in (2, 3)]


def finer(mask: int, unit: int) -> list[int]:
    """Masks that also fix all free units of so many bits but 3: near fingerprints differ in no more units."""
    free = [u for u in range(0, 64, unit) if not mask >> u & 1]
    return [ALL ^ sum(((1 << unit) - 1) << u for u in three) for three in itertools.combinations(free, BITS)]


def signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(rows: DataFrame, masks: F.Column) -> DataFrame:
    """``key, mask, fp, rep``: a row's keys are hashes of its bits under each mask."""
    each = rows.select("fp", "rep", F.explode(masks).alias("mask"))
    return each.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp", "rep")


def near_links(nodes: DataFrame) -> DataFrame:
    """``a, b``: links that connect all near fingerprints of ``fp, rep`` (distinct fp).

    Near fingerprints share a key of 24 bits. A key that more than MOST share is
    replaced by finer ones: of the 5 bytes that it leaves free at most 3 differ,
    so 2 more are fixed, in each of 10 ways; then, of 6 half bytes, 3 more, in
    each of 20. No task gets a larger group, and no near pair is lost. Only rows
    of large groups are dealt anew.
    """
    spark = nodes.sparkSession
    masks = first_masks()
    most = len(masks) * nodes.count()
    rows = keyed(nodes, F.array(*(F.lit(m) for m in signed(masks))))
    out = []
    for unit in (8, 4):
        large = cut(gathered(rows.groupBy("key").count().filter(F.col("count") > MOST).select("key"), most))
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= MOST_BROADCAST else large
        out.append(rows.join(large, "key", "left_anti"))
        steps = [(m, finer(m, unit)) for m in masks]
        table = spark.createDataFrame([(signed([m])[0], signed(f)) for m, f in steps], "mask long, finer array<bigint>")  # at most 56 rows
        rows = rows.join(large, "key", "left_semi").join(F.broadcast(table), "mask")
        rows = keyed(rows, F.col("finer")).distinct()
        masks = sorted({f for _, fs in steps for f in fs})
    found = None
    for part in (*out, rows):
        linked_rows = part.select("key", "fp", "rep").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(links, "a long, b long")
        found = linked_rows if found is None else found.unionByName(linked_rows)
    return found


def near_duplicates(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of each row: fingerprints within 3 bits link.

    Rows of equal fingerprint are one node, its smallest id. The ring theorem
    gives near fingerprints a segment of 16 bits without a difference whose next
    segment has at most one, so one of that segment's halves has none: each
    fingerprint has 8 keys of 24 bits, and near ones share a key (``near_links``
    splits large groups). Rows are dealt by key and sorted; each key's group gives
    a forest of links (``group_links``), which the star contraction joins to
    components. Fingerprints and links stay distributed.

    A null or empty text has fingerprint 0, which links like any other; a null id
    stays and its component is the smallest id reachable (null if none); repeated
    rows each return; an empty table gives an empty one; other columns are
    ignored; texts are hashed whole.
    """
    with scratch(df.sparkSession):
        fps = cut(fingerprints(df, shingle, id_col, text_col))
        n = fps.count()
        nodes = cut(gathered(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), n))
        found = components(near_links(nodes.filter("rep is not null")), rows=len(first_masks()) * n)
        groups = nodes.join(found, nodes["rep"] == found["node"], "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
        return lasting(gathered(fps.join(groups, fps["fp"] == groups["_fp"]).select("doc_id", "fp", "component_id"), n))


def profile(text: str, shingle: int) -> tuple[int, int, list[int], bytes]:
    """The SimHash of a text's set of shingles, a hash of the set, its band keys and its sketch.

    A band key is a hash of ROWS_OF_BAND least values of the shingles' hashes under
    as many multiplications; a slot of the sketch is one byte (1 to 255; 0: none) of
    the least hash among those that fall in it. No words: no band keys.
    """
    u = np.unique(shingle_hashes(text, shingle))
    sketch = np.zeros(SLOTS, np.uint8)
    slot, first = np.unique(u % np.uint64(SLOTS), return_index=True)  # u ascends, so the first is the least
    sketch[slot.astype(np.int64)] = (u[first] // np.uint64(SLOTS)) % np.uint64(255) + np.uint64(1)
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS_OF_BAND, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(len(factors), ALL, np.uint64)
    for i in range(0, len(u), 4096):
        v = u[i : i + 4096]
        np.minimum(least, (factors * (v ^ (v >> np.uint64(32)))).min(1), out=least)
    rows = least.reshape(BANDS, ROWS_OF_BAND)
    bands = [xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)] if len(u) else []
    return simhash_of(u), xxhash.xxh64_intdigest(u.tobytes(), SEED), bands, sketch.tobytes()


def profiles(df: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = [profile(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(signed([r[1] for r in rows]), pa.int64()),
                    pa.array([signed(r[2]) for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                ["doc_id", "fp", "same", "bands", "sketch"],
            )

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, fp long, same long, bands array<long>, sketch binary")


def similar_cells(similarity: float, exact: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``a, b``: links that connect the similar members of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[list[np.ndarray]]:
            for x in batches:
                sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint8).reshape(-1, SLOTS)
                sets = np.empty(len(sketch), object)
                if exact:
                    sets[:] = x.column("hashes").to_pylist()
                yield [*(x.column(c).to_numpy() for c in ("cell", "comp", "rep")), x.column("fp").to_numpy().view(np.uint64), sketch, sets]

        for cell, comp, rep, fp, sketch, sets in whole_groups(parts()):
            a, b = group_links(cell, fp, rep, near_similar(fp, sketch, similarity, sets if exact else None), comp)
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (a, b)], ["a", "b"])

    return run


def group_similar(members: DataFrame, data: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """``a, b``: links that connect all similar members of each group of ``key, rep, n``.

    ``data`` has ``rep, fp, sketch`` and, if ``exact``, ``hashes``. A group of over
    MOST members, or MOST_HASHES hashes (``n``), is dealt over cells. Members and
    then one of each component are linked within cells; what that leaves in several
    components is cut into blocks, and each two blocks meet in a cell, so every two
    members not yet connected are compared and no task holds a large group. Links of
    earlier steps come back as those of their components.
    """
    most = BANDS * data.count()

    def cells_of(rows: DataFrame) -> DataFrame:
        size = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("w")).filter("m > 1")
        return size.select("key", F.greatest(F.ceil(F.col("m") / MOST), F.ceil(F.col("w") / MOST_HASHES), F.lit(1)).alias("cells"))

    def compare(rows: DataFrame) -> DataFrame:
        full = rows.select("cell", "comp", "rep").join(data, "rep")
        return full.repartition("cell").sortWithinPartitions("cell", "fp", "rep").mapInArrow(similar_cells(similarity, exact), "a long, b long")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.join(cells_of(rows), "key").withColumn("cell", F.xxhash64("key", F.pmod(F.xxhash64("rep", "key"), "cells")))

    def labelled(rows: DataFrame, part: DataFrame) -> DataFrame:
        """Rows with their components, of those groups that have more than one."""
        now = rows.join(part, rows["rep"] == part["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        now = cut(gathered(now, most))
        return now.join(now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key"), "key")

    found = compare(dealt(members).withColumn("comp", F.col("rep")))
    large = cut(gathered(members.join(cells_of(members).filter("cells > 1").select("key"), "key").select("key", "rep", "n").distinct(), most))
    if large.isEmpty():
        return found
    part = components(found, rows=most)
    parts = labelled(large, part)
    roots = parts.groupBy("key", "comp").agg(F.min(F.struct("rep", "n")).alias("r")).select("key", "r.rep", "r.n", "comp")
    part = components(part.toDF("a", "b").unionByName(compare(dealt(roots))), rows=most)
    parts = labelled(large, part)
    blocks = parts.join(cells_of(parts).withColumn("cells", 2 * F.col("cells")), "key").withColumn("i", F.pmod(F.xxhash64("rep", "key"), "cells"))
    met = blocks.withColumn("j", F.explode(F.expr("sequence(0L, cells - 1)"))).filter("i != j")
    return part.toDF("a", "b").unionByName(compare(met.withColumn("cell", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")))))


def distinct_hashes(df: DataFrame, wanted: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``rep, hashes, n``: sorted distinct shingle hashes of the texts that ``rep, same`` name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            same = pa.array(signed([xxhash.xxh64_intdigest(u.tobytes(), SEED) for u in sets]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("same"), same, pa.array([u.tobytes() for u in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64())], ["rep", "same", "own", "hashes", "n"])

    t = texts(df, id_col, text_col)
    rows = t.join(wanted, t["doc_id"] == wanted["rep"]).select("rep", "same", "text")
    return rows.mapInArrow(run, "rep long, same long, own long, hashes binary, n long").filter("same = own").drop("own").dropDuplicates(["rep", "same"])


def similar_documents(df: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: texts link whose sets of word shingles have this Jaccard similarity or more.

    Fingerprints of such texts differ in about 10 of 64 bits, too many for any key
    of their bits. Min-wise band keys give the candidates; the ring test, the full
    count within WIDE_BITS and a sketch with MARGIN prune them. The components of
    what remains are few and mostly small; within them the exact similarity of the
    sets decides. Texts of equal sets are one node. Rows of nulls and awkward texts
    are treated as in ``near_duplicates``; texts without words are equal to each
    other.
    """
    with scratch(df.sparkSession):
        return lasting(similar_components(df, shingle, similarity, id_col, text_col))


def similar_components(df: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    found = written(profiles(df, shingle, id_col, text_col), "profiles")
    nodes = found.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    n = found.count()
    nodes = written(gathered(nodes, n, NODE_ROWS), "nodes")
    named = nodes.filter("rep is not null")
    bands = named.select("rep", F.posexplode("bands").alias("at", "band")).select(F.xxhash64("at", "band").alias("key"), "rep", F.lit(0).cast("long").alias("n"))
    maybe = components(group_similar(bands, named.select("rep", "fp", "sketch"), similarity, False), rows=BANDS * n).withColumnRenamed("node", "rep")
    few = cut(gathered(named.join(maybe, "rep").select("rep", "same", "fp", "sketch", "component"), n, NODE_ROWS))
    sets = distinct_hashes(df, few.select("rep", "same"), shingle, id_col, text_col)
    data = written(gathered(sets.join(few, ["rep", "same"]), few.count(), SET_ROWS), "sets")
    members = data.select(F.col("component").alias("key"), "rep", "n")
    parts = components(group_similar(members, data.select("rep", "fp", "sketch", "hashes"), similarity, True), rows=n)
    groups = nodes.join(parts, nodes["rep"] == parts["node"], "left").select(F.col("same").alias("_same"), F.coalesce("component", "rep").alias("component_id"))
    return gathered(found.join(groups, found["same"] == groups["_same"]).select("doc_id", "fp", "component_id"), n)


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The documents, with all their columns, but one of each component: its smallest id.

    Components are those of ``near_duplicates``, or with a ``similarity`` those of
    ``similar_documents``. Rows with a null id stay; of rows that repeat an id one
    stays, the one whose text sorts first.
    """
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, shingle, id_col, text_col) if similarity is None else similar_documents(docs, shingle, similarity, id_col, text_col)
        n = found.count()
        spare = lasting(gathered(found.filter("doc_id != component_id").select(F.col("doc_id").alias("_spare")).distinct(), n))
    kept = docs.join(spare, docs[id_col].cast("long") == spare["_spare"], "left_anti")
    return one_of_each(kept, id_col, text_col, n)


def one_of_each(docs: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """One row for each id, nulls aside; only ids that repeat are shuffled with their texts. ``rows``: at most."""
    again = docs.groupBy(docs[id_col].alias("_id")).count().filter("count > 1 and _id is not null").select("_id")
    again = cut(gathered(again, rows))
    if again.isEmpty():
        return docs
    rest = docs.join(again, docs[id_col] == again["_id"], "left_anti")
    first = docs.join(again, docs[id_col] == again["_id"], "left_semi").groupBy(docs[id_col].alias("_id")).agg(F.min_by(F.struct(*(docs[c] for c in docs.columns)), F.coalesce(docs[text_col], F.lit(""))).alias("r"))
    return rest.unionByName(first.select("r.*"))
