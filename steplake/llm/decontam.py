"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, gathered, lasting, pieces, scratch, texts, written
from .ragged import CLASS, token_hashes

#: Number words and units of measure (fixed values). Short units count after a number only.
NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
UNITS = "mm cm km mg kg hours minutes seconds days miles feet inches pounds dollars euros cents percent degrees meters metres kilometers kilometres grams kilograms liters litres watts volts".split()
SHORT_UNITS = "m g l s h ms ml min".split()
NUM, UNIT, NAME = 1, 2, 3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Only runs of letters, digits, _ and bytes over 127 are tokens here.
WORDS = np.where(CLASS == 1, 1, 0).astype(np.uint8)
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[*b".!?:\n"]] = True
#: The bitmaps of a sieve: of tokens, and of windows (32 MB at most).
TOKEN_BITS, MOST_WINDOW_BITS = 20, 28
#: Item windows up to this many (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1 << 19
VIEWS = {"code": 0, "plain": 1, "raw": 2}
#: UTF-8 of a character of three or four bytes; mostly scripts without spaces.
WIDE = re.compile(rb"[\xe0-\xf4][\x80-\xbf]+")


def lowered(data: bytes) -> tuple[bytes, np.ndarray]:
    """Bytes with Latin capitals (ASCII and Latin-1) in lower case, and where capitals were."""
    b = np.frombuffer(data, np.uint8)
    latin = np.zeros(len(b), bool)
    latin[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    capital = UPPER[b]
    low = b + np.where(capital | latin, 32, 0).astype(np.uint8)
    capital[:-1] |= latin[1:]
    return low.tobytes(), capital


class Tokens:
    """Canonical codes and places of the tokens of some bytes.

    A number (3, 3.5 or a number word) is NUM, a unit UNIT, a capitalised word
    that doesn't start a sentence NAME; another word is its hash, kept over 3.
    ``plain`` has no NAME, so it doesn't depend on the case of letters.
    """

    def __init__(self, data: bytes, units: np.ndarray, short: np.ndarray, numbers: np.ndarray):
        self.low, capital = lowered(data)
        h, start, end = token_hashes(self.low, WORDS)
        b = np.frombuffer(self.low, np.uint8)
        digits = np.concatenate([[0], np.cumsum(DIGIT[b])])
        number = digits[end] - digits[start] == end - start
        joint = np.zeros(len(h), bool)  # the second part of a decimal
        if number.any():
            joint[1:] = number[1:] & number[:-1] & (start[1:] - end[:-1] == 1)
            joint[1:] &= np.isin(b[np.minimum(end[:-1], max(len(b) - 1, 0))], [44, 46])
            following = np.flatnonzero(joint)
            for i in following[::-1].tolist():
                end[i - 1] = end[i]
            h, start, end, number = (x[~joint] for x in (h, start, end, number))
        stops = np.concatenate([[0], np.cumsum(STOP[b])])
        opens = np.ones(len(h), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        number |= isin(h, numbers)
        after = np.zeros(len(h), bool)
        after[1:] = number[:-1] & ~opens[1:]
        plain = np.where(h > 3, h, h + np.uint64(4))
        plain[isin(h, units) | (after & isin(h, short))] = UNIT
        plain[number] = NUM
        self.code = np.where(capital[start] & ~opens & (plain > 3), np.uint64(NAME), plain)
        self.plain, self.start, self.end = plain, start, end
        self.first_capital = bool(len(h)) and bool(capital[start[0]])
        self.inner = ~opens & (plain > 3)  # words whose capital would tell a name

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.low[x:y] for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


class Raw:
    """Lower-cased tokens as they stand: no placeholders; a character of three or four bytes is a token."""

    def __init__(self, data: bytes):
        self.low = WIDE.sub(rb" \g<0> ", lowered(data)[0])
        h, self.start, self.end = token_hashes(self.low, WORDS)
        self.code = np.where(h > 3, h, h + np.uint64(4))

    words = Tokens.words


def isin(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership in a sorted array, by binary search."""
    if not len(keys) or not len(h):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def word_keys(words: list[str]) -> np.ndarray:
    return np.sort(token_hashes(" ".join(words).encode(), WORDS)[0])


def window_hashes(c: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = (h ^ c[at + i]) * MIX
        h ^= h >> np.uint64(31)
    return h


def indexable(c: np.ndarray, window: int) -> np.ndarray:
    """Places of windows of which half at most are placeholders."""
    slots = np.concatenate([[0], np.cumsum(c < 4)])
    return np.flatnonzero((slots[window:] - slots[:-window]) * 2 <= window) if len(c) >= window else np.zeros(0, np.int64)


class Index:
    """The windows of some canonical token lists, by hash."""

    def __init__(self, lists: list[np.ndarray], window: int):
        self.window, self.places = window, {}
        for row, c in enumerate(lists):
            at = indexable(c, window)
            for i, h in zip(at.tolist(), window_hashes(c, at, window).tolist(), strict=True):
                self.places.setdefault(h, []).append((row, i))
        self.keys = np.array(sorted(self.places), np.uint64)

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of windows that the index has, and their hashes."""
        if len(c) < self.window or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = window_hashes(c, np.arange(len(c) - self.window + 1), self.window)
        at = np.flatnonzero(isin(h, self.keys))
        return at, h[at]


class Sieve:
    """Bitmaps of bounded size that tell which windows of a text may be an item's."""

    def __init__(self, tokens: np.ndarray, windows: np.ndarray, lengths: list[int]):
        self.tokens, self.windows, self.lengths = tokens, windows, lengths
        self.shift = np.uint64(64 - (len(windows) * 8).bit_length() + 1)

    def may(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return self.windows[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def hits(self, c: np.ndarray, window: int, view: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of windows all of whose tokens some item has, and that some item may have."""
        if len(c) < window:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        run = np.concatenate([[0], np.cumsum(self.tokens[token_bits(c)])])
        at = np.flatnonzero(run[window:] - run[:-window] == window)
        h = marked(window_hashes(c, at, window), view, window)
        may = self.may(h)
        return at[may], h[may]


def token_bits(c: np.ndarray) -> np.ndarray:
    """The bit of each token; placeholders have bits of their own."""
    return np.where(c < 4, c, c >> np.uint64(64 - TOKEN_BITS)).astype(np.int64)


def marked(h: np.ndarray, view: int, window: int) -> np.ndarray:
    """Window hashes that differ by view and length."""
    h = (h ^ np.uint64(view * 64 + window)) * MIX
    return h ^ (h >> np.uint64(32))


class Templates:
    """Some benchmark items as canonical tokens, with and without names, and as raw tokens.

    Items of fewer than ``window`` and at least ``shortest`` raw tokens are short:
    they match as a whole.
    """

    def __init__(self, items: list[tuple[int, str]], window: int, span: int, shortest: int):
        self.lists = word_keys(UNITS), word_keys(SHORT_UNITS), word_keys(NUMBER_WORDS)
        self.window, self.items = window, []
        self.short: list[tuple[int, np.ndarray]] = []
        self.views: dict[str, list[tuple[int, np.ndarray, list[bytes], int]]] = {"code": [], "plain": [], "raw": []}
        for item, text in items:
            data = text.encode("utf-8", "surrogatepass")
            t, raw = Tokens(data, *self.lists), Raw(data)
            at = len(self.items)
            self.items.append((item, t, t.words(0, len(t.code)), len(raw.code)))
            if len(t.code) >= window:
                words, need = self.items[at][2], min(span, len(t.code))
                self.views["code"].append((at, t.code, words, need))
                self.views["plain"].append((at, t.plain, words, need))
                if t.first_capital and t.code[0] > 3:  # within a sentence the first word would be a name
                    named = t.code.copy()
                    named[0] = NAME
                    self.views["code"].append((at, named, words, need))
            if len(raw.code) >= window:
                self.views["raw"].append((at, raw.code, raw.words(0, len(raw.code)), min(span, len(raw.code))))
            elif len(raw.code) >= max(1, shortest):
                self.short.append((at, raw.code))
        self.index = {view: Index([c for _, c, _, _ in rows], window) for view, rows in self.views.items()}

    def matches(self, batch: list[str]) -> list[tuple[int, int, int, int]]:
        """Text number, item, longest consistent run in tokens, tokens of the item (raw ones if only raw tokens match)."""
        parts = [t.encode("utf-8", "surrogatepass") for t in batch]
        t = Tokens(b"\n".join(parts), *self.lists)
        ends = np.cumsum([len(p) + 1 for p in parts])
        best: dict[tuple[int, int], int] = {}
        for view, c in (("code", t.code), ("plain", t.plain)):
            for doc, item, shift, run in self.runs(t, c, view, ends):
                if view == "plain" and not self.caseless(t, doc, item, shift, ends):
                    continue
                best[doc, item] = max(best.get((doc, item), 0), run)
        exact: dict[tuple[int, int], int] = {}
        raw = Raw(b"\n".join(parts))
        if len(raw.low) != len(t.low):
            ends = np.cumsum([len(WIDE.sub(rb" \g<0> ", p)) + 1 for p in parts])
        for doc, item, _, run in self.runs(raw, raw.code, "raw", ends):
            exact[doc, item] = max(exact.get((doc, item), 0), run)
        for item, c in self.short:
            for doc in self.whole(raw, c, ends):
                exact[doc, item] = len(c)
        found = [(doc, self.items[item][0], run, len(self.items[item][2])) for (doc, item), run in best.items()]
        return found + [(doc, self.items[item][0], run, self.items[item][3]) for (doc, item), run in exact.items() if (doc, item) not in best]

    def windows(self) -> Iterator[tuple[int, np.ndarray]]:
        """Item number and marked hashes of its windows, and of whole short items."""
        for view, rows in self.views.items():
            for item, c, *_ in rows:
                yield item, marked(window_hashes(c, indexable(c, self.window), self.window), VIEWS[view], self.window)
        for item, c in self.short:
            yield item, marked(window_hashes(c, np.zeros(1, np.int64), len(c)), VIEWS["raw"], len(c))

    @staticmethod
    def whole(raw: Raw, c: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Text numbers where a short item stands as a whole."""
        if len(raw.code) < len(c):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(raw.code[: len(raw.code) - len(c) + 1] == c[0])
        for i in range(1, len(c)):
            at = at[raw.code[at + i] == c[i]]
        of = np.searchsorted(ends, raw.start[at], "right")
        return np.unique(of[of == np.searchsorted(ends, raw.start[at + len(c) - 1], "right")])

    def caseless(self, t: Tokens, doc: int, item: int, shift: int, ends: np.ndarray) -> bool:
        """Whether the words of a text that face an item are all capitalised or none is, so that case tells no names."""
        first = int(np.searchsorted(t.start, ends[doc - 1])) if doc else 0
        last = int(np.searchsorted(t.start, ends[doc]))
        a, b = max(first, shift), min(last, shift + len(self.items[item][2]))
        named = (t.code[a:b] == NAME)[t.inner[a:b]]
        return bool(named.all() or not named.any())

    def runs(self, t: Tokens | Raw, c: np.ndarray, view: str, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text number, item number, diagonal and length of each consistent run of windows."""
        k, index, rows = self.window, self.index[view], self.views[view]
        at, h = index.hits(c)
        of = np.searchsorted(ends, t.start[at], "right")
        inside = of == np.searchsorted(ends, t.start[at + k - 1], "right")
        found: dict[tuple[int, int, int], list[int]] = {}
        for d, p, x in zip(of[inside].tolist(), at[inside].tolist(), h[inside].tolist(), strict=True):
            for item, i in index.places[x]:
                found.setdefault((d, item, p - i), []).append(p)
        for (doc, row, shift), places in found.items():
            item, ic, iwords, need = rows[row]
            begin, last = places[0], places[0]
            for p in [*places[1:], None]:
                if p is not None and p - last <= k:
                    last = p
                    continue
                a, b = begin, last + k
                if b - a >= need and bool((c[a:b] == ic[a - shift : b - shift]).all()) and consistent(t.words(a, b), iwords[a - shift : b - shift], c[a:b]):
                    yield doc, item, shift, b - a
                begin = last = p


def consistent(words: list[bytes], item: list[bytes], codes: np.ndarray) -> bool:
    """Whether the slots of two runs stand for one another, one to one, of each type, and the other words are equal."""
    there: dict[tuple[int, bytes], bytes] = {}
    back: dict[tuple[int, bytes], bytes] = {}
    for w, x, c in zip(words, item, codes.tolist(), strict=True):
        if c > 3 and w != x:
            return False
        if c < 4 and (there.setdefault((c, x), w) != w or back.setdefault((c, w), x) != x):
            return False
    return True


def item_parts(items: DataFrame, window: int, span: int, shortest: int) -> DataFrame:
    """``h, key, n, bits``: a row for each distinct window hash of an item, and a row
    with the bitmap of all their tokens for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TOKEN_BITS, bool)
        for b in pieces(batches):
            rows = Templates(list(zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True)), window, span, shortest)
            hs, keys, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            short = dict(rows.short)
            for item, h in rows.windows():
                hs.append(np.unique(h))
                keys.append(np.full(len(hs[-1]), rows.items[item][0], np.int64))
                size.append(np.full(len(hs[-1]), len(short.get(item, ())) or window, np.int64))
            for c in [c for view in rows.views.values() for _, c, *_ in view] + list(short.values()):
                bits[token_bits(c)] = True
            hs, keys, size = map(np.concatenate, (hs, keys, size))
            yield pa.RecordBatch.from_arrays([pa.array(hs.view(np.int64)), pa.array(keys), pa.array(size), pa.nulls(len(hs), pa.binary())], ["h", "key", "n", "bits"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([np.packbits(bits).tobytes()], pa.binary())], ["h", "key", "n", "bits"])

    return items.mapInArrow(run, "h long, key long, n long, bits binary")


def sieve_of(parts: DataFrame) -> tuple[Sieve, int]:
    """The sieve of all item windows, and their number; bitmaps of bounded size reach the driver."""
    tokens = np.zeros(1 << TOKEN_BITS, bool)
    for r in parts.filter("bits is not null").select("bits").toLocalIterator():
        tokens |= np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    windows = parts.filter("h is not null")
    n = windows.count()
    size = min(max(16, (32 * n).bit_length()), MOST_WINDOW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for b in batches:
            bits[(b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - size)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["bits"])

    every = np.zeros((1 << size) // 8, np.uint8)
    for r in windows.select("h").mapInArrow(run, "bits binary").toLocalIterator():
        every |= np.frombuffer(r.bits, np.uint8)
    lengths = [r.n for r in windows.select("n").distinct().collect()]  # at most ``window`` of them
    return Sieve(tokens, every, sorted(lengths)), n


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, span: int = 13, shortest: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_matched, n_item``: documents that hold an item's template.

    Numbers, names and units become typed placeholders. Windows of ``window``
    canonical tokens, at most half placeholders, are matched by hash; windows on
    one diagonal form runs; a run of ``span`` tokens (or the whole item, where it
    is shorter) whose canonical tokens are equal and whose slots map one to one
    counts. Where a passage is all in capitals or has none, case tells no names;
    there names are matched as ordinary words. An item's capitalised first word also
    stands for a name within a sentence. Besides, a run of ``span`` raw lower-cased
    tokens (or the whole item) counts, whatever its numbers, names and case; there a
    character of three or four bytes is a token. An item of fewer than ``window``
    raw tokens matches as a whole if it has ``shortest`` (default: ``window``, so that
    none does); what is shorter can't be told from chance.

    Both sides become tables of window hashes, which are joined by hash: the
    items' table is broadcast if its counted size allows, else both are shuffled.
    Before the join a sieve, bitmaps of bounded size, keeps back windows that no
    item has. Runs and slots are checked on the pairs that the join finds alone;
    texts of other documents don't move. The benchmark never comes to the driver.

    Null texts count as empty, null items are skipped, null ids stay, repeated
    rows each give rows, empty tables give an empty one, other columns are
    ignored, and texts are searched whole.
    """
    spark = docs.sparkSession
    least = window if shortest is None else shortest
    schema = "doc_id long, item_id long, n_matched long, n_item long"
    with scratch(spark):
        items = benchmark.select(benchmark[item_col].cast("long").alias("item_id"), benchmark[item_text].cast("string").alias("text")).dropna().distinct()
        items = items.select(F.xxhash64("item_id", "text").alias("key"), "item_id", "text")
        items = written(gathered(items, benchmark.count(), TEXT_ROWS), "items")
        parts = written(item_parts(items, window, span, least), "item-windows")
        sieve, n = sieve_of(parts)
        windows = parts.filter("h is not null").select("h", "key")
        held = spark.sparkContext.broadcast(sieve)
        lists = word_keys(UNITS), word_keys(SHORT_UNITS), word_keys(NUMBER_WORDS)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Documents with windows that pass the sieve, and the hashes of these."""
            from pyspark import TaskContext

            row = TaskContext.get().partitionId() << 40
            for b in pieces(batches):
                ts = b.column("text").to_pylist()
                for i in range(0, len(ts), 200):
                    found = window_hits(ts[i : i + 200], held.value, window, lists)
                    if found:
                        at = pa.array([i + k for k in found], pa.int64())
                        names = pa.array(range(row, row + len(found)), pa.int64())
                        row += len(found)
                        yield pa.RecordBatch.from_arrays([names, b.column("doc_id").take(at), b.column("text").take(at), pa.array(list(found.values()), pa.list_(pa.int64()))], ["row", "doc_id", "text", "hits"])

        found = written(texts(docs, id_col, text_col).mapInArrow(look, "row long, doc_id long, text string, hits array<long>"), "window-hits")
        windows = F.broadcast(windows) if n <= MOST_BROADCAST else windows
        pairs = found.select("row", F.explode("hits").alias("h")).join(windows, "h").select("row", "key").distinct()
        asked = found.select("row", "doc_id", "text").join(pairs, "row").join(items.withColumnRenamed("text", "item"), "key")
        asked = asked.select("row", "doc_id", "text", "item_id", "item").repartition("row").sortWithinPartitions("row")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                cells = [b.column(c).to_pylist() for c in ("row", "doc_id", "text", "item_id", "item")]
                i = 0
                while i < b.num_rows:
                    j = i + 1
                    while j < b.num_rows and cells[0][j] == cells[0][i]:
                        j += 1
                    rows = Templates(list(zip(cells[3][i:j], cells[4][i:j], strict=True)), window, span, least)
                    got = [(cells[1][i], *rest) for _, *rest in rows.matches([cells[2][i]])]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "item_id", "n_matched", "n_item"])
                    i = j

        return lasting(gathered(asked.mapInArrow(check, schema), found.count(), TEXT_ROWS // 4))  # a text meets several items


def window_hits(batch: list[str], sieve: Sieve, window: int, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[int, list[int]]:
    """Distinct hashes, by text number, of the windows of some texts that pass the sieve."""
    parts = [t.encode("utf-8", "surrogatepass") for t in batch]
    t, raw = Tokens(b"\n".join(parts), *lists), Raw(b"\n".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    raw_ends = ends if len(raw.low) == len(t.low) else np.cumsum([len(WIDE.sub(rb" \g<0> ", p)) + 1 for p in parts])
    of, hs = [], []
    views = [(t, t.code, 0, ends, window), (t, t.plain, 1, ends, window)] + [(raw, raw.code, 2, raw_ends, n) for n in sieve.lengths]
    for x, c, view, bounds, n in views:
        at, h = sieve.hits(c, n, view)
        of.append(np.searchsorted(bounds, x.start[at], "right"))
        hs.append(h.view(np.int64))
    of, hs = np.concatenate(of), np.concatenate(hs)
    found: dict[int, list[int]] = {}
    for d, h in np.unique(np.stack([of, hs], 1), axis=0).tolist() if len(of) else []:
        found.setdefault(d, []).append(h)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that ``contaminated`` doesn't name.

    Documents with a null id can't be named and stay. Repeated rows of a named id
    all go.
    """
    bad = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("_bad_doc")).dropna().distinct()
    return docs.join(bad, docs[options.get("id_col", "doc_id")].cast("long") == bad["_bad_doc"], "left_anti")
