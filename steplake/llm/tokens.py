"""Token counts by rank-synchronous merging of ragged symbol arrays."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: The pattern that splits text into pre-tokens in byte-level BPE vocabularies (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker remembers; the table is emptied when full.
REMEMBERED = 1_000_000
#: Longer pre-tokens are merged one by one, by a heap, in n log n steps.
LONG = 128
NONE = np.int64(1) << 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counter:
    """Counts tokens with the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        self.start = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.by_pair = {int(k): (r, int(self.made[r])) for r, k in enumerate(keys)}
        specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(SPLIT)
        self.odd = re.compile(r"[^\S \n]|[\x85\xa0]")
        self.known: dict[str, int] = {}
        self.spaced: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merge_rows(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of some byte strings.

        All strings lie in one padded array. Each turn finds every row's pair of
        lowest rank (the leftmost of equals), replaces it in all rows at once and
        closes the gap; rows without a pair leave.
        """
        sizes = np.array([len(w) for w in words])
        counts = sizes.copy()
        width = int(sizes.max())
        flat = self.start[np.frombuffer(b"".join(words), np.uint8)]
        sym = np.full((len(words), width), -1, np.int64)
        sym[np.arange(width) < sizes[:, None]] = flat
        rows = np.arange(len(words))
        rank = self.rank(sym[:, :-1], sym[:, 1:])
        while len(rows) and sym.shape[1] > 1:
            best = rank.argmin(1)
            each = np.arange(len(rows))
            r = rank[each, best]
            live = r < NONE
            if not live.all():
                counts[rows[~live]] = (sym[~live] >= 0).sum(1)
                rows, sym, rank, best, r = rows[live], sym[live], rank[live], best[live], r[live]
                if not len(rows):
                    break
                each = np.arange(len(rows))
            sym[each, best] = self.made[r]
            gap = np.arange(1, sym.shape[1])[None, :] > best[:, None]
            sym[:, 1:] = np.where(gap, np.concatenate([sym[:, 2:], np.full((len(rows), 1), -1)], 1), sym[:, 1:])
            keep = int((sym >= 0).sum(1).max())
            sym = sym[:, :keep]
            if keep > 1:
                rank = self.rank(sym[:, :-1], sym[:, 1:])
        if len(rows):
            counts[rows] = (sym >= 0).sum(1)
        return counts

    def merge_long(self, word: bytes) -> int:
        """The same count for one long string, with a heap of (rank, place)."""
        sym = [int(x) for x in self.start[np.frombuffer(word, np.uint8)]]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.by_pair[k][0], i) for i in range(n - 1) if (k := (sym[i] << 32) | sym[i + 1]) in self.by_pair]
        heapq.heapify(heap)
        left = n
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if sym[i] >= 0 else n
            if j >= n or self.by_pair.get((sym[i] << 32) | sym[j], (-1,))[0] != r:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (x := self.by_pair.get((sym[a] << 32) | sym[b])):
                    heapq.heappush(heap, (x[0], a))
        return left

    def learn(self, words: Iterable[str]) -> None:
        """Count pre-tokens and remember them, grouped by length so that rows are full."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            if len(b) == 1:
                self.known[w] = 1
            elif len(b) > LONG:
                self.known[w] = self.merge_long(b)
            else:
                by_size.setdefault((len(b) + 7) // 8, []).append((w, b))
        for group in by_size.values():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                self.known.update(zip((w for w, _ in part), self.merge_rows([b for _, b in part]).tolist(), strict=True))

    def pieces(self, t: str) -> tuple[list[str], list[str]]:
        """A text as (pre-tokens, words that each follow one space).

        A single space between two other characters always starts a pre-token,
        so such words can be counted, and remembered, on their own. Texts with
        longer white space are split by the full pattern.
        """
        if "  " in t or " \n" in t or "\n " in t or self.odd.search(t):
            return self.split.findall(t), []
        first, *words = t.split(" ")
        return self.split.findall(first), words

    def count(self, batch: list[str]) -> list[int]:
        """Tokens of each text; a special token's string in a text is one token."""
        if len(self.known) > REMEMBERED or len(self.spaced) > REMEMBERED:
            self.known.clear()
            self.spaced.clear()
        kept = []
        unseen: set[str] = set()
        for t in batch:
            parts, extra = [t], 0
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                extra = len(parts) - 1
            for k, p in enumerate(parts):
                plain, words = self.pieces(p)
                unseen.update(set(words).difference(self.spaced))
                kept.append((plain, words, extra, k == 0))
                extra = 0
        split = {w: self.split.findall(" " + w) for w in unseen}
        new = {x for xs in split.values() for x in xs}
        for plain, *_ in kept:
            new.update(plain)
        self.learn(new.difference(self.known))
        known, spaced = self.known, self.spaced
        for w, xs in split.items():
            spaced[w] = sum(map(known.__getitem__, xs))
        out: list[int] = []
        for plain, words, extra, first in kept:
            n = sum(map(known.__getitem__, plain)) + sum(map(spaced.__getitem__, words)) + extra
            if first:
                out.append(n)
            else:
                out[-1] += n
        return out


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row.

    ``vocabulary`` is the path, the same on every executor, of a byte-level BPE
    vocabulary file. One narrow pass: no shuffle, one batch in memory.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null;
    repeated rows and ids are each counted; an empty table gives an empty one;
    other columns are ignored. A text of any length is counted whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for b in pieces(batches):
            got, size = [], 0
            ts = b.column("text").to_pylist()
            part: list[str] = []
            for t in ts:  # a few MB of text at once
                part.append(t)
                size += len(t)
                if size > 2_000_000:
                    got += c.count(part)
                    part, size = [], 0
            got += c.count(part)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(got, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    t = texts(df, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return t.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
