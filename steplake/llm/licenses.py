"""License scans: fixed phrases, and an exact set-similarity join with notice templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lasting, pieces, scratch, texts, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words of common notices, the label that a block containing them gets, and the words
#: that tell a notice from its likes: they must stand in the block as they stand here.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0", "apache license version 2 0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0", "apache license version 2 0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0", "general public license version 3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2.0", "general public license version 2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu general public license"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl", "gnu lesser general public license"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", "hereby granted free of charge"),
    ("released under the mit license", "mit", "mit license"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "source and binary forms"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "with or without fee"),
    ("licensed under cc by 4 0", "cc-by-4.0", "cc by 4 0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0", "cc by nc 4 0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0", "cc by sa 4 0"),
    ("licensed under cc by nd 4 0", "cc-by-nd-4.0", "cc by nd 4 0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0", "attribution 4 0"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-4.0", "attribution sharealike 4 0"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc-4.0", "attribution noncommercial 4 0"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0", "mozilla public license"),
    ("this is free and unencumbered software released into the public domain", "unlicense", "unencumbered software"),
)
PLACES = tuple((re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split())), label) for p, label in PHRASES.items())
BREAK = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")


def phrase_places(low: str) -> list[tuple[int, str]]:
    """Offset and label of each place where a phrase's words follow one another."""
    found = []
    for pattern, label in PLACES:
        m = pattern.search(low)
        while m:
            a, b = m.span()
            if (a == 0 or BREAK.match(low, a - 1)) and (b == len(low) or BREAK.match(low, b)):
                found.append((a, label))
            m = pattern.search(low, a + 1)
    return found


def tokens(phrase: str) -> list[str]:
    """The words of a phrase and, joined by _, its word pairs."""
    words = phrase.split()
    return [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False))]


class Join:
    """Templates as token lists in the corpus's order, rarest first, with a prefix index.

    Templates are (tokens in one text, label) and perhaps the tokens that a window
    must hold; ``spans`` are the lengths of their windows.
    """

    def __init__(self, frequency: dict[str, int], templates: tuple[tuple[str, ...], ...], threshold: float, spans: list[int] | None = None):
        self.vocab = {w for t, *_ in templates for w in t.split()}
        self.order = {w: i for i, w in enumerate(sorted(self.vocab, key=lambda w: (frequency.get(w, 0), w)))}
        self.rows, self.prefix, self.required = [], {}, []
        self.spans = spans or [math.ceil(len(t.split()) / threshold - 1e-9) for t, *_ in templates]
        for text, label, *telling in templates:
            own = sorted({self.order[w] for w in text.split()})
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for i, w in enumerate(own[: len(own) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.rows), i))
            self.rows.append((own, need, label))
            self.required.append({self.order[w] for t in telling for w in t.split()})

    def block(self, words: set[str]) -> list[tuple[str, float]]:
        """Labels and containment of the templates that a block's words reach.

        A template with n tokens needs k of them, so a matching block has one of
        its n - k + 1 rarest. From there the length of the block and the places
        of the shared token bound the overlap; only who passes is counted.
        """
        b = sorted(self.order[w] for w in words & self.vocab)
        found, met = [], set()
        for j, w in enumerate(b):
            for row, i in self.prefix.get(w, ()):
                own, need, label = self.rows[row]
                if row in met or len(b) < need or 1 + min(len(own) - i - 1, len(b) - j - 1) + min(i, j) < need:
                    continue
                met.add(row)
                shared = len(set(own).intersection(b))
                if shared >= need:
                    found.append((label, shared / len(own)))
        return found

    def windows(self, words: list[str]) -> list[tuple[str, float]]:
        """Labels and best containment of the templates that some window of words reaches."""
        return self.slide([(i, self.order[w]) for i, w in enumerate(words) if w in self.order])

    def slide(self, at: list[tuple[int, int]]) -> list[tuple[str, float]]:
        """The same from places and token numbers, ascending.

        A window that reaches a template has one of its rarest tokens (prefix
        filter), so only the surroundings of those are slid over, if they have
        tokens enough (length filter) and enough different ones that aren't rarer
        than the rarest one met (positional filter). Each place is entered and
        left once for each template.
        """
        hits: dict[int, list[tuple[int, int]]] = {}
        for i, w in at:
            for row, k in self.prefix.get(w, ()):
                hits.setdefault(row, []).append((i, k))
        found = []
        for row, places in hits.items():
            own, need, label = self.rows[row]
            required, span, inner, best, done, rarest = self.required[row], self.spans[row], set(own), 0, 0, len(own)
            for k, (q, rank) in enumerate(places):
                rarest = min(rarest, rank)
                if k + 1 < len(places) and places[k + 1][0] - q < span:
                    continue  # a run of surroundings ends at its last place
                a, b = bisect_left(at, (places[done][0] - span + 1,)), bisect_left(at, (q + span,))
                done, first, rarest = k + 1, rarest, len(own)
                inside = [x for x in at[a:b] if x[1] in inner]
                if len(inside) < need or len(own) - first < need or len({w for _, w in inside}) < need:
                    continue
                held: Counter[int] = Counter()
                left = distinct = 0
                for i, w in inside:
                    held[w] += 1
                    distinct += held[w] == 1
                    while i - inside[left][0] >= span:
                        gone = inside[left][1]
                        held[gone] -= 1
                        distinct -= not held[gone]
                        left += 1
                    if distinct > best and all(held[r] for r in required):
                        best = distinct
                if best == len(own):
                    break
            if best >= need:
                found.append((label, best / len(own)))
        return found


class Scan:
    """Fixed phrases, and the tokens of the templates, in one look at a text."""

    def __init__(self, templates: tuple[tuple[str, ...], ...], threshold: float):
        self.threshold = threshold
        self.tokened = tuple((" ".join(tokens(t)), label, *(" ".join(tokens(x)) for x in telling)) for t, label, *telling in templates)
        self.spans = [math.ceil(len(t.split()) / threshold - 1e-9) for t, *_ in templates]
        self.names = sorted({w for t, *_ in self.tokened for w in t.split()})
        self.number = {w: i for i, w in enumerate(self.names)}
        self.pairs: dict[str, dict[str, int]] = {}
        for w, i in self.number.items():
            if "_" in w:
                a, b = w.split("_")
                self.pairs.setdefault(a, {})[b] = i
        join = Join({}, self.tokened, threshold)
        back = {i: self.number[w] for w, i in join.order.items()}
        self.needs = [(frozenset(back[i] for i in own), need) for own, need, _ in join.rows]

    def look(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels; bits of the tokens met;
        places and numbers of these tokens if a template may be reached."""
        low = lowered(text)
        words = WORD.findall(low)
        places = phrase_places(low)
        first = last = None
        if places:
            starts = [m.start() for m in WORD.finditer(low)]
            first, last = (bisect_left(starts, f(a for a, _ in places)) for f in (min, max))
        number, pairs = self.number, self.pairs
        met = set(map(number.get, set(words).intersection(number)))
        at, of = [], []
        if met:
            heads = [i for i, w in enumerate(words) if w in number]  # each word of a pair is a token too
            for i in heads:
                w = words[i]
                at.append(i)
                of.append(number[w])
                nxt = pairs.get(w)
                if nxt and i + 1 < len(words) and (k := nxt.get(words[i + 1])) is not None:
                    at.append(i)
                    of.append(k)
                    met.add(k)
        bits = np.zeros(len(self.names), bool)
        bits[list(met)] = True
        may = any(len(own & met) >= need for own, need in self.needs)
        more = [np.array(x, np.int32).tobytes() for x in (at, of)] if may else [None, None]
        return (len(words), len(places), first, last, ",".join(sorted({x for _, x in places})), np.packbits(bits).tobytes(), *more)


BASE = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string"
KINDS = [pa.int64()] * 4 + [pa.string()]


def license_scan(df: DataFrame, templates: tuple[tuple[str, ...], ...] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A block is a window over the whole text, line breaks or not, of a template's
    length in words over ``threshold``. Tokens are words and word pairs; a block that
    contains at least ``threshold`` of a template's tokens, and all that tell it from
    its likes, gives its label. ``labels`` joins those with the phrases' labels;
    ``score`` is the best containment, 1 where a phrase stands.

    Texts are read once: that pass finds the phrases, and which template tokens
    stand where. From its small table come the counts, over all rows, that order
    tokens by frequency (the templates' vocabulary bounds what reaches the
    driver), and then the join.

    A null text counts as empty: 0 words, null places, no labels, score 0. Null
    ids stay, repeated rows are each scanned, an empty table gives an empty one,
    other columns are ignored, texts are scanned whole in linear time.
    """
    scan = Scan(templates, threshold)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols = list(zip(*map(scan.look, b.column("text").to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, [*KINDS, *[pa.binary()] * 3], strict=True))], seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scan.names), np.int64)
        for b in batches:
            rows = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            total += np.unpackbits(rows, axis=1, count=len(scan.names)).sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(scan.names), pa.array(total)], ["word", "n"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, scores = [], []
            for base, at, of in zip(*(b.column(c).to_pylist() for c in ("base_labels", "places", "tokens")), strict=True):
                own = {*base.split(",")} - {""}
                more = []
                if at is not None:
                    more = join.slide(sorted(zip(np.frombuffer(at, np.int32).tolist(), (join.order[scan.names[i]] for i in np.frombuffer(of, np.int32).tolist()), strict=True)))
                labels.append(",".join(sorted(own.union(x for x, _ in more))))
                scores.append(1.0 if own else max((s for _, s in more), default=0.0))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*seen[:6], "labels", "score"])

    seen = [*(x.split()[0] for x in BASE.split(", ")), "bits", "places", "tokens"]
    with scratch(df.sparkSession):
        found = written(texts(df, id_col, text_col).mapInArrow(look, f"{BASE}, bits binary, places binary, tokens binary"), "license-tokens")
        frequency = Counter()
        for r in found.select("bits").mapInArrow(count, "word string, n long").groupBy("word").sum("n").collect():
            frequency[r[0]] = r[1]
        join = Join(frequency, scan.tokened, threshold, scan.spans)
        return lasting(found.drop("bits").mapInArrow(match, f"{BASE}, labels string, score double"))
