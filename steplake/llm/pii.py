"""Personal data: fixed patterns, and a linear-chain conditional random field."""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, texts
from .pii_labels import training_table

#: Kinds of spans, in the order of output; label 0 of the field is "none".
KINDS = ("email", "ip", "card", "phone")
# Fixed patterns. Possessive digits and the look-behind only save backtracking:
# a run of digits that fails from its start fails from every later digit too.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost addresses: all local characters before an @, then a dotted domain."""
    found, done, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = t.find("@", done)
    return found


def base_spans(t: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind in a text, in code points, end exclusive."""
    ips = [m.span() for m in IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())] if "." in t else []
    cards = []
    for m in CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = NOT_DIGIT.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(t) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in t else []
    return [emails(t) if "@" in t else [], ips, cards, phones]


# The conditional random field.

SPACE = re.compile(r"\S+")
EDGE = ".,;:!?\"'<>[]{}"
SHAPE = str.maketrans({**{c: "9" for c in "0123456789"}, **{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}})
DIGITS = re.compile(r"9+\+?")
RUNS = re.compile(r"([Aa])\1+|(9)\2{4,}")
FEATURES = 1 << 13
DIGIT_OR_AT = re.compile(r"[0-9@]")
SIGN_EDGE = EDGE + "()"
#: What a line must have for a span: a digit, an @ or a word for one of an address's signs.
CUE = re.compile(r"[0-9@]|(?i:[\[({<] ?(?:at|dot) ?[\])}>]|\bdot\b)")
AT, DOT = (re.compile(rf"(?i)[\[({{<]{x}[\])}}>]") for x in ("at", "dot"))
SIGNS = {"at": "<at>", "dot": "<dot>"}
#: Words round a word with a cue that are decoded with it, and words decoded as one line.
NEAR, LONGEST = 8, 512


def shape(w: str) -> str:
    """Letters as A or a, digits as 9; runs of letters, and of over four digits, cut short."""
    sign = SIGNS.get(w.strip(SIGN_EDGE).lower())
    if sign:
        return sign
    w = DOT.sub(".", AT.sub("@", w)).strip(EDGE)
    if not DIGIT_OR_AT.search(w):
        return ("Aa" if w[:1].isupper() else "a") + (".a" if "." in w else "")
    n = sum(map(str.isdigit, w))
    line = RUNS.sub(lambda m: m[1] or "9+", w.translate(SHAPE))
    return DIGITS.sub("9", line) if "@" in w else line + f"/{min(n, 20)}"


def coarse(s: str) -> str:
    """A shape as the set of its signs (of an address: @ and dots alone), and its number of digits."""
    line, _, n = s.rpartition("/") if "/" in s else (s, "", "")
    return "".join(sorted(set(line) & set("@.") if "@" in line else set(line) - set("Aa9"))) + n


@functools.lru_cache(200_000)
def feature(place: int, s: str) -> int:
    return zlib.crc32(f"{place}:{s}".encode()) % FEATURES


#: Features of a word.
EACH = 7


def features(words: list[str]) -> list[tuple[int, ...]]:
    """Of each word: its shape, its neighbours' shapes, its shape with the one before,
    the one after and the one after that, and its coarse shape."""
    s = ["^", *map(shape, words), "$", "$"]
    return [
        (feature(0, s[i]), feature(-1, s[i - 1]), feature(1, s[i + 1]), feature(2, s[i - 1] + " " + s[i]), feature(3, s[i] + " " + s[i + 1]), feature(4, s[i] + " " + s[i + 2]), feature(5, coarse(s[i])))
        for i in range(1, len(s) - 2)
    ]


class Field:
    """Weights of a linear-chain field: emissions by hashed feature, and transitions."""

    def __init__(self, table: list[tuple[list[str], list[int]]], turns: int = 80, rate: float = 0.5, decay: float = 2e-4):
        n = len(KINDS) + 1
        self.emit, self.move = np.zeros((FEATURES, n)), np.zeros((n, n))
        size = np.array([len(w) for w, _ in table])
        x = np.full((len(table), size.max(), EACH), FEATURES - 1)
        y = np.zeros((len(table), size.max()), int)
        for i, (words, labels) in enumerate(table):
            x[i, : len(words)], y[i, : len(words)] = features(words), labels
        on = np.arange(size.max()) < size[:, None]
        ge, gm = np.full_like(self.emit, 1e-8), np.full_like(self.move, 1e-8)
        gold_e, gold_m = np.zeros_like(self.emit), np.zeros_like(self.move)
        for f in range(EACH):
            np.add.at(gold_e, (x[on][:, f], y[on]), 1)
        both = on[:, 1:]
        np.add.at(gold_m, (y[:, :-1][both], y[:, 1:][both]), 1)
        for _ in range(turns):
            e = self.emit[x].sum(2)
            alpha, beta = e.copy(), np.zeros_like(e)
            for t in range(1, e.shape[1]):
                alpha[:, t] = e[:, t] + self.total(alpha[:, t - 1, :, None] + self.move, 1)
            for t in range(e.shape[1] - 2, -1, -1):
                step = self.total(self.move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(on[:, t + 1][:, None], step, 0)
            z = self.total(alpha[np.arange(len(size)), size - 1], 1)
            p = np.exp(alpha + beta - z[:, None, None])
            grad_e, grad_m = gold_e - decay * self.emit * len(table), gold_m.copy()
            for f in range(EACH):
                np.subtract.at(grad_e, x[on][:, f], p[on])
            for t in range(1, e.shape[1]):
                q = np.exp(alpha[:, t - 1, :, None] + self.move + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None])
                grad_m -= q[on[:, t]].sum(0)
            ge, gm = ge + grad_e**2, gm + grad_m**2
            self.emit += rate * grad_e / np.sqrt(ge)
            self.move += rate * grad_m / np.sqrt(gm)

    @staticmethod
    def total(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best label sequence of each line: Viterbi over lines of like length at once."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            longest = max(len(lines[order[at]]), 1)
            upto = at
            while upto < len(order) and upto - at < 4096 and len(lines[order[upto]]) <= 2 * longest and (upto - at) * len(lines[order[upto]]) < 400_000:
                upto += 1
            part = order[at : max(upto, at + 1)]
            at += len(part)
            size = np.array([len(lines[i]) for i in part])
            x = np.zeros((len(part), size.max(), EACH), np.int64)
            for k, i in enumerate(part):
                x[k, : size[k]] = features(lines[i])
            e = self.emit[x[:, :, 0]]
            for f in range(1, EACH):
                e += self.emit[x[:, :, f]]
            best, back = e[:, 0], np.zeros(e.shape, np.int8)
            ends = np.zeros((len(part), e.shape[2]))
            ends[size == 1] = best[size == 1]
            for t in range(1, e.shape[1]):
                step = best[:, :, None] + self.move
                back[:, t] = step.argmax(1)
                best = step.max(1) + e[:, t]
                ends[size == t + 1] = best[size == t + 1]
            label = np.zeros(e.shape[:2], np.int8)
            here = ends.argmax(1)
            rows = np.arange(len(part))
            for t in range(e.shape[1] - 1, -1, -1):
                here = np.where(t == size - 1, ends.argmax(1), here)
                label[:, t] = here
                here = np.where(t <= size - 1, back[rows, t, here], here)
            for k, i in enumerate(part):
                out[i] = label[k, : size[k]]
        return out


#: An address, with signs or words for them.
ADDRESS = re.compile(r"(?i)[a-z0-9._%+-]+(?:@| ?[\[({<]at[\])}>] ?| at )[a-z0-9-]+(?:(?:\.| ?[\[({<]dot[\])}>] ?| dot )[a-z0-9-]+)+")


def sound(kind: int, s: str) -> bool:
    """Whether a span that the field proposes can be of its kind at all."""
    digits = NOT_DIGIT.sub("", s)
    if kind == 1:
        return bool(ADDRESS.fullmatch(s))
    if kind == 2:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 3:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and not re.search(r"[^0-9() .+-]", s)


def near_cues(words: list[str]) -> list[slice]:
    """Parts of a line: words at most NEAR from one with a cue. A part of over LONGEST
    words is cut into ones that overlap by 4 * NEAR, more than a span can have."""
    parts: list[slice] = []
    begin = end = 0
    for i in (i for i, w in enumerate(words) if CUE.search(w)):
        if i - NEAR > end:
            if end:
                parts.append(slice(begin, end))
            begin = i - NEAR
        end = min(i + NEAR + 1, len(words))
    if end:
        parts.append(slice(begin, end))
    return [slice(a, min(a + LONGEST, p.stop)) for p in parts for a in range(p.start, max(p.start + 1, p.stop - 4 * NEAR), LONGEST - 4 * NEAR)]


def added_spans(field: Field, batch: list[str], base: list[list[list[tuple[int, int]]]]) -> list[list[list[tuple[int, int]]]]:
    """Spans that the field finds beside the fixed ones.

    A span must hold a cue, so only words near one are decoded, in lines of
    bounded length; the others can't give a span. A proposal that touches a
    fixed span is left out.
    """
    lines, where = [], []
    for k, t in enumerate(batch):
        if not CUE.search(t):
            continue
        start = 0
        for line in t.split("\n"):
            if CUE.search(line):
                tokens = [(m.start() + start, m.end() + start) for m in SPACE.finditer(line)]
                for part in near_cues([t[a:b] for a, b in tokens]):
                    lines.append([t[a:b] for a, b in tokens[part]])
                    where.append((k, tokens[part]))
            start += len(line) + 1
    found: list[list[list[tuple[int, int]]]] = [[[] for _ in KINDS] for _ in batch]
    if not lines:
        return found
    for (k, tokens), labels in zip(where, field.decode(lines), strict=True):
        if not labels.any():
            continue
        t, i = batch[k], 0
        taken = [s for spans in (*base[k], *found[k]) for s in spans]
        while i < len(labels):
            kind, j = int(labels[i]), i + 1
            while j < len(labels) and labels[j] == kind:
                j += 1
            if kind:
                a, b = tokens[i][0], tokens[j - 1][1]
                while a < b and t[a] in EDGE:
                    a += 1
                while b > a and t[b - 1] in EDGE:
                    b -= 1
                if sound(kind, t[a:b]) and not any(x < b and a < y for x, y in taken):
                    found[k][kind - 1].append((a, b))
                    taken.append((a, b))  # parts of a long line overlap
            i = j
    return found


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, part in zip(KINDS, spans, strict=True) for a, b in part)


def find_personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of each row.

    Counts and the digest are of the fixed patterns' spans; ``spans`` has the
    field's too. The field is trained on the driver from ``pii_labels.training_table``
    (seconds) and travels with the tasks; one narrow pass, no shuffle.

    A null text counts as empty: no spans, the digest of an empty string. Null
    ids stay, repeated rows are each searched, an empty table gives an empty
    one, other columns are ignored, and texts are searched whole.
    """
    field = Field(training_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ts = b.column("text").to_pylist()
            base = [base_spans(t) if CUE.search(t) else [[], [], [], []] for t in ts]
            more = added_spans(field, ts, base)
            both = [[sorted(x + y) for x, y in zip(s, m, strict=True)] for s, m in zip(base, more, strict=True)]
            counts = [pa.array([len(s[k]) for s in base], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(joined(s).encode()).hexdigest() for s in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digest), pa.array([joined(s) for s in both])], names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
