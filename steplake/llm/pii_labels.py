"""Labelled lines for the personal-data field: a training table, and one to test it on.

Both are made by rules. The test table writes its addresses and numbers in other
forms and among other words than the training table.
"""

from __future__ import annotations

import random

#: Label numbers; 0 is none.
EMAIL, IP, CARD, PHONE = 1, 2, 3, 4
Line = tuple[list[str], list[int]]


class Maker:
    def __init__(self, seed: int, letters: str, longest: int):
        self.r, self.letters, self.longest = random.Random(seed), letters, longest

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def h(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def w(self) -> str:
        return "".join(self.r.choice(self.letters) for _ in range(self.r.randint(1, self.longest)))

    def card(self) -> str:
        body = self.r.choice("3456") + self.d(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
        return body + str(-total % 10)

    def filler(self) -> str:
        x = self.w()
        x = x.capitalize() if self.r.random() < 0.2 else x
        return x + (self.r.choice(".,") if self.r.random() < 0.2 else "")

    def line(self, part: list[str], kind: int) -> Line:
        words, labels = [], []
        for _ in range(self.r.randint(1, 3)):
            before = [self.filler() for _ in range(self.r.randint(0, 4))]
            words += before
            labels += [0] * len(before)
        end = self.r.choice(".,") if self.r.random() < 0.2 else ""
        words += [*part[:-1], part[-1] + end]
        labels += [kind] * len(part)
        after = [self.filler() for _ in range(self.r.randint(0, 4))]
        return words + after, labels + [0] * len(after)


def decoys(m: Maker) -> list[list[str]]:
    """What looks like personal data and isn't: dates, versions, amounts, keys, times, plain uses of at and dot."""
    d, w, h, r = m.d, m.w, m.h, m.r
    return [
        [f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}"], [f"{d(1)}.{d(1)}"], [f"{d(1)}.{d(2)}.{d(1)}"], [d(r.randint(1, 8))], [f"{d(2)}/{d(2)}/{d(4)}"],
        [h(r.choice((8, 18, 32, 40)))], [f"AKIA{w().upper()}{d(3)}{w().upper()}"], [f"{w()}={h(18)}"], [f"${d(2)}.{d(2)}"], [f"{d(2)}%"], [f"{w()}{d(1)}"],
        [f'"{h(40)}"'], [d(20)], [f"{d(2)}:{d(2)}"], [f"{d(3)},{d(3)}"], ["@" + w()], [f"{d(1)}-{d(1)}"], [f"({d(1)})"], [f"({d(4)})"], [d(3), d(3), d(4)], [d(4), d(4)], [f"{d(5)}-{d(4)}"],
        [w(), "at", w()], ["at", d(2)], ["the", "dot", w()], [w(), "dot", w()], ["at", "the", w()], [w(), "at", w(), "dot"], [f"{w()}", "(at)", "the", w()],
    ]


def training_table(rows: int = 1200, seed: int = 7) -> list[Line]:
    """Positive rows write addresses and numbers in their usual forms, with and without a
    country code, and addresses with words for their signs; every other row is a decoy."""
    m = Maker(seed, "abcdefghiklmnoprstu", 9)
    d, w, r = m.d, m.w, m.r
    out = []
    for k in range(rows):
        kind = 0 if k % 2 else r.choice((EMAIL, EMAIL, IP, CARD, PHONE, PHONE))
        name, host = f"{w()}{r.choice(['', '.', '_', '-'])}{r.choice([w(), d(2)])}", f"{w()}{r.choice(['', '-' + w(), d(1)])}"
        x, (a, b, c) = m.card(), (d(3), d(3), d(4))
        part = {
            0: decoys,
            EMAIL: lambda _: [[f"{name}@{host}.{r.choice([w(), w() + '.com'])}"], [name, "at", host, "dot", w()], [w(), "at", w(), "dot", w()], [w(), "(at)", w(), "(dot)", w()], [f"{name}(at){host}.{w()}"], [f"{name}[at]{host}[dot]{w()}"], [name, "[at]", host, "[dot]", w()]],
            IP: lambda _: [[".".join(str(r.randint(1, 255)) for _ in range(4))]],
            CARD: lambda _: [[x], [x[:4], x[4:8], x[8:12], x[12:]], ["-".join((x[:4], x[4:8], x[8:12], x[12:]))], [".".join((x[:4], x[4:8], x[8:12], x[12:]))]],
            PHONE: lambda _: [["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], ["+" + d(2), a, b, c], [f"+{d(2)}-{a}-{b}-{c}"], [f"({a})", b, c], [f"1-{a}-{b}-{c}"], [f"({a}){b}-{c}"]],
        }[kind](m)
        one = r.choice(part)
        out.append(m.line([x.upper() for x in one] if r.random() < 0.15 else one, kind))
    return out


def test_table(rows: int = 1000, seed: int = 101) -> list[Line]:
    """Held-out lines, all of forms that the fixed patterns miss, half of them decoys."""
    m = Maker(seed, "bcdfghjklmnpqrstvwxyzaeiou", 12)
    d, w, r = m.d, m.w, m.r
    out = []
    for k in range(rows):
        kind = 0 if k % 2 else r.choice((EMAIL, CARD, PHONE))
        x, (a, b, c) = m.card(), (d(3), d(3), d(4))
        part = {
            0: decoys,
            EMAIL: lambda _: [[w(), "(at)", w(), "(dot)", w()], [f"{w()}.{w()}", "at", f"{w()}{d(2)}", "dot", "org"], [f"{w()}{d(3)}[at]{w()}[dot]net"], [w(), "AT", w(), "DOT", "COM"]],
            CARD: lambda _: [[".".join((x[:4], x[4:8], x[8:12], x[12:]))], [f"{x[:4]}.{x[4:8]}", f"{x[8:12]}.{x[12:]}"]],
            PHONE: lambda _: [[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a})", b, c], [f"1-{a}-{b}-{c}"], [f"({a})-{b}-{c}"]],
        }[kind](m)
        out.append(m.line(r.choice(part), kind))
    return out
