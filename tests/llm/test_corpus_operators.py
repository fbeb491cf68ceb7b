"""Each operator against a brute-force version, and over awkward rows."""

import collections
import hashlib
import os
import random
import re
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from steplake.llm import common, decontam, licenses, lines, packing, pii, quality_model, rules, simhash, suffix, tokens

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, _id string, bits string, kept boolean, score double, _lines string"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, True, 0.5, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta", "é", "the", "of", "zeta", "x1", "#", "same"]
    common_line = "this line stands in a good many documents of the set"
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i in range(60):
        ls = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            ls.insert(r.randint(0, len(ls)), "  " + common_line.upper() + "\t")
        if i % 4 == 0:
            ls.append(passage)
        out.append((i, "\n".join(ls)))
    out += [(60, out[5][1]), (61, out[5][1] + " more"), (62, None), (63, ""), (64, " \t\n\n "), (65, "w " * 20_000), (66, out[0][1]), (67, "\x00a\x1f b c")]
    return out


def test_line_dedup(spark, rows):
    got = {r.doc_id: r for r in lines.line_dedup(make(spark, rows)).select("doc_id", "_lines.*").collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    texts = {i: t or "" for i, t in rows}
    seen = collections.Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    for i, t in texts.items():
        left = [x for x in t.split("\n") if not key(x) or seen[key(x)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(t.split("\n")), len(t.split("\n")) - len(left), "\n".join(left))
    first = lines.line_dedup(make(spark, [(1, "a\nb\na"), (2, "a"), (None, "b")]), min_docs=1, keep_first=True)
    assert {r.doc_id: r.k for r in first.select("doc_id", F.col("_lines.kept").alias("k")).collect()} == {1: "a\nb", 2: "", None: ""}


def test_suffix_arrays(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix, "SHARD", 3000)
    monkeypatch.setattr(suffix, "RANGE", 20_000)
    got = {r.doc_id: r for r in suffix.removed_passages(make(spark, rows)).collect()}
    seen, total = {}, 0
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        total += sum(gone)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
    assert total > 1000


def test_suffix_array_order():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2400] = data[100:500]
    starts = np.arange(0, len(data) - 50, 3)
    text = data.tobytes()
    sa = suffix.suffix_array(data, starts)
    assert [text[i : i + 50] for i in sa] == sorted(text[i : i + 50] for i in starts)
    lcp = suffix.common_prefixes(data, sa)
    for a, b, n in zip(sa[:-1], sa[1:], lcp[1:], strict=True):
        same = next((k for k in range(64) if text[a + k : a + k + 1] != text[b + k : b + k + 1]), 64)
        assert min(n, 50) == min(same, 50)


def test_near_duplicates(spark, rows):
    got = {r.doc_id: r for r in simhash.near_duplicates(make(spark, rows)).collect()}
    fps = {}
    for i, t in rows:
        w = (t or "").translate(LOW).encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    parent = {i: i for i in fps}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == {i: (fps[i], top(i)) for i in fps}
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make(spark, rows)).collect()) == sorted({top(i) for i in fps})


def test_near_links_of_large_groups():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 4, np.int64).astype(np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << r.integers(0, 24, 200).astype(np.uint64)) for b in base]))
    x = fp[:, None] ^ fp[None, :]
    assert (simhash.linked(x.ravel()) == (np.bitwise_count(x.ravel()) <= 3)).all()
    a, b = simhash.group_links(np.zeros(len(fp), np.int64), fp, np.arange(len(fp)))
    assert sum(map(len, a)) < len(fp)


@pytest.mark.parametrize("most", [2, 40, 4096])
def test_near_links_by_finer_keys(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    r = random.Random(6)
    fps = {0, 2**64 - 1}
    for _ in range(8):
        base = r.getrandbits(64)
        for _ in range(40):
            fps.add(base)
            base ^= sum(1 << b for b in set(r.choices(range(64), k=r.randint(1, 5))))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    got = dict(common.components(simhash.near_links(nodes)).collect())
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert len(set(map(top, range(len(fps))))) < len(fps) - 100
    assert all(got.get(i, i) == top(i) for i in range(len(fps)))


@pytest.mark.parametrize("most", [40, 4096])
def test_similar_documents(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    r = random.Random(11)
    names = [f"w{k}" for k in range(3000)]
    rows = []
    for size, copies in ((30, 5), (200, 70), (800, 6), (150, 3)):
        base = r.choices(names, k=size)
        for _ in range(copies):
            text = list(base)
            for _ in range(r.choice([0, 1, size // 60, size // 40, size // 15])):
                text[r.randrange(size)] = r.choice(names)
            rows.append((len(rows), " ".join(text)))
    rows += [(900, None), (901, ""), (902, "w1"), (903, "W1 "), (None, rows[0][1]), (904, "w " * 30_000), (904, "w " * 10)]
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    like = lambda x, y: len(x & y) / max(1, len(x | y))
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(make(spark, rows)).collect()}
    assert set(got) == set(sets) and got[None] == got[0]
    ids = [i for i in sets if i is not None]
    sure = 0
    for i in ids:
        for j in ids:
            best = max(like(x, y) for x in sets[i] for y in sets[j])
            if best >= 0.87:
                assert got[i] == got[j]
                sure += i < j
    assert sure > 50 and (got[903], got[901], got[904]) == (902, 900, 904)
    # no document joins a group without a neighbour that is near to similar
    for i in ids:
        mates = [j for j in ids if j != i and got[j] == got[i]]
        assert not mates or max(like(x, y) for j in mates for x in sets[i] for y in sets[j]) > 0.7
    kept = simhash.drop_near_duplicates(make(spark, rows), 5, similarity=0.8).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(set(got.values()))
    assert simhash.similar_documents(make(spark, [])).count() == 0


def test_similar_documents_at_the_threshold(spark):
    """Whole shingle sets of 900 distinct 1-word shingles: Jaccard exactly 0.8 links, a little less doesn't."""
    rows, want = [], {}
    for k in range(60):
        base = [f"a{k}x{i}" for i in range(900)]
        for other, away in ((1000 + k, 100), (2000 + k, 104)):
            # 900 - away shared of 900 + away: 800 / 1000 = 0.8, and 796 / 1004 < 0.8
            name = f"b{other}"
            rows += [(10_000 * k + other, " ".join(f"{name}{w}" for w in base)), (10_000 * k + other + 5000, " ".join([f"{name}{w}" for w in base[away:]] + [f"{name}y{i}" for i in range(away)]))]
            want[10_000 * k + other + 5000] = away == 100
    got = {x.doc_id: x.component_id != x.doc_id for x in simhash.similar_documents(make(spark, rows), 1).collect()}
    assert not any(got[i] for i, w in want.items() if not w)
    missed = sum(not got[i] for i, w in want.items() if w)
    assert not missed  # the band keys miss one pair in 37,000


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_lose_no_chain(spark, monkeypatch, seed):
    """Chains whose neighbours alone are similar, in one hot key and many cells."""
    monkeypatch.setattr(simhash, "MOST", 30)
    r = random.Random(seed)
    base, rows = [f"w{i}" for i in range(400)], []
    for chain in range(2):
        text = [f"c{chain}{w}" for w in base]
        for k in range(100):
            rows.append((len(rows), " ".join(text)))
            for at in r.sample(range(400), 40):
                text[at] = f"c{chain}n{k}x{at}"
    nodes = [(i, *simhash.profile(t, 1), np.unique(simhash.shingle_hashes(t, 1)).tobytes()) for i, t in rows]
    data = spark.createDataFrame([(i, fp, bytearray(sk), bytearray(u)) for i, fp, _, _, sk, u in nodes], "rep long, fp long, sketch binary, hashes binary")
    members = spark.createDataFrame([(7, i, 400) for i, _ in rows], "key long, rep long, n long")
    links = simhash.group_similar(members, data, 0.8, True)
    got = dict(common.components(links).collect())
    assert got == {i: i // 100 * 100 for i in range(200)}


def test_similar_documents_ignore_repeats(spark):
    rows = []
    for k in range(40):
        words, line = [f"d{k}w{i}" for i in range(300)], " ".join(f"d{k}l{i}" for i in range(20))
        rows += [(2 * k, " ".join(words) + (" " + line) * 2), (2 * k + 1, " ".join(words) + (" " + line) * 40)]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(make(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(80)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (7, 7), (None, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def test_quality_rules(spark, rows):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = rules.quality_rules(make(spark, rows), labels).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        w = WORDS.findall(t)
        three = list(zip(w, w[1:], w[2:], strict=False))
        n = collections.Counter(three)
        inside = {k + j for k, x in enumerate(three) if n[x] > 1 for j in range(3)}
        ls = [x for x in t.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
    assert rules.quality_rules(make(spark, []), labels).count() == 0


def test_token_counts(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    path = places.path("byte_bpe_50k.json")
    known = tokenizers.Tokenizer.from_file(path)
    r = random.Random(3)
    more = [(1000 + k, "".join(r.choice("abc dé日<|>\n1'st") for _ in range(r.randint(0, 200)))) for k in range(200)]
    every = [*rows, *more, (2000, "a<|endoftext|>b <|endoftext|>"), (2001, "z" * 900)]
    got = {x.doc_id: x for x in tokens.token_counts(make(spark, every), path).collect()}
    for i, t in every:
        n = len(known.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)


def test_personal_data_patterns():
    dot = r"(\.[0-9]+)"
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", rf"[0-9]+{dot}{dot}{dot}", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
    digits = lambda s: re.sub("[^0-9]", "", s)
    r = random.Random(9)
    for _ in range(5000):
        t = "".join(r.choice("a1.@+ -(2)%0") for _ in range(r.randint(0, 60)))
        want = [[m.span() for m in email.finditer(t)], [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))], [m.span() for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))], [m.span() for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]]
        assert pii.base_spans(t) == want


def test_personal_data_field(spark):
    rows = [(1, "call (784) 555-9263 or a.b@c.org now"), (2, None), (3, "plain text\nof 2 lines"), (None, "+1 (784) 555-9263")]
    got = {r.doc_id: r for r in pii.find_personal_data(make(spark, rows)).collect()}
    assert got[1].spans == "email:23:32,phone:5:19" and got[1].n_phone == 0
    assert got[2].spans == got[3].spans == "" and got[None].spans == "phone:0:17"


def test_quality_model_held_out(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["one", "two", "three", "four", "five", "six", "seven"]) + str(r.randint(0, 50)) for _ in range(60))
    docs = [(i, good() if i % 2 else " ".join(x + "!!" for x in good().upper().split())) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = quality_model.quality_scores(make(spark, [*docs, (9999, None)]), labels).collect()
    test = [x for x in got if x.held_out and x.doc_id < 600]
    assert len(test) > 80 and np.mean([x.predicted == x.doc_id % 2 for x in test]) > 0.97
    assert all(0 <= x.score <= 1 for x in got) and len(got) == 601


def test_license_scan(spark):
    rows = [(1, "A\nLicensed under CC BY-NC 4.0.\nMIT  license"), (2, None), (3, "accc by mitt license"), (4, "redistribution and use in source and binary forms, with or without modification, are permitted provided the following conditions are met")]
    got = {r.doc_id: r for r in licenses.license_scan(make(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].n_words) == (2, 3, 8, "cc-by,mit", 10)
    assert "cc-by-nc-4.0" in got[1].labels and got[1].score == 1.0
    assert got[2].first_word is None and got[3].n_base == 0 and got[4].labels == "bsd" and got[4].score > 0.9


def test_license_join_is_exact():
    r = random.Random(8)
    names = [f"w{k}" for k in range(40)]
    temps = tuple((" ".join(r.sample(names, r.randint(3, 12))), f"t{k}") for k in range(30))
    join = licenses.Join({w: r.randint(0, 99) for w in names}, temps, 0.8)
    for _ in range(2000):
        block = set(r.sample(names, r.randint(0, 30)))
        want = {x for t, x in temps if len(block & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9}
        assert {x for x, _ in join.block(block)} == want


def test_license_windows_are_exact():
    r = random.Random(9)
    names = [f"w{k}" for k in range(30)]
    temps = tuple((" ".join(r.choices(names, k=r.randint(3, 12))), f"t{k}") for k in range(20))
    join = licenses.Join({w: r.randint(0, 99) for w in names}, temps, 0.8)
    seen = 0
    for _ in range(300):
        words = r.choices(names + ["other"] * 30, k=r.randint(0, 120))
        if r.random() < 0.5:
            words[r.randint(0, len(words)) : 0] = r.choice(temps)[0].split()
        want = {}
        for text, label in temps:
            own, size = set(text.split()), -(-len(text.split()) * 5 // 4)
            best = max((len(own & set(words[i : i + size])) for i in range(len(words))), default=0)
            if best >= 0.8 * len(own) - 1e-9:
                want[label] = best / len(own)
        assert dict(join.windows(words)) == want
        seen += len(want)
    assert seen > 100


def test_license_scan_of_wrapped_notices(spark):
    notices = [
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
        ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
    ]
    rows = [(k, "\n".join(["int x;", *(" * " + line for line in textwrap.wrap(text, 60)), "int y;"])) for k, (_, text) in enumerate(notices)]
    got = {r.doc_id: r for r in licenses.license_scan(make(spark, rows)).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == 1.0 for k, (label, _) in enumerate(notices))


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "If Anna buys 3 kg of apples for 5 dollars how many kg of apples can Anna buy for 20 dollars"), (2, "too short"), (3, None)], "item_id long, text string")
    same = "Well. If Bob buys 7 km of apples for 9 euros how many km of apples can Bob buy for 40 euros in all"
    rows = [(1, same), (2, same.replace("can Bob", "can Carl")), (3, "nothing of the kind"), (4, None), (None, "too short"), (5, same.upper().replace("BOB", "ANNA")), (6, same.lower())]
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(make(spark, rows), bench).collect()) == [(1, 1), (5, 1), (6, 1)]
    assert sorted(r.doc_id or 0 for r in decontam.decontaminate(make(spark, rows), bench).collect()) == [0, 2, 3, 4]


def test_decontamination_of_verbatim_items(spark):
    items = [
        (1, "12 + 7 = 19, 30 - 4 = 26, 5 * 8 = 40, 81 / 9 = 9"),
        (2, "Ask whether Anna Berg, Carl Dorn, Eva Falk, Gus Holm or Ida Jensen met Kurt Lund today"),
        (3, "Please name the largest lake of this old country"),
        (4, "請問這個國家最大的湖泊叫什麼名字以及它有多深"),
        (5, "one of 7 tokens is not enough"),
        (6, "Anna buys apples and pears at the market"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, "Some text here. " + text + " and so on") for k, text in items]
    rows += [(13, "He said, Please name the largest lake of this old country"), (14, "前文" + items[3][1] + "後文"), (16, "So, Bob buys apples and pears at the market"), (20, "12 + 7 = 19 and 30 - 4 = 27")]
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(make(spark, rows), bench).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (13, 3), (14, 4), (16, 6)]


def test_packing(spark):
    rows = [(i, "w " * (i * 37 % 5000)) for i in range(120)] + [(None, None), (7, "a b")]
    df = make(spark, rows)
    got = packing.best_fit_packing(df, packing.word_count(F.coalesce(df["text"], F.lit(""))), rows_per_shard=40).collect()
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.shard, r.bin].append(r)
    for rs in bins.values():
        end = 0
        for r in sorted(rs, key=lambda r: (r.offset, r.n_tokens)):
            assert r.offset == end
            end += r.n_tokens
        assert rs[0].bin_length == min(x for x in packing.LENGTHS if x >= end) and len({r.bin_length for r in rs}) == 1
    assert sum(r.n_tokens for r in got) == sum(i * 37 % 5000 for i in range(120)) + 2
    assert {r.doc_id for r in got} == {*range(120), None}


def test_empty_tables(spark):
    none = make(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (lines.line_dedup(none), suffix.removed_passages(none), simhash.near_duplicates(none), pii.find_personal_data(none), quality_model.quality_scores(none, labels), licenses.license_scan(none), decontam.contaminated(none, bench), packing.best_fit_packing(none, packing.word_count(none["text"]))):
        assert df.count() == 0


def test_keep_bitmaps(spark, rows):
    long = "\n".join("both" if i % 3 else f"own {i}" for i in range(9000))
    every = [*rows, *((1000 + k, f"both\n{k}\n\nboth\nboth") for k in range(12)), (2000, long)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    seen = collections.Counter(k for _, t in every for k in {key(x) for x in (t or "").split("\n")} if k)
    got = {r.doc_id: r for r in lines.line_dedup(make(spark, every)).select("doc_id", "_lines.*").collect()}
    for i, t in every:
        n = [int(x) for x in got[i].keep.split(",")]
        kept = [on for k, size in enumerate(n) for on in [k % 2 == 0] * size]
        assert kept == [not key(x) or seen[key(x)] < 10 for x in (t or "").split("\n")]
        assert all(n[1:])


def test_suffix_arrays_over_units(spark, rows, monkeypatch):
    """Many units of many shards, hot values dealt string by string."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(30)]
    passage = " ".join(r.choice(words) for _ in range(12))
    every = [*rows, *((100 + k, " ".join(r.choices(words, k=40)) + " " + passage + " " + " ".join(r.choices(words, k=40))) for k in range(150)), (None, rows[0][1])]
    for name, value in (("SHARD", 2000), ("RANGE", 4000), ("SPREAD", 500), ("HOT", 5)):
        monkeypatch.setattr(suffix, name, value)
    got = {x.doc_id: x for x in suffix.removed_passages(make(spark, every).repartition(3)).collect()}
    seen = {}
    for i, t in sorted(every, key=lambda x: (x[0] is None, x[0] or 0)):
        b, own = (t or "").encode(), 10**9 if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], own) < own:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest())
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("text_units")]


def test_license_near_misses(spark):
    rows = [(1, "Licensed under CC BY-NC 4.0."), (2, "the code is released under the license"), (3, "released under the bsd license"), (4, "licensed under cc by 4 0"), (5, "Licensed under the MIT license version 2.0"), (6, "This work is licensed under the GNU General Public License, version 2."), (None, "mit license " * 20_000), (7, ""), (7, "Released under the\nMIT License.")]
    got = [(r.doc_id, r.labels) for r in licenses.license_scan(make(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, "cc-by,cc-by-nc-4.0"), (2, ""), (3, ""), (4, "cc-by,cc-by-4.0"), (5, "mit"), (6, "gpl,gpl-2.0"), (None, "mit"), (7, ""), (7, "mit")], key=str)


def test_decontamination_of_short_items_and_repeats(spark):
    bench = spark.createDataFrame([(5, "one of 7 tokens is not enough"), (5, "one of 7 tokens is not enough"), (6, "Find the area of a circle with radius 5"), (7, "so short")], "item_id long, text string")
    rows = [(1, "Some text. One of 7 tokens is not enough, they say"), (2, "one of 8 tokens is not enough"), (3, "he said Find the area of a circle with radius 5 now"), (None, "so short " * 50_000), (3, None), (1, "One of 7 tokens is not enough")]
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(make(spark, rows), bench, shortest=4).collect())
    assert got == [(1, 5), (1, 5), (3, 6)]


def test_decontamination_against_brute_force(spark):
    r = random.Random(21)
    words = [f"word{chr(97 + k)}" for k in range(20)]
    items = [(k, " ".join(r.choices(words, k=r.randint(4, 30)))) for k in range(40)]
    rows = []
    for k in range(200):
        text = r.choices(words, k=r.randint(0, 40))
        if k % 3 == 0:
            own = r.choice(items)[1].split()
            a = r.randint(0, max(0, len(own) - 13))
            text[len(text) // 2 : 0] = own[a : a + r.choice([12, 13, 20, 30])]
        rows.append((k, " ".join(text)))
    want = set()
    for i, t in rows:
        w = t.split()
        for j, x in items:
            own = x.split()
            n = min(13, len(own))
            runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                want.add((i, j))
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(make(spark, rows), spark.createDataFrame(items, "item_id long, text string"), shortest=1).collect()}
    assert got == want and len(want) > 30


def test_packing_chooses_lengths():
    r = np.random.default_rng(5)
    price = lambda w, f: sum(x + packing.OVERHEAD for x in dict(zip(w.tolist(), f.tolist(), strict=True)).values())
    assert [packing.pack(np.array([s]), packing.LENGTHS, 16)[2][0] for s in (1, 500, 900, 3000)] == [512, 512, 1024, 4096]
    less = 0
    for _ in range(60):
        sizes = r.integers(0, 4097, r.integers(1, 8))
        where, offset, final = packing.pack(sizes, packing.LENGTHS, 16)
        joint, longest = price(where, final), price(*packing.pack(sizes, (4096,), 16)[::2])
        assert joint <= longest
        less += joint < longest
        best = 10**9  # every way to put the pieces into bins
        def place(k, bins):
            nonlocal best
            if k == len(sizes):
                best = min(best, sum(min(c for c in packing.LENGTHS if c >= b) + 16 for b in bins))
                return
            for i, b in enumerate(bins):
                if b + sizes[k] <= 4096:
                    place(k + 1, [*bins[:i], b + sizes[k], *bins[i + 1 :]])
            place(k + 1, [*bins, sizes[k]])
        place(0, [])
        assert best <= joint <= 1.4 * best
    assert less  # the guess first written here, over 30 of 60, was wrong: 25 are cheaper


def test_personal_data_field_on_held_out_lines():
    from steplake.llm import pii_labels

    field = pii.Field(pii_labels.training_table())
    table = pii_labels.test_table(400)
    texts = [" ".join(w) for w, _ in table]
    base = [pii.base_spans(t) for t in texts]
    more = pii.added_spans(field, texts, base)
    hit = found = there = 0
    for (words, labels), t, m in zip(table, texts, more, strict=True):
        got = {(k + 1, t[a:b]) for k in range(4) for a, b in m[k]}
        want = {(max(labels), " ".join(w for w, y in zip(words, labels, strict=True) if y).rstrip(".,"))} if any(labels) else set()
        hit, found, there = hit + len(got & want), found + len(got), there + len(want)
    assert hit / found > 0.95 and hit / there > 0.7


def test_quality_scores_are_dot_products():
    r = random.Random(2)
    w = np.random.default_rng(2).normal(size=(1 << quality_model.BITS) + 1)
    batch = [" ".join(r.choices(["a", "b", "c!", "d"], k=r.randint(0, 30))) for _ in range(50)] + ["", " \n"]
    for t, s in zip(batch, quality_model.scores(batch, w), strict=True):
        at, x = quality_model.sparse(quality_model.grams([t])[0])
        assert abs(s - 1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35)))) < 1e-9


def test_quality_ratio_against_a_plain_loop(spark):
    r = random.Random(13)
    docs = [(i, " ".join(r.choices([f"g{k}" for k in range(40)] if i % 2 else [f"b{k}" for k in range(40)], k=80))) for i in range(40)] + [(None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in rules.quality_rules(make(spark, docs), labels).collect()}
    bad, good = [got[i].ratio for i in range(0, 40, 2)], [got[i].ratio for i in range(1, 40, 2)]
    assert max(bad) < min(good) and got[None].ratio == 0 and not got[None].kept
    assert all(got[i].kept for i in range(1, 40, 2)) or got[1].base_failed


def test_operators_over_nulls_and_repeats(spark):
    rows = [(None, None), (None, "x y z"), (1, "x y z"), (1, "x y z"), (2, ""), (2, None)]
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    for got in (quality_model.quality_scores(make(spark, rows), labels), rules.quality_rules(make(spark, rows), labels), simhash.near_duplicates(make(spark, rows)), licenses.license_scan(make(spark, rows)), pii.find_personal_data(make(spark, rows)), suffix.removed_passages(make(spark, rows)), lines.line_dedup(make(spark, rows))):
        assert got.count() == len(rows)


def test_recall_of_similar_documents(spark):
    """600 pairs of similarity 0.80 to 0.85 and 200 of 0.75 to 0.80, of 20 to 1,200 words, some with repeated lines."""
    r = random.Random(31)
    names = [f"w{k}" for k in range(5000)]

    def shingles(w):
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    rows, want, left = [], [], {True: 600, False: 200}
    while any(left.values()):
        size = r.choice([20, 60, 150, 400, 1200])
        base = r.choices(names, k=size)
        if r.random() < 0.3:
            base += base[:12] * r.randint(1, 6)
        other = list(base)
        for _ in range(r.randint(1, max(1, size // 30))):
            other[r.randrange(len(other))] = r.choice(names)
        x, y = shingles(base), shingles(other)
        like = len(x & y) / len(x | y)
        if 0.75 <= like <= 0.85 and left[like >= 0.8]:
            left[like >= 0.8] -= 1
            rows += [(2 * len(want), " ".join(base)), (2 * len(want) + 1, " ".join(other))]
            want.append(like >= 0.8)
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(make(spark, rows)).collect()}
    found = [got[2 * k + 1] == got[2 * k] for k in range(len(want))]
    hit = sum(f and w for f, w in zip(found, want, strict=True))
    print(f"recall {hit} of 600")
    assert hit >= 594 and not any(f and not w for f, w in zip(found, want, strict=True))


def test_stored_tables_have_few_files(spark, monkeypatch):
    """However many shuffle partitions there are, and with a hot key in many cells."""
    monkeypatch.setattr(simhash, "MOST", 10)
    paths = []
    monkeypatch.setattr(common, "noted", lambda path, *_, **__: paths.append(path))
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"own{i}", "same line\nother"])) for i in range(60)] + [(60 + i, " ".join(f"d{i}w{k}" for k in range(100))) for i in range(20)]
    docs, items = make(spark, rows), spark.createDataFrame([(1, " ".join(f"d3w{k}" for k in range(40)))], "item_id long, text string")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert {r._lines.n_dropped for r in lines.line_dedup(docs).filter("doc_id < 60").collect()} == {1}
        assert {r.doc_id for r in simhash.drop_near_duplicates(docs, 5, similarity=0.8).collect()} == {0, *range(60, 80)}
        assert {r.component_id for r in simhash.near_duplicates(docs).collect()} >= set(range(60, 80))
        assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(63, 1)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [sum(f.startswith("part-") for f in os.listdir(re.sub("^file:/+", "/", p))) for p in paths]
    assert len(files) > 20 and max(files) <= 2 * spark.sparkContext.defaultParallelism
