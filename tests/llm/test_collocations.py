"""Collocations against brute force, and the trie with small bounds."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldbook.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n\v\f\r]", (text or "").translate(LOWER))]


def grams(text, n):
    return [tuple(p[i : i + n]) for p in pieces(text) for i in range(len(p) - n + 1)]


def brute(docs, least=10, share=50, k=2000):
    f = {}
    for lang, text in docs:
        for n in (1, 2, 3):
            for g in grams(text, n):
                f.setdefault(lang or "und", Counter())[g] += 1
    out = []
    for lang, counts in f.items():
        total, rows = sum(n for g, n in counts.items() if len(g) == 1), []
        candidates = {g: n for g, n in counts.items() if len(g) > 1 and n >= least}
        for g, a in candidates.items():
            if len(g) == 2 and any(len(o) == 3 and g in (o[:2], o[1:]) and 100 * b >= share * a for o, b in candidates.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[g[:c]] * counts[g[c:]]), c, counts[g[:c]], counts[g[c:]]) for c in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        out.extend((lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:k]))
    return sorted(out)


def made(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "a\x1fb", "é", "x-1", "日本", *[f"w{i}" for i in range(30)]]
    out = []
    for i in range(n):
        text = "".join((r.choice(words) if r.random() < 0.7 else "New York City") + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.choice((0, 1, 5, 60))))
        out.append((("en", "de", None)[i % 3], text))
    return out


@pytest.mark.parametrize(("least", "share", "k"), [(10, 50, 2000), (2, 90, 7)])
def test_collocations_against_brute_force(spark, least, share, k):
    docs = [*made(1, 150), ("fr", None), ("fr", ""), (None, "..."), ("it", "uno"), ("en", "hot word " * 3000), ("en", "hot word " * 3000)]
    table = spark.createDataFrame(docs, "lang string, text string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS tail").repartition(3)
    got = C.collocations(table, least=least, share=share, k=k)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, least, share, k)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert C.collocations(empty).collect() == []


def test_products_beyond_64_bits(spark):
    a, n = 3_000_000_000, 4_000_000_000
    t = spark.sql(f"SELECT {a}L AS a, {n}L AS l, {n}L AS r")
    assert t.select(C.score_of("l", "r")).first()[0] == 1_000_000 * a * a // (n * n)


@pytest.mark.parametrize("length", [2, 3])
def test_tries_that_burst_and_spill(monkeypatch, length):
    monkeypatch.setattr(C, "BURST", 4)
    monkeypatch.setattr(C, "HELD", 60)
    docs = [(g or "und", t) for g, t in made(2, 60)]
    full = C.BitMap(np.full(1 << (C.MAP_BITS - 6), 2**64 - 1, np.uint64))
    followers = Counter(" ".join(g[:2]) for lang, text in docs if lang == "en" for g in set(grams(text, 3)))
    common = ("en", followers.most_common(1)[0][0])
    hot = frozenset([common, ("de", "no such")])
    counter, got, places, spills = C.Counter(length, [full] * (length - 1), 16, hot), Counter(), {}, 0

    def take(rows):
        for part, langs, run in rows:
            assert 0 <= part < 16
            for line in run.split("\n"):
                at, prefix, tail, *n = line.split("\t")
                lang = langs[int(at)]
                got[lang, prefix, tail] += int(n[0]) if n else 1
                assert places.setdefault((lang, prefix, tail), part) == part

    for lang, text in docs:
        counter.take(lang, [text])
        counter.settle()
        if counter.held > C.HELD:
            take(counter.spill(False))
            spills += 1
            assert counter.held <= C.HELD // 2
        assert counter.held == sum(C.size(x.trie) for x in counter.langs.values())
    take(counter.spill(True))
    assert spills > 3 and counter.held == 0
    want = Counter((lang, " ".join(g[:-1]), g[-1]) for lang, text in docs for g in grams(text, length))
    if length == 2:
        want.update((lang, g[0], "") for lang, text in docs for g in grams(text, 1))
        want.update((lang, "", "") for lang, text in docs for _ in grams(text, 1))
    else:
        of = {}
        for (lang, prefix, _), part in places.items():
            of.setdefault((lang, prefix), set()).add(part)
        assert len(of[common]) > 1 and all(len(x) == 1 for k, x in of.items() if k != common)
    assert got == want


def test_one_place_by_both_ways():
    words = [b"a", "日本".encode(), b"x" * 90]
    hashes = np.array([C.word_hash(w) for w in words], np.uint64)
    cells = np.zeros(1 << (C.MAP_BITS - 6), np.uint64)
    for p in C.phrase_bits("en", [hashes[:2]]):
        cells[p >> np.uint64(6)] |= np.uint64(1) << (p & np.uint64(63))
    found = [C.BitMap(cells).has_word(C.word_hash(b"en"), int(h)) for h in hashes]
    assert found[:2] == [True, True] and found == C.BitMap(cells).has(C.phrase_bits("en", [hashes])).tolist()
