"""Ranked search against brute force: ties, nulls, repeated rows, small blocks and several groups of items."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldbook.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    total, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    out = []
    for item_id, text in items:
        scores = Counter()
        for t in set(terms(text)):
            df = sum(1 for _, b in bags if t in b)
            w = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
            for row, (_, b) in enumerate(bags):
                if t in b:
                    scores[row] += w * ((1000000000 * b[t]) // (1000 * b[t] + 8 * (100 - 90 + (90 * b.total() * total) // length)))
        best = sorted(((-s, bags[row][0] is not None, bags[row][0]) for row, s in scores.items() if s > 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        out.extend((item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(best))
    return Counter(out)


def made(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["Über", "straße", "x9"]
    return [(i * 7 % 1009, " ".join(r.choice(vocabulary) for _ in range(r.choice((0, 1, 3, 40, 200))))) for i in range(n)]


@pytest.mark.parametrize(("cells", "opened", "item_terms"), [(2_000_000, 256, 1_000_000), (150, 2, 40)])
def test_search_against_brute_force(spark, monkeypatch, cells, opened, item_terms):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "OPENED", opened)
    monkeypatch.setattr(R, "ITEM_TERMS", item_terms)
    docs = [*made(1, 150), *[(2000 + i, "copy of W1 w2 w3") for i in range(40)], (5000, None), (5001, ""), (None, "w1 w2 straße"), (None, None), (5002, "ÜBER über Über"), (5003, "w1 " * 4000), (7, "w2 w3"), (7, "w2 w3")]
    items = [(1, "w1 w2 w3 w3"), (2, "Über STRASSE straße"), (3, None), (4, ""), (5, "unknown words"), (6, "w1"), (6, "w5 w9 x9"), (None, "w2"), *[(10 + i, t[:90]) for i, (_, t) in enumerate(made(2, 12))]]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "'x' AS terms").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS terms", "2 AS score")
    got = R.search(d, i)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, items)


def test_empty_tables_and_ids_of_text(spark):
    d = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "doc_id string, text string")
    i = spark.createDataFrame([("x", "one")], "item_id string, text string")
    assert R.search(d.where("false"), i).collect() == [] and R.search(d, i.where("false")).collect() == []
    assert [r.doc_id for r in R.search(d, i, k=2).orderBy("rank").collect()] == [None, "a"]


def test_treap_against_a_full_scan():
    r = np.random.default_rng(3)
    for n_rows, n_cols in ((1, 1), (3, 70), (200, 5), (40, 300)):
        cells = np.unique(r.integers(0, n_rows * n_cols, n_rows * n_cols // 2 + 1))
        rows, cols, values = cells // n_cols, cells % n_cols, r.integers(1, 6, len(cells))
        treap, grid = R.Treap(rows, cols, values, n_cols), np.zeros((n_rows, n_cols), np.int64)
        grid[rows, cols] = values
        for _ in range(20):
            asked = np.unique(r.integers(0, n_rows, 4))
            weights = r.integers(1, 9, len(asked))
            scores = weights @ grid[asked]
            want = [(int(scores[c]), int(c)) for c in np.lexsort((np.arange(n_cols), -scores))[:10] if scores[c]]
            assert treap.search(asked, weights, 10, []) == want
