"""Scores of the classifiers, row by row in plain Python, against what the tasks compute for many rows at once."""

import math
import random

import numpy as np
import pytest

from fieldbook.llm import language_id, quality_model

TEXTS = [None, "", "a", "abc", "Éé", "12 34", "short words and more", "the same " * 90, "x" * 511, "y" * 512, "z" * 513, "word, Word. 12\n\n#$% " * 300]


def made(seed, n, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 8))) for _ in range(n))


def plain_language(model, text):
    """(language, score) by adding up one gram at a time."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    padded, sums = b"  " + data, [0.0] * model.code.shape[1]
    for i in range(len(data)):
        code = padded[i] << 16 | padded[i + 1] << 8 | padded[i + 2]
        cell = (code * 2654435761 & 0xFFFFFFFF) >> 18
        for b in range(len(sums)):
            sums[b] += float(model.weights[cell, b])
    margins = [s / len(data) * min(len(data), language_id.FULL) for s in sums]
    total = sum(abs(m) + 1e-6 for m in margins)
    losses = [sum(math.log1p(math.exp(-m * c)) * (abs(m) + 1e-6) if -m * c < 700 else -m * c * abs(m) for m, c in zip(margins, word.tolist(), strict=True)) / total for word in model.code]
    first, second = sorted(losses)[:2]
    return model.langs[losses.index(first)], 1 / (1 + math.exp(-min(second - first, 30)))


@pytest.mark.parametrize("k", [2, 3, 8])
def test_languages_against_plain_decoding(spark, k):
    alphabets = ["abcde", "defgh", "hijkl", "éèàç", "опрст", "mnopq", "rstuv", "wxyzß"][:k]
    train = spark.createDataFrame([(made(100 * i + j, 40, a), f"l{i}") for i, a in enumerate(alphabets) for j in range(6)], "text string, lang string")
    model = language_id.fit(train)
    texts = TEXTS + [made(i, n, alphabets[i % k] + alphabets[(i + 1) % k][: i % 4]) for i, n in enumerate([1, 2, 5, 30, 200] * 4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for i, t in enumerate(texts):
        lang, score = plain_language(model, t)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-5)


def plain_features(text):
    """Features of each passage of one text, counted byte by byte."""
    data, out = (text or "").encode(), []
    for p in range(max(1, -(-len(data) // quality_model.PASSAGE))):
        part = data[p * quality_model.PASSAGE : (p + 1) * quality_model.PASSAGE]
        size = max(len(part), 1)
        kinds, pairs, runs, n_runs = [0] * 8, [0] * quality_model.CELLS, set(), 0
        for i, b in enumerate(part):
            kinds[int(quality_model._KIND[b])] += 1
            if i + 1 < len(part):
                pairs[((b << 8 | part[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 26] += 1
            if i + 6 <= len(part):
                h = 0
                for c in part[i : i + 6]:
                    h = (h * 1099511628211 + c) % 2**64
                runs.add(h >> 20 & 1023)
                n_runs += 1
        gaps = (kinds[3] + kinds[4]) / size
        shapes = [*(4 * x / size for x in kinds), len(runs) / max(1, n_runs), gaps, min(1 / max(gaps, 1e-3), 40) / 10 if gaps > 0 else 4, math.log1p(len(part)) / 7, math.log1p(len(data)) / 12, float(p == 0)]
        out.append([8 * x / size for x in pairs] + shapes)
    return out


def plain_score(model, text):
    p, hs = model.p, [[(v - m) / s for v, m, s in zip(f, model.mean, model.scale, strict=True)] for f in plain_features(text)]
    dot = lambda h, w: [sum(x * row[j] for x, row in zip(h, w, strict=True)) for j in range(len(w[0]))]
    v, u, e = (p[k].tolist() for k in "VUE")
    attention, values = [], []
    for h in hs:
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(dot(h, v), dot(h, u), strict=True)]
        attention.append(math.exp(max(-30, min(30, sum(a * b for a, b in zip(gate, p["w"], strict=True))))))
        values.append([max(0.0, a + b) for a, b in zip(dot(h, e), p["e"], strict=True)])
    bag = [sum(a * x[j] for a, x in zip(attention, values, strict=True)) / sum(attention) for j in range(len(values[0]))]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(bag, p["b"], strict=True)) + p["c"][0]))))


def test_quality_against_plain_scoring(spark):
    r = np.random.default_rng(1)
    bags = [np.array(plain_features(made(i, 80, "abcdefgh" if i % 2 else "a#b$ 1")), np.float32) for i in range(12)]
    model = quality_model.Attention().fit(bags, np.arange(12) % 2.0, epochs=3)
    model.p = {k: x + r.normal(0, 0.05, x.shape) for k, x in model.p.items()}
    texts = TEXTS + [made(i, n, "abcd é#") for i, n in enumerate((3, 200, 900))]
    for parts in (1, len(texts)):  # a row's score is its own, whatever else its task holds
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
        got = {x.doc_id: x.score for x in quality_model.score(docs, model).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(plain_score(model, t), abs=2e-3)


def test_training_texts_are_bounded_by_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, made(i, 60, "abcdefgh" if i % 2 else "a#b$ 1")) for i in range(40)] + [(100, "ab " * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(100, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_model.Attention, "fit", lambda self, bags, y, *a: seen.append((sum(map(len, bags)), len(y), float(y.sum()))) or self)
    quality_model.fit(docs, labels)
    quality_model.fit(docs, labels, train_bytes=8000)
    quality_model.fit(docs, labels, train_rows=6)
    (passages, rows, good), (few, less, fewer), (_, six, three) = seen
    assert rows == 41 and good == 21 and passages > 586 and few * quality_model.PASSAGE < 16_000 and 0 < fewer < less < 40 and (six, three) == (6, 3)
