"""Language identification with error-correcting output codes.

Each language has a codeword of bits; each bit has a binary classifier over hashed byte n-grams (naive
Bayes: the log ratio of how often a gram occurs in the languages on either side, each language counting
alike).  A text's margins are decoded to the codeword of least logistic loss; a small gap between the
best two flags ambiguity.  Gram counts come from all the training rows, added up in tasks first.

Defined cases: a null text or one without a letter is `und` with score 0; without any training row
every text is `und`; a text of one training language scores 1; repeated rows count as often as they
occur; texts of any length are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import column, small_batches, text_chunks

#: Cells that trigrams of bytes are hashed to.
CELLS = 1 << 14
#: Added to each count.
SMOOTH = 0.5
#: Gap of mean loss between the best two codewords below which a text is ambiguous.
GAP = 0.02
#: Grams from which a text's evidence is full.
FULL = 200.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each gram, end offsets of the rows in them): trigrams of the lower-cased bytes, a blank before each row."""
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    shift = np.arange(len(data)) + np.repeat(2 * np.arange(1, n + 1), np.diff(offsets))
    padded[shift] = _LOWER[data]
    p = padded.astype(np.uint32)
    code = (p[:-2] << 16) | (p[1:-1] << 8) | p[2:] if len(p) > 2 else np.zeros(0, np.uint32)
    cells = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)  # 14 bits
    starts = offsets[:-1] + 2 * np.arange(n)
    ends = np.maximum(starts, np.minimum(offsets[1:] + 2 * np.arange(1, n + 1) - 2, len(cells)))
    return cells, np.stack([starts, ends])


def codewords(k: int) -> np.ndarray:
    """k codewords of -1 and 1: all splits of up to six languages, else random ones that lie far apart."""
    if k <= 6:
        splits = [c for c in itertools.product((-1, 1), repeat=k - 1) if -1 in c]
        return np.array([[1, *c] for c in splits], np.int8).T
    bits, best, most = int(np.ceil(12 * np.log2(k))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (k, bits))
        code = code[:, np.abs(code.sum(0)) < k]
        away = code.shape[1] - code.astype(int) @ code.T.astype(int)
        np.fill_diagonal(away, 1 << 20)
        if away.min() > most:
            best, most = code, away.min()
    return best


def gram_counts(docs: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(lang, cell, n) over all rows; each task hands on one row for a language and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for i, j, data, offsets in text_chunks(batch.column(0)):
                cells, (starts, ends) = grams(data, offsets)
                names = sorted(set(langs[i:j]))
                number = {x: k for k, x in enumerate(names)}
                of_row = np.array([number[x] for x in langs[i:j]], np.int64)
                sizes = ends - starts
                at = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
                n = np.bincount(np.repeat(of_row, sizes) * CELLS + cells[at], minlength=len(names) * CELLS).reshape(-1, CELLS)
                for k, x in enumerate(names):
                    total[x] = total.get(x, 0) + n[k]
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("lang")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages by cells."""
        self.langs = langs
        self.code = codewords(len(langs)) if len(langs) > 1 else np.ones((len(langs), 0), np.int8)
        p = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * counts.shape[1])
        sides = [(np.log(p[c > 0].mean(0)) - np.log(p[c < 0].mean(0))) for c in self.code.T]
        self.weights = np.array(sides, np.float32).T if sides else np.zeros((CELLS, 0), np.float32)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Mean logistic loss of each row's margins against each codeword; sure bits weigh more."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None].astype(float))
        weight = np.abs(margins) + 1e-6
        return (loss * weight[:, None, :]).sum(2) / weight.sum(1)[:, None]


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> Model:
    """A model of the rows whose label is not null.  Languages times CELLS numbers reach the driver."""
    rows = gram_counts(docs, text_col, label_col).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    number = {x: k for k, x in enumerate(langs)}
    counts = np.zeros((len(langs), CELLS))
    if langs:
        counts[[number[x] for x in rows["lang"].to_pylist()], rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score, ambiguous) of each row; with columns to keep, the id as _id and these as _k0, _k1 and so on before the last three."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times CELLS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits, by_bit = m.weights.shape[1], np.ascontiguousarray(m.weights.T)
        for batch in batches:
            text_at, lettered_at = batch.schema.get_field_index("_text"), batch.schema.get_field_index("_lettered")
            lettered_all = np.array([bool(x) for x in batch.column(lettered_at).to_pylist()], bool)
            for i, j, data, offsets in text_chunks(batch.column(text_at)):
                lettered = lettered_all[i:j] & bool(m.langs)
                best, score, unsure = np.zeros(j - i, int), np.zeros(j - i), np.ones(j - i, bool)
                if bits and lettered.any():
                    cells, (starts, ends) = grams(data, offsets)
                    n, sums, total = np.maximum(ends - starts, 1), np.empty((j - i, bits)), np.zeros(len(cells) + 1)
                    for b in range(bits):  # one bit at a time: what a chunk takes does not grow with the code
                        np.cumsum(by_bit[b][cells], dtype=np.float64, out=total[1:])
                        sums[:, b] = total[ends] - total[starts]
                    mean = sums / n[:, None]
                    loss = m.losses(mean * np.minimum(n, FULL)[:, None])
                    two = np.sort(loss, 1)[:, :2]
                    best = loss.argmin(1)
                    gap = two[:, 1] - two[:, 0]
                    score = 1 / (1 + np.exp(-np.minimum(gap, 30)))
                    unsure = gap < GAP
                elif m.langs:
                    score, unsure = np.ones(j - i), np.zeros(j - i, bool)
                names = [m.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)]
                columns = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns) if c not in (text_at, lettered_at)]
                kept = [n for n in batch.schema.names if n not in ("_text", "_lettered")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(unsure | ~lettered)], names=[*kept, "lang_pred", "score", "ambiguous"])

    has_letter = F.coalesce(column(text_col).rlike(r"\p{L}"), F.lit(False))
    chosen = docs.select(column(id_col).alias("_id"), *[column(c).alias(f"_k{k}") for k, c in enumerate(keep)], column(text_col).alias("_text"), has_letter.alias("_lettered"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name not in ("_text", "_lettered"))
    out = chosen.mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("_id", id_col) if not keep else out


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query: fold 2 of 4 is held out."""
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def accepted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is told; `und` and ambiguous ones go."""
    told = predict(docs, model, id_col, text_col, tuple(docs.columns)).where("lang_pred <> 'und' and not ambiguous")
    return told.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(docs.columns)])
