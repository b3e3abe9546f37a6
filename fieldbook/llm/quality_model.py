"""Quality by attention-based multiple-instance learning.

A text is a bag of passages.  Each passage is encoded as fixed-length features: hashed byte pairs that
say how it is written, and shape figures (kinds of characters, word lengths, repetition).  Gated
attention, w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted passage is scored.  Only
the labels of whole texts train it, by gradient descent on a bounded sample of labelled rows
(TRAIN_ROWS, the first by hash); scoring runs over all rows in tasks.

Defined cases: a null or empty text is one passage without content and gets the model's score for it;
labels that are null or that fall in the held-out fold are not learned from; of several labels of a
row each counts; without any label, or with one kind only, every score is the share of label 1 (0.5
without any); texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.llm.common import text_chunks

#: Bytes of a passage.
PASSAGE = 512
#: Cells of hashed byte pairs.
CELLS = 64
SHAPES = 14
WIDTH = CELLS + SHAPES
#: Labelled rows that the model is fitted on at most, and bytes of their texts (features on the driver take 0.6 times as many, twice).
TRAIN_ROWS = 4000
TRAIN_BYTES = 256_000_000

_KIND = np.zeros(256, np.int64)  # lower letters and bytes beyond ASCII
for _set, _k in ((range(65, 91), 1), (range(48, 58), 2), ((32, 9, 13), 3), ((10,), 4), (map(ord, ".,;:'\"?-()"), 5), (map(ord, "#*$%&|<>!@_=+{}[]^~\\/`"), 6)):
    for _c in _set:
        _KIND[_c] = _k
_KIND[:9] = _KIND[14:32] = 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages, index of the first passage of each row and the end)."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n)])
    total = int(first[-1])
    row = np.repeat(np.arange(len(sizes)), n)
    inside = np.arange(total) - first[row]
    of_byte = np.repeat(first[:-1], sizes) + (np.arange(len(data)) - np.repeat(offsets[:-1], sizes)) // PASSAGE
    length = np.bincount(of_byte, minlength=total).astype(float)
    safe = np.maximum(length, 1)
    kind = _KIND[data]
    kinds = np.bincount(of_byte * 8 + kind, minlength=total * 8).reshape(total, 8) / safe[:, None]
    pair_cell = ((data[:-1].astype(np.uint32) << 8 | data[1:]) * np.uint32(2654435761) >> np.uint32(26)).astype(np.int64) if len(data) > 1 else np.zeros(0, np.int64)
    same = of_byte[1:] == of_byte[:-1]
    pairs = np.bincount(of_byte[1:][same] * CELLS + pair_cell[same], minlength=total * CELLS).reshape(total, CELLS) / safe[:, None]
    # repetition: how few different hashed runs of six bytes a passage holds
    if len(data) > 6:
        run = np.zeros(len(data) - 5, np.uint64)
        for k in range(6):
            run = run * np.uint64(1099511628211) + data[k : len(data) - 5 + k]
        at = of_byte[: len(run)]
        inner = at == of_byte[5:]
        slot = (run >> np.uint64(20)).astype(np.int64) & 1023
        seen = np.bincount(np.unique(at[inner] * 1024 + slot[inner]) // 1024, minlength=total)
        distinct = seen / np.maximum(1, np.bincount(at[inner], minlength=total))
    else:
        distinct = np.zeros(total)  # as in a chunk with longer rows
    gaps = kinds[:, 3] + kinds[:, 4]
    shapes = np.column_stack([kinds * 4, distinct, gaps, np.where(gaps > 0, np.minimum(1 / np.maximum(gaps, 1e-3), 40) / 10, 4), np.log1p(length) / 7, np.log1p(sizes[row]) / 12, inside == 0])
    return np.column_stack([pairs * 8, shapes]).astype(np.float32), first


class Attention:
    """Gated attention over a row's passages and a logistic score of their weighted mean."""

    def __init__(self, width: int = WIDTH, hidden: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"V": r.normal(0, 0.2, (width, hidden)), "U": r.normal(0, 0.2, (width, hidden)), "w": r.normal(0, 0.2, hidden), "E": r.normal(0, 0.2, (width, hidden)), "e": np.zeros(hidden), "b": r.normal(0, 0.2, hidden), "c": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p = self.p
        h = (x - self.mean) / self.scale
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = np.clip((t * g) @ p["w"], -30, 30)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), np.diff(first)))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), np.diff(first))
        z = np.maximum(h @ p["E"] + p["e"], 0)
        bag = np.add.reduceat(a[:, None] * z, first[:-1])
        s = 1 / (1 + np.exp(-np.clip(bag @ p["b"] + p["c"][0], -30, 30)))
        return h, t, g, a, z, bag, s

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.constant) if self.constant is not None else self.forward(x, first)[-1]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy of the rows, by each parameter."""
        h, t, g, a, z, bag, s = self.forward(x, first)
        rep = lambda q: np.repeat(q, np.diff(first), axis=0)
        d = (s - y) * weight / len(y)
        dbag = d[:, None] * self.p["b"]
        dz = a[:, None] * rep(dbag) * (z > 0)
        da = (z * rep(dbag)).sum(1)
        da = a * (da - rep(np.add.reduceat(a * da, first[:-1])))
        dtg = da[:, None] * self.p["w"]
        return {"b": bag.T @ d, "c": np.array([d.sum()]), "E": h.T @ dz, "e": dz.sum(0), "w": (t * g).T @ da, "V": h.T @ (dtg * g * (1 - t * t)), "U": h.T @ (dtg * t * g * (1 - g))}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> Attention:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.05
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels count alike
        m, v, step = {k: 0 * x for k, x in self.p.items()}, {k: 0 * x for k, x in self.p.items()}, 0
        r = np.random.default_rng(11)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                x = np.concatenate([bags[k] for k in chosen])
                first = np.concatenate([[0], np.cumsum([len(bags[k]) for k in chosen])])
                grad = self.gradient(x, first, y[chosen], weight[chosen])
                step += 1
                for k, q in self.p.items():
                    q_grad = grad[k] + decay * q
                    m[k] = 0.9 * m[k] + 0.1 * q_grad
                    v[k] = 0.999 * v[k] + 0.001 * q_grad**2
                    q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Attention:
    """A model of at most train_rows labelled rows, half of them for each label where there are as many; every passage counts.

    Rows are taken in the order of a hash; the first of each label that together have half of train_bytes at most stay.
    An id with unlike texts gives one of them, the least.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    order = F.xxhash64(F.lit("sample"), F.col("id"))
    marked = marked.where("y = 1").orderBy(order).limit(train_rows // 2).unionByName(marked.where("y = 0").orderBy(order).limit(train_rows // 2))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # train_rows rows at most
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    sizes = rows.select("id", "y", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    so_far = F.sum("n").over(W.partitionBy("y").orderBy(F.xxhash64(F.lit("sample"), F.col("id")), "id"))  # train_rows numbers at most
    chosen = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= train_bytes // 2).select("id", "y")
    rows = rows.join(F.broadcast(chosen), ["id", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                x, first = passages(data, offsets)
                out = [x[first[k] : first[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(out, pa.binary())], names=["id", "y", "bag"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("id", "text", "y").mapInArrow(run, f"id {kind}, y int, bag binary").toArrow().sort_by([("id", "ascending"), ("y", "ascending")])
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in found["bag"].to_pylist()]
    return Attention().fit(bags, found["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages, attention: the greatest weight) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                x, first = passages(data, offsets)
                s = shared.value.score(x, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s.astype(float)), pa.array(np.diff(first), pa.int32())], names=["id", "score", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, passages int").withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the query: fold 1 of 3 is held out."""
    model = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")
