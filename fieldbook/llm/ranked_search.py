"""Ranked lexical search with K2-treaps over the grid of terms and documents.

Documents are searched in blocks.  A block's grid has a row for each query term and a column for each
document, in the order of their ids; a cell holds the impact of the term in the document, a whole
number.  The grid is a quadtree: a node has the largest impact below it and four bits that say which
quarters hold cells; the nodes of a level lie one after another, so a child is found by counting bits,
and empty quarters cost nothing.

An item descends the rows of its terms together over ranges of documents, the best first: a range's
bound is the sum, over the item's terms, of weight times the impact at the term's node of that range;
at a single document it is the score.  Ranges that cannot come before the tenth best so far are left,
and that tenth best is carried from block to block within a task.  A task so hands on ten documents an
item, and the ten best of these are the result.  Nothing is approximate.

Term counts of the documents are written once, in rows of small numbers, for the statistics and then
for the search.  Items are the query set; they go to every task in groups of ITEM_TERMS terms, and
further groups are further passes.

Defined cases: null and empty texts have no terms, count for nothing and are never found, and items
without terms (or none known) find nothing; equal scores go by ascending id, a null id first; rows of
one doc_id are ranked each, and rows of one item_id answer each; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.llm.common import column, materialise, small_batches, string_chunks
from fieldbook.llm.words import words

#: Terms of the items that are searched in one pass (all are in the memory of every task and of the driver).
ITEM_TERMS = 1_000_000
#: Cells of a block, ranges that are opened at once.
CELLS = 2_000_000
OPENED = 256
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Place of a quarter's child among the children, by the node's bits; -1 where it has none.
_CHILD = np.array([[bin(m & ((1 << q) - 1)).count("1") if m >> q & 1 else -1 for q in range(4)] for m in range(16)], np.int8)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32, each with a zero before it."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(keep)
    return x


class Treap:
    """The quadtree of cells (row, column, value), no cell twice."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_columns: int):
        self.height = max(int(rows.max()), n_columns - 1, 1).bit_length()
        code = spread(rows) << np.uint64(1) | spread(columns)
        order = np.argsort(code)
        code, top = code[order], values[order]
        levels = [(top, np.zeros(len(top), np.uint8), np.zeros(len(top), np.int64))]
        for _ in range(self.height):
            quarter = np.left_shift(1, (code & np.uint64(3)).astype(np.uint8), dtype=np.uint8)
            code = code >> np.uint64(2)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            top, code = np.maximum.reduceat(top, starts), code[starts]
            levels.append((top, np.bitwise_or.reduceat(quarter, starts), starts))
        levels.reverse()
        below = np.cumsum([len(x[0]) for x in levels])
        self.top = np.concatenate([x[0] for x in levels])
        self.mask = np.concatenate([x[1] for x in levels])
        self.first = np.concatenate([x[2] + n for x, n in zip(levels, below, strict=True)])

    def children(self, nodes: np.ndarray, quarters: np.ndarray) -> np.ndarray:
        """The nodes' children in these quarters, -1 for none; a node of -1 has none."""
        place = _CHILD[self.mask[nodes], quarters]
        return np.where((nodes >= 0) & (place >= 0), self.first[nodes] + place, -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """The k best (score above 0, column), the highest and then the lowest column first, of this grid and what came before."""
        shift = self.height - 1
        nodes, at, level = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(weights.sum()) * int(self.top[0])])
        while len(bound):
            keep = bound > 0
            if len(best) == k:
                score, last = best[-1]
                keep &= (bound > score) | ((bound == score) & (at < last))
            nodes, at, level, bound = nodes[keep], at[keep], level[keep], bound[keep]
            if not len(bound):
                break
            opened = np.argpartition(-bound, OPENED - 1)[:OPENED] if len(bound) > OPENED else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[opened] = False
            down = shift - level[opened]
            side = (rows[None, :] >> down[:, None] & 1) << 1
            new_nodes, new_at = [nodes[rest]], [at[rest]]
            for half in (0, 1):
                new_nodes.append(self.children(nodes[opened], side | half))
                new_at.append(at[opened] | half << down)
            made = np.concatenate(new_nodes[1:])
            sums = (np.where(made >= 0, self.top[made], 0) * weights).sum(axis=1)
            nodes, at = np.concatenate([new_nodes[0], made]), np.concatenate(new_at)
            level, bound = np.concatenate([level[rest], level[opened] + 1, level[opened] + 1]), np.concatenate([bound[rest], sums])
            single = level == self.height
            if single.any():
                found = single & (bound > 0)
                best = sorted([*best, *zip(bound[found].tolist(), at[found].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
                nodes, at, level, bound = nodes[~single], at[~single], level[~single], bound[~single]
        return best


def term_counts(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tfs) of each row: all its terms with repeats, and the numbers and counts of those in the vocabulary."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode(): k for k, t in enumerate(shared.value)}
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                found = [_TERM.findall(t.encode().lower()) for t in texts]
                n = np.array([len(x) for x in found], np.int64)
                known = np.array([number.get(t, -1) for x in found for t in x], np.int64)
                row = np.repeat(np.arange(len(texts)), n)[known >= 0]
                cells, tf = np.unique(row << 32 | known[known >= 0], return_counts=True)
                ends = pa.array(np.searchsorted(cells, np.arange(len(texts) + 1) << 32), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cells & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *lists], names=["id", "n", "terms", "tfs"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


class Found:
    """The best documents of each item so far, over the blocks of a task."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, size: tuple[int, int], k: int):
        self.items, self.weights, self.size, self.k = items, weights, size, k
        self.best: list[list[tuple[int, tuple]]] = [[] for _ in items]

    def block(self, ids: list, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Take in documents: ids, lengths, numbers of cells, and the cells one after another."""
        if not len(terms):
            return
        total, length = self.size
        keys = [(i is not None, i) for i in ids]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        keys = [keys[i] for i in order]
        m = 100 - 90 + (90 * n * total) // length
        impact = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, counts))
        treap = Treap(terms, np.repeat(place, counts), impact, len(ids))
        here = np.zeros(len(self.weights), bool)
        here[terms] = True
        for i, item in enumerate(self.items):
            rows = item[here[item] & (self.weights[item] > 0)]
            if len(rows):
                old = self.best[i]
                # what came before stands between the columns of this block, in its own order
                before = [(score, bisect_left(keys, key) - 1 + (j + 1) / (self.k + 1.5)) for j, (score, key) in enumerate(old)]
                at = dict(zip(before, old, strict=True))
                best = treap.search(rows, self.weights[rows], self.k, before)
                self.best[i] = [at[b] if b in at else (b[0], keys[int(b[1])]) for b in best]


def search_group(counts: DataFrame, items: list[tuple[object, list[int]]], item_type: pa.DataType, weights: list[int], size: tuple[int, int], k: int, schema: str) -> DataFrame:
    """(item, item_id, id, score): the best k of each task for each item; term counts of all documents are read once."""
    shared = counts.sparkSession.sparkContext.broadcast((items, weights))  # ITEM_TERMS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        found = Found([np.array(t, np.int64) for _, t in items], np.array(weights, np.int64), size, k)
        held: list[pa.RecordBatch] = []
        kind = None

        def close() -> None:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()
            for b in part:
                flat = [b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)]
                found.block(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False), *flat)
            held.clear()

        cells = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for a in range(0, batch.num_rows, 1000):
                held.append(batch.slice(a, 1000))
                cells += len(held[-1].column(2).flatten())
                if cells >= CELLS:
                    close()
                    cells = 0
        if held:
            close()
        rows = [(i, items[i][0], key[1], score) for i, best in enumerate(found.best) for score, key in best]
        if rows:
            cols = list(zip(*rows, strict=True))
            types = (pa.int32(), item_type, kind, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item", "item_id", "id", "score"])

    return counts.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item id, rank, id, score): the k best documents of each item, by the score of the docstring's contract with whole numbers.

    The terms of an item's text are its query, once each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    queries = materialise(items.select(column(item_col).alias("item_id"), F.array_distinct(words(column(text_col))).alias("terms")).where("size(terms) > 0"), "items")
    total = queries.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    groups = max(1, -(-total // ITEM_TERMS))
    item_type, kind = queries.schema["item_id"].dataType, docs.schema[id_col].dataType
    schema = f"item int, item_id {item_type.simpleString()}, id {kind.simpleString()}, score long"
    parts = []
    for g in range(groups):
        own = queries.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(groups)) == g).collect()  # ITEM_TERMS terms or one item
        vocabulary = sorted({t for r in own for t in r.terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        counts = materialise(term_counts(docs, vocabulary, id_col, text_col), "counts")
        size = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = dict.fromkeys(range(len(vocabulary)), 0) | {r.t: r.df for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}  # a row a term of the group
        weights = [math.floor(1000 * math.log((2 * size.docs + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))]
        listed = [(r.item_id, sorted(number[t] for t in r.terms)) for r in own]
        found = search_group(counts, listed, to_arrow_type(item_type), weights, (size.docs, size.terms), k, schema)
        parts.append(found.withColumn("part", F.lit(g)))
    best = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(W.partitionBy("part", "item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_first()))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
