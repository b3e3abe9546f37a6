"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Texts are cut by the tokenizer's pattern; each distinct piece of a chunk is encoded once.  Pieces of
about one length form a matrix of token ids, a row each.  In each round every row merges its leftmost
pair of least rank; ranks come from a hash table of pairs with linear probing, and finished rows
leave the matrix.  A piece of over LONG bytes (no word is that long) keeps its pairs in a heap
instead, so that it costs n log n and not its square; the order of merges is the same.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded
each; ids that are not in the vocabulary fail the decoding.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.common import column, small_batches, string_chunks

NONE = np.int32(2**31 - 1)
LONG = 256
#: Distinct pieces whose ids a task remembers between chunks.
REMEMBERED = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Open-addressing hash table from (left id, right id) to the id of their join."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs, joined = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    joined.append(rank)
        pairs, joined = np.array(pairs, np.int64), np.array(joined, np.int32)
        self.bits = max(10, int(len(pairs) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left, self.probes = self.slots(pairs), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] < 0]
            self.keys[slot[free]] = pairs[free]  # the last of those that meet in a slot stays
            won = self.keys[slot[left]] == pairs[left]
            self.values[slot[left[won]]] = joined[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.single = single
        self.ranks = ranks

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self.slots(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        seek = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(seek):
                break
            slot[seek] = (slot[seek] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[seek]]
            hit = found == keys[seek]
            out[seek[hit]] = self.values[slot[seek[hit]]]
            seek = seek[~hit & (found >= 0)]
        return out


def merge_rows(table: PairTable, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, ids one row after another, counts of ids) of a padded matrix of byte ids.

    The matrix lies on its side, a column each for the rows, so that a round is a few operations on
    long vectors.
    """
    origin, ids, lengths = np.arange(len(rows)), np.ascontiguousarray(rows.T), lengths.copy()
    ranks = np.full((max(1, len(ids) - 1), len(origin)), NONE, np.int32)
    for k in range(len(ids) - 1):
        inside = np.flatnonzero(lengths > k + 1)
        ranks[k, inside] = table.get(ids[k, inside], ids[k + 1, inside])
    order, flat, counts = [], [], []
    while len(origin):
        rank = ranks.min(axis=0)
        done = rank == NONE
        if done.any():
            order.append(origin[done])
            counts.append(lengths[done])
            ended = ids[:, done].T
            flat.append(ended[np.arange(ended.shape[1])[None, :] < lengths[done][:, None]])
            keep = np.flatnonzero(~done)  # compaction: finished rows leave
            if not len(keep):
                break
            origin, lengths, rank = origin[keep], lengths[keep], rank[keep]
            width = int(lengths.max())
            ids, ranks = ids[:width, keep], ranks[: max(1, width - 1), keep]
        best = np.zeros(len(origin), np.int64)
        for k in range(len(ranks) - 1, -1, -1):  # the leftmost comes last
            best[ranks[k] == rank] = k
        row = np.arange(len(origin))
        ids[best, row] = rank
        for k in range(1, len(ids) - 1):
            np.copyto(ids[k], ids[k + 1], where=best < k)
        lengths -= 1
        for k in range(len(ranks) - 1):
            np.copyto(ranks[k], ranks[k + 1], where=best < k)
        for k in range(len(ranks)):
            ranks[k][lengths <= k + 1] = NONE
        right = np.flatnonzero(best < lengths - 1)
        ranks[best[right], right] = table.get(ids[best[right], right], ids[best[right] + 1, right])
        left = np.flatnonzero(best > 0)
        ranks[best[left] - 1, left] = table.get(ids[best[left] - 1, left], ids[best[left], left])
    return np.concatenate(order), np.concatenate(flat), np.concatenate(counts)


def merge_long(ranks: dict[bytes, int], piece: bytes) -> np.ndarray:
    """Ids of one long piece: a heap holds the pairs, so that length costs n log n."""
    after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    end = list(range(1, len(piece) + 1))
    heap = [(r, i, i + 2) for i in range(len(piece) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = bytearray(b"\1" * len(piece))
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or after[i] >= len(piece) or end[after[i]] != stop:
            continue
        j = after[i]
        live[j], end[i], after[i] = 0, stop, after[j]
        if after[i] < len(piece):
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return np.array([ranks[piece[i : end[i]]] for i in range(len(piece)) if live[i]], np.int32)


def encode_pieces(table: PairTable, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, counts)."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    by_size = np.argsort(sizes, kind="stable")
    order, flat, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    start = 0
    while start < len(by_size):
        longest = int(sizes[by_size[start]])
        if longest > LONG:
            ids = merge_long(table.ranks, pieces[by_size[start]])
            part, end = (by_size[start : start + 1], ids, np.array([len(ids)])), start + 1
        else:
            top = max(4, longest + longest // 4)
            end = min(int(np.searchsorted(sizes[by_size], top, "right")), start + max(1, 500_000 // top))
            bucket = by_size[start:end]
            width = int(sizes[bucket].max())
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in bucket), np.uint8).reshape(len(bucket), width)
            rows, ids, n = merge_rows(table, table.single[raw], sizes[bucket])
            part = bucket[rows], ids, n
        for to, x in zip((order, flat, counts), part, strict=True):
            to.append(x)
        start = end
    order, flat, counts = np.concatenate(order), np.concatenate(flat), np.concatenate(counts)
    back = np.argsort(order)
    return gather(flat, (np.cumsum(counts) - counts)[back], counts[back]), counts[back]


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s:s+n] of each start and length, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


#: What this worker made of the last vocabulary.
_tables: dict[str, PairTable] = {}


class Encoder:
    """Ids of texts; pieces that came before are remembered."""

    def __init__(self, ranks: dict[bytes, int], name: str, pattern: str):
        import regex

        if name not in _tables:
            _tables.clear()
            _tables[name] = PairTable(ranks)
        self.table, self.cut = _tables[name], regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.known) > REMEMBERED:
            self.forget()
        known, first = self.known, len(self.known)
        which, counts = [], []
        for text in texts:
            pieces = self.cut.findall(text)
            which.extend([known.setdefault(p, len(known)) for p in pieces])
            counts.append(len(pieces))
        if len(known) > first:
            fresh, sizes = encode_pieces(self.table, [p.encode() for p in islice(known, first, None)])
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, fresh])
        which = np.array(which, np.int64)
        of_piece = np.concatenate([[0], np.cumsum(self.lengths[which])])
        of_text = of_piece[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        ids = gather(self.flat, self.starts[which], self.lengths[which])
        return pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.array(ids, pa.int32()))


class Decoder:
    """Bytes of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.known = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.known) - self.known
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        out = []
        for k in range(0, len(lists), 500):
            part = lists.slice(k, 500)
            ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= self.size or (self.known[ids] == 0).any()):
                raise ValueError("an id is not in the vocabulary")
            counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(self.known[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            raw = gather(self.data, self.at[ids], self.known[ids]).tobytes()
            out.extend(raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of each row; if so wanted also the bytes (decoded) that the ids decode to, in the same worker."""
    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex  # a vocabulary file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, name, pattern), Decoder(shared.value) if decoded else None
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                ids = encoder.encode(texts)
                more = [pa.array(decoder.decode(ids), pa.binary())] if decoder else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, *more], names=["id", "ids", "decoded"][: 2 + decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids (binary) as a further column."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for lists in batches:
            yield pa.array(decoder.decode(lists), pa.binary())

    return encoded.withColumn(out_col, bytes_of(column(ids_col)))


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of the query: counts and hashes of the ids and of the decoded bytes."""
    return encode(docs, load_ranks(path), pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
