"""Exact substring dedup with run-length compressed Burrows-Wheeler indexes.

A byte goes when a string of SPAN bytes that covers it also starts earlier: in a document of a smaller
id, or earlier in its own.  No task sees the whole corpus.  Of the GRAM-byte hashes in a SPAN-byte
window the least marks the window; neighbouring windows with one mark form a segment, and equal windows
have equal marks at equal offsets, so all copies of a window meet under its mark's hash.

1. Tasks cut documents into segments; of equal segments in a task only the earliest is handed on.
2. Sorted by mark and segment, equal segments stand together: all but the earliest are repeats.
   Segments that share a mark with a different segment are undecided.
3. Undecided segments get their bytes and are indexed in blocks by mark: a Burrows-Wheeler transform
   in runs, with suffix positions sampled at run ends and common prefix lengths at run starts.  Only
   the samples are kept; streaming over the text, each place's matching statistic (its longest match
   with its lexicographic neighbour, and where that is) follows from the sample before it.  Windows
   that match in full SPAN bytes form chains, of which all but the earliest window are repeats.
   A mark with over HOT segments is not indexed: its windows are dealt out by their own hashes as in
   steps 1 and 2, as places without bytes, so that a task hands on one place of each of its windows,
   and all places but the earliest are repeats.  An index thus gets HOT segments of a mark at most.
4. The repeated spans of a document are united and cut.

Defined cases: null is an empty text; texts below SPAN bytes lose nothing; equal rows of one id count as
one document and all return; unlike texts of one id are documents of their own, in the order of a hash;
null ids sort first; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from fieldbook.llm.common import RollingHash, column, materialise, text_chunks

SPAN, GRAM = 100, 20
#: Segments that a task holds before it drops equal ones and hands on.
HELD = 400_000
#: Bytes of an index, and segments of a mark above which its windows are told without one.
BLOCK_BYTES = 600_000
HOT = 10_000
#: Place of a segment: its first window, count of windows and offset of the mark in one number.
_N_BITS, _M_BITS = 7, 7


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(mark hash, segment hash, row, first window, windows, offset of the mark), piece by piece of the text."""
    piece = 1_000_000
    of_byte = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for p in range(0, max(0, len(data) - span + 1), piece):
        part = data[p : p + piece + span - 1]
        if len(part) < span:
            continue
        rolling = RollingHash(part)
        at = np.arange(len(part) - gram + 1)
        hashes = rolling.of(at, at + gram)
        marks = (sliding_least((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.arange(len(marks))
        rows = of_byte[p : p + len(first)]
        ok = first + p + span <= offsets[rows + 1]
        first, rows, marks = first[ok], rows[ok], marks[ok]
        if not len(first):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(marks) != 0) | (np.diff(rows) != 0) | (np.diff(first) != 1)]))
        n = np.diff(np.append(new, len(first)))
        a, m, r = first[new], marks[new], rows[new]
        seg = rolling.of(a, a + n + span - 1)
        seg[seg == 0] = 1
        yield hashes[m], seg, r, a + p - offsets[r], n, m - a


def united(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document without overlaps, neighbours joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.concatenate([[True], doc[1:] != doc[:-1]])
    lift = (np.cumsum(change) - 1) << 40
    reach = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.concatenate([[True], (start + lift)[1:] > reach[:-1]]) | change)
    last = np.append(new[1:], len(doc)) - 1
    return doc[new], start[new], reach[last] - lift[last]


def earliest(span: int) -> Callable[[list[tuple[np.ndarray, ...]]], pa.RecordBatch]:
    """Of the held (key, seg, doc, at): the first of each seg, and with seg 0 spans of the others."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, seg, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, seg))
        key, seg, doc, at = key[order], seg[order], doc[order], at[order]
        again = np.concatenate([[False], seg[1:] == seg[:-1]])
        same = np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])]) & again  # rows of one id
        gone = again & ~same
        start = at[gone] >> (_N_BITS + _M_BITS)
        d, s, e = united(doc[gone], start, start + ((at[gone] >> _M_BITS) & 127) + span - 1)
        keep = ~again
        spread = ((d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + s.astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in ((key[keep].view(np.int64), spread), (seg[keep].view(np.int64), np.zeros(len(d), np.int64)), (doc[keep], d), (at[keep], s << 31 | (e - s)))], names=["key", "seg", "doc", "at"]
        )

    return flush


def segment_rows(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, seg, doc, at): segments, and with seg 0 spans that are known to be repeats."""
    flush = earliest(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in text_chunks(batch.column(1)):
                for key, seg, row, a, n, m in segments(data, offsets, span, gram):
                    held.append((key, seg, ids[i + row], (a << _N_BITS | n) << _M_BITS | m))
                    count += len(key)
                    if count >= HELD:
                        yield flush(held)
                        held, count = [], 0
        if held:
            yield flush(held)

    return docs.mapInArrow(run, "key long, seg long, doc long, at long")


def decide(rows: DataFrame, span: int) -> DataFrame:
    """(doc, start, end, key, m): repeated spans with a null key, and undecided segments with theirs.

    Rows come sorted by key, seg, doc, at; one row is held back between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, seg0, doc0, at0, waiting = None, None, None, None, None

        def out(doc, start, end, key, m):
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), key, pa.array(m, pa.int32())], names=["doc", "start", "end", "key", "m"])

        def opened(doc, at, key):
            start = at >> (_N_BITS + _M_BITS)
            return out(doc, start, start + ((at >> _M_BITS) & 127) + span - 1, pa.array(key, pa.int64()), at & 127)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, seg, doc, at = (batch.column(c).to_numpy() for c in range(4))
            known = seg == 0
            d, t = doc[known], at[known]
            yield out(d, t >> 31, (t >> 31) + (t & 0x7FFFFFFF), pa.nulls(len(d), pa.int64()), np.zeros(len(d), np.int32))
            key, seg, doc, at = key[~known], seg[~known], doc[~known], at[~known]
            if not len(key):
                continue
            new_key = np.concatenate([[key0 is None or key[0] != key0], key[1:] != key[:-1]])
            new_seg = new_key | np.concatenate([[seg0 is None or seg[0] != seg0], seg[1:] != seg[:-1]])
            same = np.concatenate([[doc0 is not None and doc[0] == doc0 and at[0] == at0], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
            gone = ~new_seg & ~same
            start = at[gone] >> (_N_BITS + _M_BITS)
            yield out(doc[gone], start, start + ((at[gone] >> _M_BITS) & 127) + span - 1, pa.nulls(int(gone.sum()), pa.int64()), np.zeros(int(gone.sum()), np.int32))
            firsts = np.flatnonzero(new_seg)
            follows = np.append(~new_key[firsts[1:]], False) if len(firsts) else np.zeros(0, bool)
            if waiting is not None and len(firsts):
                if not new_key[firsts[0]]:
                    yield opened(*waiting)
                waiting = None
            mixed = firsts[~new_key[firsts] | follows]
            yield opened(doc[mixed], at[mixed], key[mixed])
            if len(firsts) and new_key[firsts[-1]]:
                f = firsts[-1:]
                waiting = doc[f].copy(), at[f].copy(), key[f].copy()
            key0, seg0, doc0, at0 = key[-1], seg[-1], doc[-1], at[-1]

    return rows.mapInArrow(run, "doc long, start long, end long, key long, m int")


class RunLengthIndex:
    """Run-compressed transform of segments (each with an end mark), kept as samples at its runs."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_seg = len(offsets) - 1
        sizes = np.diff(offsets)
        self.starts = offsets[:-1] + np.arange(n_seg)
        text = np.zeros(len(data) + n_seg, np.int64)
        text[np.arange(len(data)) + np.repeat(np.arange(n_seg), sizes)] = data.astype(np.int64) + 1
        self.size = len(text)
        self.ends = self.starts + sizes
        order = self.suffixes(text)
        before = np.where(order > 0, text[order - 1], 0)
        head = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        at = np.flatnonzero(head)
        self.runs = len(at)
        place = order[at]  # sampled at run starts
        above = np.where(at > 0, order[at - 1], -1)  # and at the ends of the runs before
        common = self.common(text, np.maximum(place, 0), above)
        by_place = np.argsort(place)
        self.sample, self.above, self.shared = place[by_place], above[by_place], common[by_place]

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling.  Suffixes of different segments that end alike are ordered by place.

        Ranks and places are packed into one number, as sorting plain numbers is ten times faster than
        sorting by a key.
        """
        n = len(text)
        bits = max(1, int(n + 1).bit_length())
        place = np.arange(n)
        padded = np.concatenate([text, np.zeros(3, np.int64)])
        key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(4):  # four symbols of nine bits; nothing after an end mark counts
            symbol = np.where(open_, padded[k : k + n], 0)
            key = key << 9 | symbol
            open_ &= symbol > 0
        order = RunLengthIndex.sorted_places([key], [36], bits)
        depth, ended = 4, ~open_
        while True:
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            if rank[order[-1]] == n - 1:
                return order
            ahead = np.minimum(place + depth, n - 1)
            second = np.where(ended, place, rank[ahead] + 1)
            key = rank << bits | second
            order = RunLengthIndex.sorted_places([rank, second], [bits, bits], bits)
            ended = ended | ended[ahead]
            depth *= 2

    @staticmethod
    def sorted_places(keys: list[np.ndarray], widths: list[int], bits: int) -> np.ndarray:
        """Places in the order of the keys, first key first."""
        mask = (1 << bits) - 1
        if sum(widths) + bits <= 63:
            packed = np.arange(len(keys[0]))
            for k, shift in zip(reversed(keys), np.cumsum([bits, *reversed(widths)])[:-1].tolist(), strict=True):
                packed = packed | k << shift
            packed.sort()
            return packed & mask
        order = np.arange(len(keys[0]))
        for k in reversed(keys):  # from the last key on, keeping the order of equals
            packed = k[order] << bits | np.arange(len(order))
            packed.sort()
            order = order[packed & mask]
        return order

    @staticmethod
    def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix length of suffixes, up to the end marks (b -1: 0), by halving on hashes."""
        n = len(text)
        stops = np.flatnonzero(text == 0)
        room = np.minimum(stops[np.searchsorted(stops, a)] - a, np.where(b < 0, 0, stops[np.searchsorted(stops, np.maximum(b, 0))] - b))
        rolling = RollingHash(text.astype(np.uint64))
        sums = rolling.sums
        b = np.maximum(b, 0)
        low, high = np.zeros(len(a), np.int64), room.copy()
        ua, ub, sa, sb = rolling.up[a], rolling.up[b], sums[a], sums[b]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            equal = (sums[a + mid] - sa) * ua == (sums[b + mid] - sb) * ub
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every place: the length of its match with its neighbour above, and where that stands."""
        which = np.searchsorted(self.sample, np.arange(self.size), "right") - 1
        past = np.arange(self.size) - self.sample[which]
        return self.shared[which] - past, self.above[which] + past

    def repeats(self, span: int) -> np.ndarray:
        """Places from which span bytes stand that also stand at an earlier place."""
        length, neighbour = self.statistics()
        to = np.where(length >= span, neighbour, np.arange(self.size))
        while True:
            further = to[to]
            if (further == to).all():
                break
            to = further
        first = np.full(self.size, self.size)
        valid = np.zeros(self.size, bool)
        for_seg = np.maximum(self.ends - self.starts - span + 1, 0)
        valid[np.repeat(self.starts, for_seg) + (np.arange(int(for_seg.sum())) - np.repeat(np.cumsum(for_seg) - for_seg, for_seg))] = True
        at = np.flatnonzero(valid)
        np.minimum.at(first, to[at], at)
        return at[first[to[at]] < at]


def match_blocks(rows: DataFrame, span: int) -> DataFrame:
    """(doc, start, end) of repeats among segments (key, doc, start, bytes), which come sorted by these."""

    def index(doc: np.ndarray, start: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
        made = RunLengthIndex(data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
        at = made.repeats(span)
        seg = np.searchsorted(made.starts, at, "right") - 1
        begin = start[seg] + at - made.starts[seg]
        d, s, e = united(doc[seg], begin, begin + span)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(3).cast(pa.large_binary()), BLOCK_BYTES):
                held.append([*(batch.column(c).slice(i, j - i).to_numpy() for c in range(3)), np.diff(offsets), data])
                size += len(data)
                if size < BLOCK_BYTES:
                    continue
                key, doc, start, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
                held = [[key, doc, start, sizes, data]]
                change = np.flatnonzero(key[1:] != key[:-1]) + 1
                if len(change):  # all marks but the last are complete
                    c = int(change[-1])
                    b = int(sizes[:c].sum())
                    yield index(doc[:c], start[:c], sizes[:c], data[:b])
                    held = [[x[c:].copy() for x in (key, doc, start, sizes)] + [data[b:].copy()]]
                    size = len(held[0][4])
        if held:
            _, doc, start, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
            yield index(doc, start, sizes, data)

    return rows.mapInArrow(run, "doc long, start long, end long")


def listed(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, offset of the row, its doc, key, start, end) of the segments in batches of (doc, text, s), by runs of rows."""
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            part = batch.column(2).slice(i, j - i)
            row = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
            key, start, end = (x.to_numpy(zero_copy_only=False) for x in part.flatten().flatten())
            end = np.minimum(end, np.diff(offsets)[row])  # rows of one id may differ
            fits = end - start >= span
            row = row[fits]
            yield data, offsets[row], batch.column(0).slice(i, j - i).to_numpy()[row], key[fits], start[fits], end[fits]


def cut_segments(joined: DataFrame, span: int) -> DataFrame:
    """(key, doc, start, bytes) of the undecided segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offset, doc, key, start, end in listed(batches, span):
            sizes = end - start
            at = np.concatenate([[0], np.cumsum(sizes)])
            raw = data[np.arange(int(at[-1])) + np.repeat(offset + start - at[:-1], sizes)]
            cut = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(start), cut], names=["key", "doc", "start", "bytes"])

    return joined.mapInArrow(run, "key long, doc long, start long, bytes binary")


def window_rows(joined: DataFrame, span: int) -> DataFrame:
    """(key, seg, doc, at) as segment_rows() has them, of each window of the segments of hot marks; key is the mark's, seg the window's hash."""
    flush = earliest(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for data, offset, doc, key, start, end in listed(batches, span):
            rolling = RollingHash(data)
            n = end - start - span + 1
            past = np.concatenate([[0], np.cumsum(n)])
            for i in range(0, len(n), HELD // 128):  # a segment has 81 windows at most
                some = slice(i, i + HELD // 128)
                of = np.repeat(np.arange(len(n))[some], n[some])
                first = start[of] + np.arange(len(of)) - (past[of] - past[i])
                seg = rolling.of(offset[of] + first, offset[of] + first + span)
                seg[seg == 0] = 1
                held.append((key[of].view(np.uint64), seg, doc[of], (first << _N_BITS | 1) << _M_BITS))
                count += len(of)
                if count >= HELD:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return joined.mapInArrow(run, "key long, seg long, doc long, at long")


def repeated_spans(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc, start, end), overlaps included; docs has (doc, text)."""
    rows = segment_rows(docs, span, gram).repartition("key").sortWithinPartitions("key", "seg", "doc", "at")
    decided = materialise(decide(rows, span), "decided")
    known = decided.where("key is null").select("doc", "start", "end")
    open_ = decided.where("key is not null")
    hot = materialise(open_.groupBy("key").count().where(F.col("count") > HOT).select("key"), "hot")
    by_doc = lambda some: docs.join(some.groupBy("doc").agg(F.collect_list(F.struct("key", "start", "end")).alias("s")), "doc").select("doc", "text", "s")
    none = hot.isEmpty()
    cut = cut_segments(by_doc(open_ if none else open_.join(hot, "key", "left_anti")), span).repartition("key").sortWithinPartitions("key", "doc", "start")
    found = known.unionByName(match_blocks(cut, span))
    if none:
        return found
    windows = window_rows(by_doc(open_.join(hot, "key", "left_semi")), span).repartition("key", "seg").sortWithinPartitions("key", "seg", "doc", "at")
    # windows of one mark are no segments of it: what decide() leaves open is different windows
    again = decide(windows, span).where("key is null").select("doc", "start", "end")
    return found.unionByName(again)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of each row, and (doc, own): doc is the id itself where ids are integers and none has two texts (no second table), else a number in the order of ids and texts."""
    id_, text = column(id_col), F.coalesce(column(text_col), F.lit(""))
    rows = docs.select(id_.alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        texts = rows.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"))
        if texts.where("low <> high or id is null").isEmpty():
            never = F.lit(0).cast("long")  # told not to be null, the texts of all joins come from one shuffle
            return docs.select(F.coalesce(id_.cast("long"), never).alias("doc"), text.alias("text")), None
    order = [F.col("id").asc_nulls_first(), F.col("hash")]
    ranked = rows.select("id", "hash").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = materialise(ranked.select(F.col("id").alias("own"), F.col("hash").alias("own_hash"), F.monotonically_increasing_id().alias("doc")), "numbers")
    return rows.join(ranked, F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("own_hash"))).select("doc", "text"), ranked.select("doc", "own")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(id, n_bytes, kept binary, removed array<struct<start, end>>) of each row; removed runs are of bytes."""
    own, ids = numbered(docs, id_col, text_col)
    spans = repeated_spans(own, span, gram).groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                raw, kept, runs = data.tobytes(), [], []
                for k in range(j - i):
                    text, list_ = raw[offsets[k] : offsets[k + 1]], batch.column(2)[i + k].values
                    if list_ is None or not len(list_):
                        kept.append(text)
                        runs.append([])
                        continue
                    start, end = (list_.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                    _, start, end = united(np.zeros(len(start), np.int64), start, end)
                    cuts = zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)
                    kept.append(b"".join(text[a:b] for a, b in cuts))
                    runs.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(runs, pa.list_(kind))], names=["doc", "n_bytes", "kept", "removed"])

    joined = own.join(spans, "doc", "left").select("doc", "text", "s")
    found = joined.mapInArrow(run, "doc long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>")
    found = found.withColumn("own", F.col("doc").cast(docs.schema[id_col].dataType)) if ids is None else found.join(ids, "doc")
    return found.select(F.col("own").alias(id_col), "n_bytes", "kept", "removed")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    d = deduplicated(docs)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return d.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
