"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, and their components.

Two sets link when 100 * |A and B| >= percent * |A or B|.  Equal sets are one node, named by a digest.

1. A set that links holds percent of its shingles in common with others, so at most the rest of them
   are its own.  Tasks deal the even half of all shingles' hashes to buckets, a few bytes each, and each
   bucket counts, set by set, those that another set has too (within a task a shingle of several sets
   is handed on once, so no key is hot).  Sets with too many of their own in that half are done; what is
   left is mostly near copies.
2. Of the sets left all shingles are dealt to buckets, which count how many of these sets have each.  A set
   with fewer shared ones than T = ceil(percent * |A| / 100) is done.  The others go by their |A| - T + 1
   rarest shingles: two sets that link have one of these in common, as all they share lies behind the first
   of both.  Its own shingles are the rarest of all, so little but near copies meets.  Sets that have such a
   shingle in common are joined to groups.  A group of over LARGE shingles is told apart once more, by
   signatures that lose no link: sizes fall in levels, and at each level shingles are dealt to so many parts
   by hash that linked sets, which differ in few shingles, agree in some.
3. A group is searched for links by T-occurrence: for a set A, a partner shares at least T of A's
   shingles.  In an inverted index the L longest lists of A stay out of the merge; the others are merged with a heap that skips what can't occur in T - L of them, and what
   does is probed in the long lists by binary search (DivideSkip) against the overlap that its size needs.
   All sets first meet a few leaders, which joins most of a true group; only the sets outside of its
   largest component then meet all others.  Of the links a spanning forest is handed on, which joins the
   same components.  The index goes by size in windows, and each has a T of its own for the sizes in it.
   Groups of over BLOCK shingles do both steps in blocks, so no task holds more than two of these however
   large a group is, and a set is copied to few blocks.

Defined cases: a document without words (or with a null text) has an empty set and links with none; one
with fewer words than a shingle has its whole sequence as its one shingle; repeated rows of one id are
one document with the union of their links (a row without words has its own id as its component even
then), and every row returns; rows with a null id link as others do but give no component their id, so
a component of such rows alone is null; ids may be of any type that can be ordered.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldbook.llm import common
from fieldbook.llm.common import column, components, free_name, materialise, mix, small, split_by_map, text_chunks, word_hashes

#: Shingles of a bucket, of a task's hand-over, and of a block of a group.
BUCKET = 8_000_000
HELD = 1_500_000
BLOCK = 1_000_000
#: Shingles of a group above which it is told apart once more.
LARGE = 100_000
#: Buckets at least.
BUCKETS = 64
#: Sets of a group that all of its sets meet first.
LEADERS = 32
#: Sets of a window of the index at least, and by how many hundredths their sizes differ at most in a larger one.
WINDOW = 16
WIDTH = 2
#: Steps of the merge that a probe of a long list costs, in the choice of how many lists are left out of the merge.
PROBE = 0.3
#: Sizes up to which signatures are of two parts together.
PAIRED_SIZE = 40
#: Bytes of a digest; the first eight are the set's node, by which it is told while groups form.
DIGEST = 12
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique() of integers, by sorting alone; it hashes them first, which takes three times as long for a text's shingles."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted hashes of each row's different shingles of n words."""
    data = _LOWER[data]
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(last) + 1
    hashes = word_hashes(data, starts, ends)
    bounds = np.searchsorted(starts, offsets)
    many = max(0, len(hashes) - n + 1)
    rolled = np.zeros(many, np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + many]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(distinct(rolled[a : b - n + 1]))
        elif b > a:
            x = np.full(1, b - a, np.uint64)
            for h in hashes[a:b]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + h
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Levels:
    """Levels of sizes, and the parts that shingles are dealt to at each.

    Linked sets up to a level's top differ in `differ` shingles at most, so of differ + 1 + spare parts
    at least 1 + spare agree.  Parts with few shingles say little (one shared phrase may fill them), so
    signatures are of parts with three shingles or more where a set has so many that one of them must
    be among those that agree; else of two or more, and so on.  At low levels, where parts hold few,
    signatures are of two parts together.  Nothing is lost by it: what a set leaves out, it leaves out
    only when another of its signatures must agree, and the partner has that one too.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.tops = [1]
        while self.tops[-1] < 1 << 31:  # sizes of one level and the next differ by the least ratio of linked sets at most
            self.tops.append(max(self.tops[-1] + 1, self.tops[-1] * 100 // percent))

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.tops, size, "left"))

    def parts(self, level: int) -> tuple[int, int, bool]:
        """(parts, spare, whether two go together); no parts where only equal sets link."""
        differ = 2 * self.tops[level] * (100 - self.percent) // (100 + self.percent)
        if differ == 0:
            return 0, 0, False
        if self.tops[level] <= PAIRED_SIZE:
            return differ + 3, 2, True
        spare = 2 + differ // 4
        return differ + 1 + spare, spare, False

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Signatures of a sorted set for its own level and the next, where it may be the smaller of a pair."""
        out = [np.zeros(0, np.uint64)]
        weights = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)))])
        own = self.of(len(shingles))
        for level in (own, own + 1):
            parts, spare, paired = self.parts(level)
            if not parts:
                continue
            ends = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(shingles, ends, "left"), [len(shingles)]])
            count = np.diff(cuts)
            signs = mix(weights[cuts[1:]] - weights[cuts[:-1]] + mix(np.arange(parts, dtype=np.uint64) + np.uint64(level << 32)))
            if paired:
                i, j = np.triu_indices(parts, 1)
                both = mix(signs[i] * np.uint64(3) + signs[j])
                # the most parts of which no two hold three shingles together; three parts agree at least
                weak = max((count < 2).sum(), (count == 0).sum() + (count == 2).any())
                out.append(both[count[i] + count[j] >= 3] if weak < 3 else both)
            else:
                least = next(m for m in (3, 2, 1, 0) if (count < m).sum() <= spare)
                out.append(signs[count >= least])
        return np.concatenate(out)


def digest_of(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=DIGEST).digest()


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def even_half(s: np.ndarray) -> np.ndarray:
    return s[s & np.uint64(1) == 0]


def text_hash(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text)


def set_rows(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, n_shingles, n_even, node, digest) of each row; node and digest are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(2)):
                sets = shingle_sets(data, offsets, n)
                digest = [digest_of(s) if len(s) else None for s in sets]
                own = [batch.column(c).slice(i, j - i) for c in (0, 1)]
                counts = [pa.array([len(x) for x in list_], pa.int64()) for list_ in (sets, map(even_half, sets))]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array([d and node_of(d) for d in digest], pa.int64()), pa.array(digest, pa.binary())], names=["id", "hash", "n_shingles", "n_even", "node", "digest"])

    text = column(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(id_col).alias("id"), text_hash(text).alias("hash"), text.alias("text")).mapInArrow(run, f"id {kind}, hash long, n_shingles long, n_even long, node long, digest binary")


# ---- shingles that another set has too


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Rows of so many elements each, as bytes."""
    at = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def dealt(digests: list[bytes], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """One row for each bucket: the sets with shingles in it, how many of these are known to be shared, 32 bits of the others, and of those that are."""
    flat = np.concatenate(sets)
    low_bits = lambda x: (x >> np.uint64(1)).astype(np.uint32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(flat)
    ordered = flat[order]
    again = ordered[1:] == ordered[:-1]
    known = np.zeros(len(flat), bool)
    known[order[1:][again]] = known[order[:-1][again]] = True
    shared = np.unique(ordered[1:][again])
    bucket_of = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    bucket = bucket_of(flat)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, owner, known = bucket[order], owner[order], known[order]
    low = low_bits(flat[order])[~known]
    cell = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
    n_known = np.add.reduceat(known.astype(np.uint32), cell, dtype=np.uint32)
    n_low = (np.diff(np.append(cell, len(flat))) - n_known).astype(np.uint32)
    used = np.unique(bucket)
    upto = np.searchsorted(bucket[cell], np.append(used, buckets))
    cells, lows = np.diff(upto), np.diff(np.concatenate([[0], np.cumsum(n_low)])[upto])
    nodes = np.array([node_of(d) for d in digests], np.int64)[owner[cell]]
    at = np.searchsorted(bucket_of(shared), np.append(used, buckets))
    columns = [binaries(nodes, cells), binaries(n_known, cells), binaries(n_low, cells), binaries(low, lows), binaries(low_bits(shared), np.diff(at))]
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *columns], names=["bucket", "nodes", "known", "counts", "low", "shared"])


def counted(key: tuple, table: pa.Table) -> pa.Table:
    """(node, excess) of the sets of one bucket of whose shingles in it another set has over half: twice these, less all."""
    whole = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
    nodes, known, counts, low = whole("nodes", np.int64), whole("known", np.uint32), whole("counts", np.uint32), whole("low", np.uint32)
    shared = np.unique(whole("shared", np.uint32))
    _, first = np.unique(nodes, return_index=True)  # tasks may hold equal sets
    keep = np.zeros(len(nodes), bool)
    keep[first] = True
    owner = np.repeat(np.arange(len(nodes)), counts)
    mine = keep[owner]
    packed = low[mine].astype(np.uint64) << np.uint64(32) | owner[mine].astype(np.uint64)
    packed.sort()
    value, owner = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    both = np.zeros(len(value), bool)
    again = value[1:] == value[:-1]
    both[1:] |= again
    both[:-1] |= again
    if len(shared):
        both |= shared[np.minimum(np.searchsorted(shared, value), len(shared) - 1)] == value
    excess = 2 * np.bincount(owner[both], minlength=len(nodes)) + known.astype(np.int64) - counts
    found = np.flatnonzero(keep & (excess > 0))
    return pa.table({"node": pa.array(nodes[found]), "excess": pa.array(excess[found], pa.int64())})


def shared_excess(docs: DataFrame, n: int, text_col: str, buckets: int) -> DataFrame:
    """(node, excess) by set, over the buckets where it is above 0: by how much the even shingles that another set has are more than those that none has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # equal sets of a task count once; what is past this bound, the bucket tells
        held: dict[bytes, np.ndarray] = {}
        size = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for s in shingle_sets(data, offsets, n):
                    half = even_half(s)
                    if not len(half) or (d := digest_of(s)) in seen or d in held:
                        continue
                    held[d] = half
                    size += len(half)
                if size >= HELD:
                    yield dealt(list(held), list(held.values()), buckets)
                    if len(seen) < 500_000:
                        seen.update(held)
                    held, size = {}, 0
        if held:
            yield dealt(list(held), list(held.values()), buckets)

    rows = docs.select(column(text_col).alias("text")).mapInArrow(run, "bucket int, nodes binary, known binary, counts binary, low binary, shared binary")
    return rows.groupBy("bucket").applyInArrow(counted, "node long, excess long").groupBy("node").agg(F.sum("excess").alias("excess"))


def able_sets(docs: DataFrame, rows: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(digest, node, size, shingles binary) of the sets that have enough in common with others to link with one.

    In a bucket without excess a set shares half at most, so over all (n_even + excess) / 2 at most are
    shared; the others are its own, which no partner has: they are (100 - percent) / 100 of it at most.
    """
    total = rows.agg(F.sum("n_even")).first()[0] or 0
    excess = shared_excess(docs, n, text_col, max(BUCKETS, -(-total // BUCKET)))
    one = rows.where("digest is not null").groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("row"), F.first("n_shingles").alias("size"), F.first("n_even").alias("even"), F.first("node").alias("node"))
    own = (F.col("even") - F.coalesce("excess", F.lit(0))) / 2
    able = one.join(excess, "node", "left").where(own * 100 <= F.col("size") * (100 - percent))
    able = materialise(able.select("digest", F.col("row.id").alias("own"), F.col("row.hash").alias("own_hash")), "able")
    many = able.count() > common.BROADCAST_ROWS
    same = F.col("id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("own_hash"))
    repeated = rows.select("id", "hash").join(small(able), same).count() > able.count()
    texts = docs.select(column(id_col).alias("id"), text_hash(column(text_col)).alias("hash"), column(text_col).alias("text"))
    if many:  # or all texts would be shuffled
        texts = split_by_map(texts, F.col("hash"), able.select("own_hash"))[0]
    texts = texts.join(able if many else F.broadcast(able), same).select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                digest = batch.column(0).slice(i, j - i)
                node = [node_of(d) for d in digest.to_pylist()]
                columns = [digest, pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "node", "size", "shingles"])

    sets = texts.mapInArrow(run, "digest binary, node long, size long, shingles binary")
    return materialise(sets.dropDuplicates(["digest"]) if repeated else sets, "able-sets")


def sets_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


# ---- groups


def handed_on(sign: np.ndarray, node: np.ndarray) -> dict[str, pa.Array]:
    """(sign, open, a, b): of the sets of one sign that a task holds the first goes on with it (open, a = b), the others are joined to it."""
    order = np.lexsort((node, sign))
    sign, node = sign[order], node[order]
    head = np.ones(len(sign), bool)
    head[1:] = sign[1:] != sign[:-1]
    first = node[np.flatnonzero(head)[np.cumsum(head) - 1]]
    pairs = np.unique(np.stack([first[~head], node[~head]], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    salt = mix(pairs[:, 0].view(np.uint64) * np.uint64(3) + pairs[:, 1].view(np.uint64)).view(np.int64)
    columns = [np.concatenate(x) for x in ((sign[head].view(np.int64), salt), (node[head], pairs[:, 0]), (node[head], pairs[:, 1]))]
    return {"sign": pa.array(columns[0]), "open": pa.array(np.repeat([True, False], [head.sum(), len(pairs)])), "a": pa.array(columns[1]), "b": pa.array(columns[2])}


def cells_of(owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Where a run of elements of one owner in one bucket begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(owner)), bool), (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))


def by_bucket(bucket: np.ndarray, cell: np.ndarray, columns: dict[str, np.ndarray], elements: np.ndarray) -> dict[str, pa.Array]:
    """One row for each bucket: the columns of its cells, how many elements these have, and the elements, all as bytes."""
    used = np.unique(bucket)
    upto = np.searchsorted(bucket[cell], np.append(used, used[-1:] + 1)) if len(used) else np.zeros(1, int)
    counts = np.diff(np.append(cell, len(elements))).astype(np.uint32)
    lengths = np.diff(np.append(cell, len(elements))[upto])
    out = {k: binaries(v, np.diff(upto)) for k, v in (columns | {"counts": counts}).items()}
    return {"bucket": pa.array(used.astype(np.int32))} | out | {"elements": binaries(elements, lengths)}


def prefix_rows(sets: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(sign, open, a, b) as handed_on gives them, of the rarest shingles of each set that may link: |A| - T + 1, less those that no other set has.

    Shingles go by bucket and 32 bits; what falls together in these counts as one, which brings sets together but loses none.
    """
    dealt_row = "bucket int, nodes binary, sizes binary, counts binary, elements binary"
    whole = lambda table, name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            flat, sizes = np.concatenate(held), np.array([len(s) for s in held], np.uint32)
            owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            bucket = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, owner, low = bucket[order], owner[order], (flat[order] >> np.uint64(1)).astype(np.uint32)
            cell = cells_of(owner, bucket)
            return pa.RecordBatch.from_pydict(by_bucket(bucket, cell, {"nodes": np.array(nodes, np.int64)[owner[cell]], "sizes": sizes[owner[cell]]}, low))

        nodes, held, size = [], [], 0
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1)), strict=True):
                nodes.append(node)
                held.append(s)
                size += len(s)
                if size >= HELD:
                    yield out()
                    nodes, held, size = [], [], 0
        if size:
            yield out()

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        """Of the shingles of one bucket those of several sets, under the set again; an element is how many have it (its power of two), bucket, 32 bits."""
        nodes, sizes, counts, low = (whole(table, *x) for x in (("nodes", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("elements", np.uint32)))
        order = np.argsort(low)
        head = np.flatnonzero(np.concatenate([[True], np.diff(low[order]) != 0]))
        times = np.diff(np.append(head, len(low)))
        power = np.empty(len(low), np.uint8)
        power[order] = np.repeat(np.log2(times).astype(np.uint8), times)
        several = np.zeros(len(low), bool)
        several[order] = np.repeat(times > 1, times)
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)[several]
        part = (mix(nodes.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)[owner]
        elements = power[several].astype(np.uint64) << np.uint64(58) | np.uint64(key[0].as_py()) << np.uint64(32) | low[several].astype(np.uint64)
        order = np.argsort(part, kind="stable")
        part, owner, elements = part[order], owner[order], elements[order]
        cell = cells_of(owner, part)
        return pa.table(by_bucket(part, cell, {"nodes": nodes[owner[cell]], "sizes": sizes[owner[cell]]}, elements))

    def rarest(key: tuple, table: pa.Table) -> pa.Table:
        nodes, sizes, counts, elements = (whole(table, *x) for x in (("nodes", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("elements", np.uint64)))
        node, at, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        owner = np.repeat(inverse, counts)
        order = np.lexsort((elements, owner))
        owner, elements = owner[order], elements[order]
        n = np.bincount(owner, minlength=len(node))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        first = place < (n + 1 + (-percent * sizes[at].astype(np.int64) // 100))[owner]  # with the set's own shingles in front: size - T + 1
        return pa.table(handed_on(elements[first], node[owner[first]]))

    rows = sets.select("node", "shingles").mapInArrow(deal, dealt_row)
    rows = rows.groupBy("bucket").applyInArrow(shared, dealt_row)
    return rows.groupBy("bucket").applyInArrow(rarest, "sign long, open boolean, a long, b long")


def signature_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(sign, open, a, b) as handed_on gives them, of the signatures of the sets within their groups g."""
    levels = Levels(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda: pa.RecordBatch.from_pydict(handed_on(*(np.concatenate(x) for x in zip(*held, strict=True))))
        for batch in batches:
            for node, g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2)), strict=True):
                signs = mix(levels.signatures(s) ^ np.full(1, g, np.int64).view(np.uint64))
                held.append((signs, np.full(len(signs), node, np.int64)))
                size += len(signs)
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return sets.select("node", "g", "shingles").mapInArrow(run, "sign long, open boolean, a long, b long")


def weighed(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, g, n): the sets that rows (sign, open, a, b) join to groups of n shingles."""
    first = F.min("a").over(W.partitionBy("sign", "open").orderBy("a").rowsBetween(W.unboundedPreceding, W.currentRow))
    near = materialise(rows.select(first.alias("a"), "b").where("a <> b").distinct(), "near")
    groups = materialise(components(near, "groups"), "group-of")
    roots = groups.select(F.col("component").alias("node"), F.col("component").alias("g")).distinct()
    members = materialise(groups.select("node", F.col("component").alias("g")).unionByName(roots), "members")
    weight = members.join(sets.select("node", "size"), "node").groupBy("g").agg(F.sum("size").alias("n"))
    return materialise(members.join(small(materialise(weight, "weights")), "g").select("node", "g", "n"), "weighed")


def grouped(sets: DataFrame, percent: int) -> DataFrame:
    """(g, k, digest, shingles) of the sets in groups, which are cut into k blocks."""
    total = sets.agg(F.sum("size")).first()[0] or 0
    of = weighed(prefix_rows(sets, percent, max(BUCKETS, -(-2 * total // BUCKET))), sets)
    large = of.where(F.col("n") > LARGE)
    if not large.isEmpty():
        finer = weighed(signature_rows(sets.join(small(large), "node"), percent), sets)
        of = materialise(of.where(F.col("n") <= LARGE).unionByName(finer), "finer")
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    return materialise(sets.join(small(of), "node").select("g", k.alias("k"), "digest", "shingles"), "groups")


# ---- the search


class Postings:
    """Inverted lists: for each shingle the places of the sets that hold it, rising."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        places = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
        self.places = places.tolist()
        self.shingles, start = np.unique(flat[order], return_index=True)
        self.bounds = np.append(start, len(flat))
        self.keys = np.repeat(np.arange(len(self.shingles)), np.diff(self.bounds)) * len(sets) + places  # rising: list, then place
        self.sizes = [len(s) for s in sets]
        self.windows: list[list[int]] = []  # first place, end, least and largest size
        for k, size in enumerate(self.sizes):
            if self.windows:
                first, _, low, high = self.windows[-1]
                low, high = min(low, size), max(high, size)
                if k - first < WINDOW or high * 100 <= low * (100 + WIDTH):
                    self.windows[-1] = [first, k + 1, low, high]
                    continue
            self.windows.append([k, k + 1, size, size])

    def held(self, s: np.ndarray) -> np.ndarray:
        """Which lists are of shingles of a set."""
        if not len(self.shingles):
            return np.zeros(0, int)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return at[self.shingles[at] == s]

    def lists(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(start, end) of the lists of a set's shingles, short ones first."""
        at = self.held(s)
        start, end = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(end - start, kind="stable")
        return list(zip(start[order].tolist(), end[order].tolist(), strict=True))

    def within(self, held: np.ndarray, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts and the ends of what these lists have of the places from first on, before end."""
        return np.searchsorted(self.keys, held * len(self.sizes) + first), np.searchsorted(self.keys, held * len(self.sizes) + end)


def merge_skip(places: list[int], lists: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    """(place, lists that hold it) of what is in at least so many of the lists, rising: a heap of their fronts."""
    heap = [(places[a], a, b) for a, b in lists]
    heapify(heap)
    while len(heap) >= least:
        place = heap[0][0]
        popped = []
        while heap and heap[0][0] == place:
            popped.append(heappop(heap))
        if len(popped) >= least:
            yield place, len(popped)
            ahead = place + 1
        else:  # with the next few fronts it would still be too few up to what stands behind them
            while len(popped) < least - 1:
                popped.append(heappop(heap))
            ahead = heap[0][0]
        for _, a, b in popped:
            a = bisect_left(places, ahead, a, b)
            if a < b:
                heappush(heap, (places[a], a, b))


def left_out(lengths: np.ndarray, need: int) -> int:
    """How many of the lists, short ones first, to leave out of the merge: for the least cost of merging the others and probing for what they may hold often enough."""
    out = np.arange(min(need, len(lengths)))
    merged = np.cumsum(lengths)[len(lengths) - 1 - out]
    return int(np.argmin(merged * (np.log2(len(lengths) - out) + 1 + PROBE * out / (need - out))))


def divide_skip(index: Postings, s: np.ndarray, percent: int, wanted: Callable[[int], bool], own: int | None = None) -> Iterator[int]:
    """Places of the sets in the index that link with s, of those wanted when they are met.  own: the place of s itself, if it is there and not wanted."""
    held = index.held(s)
    for first, end, low, high in index.windows:
        if high * 100 < percent * len(s) or len(s) * 100 < percent * low:
            continue
        need = -(-percent * (len(s) + max(low, -(-percent * len(s) // 100))) // (100 + percent))
        if len(held) < need:
            continue
        start, stop = index.within(held, first, end)
        length = stop - start - (own is not None and first <= own < end)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        if len(order) < need:  # too many shingles that nothing else in the window has
            continue
        lists = list(zip(start[order].tolist(), stop[order].tolist(), strict=True))
        out = left_out(length[order], need)
        short, long_ = lists[: len(lists) - out], lists[len(lists) - out :]
        places = index.places
        for place, hits in merge_skip(places, short, need - out):
            size = index.sizes[place]
            if size * 100 < percent * len(s) or len(s) * 100 < percent * size or not wanted(place):
                continue
            missing = -(-percent * (len(s) + size) // (100 + percent)) - hits
            for done, (a, b) in enumerate(long_):
                if missing <= 0 or missing > len(long_) - done:
                    break
                a = bisect_left(places, place, a, b)
                missing -= a < b and places[a] == place
            if missing <= 0:
                yield place


class Forest:
    """Components of sets, and the links that joined them."""

    def __init__(self, labels: list):
        first: dict = {}
        self.parent = [first.setdefault(x, k) for k, x in enumerate(labels)]
        self.count = len(first)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def search(self, sets: list[np.ndarray], indexed: Iterable[int], queries: Iterable[int], percent: int, names: list | None = None) -> None:
        """Join all that queries link with; a query is in the index too where a set there has its name (else its number)."""
        indexed = sorted(indexed, key=lambda k: len(sets[k]))
        index = Postings([sets[k] for k in indexed])
        place_of = {k if names is None else names[k]: p for p, k in enumerate(indexed)}
        for q in queries:
            if self.count == 1:
                return
            own = place_of.get(q if names is None else names[q])
            for place in divide_skip(index, sets[q], percent, lambda p, q=q: self.root(indexed[p]) != self.root(q), own):
                a, b = self.root(indexed[place]), self.root(q)
                if a != b:
                    self.parent[b] = a
                    self.count -= 1
                    self.links.append((indexed[place], q))

    def rest(self) -> list[int]:
        """All outside of the largest component."""
        roots = np.array([self.root(k) for k in range(len(self.parent))])
        return np.flatnonzero(roots != np.argmax(np.bincount(roots))).tolist()


def found(forest: Forest, digests: list[bytes]) -> pa.Table:
    return pa.table({"a": pa.array([digests[a] for a, _ in forest.links], pa.binary()), "b": pa.array([digests[b] for _, b in forest.links], pa.binary())})


def joined(sets: list[np.ndarray], percent: int) -> Forest:
    """The components of a whole group."""
    forest = Forest(list(range(len(sets))))
    forest.search(sets, range(min(LEADERS, len(sets))), range(len(sets)), percent)
    if len(sets) > LEADERS and (rest := forest.rest()):
        forest.search(sets, range(len(sets)), rest, percent)
    return forest


def near_links(groups: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges (a, b) of digests that join what all links join: stars around the least of a component, and others of groups in blocks, if any."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("digest")
        forest = joined(sets_of(table["shingles"]), percent)
        digests = table["digest"].to_pylist()
        least: dict[int, bytes] = {}
        stars = [(least.setdefault(forest.root(k), d), d) for k, d in enumerate(digests)]  # by digest: the first is the least
        stars = [(a, b) for a, b in stars if a != b]
        return pa.table({"a": pa.array([a for a, _ in stars], pa.binary()), "b": pa.array([b for _, b in stars], pa.binary())})

    def between(key: tuple, table: pa.Table) -> pa.Table:
        """Sets of a block (side 1) as queries against the leaders, or as an index for the sets outside (side 0)."""
        table = table.sort_by([("side", "ascending"), ("digest", "ascending")])
        digests, sets, side = table["digest"].to_pylist(), sets_of(table["shingles"]), table["side"].to_numpy()
        forest = Forest(table["label"].to_pylist())
        few_, many = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
        indexed, queries = (few_, many) if key[1].as_py() < 0 else (many, few_)
        forest.search(sets, indexed, queries, percent, digests)
        return found(forest, digests)

    schema = "a binary, b binary"
    within = groups.where("k = 1").groupBy("g").applyInArrow(whole, schema)
    large = materialise(groups.where("k > 1").withColumn("j", F.pmod(F.xxhash64("digest"), F.col("k")).cast("int")), "large-groups")
    if large.isEmpty():
        return within, None
    every = lambda df, k, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(k) - 1)))
    nth = F.row_number().over(W.partitionBy("g").orderBy("digest"))
    leaders = large.select("g", "digest").withColumn("nth", nth).where(F.col("nth") <= LEADERS).select("g", "digest")
    leaders = every(large.join(leaders, ["g", "digest"], "left_semi").drop("j"), "k", "j")
    fields = ["g", "i", "j", "side", "digest", "label", "shingles"]
    sided = lambda df, side, i, label: df.select("g", i.alias("i"), "j", F.lit(side).alias("side"), "digest", label.alias("label"), "shingles").select(fields)
    led = sided(leaders, 0, F.lit(-1), F.col("digest")).unionByName(sided(large, 1, F.lit(-1), F.col("digest")))
    first = materialise(led.groupBy("g", "i", "j").applyInArrow(between, schema), "led")

    labels = components(first, "led").select(F.col("node").alias("digest"), "component")
    labelled = large.join(labels, "digest", "left").withColumn("label", F.coalesce("component", "digest"))
    main = labelled.groupBy("g", "label").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "label"))["label"].alias("main"))
    labelled = materialise(labelled.join(main, "g").select("g", "k", "j", "digest", "label", "main", "shingles"), "labelled")
    outside = labelled.where("label <> main")
    pieces = materialise(outside.groupBy("g").agg(F.ceil(F.sum(F.length("shingles")) / (8 * BLOCK)).cast("int").alias("pieces")), "pieces")
    if pieces.isEmpty():
        return within, first
    cut = F.pmod(F.xxhash64("digest", F.lit(1)), F.col("pieces")).cast("int")
    queries = sided(every(outside.join(pieces, "g").drop("j"), "k", "j"), 0, cut, F.col("label"))
    index = every(labelled.join(pieces, "g"), "pieces", "i")
    index = sided(index, 1, F.col("i"), F.col("label"))
    second = queries.unionByName(index).groupBy("g", "i", "j").applyInArrow(between, schema)
    return within, first.unionByName(second)


# ---- what callers take


def row_classes(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of set_rows with their class: a digest, equal for all that links and equal ids join (null: an empty set)."""
    rows = materialise(set_rows(docs, n, id_col, text_col), "sets")
    stars, more = near_links(grouped(able_sets(docs, rows, n, percent, id_col, text_col), percent), percent)
    alike = rows.where("digest is not null and id is not null")
    unlike = alike.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("id", "a")
    same_id = materialise(alike.join(unlike, "id").where("a <> digest").select("a", F.col("digest").alias("b")), "same-id")
    if more is None and same_id.isEmpty():
        class_of = materialise(stars.select(F.col("b").alias("node"), F.col("a").alias("component")), "classes")
    else:
        edges = stars.unionByName(same_id)
        class_of = components(edges if more is None else edges.unionByName(more), "classes")
    class_of = class_of.select(F.col("node").alias("member"), "component")
    return materialise(rows.join(class_of, F.col("digest") == F.col("member"), "left").select("id", "hash", "n_shingles", "digest", F.coalesce("component", "digest").alias("class")), "row-classes")


def with_class(rows: DataFrame, of_class: DataFrame) -> DataFrame:
    """rows joined with a table (class, n, ...) of some classes of n rows, inner; classes with over a thousandth of all rows are a thousand at most and broadcast."""
    of_class = materialise(of_class, "of-class")
    bound = rows.count() // 1000
    hot = F.broadcast(of_class.where(F.col("n") > bound))
    return rows.join(hot, "class").unionByName(rows.join(hot, "class", "left_anti").join(of_class.where(F.col("n") <= bound), "class"))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: the smallest id reachable by links."""
    rows = row_classes(docs, n, percent, id_col, text_col)
    alone = rows.where("class is null").select("id", "n_shingles", F.col("id").alias("least"))
    least = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    found = with_class(rows, least).select("id", "n_shingles", "least").unionByName(alone)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of docs: that of the smallest id (null ids last), of repeated rows any one; rows with an empty set all stay."""
    rows = row_classes(docs, n, percent, id_col, text_col)
    best = rows.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("best"), F.count("*").alias("n")).where("n > 1")
    marked = with_class(rows, best).withColumn("stays", F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash")))
    told = materialise(marked.groupBy("id", "hash", "stays").agg(F.count("*").alias("times")).where("not stays or times > 1"), "told")
    names = free_name(docs, "own_id"), free_name(docs, "own_hash")
    same = column(id_col).eqNullSafe(F.col(names[0])) & (text_hash(column(text_col)) == F.col(names[1]))

    def apart(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """df without the told rows, and what of it is among them; many rows meet what may be among them only, or all of df would be shuffled."""
        rows, rest = rows.select(F.col("id").alias(names[0]), F.col("hash").alias(names[1])), None
        if rows.count() <= common.BROADCAST_ROWS:
            rows = F.broadcast(rows)
        else:
            df, rest = split_by_map(df, text_hash(column(text_col)), rows.select(names[1]))
        out = df.join(rows, same, "left_anti")
        return out if rest is None else rest.union(out), df.join(rows, same, "left_semi")

    kept = apart(docs, told.where("not stays"))[0]
    twice = told.where("stays")
    if twice.isEmpty():
        return kept
    once, repeated = apart(kept, twice)
    return once.union(repeated.dropDuplicates([id_col, text_col]))
