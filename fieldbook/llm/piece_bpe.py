"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

A piece is possible where its characters, merged on their own, end as that piece; others never come
about.  A row of possible pieces is the result of all merges of a text exactly if each two neighbours,
put together and merged again, end as these two: the first merge across a border would also happen
with only the two around it there.  So a text is encoded from its left: an Aho-Corasick automaton
gives the longest piece at each place; it stays if it stands next to its predecessor, else its next
shorter prefix is tried; where none is left, the place is noted in a bitfield as failed, the
predecessor is taken back and shortened.  What leads up to a place is the one encoding of that
prefix, so a failed place has failed for good, and the cost is linear in the text.  Neighbours that
were merged again are remembered.

Texts are cut where no piece of the vocabulary can cross: before a space mark that follows another
character (a vocabulary with such a piece is not cut).  Each distinct word of a task is encoded once.

Defined cases: a null or empty text has the end id alone and decodes to nothing; repeated rows are
encoded each; a character that is in no piece becomes its bytes (or the unknown id, where the model has
no bytes); space marks of a text decode to spaces, as the library does it; columns other than id and
text are not read.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldbook.llm.byte_bpe import gather
from fieldbook.llm.common import column, mix, small_batches, string_chunks

SPACE = "▁"
#: Distinct words, and bits of the number of neighbours, that a task remembers.
REMEMBERED_WORDS = 500_000
PAIR_BITS = 20
#: Characters of a word whose failed places are the bits of one number; longer words are encoded one by one.
SHORT = 63
#: Fixed values of the model's format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass
class Model:
    """Pieces by id with their scores and kinds, and what the text is changed by before."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    end: int
    prefix: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers, and bytes of any other kind."""
    i = 0

    def number() -> int:
        nonlocal i
        out = shift = 0
        while True:
            out, shift, more = out | (data[i] & 127) << shift, shift + 7, data[i] > 127
            i += 1
            if not more:
                return out

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[i : i + n]
            i += n


def load_model(path: str) -> Model:
    """The vocabulary of a model file; models that change texts by tables, or have pieces of other kinds, are refused."""
    with open(path, "rb") as f:
        parts = list(_fields(f.read()))
    rows = [dict(_fields(v)) for k, v in parts if k == 1]
    trainer = dict(_fields(next(v for k, v in parts if k == 2)))
    normal = dict(_fields(next(v for k, v in parts if k == 3)))
    kinds = [r.get(3, NORMAL) for r in rows]
    # fixed values: field numbers of the format
    if trainer.get(3) != 2 or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("not a merge-type model that leaves texts as they are")
    return Model([r[1].decode() for r in rows], [struct.unpack("<f", r.get(2, bytes(4)))[0] for r in rows], kinds, trainer.get(42, 2), bool(normal.get(3, 1)))


@dataclass
class Merges:
    """How a text's characters merge: always the pair of least order, the leftmost of equals."""

    parts: list[str]  #: at the end
    orders: list[float]  #: of each merge, then infinity
    first: list[str]  #: the first part before each merge, and at the end
    last: list[str]


def merge(text: str, order: dict[str, float]) -> Merges:
    parts = list(text)
    out = Merges(parts, [], [parts[0]], [parts[-1]])
    while found := [(r, i) for i in range(len(parts) - 1) if (r := order.get(parts[i] + parts[i + 1])) is not None]:
        r, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out.orders.append(r)
        out.first.append(parts[0])
        out.last.append(parts[-1])
    out.orders.append(math.inf)
    return out


class Pieces:
    """The automaton of the possible pieces, their prefixes, and the test of neighbours."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == NORMAL}
        self.order = {p: -model.scores[i] for p, i in ids.items()}
        merges = {p: merge(p, self.order) for p in {c for p in ids for c in p} | ids.keys()}
        # frequent pieces first: the automaton tries a node's characters in the order in which they came
        self.text = sorted((p for p, m in merges.items() if m.parts == [p]), key=lambda p: (ids.get(p, len(model.pieces)), p))
        self.merges = [merges[p] for p in self.text]
        self.number = {p: k for k, p in enumerate(self.text)}
        self.size = [len(p) for p in self.text]
        self.back = [1 - n for n in self.size]
        self.shorter = [next((self.number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.number), -1) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.text):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.bytes = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        self.ids = [[ids[p]] if p in ids else self.of_unknown(p) for p in self.text]
        self.plain = all(len(i) == 1 for i in self.ids)  # no character of a piece that is none itself
        self.first_id = np.array([i[0] for i in self.ids], np.int32)
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids)
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.cuts else "(?s).+")
        # neighbours that were tested: a table by hash, where the later of two that meet in a slot stays
        self.tested, self.fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.sizes, self.shorts = np.array(self.size), np.array(self.shorter)

    def of_unknown(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]

    def stand_together(self, a: int, b: int) -> bool:
        """Whether a and b, put together and merged again, end as a and b: no pair across their border ever comes first."""
        left, right, i, j = self.merges[a], self.merges[b], 0, 0
        while True:
            across = self.order.get(left.last[i] + right.first[j], math.inf)
            if across < left.orders[i] and across <= right.orders[j]:
                return False
            if left.orders[i] <= right.orders[j]:  # the leftmost of equals
                i += 1
                if i == len(left.orders):
                    return True
            else:
                j += 1

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether neighbours stand together."""
        keys = left * len(self.text) + right
        slot = (mix(keys) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.fits[slot]
        new = np.flatnonzero(self.tested[slot] != keys)
        if len(new):
            found, back = np.unique(keys[new], return_inverse=True)
            out[new] = np.array([self.stand_together(*divmod(k, len(self.text))) for k in found.tolist()], bool)[back]
            self.tested[slot[new]], self.fits[slot[new]] = keys[new], out[new]
        return out

    def run(self, longest: list[int], start: int, stop: int) -> list[int]:
        """Numbers of the pieces of one run of known characters."""
        size, shorter = self.size, self.shorter
        failed = bytearray((stop - start) // 8 + 1)
        out: list[int] = []
        pos, piece = start, longest[start]
        while True:
            end = pos + size[piece]
            at = end - start
            if not failed[at >> 3] >> (at & 7) & 1 and (not out or self.stand_together(out[-1], piece)):
                out.append(piece)
                if end == stop:
                    return out
                pos, piece = end, longest[end]
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:
                at = pos - start
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                pos -= size[piece]

    def run_many(self, longest: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces in rows, counts) of words of known characters, SHORT at most; a step for all of them at once."""
        out, depth = np.zeros((len(start), int(length.max())), np.int64), np.zeros(len(start), np.int64)
        row, pos, piece, failed = np.arange(len(start)), np.zeros(len(start), np.int64), longest[start], np.zeros(len(start), np.uint64)
        one = np.uint64(1)
        while len(row):
            end = pos + self.sizes[piece]
            fits = failed >> end.astype(np.uint64) & one == 0
            test = np.flatnonzero(fits & (depth[row] > 0))
            fits[test] = self.fit(out[row[test], depth[row[test]] - 1], piece[test])
            yes = np.flatnonzero(fits)
            out[row[yes], depth[row[yes]]] = piece[yes]
            depth[row[yes]] += 1
            pos[yes] = end[yes]
            ended = np.zeros(len(row), bool)
            ended[yes] = end[yes] == length[row[yes]]
            on = yes[~ended[yes]]
            piece[on] = longest[start[row[on]] + end[on]]
            no = np.flatnonzero(~fits)
            shorter = self.shorts[piece[no]]
            piece[no] = shorter
            back = no[shorter < 0]
            failed[back] |= one << pos[back].astype(np.uint64)
            depth[row[back]] -= 1
            piece[back] = out[row[back], depth[row[back]]]
            pos[back] -= self.sizes[piece[back]]
            if ended.any():
                row, pos, piece, failed = row[~ended], pos[~ended], piece[~ended], failed[~ended]
        return out, depth

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, counts)."""
        joined = "".join(words)
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        # no piece crosses into a next word that starts with a space mark, unless the mark follows another
        apart = np.array([w[0] == SPACE and w[-1] != SPACE for w in words], bool)
        longest = np.full(len(joined), -1, np.int64)
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        longest[found[:, 0] + 1 - self.sizes[found[:, 1]]] = found[:, 1]  # of one start, the longest comes last
        strange = np.zeros(len(joined) + 1, np.int64)
        np.cumsum(longest < 0, out=strange[1:])
        plain = np.flatnonzero(apart & (length <= SHORT) & (strange[start + length] == strange[start]) & (self.plain and self.cuts and apart.any()))
        if len(plain):
            pieces, counts = self.run_many(longest, start[plain], length[plain])
            flat = self.first_id[pieces[np.arange(pieces.shape[1]) < counts[:, None]]]
        else:
            flat, counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(len(words)), plain, assume_unique=True)
        others = [self.encode(words[k]) for k in rest.tolist()]
        flat = np.concatenate([flat, np.array([i for x in others for i in x], np.int32)])
        counts = np.concatenate([counts, np.array([len(x) for x in others], np.int64)])
        order = np.argsort(np.concatenate([plain, rest]))
        return gather(flat, (np.cumsum(counts) - counts)[order], counts[order]), counts[order]

    def encode(self, word: str) -> list[int]:
        """Ids of a word."""
        longest, back = [-1] * len(word), self.back
        for end, k in self.automaton.iter(word):
            longest[end + back[k]] = k  # of one start, the longest comes last
        if -1 not in longest:
            return [i for k in self.run(longest, 0, len(word)) for i in self.ids[k]]
        out, pos = [], 0
        while pos < len(word):
            stop = pos
            while stop < len(word) and longest[stop] >= 0:
                stop += 1
            if stop > pos:
                out.extend(i for k in self.run(longest, pos, stop) for i in self.ids[k])
            if stop < len(word):
                out.extend(self.of_unknown(word[stop]))
            pos = stop + 1
        return out


#: What this worker made of the last model.
_pieces: dict[str, Pieces] = {}


class Encoder:
    """Ids of texts; words that came before are remembered."""

    def __init__(self, model: Model, name: str):
        if name not in _pieces:
            _pieces.clear()
            _pieces[name] = Pieces(model)
        self.pieces = _pieces[name]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.known) > REMEMBERED_WORDS:
            self.forget()
        model, known, cut, first = self.pieces.model, self.known, self.pieces.cut, len(self.known)
        which, counts = [], []
        for text in texts:
            words = cut.findall((SPACE * model.prefix + text.replace(" ", SPACE)) if text else "")
            which.extend([known.setdefault(w, len(known)) for w in words])
            counts.append(len(words))
        if len(known) > first:
            fresh, sizes = self.pieces.encode_words(list(islice(known, first, None)))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.lengths = np.concatenate([self.lengths, sizes])
            self.flat = np.concatenate([self.flat, fresh])
        which = np.array(which, np.int64)
        ids = gather(self.flat, self.starts[which], self.lengths[which])
        ends = np.concatenate([[0], np.cumsum(self.lengths[which])])[np.cumsum(counts)]
        ids = np.insert(ids, ends, model.end)  # an end id after each text
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends + np.arange(1, len(texts) + 1)]), pa.int32()), pa.array(ids, pa.int32()))


class Decoder:
    """Texts of ids: control ids are silent, bytes join to characters, a space that a prefix gave goes."""

    def __init__(self, model: Model):
        made = [
            b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(model.pieces, model.kinds, strict=True)
        ]
        self.prefix = model.prefix
        self.leads = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.silent = np.array([k == CONTROL for k in model.kinds])
        self.sizes = np.array([len(x) for x in made], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(made), np.uint8)

    def decode(self, lists: pa.ListArray) -> list[str]:
        out = []
        for k in range(0, len(lists), 500):
            part = lists.slice(k, 500)
            ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
                raise ValueError("an id is not in the vocabulary")
            bounds = np.concatenate([[0], np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds]
            raw = gather(self.data, self.at[ids], self.sizes[ids]).tobytes()
            for a, b, i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                while i < j and self.silent[ids[i]]:
                    i += 1
                skip = 1 if self.prefix and i < j and self.leads[ids[i]] else 0
                out.append(raw[a + skip : b].decode(errors="replace"))
        return out


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>, the end id last) of each row; if so wanted also the text (decoded) that they decode to, in the same worker."""
    small_batches(docs.sparkSession)
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # a vocabulary file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value, name), Decoder(shared.value) if decoded else None
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                ids = encoder.encode(texts)
                more = [pa.array(decoder.decode(ids), pa.string())] if decoder else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), ids, *more], names=["id", "ids", "decoded"][: 2 + decoded])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: Model, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids as a further column."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(shared.value)
        for lists in batches:
            yield pa.array(decoder.decode(lists), pa.string())

    return encoded.withColumn(out_col, text_of(column(ids_col)))


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """The digest columns of the query: counts and hashes of the ids and of the decoded text."""
    return encode(docs, load_model(path), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
