"""Phrase collocations, counted in HAT-tries.

Words and phrases of two words are counted in one pass, phrases of three in another.  A task numbers words
and keeps its counts in a trie over word numbers: below a first word is a hash container of what
follows it; one that grows over BURST entries bursts into a node for each next word, so the trie
stays as shallow as a phrase is long.  When HELD entries are in it, the largest subtrees leave as sorted runs,
whole, until half is left; at the end the rest leaves.  Runs are dealt by prefix, the first two words, and the
task of a prefix merges them; a prefix that starts more than one of COMMON phrases is dealt by its third word
too, so it is not one task's.

A phrase that occurs often enough has only words and parts that do, so the second pass leaves out what
holds a word or a pair that is too rare.  What is frequent is told by a bit map of a fixed size that every task gets; the
more phrases a corpus has, the less it sorts out, and results do not depend on it.

Candidates then meet the counts of their parts by joins; scores are whole numbers in 38 digits.

Defined cases: null and empty texts have no words; a null language is 'und'; repeated rows count each;
phrases do not cross pieces, lines or documents; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldbook.llm.common import column, materialise, mix, small, small_batches, string_chunks

#: Entries of a container, entries and words of a task.
BURST = 16_384
HELD = 1_000_000
WORDS = 1_000_000
#: Phrases that wait to be added up before they are put into the trie.
WAITING = 1_000_000
#: A prefix is common if it starts one of so many phrases; and the rows of an Arrow batch.
COMMON = 4096
ROWS = 1000
#: Bits of the number of bits of the map of frequent phrases.
MAP_BITS = 25
_BITS = 21  # of a word's number: three make a key
_MASK = (1 << _BITS) - 1
_BREAK = b"\xff"  # in no text
_PLAIN = bytes(0xFF if chr(b) in ".,;:!?\n\v\f\r" else 32 if b in (9, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR, _WHOLE = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def phrase_hash(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, from the hashes of their first words, second words, and so on."""
    h = np.full(len(hashes[0]), word_hash(lang.encode()), np.uint64)
    for x in hashes:
        h = mix(h * _FACTOR + x)
    return h


def phrase_bits(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Places in the map of phrases."""
    return phrase_hash(lang, hashes) >> np.uint64(64 - MAP_BITS)


def mixed(x: int) -> int:
    """mix() of one number."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _WHOLE
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _WHOLE
    return x ^ x >> 31


class BitMap:
    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def has_word(self, lang_hash: int, h: int) -> bool:
        place = mixed(lang_hash * int(_FACTOR) + h & _WHOLE) >> 64 - MAP_BITS
        return bool(int(self.cells[place >> 6]) >> (place & 63) & 1)

    def has(self, places: np.ndarray) -> np.ndarray:
        return self.cells[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1) == 1


def bit_map(frequent: DataFrame) -> BitMap:
    """The map of the phrases of a table (lang, prefix, tail); of a fixed size, whatever the table's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, phrases = batch.column(0).to_pylist(), [f"{a} {b}".split(" ") if b else [a] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            by_lang: dict[str, list[list[str]]] = {}
            for g, p in zip(lang, phrases, strict=True):
                by_lang.setdefault(g, []).append(p)
            for g, listed in by_lang.items():
                places = phrase_bits(g, [np.array([word_hash(w.encode()) for w in x], np.uint64) for x in zip(*listed, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], names=["cell", "bits"])

    rows = frequent.select("lang", "prefix", "tail").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # 2 ** (MAP_BITS - 6) rows at most
    cells = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    cells[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    return BitMap(cells)


class Numbers(dict):
    """Numbers of one language's words, from 1; a word that is not frequent is 0, as is a break."""

    def __init__(self, lang: str, words: BitMap | None):
        super().__init__({_BREAK: 0})
        self.lang, self.lang_hash, self.map = lang, word_hash(lang.encode()), words
        self.names, self.hashes = [""], [0]
        self.trie = Node()

    def __missing__(self, word: bytes) -> int:
        h = word_hash(word)
        if self.map is not None and not self.map.has_word(self.lang_hash, h):
            self[word] = 0
            return 0
        self.names.append(word.decode())
        self.hashes.append(h)
        self[word] = len(self.names) - 1
        return len(self.names) - 1


class Node(dict):
    """Inner node of the trie: a word's number -> container (a plain dict of keys and counts) or node."""


def add(node: Node, heads: list[int], rests: list[int], counts: list[int], depth: int) -> int:
    """Entries gained by counts of phrases: the first word's number, and a key of the words behind it."""
    gained, get = 0, node.get
    for w, rest, n in zip(heads, rests, counts, strict=True):
        at = get(w)
        if at is None:
            node[w] = {rest: n}
            gained += 1
        elif type(at) is dict:
            if rest in at:
                at[rest] += n
            else:
                at[rest] = n
                gained += 1
                if depth > 1 and len(at) > BURST:
                    node[w] = burst(at, depth)
        else:
            shift = _BITS * (depth - 1)
            gained += add(at, [rest >> shift], [rest & (1 << shift) - 1], [n], depth - 1)
    return gained


def burst(container: dict, depth: int) -> Node:
    node, shift = Node(), _BITS * (depth - 1)
    add(node, [k >> shift for k in container], [k & (1 << shift) - 1 for k in container], list(container.values()), depth - 1)
    return node


def containers(at: dict, head: int, depth: int) -> Iterator[tuple[int, dict]]:
    """(words before, container) of a subtree."""
    if isinstance(at, Node):
        for w, child in at.items():
            yield from containers(child, head | w << _BITS * depth, depth - 1)
    else:
        yield head, at


def size(at: dict) -> int:
    return sum(map(size, at.values())) if isinstance(at, Node) else len(at)


class Counter:
    """Counts of the phrases of a task; what leaves it are runs (lang, part, lines).

    Of two words, single words are counted too, as a word with nothing behind it.  A line is a prefix, what
    follows it, and a count over one.
    """

    def __init__(self, length: int, maps: list[BitMap], parts: int, hot: frozenset[tuple[str, str]] = frozenset()):
        self.length, self.maps, self.parts, self.hot = length, maps, parts, hot
        self.langs: dict[str, Numbers] = {}
        self.total: dict[str, int] = {}
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.waits = self.held = 0

    def take(self, lang: str, texts: list[str]) -> None:
        own = self.langs.get(lang)
        if own is None:
            own = self.langs[lang] = Numbers(lang, self.maps[0] if self.maps else None)
        raw = b"\n".join(t.encode() for t in texts).translate(_PLAIN).replace(_BREAK, b" \xff ")
        ids = np.fromiter(map(own.__getitem__, raw.split()), np.int64)
        n = self.length
        if n == 2:
            self.total[lang] = self.total.get(lang, 0) + int((ids > 0).sum())
        many = max(0, len(ids) - n + 1)
        fits = ids[:many] > 0
        for j in range(1, n):
            fits &= ids[j : j + many] > 0
        at = np.flatnonzero(fits)
        if n > 2:  # both parts without a word at an end
            hashes = np.array(own.hashes, np.uint64)[ids]
            for first in (0, 1):
                at = at[self.maps[n - 2].has(phrase_bits(lang, [hashes[at + first + j] for j in range(n - 1)]))]
        keys = ids[at]
        for j in range(1, n):
            keys = keys << _BITS | ids[at + j]
        if n == 2:
            keys = np.concatenate([keys, ids[ids > 0] << _BITS])
        self.waiting.setdefault(lang, []).append(keys)
        self.waits += len(keys)
        if self.waits >= WAITING:
            self.settle()

    def settle(self) -> None:
        """Add up what waits, and put it into the tries."""
        shift = _BITS * (self.length - 1)
        for lang, waiting in self.waiting.items():
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            self.held += add(self.langs[lang].trie, (keys >> shift).tolist(), (keys & (1 << shift) - 1).tolist(), counts.tolist(), self.length - 1)
        self.waiting.clear()
        self.waits = 0

    def spill(self, everything: bool) -> Iterator[tuple[int, list[str], str]]:
        """Runs of the largest subtrees, until half of the entries is left, or of all: one for each part, whose lines start with the place of their language."""
        by_part: dict[int, tuple[list[str], list[str]]] = {}
        for lang, part, run in self.leaving(everything):
            langs, runs = by_part.setdefault(part, ([], []))
            if lang not in langs[-1:]:
                langs.append(lang)
            at = f"{len(langs) - 1}\t"
            runs.append(at + run.replace("\n", f"\n{at}"))
        for part, (langs, runs) in by_part.items():
            yield part, langs, "\n".join(runs)

    def leaving(self, everything: bool) -> Iterator[tuple[str, int, str]]:
        self.settle()
        leave: dict[str, list[int]] = {lang: list(own.trie) for lang, own in self.langs.items()}
        if not everything:
            trees = sorted(((size(child), lang, w) for lang, own in self.langs.items() for w, child in own.trie.items()), reverse=True)
            leave.clear()
            for n, lang, w in trees:
                if self.held <= HELD // 2:
                    break
                self.held -= n
                leave.setdefault(lang, []).append(w)
        shift = _BITS * (self.length - 1)
        for lang, heads in leave.items():
            own, found = self.langs[lang], []
            for w in heads:
                child = own.trie.pop(w)
                found.extend([(w << shift, child)] if type(child) is dict else containers(child, w << shift, self.length - 2))
            if found:
                yield from self.runs(own, found)
        if everything:
            for lang, n in self.total.items():
                yield lang, 0, f"\t\t{n}"
            self.langs.clear()
            self.total.clear()
            self.held = 0

    def runs(self, own: Numbers, found: list[tuple[int, dict]]) -> Iterator[tuple[str, int, str]]:
        sizes = [len(c) for _, c in found]
        keys = np.repeat(np.array([h for h, _ in found], np.int64), sizes) | np.fromiter(chain.from_iterable(c for _, c in found), np.int64, sum(sizes))
        counts = np.fromiter(chain.from_iterable(c.values() for _, c in found), np.int64, len(keys))
        hashes, names, n = np.array(own.hashes, np.uint64), np.array(own.names, object), self.length
        word = [keys >> _BITS * j & _MASK for j in range(n - 1, -1, -1)]
        # the part of a phrase goes by its first two words; by all of them where these alone are a common prefix
        part = phrase_hash(own.lang, [hashes[w] for w in word[:2]])
        if n > 2 and self.hot:
            number = {name: i for i, name in enumerate(own.names)}
            pairs = [[number.get(w, -1) for w in p.split(" ")] for lang, p in self.hot if lang == own.lang]
            common = np.isin(keys >> _BITS, np.array([a << _BITS | b for a, b in pairs if a > 0 and b > 0], np.int64))
            part = np.where(common, mix(part + hashes[word[2]]), part)
        part = (part >> np.uint64(8)) % np.uint64(self.parts)
        order = np.lexsort((keys, part))
        part, keys, counts = part[order], keys[order], counts[order]
        behind = zip(names[keys & _MASK].tolist(), counts.tolist(), strict=True)
        heads = [names[keys >> _BITS * j & _MASK].tolist() for j in range(n - 1, 0, -1)]
        before = heads[0] if n == 2 else map(" ".join, zip(*heads, strict=True))
        lines = [f"{p}\t{t}" if c == 1 else f"{p}\t{t}\t{c}" for p, (t, c) in zip(before, behind, strict=True)]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(lines)], strict=True):
            yield own.lang, int(part[a]), "\n".join(lines[a:b])


def runs_of(rows: DataFrame, length: int, maps: list[BitMap], parts: int, hot: frozenset[tuple[str, str]]) -> DataFrame:
    """(part, langs, run) of the phrases of so many words in rows (lang, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((maps, hot))  # of a fixed size, and a few prefixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(length, shared.value[0], parts, shared.value[1])

        def leave(everything: bool) -> Iterator[pa.RecordBatch]:
            spilled = counter.spill(everything)
            while out := list(islice(spilled, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.string()), pa.string()), strict=True)], names=["part", "langs", "run"])

        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                by_lang: dict[str, list[str]] = {}
                for g, t in zip(batch.column(0).slice(i, j - i).to_pylist(), texts, strict=True):
                    by_lang.setdefault(g, []).append(t)
                for g, listed in by_lang.items():
                    counter.take(g, listed)
                if sum(len(x) for x in counter.langs.values()) > WORDS:
                    yield from leave(True)
                elif counter.held > HELD:
                    yield from leave(False)
        yield from leave(True)

    return rows.mapInArrow(run, "part int, langs array<string>, run string")


def counted(rows: DataFrame, length: int, maps: list[BitMap], least: int, hot: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """(lang, prefix, tail, n) of the phrases that occur so often; single words have no tail, and the count of all words has no prefix either."""
    parts = max(256, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = runs_of(rows, length, maps, parts, hot).repartition("part")
    lines = runs.select("part", "langs", F.explode(F.split("run", "\n")).alias("line")).select("part", "langs", F.split("line", "\t").alias("f"))
    lang = F.get("langs", F.get("f", F.lit(0)).cast("int"))
    each = lines.select(lang.alias("lang"), "part", F.get("f", F.lit(1)).alias("prefix"), F.get("f", F.lit(2)).alias("tail"), F.coalesce(F.get("f", F.lit(3)).cast("long"), F.lit(1)).alias("n"))
    merged = each.groupBy("lang", "part", "prefix", "tail").agg(F.sum("n").alias("n"))  # runs of a part lie together already
    return materialise(merged.where((F.col("n") >= least) | ((F.col("prefix") == "") & (F.col("tail") == ""))).select("lang", "prefix", "tail", "n"), f"phrases{length}")


def score_of(left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)): products in 38 digits, divided to whole numbers."""
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST({left} AS DECIMAL(18,0)) * CAST({right} AS DECIMAL(18,0)))")


def collocations(docs: DataFrame, least: int = 10, share: int = 50, k: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first k phrases of two and three words that occur at least so often.

    a counts the phrase, l and r the parts of its worst cut, n all words.  A phrase inside a longer candidate that makes
    up so many percent of it is left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(column(lang_col).cast("string"), F.lit("und")).alias("lang"), column(text_col).alias("text"))
    short = counted(rows, 2, [], least)
    words, pairs = short.where("prefix <> '' AND tail = ''"), short.where("tail <> ''")
    total = short.where("prefix = ''").select("lang", F.col("n").alias("total"))
    share_of = short.where("prefix = ''").agg(F.sum("n")).first()[0] or 0
    # prefixes that start so many phrases that they are dealt by what follows: fewer than COMMON, as pairs are no more than words
    hot = frozenset((r.lang, r.p) for r in pairs.where(F.col("n") * COMMON > share_of).select("lang", F.concat_ws(" ", "prefix", "tail").alias("p")).collect())
    triples = counted(rows, 3, [bit_map(words), bit_map(pairs)], least, hot)
    single = words.select("lang", F.col("prefix").alias("part"), F.col("n").alias("f"))
    double = pairs.select("lang", F.concat_ws(" ", "prefix", "tail").alias("part"), F.col("n").alias("f"))

    def with_counts(t: DataFrame, parts: DataFrame, key: str, out: str) -> DataFrame:
        return t.join(small(parts.select("lang", F.col("part").alias(key), F.col("f").alias(out))), ["lang", key])

    two = pairs.select("lang", F.concat_ws(" ", "prefix", "tail").alias("phrase"), F.col("prefix").alias("left"), F.col("tail").alias("right"), F.col("n").alias("a"))
    two = with_counts(with_counts(two, single, "left", "l1"), single, "right", "r1")
    three = triples.select("lang", F.concat_ws(" ", "prefix", "tail").alias("phrase"), F.col("prefix").alias("left2"), F.col("tail").alias("right2"), F.col("n").alias("a"))
    three = three.select("*", F.substring_index("left2", " ", 1).alias("left"), F.concat_ws(" ", F.substring_index("left2", " ", -1), "right2").alias("right"))
    for parts, key, out in ((single, "left", "l1"), (double, "right", "r1"), (double, "left2", "l2"), (single, "right2", "r2")):
        three = with_counts(three, parts, key, out)
    three = materialise(three.select("lang", "phrase", "left2", "right", "a", "l1", "r1", "l2", "r2"), "triples")
    inside = three.select("lang", "a", F.explode(F.array("left2", "right")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    two = two.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))

    def cut(left: str, right: str) -> Column:
        return F.struct(score_of(left, right).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))

    both = [two.select("lang", "phrase", "a", cut("l1", "r1").alias("c")), three.select("lang", "phrase", "a", F.when(cut("l2", "r2")["score"] < cut("l1", "r1")["score"], cut("l2", "r2")).otherwise(cut("l1", "r1")).alias("c"))]
    found = reduce(DataFrame.unionByName, both).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    best = found.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)  # tasks hand on k rows of a language
    return best.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
