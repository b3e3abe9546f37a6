"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is SPAN consecutive item words (a shorter item is one window).  Both sides hash every GRAM
words; of each SPAN - GRAM + 1 neighbouring hashes the least is a fingerprint, so two texts that share
SPAN words share a fingerprint at the same place of them.  Documents keep the fingerprints that the
benchmark has (a bit map sized by the benchmark's windows sorts out nearly all others before any row
is made; beyond four million windows it fills and only sorts out less), each hit is extended to the windows around it, and those are joined with the benchmark's windows by their words.
Items below SPAN words are joined by their own lengths, at every place.

A window that very many documents contain costs a row for each of them: the benchmark's side is
unique by window, and it is broadcast only below a checked size; beyond it the join is a sort-merge
join whose hot keys AQE splits.

Defined cases: null has no words; an item without words has no window; a document without words has
zeros, no items and is not contaminated; a document or an item that is repeated counts as one row for
each of its rows (items: as one item, by its id); ids may be null and then are listed nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import column, free_name, materialise, small
from fieldbook.llm.words import words

SPAN, GRAM = 13, 5
#: Bits of the map of benchmark fingerprints: 16 for each window, within these bounds (128 KB to 8 MB).
MAP_BITS = (1 << 20, 1 << 26)
#: Rows of benchmark windows (a few hundred bytes each) that are broadcast.
BROADCAST_WINDOWS = 50_000
#: Low bits of a hash that give way to the place in its window.
PLACE_BITS = 8


def gram(hashes: str, at: Column, n: int) -> Column:
    """Hash of the n words from a place on."""
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(n)])


def mark(hashes: str, at: Column, n: int, start: Column) -> Column:
    """The hash with its low bits replaced by the place after a window's start, so that the least is the first of equals."""
    high = F.shiftleft(F.shiftright(gram(hashes, at, n), PLACE_BITS), PLACE_BITS)
    return high + (at - start)


def is_winnowed(hashes: str, at: Column, n: int, guard: int) -> Column:
    """Whether the place has the least mark of some guard neighbouring places."""
    last = F.size(hashes) - n - guard + 1
    first = F.greatest(at - guard + 1, F.lit(0))
    tries = F.when(first <= F.least(at, last), F.sequence(first, F.least(at, last))).otherwise(F.array().cast("array<int>"))
    return F.exists(tries, lambda j: F.forall(F.sequence(j, j + guard - 1), lambda q: mark(hashes, q, n, j) >= mark(hashes, at, n, j)))


def run_of(array: str, start: Column, n: int) -> Column:
    """n elements from start on.  slice() would copy the whole array first."""
    return F.array(*[F.get(array, start + k) for k in range(n)])


def map_bits(n_windows: int) -> int:
    """A power of two within MAP_BITS, of 16 bits and more for each window where the bound allows it."""
    return min(max(MAP_BITS[0], 1 << (16 * n_windows - 1).bit_length() if n_windows else 0), MAP_BITS[1])


def in_map(bit_map: Column, bits: int, h: Column) -> Column:
    cell = F.get(bit_map, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int"))
    return F.call_function("shiftright", cell, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def places(hashes: str, n: int) -> Column:
    """All places from which n words stand."""
    return F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))


def short_candidates(bit_map: Column, bits: int, n: int) -> Column:
    """Windows of n words whose hash the map has: for items below the span, whose hashes are taken whole."""
    at = F.filter(places("h", n), lambda i: in_map(bit_map, bits, gram("h", i, n)))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), run_of("w", i, n).alias("window")))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(n, window array<string>, items array<string>), one row for each different window."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(span)))
    each = w.select("item", "n", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.slice("w", i, F.col("n")))).alias("window"))
    return each.groupBy("n", "window").agg(F.collect_set("item").alias("items"))


def fingerprint_map(windows: DataFrame, bits: int, short: list[int], span: int, n: int) -> Column:
    """array<bigint> of so many bits, a literal, set for each fingerprint of a window."""
    hashed = windows.select("n", F.transform("window", lambda x: F.xxhash64(x)).alias("h"))
    least = F.array_min(F.transform(places("h", n), lambda q: mark("h", q, n, F.lit(0))))
    prints = hashed.where(F.col("n") == span).select(gram("h", least.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"), n).alias("x"))
    for m in short:
        prints = prints.unionByName(hashed.where(F.col("n") == m).select(gram("h", F.lit(0), m).alias("x")))
    bit = F.col("x").bitwiseAND(F.lit(bits - 1))
    set_bits = prints.select(F.shiftright(bit, 6).cast("int").alias("cell"), (bit % 64).cast("int").alias("bit")).distinct().groupBy("cell").agg(F.collect_list("bit").alias("bits"))
    cells = ["0"] * (bits // 64)
    for r in set_bits.collect():  # MAP_BITS bits at most
        v = sum(1 << b for b in r["bits"])
        cells[r["cell"]] = str(v - (1 << 64) * (v >> 63))
    return F.split(F.lit(",".join(cells)), ",").cast("array<bigint>")  # folded into one literal


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram_size: int = GRAM) -> DataFrame:
    """(id, n_words, n_hit, items array<string>, spans array<struct<start, end>>) of each document; spans are of words."""
    guard = span - gram_size + 1
    windows = materialise(benchmark_windows(items, item_col, item_text_col, span), "windows")
    counts = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # a row for each of span lengths at most
    short = sorted(n for n in counts if n < span)

    d = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"))
    d = d.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    bits = map_bits(sum(counts.values()))
    bit_map = fingerprint_map(windows, bits, short, span, gram_size)
    # the map first, as it is cheap and rules out nearly all places; then whether the place is a fingerprint of the document
    hits = F.filter(F.filter(places("h", gram_size), lambda p: in_map(bit_map, bits, gram("h", p, gram_size))), lambda p: is_winnowed("h", p, gram_size, guard))
    last = F.size("w") - span
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(p - guard + 1, F.lit(0)), F.least(p, last)))))
    found = [F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(span).alias("n"), run_of("w", i, span).alias("window")))]
    found += [short_candidates(bit_map, bits, n) for n in short]
    d = d.select("row", "id", F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(*found)).alias("c")).select("row", "id", "n_words", "c.*")
    right = windows.select("n", "window", "items")
    if sum(counts.values()) <= BROADCAST_WINDOWS:
        right = F.broadcast(right)
    matched = d.join(right, ["n", "window"], "left")
    span_of = F.when(F.col("items").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("end")))
    each = matched.groupBy("row", "id", "n_words").agg(F.array_sort(F.collect_set(span_of)).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    merged = F.aggregate("s", F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")), lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("hit")))
    return each.select(F.col("id").alias(id_col), "n_words", merged["hit"].cast("long").alias("n_hit"), "items", F.col("s").alias("spans"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    c = contamination(docs, items)
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, by the rule of report().  Ids may be null or repeated: a row goes by its id and text."""
    text = column(text_col)
    keyed = docs.select(F.struct(column(id_col).alias("id"), F.sha2(text, 256).alias("hash")).alias("doc"), text.alias("text"))
    names = free_name(docs, "bad_id"), free_name(docs, "bad_hash")
    bad = contamination(keyed, items, id_col="doc").where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("doc.id").alias(names[0]), F.col("doc.hash").alias(names[1])).distinct()
    return docs.join(small(materialise(bad, "bad")), column(id_col).eqNullSafe(F.col(names[0])) & (F.sha2(text, 256) == F.col(names[1])), "left_anti")
