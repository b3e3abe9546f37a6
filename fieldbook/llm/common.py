"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; a longer document is a chunk of its own.
CHUNK_BYTES = 400_000
#: Rows of a table (below 100 bytes each) that are broadcast.
BROADCAST_ROWS = 300_000
#: Bits of a map of hashes: 16 for each, within these bounds (a table of 16 thousand to half a million rows).
MAP_BITS = (1 << 20, 1 << 25)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its whole name, which may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand texts to Python in batches of so many rows: several of them are in memory at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("fieldbook.scratch", "")
        if not folder:
            folder = tempfile.mkdtemp(prefix="fieldbook-")
            spark.conf.set("fieldbook.scratch", folder)
    return folder


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and no executor holds it."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table of a few numbers a row, broadcast when it is counted to have few rows; beyond, Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def split_by_map(df: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key, a 64-bit hash, may be among those of a table of one column, and the rows whose key is not.

    A bit map of the hashes is broadcast, so only the first part needs to be shuffled; beside the rows that belong there it
    holds a sixteenth of the others at most, more beyond two million hashes.
    """
    bits = min(max(MAP_BITS[0], 1 << (16 * hashes.count()).bit_length()), MAP_BITS[1])
    cell = lambda x: F.shiftright(x.bitwiseAND(F.lit(bits - 1)), 6)
    place = lambda x: x.bitwiseAND(F.lit(63)).cast("int")
    names, h = (free_name(df, "map_cell"), free_name(df, "map_marks")), F.col(hashes.columns[0])
    marks = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place(h)))
    cells = materialise(hashes.groupBy(cell(h).alias(names[0])).agg(marks.alias(names[1])), "map")
    met = df.join(F.broadcast(cells), cell(key) == F.col(names[0]), "left")
    hit = F.coalesce(F.call_function("shiftright", F.col(names[1]), place(key)).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return met.where(hit).drop(*names), met.where(~hit).drop(*names)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end in them) of runs of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, at, data = column.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end row, texts) of runs of whole rows; null is an empty text."""
    for i, j, _, _ in text_chunks(column, limit):
        yield i, j, [x or "" for x in column.slice(i, j - i).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class RollingHash:
    """Hashes of any byte ranges of one array, from one pass over it (arithmetic modulo 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = np.empty(n + 1, np.uint64)
        self.up[0] = 1
        self.up[1:] = _BASE
        np.multiply.accumulate(self.up, out=self.up)
        down = np.empty(n + 1, np.uint64)
        down[0] = 1
        down[1:] = _BASE_INVERSE
        np.multiply.accumulate(down, out=down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(data.astype(np.uint64) + np.uint64(1)) * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(np.uint64))


def _numbers(place: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return mix(((place << 8) | byte).astype(np.uint64) * _BASE + np.uint64(0xD1B54A32D192ED03))


#: The numbers of all bytes at the first places of a word.
_PLACES = 32
_FIRST_NUMBERS = _numbers(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, runs of data one after another: a sum of numbers that stand at random for a byte at a place.

    Unlike a polynomial it has no words of a regular build that meet, whatever its factor.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.arange(int(lengths.sum()), dtype=kind) - np.repeat(first.astype(kind), lengths)
    byte = data[place + np.repeat(starts.astype(kind), lengths)]
    if int(lengths.max()) <= _PLACES:
        numbers = _FIRST_NUMBERS[(place << 8) | byte]
    else:
        numbers, far = _FIRST_NUMBERS[(np.minimum(place, _PLACES - 1) << 8) | byte], np.flatnonzero(place >= _PLACES)
        numbers[far] = _numbers(place[far].astype(np.int64), byte[far])
    return mix(np.add.reduceat(numbers, first) + lengths.astype(np.uint64))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that is not one itself.

    Rounds of star contraction: every larger neighbour of a node moves to the smallest one around it,
    then every node and its smaller neighbours move to the smallest of these, until all are stars.  Each
    round is cut by a table in the shared folder; one flag a round reaches the driver.
    """
    swapped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    current = materialise(edges.select("a", "b").unionByName(swapped).where("a <> b").distinct(), f"{tag}-edges")
    while True:
        least = current.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = current.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        stars = materialise(small.distinct(), f"{tag}-stars")
        twice = stars.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        if twice.unionByName(stars.join(stars.select(F.col("b").alias("a")), "a", "left_semi").select("a")).isEmpty():
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        current = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
