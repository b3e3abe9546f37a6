"""Quality rules by compression bands.

Words are runs of characters other than ASCII blanks.  The verdict: zstandard's ratio (compressed
to plain bytes) of the whole text and of fixed chunks must lie between limits that depend on the
length; text below is repetitive, text above incompressible.  Every byte is in a chunk: the last chunk
is the text's last CHUNK bytes, and a shorter text is one chunk with the limits of its length.

Defined cases: a null or empty text has no words, ratio 1 and fails the base rule; every row is
judged by itself, so repeated rows agree; texts of any length are read whole, in one pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import string_chunks

#: (bytes at least, least ratio, greatest ratio) of a whole text, by half octaves.  The limits lie just
#: outside of what texts labelled good showed in 10,000 documents (3,200 of them).  Longer texts give
#: more context and compress better; none below 128 bytes is judged, as the format's frame outweighs it.
BANDS = (
    (0, 0.0, 9.9), (128, 0.45, 0.97), (256, 0.56, 0.8), (362, 0.54, 0.77), (512, 0.53, 0.75), (724, 0.505, 0.7), (1024, 0.488, 0.66), (1448, 0.468, 0.62), (2048, 0.46, 0.6),
    (2896, 0.447, 0.58), (4096, 0.432, 0.55), (5792, 0.422, 0.54), (8192, 0.412, 0.53), (11585, 0.405, 0.52), (16384, 0.4, 0.51), (23170, 0.393, 0.5), (32768, 0.385, 0.5), (65536, 0.375, 0.5),
)
CHUNK = 1024
#: Limits of one chunk of CHUNK bytes, and the share of a text's chunks that may lie outside.
CHUNK_LIMITS = (0.48, 0.7)
BAD_CHUNKS = 0.3
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


@dataclass
class Rules:
    level: int = 3
    bands: tuple = BANDS
    chunk: int = CHUNK
    chunk_limits: tuple = CHUNK_LIMITS
    bad_chunks: float = BAD_CHUNKS


def ratios(raw: bytes, compress, chunk: int) -> tuple[float, list[float]]:
    """Of the whole text, and of its chunks; the last one ends with the text, and a text below a chunk has none, as it is one as a whole."""
    whole = len(compress(raw)) / len(raw) if raw else 1.0
    at = list(range(0, len(raw) - chunk + 1, chunk))
    if at and at[-1] + chunk < len(raw):
        at.append(len(raw) - chunk)
    return whole, [len(compress(raw[i : i + chunk])) / chunk for i in at]


def verdict(n_bytes: int, whole: float, chunks: list[float], rules: Rules) -> str:
    """'' or what is wrong."""
    low, high = next((a, b) for least, a, b in reversed(rules.bands) if n_bytes >= least)
    if whole < low:
        return "repetitive"
    if whole > high:
        return "incompressible"
    low, high = rules.chunk_limits
    if chunks and sum(r < low for r in chunks) > rules.bad_chunks * len(chunks):
        return "repetitive chunks"
    if chunks and sum(r > high for r in chunks) > rules.bad_chunks * len(chunks):
        return "incompressible chunks"
    return ""


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows of three."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated, end = 0, 0
    if len(often) < len(windows):
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def judge(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, reason, ratio, worst and best chunk) of each row."""
    rules = rules or Rules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason", "ratio", "chunk_min", "chunk_max"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                rows = []
                for text in texts:
                    n, chars, symbols, lines, repeated = base_counts(text)
                    raw = text.encode("utf-8", "surrogatepass")
                    whole, chunks = ratios(raw, compress, rules.chunk)
                    failed = n < 50 or 100 * repeated > 50 * n
                    reason = "base" if failed else verdict(len(raw), whole, chunks, rules)
                    rows.append((n, chars, symbols, lines, repeated, failed, not reason, reason, whole, min(chunks, default=None), max(chunks, default=None)))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 3, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, reason string, ratio double, chunk_min double, chunk_max double"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
