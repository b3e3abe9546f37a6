"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: every text that the rule
can match satisfies it.  A task indexes its texts in chunks: postings of the trigrams that some query
names (of the text with A-Z lower-cased), intersected and united as the query says; only the candidates
are verified by the expression itself.  A rule without mandatory trigrams scans every text fully.

Base rules (assign, access, hex) drop matches that are too short after matching; the others add spans.
Spans are in code points, ends exclusive.

Defined cases: a null or empty text has no span; each row is scanned by itself and whole; spans of
different rules may overlap and are all reported, ordered by start, then by the rules' order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import column, small_batches, text_chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Letters match in either case (ASCII only).
    any_case: bool = False
    #: Whether a match counts.
    holds: Callable[[re.Match], bool] = lambda m: True

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


def long_value(m: re.Match) -> bool:
    return m.end(2) - m.start(2) >= 6


def long_key(m: re.Match) -> bool:
    return m.end() - m.start() >= 20


def long_hex(m: re.Match) -> bool:
    return m.end() - m.start() >= 24


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, long_value),
    Rule("access", r"AKIA[A-Z0-9]+", False, long_key),
    Rule("hex", r"[0-9a-f]+", False, long_hex),
)
#: Public formats of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----)?"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}"),
    Rule("chat_token", r"xox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{32,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", True),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE


# ---- Boolean trigram queries: True, a trigram (bytes), ("and", ...) or ("or", ...)


def both(parts: list) -> object:
    flat = []
    for p in parts:
        if p is not True:
            flat.extend(p[1:] if isinstance(p, tuple) and p[0] == "and" else [p])
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", *flat)


def either(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *parts)


def of_strings(strings: set[str]) -> object:
    """What a text holds that has one of the strings."""
    grams = []
    for s in sorted(strings):
        b = s.lower().encode()
        grams.append(both([b[i : i + 3] for i in range(len(b) - 2)]))
    return either(grams)


#: A set of exact strings is carried along up to this size.
MOST = 16


def trigram_query(pattern: str) -> object:
    def walk(items) -> tuple[object, set[str] | None]:
        """The query of a sequence, and its strings if it has only these."""
        found, run, exact = [], {""}, True
        for op, arg in items:
            name = str(op)
            strings: set[str] | None = None
            query: object = True
            if name == "LITERAL":
                strings = {chr(arg)}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 4:
                strings = {chr(a) for _, a in arg}
            elif name == "SUBPATTERN":
                query, strings = walk(arg[3])
            elif name == "BRANCH":
                arms = [walk(x) for x in arg[1]]
                query = either([q for q, _ in arms])
                if all(s is not None for _, s in arms):
                    strings = set().union(*(s for _, s in arms))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, inner = arg
                query, strings = walk(inner)
                if strings is not None and (least, most) == (0, 1):
                    strings = strings | {""}
                elif (least, most) != (1, 1):
                    strings = None
                if least == 0:
                    query = True
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                strings = {""}
            if strings is not None and len(strings) * len(run) <= MOST:
                run = {a + b for a in run for b in strings}
            else:
                exact = False
                found += [of_strings(run), query]
                run = {""}
        if exact:
            return of_strings(run), run
        return both([*found, of_strings(run)]), None

    return walk(parser.parse(pattern))[0]


def grams_of(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(grams_of, query[1:]))


def candidates(query: object, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows (sorted) of a chunk of n that satisfy the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings[query]
    parts = sorted((candidates(q, postings, n) for q in query[1:]), key=len, reverse=query[0] == "or")
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


class Index:
    """Postings of the wanted trigrams of one chunk of texts."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, np.uint16)
        for k, g in enumerate(wanted):
            self.number[g[0] << 16 | g[1] << 8 | g[2]] = k + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        low = _LOWER[data]
        which = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(which)
        rows = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[rows + 1]
        seen = np.unique(which[at[inside]].astype(np.int64) << 32 | rows[inside])
        numbers, rows = seen >> 32, seen & 0xFFFFFFFF
        cuts = np.searchsorted(numbers, np.arange(1, len(self.wanted) + 2))
        return {g: rows[cuts[k] : cuts[k + 1]] for k, g in enumerate(self.wanted)}


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with the mask for each span (start, rule, end), which come in order; overlapping ones are one."""
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mask]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _scan(docs: DataFrame, rules: tuple[Rule, ...], text_col: str, keep: list[str], mask: str | None = None) -> DataFrame:
    """(the kept columns as _k0, _k1 and so on, spans array<struct<kind, start, end>>) of each row, spans in order; with a mask, _text in place of spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        patterns = [r.compiled() for r in rules]
        index = Index(sorted(set().union(*map(grams_of, queries))))
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            text_at = batch.schema.get_field_index("_text")
            for i, j, data, offsets in text_chunks(batch.column(text_at)):
                postings = index.postings(data, offsets)
                raw, texts = data.tobytes(), {}
                spans: list[list] = [[] for _ in range(j - i)]
                for k, (rule, query, pattern) in enumerate(zip(rules, queries, patterns, strict=True)):
                    for row in candidates(query, postings, j - i).tolist():
                        if (text := texts.get(row)) is None:
                            text = texts[row] = raw[offsets[row] : offsets[row + 1]].decode("utf-8", "replace")
                        spans[row].extend((m.start(), k, m.end()) for m in pattern.finditer(text) if rule.holds(m))
                columns = [batch.column(c).slice(i, j - i) for c in range(batch.num_columns) if c != text_at]
                if mask is None:
                    out = pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in sorted(s)] for s in spans], pa.list_(kind))
                else:
                    out = batch.column(text_at).slice(i, j - i)
                    if any(spans):
                        out = pa.array([masked(texts[k], sorted(spans[k]), mask) if spans[k] else t for k, t in enumerate(out.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, out], names=[n for n in batch.schema.names if n != "_text"] + ["spans" if mask is None else "_text"])

    small_batches(docs.sparkSession)
    chosen = docs.select(*[column(c).alias(f"_k{k}") for k, c in enumerate(keep)], column(text_col).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(run, schema + ("spans array<struct<kind: string, start: int, end: int>>" if mask is None else "_text string"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of each row, spans in order."""
    return _scan(docs, rules, text_col, [id_col]).withColumnRenamed("_k0", id_col)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the query."""
    base = [r.kind for r in BASE]
    s = F.col("spans")
    of = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *[of(k) for k in base], F.sha2(joined(F.filter(s, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(s).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by the mask; overlapping spans count as one."""
    rest = [c for c in docs.columns if c != text_col]
    found = _scan(docs, RULES, text_col, rest, mask)
    return found.select(*[F.col("_text" if c == text_col else f"_k{rest.index(c)}").alias(c) for c in docs.columns])
