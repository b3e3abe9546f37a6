"""PII surrogates: keyed, type-consistent replacements that keep entities apart and together.

Detected: mail addresses (of any letters), telephone numbers (international, national, with an area code in
brackets), IPv4 and IPv6 addresses, card numbers of 13 to 16 digits, account numbers (IBAN) and social security
numbers that keep their checks, names after one title or several in Latin, Cyrillic or Greek letters, and later the
full name without its title in the same text (kind bare).  A name is whole tokens: inner capitals, hyphens,
apostrophes, all capitals, initials, particles and any number of parts.
A surrogate comes from a keyed hash of kind, entity and attempt.  It keeps the format: separators and
counts of digits, check digits, the script and case of letters, particles, the gender that a title shows.
Mentions of an entity (compared without regard to case or separators) get one surrogate.  Distinct
entities of a kind that meet in a surrogate are told apart by further attempts for all but the first,
as are surrogates that equal an entity of the corpus; the loop ends when none is left, as attempts widen
the space: names by a syllable each, the others when ATTEMPTS have found no free surrogate in the format, which then
give that up by a character.

A name is a family name, its last part, and maybe first names and initials.  Family names have surrogates of their
own, so that a surname alone and the full name keep it in common (in the script of the name); a first name's
surrogate is one of a number that stands for a name of either gender, and is told apart from the others of its
family.  A title that shows no gender takes that of the other mentions of the first name and family, in any text; where these
show both, the female one.  As no two family
names and no first names of one family meet, and no family name's surrogate is a family name of the
corpus, written names are apart from each other and from real ones whatever gender they are written in.

Only distinct entities are shuffled, then texts of documents that hold some.

Defined cases: a null or empty text has no entity and returns as it is; overlapping mentions count by
the earliest, then the longest; equal rows get equal results; rows without entities pass unshuffled.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fieldbook.llm.common import materialise, string_chunks

#: Attempts after which the space of a format counts as used up: then addresses may be any, digits and letters are added.
ATTEMPTS = 50
KINDS = ("iban", "ipv6", "email", "card", "ssn", "phone", "ip", "name", "bare")
_TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "doña": "f", "dr": "n", "prof": "n", "pan": "m", "pani": "f", "господин": "m", "г-н": "m", "госпожа": "f", "г-жа": "f", "доктор": "n", "профессор": "n", "κύριος": "m", "κος": "m", "κυρία": "f", "κα": "f"}
#: Small words within names.
_PARTICLES = "van von der den de del della la le di da do dos das du ter ten zu zum zur af av bin ibn al el y e".split()
#: Ranges of the letters of each script that names are found in.
SCRIPTS = {"latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "cyrillic": ((0x400, 0x52F),), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF))}


def _letters(upper: bool) -> str:
    found = (c for ranges in SCRIPTS.values() for a, b in ranges for c in map(chr, range(a, b + 1)) if c.isalpha())
    return "".join(c for c in found if not upper or c.isupper() or c.istitle())


_UPPER, _ANY = _letters(True), _letters(False) + "\u0300-\u036f"
_BLANK = "[ \\t\u00a0\u2000-\u200a\u202f\u3000]"
_TOKEN = f"[{_UPPER}][{_ANY}]*(?:['’‐-][{_ANY}]+)*(?!\\w)"
_INITIAL = f"[{_UPPER}]\\."
_LEAD = f"(?:(?:{'|'.join(_PARTICLES)}){_BLANK}+|{_INITIAL}{_BLANK}*)*"
_TITLE = "(?:" + "|".join(sorted({x for t in _TITLES for x in (t.capitalize(), t.upper(), *([t] if "-" in t else []))}, key=len, reverse=True)) + r")(?:\.\s*|\s+)"
_PATTERNS = {
    "email": re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+"),
    "card": re.compile(r"(?<![\d.])(?:(?:\d{4}[ -]?){3}\d{1,4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\d.]?\d)"),
    "ssn": re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"),
    "phone": re.compile(
        r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)"
        r"|(?<![\w.])\(0\d{1,4}\)[ ]?\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\w.]?\d)|(?<![\w.])0\d{2,4}[ /-]\d{2,4}(?:[ -]?\d{2,4}){1,3}(?![\w.]?\d)"
    ),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)"),
    "ipv6": re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:])"),
    "name": re.compile(rf"(?<!\w)((?:{_TITLE})+)({_LEAD}{_TOKEN}(?:{_BLANK}+{_LEAD}{_TOKEN})*)"),
}
_ONE_TITLE = re.compile(_TITLE)
_ONE_TOKEN = re.compile(f"{_INITIAL}|{_TOKEN}")
#: First names by gender (n: either), and family names are made of syllables of the script of Latin.
_FIRST = {"m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Noel Oscar Paul Rene Simon Theo Victor".split(), "f": "Ada Berta Clara Diana Emma Frida Greta Helen Ida Julia Klara Lena Marta Nora Olga Paula Rosa Sofia Tina Vera".split(), "n": "Alex Andrea Chris Dominique Jo Kim Lee Maxime Noa Robin Sam Sascha Toni Mika Eden Charlie Jamie Nicola Ulli Bente".split()}
#: Places in each of the lists: a first name's surrogate is one, whatever the gender it is written in.
_FIRSTS = 20
#: Letters of the other scripts for those that the lists and syllables are made of; no two syllables become one.
_LATIN = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
_WRITTEN = {
    "cyrillic": dict(zip(_LATIN, "а б ц д е ф г х и й к л м н о п к р с т у в в кс ы з".split(), strict=True)),
    "greek": dict(zip(_LATIN, "α μπ τσ ντ ε φ γκ χ ι τζ κ λ μ ν ο π κ ρ σ τ ου β β ξ υ ζ".split(), strict=True)),
}
_SYLLABLES = "ba be bi bo da de di do ga ge go la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split()


def script_of(name: str) -> str:
    """The script of a name's first letter, Latin if it is none of SCRIPTS."""
    return next((x for x, ranges in SCRIPTS.items() if any(a <= ord(name[:1] or "a") <= b for a, b in ranges)), "latin")


def written(name: str, script: str) -> str:
    """A name of Latin letters in another script, one capital first."""
    return name if script == "latin" else "".join(_WRITTEN[script].get(c, c) for c in name.lower()).capitalize()


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, mention) without overlaps; of a bare name the mention is its first one with a title."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _PATTERNS["email"].finditer(text)]
    if any(c in text for c in "0123456789"):
        for kind in ("card", "ssn", "iban", "phone", "ip"):
            found += [(m.start(), m.end(), kind) for m in _PATTERNS[kind].finditer(text) if holds(kind, m[0])]
    if "::" in text or text.count(":") > 6:
        found += [(m.start(), m.end(), "ipv6") for m in _PATTERNS["ipv6"].finditer(text) if holds("ipv6", m[0])]
    titled = {}  # full names, and the first mention of each with its title
    for m in _PATTERNS["name"].finditer(text):
        found.append((m.start(), m.end(), "name"))
        if len(_ONE_TOKEN.findall(m[2])) > 1:
            titled.setdefault(m[2], m[0])
    if titled:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(titled, key=len, reverse=True)))})(?!\w)")
        found += [(m.start(), m.end(), "bare") for m in again.finditer(text)]
    out, at = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if a >= at:
            out.append((a, b, kind, titled[text[a:b]] if kind == "bare" else text[a:b]))
            at = b
    return out


def holds(kind: str, mention: str) -> bool:
    """Whether what looks like an entity of a kind is one."""
    if kind == "card":
        digits = re.sub(r"\D", "", mention)
        return luhn(digits) or (len(digits) == 16 and "-" not in mention)
    if kind == "iban":
        return mod97(re.sub(r"\s", "", mention)) == 1
    if kind == "ipv6":
        try:
            return ipaddress.ip_address(mention).version == 6
        except ValueError:
            return False
    return True


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def canonical(kind: str, mention: str) -> str:
    """What mentions of one entity have in common."""
    if kind == "email":
        return mention.lower()
    if kind == "iban":
        return re.sub(r"\s", "", mention)
    if kind == "ipv6":
        return str(ipaddress.ip_address(mention))
    return mention if kind == "ip" else re.sub(r"\D", "", mention)


def name_of(mention: str) -> tuple[int, str, list[str]]:
    """(where the name starts behind its titles, the gender that they show or n, tokens, the last of which is the family name)."""
    at, gender = 0, "n"
    while (m := _ONE_TITLE.match(mention, at)) and _ONE_TOKEN.search(mention, m.end()):
        shown = _TITLES[m[0].strip().rstrip(".").lower()]
        gender, at = (shown if gender == "n" else gender), m.end()
    tokens = _ONE_TOKEN.findall(mention, at)
    return at, gender, tokens


def parts(kind: str, mention: str) -> list[tuple[str, str, str]]:
    """(kind, entity, gender) of what has a surrogate of its own: of a name the family name, then first names and initials within the family, as they come."""
    if kind not in ("name", "bare"):
        return [(kind, canonical(kind, mention), "n")]
    _, gender, tokens = name_of(mention)
    family = tokens[-1].lower()
    return [("family", family, "n")] + [("initial", f"{family} {t[0].lower()}", "n") if t.endswith(".") else ("first", f"{family} {t.lower()}", gender) for t in tokens[:-1]]


def _stream(key: bytes, *parts: str) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, "\0".join([*parts, str(block)]).encode(), hashlib.sha256).digest()
        block += 1


def surrogate(key: bytes, kind: str, entity: str, attempt: int) -> str:
    """The canonical form of the replacement; of a first name: its family, and #, its place in the lists and further syllables."""
    r = _stream(key, kind, entity, str(attempt))
    more = attempt // ATTEMPTS
    if kind == "email":
        name, _, host = entity.partition("@")
        letters = lambda s: "".join(chr(97 + next(r) % 26) if c.isalpha() else str(next(r) % 10) if c.isdigit() else c for c in s)
        first, *rest = host.split(".")
        name += "x" * more
        return f"{letters(name)}@{letters(first)}.{'.'.join(rest)}" if rest else letters(name) + "@" + letters(host)
    if kind == "ip":
        return ".".join([str(next(r)) if more else "10", *(str(next(r)) for _ in range(3))])
    if kind == "card":
        body = entity[:1] + "".join(str(next(r) % 10) for _ in range(len(entity) - 2 + more))
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        return body + (last if luhn(entity) else str((int(last) + 1 + next(r) % 9) % 10))
    if kind == "phone":
        fixed = len(entity) - 10 if len(entity) > 10 else 0  # the country stays
        return entity[:fixed] + "".join(str(next(r) % 8 + 2) if i == 0 else str(next(r) % 10) for i in range(len(entity) - fixed + more))
    if kind == "ssn":
        return "".join(str(next(r) % 10) for _ in range(9 + more))
    if kind == "ipv6":
        return str(ipaddress.ip_address(bytes([0xFD, *(next(r) for _ in range(15))])))
    if kind == "iban":
        body = "".join(str(next(r) % 10) if c.isdigit() else chr(65 + next(r) % 26) for c in entity[4:]) + "0" * more
        return f"{entity[:2]}{98 - mod97(entity[:2] + '00' + body):02d}{body}"
    if kind == "initial":
        return f"{entity.split(' ')[0]} ={''.join(chr(97 + next(r) % 26) for _ in range(1 + more))}"
    syllables = lambda n: "".join(_SYLLABLES[next(r) % len(_SYLLABLES)] for _ in range(n))
    if kind == "family":
        return written(syllables(3 + attempt).capitalize(), script_of(entity))
    return f"{entity.split(' ')[0]} #{next(r) % _FIRSTS} {syllables(attempt)}"


def shaped(kind: str, mention: str, new: list[tuple[str, str]]) -> str:
    """The surrogates of a mention's parts, each with the gender of its entity, in the mention's format."""
    if kind in ("card", "phone", "ssn", "iban"):
        signs = iter(new[0][0])
        return "".join(next(signs) if c.isalnum() else c for c in mention) + "".join(signs)
    if kind == "email":
        return new[0][0].upper() if mention.isupper() else new[0][0]
    if kind in ("name", "bare"):
        at, _, tokens = name_of(mention)
        family, *others = new
        made = iter([*(given(token, *x) for token, x in zip(tokens, others, strict=False)), cased(family[0], tokens[-1])])
        name = _ONE_TOKEN.sub(lambda m: next(made), mention[at:])
        return name if kind == "bare" else mention[:at] + name
    return new[0][0]


def cased(name: str, like: str) -> str:
    return name.upper() if len(like) > 1 and like.isupper() else name


def given(token: str, surrogate: str, gender: str) -> str:
    """A first name or initial, written as the token is."""
    sign, *more = surrogate.split(" ")[1:]
    script = script_of(token)
    if sign[0] == "=":
        return written(sign[1:], script).upper() + "."
    return cased(written(_FIRST[gender][int(sign[1:])] + "".join(more), script), token)


_MENTIONS = "array<struct<start: int, end: int, kind: string, mention: string, parts: array<struct<kind: string, entity: string, gender: string>>>>"


def detected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mentions) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string()), ("gender", pa.string())]))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("mention", pa.string()), ("parts", part)]))
        for batch in batches:
            for i, j, texts in string_chunks(batch.column(1)):
                found = [[{"start": a, "end": b, "kind": k, "mention": m, "parts": [{"kind": x, "entity": e, "gender": g} for x, e, g in parts(k, m)]} for a, b, k, m in entities(t)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(found, kind)], names=["id", "text", "mentions"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, text string, mentions {_MENTIONS}")


def mapping(distinct: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate), no two entities of a kind with one surrogate and none that is an entity."""

    @F.arrow_udf("string")
    def made(kind: pa.Array, entity: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k, e, n) for k, e, n in zip(kind.to_pylist(), entity.to_pylist(), attempt.to_pylist(), strict=True)], pa.string())

    current = materialise(distinct.select("kind", "entity", F.lit(0).alias("attempt")).withColumn("surrogate", made("kind", "entity", "attempt")), "surrogates")
    real = distinct.select(F.col("kind").alias("rk"), F.col("entity").alias("re"))
    while True:
        nth = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
        marked = current.withColumn("nth", nth).join(real, (F.col("kind") == F.col("rk")) & (F.lower("surrogate") == F.col("re")), "left")
        clash = (F.col("nth") > 1) | F.col("re").isNotNull()
        if marked.where(clash).isEmpty():
            return current.select("kind", "entity", "surrogate")
        again = marked.select("kind", "entity", F.when(clash, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), F.col("surrogate").alias("old"), clash.alias("clash"))
        again = again.withColumn("surrogate", F.when(F.col("clash"), made("kind", "entity", "attempt")).otherwise(F.col("old")))
        current = materialise(again.select("kind", "entity", "attempt", "surrogate"), "surrogates")


def replaced(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with surrogates, replacements array<struct<start, end, kind, surrogate>>) of each row; places are of the old text.

    Who has the key can test guesses at what a surrogate stands for: keep it secret, and use it again where corpora are to agree.
    """
    found = detected(docs, id_col, text_col)
    dirty = materialise(found.where(F.size("mentions") > 0).withColumn("row", F.monotonically_increasing_id()), "mentions")
    each = dirty.select("row", F.explode("mentions").alias("m")).select("row", "m.start", F.posexplode("m.parts").alias("part", "p")).select("row", "start", "part", "p.*")
    shown = F.min(F.when(F.col("gender") != "n", F.col("gender"))).alias("shown")  # of all mentions
    distinct = materialise(each.groupBy("kind", "entity").agg(shown), "entities")
    names = mapping(distinct, key).join(distinct, ["kind", "entity"])
    gender = F.when(F.col("gender") != "n", F.col("gender")).otherwise(F.coalesce("shown", F.lit("n")))
    new = each.join(names, ["kind", "entity"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "part", "surrogate", gender.alias("gender")))).alias("new"))

    @F.arrow_udf("array<struct<start: int, end: int, kind: string, surrogate: string>>")
    def formed(mentions: pa.Array, new: pa.Array) -> pa.Array:
        out = []
        for list_, made in zip(mentions.to_pylist(), new.to_pylist(), strict=True):
            at = iter(made)  # both by start
            out.append([{"start": m["start"], "end": m["end"], "kind": m["kind"], "surrogate": shaped(m["kind"], m["mention"], [(x["surrogate"], x["gender"]) for x in (next(at) for _ in m["parts"])])} for m in list_])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string())])))

    @F.arrow_udf("string")
    def rewritten(text: pa.Array, replacements: pa.Array) -> pa.Array:
        out = []
        for t, list_ in zip(text.to_pylist(), replacements.to_pylist(), strict=True):
            parts, at = [], 0
            for r in list_:
                parts += [t[at : r["start"]], r["surrogate"]]
                at = r["end"]
            out.append("".join([*parts, t[at:]]))
        return pa.array(out, pa.string())

    done = dirty.join(new, "row").select("id", "text", formed("mentions", "new").alias("replacements")).select("id", rewritten("text", "replacements").alias("text"), "replacements")
    none = F.array().cast("array<struct<start: int, end: int, kind: string, surrogate: string>>")
    clean = found.where(F.size("mentions") == 0).select("id", "text", none.alias("replacements"))
    return clean.unionByName(done).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "replacements")


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """The query's columns: the new text, and what was replaced, as kind:start:end."""
    r = replaced(docs, key)
    spans = F.array_join(F.transform("replacements", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return r.select("doc_id", F.size("replacements").cast("long").alias("n_entities"), spans.alias("spans"), F.transform("replacements", lambda x: x["surrogate"]).alias("surrogates"), "text")
