"""Text functions as column expressions; the order of their steps is part of what they promise."""

from __future__ import annotations

import html.entities
import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: C1 controls and what they stand for in Windows-1252; a no-break space is a space.
C1_FROM = "\x91\x92\x93\x94\x95\x96\x97\x85\xa0"
C1_TO = "‘’“”•–—… "
#: The entities that occur in plain pages; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))
#: White space other than a line feed.
BLANKS = r"\t\r\f\x0B\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: An opening tag of a link up to its end; group 1 or 2 is the target.
LINK = r"""<\s*a\b[^>]*href\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>"""
#: Words of a place name that say nothing of which place it is.
STOPWORDS = ("the", "and", "of", "state", "park", "national", "wildlife", "refuge", "area", "natural", "lake", "creek", "river", "road", "county", "washington", "wa", "usa")


def _folded(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Characters that a fold changes, by Unicode's compatibility decomposition; Hangul syllables have letters of their own and never fold to Latin ones.
_FOLDS = {c: _folded(c) for c in map(chr, range(0x80, sys.maxunicode + 1)) if not "\uac00" <= c <= "\ud7a3" and not "\ud800" <= c <= "\udfff" and _folded(c) != c}
#: Those that become one ASCII character (the first of each pair of texts), then those that vanish.
_ONE = {c: f for c, f in _FOLDS.items() if len(f) == 1 and f.isascii()}
ACCENTS_FROM = "".join(_ONE) + "".join(c for c, f in _FOLDS.items() if f == "")
ACCENTS_TO = "".join(_ONE.values())
#: Those that become several characters, some of them ASCII: ligatures, fractions, units.
LIGATURES = {c: f for c, f in _FOLDS.items() if len(f) > 1 and any(x.isascii() for x in f)}

#: What names of entities stand for, with their semicolon or, for the older ones, without.
_NAMED = html.entities.html5
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=len, reverse=True)
#: Numbers 128 to 159 mean Windows-1252, where it has them.
_CP1252 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}


def repair_c1(x: Column) -> Column:
    return F.translate(x, C1_FROM, C1_TO)


def _number(digits: Column, base: int) -> Column:
    """The character of a number; what is none, or a surrogate, is U+FFFD, and what HTML forbids is nothing."""
    n = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("long")).otherwise(0x110000)
    old = F.array(*[F.lit(c) for c in _CP1252.values()])
    low = n.bitwiseAND(F.lit(0xFFFF))
    bad = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (low >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd")).when(n == 13, F.lit("\r"))
        .when(n.between(128, 159), F.get(old, (n - 128).cast("int"))).when(bad, F.lit("")).otherwise(char)
    )


def _entity(p: Column) -> Column:
    """A text that followed an ampersand, with the entity at its start decoded."""
    common = {e[1:]: c for e, c in ENTITIES if e[1] != "#"} | {"nbsp;": "\xa0"}
    all_names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")
    decimal, hexadecimal = F.regexp_extract(p, "^#([0-9]+)", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+)", 1)
    name, bare = F.regexp_extract(p, r"^([^\t\n\f <&#;]{1,32};)", 1), F.regexp_extract(p, f"^({'|'.join(_BARE)})", 1)
    rest = lambda pattern: F.regexp_replace(p, pattern, "")
    out = F.when(p == "", F.lit("&"))
    for n, c in common.items():
        out = out.when(F.startswith(p, F.lit(n)), F.concat(F.lit(c), F.substr(p, F.lit(len(n) + 1))))
    known = F.when(name != "", F.try_element_at(all_names, name))
    return (
        out.when(decimal != "", F.concat(_number(decimal, 10), rest("^#[0-9]+;?"))).when(hexadecimal != "", F.concat(_number(hexadecimal, 16), rest("^#[xX][0-9a-fA-F]+;?")))
        .when(known.isNotNull(), F.concat(known, F.substr(p, F.length(name) + 1))).when(bare != "", F.concat(F.try_element_at(all_names, bare), F.substr(p, F.length(bare) + 1)))
        .otherwise(F.concat(F.lit("&"), p))
    )


#: Entities and what they stand for; where a text function takes none, all are decoded as HTML reads them.
Entities = tuple[tuple[str, str], ...]


def unescape_entities(x: Column, only: Entities | None = None) -> Column:
    """Every named, decimal and hexadecimal entity in one pass, as HTML reads them; the text is cut at its ampersands, without Python.

    With a list, those of it alone, each as it is written, in the order of the list.
    """
    if only is not None:
        for entity, char in only:
            x = F.replace(x, F.lit(entity), F.lit(char))
        return x
    return F.array_join(F.transform(F.split(x, "&"), lambda p, i: F.when(i == 0, p).otherwise(_entity(p))), "")


def inline_markdown(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?is)<\s*(?:em|i)\b[^>]*>(.*?)<\s*/\s*(?:em|i)\s*>", r"*$1*")
    x = F.regexp_replace(x, r"(?is)<\s*(?:strong|b)\b[^>]*>(.*?)<\s*/\s*(?:strong|b)\s*>", r"**$1**")
    x = F.regexp_replace(x, rf"(?is){LINK}\s*<\s*/\s*a\s*>", "")
    return F.regexp_replace(x, rf"(?is){LINK}(.*?)<\s*/\s*a\s*>", r"[$3]($1$2)")


def strip_tags(x: Column, by: str = "") -> Column:
    return F.regexp_replace(x, r"(?s)<[^>]+>", by)


def trim_lines(x: Column) -> Column:
    return F.array_join(F.transform(F.split(x, "\n"), lambda t: F.trim(F.regexp_replace(t, f"[{BLANKS}]+", " "))), "\n")


def clean_text(x: Column, only: Entities | None = None) -> Column:
    """Markup to plain text with Markdown marks; blank lines part paragraphs."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)(?:<br\s*/?>\s*){2,}", "\n\n")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>", "\n")
    x = repair_c1(unescape_entities(strip_tags(inline_markdown(x)), only))
    x = F.regexp_replace(x, "(?s)''(.+?)''", "“$1”")
    return F.trim(F.regexp_replace(trim_lines(x), "\n{3,}", "\n\n"), F.lit(" \n"))


def node_paragraphs(x: Column, only: Entities | None = None) -> Column:
    """The paragraphs of a node (the node itself if it has none), cleaned, blank ones dropped, parted by blank lines."""
    chunks = F.regexp_extract_all(x, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    chunks = F.when(F.size(chunks) > 0, chunks).otherwise(F.array(x))
    parts = F.flatten(F.transform(chunks, lambda c: F.split(clean_text(c, only), "\n\n")))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(" \n"))), lambda p: p != ""), "\n\n")


def collapse_ws(x: Column, only: Entities | None = None) -> Column:
    x = repair_c1(unescape_entities(F.coalesce(x, F.lit("")), only))
    return F.trim(F.regexp_replace(x, rf"[\n{BLANKS}]+", " "))


def visible_text(x: Column, only: Entities | None = None) -> Column:
    """Text that a page shows; independent of clean_text."""
    x = F.regexp_replace(x, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    x = F.translate(unescape_entities(strip_tags(x, " "), only), "\x91\x92\x93\x94", "‘’“”")
    return F.trim(F.regexp_replace(x, rf"[\n{BLANKS}]+", " "))


def audit_fold(x: Column) -> Column:
    """What an audit compares: straight marks, no Markdown, one case."""
    x = F.translate(x, "‘’“”–", "''\"\"-")
    x = F.replace(x, F.lit("—"), F.lit("--"))
    x = F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.replace(F.replace(x, F.lit("*"), F.lit("")), F.lit("''"), F.lit('"'))
    return F.lower(F.trim(F.regexp_replace(x, r"[ \t\n\r\f\x0B]+", " ")))


def name_fold(x: Column, keep_digits: bool = False) -> Column:
    """A name without accents (by compatibility decomposition), case, apostrophes and marks; word breaks stay."""
    x = F.translate(F.coalesce(x, F.lit("")), ACCENTS_FROM, ACCENTS_TO)
    split = F.transform(F.split(x, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(LIGATURES)), "map<string,string>"), c), c)))
    x = F.lower(F.when(x.rlike(r"[^\x00-\x7F]"), F.array_join(split, "")).otherwise(x))
    x = F.translate(F.regexp_replace(x, "['’‘`]", ""), "-_", "  ")
    x = F.regexp_replace(x, "[^a-z0-9 ]" if keep_digits else "[^a-z ]", "")
    return F.trim(F.regexp_replace(x, " +", " "))


def asset_name(url: Column) -> Column:
    path = F.rtrim(F.substring_index(url, "?", 1), F.lit("/"))
    return F.nullif(F.substring_index(path, "/", -1), F.lit(""))


def clean_url(x: Column) -> Column:
    """A link fit for a credit, or null."""
    t = F.trim(F.coalesce(x, F.lit("")), F.lit(" \t\n\"'"))
    return (
        F.when((t == "") | t.rlike("(?i)^(?:mailto:|#|javascript:)"), None)
        .when(t.rlike("(?i)^https?://"), t)
        .when(t.rlike(r"^[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?:/.*)?$"), F.concat(F.lit("http://"), t))
    )


def credit_text(x: Column, only: Entities | None = None) -> Column:
    return F.regexp_replace(collapse_ws(x, only), r"^(?:©|\(c\)) *", "")


def first_sentences(x: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(x, r"(?<=\.)[ \t\n\r\f\x0B]+"), 1, n), " ")


def name_tokens(x: Column) -> Column:
    """Distinct telling words of a name."""
    found = F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def label_from_key(x: Column) -> Column:
    return F.initcap(F.replace(x, F.lit("_"), F.lit(" ")))


def excerpt(x: Column, n: int = 180) -> Column:
    return F.substring(x, 1, n)


def file_stem(x: Column) -> Column:
    return F.regexp_replace(x, r"\.[^.]+$", "")
