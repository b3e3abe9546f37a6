"""Words as column expressions: runs of digits, ASCII letters and every character beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words, once A-Z are lower-cased.  Splitting at these is several times faster than
#: extracting runs of all other characters, which Java's regular expressions test one range after another.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
RAW_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond ASCII that lower() could change.
_OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else changed; null is empty.

    lower() is many times faster than translate() and does the same where no other capital occurs.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BETWEEN), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(RAW_WORD)).cast("long")
