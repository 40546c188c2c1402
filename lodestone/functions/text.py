"""Text functions on columns, with Unicode semantics spelled out where Java's differ by default."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Patterns whose results must agree with other readers of the same documents.
#: Vietnamese upper-case letters; the even code points of U+1EA0..U+1EF8 are upper case.
UPPER = "A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝĂĐĨŨƠƯ" + "".join(chr(c) for c in range(0x1EA0, 0x1EFA, 2))
#: A wider class that also holds most accented lower-case letters; chunking and alias cutting use it as it is.
WIDE_UPPER = "A-ZĐÀ-Ỹ0-9"
HEADING = r"(?Ud)^(#{1,6})\s+(.*)$"
BULLET = r"(?Ud)^\s*(?:[-*•]|\d+\.)\s+"
CHUNK_SENTENCE = rf"(?U)(?<=[.!?:])\s+(?=[{WIDE_UPPER}])"
ANSWER_SENTENCE = rf"(?U)(?<=[.!?:])\s+(?=[{UPPER}0-9])"
#: Unicode white space, the characters of \s under (?U).
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: Blanks at a line's end. A match begins where a run of blanks does, so a long run is read once.
TRAILING = r"(?U)[\s&&[^\n]](?<![\s&&[^\n]]{2})[\s&&[^\n]]*+(?=\n)"
#: Title of the text before any heading.
OPENING = "Mở đầu"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row though body uses it more often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """text without Unicode white space at its ends, read from both ends; Spark's trim knows the space only unless it is told."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column, most: int | None = None) -> Column:
    """White space runs as single spaces, cut to so many characters."""
    one = F.regexp_replace(strip(text), r"(?U)\s+", " ")
    return one if most is None else F.substring(one, 1, most)


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Unicode NFC. Spark has no such function; texts that are normalised already are passed on unchanged."""
    return pa.array([t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def clean_text(text: Column, normalize: Callable[[Column], Column] = nfc) -> Column:
    """Normalised text: no byte-order marks or zero-width spaces, LF line ends, NFC, plain spaces, no trailing blanks.

    Runs of three line ends or more become two, and the whole is stripped.
    """
    text = F.replace(text, F.lit("\ufeff"), F.lit(""))
    text = normalize(F.regexp_replace(text, r"\r\n?", "\n"))
    text = F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    text = F.regexp_replace(text, TRAILING, "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def sentences(text: Column, pattern: str = CHUNK_SENTENCE) -> Column:
    """The non-empty sentences of text, stripped."""
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def fixed(number: Column) -> Column:
    """number with three decimals, rounded as C and Python do: by its exact binary value, ties to even.

    %.3f of format_string() rounds the shortest decimal that stands for the number, halves up: 0.8125 and 0.5005 would differ.
    format_number() keeps to the exact value but for 0.0005, which is a little more than its decimal and rounded down there.
    """
    return F.call_function("format_number", F.when(F.abs(number) == 0.0005, 2 * number).otherwise(number), F.lit("0.000"))


def approx_tokens(chars: Column) -> Column:
    """A third of a number of characters, halves to even."""
    return F.bround(chars / F.lit(3.0)).cast("int")


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_title(line: Column) -> Column:
    return strip(F.regexp_extract(line, HEADING, 2))


def is_heading(line: Column) -> Column:
    return line.rlike(HEADING)


def without_suffix(name: Column, suffix: str = ".txt") -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def short_name(name: Column) -> Column:
    """A model's name after its first slash."""
    return F.regexp_replace(name, "^[^/]*/", "")
