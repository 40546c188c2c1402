"""Functions that check an answer against its context: citations, numbers, proper names."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestone.functions.text import ANSWER_SENTENCE, UPPER, sentences, strip

# Patterns and numbers of the checks.
CITATION = r"(?U)\[(\d+)\]"
NUMBER = r"(?U)\d+(?:[.,]\d+)?"
#: Numbers that are turns of phrase rather than facts.
NOT_FACTS = ("0", "1", "2")
PROPER = re.compile(rf"(?:[{UPPER}]\w*(?:\s+|$)){{2,}}")
#: After one of these, or at the start, a capital says nothing.
STARTS = frozenset("\n.!?:-•")
SHORT_NAME = 6


def cited(text: Column) -> Column:
    """The indices of all citations [n] in text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda n: n.cast("int"))


def invalid_citations(text: Column, n_sources: Column) -> Column:
    """Cited indices outside 1..n_sources, in order, repeats included."""
    return F.filter(cited(text), lambda n: (n < 1) | (n > n_sources))


def distinct_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def strip_citations(text: Column, n_sources: Column) -> Column:
    """text without citations outside 1..n_sources, and without the white space that they leave.

    Each invalid literal, such as [07], is removed as it is written; double spaces collapse and none stays before a
    punctuation mark, whether or not anything was removed.
    """
    literals = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))
    bad = F.filter(literals, lambda s: ~F.regexp_extract(s, CITATION, 1).cast("int").between(1, n_sources))
    cleaned = F.aggregate(bad, text, lambda t, s: F.replace(t, s, F.lit("")))
    cleaned = F.regexp_replace(F.regexp_replace(cleaned, " {2,}", " "), r"(?U)\s+([.,;:!?])", "$1")
    return strip(cleaned)


def citation_coverage(text: Column) -> Column:
    """The share of sentences with a citation; 0 without a sentence."""
    parts = sentences(text, ANSWER_SENTENCE)
    return F.coalesce(F.try_divide(F.size(F.filter(parts, lambda s: s.rlike(CITATION))), F.size(parts)), F.lit(0.0))


def normalized_number(token: Column) -> Column:
    """1,50 and 1.5 alike: the comma as a point, no zeros at the end; so 10,000 is 10. Whole numbers stay."""
    trimmed = F.regexp_replace(F.regexp_replace(F.translate(token, ",", "."), "0+$", ""), r"\.+$", "")
    return F.when(token.rlike("[.,]"), trimmed).otherwise(token)


def numbers(text: Column) -> Column:
    """Struct (norm, raw) of each number in text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: F.struct(normalized_number(t).alias("norm"), t.alias("raw")))


def ungrounded_numbers(answer: Column, haystack: Column) -> Column:
    """Numbers of the answer, besides citations and small ones, that haystack hasn't: as first written, in order."""
    known = F.transform(numbers(haystack), lambda n: n["norm"])
    found = F.filter(numbers(F.regexp_replace(answer, CITATION, "")), lambda n: ~n["norm"].isin(*NOT_FACTS))
    start = F.array().cast("array<struct<norm:string,raw:string>>")
    first = F.aggregate(found, start, lambda seen, n: F.when(F.exists(seen, lambda s: s["norm"] == n["norm"]), seen).otherwise(F.concat(seen, F.array(n))))
    return F.transform(F.filter(first, lambda n: ~F.array_contains(known, n["norm"])), lambda n: n["raw"])


def names_not_in(answer: str, haystack: str) -> list[str]:
    """Pairs of neighbouring capitalised words of the answer that the haystack hasn't, distinct and in order.

    Runs of two or more such words, each followed by white space or the end, are looked at; a run that the haystack
    holds whole or that is short is skipped, and the first word of one that starts a text, line or sentence.
    """
    low, found = haystack.lower(), []
    for match in PROPER.finditer(answer):
        run = match.group().strip()
        if len(run) < SHORT_NAME or run.lower() in low:
            continue
        words, ahead = run.split(), answer[: match.start()].rstrip(" \t")
        if not ahead.strip() or ahead[-1] in STARTS:
            del words[0]
        found += [f"{words[k]} {words[k + 1]}" for k in range(len(words) - 1)]
    return [pair for pair in dict.fromkeys(found) if pair.lower() not in low]


@F.arrow_udf(ArrayType(StringType()))
def ungrounded_names(answer: pa.Array, haystack: pa.Array) -> pa.Array:
    """names_not_in() for columns; needs the places of matches, which Spark's functions don't give."""
    return pa.array([names_not_in(a or "", h or "") for a, h in zip(answer.to_pylist(), haystack.to_pylist(), strict=True)], pa.list_(pa.string()))


def entailment_claims(response: Column) -> Column:
    """Claims that a verifier's response lists; none if it is empty or starts with its word for passed."""
    text = strip(F.coalesce(response, F.lit("")))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s.startswith("-"))
    claims = F.transform(lines, lambda s: strip(F.regexp_replace(s, "^[- ]+", "")))
    return F.when((text == "") | F.upper(text).startswith("ĐẠT"), F.array().cast("array<string>")).otherwise(claims)
