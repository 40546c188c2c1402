"""Deterministic verification of answers against the passages that they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.grounding import citation_coverage, distinct_sorted, invalid_citations, strip_citations, ungrounded_names, ungrounded_numbers
from lodestone.operators.graph import Surfaces, found_entities, match_surfaces
from lodestone.session import ship

# The words of flags, each before its list.
FLAGS = (
    ("invalid_citations", "trích dẫn không tồn tại: "),
    ("ungrounded_numbers", "số không có trong ngữ cảnh: "),
    ("ungrounded_entities", "thực thể không có trong ngữ cảnh: "),
    ("ungrounded_names", "tên riêng không có trong ngữ cảnh: "),
)


def _listed(name: str) -> Column:
    quote = F.lit("" if name == "invalid_citations" else "'")
    items = F.transform(F.col(name), lambda x: F.concat(quote, x.cast("string"), quote))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def flags() -> Column:
    """A sentence for each check that found something; columns named in FLAGS."""
    each = [F.when(F.size(name) > 0, F.concat(F.lit(words), _listed(name))) for name, words in FLAGS]
    return F.filter(F.array(*each), lambda f: f.isNotNull())


def needs_entailment(mode: str = "auto") -> Column:
    """Whether a costly check is worth it: always, never, or where citations, numbers or entities (not names) failed."""
    if mode != "auto":
        return F.lit(mode == "on")
    return (F.size("invalid_citations") > 0) | (F.size("ungrounded_numbers") > 0) | (F.size("ungrounded_entities") > 0)


def verify(answers: DataFrame, lexicon: DataFrame | None = None, ready: Surfaces | None = None) -> DataFrame:
    """answers (qid, question, answer, contents array<string>) with the cleaned text and what each check found.

    Added: text, invalid_citations (sorted, distinct), citation_coverage, ungrounded_numbers, ungrounded_entities,
    ungrounded_names, flags, escalate. Coverage, numbers and names are those of the cleaned text; the question counts as
    known for numbers and names, not for entities. Without a lexicon (surface, key, name, ...) of any size no entity is checked; ready
    is the same made ready, if the caller has it. Null answers and contexts are empty.
    """
    ship(answers.sparkSession)
    none = F.array().cast("array<string>")
    contents = F.coalesce("contents", none)
    answers = answers.withColumns({"_answer": F.coalesce("answer", F.lit("")), "_n": F.size(contents), "_context": F.array_join(contents, "\n")})
    answers = answers.withColumns({"text": strip_citations(F.col("_answer"), F.col("_n")), "_hay": F.concat("_context", F.lit("\n"), F.coalesce("question", F.lit("")))})
    answers = answers.withColumns(
        {
            "invalid_citations": distinct_sorted(invalid_citations(F.col("_answer"), F.col("_n"))),
            "citation_coverage": citation_coverage(F.col("text")),
            "ungrounded_numbers": ungrounded_numbers(F.col("text"), F.col("_hay")),
            "ungrounded_names": ungrounded_names(F.col("text"), F.col("_hay")),
        }
    )
    if lexicon is None:
        answers = answers.withColumn("ungrounded_entities", none)
    else:
        ready = ready or Surfaces(lexicon)
        said, known = (found_entities(match_surfaces(answers.select("qid", F.col(c).alias("t")), ready, "qid", "t"), lexicon, "qid") for c in ("text", "_context"))
        pairs = said.join(known.withColumnRenamed("names", "_known"), "qid", "left")
        apart = pairs.select("qid", F.array_except("names", F.coalesce("_known", none)).alias("_apart"))
        answers = answers.join(apart, "qid", "left").withColumn("ungrounded_entities", F.coalesce("_apart", none)).drop("_apart")
    return answers.drop("_answer", "_n", "_context", "_hay").withColumns({"flags": flags(), "escalate": needs_entailment()})


def verified(flags_: str = "flags", unsupported: str = "unsupported") -> Column:
    return (F.size(flags_) == 0) & (F.size(unsupported) == 0)


def total_ms(*parts: str) -> Column:
    return sum((F.coalesce(F.col(p), F.lit(0)) for p in parts), F.lit(0))
