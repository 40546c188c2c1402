"""Structure-first chunking of documents, each on its row: nothing is shuffled.

A document is cut into sections at headings, sections into units (bullets, sentences) and units are packed into
chunks with overlap. A chunk's units are neighbours, so a packed chunk is a range of unit numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import BULLET, CHUNK_SENTENCE, OPENING, approx_tokens, heading_level, heading_title, is_heading, let, not_blank, sentences, strip
from lodestone.operators.ordering import numbered
from lodestone.session import materialize, ship

# Sizes in characters.
TARGET_CHARS, OVERLAP_CHARS, MIN_CHUNK_CHARS = 1800, 300, 80
#: Documents of an Arrow batch while chunks are written.
CHUNKED_ROWS = 250


def units(body: Column) -> Column:
    """The parts of a section that stay whole, in order.

    Paragraphs stand between blank lines. One of which at least half of the lines (rounded down, 1 at least) are bullets is
    a list: each line is a unit, but indented lines that aren't bullets join the unit before. Others are cut into sentences.
    """

    def of_list(lines: Column) -> Column:
        follows = F.transform(lines, lambda x, i: (i > 0) & x.rlike(r"(?U)^\s+\S") & ~x.rlike(BULLET))
        starts = F.filter(F.transform(follows, lambda f, i: F.when(~f, i)), lambda i: i.isNotNull())

        def joined(at: Column) -> Column:
            # both arrays are made once: within the function of an element they would be made for each
            ends = F.concat(F.slice(at, F.lit(2), F.size(at) - 1), F.array(F.size(lines)))
            return F.zip_with(at, ends, lambda s, e: F.array_join(F.transform(F.slice(lines, s + 1, e - s), strip), " "))

        return F.filter(let(starts, joined), lambda u: u != "")

    def of_paragraph(paragraph: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            bullets = F.size(F.filter(lines, lambda x: x.rlike(BULLET)))
            prose = sentences(F.array_join(F.transform(lines, strip), " "), CHUNK_SENTENCE)
            return F.when(bullets >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2)), of_list(lines)).otherwise(prose)

        return let(F.split(strip(paragraph), "\n"), of_lines)

    paragraphs = F.filter(F.split(body, r"(?U)\n\s*\n"), not_blank)
    return F.flatten(F.transform(paragraphs, of_paragraph))


def with_sections(docs: DataFrame, text: str = "text", source: str = "source_name") -> DataFrame:
    """docs with title and sections, array<struct<section, body>>.

    The first level-1 heading is the title, else the source's name; every other heading starts a section. Text before any
    is the section OPENING. Sections with blank lines only are left out.
    """
    docs = docs.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    level1 = F.filter(F.transform("_lines", lambda x, i: F.when(heading_level(x) == 1, i)), lambda i: i.isNotNull())
    docs = docs.withColumn("_title_at", F.get(level1, F.lit(0)))
    docs = docs.withColumn("title", F.coalesce(F.nullif(heading_title(F.get("_lines", F.col("_title_at"))), F.lit("")), F.col(source)))
    docs = docs.withColumn("_lines", F.filter("_lines", lambda x, i: F.coalesce(i != F.col("_title_at"), F.lit(True))))
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    docs = docs.withColumn("_heads", F.concat(F.array(F.lit(-1)), heads))

    def section(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get("_heads", k + 1), F.size("_lines"))
        title = F.when(at < 0, F.lit(OPENING)).otherwise(heading_title(F.get("_lines", at)))
        return F.struct(title.alias("section"), strip(F.array_join(F.slice("_lines", at + 2, after - at - 1), "\n")).alias("body"))

    docs = docs.withColumn("sections", F.filter(F.transform("_heads", section), lambda s: not_blank(s["body"])))
    return docs.drop("_lines", "_title_at", "_heads")


def packed_ranges(lengths: Sequence[int], target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, end) of units for each chunk, given the units' lengths; a joint between two counts 1.

    A chunk closes when one more unit would exceed the target. The next starts with the last units that fit the overlap,
    and takes at least one unit more, whatever its size. Starts only move on, so time is in proportion to the units.
    """
    start, size = 0, 0  # size: the open chunk with a joint behind each unit
    for k, n in enumerate(lengths):
        if start < k and size + n + 1 > target:
            yield start, k
            while size - 1 > overlap:
                size -= lengths[start] + 1
                start += 1
        size += n + 1
    if lengths:
        yield start, len(lengths)


def packed_texts(units_: Sequence[str], target: int, overlap: int) -> list[str]:
    """The chunks' texts: units of each range joined by line ends; a short last one is joined to the one before."""
    texts = ["\n".join(units_[a:b]) for a, b in packed_ranges([len(u) for u in units_], target, overlap)]
    if len(texts) > 1 and len(texts[-1]) < MIN_CHUNK_CHARS:
        texts[-2:] = [f"{texts[-2]}\n{texts[-1]}"]
    return texts


def packed(target: int, overlap: int) -> Callable[[Column], Column]:
    """A function that packs array<struct<section, header, units>> into array<struct<section, content>>.

    Folding arrays in Spark's own functions copies them at every step; this reads each unit once, in Arrow batches.
    """

    @F.arrow_udf("array<struct<section:string,content:string>>")
    def pack(sections: pa.Array) -> pa.Array:
        rows = []
        for own in (x.as_py() for x in sections):
            room = lambda s: max(target - len(s["header"]) - 1, MIN_CHUNK_CHARS)
            rows.append([{"section": s["section"], "content": f"{s['header']}\n{t}"} for s in own for t in packed_texts(s["units"], room(s), overlap)])
        return pa.array(rows, pa.list_(pa.struct([("section", pa.string()), ("content", pa.string())])))

    return pack


def chunk_documents(docs: DataFrame, target_chars: int = TARGET_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks of documents (source_name, text): source_name, section, chunk_index, content, n_chars, approx_tokens.

    A chunk's content is a header, title and section, over its units; the header counts towards the target, but
    MIN_CHUNK_CHARS are left at least. chunk_index runs from 0 over a document's sections. Null and blank texts have no chunks.
    """
    ship(docs.sparkSession)
    docs = with_sections(docs.select("source_name", "text"))
    header = lambda s: F.concat(F.col("title"), F.lit(" — "), s["section"])
    docs = docs.withColumn("_units", F.transform("sections", lambda s: F.struct(s["section"].alias("section"), header(s).alias("header"), units(s["body"]).alias("units"))))

    every = docs.select("source_name", F.posexplode(packed(target_chars, overlap_chars)(F.col("_units"))).alias("chunk_index", "_chunk"))
    every = every.select("source_name", F.col("_chunk.section").alias("section"), "chunk_index", F.col("_chunk.content").alias("content"))
    n = F.length("content")
    return every.withColumns({"n_chars": n, "approx_tokens": approx_tokens(n)})


def with_ids(chunks: DataFrame) -> DataFrame:
    """chunks with id, their rank by source and index from 1, over ranges of both: no source, however large, is in one task.

    Chunks are written first, a few documents in an Arrow batch: ranges are found in one reading and dealt in another.
    """
    return numbered(materialize(chunks, CHUNKED_ROWS), "source_name", "chunk_index")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Number, least, mean (rounded down) and largest size of each source's chunks, and its sections."""
    return chunks.groupBy("source_name").agg(
        F.count("*").alias("n_chunks"),
        F.min("n_chars").alias("min_chars"),
        F.floor(F.sum("n_chars") / F.count("*")).alias("avg_chars"),
        F.max("n_chars").alias("max_chars"),
        F.sum("approx_tokens").alias("tokens"),
        F.count_distinct("section").alias("n_sections"),
    )


def neighbours_overlap(chunks: DataFrame, pattern: str = "\n") -> DataFrame:
    """Pairs of neighbouring chunks of a section, and whether the later one starts with a line that the earlier one has."""
    order = Window.partitionBy("source_name", "section").orderBy("chunk_index")
    pairs = chunks.withColumn("_next", F.lead("content").over(order)).where("_next is not null")
    first_line = F.get(F.split("_next", pattern), F.lit(1))
    return pairs.select("source_name", "section", "chunk_index", F.contains("content", first_line).alias("overlaps"))
