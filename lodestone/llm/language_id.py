"""Language ID by compression: each text is encoded with a zstandard dictionary of each language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import map_arrow, materialize, table

#: The training sample: documents of each language, and code points of each, at most.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 2000
#: Bytes of a language's raw-content dictionary, the compression level, and the relative margin that rejects.
DICTIONARY, LEVEL, MARGIN = 65536, 9, 0.01
#: Bytes of a text's letters that are compressed at a time, so that the dictionary counts for all of a long text.
BLOCK = 16384

UNKNOWN = "und"
WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters_only(text: str) -> str:
    """text in lower case, each run of anything but letters and the marks that they carry as one space, between spaces."""
    return f" {' '.join(WORDS.findall(text.lower()))} "


def held_out(doc_id: Column) -> Column:
    """Whether a row isn't learned from; one without an id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary of each language among docs (doc_id, text, lang), from a bounded sample of its documents.

    A language's sample is the distinct texts with the least hashes, so many at most, and so many code points of each from
    an offset that its hash gives. Copies count once. The most frequent language among all of docs comes first. Rows
    with a null text or language teach nothing.
    """
    rows = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    hashes = materialize(rows.groupBy("lang", "_h").agg(F.count("*").alias("_n")))
    sizes = {r["lang"]: (r["n"], r["texts"]) for r in hashes.groupBy("lang").agg(F.sum("_n").alias("n"), F.count("*").alias("texts")).collect()}
    if not sizes:
        return {}
    counts = {lang: n for lang, (n, _) in sizes.items()}

    def least(of: DataFrame) -> list[tuple[str, int, int]]:
        ranked = of.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_k") <= sample_docs)
        return [tuple(r) for r in ranked.select("lang", "_h", "_k").collect()]

    share = F.create_map(*[F.lit(x) for lang, (_, n) in sizes.items() for x in (lang, min(1.0, 8 * sample_docs / n))])[F.col("lang")]
    chosen = least(hashes.where(F.col("_h") / 2.0**64 + 0.5 <= share))  # so that few rows are ranked, whatever the number of partitions
    got = Counter(lang for lang, _, _ in chosen)
    if short := [lang for lang, (_, n) in sizes.items() if got[lang] < min(sample_docs, n)]:
        chosen = [x for x in chosen if x[0] not in short] + least(hashes.where(F.col("lang").isin(short)))
    wanted = docs.sparkSession.createDataFrame(chosen, "lang string, _h long, _k int")
    part = F.expr(f"substring(text, cast(pmod(_h, greatest(length(text) - {sample_chars}, 0) + 1) as int) + 1, {sample_chars})").alias("_part")
    sample = rows.join(F.broadcast(wanted), ["lang", "_h"]).select("lang", "_k", part).groupBy("lang", "_k").agg(F.min("_part").alias("_part"))
    found: dict[str, list[str]] = {}
    for row in sample.orderBy("lang", F.desc("_k")).collect():
        found.setdefault(row["lang"], []).append(letters_only(row["_part"]))
    order = sorted(found, key=lambda lang: (-counts[lang], lang))
    return {lang: b for lang in order if len(b := "".join(found[lang]).encode()[-size:]) >= 8}


def _encoders(dictionaries: dict[str, bytes], level: int) -> list[tuple[str, object]]:
    import zstandard as zstd

    out = []
    for lang, data in dictionaries.items():
        shared = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        out.append((lang, zstd.ZstdCompressor(level=level, dict_data=shared, write_content_size=False)))
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text), from the whole text.

    Each text's letters are compressed with each dictionary, block by block; the language of the smallest sum of
    encodings is predicted, the first of dictionaries on ties. The margin is how much smaller it is than the second, in parts of that; score grows with
    it from 0 towards 1 and is 0.5 at twice the margin that rejects. Narrower texts are rejected. A text that is null
    or has no letter is 'und', with score 0, and rejected; so is every text if nothing was learned; a single
    language is predicted with score 1. Rows are handled where they are read; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(dictionaries, level)
        for batch in batches:
            found = [_predict(text.as_py() or "", encoders, margin) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(found)], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def _predict(text: str, encoders: list[tuple[str, object]], margin: float) -> tuple[str, float, bool]:
    if not encoders or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, True
    data = letters_only(text).encode()
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
    sizes = sorted((sum(len(e.compress(b)) for b in blocks), k, name) for k, (name, e) in enumerate(encoders))
    if len(sizes) == 1:
        return sizes[0][2], 1.0, False
    gain = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][2], gain / (gain + 2 * margin), gain < margin


def _columns(found: list[tuple[str, float, bool]]) -> list[pa.Array]:
    return [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that aren't held out, and predicts all rows."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
