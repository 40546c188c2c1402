"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_ROWS, discard, map_arrow, materialize, release, table
from lodestone.llm.shingles import run_hashes, word_hashes

#: A perfect difference set: every residue modulo 31 is the difference of two members, all but 0 in one way.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)

#: Hashes in one Arrow batch, at least.
FLUSH = 200_000


def is_cover(cover: Sequence[int], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _anchors(words: np.ndarray, window: int, period: int, cover: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover, and hashes of the window - period + 1 words from each."""
    n = window - period + 1
    at = (np.arange(0, len(words), period)[:, None] + np.sort(np.array(cover))).ravel()
    at = at[at <= len(words) - n]
    return at, run_hashes(words, n, at)


def _emit(found: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches (h, doc) of each document's distinct hashes."""
    docs, hashes, n = [], [], 0

    def batch() -> pa.RecordBatch:
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), [len(x) for x in hashes]))], names=["h", "doc"])

    for doc, own in found:
        if len(own):
            docs.append(doc)
            hashes.append(np.unique(own))
            n += len(hashes[-1])
        if n >= FLUSH:
            yield batch()
            docs, hashes, n = [], [], 0
    if n:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text as bytes, the third column's list of hashes) of each row."""
    for batch in batches:
        lists = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
        for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), lists, strict=True):
            yield doc, (text.as_py() or "").encode(), np.empty(0, np.uint64) if own is None or own.values is None else own.values.to_numpy().view(np.uint64)


def repeated_words(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: Sequence[int] = COVER) -> DataFrame:
    """Removes words in windows that repeat from documents with a smaller id: doc_id, n_words, n_removed, kept.

    kept is the remaining words, joined by one space. A window is so many consecutive words of one document; each word is
    removed that a window covers whose words also start in a document with a smaller doc_id, in the input.

    Anchors, runs of window - period + 1 words, are hashed only at positions whose residue modulo period is in the
    difference cover. Wherever two documents share a window, the cover has an offset below period at which both
    are anchored, so they share that anchor. Anchors that one document alone holds go; shared ones extend: of
    the windows around them the hashes are compared, and a document's windows with a smaller holder are cut.
    No pairs are made: a hash's documents are counted, or the least of them is taken, and joined back, so that a passage
    in very many documents is combined before it is shuffled and split after. Intermediate tables go to the shared folder.

    Null texts are empty. Rows that repeat an id are one document, compared with others only; a null id has no smaller
    one, and such rows stay whole and remove nothing. No rows give no rows; other columns are ignored.
    """
    if not 0 < period <= window or not is_cover(cover, period):
        raise ValueError("cover must be a difference cover of a period within the window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit((doc, _anchors(word_hashes(text), window, period, cover)[1]) for doc, text, _ in _rows(batches))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, np.ndarray]]:
            for doc, text, shared in _rows(batches):
                words = word_hashes(text)
                at, hashes = _anchors(words, window, period, cover)
                whole = run_hashes(words, window)
                hits = np.zeros(len(words) + period + 1, np.int64)
                hits[at[np.isin(hashes, shared)] + 1] = 1
                hits = np.cumsum(hits)
                yield doc, whole[hits[period : period + len(whole)] > hits[: len(whole)]]

        yield from _emit(found())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, gone in _rows(iter([batch])):
                split = text.split()
                kept = split
                if len(gone):
                    starts = np.isin(run_hashes(word_hashes(text), window), gone)
                    cover_ends = np.zeros(len(split) + 1, np.int64)
                    cover_ends[: len(starts)] += starts
                    cover_ends[window : window + len(starts)] -= starts
                    stay = np.cumsum(cover_ends[:-1]) == 0
                    kept = [w for w, s in zip(split, stay.tolist(), strict=True) if s]
                rows.append((doc, len(split), len(split) - len(kept), b" ".join(kept)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    known = docs.where("doc_id is not null")
    found = materialize(map_arrow(known, anchors, "h long, doc long"), TEXT_ROWS)
    marks = materialize(found.join(found.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1").select("h"), "h", "left_semi").groupBy("doc").agg(F.collect_list("h").alias("_h")))
    discard(found)
    windows = materialize(map_arrow(known.join(marks, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "_h"), extend, "h long, doc long"), TEXT_ROWS)
    discard(marks)
    gone = materialize(windows.join(windows.groupBy("h").agg(F.min("doc").alias("_least")), "h").where("doc > _least").groupBy("doc").agg(F.collect_list("h").alias("_h")))
    discard(windows)
    release(docs.sparkSession)
    return map_arrow(docs.join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "_h"), cut, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM h JOIN m USING (h), range(50) t(k) WHERE doc_id > least),
g AS (SELECT doc_id, list(pos) AS gone FROM gone GROUP BY doc_id),
one AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT one.doc_id, string_agg(word, ' ' ORDER BY one.pos) AS kept FROM one LEFT JOIN gone ON one.doc_id = gone.doc_id AND one.pos = gone.pos WHERE gone.pos IS NULL GROUP BY one.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
