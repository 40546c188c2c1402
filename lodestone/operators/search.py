"""Vector search: exact cosine top-k for many questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.routing import refused
from lodestone.functions.vectors import cosine, has_dimension, norm
from lodestone.session import materialize, ship

#: Vectors of a block, of questions and of candidates.
QUESTION_BLOCK, CANDIDATE_BLOCK = 256, 2048
#: Pairs of blocks in an Arrow batch.
PAIR_ROWS = 8


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k highest scores, ordered by row, score and id; ids belong to columns.

    Each row's k-th score is selected without sorting the row; only what reaches it is sorted, ties included.
    """
    n = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n] if n else np.zeros(len(scores))
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < n], column[place < n]


def resized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of size, however they come; the last may be smaller."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            held.append(batch.slice(at, size))
            if sum(b.num_rows for b in held) >= size:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                yield rows.slice(0, size)
                held = [rows.slice(size)]
    if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield rows.to_batches()[0]


def _blocks(vectors: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows of up to size vectors each, made where they are read: ids and the concatenated unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in resized(batches, size):
            if some.num_rows:
                m = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1).astype(np.float64)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_numpy()]), pa.array([m.ravel()])], names=[f"{prefix}_ids", f"{prefix}_units"])

    rows = vectors.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(key).cast("long"), F.col(vector))
    return rows.mapInArrow(run, f"{prefix}_ids array<long>, {prefix}_units array<double>")


def top_k(questions: DataFrame, candidates: DataFrame, k: int = 5, question_id: str = "qid", candidate_id: str = "id", vector: str = "embedding") -> DataFrame:
    """Each question's k most similar candidates: qid, id, similarity, rank. Ties go to the smaller id.

    Blocks of questions meet blocks of candidates, each pair in one matrix product of which only the k best of each
    question leave the task, so a row of the cross join stands for half a million comparisons. Spark sends the side that is
    small enough to all tasks, else pairs partitions. Such a row holds a megabyte and more, so few make an Arrow batch, and
    the k best of each are written. The k best of all blocks are limited in each partition before they are shuffled. Null and zero vectors are near nothing and left out; with fewer than k candidates all are ranked.
    """
    ship(questions.sparkSession)
    crossed = _blocks(candidates, candidate_id, vector, CANDIDATE_BLOCK, "c").crossJoin(_blocks(questions, question_id, vector, QUESTION_BLOCK, "q"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c_ids, c_units, q_ids, q_units in zip(*batch.columns, strict=True):
                ids, qids = c_ids.values.to_numpy(), q_ids.values.to_numpy()
                a, b = c_units.values.to_numpy().reshape(len(ids), -1), q_units.values.to_numpy().reshape(len(qids), -1)
                scores = b @ a.T
                row, column = best_of(scores, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[column]), pa.array(scores[row, column])], names=["qid", "id", "similarity"])

    return ranked(materialize(crossed.mapInArrow(best, "qid long, id long, similarity double"), PAIR_ROWS), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows (qid, id, similarity) of each qid with rank from 1."""
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hits_for_ids(wanted: DataFrame, questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Given (qid, id, position), the true similarity of each, in that order, marked as coming from the graph."""
    q = questions.select("qid", F.col("embedding").alias("_q"))
    c = candidates.select("id", F.col("embedding").alias("_c"))
    return wanted.join(q, "qid").join(c, "id").select("qid", "id", "position", cosine(F.col("_q"), F.col("_c")).alias("similarity"), F.lit("graph").alias("via"))


def gate(questions: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """Each question's best similarity, 0 without a hit, and whether it is refused."""
    top = hits.groupBy("qid").agg(F.max("similarity").alias("_top"))
    joined = questions.select("qid").join(top, "qid", "left")
    return joined.select("qid", F.coalesce("_top", F.lit(0.0)).alias("top_similarity"), refused(F.col("_top"), threshold).alias("refused"))


def vector_stats(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """One row: vectors, those of another dimension, and the largest deviation of a norm from 1."""
    return vectors.agg(
        F.count("*").alias("n"),
        F.count_if(~has_dimension(F.col(vector), dims)).alias("wrong_dimension"),
        F.max(F.abs(norm(F.col(vector)) - 1)).alias("max_deviation"),
    )
