"""Vector search through an index of cells that leaves out what can't matter. top_k() is the plain form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import norm
from lodestone.operators.search import best_of, ranked
from lodestone.session import materialize, ship

#: Vectors that centroids are fitted on, cells, rounds of fitting, and cells that a question looks into first.
SAMPLE, CELLS, ROUNDS, FIRST = 20_000, 64, 8, 4
#: Vectors of one block of a cell, and questions of one block that ask the same cell.
BLOCK, ASKING = 2048, 256
#: How many standard deviations, of random directions, an approximate search allows for; see search().
SURE = 2.5


def fit(vectors: DataFrame, vector: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means, on the sample distinct vectors with the least hashes: a bounded number on the driver.

    Equal vectors count once, so that a very common one doesn't fill the sample. Only hashes in a share that about eight
    times the sample has are made distinct, and all where that share, full of copies, yields too few.
    """
    rows = vectors.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(vector).alias("_h"))
    share = min(1.0, 8 * sample / max(1, vectors.count()))
    picked = lambda some: [r["v"] for r in some.distinct().orderBy("_h", "v").limit(sample).collect()]
    found = picked(rows if share == 1 else rows.where(F.col("_h") / 2.0**64 + 0.5 < share))
    m = np.array(found if share == 1 or len(found) == sample else picked(rows), np.float64)
    m = m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else np.zeros((0, 1))
    centers = m[: min(cells, len(m))].copy()
    for _ in range(ROUNDS if len(m) else 0):
        best = (m @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, best, m)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.maximum(size, 1e-12), centers)
    return centers


def _units(column: pa.Array, rows: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list of each row of a matrix."""
    at = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim > 1 else 0)
    return pa.ListArray.from_arrays(at, pa.array(values.ravel(), kind))


def _some(vectors: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    return vectors.where(F.col(vector).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(key).cast("long"), F.col(vector), *more)


def _grouped(rows: DataFrame, by: list[str], parts: Column, size: int, names: tuple[str, str]) -> DataFrame:
    """Rows (by, id, unit) as blocks (by, names) of about size rows; parts says how many blocks a row's group makes."""
    salted = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), parts)))
    blocked = salted.groupBy(*by, "_part").agg(F.collect_list(F.struct("id", "unit")).alias("_b"))
    return blocked.select(*by, F.col("_b.id").alias(names[0]), F.flatten(F.col("_b.unit")).alias(names[1]))


class Index:
    """blocks (cell, ids, units) of unit vectors, centroids, and each cell's size and least and largest angle to its centroid."""

    def __init__(self, blocks: DataFrame, centers: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.blocks, self.centers, self.sizes, self.low, self.high = blocks, centers, sizes, low, high


def build(vectors: DataFrame, centers: np.ndarray, key: str = "id", vector: str = "embedding", path: str | None = None) -> Index:
    """The index of vectors: each goes to its nearest centroid's cell; null and zero vectors are left out.

    Cells are counted first, a row a cell on the driver, and dealt to blocks of about BLOCK vectors by a hash of the id,
    so a full cell is many blocks and no task has more than a few. Blocks are written, partitioned by cell, at path or
    in the shared folder.
    """
    spark = vectors.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _units(batch.column(1), batch.num_rows)
                scores = m @ sent.value.T
                cell = scores.argmax(axis=1)
                angle = np.arccos(np.clip(scores[np.arange(len(m)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(angle), _rows(m, pa.float64())], names=["id", "cell", "angle", "unit"])

    placed = _some(vectors, key, vector).mapInArrow(run, "id long, cell int, angle double, unit array<double>")
    sizes, low, high = np.zeros(len(centers), np.int64), np.full(len(centers), np.pi), np.zeros(len(centers))
    for cell, n, a, b in placed.groupBy("cell").agg(F.count("*"), F.min("angle"), F.max("angle")).collect():
        sizes[cell], low[cell], high[cell] = n, a, b
    parts = F.get(F.array(*[F.lit(int(-(-n // BLOCK))) for n in sizes]), F.col("cell")) if len(centers) else F.lit(1)
    blocks = _grouped(placed.select("cell", "id", "unit"), ["cell"], parts, BLOCK, ("ids", "units"))
    return Index(materialize(blocks, path=path, partition_by="cell"), centers, sizes, low, high)


def bounds(index: Index, scores: np.ndarray, sure: float | None) -> np.ndarray:
    """For questions with these scores to the centroids, what a vector of each cell can score at most.

    At angles a to a cell's centroid for the question and b for a vector, the score is cos a cos b + sin a sin b x, where
    x is the cosine between the directions in which they leave the centroid. It is 1 at most, which is the triangle
    inequality; of random directions in d - 1 dimensions it has the standard deviation 1 / sqrt(d - 1), and sure of these
    are allowed for. b lies between the cell's least and largest angle; -inf for an empty cell.
    """
    dims = max(2, index.centers.shape[1])
    x = 1.0 if sure is None else min(1.0, sure / np.sqrt(dims - 1))
    a = np.arccos(np.clip(scores, -1, 1))
    along, across = np.cos(a), np.sin(a) * x
    b = np.clip(np.arctan2(across, along), index.low, index.high)
    return np.where(index.sizes > 0, along * np.cos(b) + across * np.sin(b), -np.inf)


def search(questions: DataFrame, index: Index, k: int = 5, sure: float | None = SURE, first: int = FIRST, key: str = "qid", vector: str = "embedding") -> DataFrame:
    """qid, id, similarity, rank of each question's k best vectors of the index; ids of questions are unique.

    A question asks its first nearest cells; the k-th best score found there is what the others must beat. Then it asks
    the cells that may: those whose bounds() reach that score. With sure=None bounds are certain and the result is that
    of top_k(); else a cell may be left out wrongly, the more rarely the larger sure is. How many cells are asked follows the data: few
    if vectors lie in clusters, most if they don't, as in the test tables. reads() says how much is read.

    Questions meet cells by an equi-join on the cell, as blocks on both sides, and only k rows of a pair of blocks leave
    the task. A block of the index is read for the questions that ask its cell alone, and cells that none asks aren't read.
    """
    opened = _asked(questions, index, first, key, vector)
    near = materialize(_best(opened, index, k))
    last = near.where(F.col("rank") == k).select("qid", F.col("similarity").alias("_least"))
    more = questions.join(last, questions[key] == last["qid"], "left").select(questions[key], questions[vector], "_least")
    return ranked(near.drop("rank").union(_best(_asked(more, index, first, key, vector, sure, rest=True), index, k).drop("rank")), k)


def _asked(questions: DataFrame, index: Index, first: int, key: str, vector: str, sure: float | None = None, rest: bool = False) -> DataFrame:
    """(cell, id, unit) for each cell that a question asks: its first nearest ones, or the rest that may beat _least."""
    spark = questions.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((index.centers, index.sizes, index.low, index.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = Index(None, *sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ASKING):
                some = batch.slice(at, ASKING)
                m = _units(some.column(1), some.num_rows)
                scores = m @ given.centers.T if len(given.centers) else np.zeros((len(m), 0))
                full = np.where(given.sizes > 0, scores, -np.inf)
                opened = np.zeros(scores.shape, bool)
                np.put_along_axis(opened, np.argsort(-full, axis=1, kind="stable")[:, :first], True, axis=1)
                opened &= given.sizes > 0
                if rest:
                    least = some.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    opened = ~opened & (bounds(given, scores, sure) >= least[:, None] - 1e-9)
                row, cell = np.nonzero(opened)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), some.column(0).take(pa.array(row)), _rows(m[row], pa.float64())], names=["cell", "id", "unit"])

    return _some(questions, key, vector, *(["_least"] if rest else [])).mapInArrow(run, "cell int, id long, unit array<double>")


def _best(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """qid, id, similarity, rank of the k best vectors of the asked cells for each question."""
    asked = materialize(asked)
    counts = asked.groupBy("cell").agg(F.count("*").alias("_n"))
    blocks = _grouped(asked.join(F.broadcast(counts), "cell"), ["cell"], F.ceil(F.col("_n") / ASKING), ASKING, ("qids", "q_units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, units, qids, q_units in zip(*batch.columns[1:], strict=True):
                ids, qids = ids.values.to_numpy(), qids.values.to_numpy()
                scores = q_units.values.to_numpy().reshape(len(qids), -1) @ units.values.to_numpy().reshape(len(ids), -1).T
                row, column = best_of(scores, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids[column]), pa.array(scores[row, column])], names=["qid", "id", "similarity"])

    return ranked(index.blocks.select("cell", "ids", "units").join(blocks, "cell").mapInArrow(run, "qid long, id long, similarity double"), k)


def reads(questions: DataFrame, index: Index, k: int = 5, sure: float | None = SURE, first: int = FIRST, key: str = "qid", vector: str = "embedding") -> float:
    """The share of all pairs of a question and a vector that search() scores."""
    near = _best(_asked(questions, index, first, key, vector), index, k).where(F.col("rank") == k).select("qid", F.col("similarity").alias("_least"))
    more = questions.join(near, questions[key] == near["qid"], "left").select(questions[key], questions[vector], "_least")
    both = _asked(questions, index, first, key, vector).select("cell").union(_asked(more, index, first, key, vector, sure, rest=True).select("cell"))
    read = sum(int(index.sizes[r["cell"]]) * r["count"] for r in both.groupBy("cell").count().collect())
    return read / max(1, int(index.sizes.sum()) * _some(questions, key, vector).count())
