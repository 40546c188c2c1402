"""Best-fit packing of token pieces into sequences, by vectors of residual capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_ROWS, map_arrow, materialize, table
from lodestone.llm.encoding import encoder

#: Rows that one task ranks, about.
RANKED_ROWS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of n ids' pieces: all of capacity but the first, which has the rest."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, capacity: int, end_id: int, path: str | None) -> DataFrame:
    """A row for each piece of each document's ids. One document at a time is held besides its Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(_cut(len(ids), capacity))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SLOTS.types[:5], strict=True)], names=SLOTS.names[:5])

    return map_arrow(docs, run, PIECES)


def plan_bins(counts: dict[int, int], capacities: np.ndarray, demand, weights: np.ndarray, mode: str = "norm") -> np.ndarray:
    """Vector best-fit decreasing over a histogram: rows (length, first rank, how many, first sequence, offset).

    An item's demand vector depends on its length alone, so equal lengths are placed together: a group is a number
    of bins with the same content, and a placement moves a whole group or splits it. Lengths go from the largest;
    each is put where the weighted residual capacity it leaves has the least norm (mode "norm"), or where the
    weighted dot product of its demand with the residual capacity is least (mode "dot"), among bins that hold it
    under every constraint. The work and the plan depend on the number of lengths, not of items.
    """
    residual = np.empty((0, len(capacities)))
    groups: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # first sequence, bins, (length, first rank, offset)
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank, need = counts[length], 0, demand(length)
        if (need > capacities).any():
            raise ValueError(f"a piece of {length} exceeds an empty bin")
        while left:
            fits = np.flatnonzero((residual >= need).all(axis=1))
            if len(fits):
                rest = residual[fits]
                score = (((rest - need) / capacities * weights) ** 2).sum(axis=1) if mode == "norm" else (rest / capacities * (need / capacities) * weights).sum(axis=1)
                at = int(fits[np.argmin(score)])
                first, bins, slots = groups[at]
            else:
                each = int(np.floor(capacities / np.maximum(need, 1e-12)).min())
                at, first, bins, slots = len(groups), sequences, max(1, left // each), []
                sequences += bins
                groups.append((first, bins, slots))
                residual = np.vstack([residual, capacities])
            used = min(left, bins)
            if used < bins:
                groups.append((first + used, bins - used, [(n, a + used, o) for n, a, o in slots]))
                residual = np.vstack([residual, residual[at]])
            offset = sum(n for n, _, _ in slots)
            groups[at] = (first, used, [*slots, (length, rank, offset)])
            residual[at] = residual[at] - need
            left, rank = left - used, rank + used
    rows = [(n, a, bins, first, o) for first, bins, slots in groups for n, a, o in slots]
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with _rank, from 0 within each length. A frequent length is ranked in parts, by a salt of its rows."""
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, total // RANKED_ROWS))).alias("_salt")
    salted = pieces.select("*", salt)
    parts = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    return salted.withColumn("_row", F.row_number().over(within)).join(parts, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, max_docs: int | None = None, max_attention: float | None = None, weights: Sequence[float] = (1.0, 0.01, 0.01), mode: str = "norm", path: str | None = None) -> DataFrame:
    """Packs docs' (doc_id, text) ids, each document closed by end_id, into sequences of capacity tokens.

    A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than
    capacity are cut, into pieces of capacity of which the first may be shorter. A sequence holds at most capacity
    tokens, max_docs pieces and an attention cost (the sum of squared lengths) of max_attention; by default the
    last two are what a full sequence allows, so that tokens alone bind.

    Pieces are written to the shared folder; only the histogram of their lengths, at most capacity rows, reaches the
    driver, which plans on it. The plan, bounded by capacity too, is sent to all tasks, which look up their pieces
    by rank within their length. Null texts are empty and give one piece of one id; rows that repeat a document are
    packed as often; no rows give no rows; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs.select(F.col("doc_id").cast("long"), F.col("text")), capacity, end_id, path), TEXT_ROWS)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    capacities = np.array([capacity, max_docs or capacity, max_attention or float(capacity) ** 2])
    plan = plan_bins(counts, capacities, lambda n: np.array([n, 1, float(n) ** 2]), np.array(weights), mode)
    sent = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = sent.value
        lengths, nth = np.unique(slots[:, 0], return_inverse=True)
        starts = nth << 40 | slots[:, 1]  # by length, then rank
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "_rank"))
            at = np.searchsorted(starts, np.searchsorted(lengths, length) << 40 | rank, side="right") - 1
            sequence = slots[at, 3] + rank - slots[at, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in SLOTS.names[:5]), pa.array(sequence), pa.array(slots[at, 4])], schema=SLOTS)

    ranked = _ranked(pieces, sum(counts.values())).select(*SLOTS.names[:5], "_rank")
    return map_arrow(ranked, place, f"{PIECES}, sequence_id long, offset long")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
