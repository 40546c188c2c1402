"""Importance resampling towards a target text: hashed n-gram features counted by a byte automaton that runs over whole Arrow buffers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import map_arrow, materialize, table

#: For each byte what it stands for in a word: itself, its lower-case letter, or 0 where it ends a word.
LETTER = np.zeros(256, dtype=np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    LETTER[_low : _high + 1] = np.arange(_low, _high + 1)
LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)

#: The table of CRC-32: what a byte at the end of the register turns into.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, (CRC >> 1) ^ np.uint32(0xEDB88320), CRC >> 1)
ONES, SPACE = np.uint32(0xFFFFFFFF), 0x20

#: Starts that advance together, bytes of text that are classified together (one text at least), and the number of
#: words below which the rest of each is finished by itself.
STARTS, BYTES, FEW = 1 << 18, 1 << 24, 24


def _advance(state: np.ndarray, letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers state after the word letters[start : start + length] of each."""
    order = np.argsort(-length if length.max(initial=0) >= 1 << 15 else (-length).astype(np.int16), kind="stable")
    state, start, length = state[order], start[order], length[order]
    shorter = -length
    step = 0
    while (n := int(np.searchsorted(shorter, -step))) >= FEW:
        some = state[:n]
        state[:n] = CRC[(some ^ letters[start[:n] + step]) & 0xFF] ^ (some >> 8)
        step += 1
    for i in range(n):
        rest = letters[start[i] + step : start[i] + length[i]]
        state[i] = zlib.crc32(rest, int(state[i] ^ ONES)) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, start, length, text) of the words of texts that lie one behind the other in data, from offset to offset.

    A word starts where a letter's predecessor is none or another text's, and ends likewise.
    """
    letters = LETTER[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = letters != 0
    edge = inside.copy()
    edge[1:] ^= inside[:-1]
    starts, ends = edge & inside, edge & ~inside
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    starts[cut], ends[cut] = True, True
    start = np.flatnonzero(starts)
    length = np.flatnonzero(ends) - start
    return letters, start, length, np.searchsorted(offsets, start, side="right") - 1


def feature_buckets(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of 1 to most words of a text, in blocks.

    A run's CRC is advanced from each start at once: over its first word, which gives the run of one, then over a
    space and the next word, and so on for the starts whose text has one.
    """
    letters, start, length, text = words_of(data, offsets)
    for at in range(0, len(start), STARTS):
        i = np.arange(at, min(at + STARTS, len(start)))
        state = np.full(len(i), ONES)
        for n in range(most):
            if n:
                goes_on = i + n < len(start)
                goes_on[goes_on] = text[i[goes_on] + n] == text[i[goes_on]]
                i, state = i[goes_on], state[goes_on]
                state = CRC[(state ^ SPACE) & 0xFF] ^ (state >> 8)
            state = _advance(state, letters, start[i + n], length[i + n])
            yield text[i], (state ^ ONES) % np.uint32(buckets)


def _buffers(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, number of rows, bytes, offsets from 0) of runs of texts of about BYTES; null texts are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if len(column):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
            end = min(end, len(column))
            yield at, end - at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end


def _counted(most: int, buckets: int):
    """Arrow batches of texts to a task's features for each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in _buffers(batch.column(0)):
                for _, bucket in feature_buckets(data, offsets, most, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", most: int = 3, buckets: int = 10000) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket; buckets without any are left out. Tasks send a row a bucket."""
    return map_arrow(docs.select(text_col), _counted(most, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(given: DataFrame, target: DataFrame, buckets: int = 10000) -> np.ndarray:
    """Each bucket's gain, floor(1000 * ln of the target's smoothed share over the given one); counts are (bucket, n), so buckets rows are collected."""
    spark = given.sparkSession
    both = given.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")).union(both)
    sums = materialize(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = sums.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda c: c.cast("double")
    share = d(F.col("t") + 1) * d(F.lit(whole["S"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(whole["T"] + buckets)))
    gains = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in sums.select("bucket", F.floor(1000 * F.log(share))).collect():
        gains[bucket] = gain
    return gains


def _weighed(gains: np.ndarray, most: int):
    """Arrow batches of (_id, text) to (_id, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = np.zeros((3, batch.num_rows), dtype=np.int64)
            for at, n, data, offsets in _buffers(batch.column(1)):
                for k, (text, bucket) in enumerate(feature_buckets(data, offsets, most, len(gains))):
                    found = np.bincount(text, minlength=n)
                    words[at : at + n] += found if k % most == 0 else 0
                    features[at : at + n] += found
                    np.add.at(weight, text + at, gains[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], ["_id", "n_words", "n_features", "weight"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each row of a partition its place there, from 1."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n + 1, n + 1 + batch.num_rows))], [*batch.schema.names, "_nth"])
        n += batch.num_rows


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with _rank, their place (from 1) in the order over all of them; equal rows in any order.

    Rows are dealt to partitions by ranges of the order, sorted and numbered within each, and written; then each
    partition's count is added up for those behind it. No task sees more than its range.
    """
    ranges = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", _nth long")
    placed = materialize(map_arrow(ranges, _numbered, schema))
    before, counts = 0, []
    for part, n in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a partition
        counts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(counts, "_part int, _before long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, most: int = 3, buckets: int = 10000, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row for each of docs: id_col, n_words, n_features, weight, score, rank.

    Features are the runs of 1 to most words of a text, as bytes, by CRC-32 modulo buckets. A document's weight sums
    the gains of its features, so it is the log of how much likelier target text is to have them than docs have, in
    thousandths. score adds Gumbel noise from a hash of "seed:id", which makes the highest scores a draw without
    replacement by weight. Of the N documents with least_words words or more, the floor(percent * N / 100) highest
    scores get a rank; equal scores go by id, null ids last (they hash as nothing), rows equal in both in any order.

    Texts are read twice: for counts, of which a task sends at most a row a bucket, and for weights. Everything else
    works on narrow rows. Null texts have no words; a text of any length is classified whole, and its starts advance
    in blocks, so memory follows the longest text. No rows give no rows; an empty target only makes gains smaller;
    other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_col, most, buckets), buckets)
    ids = dict(docs.dtypes)[id_col]
    weighed = map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), _weighed(gains, most), f"_id {ids}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed).withColumn("score", F.col("weight") + noise).withColumn("_short", F.col("n_words") < least_words)
    places = ranked(scored, F.col("_short"), F.col("score").desc(), F.col("_id").isNull(), F.col("_id"))
    drawn = places.where(~F.col("_short")).count() * percent // 100
    rank = F.when(~F.col("_short") & (F.col("_rank") <= drawn), F.col("_rank"))
    return places.select(F.col("_id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 from its definition: a table of 256 by recursion, then a fold over each feature's bytes.
OP13_SQL = r"""
WITH RECURSIVE crc(n, i, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE i < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS t FROM crc WHERE i = 8),
texts AS (SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT item_id, text, true FROM benchmark),
words AS (SELECT doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS MATERIALIZED (SELECT doc_id, target, array_to_string(w[i:i + n - 1], ' ') AS f, count(*) AS c FROM (SELECT doc_id, target, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, range(1, 4) AS r(n)) GROUP BY ALL),
h AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT), lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, tab),
n AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE NOT target), 0) AS s, coalesce(sum(c) FILTER (WHERE target), 0) AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT doc_id, sum(c) AS n_features, sum(c * gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE NOT target GROUP BY doc_id),
e AS (SELECT doc_id, len(w) >= 20 AS long, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM words LEFT JOIN d USING (doc_id) WHERE NOT target),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY long) AS n FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN long AND place <= 5 * n // 100 THEN place END AS rank FROM o
"""
