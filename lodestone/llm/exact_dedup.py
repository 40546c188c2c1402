"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, squeeze, table


#: Keys that repeat are marked by so many hash buckets at most, which bounds what is sent to all tasks.
BUCKETS = 1 << 21


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize=squeeze, prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when normalize(text) is; of equal texts the row with the most code points in its original text
    stays, then the smallest id (null ids last). What is left to compare shrinks level by level:

    1. One scan leaves a narrow row for each row of docs: its id, code points, normalised length and the hash of its
       first prefix_chars. These are counted by length, and those whose length repeats by length and prefix.
    2. A second scan takes the SHA-256 of the whole text of rows that share both with another, which alone decides;
       they are grouped by it. Rows that share neither are alone. With digest_all these get their SHA-256 in the same
       scan, else text_sha256 is null for them.

    So each text is read twice. The second scan knows what is left by marks: hash buckets of keys that repeat, eight
    for each such key, BUCKETS at most however many keys there are, so they are sent to all tasks and no text is
    shuffled; a row that shares a bucket only by chance is told apart by its hash. Narrow rows are shuffled, and
    a large group is split by its join.

    Null texts count as empty, and empty texts equal each other. Rows that repeat an id and a text count towards
    group_size and are kept or dropped alike: they are one document. No rows give no rows; other columns of docs
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select("_id", F.length("_text").alias("_n"), normalize(F.col("_text")).alias("_norm"))
    rows = rows.select("_id", "_n", "_norm", F.length("_norm").alias("_len"), F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix"))
    narrow = materialize(rows.select("_id", "_n", "_len", "_prefix"))
    lengths = narrow.groupBy("_len").agg(F.count("*").alias("_c")).where("_c > 1").select("_len")
    shared = narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_prefix").agg(F.count("*").alias("_c")).where("_c > 1")
    shared = materialize(shared.select(F.xxhash64("_len", "_prefix").alias("_key")))
    buckets = max(1, min(BUCKETS, 8 * shared.count()))
    marks = shared.select(F.pmod("_key", F.lit(buckets)).alias("_mark")).distinct()

    marked = rows.join(F.broadcast(marks), F.pmod(F.xxhash64("_len", "_prefix"), F.lit(buckets)) == F.col("_mark"), "left")
    left = F.col("_mark").isNotNull()
    hashed = materialize(marked.select("_id", "_n", "_len", left.alias("_left"), F.when(left | F.lit(digest_all), F.sha2("_norm", 256)).alias("_sha")))
    rest, alone = hashed.where("_left"), hashed.where("not _left")
    alone = alone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "_sha")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("last"), F.col("_id").alias("id")))
    groups = rest.groupBy("_len", "_sha").agg(F.count("*").alias("group_size"), best.alias("_best"))
    grouped = rest.join(groups, ["_len", "_sha"]).select("_id", F.col("_best.id").alias("keep_id"), "group_size", "_sha")
    both = grouped.union(alone)
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)
"""
