"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, materialize, n_words, table

#: Bins of a source's sampling keys; a bin holds about this share of a source.
BINS = 65536
#: Bins that one task sums up; sums of such shelves are summed again.
SHELF = 256


def letter_share(text: Column) -> Column:
    """A document's quality weight: the share of letters, of any script, in its non-blank characters, 0.05 at least."""
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""))
    letters = solid - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.greatest(F.lit(0.05), F.coalesce(F.try_divide(letters, solid), F.lit(0.0)))


def uniform(*key: Column) -> Column:
    """A number inside (0, 1) that depends on the key alone: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (_source, _size) with _target: share of all sizes dealt by weight, none above most times its source.

    The level at which targets stop is found without a loop: sources in order of how soon their cap binds, the
    capped ones take their caps, the others share the rest by weight. Sources are ordered by code point, null last,
    and weigh weights, repeating. This orders one narrow row for each source.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_w", F.element_at(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1))
    by_cap = Window.orderBy(F.try_divide(F.col("_size") * most, F.col("_w")), F.col("_source").isNull(), "_source")
    every, before = Window.partitionBy(), by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("_size") * most
    level = F.try_divide(F.sum("_size").over(every) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levelled = ranked.select("_source", "_size", "_w", level.alias("_level"), F.row_number().over(by_cap).alias("_at"))
    free = F.min(F.when(F.col("_level") * F.col("_w") <= cap, F.struct("_at", "_level"))).over(every)["_level"]
    return levelled.select("_source", "_size", F.least(cap, F.coalesce(free * F.col("_w"), cap)).alias("_target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, quality: Column | None = None, seed: str = "mix", bins: int = BINS) -> DataFrame:
    """How often the mix takes each row of docs: id_col, size, source_size, target, copies, taken (copies * size).

    Targets in size units come from source_targets(). A source is first taken whole as often as its target allows;
    the rest of its target goes to documents in order of their Efraimidis-Spirakis keys -ln(u) / quality, where u
    is a hash of the id, up to the prefix sum nearest the rest. To split large sources, keys fall into bins: totals by
    (source, bin) are combined before the shuffle and prefix-summed, by shelves of SHELF bins and within each; bins below the rest are taken whole, and only
    documents of the one bin in which the rest ends are sorted. Documents are dealt by (source, bin), never by source. No document is taken more than ceil(most) times.

    quality: a positive weight column, by default letter_share of text. Null sizes and texts count 0 and go with
    complete epochs; null sources are a source; rows that repeat an id share its key and are ordered by size; no
    rows give no rows; other columns are ignored. Reruns agree, whatever the partitioning.
    """
    size = n_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    quality = letter_share(F.col("text")) if quality is None else quality
    u = uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_n"), (-F.log(u) / F.greatest(quality, F.lit(1e-6))).alias("_key"))
    rows = materialize(rows.withColumn("_bin", F.floor((1 - F.exp(-F.col("_key"))) * bins).cast("int")))

    sizes = rows.groupBy("_source").agg(F.sum("_n").alias("_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.coalesce(F.floor(F.try_divide(F.col("_target"), F.col("_size"))), F.lit(0)).cast("long")
    targets = targets.select(F.col("_source").alias("_s"), "_size", "_target", epochs.alias("_epochs"), (F.col("_target") - epochs * F.col("_size")).alias("_rest"))

    binned = rows.groupBy("_source", "_bin").agg(F.sum("_n").alias("_b")).withColumn("_shelf", F.floor(F.col("_bin") / SHELF).cast("int"))
    below = Window.partitionBy("_source").orderBy("_shelf").rowsBetween(Window.unboundedPreceding, -1)
    shelves = binned.groupBy("_source", "_shelf").agg(F.sum("_b").alias("_shelved"))
    shelves = shelves.select(F.col("_source").alias("_of"), F.col("_shelf").alias("_nth"), F.coalesce(F.sum("_shelved").over(below), F.lit(0)).alias("_below"))
    up_to = Window.partitionBy("_source", "_shelf").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = binned.withColumn("_within", F.sum("_b").over(up_to)).join(shelves, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_shelf") == F.col("_nth")))
    binned = binned.withColumn("_end", F.col("_below") + F.col("_within"))
    binned = binned.join(targets, F.col("_source").eqNullSafe(F.col("_s")))
    binned = binned.select("_s", F.col("_bin").alias("_k"), "_size", "_target", "_epochs", "_rest", (F.col("_end") - F.col("_b")).alias("_before"), (F.col("_end") <= F.col("_rest")).alias("_whole"))
    rows = rows.join(binned, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bin") == F.col("_k")))

    ends = ~F.col("_whole") & (F.col("_before") < F.col("_rest"))
    by_key = Window.partitionBy("_source", "_bin").orderBy("_key", F.col("_id").isNull(), "_id", "_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = rows.where(ends).withColumn("_sum", F.col("_before") + F.sum("_n").over(by_key))
    nearest = (F.col("_sum") - F.col("_rest")) <= (F.col("_rest") - (F.col("_sum") - F.col("_n")))
    both = cut.withColumn("_more", nearest.cast("long")).drop("_sum").unionByName(rows.where(~ends).withColumn("_more", F.col("_whole").cast("long")))
    copies = F.col("_epochs") + F.when(F.col("_rest") > 0, F.col("_more")).otherwise(0)
    return both.select(F.col("_id").alias(id_col), F.col("_n").alias("size"), F.col("_size").alias("source_size"), F.col("_target").alias("target"), copies.alias("copies"), (copies * F.col("_n")).alias("taken"))


#: The water level is found step by step here: each step fixes the caps that bind at it.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS solid, length(regexp_replace(coalesce(text, ''), '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS other,
  (('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05, CASE WHEN solid = 0 THEN 0 ELSE (solid - other)::DOUBLE / solid END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w FROM k GROUP BY source),
lv(i, level, n) AS (SELECT 0, (SELECT sum(source_size) * 1.5 / sum(w) FROM s)::DOUBLE, 0::BIGINT
  UNION ALL SELECT i + 1, (SELECT ((SELECT sum(source_size) * 1.5 FROM s) - coalesce(sum(2.0 * source_size) FILTER (WHERE level * w > 2.0 * source_size), 0)) / nullif(sum(w) FILTER (WHERE level * w <= 2.0 * source_size), 0) FROM s)::DOUBLE,
    (SELECT count(*) FROM s WHERE level * w > 2.0 * source_size)::BIGINT FROM lv WHERE i < 60 AND level IS NOT NULL),
f AS (SELECT level FROM lv WHERE level IS NOT NULL ORDER BY i DESC LIMIT 1),
t AS (SELECT source, source_size, least(2.0 * source_size, level * w) AS target FROM s, f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR (upto - size < rest AND upto - rest <= rest - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
