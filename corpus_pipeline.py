"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_ROWS, materialize, sent_if_small, table
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.language_id import held_out, identify, learn
from lodestone.llm.mixing import mix_sources
from lodestone.llm.near_dedup import near_groups
from lodestone.llm.packing import pack


def _keep(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id has a kept row in decided. Rows that repeat a doc_id stay or go together.

    Far fewer documents go than stay, so the ids that go are written and taken out: they are sent to all tasks while they
    are few, and docs aren't shuffled; else both are, by id.
    """
    gone = materialize(decided.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept")).select("doc_id"))
    return docs.join(sent_if_small(gone), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay; those without a letter or with a narrow margin go."""
    found = materialize(identify(docs, learn(docs.where(~held_out(F.col("doc_id"))))), TEXT_ROWS)
    return _keep(docs, found.select("doc_id", (~F.col("rejected")).alias("kept")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the longest stays, then the one with the smallest doc_id."""
    return _keep(docs, exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on five-word shingles join, the one with the smallest doc_id stays."""
    return _keep(docs, near_groups(docs, words=5, percent=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none, one or two rows."""
    copies = mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies["doc_id"]))
    return taken.select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), copies["copies"])).alias("nth of its copies")).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces, packed into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pieces)]

#: SQL can't express stages that compress, hash by MinHash or tokenise; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows, packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
