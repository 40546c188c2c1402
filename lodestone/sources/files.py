"""Text and question files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import clean_text
from lodestone.session import ship

SUFFIXES = (".txt", ".md")

QUESTION = T.StructType([T.StructField(n, T.StringType()) for n in ("q", "type", "expect_source", "expect_section")] + [T.StructField("expect_any_source", T.ArrayType(T.StringType()))])


def read_documents(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """source_name, path, text, n_chars: each text file of a folder (not below it), cleaned, by its whole content.

    Suffixes count in any case. With ordered, which sorts all of them, rows come in the order of their paths. A file that isn't UTF-8 raises an error, as do a missing folder and one without such a file.
    """
    ship(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    lower = F.lower(name)
    chosen = raw.where(F.endswith(lower, F.lit(SUFFIXES[0])) | F.endswith(lower, F.lit(SUFFIXES[1])))
    if chosen.select("path").isEmpty():
        raise FileNotFoundError(f"no {' or '.join(SUFFIXES)} file in {folder}")
    # decode() raises on malformed input while ANSI mode is on
    docs = chosen.select(name.alias("source_name"), "path", clean_text(F.decode("content", "UTF-8")).alias("text"))
    docs = docs.withColumn("n_chars", F.length("text"))
    return docs.orderBy("path") if ordered else docs


def read_questions(spark: SparkSession, path: str, field: str = "questions") -> DataFrame:
    """pos and the fields of each question in a list of a JSON object."""
    schema = T.StructType([T.StructField(field, T.ArrayType(QUESTION))])
    rows = spark.read.schema(schema).option("multiLine", "true").json(path)
    return rows.select(F.posexplode(field).alias("pos", "_q")).select("pos", "_q.*")
