"""Tables: readers with checks, and sinks that insert, update and replace."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import materialize

CHUNKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("source_name", T.StringType(), False),
        T.StructField("section", T.StringType(), False),
        T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)
ENTITIES = T.StructType([T.StructField("id", T.LongType(), False)] + [T.StructField(n, T.StringType(), False) for n in ("key", "name", "kind", "definition", "source_name", "section")])
ALIASES = T.StructType([T.StructField("entity_id", T.LongType(), False), T.StructField("alias", T.StringType(), False)])
MENTIONS = T.StructType([T.StructField("entity_id", T.LongType(), False), T.StructField("chunk_id", T.LongType(), False)])
EDGES = T.StructType([T.StructField("src_id", T.LongType(), False), T.StructField("dst_id", T.LongType(), False), T.StructField("relation", T.StringType(), False), T.StructField("weight", T.FloatType(), False)])


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, non_empty: bool = False) -> DataFrame:
    """A Parquet table of a folder, its columns pruned in the scan; an error if it must have rows and has none."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df if columns is None else df.select(*columns)
    if non_empty and df.isEmpty():
        raise ValueError(f"table {name} is empty: fill it first")
    return df


def is_built(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a table is there and has rows; False for any reason that it can't be read."""
    try:
        return not table(spark, folder, name).isEmpty()
    except Exception:
        return False


def check_dimension(df: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """df, after its vectors' dimension was checked; an error names what was found."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low is not None and (low, high) != (dims, dims):
        raise ValueError(f"{vector} has {low} to {high} dimensions, not {dims}")
    return df


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """old with the rows of new in the place of those with their keys; rows of old with other keys stay.

    Of rows of new that repeat keys the last by order wins. So chunks of a document that has become shorter stay until they
    are removed by replace_sources().
    """
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_last", F.row_number().over(last)).where("_last = 1").drop("_last")
    return old.join(new, [*keys], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_sources(old: DataFrame, new: DataFrame, source: str = "source_name") -> DataFrame:
    """old without any row of new's sources, and new."""
    return old.join(new.select(source).distinct(), source, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old and those rows of new, one for each keys, whose keys it hasn't."""
    return old.unionByName(new.dropDuplicates([*keys]).join(old, [*keys], "left_anti").select(*old.columns))


#: Folders that a keyed table is dealt to, and the start of the column that says so.
BUCKETS, DEALT = 64, "bucket_of_"


def _dealt(df: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(f"{DEALT}{buckets}", F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))


def create_keyed(df: DataFrame, path: str, by: Sequence[str], buckets: int = BUCKETS) -> None:
    """Writes df as a table dealt to folders by a hash of the columns by, so that a change touches only some of them."""
    dealt = _dealt(df, by, buckets)
    dealt.repartition(dealt.columns[-1]).write.mode("overwrite").partitionBy(dealt.columns[-1]).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*(c for c in df.columns if not c.startswith(DEALT)))


def change_keyed(new: DataFrame, path: str, by: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Puts merge(old, new) in the place of the folders of a keyed table that new's rows fall in, and says which these are.

    merge is upsert(), insert_new() or replace_sources() with its keys, which contain the columns by. Only touched folders are read, and
    only they are written: the merged rows are made in the shared folder first, then staged beside the table and moved
    in when all of them are there. Files of other folders stay as they are. A failure before that leaves the table as it was. One writer
    at a time. No rows change nothing.
    """
    spark = new.sparkSession
    old = spark.read.parquet(path)
    column = next(c for c in old.columns if c.startswith(DEALT))
    new = materialize(_dealt(new, by, int(column.removeprefix(DEALT))))
    touched = sorted(r[0] for r in new.select(column).distinct().collect())  # a number a folder
    if touched:
        merged = materialize(merge(old.where(F.col(column).isin(touched)), new.select(old.columns)))
        merged.repartition(column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return touched


def write(df: DataFrame, folder: str, name: str) -> None:
    """Drops and writes a Parquet table."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_results(rows: DataFrame, path: str, settings: dict[str, object] | None = None) -> None:
    """Rows as JSON lines, and the settings that they were made with as one line under path.config; text isn't escaped."""
    rows.write.mode("overwrite").json(path)
    if settings:
        rows.sparkSession.range(1).coalesce(1).select(*(F.lit(v).alias(k) for k, v in settings.items())).write.mode("overwrite").json(f"{path}.config")


def read_results(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of write_results(), each with the settings that they were made with as one struct, settings; null without any."""
    rows = spark.read.schema(schema).json(path)
    try:
        made = spark.read.json(f"{path}.config")
    except AnalysisException:
        return rows.withColumn("settings", F.lit(None))
    return rows.crossJoin(F.broadcast(made.select(F.struct(*made.columns).alias("settings"))))  # one row


def paired(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """chunks with their vectors by key; an error if either has a key that the other hasn't."""
    both = chunks.join(vectors, key, "full_outer").where(F.col("content").isNull() | F.col("embedding").isNull())
    if not both.isEmpty():
        raise ValueError("chunks and vectors don't match")
    return chunks.join(vectors, key)
