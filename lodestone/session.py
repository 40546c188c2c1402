"""Spark session helpers: defaults for local use, and shipping this package's code to Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package's code, once for each Spark context, so that it needn't be installed there."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_code", False):
        return
    root = Path(__file__).resolve().parents[1]
    with zipfile.ZipFile(path := f"{tempfile.mkdtemp()}/lodestone.zip", "w") as file:
        for source in sorted((root / "lodestone").rglob("*.py")):
            file.write(source, source.relative_to(root))
    context.addPyFile(path)
    context._lodestone_code = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir, or the folder the session already has.

    Where neither is set, a local session gets a temporary folder and a cluster the warehouse, which executors share.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    local = context.master.split("[")[0] == "local"
    context.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch")
    return context.getCheckpointDir()


#: Narrow rows that one task sorts or hashes, about.
ROWS_PER_TASK = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many narrow rows, dealt by keys to tasks whose share doesn't grow with it."""
    tasks = -(-rows // ROWS_PER_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(*keys) if tasks <= usual else df.repartition(tasks, *keys)


def materialize(df: DataFrame, batch_rows: int | None = None, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """df written as a Parquet table at path (by default in the shared folder) and read again.

    This cuts the lineage, so a lost executor costs no recomputation of earlier stages, and lets Spark drop
    their shuffle files: it does so once the driver has collected the objects that refer to them. While it is written,
    batch_rows bounds the rows of an Arrow batch, for wide rows such as texts that pass through Python.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = path or f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    usual = spark.conf.get(key)
    try:
        spark.conf.set(key, str(batch_rows or usual))
        df.write.parquet(path, partitionBy=partition_by)
    finally:
        spark.conf.set(key, usual)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)
