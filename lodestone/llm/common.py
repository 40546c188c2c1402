"""Helpers shared by the corpus operators: white space, scratch tables, table reading, connected components."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.session import checkpoint_dir, materialize, ship

__all__ = ["checkpoint_dir", "components", "discard", "map_arrow", "materialize", "n_words", "release", "sent_if_small", "ship", "squeeze", "table"]

#: White space and words of all contracts, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch where texts or sets of hashes pass through Python.
TEXT_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeeze(text: Column) -> Column:
    """text (null: empty) without any white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def n_words(text: Column) -> Column:
    """Number of words in text (null: 0), as long."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


#: Narrow rows that may be sent to all tasks.
SENT_ROWS = 300_000


def sent_if_small(rows: DataFrame) -> DataFrame:
    """Written narrow rows, marked to be sent to all tasks if there are SENT_ROWS at most; else Spark shuffles both sides of their join."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by materialize() that no later step reads, and lets Spark drop finished shuffles."""
    for df in tables:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        for parent in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(hadoop).delete(path, True)
    release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Spark's cleaner removes shuffle files of plans that are garbage on the driver; this collects that garbage."""
    gc.collect()
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def forest(pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that is not a root, of the graph with these links; a root is its tree's least node."""
    nodes, index = np.unique(np.concatenate(pairs), return_inverse=True)
    parent = np.arange(len(nodes))
    a, b = index[: len(pairs[0])], index[len(pairs[0]) :]
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A spanning forest of one partition's links, as links to roots; memory is bounded by the partition's size."""
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u, v = forest((np.concatenate([u, batch["u"].to_numpy()]), np.concatenate([v, batch["v"].to_numpy()])))
    yield pd.DataFrame({"u": u, "v": v})


#: Links that one task contracts, about; fewer make a graph that a single task settles.
LINKS_PER_TASK = 500_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v long): a row (node, root) for each node but the root, its component's least node.

    Links are dealt to as many tasks as their number asks for, LINKS_PER_TASK each, and each shrinks its own to a spanning
    forest. If that took one task, all is done. Else large-star and small-star steps alternate with this until nothing
    changes. Every step is an aggregation and an equi-join, whose skewed keys Spark can split; links stay on the
    executors, a task's memory is bounded, and each round is written to the shared folder. Null nodes, loops and repeated
    links are ignored; no links give no rows.
    """
    ship(links.sparkSession)

    def contracted(rows: DataFrame) -> tuple[DataFrame, int]:
        given = materialize(rows)
        tasks = max(1, -(-given.count() // LINKS_PER_TASK))
        out = materialize(given.coalesce(tasks).mapInPandas(_contract, "u long, v long"))
        discard(given)
        return out, tasks

    state, tasks = contracted(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"))
    mark = None
    for _ in range(rounds if tasks > 1 else 0):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == mark:
            break
        mark = (now["n"], now["h"])
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        old = state
        state, tasks = contracted(small)
        discard(old)
        if tasks == 1:
            break
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
