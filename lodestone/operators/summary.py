"""One-row summaries of what is stored, for a service's status pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import communities


def health(chunks: DataFrame, entities: DataFrame, edges: DataFrame, settings: dict[str, object] | None = None, edge_count: Column | None = None) -> DataFrame:
    """One row: chunks, sources, entities, edges, whether there is a graph, and the given settings as columns.

    The tables are counted in one pass each; only their counts are put side by side. edge_count is an aggregate that counts
    edges, for tables that don't list each.
    """
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("source_name").alias("sources"))
    for df, name, n in ((entities, "entities", None), (edges, "edges", edge_count)):
        counts = counts.crossJoin(df.agg((F.count("*") if n is None else n).alias(name)))
    return counts.select("*", (F.col("entities") > 0).alias("graph_built"), *(F.lit(v).alias(k) for k, v in (settings or {}).items()))


def graph_summary(entities: DataFrame) -> DataFrame:
    """One row: built, and the communities, largest first, as an array of few and short structs."""
    each = F.struct((-F.col("n")).alias("_o"), "source_name", "n", "kinds", "samples")
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda c: F.struct(c["source_name"].alias("source_name"), c["n"].alias("n"), c["kinds"].alias("kinds"), c["samples"].alias("samples")))
    return communities(entities).agg((F.count("*") > 0).alias("built"), listed.alias("communities"))
