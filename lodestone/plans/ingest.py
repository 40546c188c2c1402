"""From a folder of documents to chunks with vectors and a knowledge graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_documents, with_ids
from lodestone.operators.graph import build_graph
from lodestone.sources.files import read_documents
from lodestone.sources.services import DOCUMENTS, embed, embed_kept
from lodestone.sources.tables import check_dimension, upsert


def ingest(spark: SparkSession, folder: str, embedder: Callable[[list[str], str], list[Sequence[float]]], dims: int, old: DataFrame | None = None, kept: str | None = None, rate: float | None = None) -> DataFrame:
    """Chunks of a folder's documents with unit vectors, put into the chunks there are, if any, by source and index.

    The embedder is given texts and the task DOCUMENTS. The dimension of old vectors is checked before any text is embedded.
    With a path in kept, vectors are kept there, so that unchanged texts and the next run after a failed one cost no calls, and
    all tasks together make no more than rate calls a second.
    """
    if rate is not None and kept is None:
        raise ValueError("a rate needs a path to keep vectors at")
    if old is not None:
        check_dimension(old, dims)
    chunks = chunk_documents(read_documents(spark, folder))
    chunks = embed(chunks, embedder, task=DOCUMENTS) if kept is None else embed_kept(chunks, embedder, kept, rate=rate, task=DOCUMENTS)
    rows = chunks.select("source_name", "section", "chunk_index", "content", "embedding", F.current_timestamp().alias("created_at"))
    return rows if old is None else upsert(old.select(rows.columns), rows, ["source_name", "chunk_index"])


def graph_of(docs: DataFrame) -> dict[str, DataFrame]:
    """The knowledge graph of documents (source_name, text) over their own chunks."""
    return build_graph(docs, with_ids(chunk_documents(docs)))
