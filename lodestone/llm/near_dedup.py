"""MinHash near-dedup: min-max hashing, banding, and exact confirmation of links on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import TEXT_ROWS, components, discard, forest, map_arrow, materialize, release, sent_if_small, table
from lodestone.llm.shingles import mixed, shingle_set

#: Permutations, each giving a minimum and a maximum, and rows of a band: 126 hash evaluations make 42 bands of 6.
PERMUTATIONS, ROWS = 126, 6

#: A block of a candidate cluster has about so many documents and shingles at most, however large the cluster.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 500_000
#: Documents of a large cluster that every one of its blocks also gets.
HUBS = 32

U = np.uint64

MEMBER = ["node", "cluster", "size", "blocks", "block", "hub"]
SETS = "node long, cluster long, size long, blocks long, block long, hub boolean, own array<long>"


def band_keys(shingles: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS, seed: int = 8) -> np.ndarray:
    """Keys of the bands of a set's min-max signature: both extremes of each permutation, rows values a band.

    At a similarity of s two sets share a band with probability 1 - (1 - s**rows)**(2 * permutations / rows); with
    the defaults, 0.999997 at 0.8.
    """
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, permutations, dtype=np.uint64) * U(2) + U(1)
    low, high = np.full(permutations, ~U(0)), np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), 256):
        hashes = shingles[at : at + 256, None] * factors
        np.minimum(low, hashes.min(axis=0), out=low)
        np.maximum(high, hashes.max(axis=0), out=high)
    signature = np.stack([low, high], axis=1).reshape(-1, rows)
    mixers = rng.integers(0, 2**63, rows, dtype=np.uint64) * U(2) + U(1)
    bands = np.arange(len(signature), dtype=np.uint64)
    return mixed((mixed(signature) * mixers).sum(axis=1, dtype=np.uint64) + bands * U(0x9E3779B97F4A7C15))


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose sets have at least percent % of their union in common, by exact counts.

    Intersections come from a product of the sets' incidence matrix with itself, built some shingles at a time;
    shingles that only one set has are left out.
    """
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts[columns] > 1
    rows, columns = rows[common], columns[common]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    edges = np.searchsorted(columns, np.arange(0, len(counts) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            used, at = np.unique(columns[a:b] - k * width, return_inverse=True)
            part = np.zeros((len(sets), len(used)), np.float32)
            part[rows[a:b], at] = 1
            both += part @ part.T
    both = both.astype(np.int64)
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    return np.nonzero(np.triu(near, 1))


def _sets_of(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield shingle_set((text.as_py() or "").encode().lower(), words)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and sets of each group of rows with equal keys; rows come ordered by keys, and one group is held at a time."""
    now, ids, sets = None, [], []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        for key, doc, own in zip(zip(*columns, strict=True), batch.column("node").to_pylist(), batch.column("own"), strict=True):
            if key != now:
                if len(ids) > 1:
                    yield ids, sets
                now, ids, sets = key, [], []
            ids.append(doc)
            sets.append(own.values.to_numpy().view(np.uint64))
    if len(ids) > 1:
        yield ids, sets


def near_groups(docs: DataFrame, words: int = 4, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    A document's set is its distinct runs of words, with A-Z in lower case; of all its words as one run where there
    are fewer. Documents are linked whose sets have percent % of their union in common, and component_id is the
    smallest doc_id that links reach; kept where it is the document's own. Documents without a word have no link.

    1. One scan makes sets, their 128-bit keys and min-max band keys; only keys are kept. Documents with equal sets
       are one class, which its smallest id stands for.
    2. Classes that share a band form candidate clusters: each is tied to the least of its band, and the ties'
       components are taken, so no pairs are listed.
    3. Clusters are confirmed on full sets. A cluster goes to one task if it is small; a larger one is cut into blocks,
       each with the cluster's HUBS least documents too, which already joins most.
    4. In large clusters bands are settled one by one: a band whose documents are all joined needs no more. In the others
       the documents outside the band's main component meet the band's blocks, so that every two documents that share
       a band are compared unless links already join them. Chains of bands that only meet by chance cost nothing more.
    5. Components of the confirmed links, each given as a spanning forest, are the result.

    A pair of blocks is held at a time. Sets are of hashes of 64 bits; texts made for it could collide. Rows that repeat an
    id are one document: they join its texts' components. A null id has no row to be named by: it has no links, a null component_id, and is kept. Null
    texts are empty; no rows give no rows; other columns are ignored. The result is written and all other scratch
    tables are deleted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, bands = [], [], [], []
            for own in _sets_of(batch, words):
                n.append(len(own))
                keys = mixed(own), mixed(own + U(0x632BE59BD9B4E019))
                first.append(int(keys[0].sum(dtype=np.uint64).view(np.int64)))
                second.append(int(keys[1].sum(dtype=np.uint64).view(np.int64)))
                bands.append(band_keys(own, permutations, rows).view(np.int64) if len(own) else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)])
            if n:
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(first), pa.array(second), lists], names=["doc_id", "n", "k1", "k2", "bands"])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.view(np.int64) for x in _sets_of(batch, words)]
            if sets:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in MEMBER), lists], names=[*MEMBER, "own"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _groups(batches, ["cluster", "i", "j"]):
            names = np.array(ids, np.int64)
            a, b = linked(sets, percent)
            u, v = forest((names[a], names[b])) if len(a) else (names[:0], names[:0])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    signed = materialize(map_arrow(docs, sign, "doc_id long, n long, k1 long, k2 long, bands array<long>"), TEXT_ROWS)
    named = signed.where("n > 0 and doc_id is not null")
    classes = materialize(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    first = materialize(classes.join(named.select(F.col("doc_id").alias("rep"), "k1", "k2", "n", "bands"), ["k1", "k2", "rep"]).select("rep", "n", "bands"))
    banded = first.select("rep", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    ties = banded.join(least, "band").select(F.col("rep").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    clusters = components(ties)

    members = clusters.select("node", F.col("root").alias("cluster")).union(clusters.select("root", "root").distinct())
    members = members.join(first.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node")
    size = members.groupBy("cluster").agg(F.count("*").alias("size"), F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("size") / HUBS)) == 0)
    members = members.join(size, "cluster").select("node", "cluster", "size", "blocks", block, hub.alias("hub"))
    members = materialize(members)
    sets = materialize(map_arrow(docs.join(sent_if_small(members), F.col("doc_id") == F.col("node")).select("text", *MEMBER), shingle, SETS), TEXT_ROWS)

    def confirmed(rows: DataFrame) -> DataFrame:
        rows = rows.select("cluster", "i", "j", "node", "own").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        return materialize(map_arrow(rows, confirm, "u long, v long"), TEXT_ROWS)

    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    links = confirmed(sets.select("*", F.lit(0).alias("i"), F.explode(F.when(F.col("hub"), every).otherwise(F.array("block"))).alias("j")))
    large = sets.where("blocks > 1").select("node", "own")
    scratch = [signed, classes, first, clusters, members, sets, links]
    if not large.isEmpty():
        joined = components(links)
        placed = members.where("blocks > 1").join(joined, "node", "left").select(F.col("node").alias("rep"), F.coalesce("root", "node").alias("root"))
        inside = materialize(first.join(placed, "rep").select("rep", "root", "n", F.explode("bands").alias("band")))
        roots = inside.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        bands = roots.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("size"), F.sum("n").alias("n"), F.max("c").alias("in_main"))
        blocks = lambda c: F.ceil(F.greatest(c / BLOCK_DOCS, c / F.col("size") * F.col("n") / BLOCK_SHINGLES))
        bands = materialize(bands.where("roots > 1").select(F.col("band").alias("cluster"), "main", blocks(F.col("size")).alias("blocks"), blocks(F.col("size") - F.col("in_main")).alias("parts")))
        met = inside.join(bands, F.col("band") == F.col("cluster")).select("cluster", F.col("rep").alias("node"), "root", "main", "blocks", "parts")
        block, part = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts"))
        asking = met.where("root <> main").select("cluster", "node", part.alias("i"), F.explode(every).alias("j"))
        asked = met.select("cluster", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), block.alias("j"))
        again = confirmed(asking.union(asked).distinct().join(large, "node"))
        scratch += [joined, inside, bands, again]
        links = links.union(again)
    release(docs.sparkSession)

    copies = named.join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v")
    found = components(links.union(copies))
    component = F.coalesce(F.col("root"), F.col("doc_id"))
    placed = signed.select("doc_id", F.col("n").alias("n_shingles")).join(found, F.col("doc_id") == F.col("node"), "left")
    result = materialize(placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")))
    discard(*scratch, found)
    return result


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i: array_to_string(list_slice(words, i, i + 3), ' '))) AS s FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
