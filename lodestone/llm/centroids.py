"""Centroid clustering of quantised vectors: Lloyd's algorithm on distinct vectors with multiplicities, all in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import map_arrow, materialize, table

#: Quantised components lie within this of 0: any two vectors' squared distance then fits a long.
RANGE = 1 << 27
#: Below this, products and squared distances of 64 components are whole numbers that doubles hold exactly.
EXACT = 1 << 22
#: Vectors that are multiplied with the centroids at a time.
BLOCK = 4096


def _quantised(dims: int, scale: int):
    """Arrow batches of (id, list of floats) to those of (_id, _vec), kept vectors only, a vector as its packed 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = lists.is_valid().to_numpy(zero_copy_only=False)
            fits &= lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims
            rows = pa.array(np.flatnonzero(fits))
            x = lists.take(rows).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * x)
                near = (np.isfinite(x) & (np.abs(whole) <= RANGE)).all(1)
            packed = np.ascontiguousarray(whole[near], dtype="<i4")
            at = np.arange(len(packed) + 1, dtype=np.int32) * (4 * dims)
            vectors = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(at), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows.filter(pa.array(near))), vectors], ["_id", "_vec"])

    return run


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(len(column), dims)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid (of equally near ones the smallest) and the squared distance."""
    small = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) * np.sqrt(vectors.shape[1] / 64) < EXACT
    v, c = (a.astype(np.float64 if small else np.int64) for a in (vectors, centroids))
    d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]
    best = d.argmin(1)
    return best, d[np.arange(len(d)), best].astype(np.int64)


def _summed(centroids: np.ndarray):
    """Arrow batches of (_vec, _n) to a task's sums: for each cluster its number of vectors and component totals."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, totals = [0] * k, np.zeros((k, dims), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                v, w = _vectors(some.column(0), dims).astype(np.int64), some.column(1).to_numpy()
                best, _ = nearest(v, centroids)
                if int(w.sum(dtype=object)) * int(np.abs(v).max(initial=0)) >= 1 << 62:
                    v, w = v.astype(object), w.astype(object)
                for c in np.unique(best):
                    mine = best == c
                    n[c] += int(w[mine].sum())
                    totals[c] += (v[mine] * w[mine, None]).sum(0)
        full = [c for c in range(k) if n[c]]
        columns = [pa.array([c for c in full for _ in range(dims)], pa.int32()), pa.array(list(range(dims)) * len(full), pa.int32()), pa.array([n[c] for c in full for _ in range(dims)], pa.int64()), pa.array([Decimal(int(x)) for c in full for x in totals[c]], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "dim", "n", "total"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column(0), centroids.shape[1])
            blocks = [nearest(v[at : at + BLOCK], centroids) for at in range(0, len(v), BLOCK)]
            best, distance = (np.concatenate([np.empty(0, np.int64), *(b[i] for b in blocks)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], ["_vec", "_n", "cluster", "distance"])

    return run


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; only k * dims sums reach the driver."""
    sums = map_arrow(distinct, _summed(centroids), "cluster int, dim int, n long, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for cluster, dim, n, total in sums.collect():
        out[cluster, dim] = int(total) // n
    return out


def cluster_vectors(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Clusters of rows' vectors, and the k final centroids (integers, fewer if fewer vectors are kept).

    The table has id_col, cluster, distance, cluster_inertia, inertia and centroid_sha256 for every kept vector.
    Kept are vectors of exactly dims components, none null or not finite; each x becomes floor(scale * x). A vector
    with a component beyond RANGE after that isn't kept either, since squared distances of such do not fit a long.

    Equal quantised vectors are grouped first, counted before they are shuffled, and written once with their
    multiplicity. The first centroids are the k kept vectors with the smallest SHA-256 of "seed:id" (a null id is
    written as nothing; rows that share an id are ordered by vector). A round reads distinct vectors, assigns each to
    its nearest centroid by squared distance (ties: the smaller number), and sums components times multiplicity in
    each task; Spark adds tasks' sums up, and the driver divides k * dims of them with floors. An empty cluster keeps
    its centroid. Rounds end early when no centroid moves: all later ones would change nothing.

    Assignments are joined back to ids by the SHA-256 of the quantised vector, so rows travel with 32 bytes each, and
    Spark splits the join's partition of a very common vector. All arithmetic is exact, whatever the order of rows.
    An inertia that doesn't fit a long is null. No kept vectors give no rows; other columns are ignored.
    """
    spark = rows.sparkSession
    ids = dict(rows.dtypes)[id_col]
    kept = map_arrow(rows.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_vec")), _quantised(dims, scale), StructType.fromDDL(f"_id {ids}, _vec binary"))
    distinct = materialize(kept.groupBy("_vec").agg(F.count("*").alias("_n")))

    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = kept.select(order.alias("_h"), "_vec").orderBy("_h", "_vec").limit(k).collect()
    centroids = np.array([np.frombuffer(r["_vec"], "<i4") for r in first], dtype=np.int64).reshape(len(first), dims)
    for _ in range(rounds if len(first) else 0):
        moved = _moved(distinct, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved

    digest = F.unhex(F.sha2("_vec", 256))
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], f"{id_col} {ids}, cluster int, distance long, {names.partition(', ')[2]}"), centroids
    assigned = materialize(map_arrow(distinct, _assigned(centroids), "_vec binary, _n long, cluster int, distance long").select(digest.alias("_key"), "_n", "cluster", "distance"))
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("_n").cast("decimal(20,0)") * F.col("distance")).alias("s")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    clusters = [(c, long(inertia.get(c, 0)), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, m.tolist())).encode()).hexdigest()) for c, m in enumerate(centroids)]
    known = assigned.drop("_n").join(F.broadcast(spark.createDataFrame(clusters, names)), "cluster")
    found = kept.select(F.col("_id").alias(id_col), digest.alias("_key")).join(known, "_key")
    return found.select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def _sql(rounds: int = 10) -> str:
    """Each round's assignments and centroids follow from the last one's."""
    steps = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS c, q AS m FROM (SELECT * FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8))",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, q, arg_min({{'c': c, 'd': d}}, (d, c)) AS b FROM (SELECT vec_id, q, c, list_sum(list_transform(list_zip(q, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i}) GROUP BY vec_id, q)")
        if i < rounds:
            sums = f"SELECT b.c AS c, dim, sum(x) AS s, count(*) AS n FROM (SELECT b, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM a{i}) GROUP BY 1, 2"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list((s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY dim) AS m FROM ({sums}) GROUP BY c) n ON c{i}.c = n.c)")
    last = f"SELECT vec_id, b.c AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.c)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON b.c = c{rounds}.c"
    return "WITH " + ",\n".join(steps) + "\n" + last


OP11_SQL = _sql()
