"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators.graph import Matcher
from lodestone.plans.queries import NAMES, ORACLE_SQL, QUERIES
from lodestone.session import materialize

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(float(v)) if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = rows(QUERIES[name](spark, sf_dir).toPandas()), rows(duck.sql(ORACLE_SQL[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "id", "similarity", "rank"]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_matched_entities(spark, sf_dir, duck):
    """Against a search that tries every place for every name, longest first."""
    import re

    want = {}
    for conv, turn, text in duck.sql("select conv_id, turn, text from conversations").fetchall():
        taken = []
        for name in sorted(NAMES, key=len, reverse=True):
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text, re.I):
                if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                    taken.append((m.start(), m.end(), name))
        if names := list(dict.fromkeys(n for _, _, n in sorted(taken))):
            want[conv * 1000 + turn] = ",".join(names)
    assert {r["id"]: r["names"] for r in QUERIES["match_entities"](spark, sf_dir).collect()} == want


def test_longest_match_is_not_leftmost():
    assert [s for *_, s in Matcher(["a b", "b c d"])("a b c d")] == ["b c d"]
    assert [s for *_, s in Matcher(["rồng", "rồng bạo chúa"])("Rồng Bạo Chúa và RỒNG, rồngx")] == ["rồng bạo chúa", "rồng"]
    assert Matcher(["abc"])("xabc abc_ _abc") == []


def pairs(rows):
    return {(r["qid"], r["id"]) for r in rows.collect()}


def test_approximate_search_finds_nearly_all(spark):
    from lodestone.operators import ivf
    from lodestone.plans.queries import indexed_vectors

    for sf_dir in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        exact = pairs(QUERIES["vector_topk"](spark, sf_dir))
        assert len(exact & pairs(QUERIES["vector_topk_approximate"](spark, sf_dir))) >= 0.9 * len(exact)
    assert ivf.reads(*indexed_vectors(spark, sf_dir), 6) < 0.6  # these vectors have no clusters


def clustered(spark, n=12_000, dims=32, seed=1):
    """Vectors around 40 points, a third of them at one; some equal, zero or null, and in every partition."""
    rng = np.random.default_rng(seed)
    spots = rng.normal(size=(40, dims))
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(0, 40, n))
    v = (spots[at] + rng.normal(size=(n, dims)) * 0.25).astype(np.float32)
    v[5::97] = v[5]
    rows = [(i, None if i % 1001 == 7 else [0.0] * dims if i % 1001 == 8 else x.tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def test_the_index_reads_a_part_of_clustered_vectors(spark):
    from lodestone.operators import ivf, search

    rows = materialize(clustered(spark))
    index = ivf.build(rows, ivf.fit(rows))
    asked = rows.where("id % 50 = 0").withColumnRenamed("id", "qid")
    exact = search.top_k(asked, rows, 6)
    key = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["similarity"], 9)) for r in df.collect())
    assert key(ivf.search(asked, index, 6, sure=None)) == key(exact)
    assert ivf.reads(asked, index, 6, sure=None) < 0.25
    assert len(pairs(exact) & pairs(ivf.search(asked, index, 6))) >= 0.9 * exact.count()
    assert max(index.blocks.select(F.size("ids")).collect())[0] < 2 * ivf.BLOCK and int(index.sizes.sum()) == sum(r[0] for r in index.blocks.select(F.size("ids")).collect())


def test_the_index_of_few_or_no_vectors(spark):
    from lodestone.operators import ivf, search

    rows = clustered(spark, 30)
    index = ivf.build(rows, ivf.fit(rows, cells=7))
    asked = rows.withColumnRenamed("id", "qid")
    for k in (1, 40):  # more than there are
        assert pairs(ivf.search(asked, index, k, sure=None, first=2)) == pairs(search.top_k(asked, rows, k))
    none = rows.limit(0)
    assert ivf.search(asked, ivf.build(none, ivf.fit(none))).count() == 0 == ivf.search(asked.limit(0), index).count()


def test_bounds_hold():
    """No vector of a cell scores more than the certain bound."""
    from lodestone.operators import ivf

    rng = np.random.default_rng(3)
    for dims in (2, 3, 16):
        unit = lambda n: (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(rng.normal(size=(n, dims)))
        centers, v, q = unit(5), unit(400), unit(50)
        cell = (v @ centers.T).argmax(axis=1)
        angle = np.arccos(np.clip((v * centers[cell]).sum(axis=1), -1, 1))
        sizes = np.bincount(cell, minlength=5)
        low, high = (np.array([f(angle[cell == c], initial=i) for c in range(5)]) for f, i in ((np.min, np.pi), (np.max, 0)))
        top = np.array([[(v[cell == c] @ x).max(initial=-np.inf) for c in range(5)] for x in q])
        assert (ivf.bounds(ivf.Index(None, centers, sizes, low, high), q @ centers.T, None) >= top - 1e-9).all()


def test_selection_keeps_ties_by_id():
    from lodestone.operators.search import best_of

    rng = np.random.default_rng(4)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, (rng.integers(1, 5), rng.integers(1, 30))) / 3, rng.permutation(1000)
        ids = ids[: scores.shape[1]]
        k = int(rng.integers(1, 9))
        row, column = best_of(scores, ids, k)
        want = [(r, i) for r in range(len(scores)) for i in sorted(range(len(ids)), key=lambda c: (-scores[r, c], ids[c]))[:k]]
        assert list(zip(row.tolist(), column.tolist())) == want


def test_a_common_vector_does_not_fill_the_sample(spark):
    from lodestone.operators import ivf

    common = [[1.0, 0.0]] * 5000
    rows = spark.createDataFrame([(v,) for v in common + [[0.01 * k, 1.0] for k in range(1, 41)]], "embedding array<double>")
    for sample in (20, 100):  # with a share of the hashes, and with all
        centers = ivf.fit(rows, cells=20, sample=sample)
        assert len(centers) == 20 and sum(abs(c[1]) < 1e-9 for c in centers) <= 1


def test_few_pairs_of_blocks_make_a_batch(spark, monkeypatch):
    """Rows of the cross join are large; blocks stay full although vectors come in as small batches."""
    import pyarrow as pa

    from lodestone.operators import search

    asked = []
    monkeypatch.setattr(search, "materialize", lambda df, rows=None: asked.append(rows) or materialize(df, rows))
    v = spark.range(300).select("id", F.array(F.col("id") + 1.0, F.lit(20.0)).cast("array<float>").alias("embedding"))
    found = search.top_k(v.where("id < 3").withColumnRenamed("id", "qid"), v, 2)
    assert asked == [search.PAIR_ROWS] and {(r["qid"], r["id"]) for r in found.where("rank = 1").collect()} == {(0, 0), (1, 1), (2, 2)}
    small = pa.RecordBatch.from_pydict({"x": [1, 2, 3]})
    assert [b["x"].to_pylist() for b in search.resized(iter([small, small, small]), 4)] == [[1, 2, 3, 1], [2, 3, 1, 2], [3]]
