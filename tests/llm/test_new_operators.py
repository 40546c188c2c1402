"""Centroid clustering, the byte-level BPE codec and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import importance
from lodestone.llm.bpe import RANKS, Codec, decode_ids, encode_texts, op12_byte_bpe
from lodestone.llm.centroids import OP11_SQL, RANGE, cluster_vectors, nearest, op11_centroid_clusters
from lodestone.llm.importance import OP13_SQL, bucket_counts, op13_importance_resampling, ranked, resample

from .conftest import prose
from .test_dedup import same_as_sql

# ---------------------------------------------------------------------------------------------------- centroids


def plain_clusters(rows, k, rounds, dims, scale, seed):
    """By Python's integers, vector by vector."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, v) for i, v in kept if all(abs(x) <= RANGE for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centers = [v for _, v in first]
    assign = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centers))
    for _ in range(rounds):
        groups = [[v for _, v in kept if assign(v)[1] == c] for c in range(len(centers))]
        centers = [[sum(x) // len(g) for x in zip(*g)] if g else m for g, m in zip(groups, centers)]
    found = [(i, *assign(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, d, long(inertia[c]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for i, d, c in found), key=str)


def clusters(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, _vec string, cluster string").repartition(3)
    how = {"k": 3, "rounds": 10, "dims": 4, "scale": 1024, "seed": "3"} | how
    return sorted(map(tuple, cluster_vectors(df, **how)[0].collect()), key=str), how


def test_clusters_equal_sql(spark, sf_dir):
    same_as_sql(op11_centroid_clusters(spark, sf_dir), OP11_SQL, sf_dir, ["embeddings"])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_equal_a_plain_version(spark, kind):
    rng = random.Random(4)
    spots = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.choice([0, 0, 0.001, 0.3]))) for x in rng.choice(spots)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0, 2.0, None, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("-inf"), 0.0, 0.0, 0.0]), (205, [0.0] * 3), (206, [0.0] * 5)]
    rows += [(None, [0.5, -0.5, 0.25, 0.0]), (7, rows[7][1]), (7, [0.0] * 4), (207, [1e30, 0.0, 0.0, 0.0]), (208, [-0.0001] * 4)]
    for how in ({}, {"k": 8}, {"k": 1, "rounds": 2}, {"k": 5, "rounds": 0}):
        got, all_of_how = clusters(spark, rows, kind, **how)
        assert got == plain_clusters(rows, **all_of_how) and len(got) == 154


def test_clusters_of_large_components_and_ties(spark):
    far = [(i, [float(s * RANGE), float(t * RANGE), float(i % 3), 0.0]) for i, (s, t) in enumerate([(1, 1), (-1, 1), (1, -1), (-1, -1)] * 4)]
    got, how = clusters(spark, far, scale=1)
    assert got == plain_clusters(far, **how)
    tie = [(i, [float(x), 0.0, 0.0, 0.0]) for i, x in enumerate([0, 2, 1, 1, 1])]
    got, how = clusters(spark, tie, scale=1, k=2, rounds=1)
    assert got == plain_clusters(tie, **how)
    assert nearest(np.array([[1, 0]]), np.array([[0, 0], [2, 0]]))[0][0] == 0
    assert nearest(np.array([[RANGE, RANGE]]), np.array([[-RANGE, -RANGE]]))[1][0] == 2 * (2 * RANGE) ** 2


def test_clusters_of_few_or_no_vectors(spark):
    assert clusters(spark, [])[0] == [] == clusters(spark, [(1, None), (2, [1.0])])[0]
    one, how = clusters(spark, [(1, [1.0, 2.0, 3.0, 4.0])] * 3)
    assert one == plain_clusters([(1, [1.0, 2.0, 3.0, 4.0])] * 3, **how) and len(one) == 3


def test_a_common_vector_is_multiplied_once(spark):
    rng = random.Random(5)
    rows = [(i, [0.5, 0.5, 0.5, 0.5] if i % 3 else [rng.random() for _ in range(4)]) for i in range(3000)]
    got, how = clusters(spark, rows, rounds=2)
    assert got == plain_clusters(rows, **how)


# --------------------------------------------------------------------------------------------------------- codec


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def library(path):
    return Codec(path).bpe


ALPHABETS = ["ab ", "a", "aA1 .'s", "'stre ll", "\n\t  a", "日本語、。 a", "é́ x́a1", "!!..a1", "0123456789", "abcdefghij", "a'", " ", " \n", "　\xa0\x85\x1c a", "🎉👍a ", "<|endoftext|>", "\x00\x7f﻿a "]


def test_joined_parts_are_the_librarys_encoding(path, library):
    """Tiny leaves put borders at every place, and matches of any length are joined by tokens."""
    rng = random.Random(6)
    codecs = [Codec(path, leaf=leaf, long=long) for leaf in (1, 2, 5, 16) for long in (0, 1, 4, 20, 512)]
    for _ in range(4000):
        text = "".join("".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(0, 60))) + rng.choice(["", "'", "'r", " ", "  "]) for _ in range(rng.randrange(1, 4)))
        want = library.encode_ordinary(text)
        codec = rng.choice(codecs)
        assert codec.encode(text) == want, text
        assert codec.decode(want) == text.encode()


def test_any_ranks_merge_alike(path, tmp_path):
    """Invented ranks in any order, some of which no merge reaches."""
    import base64

    rng = random.Random(7)
    for trial in range(30):
        pieces = [bytes([b]) for b in range(256)]
        more = {bytes(rng.choices(b"abc", k=rng.randrange(2, 6))) for _ in range(40)}
        pieces += rng.sample(sorted(more), len(more))
        file = tmp_path / f"{trial}.tiktoken"
        file.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % r for r, p in enumerate(pieces)))
        codec = Codec(str(file), leaf=rng.choice([1, 3, 8]), long=0)
        for _ in range(100):
            text = "".join(rng.choices("abc", k=rng.randrange(0, 70)))
            assert codec.encode(text) == codec.bpe.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "ab" * 200_000, " " * 300_000 + "x", "\n" * 200_000, "?!" * 100_000, "日本語" * 60_000, "word " * 60_000])
def test_very_long_texts_take_time_in_proportion(path, text):
    import time

    codec = Codec(path)
    began = time.perf_counter()
    ids = codec.encode(text)
    assert time.perf_counter() - began < 20
    assert ids == [i for piece in codec.matches(text) for i in codec.bpe._encode_single_piece(piece)] and codec.decode(ids) == text.encode()


def test_joins_encode_little(path):
    codec = Codec(path)
    codec.encode(prose(random.Random(8), 60_000))
    assert 0 < codec.reencoded < 10_000


def test_codec_query(spark, sf_dir, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op12_byte_bpe(spark, sf_dir).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(rows[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_codec_odd_rows(frame, odd_rows, library):
    docs = frame(odd_rows)
    encoded = encode_texts(docs)
    got = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str)
    assert got == sorted(((d, library.encode_ordinary(t or "")) for d, t, *_ in odd_rows), key=str)
    back = decode_ids(encoded.select("ids", F.col("doc_id").alias("bytes_of")))
    assert sorted(((r["bytes_of"], bytes(r["bytes"]).decode()) for r in back.collect()), key=str) == sorted(((d, t or "") for d, t, *_ in odd_rows), key=str)
    assert encode_texts(frame([])).count() == 0 == decode_ids(encode_texts(frame([]))).count()
    nulls = encoded.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {bytes(r["bytes"]) for r in decode_ids(nulls).collect()} == {b""}


# ---------------------------------------------------------------------------------------------------- importance

FEATURE = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = FEATURE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, percent=5, least=20):
    """Rows (id, features, weight, score, rank); docs may repeat an id."""
    found = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([n, d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in rows if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0))
    for i, r in enumerate(order[: percent * len(order) // 100]):
        r[5] = i + 1
    return sorted((tuple(r[1:]) for r in rows), key=str)


def resampled(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    assert resampled(op13_importance_resampling(spark, sf_dir)) == sorted(con.sql(OP13_SQL).fetchall(), key=str)


def test_resampling_equals_a_plain_version(spark, frame, odd_rows):
    docs = frame(odd_rows)
    target = [odd_rows[8][1], "", None, "MIXED Case, l'été"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    for percent in (5, 50, 100):
        got = resampled(resample(docs, bench, percent=percent))
        assert got == plain_resample([(d, t) for d, t, *_ in odd_rows], target, percent)
    assert any(r[4] for r in got)


def test_resampling_of_nothing(frame):
    some = frame([(1, prose(random.Random(1), 30), "en", "a")])
    assert resample(frame([]), some).count() == 0
    assert resampled(resample(some, frame([]), percent=100)) == plain_resample([(r["doc_id"], r["text"]) for r in some.collect()], [], 100)


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_automaton_on_odd_bytes(monkeypatch, block):
    """Blocks of any size, words next to each other in two texts, very long words, bytes of every kind."""
    import pyarrow as pa

    monkeypatch.setattr(importance, "STARTS", block)
    monkeypatch.setattr(importance, "BYTES", 50)
    rng = random.Random(9)
    texts = ["ab", "cd", "", None, "A", "a b", " a", "a ", "\x00a\x7f/:@[`{z0 9", "é日本 Éx", "x" * 5000 + " y", *(prose(rng, 40, "aB1 é.") for _ in range(30))]
    want = Counter()
    for k, t in enumerate(texts):
        want.update((k, b) for b in features(t)[1])
    got = Counter()
    for column in (pa.array(texts), pa.concat_arrays([pa.array(["zz"]), pa.array(texts)]).slice(1)):
        got.clear()
        for at, _, data, offsets in importance._buffers(column):
            for text, bucket in importance.feature_buckets(data, offsets, 3, 10000):
                got.update(zip((text + at).tolist(), bucket.tolist()))
        assert got == want


def test_a_long_word_is_finished_by_itself():
    import time

    began = time.perf_counter()
    data = np.frombuffer(b"q" * 3_000_000, dtype=np.uint8)
    ((text, bucket),) = [x for x in importance.feature_buckets(data, np.array([0, len(data)]), 3, 10000) if len(x[0])]
    assert bucket[0] == zlib.crc32(data) % 10000 and time.perf_counter() - began < 2


def test_counts_travel_as_a_row_a_bucket(frame, odd_rows):
    counts = {r["bucket"]: r["n"] for r in bucket_counts(frame(odd_rows)).collect()}
    assert counts == Counter(b for _, t, *_ in odd_rows for b in features(t)[1])


def test_ranks_over_all_partitions(spark):
    rng = random.Random(10)
    rows = spark.createDataFrame([(i, rng.randrange(20)) for i in range(5000)], "k long, v int").repartition(7)
    got = {r["k"]: r["_rank"] for r in ranked(rows, F.col("v").desc(), F.col("k")).collect()}
    assert got == {r["k"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r["v"], r["k"])))}
