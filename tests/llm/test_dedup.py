from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import common, near_dedup, substring_dedup
from lodestone.llm import exact_dedup as exact
from lodestone.llm.exact_dedup import OP6_SQL, exact_dedup, op6_exact_dedup
from lodestone.llm.near_dedup import OP1_SQL, near_groups, op1_near_dedup
from lodestone.llm.substring_dedup import COVER, OP5_SQL, PERIOD, is_cover, op5_substring_dedup, repeated_words

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same_as_sql(got, sql, sf_dir, tables=("documents",)):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(sql).df()
    assert sorted(map(str, got.toPandas()[list(want.columns)].itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


# ------------------------------------------------------------------------------------------------------------ exact


def test_exact_dedup_matches_sql(spark, sf_dir):
    same_as_sql(op6_exact_dedup(spark, sf_dir), OP6_SQL, sf_dir)


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, d))
    out = []
    for d, t, *_ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[3]
        out.append((d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(str, out))


def test_exact_dedup_of_odd_rows(frame, odd_rows):
    got = exact_dedup(frame(odd_rows), digest_all=True).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_exact(odd_rows)
    lazy = exact_dedup(frame(odd_rows)).collect()
    assert sorted(str(tuple(r)[:4]) for r in lazy) == sorted(str(tuple(r)[:4]) for r in got)
    assert {r["text_sha256"] for r in lazy if r["group_size"] == 1} <= {None} | {r["text_sha256"] for r in got}
    assert exact_dedup(frame([])).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 5])
def test_marks_that_keys_share_by_chance_change_nothing(frame, odd_rows, monkeypatch, buckets):
    monkeypatch.setattr(exact, "BUCKETS", buckets)
    assert sorted(str(tuple(r)) for r in exact_dedup(frame(odd_rows), digest_all=True).collect()) == brute_exact(odd_rows)


def test_prefix_and_length_do_not_decide(frame):
    rows = [(1, "a" * 100 + "b", "en", "s"), (2, "a" * 100 + "c", "en", "s"), (3, "a" * 100 + "c", "en", "s")]
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup(frame(rows)).collect()} == {1: 1, 2: 2, 3: 2}


# ------------------------------------------------------------------------------------------------------------ near


def brute_near(rows, words=4, percent=80):
    sets = defaultdict(list)
    for d, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d].append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    seen = defaultdict(int)
    out = []
    for d, *_ in rows:
        own = sets[d][seen[d]]
        seen[d] += 1
        root = None if d is None else find(d)
        out.append((d, len(own), root, d is None or root == d))
    return sorted(map(str, out))


def test_near_dedup_matches_sql(spark, sf_dir):
    same_as_sql(op1_near_dedup(spark, sf_dir), OP1_SQL, sf_dir)


def test_near_dedup_of_odd_rows(frame, odd_rows):
    got = near_groups(frame(odd_rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_near(odd_rows)
    assert near_groups(frame([])).count() == 0


def test_near_dedup_when_members_are_too_many_to_send(frame, odd_rows, monkeypatch):
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    assert sorted(str(tuple(r)) for r in near_groups(frame(odd_rows)).collect()) == brute_near(odd_rows)


@pytest.mark.parametrize("block,hubs", [(1024, 64), (4, 2), (7, 1)])
def test_near_dedup_of_one_large_family(frame, monkeypatch, block, hubs):
    """Copies of one text, with edits of any number: chains of links around 0.8, also across blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(near_dedup, "HUBS", hubs)
    rng = random.Random(block)
    base = prose(rng, 60).split()
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((d, " ".join(w), "en", "s"))
    got = near_groups(frame(rows, 5)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_near(rows)


@pytest.mark.parametrize("words,pairs", [(40, 60), (200, 60), (1500, 30)])
def test_links_just_above_the_limit_are_found(frame, words, pairs):
    """Pairs of 0.80 to 0.85 and of 0.75 to 0.80, of short to long texts: every one of the first is linked, none of the second."""
    rng = random.Random(words)
    shingles = lambda w: {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    rows, near = [], {}
    for _ in range(200 * pairs):
        w = [f"{rng.randrange(10**9):x}" for _ in range(words)]
        v = list(w)
        for _ in range(rng.randrange(1, max(4, words // 15))):
            v[rng.randrange(words)] = f"{rng.randrange(10**9):x}"
        likeness = len(shingles(w) & shingles(v)) / len(shingles(w) | shingles(v))
        if 0.75 <= likeness <= 0.85 and sum((x >= 0.8) == (likeness >= 0.8) for x in near.values()) < pairs:
            near[len(rows)] = likeness
            rows += [(len(rows), " ".join(w), "en", "s"), (len(rows) + 1, " ".join(v), "en", "s")]
        if len(near) == 2 * pairs:
            break
    assert min(sum(x >= 0.8 for x in near.values()), sum(x < 0.8 for x in near.values())) >= 10
    got = {r["doc_id"]: r["component_id"] for r in near_groups(frame(rows, 5)).collect()}
    assert {d: got[d + 1] == d for d in near} == {d: x >= 0.8 for d, x in near.items()}


def test_a_chain_of_chance_bands_stays_exact(frame, monkeypatch):
    """Texts that share boilerplate meet in many bands without a link; large clusters are settled band by band."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(near_dedup, "HUBS", 2)
    rng = random.Random(12)
    shared = prose(rng, 90).split()
    rows = []
    for d in range(60):
        own = prose(rng, 50 + d % 3)
        rows.append((d, f"{' '.join(shared)} {own}" if d % 4 else f"{' '.join(shared[: 70 + d // 4])} {rows[d - 1][1] if d else own}", "en", "s"))
    assert sorted(str(tuple(r)) for r in near_groups(frame(rows, 5)).collect()) == brute_near(rows)


def test_scratch_tables_are_deleted(spark, frame, odd_rows):
    import os

    from lodestone.llm.common import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    near_groups(frame(odd_rows)).count()
    assert len(set(os.listdir(folder)) - before) <= 3


def test_band_keys_are_of_extremes():
    import numpy as np

    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 600, dtype=np.uint64))
    keys = near_dedup.band_keys(a)
    assert len(keys) == 2 * near_dedup.PERMUTATIONS // near_dedup.ROWS == len(set(keys.tolist()))
    assert (keys == near_dedup.band_keys(a[::-1])).all()
    assert 0 < (keys == near_dedup.band_keys(a[60:])).sum() < len(keys)


# ------------------------------------------------------------------------------------------------------- substring


def brute_substring(rows, window=50):
    texts = [(d, WORD.findall(t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), kept))
    return sorted(map(str, out))


def test_substring_dedup_matches_sql(spark, sf_dir):
    same_as_sql(op5_substring_dedup(spark, sf_dir), OP5_SQL, sf_dir)


def test_substring_dedup_of_odd_rows(frame, odd_rows):
    got = repeated_words(frame(odd_rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_substring(odd_rows)
    assert repeated_words(frame([])).count() == 0


def test_substring_dedup_at_every_offset(frame):
    """Passages of 49 to 52 words, placed at any position of both documents."""
    rng = random.Random(5)
    rows = [(0, prose(rng, 200), "en", "s")]
    first = rows[0][1].split()
    for d in range(1, 41):
        n, at = 49 + d % 4, rng.randrange(0, 140)
        rows.append((d, f"{prose(rng, d)} {' '.join(first[at : at + n])} {prose(rng, 5)}".strip(), "en", "s"))
    got = repeated_words(frame(rows)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_substring(rows)


def test_difference_cover():
    assert is_cover(COVER, PERIOD) and not is_cover((0, 1, 2), 31)
    for i in range(PERIOD):
        for j in range(PERIOD):
            assert any((i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER for k in range(PERIOD))
    with pytest.raises(ValueError):
        substring_dedup.repeated_words(None, window=50, period=31, cover=(0, 1))


# ------------------------------------------------------------------------------------------------------ components


def test_components(spark):
    from lodestone.llm.common import components

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    want = {x: find(x) for x in list(parent) if find(x) != x}
    got = components(spark.createDataFrame(links, "u long, v long").repartition(9))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
