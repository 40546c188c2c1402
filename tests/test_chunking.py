from __future__ import annotations

import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking as C

def chunks_of(spark, text, target=1800, overlap=300, name="d.txt"):
    rows = C.chunk_documents(spark.createDataFrame([(name, text)], "source_name string, text string"), target, overlap)
    return [(r["section"], r["content"]) for r in rows.orderBy("chunk_index").collect()]


def test_sections(spark):
    """Text before a heading, the title (the first of level 1 only), headings of any level, blank sections, near-headings."""
    text = "before\n# Title \nopening\n## One\n\n  \n### Two\nx\n#no heading\n####### seven\n# Second title\ny\n## \nz"
    assert chunks_of(spark, text) == [
        ("Mở đầu", "Title — Mở đầu\nbefore opening"),
        ("Two", "Title — Two\nx #no heading ####### seven"),
        ("Second title", "Title — Second title\ny"),
        ("", "Title — \nz"),
    ]
    assert chunks_of(spark, "only text") == [("Mở đầu", "d.txt — Mở đầu\nonly text")]
    assert chunks_of(spark, "# Title") == chunks_of(spark, "") == chunks_of(spark, None) == chunks_of(spark, " \n\t\n") == []


@pytest.mark.parametrize(
    "body,units",
    [
        ("Một câu. Hai câu! Ba? bốn. 5 năm: Sáu", ["Một câu.", "Hai câu!", "Ba? bốn.", "5 năm:", "Sáu"]),  # a capital or digit must follow
        ("one line\nand the next. Then\nmore", ["one line and the next.", "Then more"]),
        ("- a\n- b. C\n* d\n12. e\n• f", ["- a", "- b. C", "* d", "12. e", "• f"]),  # bullets stay whole
        ("- a\n  goes on\n- b\n\tand on\n  and on", ["- a goes on", "- b and on and on"]),
        ("- a\nnot indented", ["- a", "not indented"]),  # one of two lines is half
        ("text. Then\nmore\nand\n- one bullet", ["text.", "Then more and - one bullet"]),  # one of four isn't
        ("- a\n\nProse here. More\n\n\n1. b", ["- a", "Prose here.", "More", "1. b"]),  # each paragraph by itself
        ("  - indented bullet\n-no bullet", ["- indented bullet", "-no bullet"]),
    ],
)
def test_units(spark, body, units):
    assert spark.createDataFrame([(body,)], "t string").select(C.units(T.strip(F.col("t")))).first()[0] == units


@pytest.mark.parametrize(
    "lengths,target,overlap,ranges",
    [
        ([], 10, 0, []),
        ([3], 1, 0, [(0, 1)]),  # a unit is never cut
        ([4, 4, 4], 10, 0, [(0, 2), (2, 3)]),  # 4 and 1, twice, fill ten
        ([4, 4, 4, 4], 10, 4, [(0, 2), (1, 3), (2, 4)]),  # the last unit of four is repeated
        ([2, 2, 2, 2, 2], 9, 5, [(0, 3), (1, 4), (2, 5)]),  # two of two and the joint between are five
        ([20, 1, 20, 1], 10, 300, [(0, 1), (0, 2), (0, 3), (0, 4)]),
        ([20, 20], 10, 5, [(0, 1), (1, 2)]),
    ],
)
def test_packing(lengths, target, overlap, ranges):
    assert list(C.packed_ranges(lengths, target, overlap)) == ranges


def test_packing_keeps_its_promises():
    rng = random.Random(3)
    for _ in range(500):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
        target, overlap = rng.randrange(20, 200), rng.randrange(0, 80)
        ranges = list(C.packed_ranges(lengths, target, overlap))
        size = lambda a, b: sum(lengths[a:b]) + b - a  # noqa: E731, B023
        assert ranges[0][0] == 0 and ranges[-1][1] == len(lengths)
        for (a, b), (c, d) in zip(ranges, ranges[1:], strict=False):
            assert a <= c <= b < d  # none is left out, each brings a new one
            assert size(a, b + 1) > target  # closed for a reason
            assert size(c, b) - 1 <= overlap and (c == a or size(c - 1, b) - 1 > overlap)  # as much as fits is repeated
        assert all(size(a, b) <= target or size(a, b - 1) - 1 <= overlap for a, b in ranges)


def test_headers_and_short_ends(spark):
    """A header counts towards the target; a last piece under 80 characters joins the one before."""
    lines = [f"- {'x' * 56}{k:02}" for k in range(7)]
    assert chunks_of(spark, "# T\n## S\n" + "\n".join(lines), 188, 0) == [("S", "\n".join(["T — S", *lines[:2]])), ("S", "\n".join(["T — S", *lines[2:4]])), ("S", "\n".join(["T — S", *lines[4:]]))]
    assert chunks_of(spark, f"# {'T' * 500}\n" + "\n".join(lines[:2]), 188, 0) == [("Mở đầu", f"{'T' * 500} — Mở đầu\n" + "\n".join(lines[:2]))]


def test_long_sections_take_time_in_proportion(spark):
    text = "Một câu ngắn. " * 100_000
    assert spark.createDataFrame([("d", text)], "source_name string, text string").transform(C.chunk_documents).count() > 700


def test_long_lists_take_time_in_proportion(spark):
    """The ends of units are found once for a list, not once for each unit."""
    lines = "\n".join(f"- bullet {k}" + ("\n  goes on" if k % 3 == 0 else "") for k in range(40_000))
    docs = spark.createDataFrame([(lines,)], "body string")
    began = time.monotonic()
    row = docs.select(C.units(F.col("body")).alias("u")).select(F.size("u").alias("n"), F.get("u", F.lit(39_999)).alias("last")).first()
    assert tuple(row) == (40_000, "- bullet 39999 goes on") and time.monotonic() - began < 60


def test_no_line_is_lost_and_neighbours_overlap(spark):
    body = "\n\n".join(f"Câu số {k} có vài từ. Câu tiếp theo của đoạn {k}." for k in range(40))
    chunks = C.chunk_documents(spark.createDataFrame([("x.txt", f"# T\n\n## S\n{body}")], "source_name string, text string"), 400, 120)
    joined = "\n".join(r["content"] for r in chunks.collect())
    assert all(sentence in joined for sentence in re.split(r"(?<=\.)\s+", body))
    pairs = C.neighbours_overlap(chunks).collect()
    assert len(pairs) > 3 and all(r["overlaps"] for r in pairs)


def test_clean_text(spark):
    raw = ["﻿a\r\nb \t\rc d​e  \n\n\n\n hòá \n ", "  x\n\n\ny", None, "", " 　z \n"]

    def plain(t):
        t = unicodedata.normalize("NFC", t.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n"))
        t = "\n".join(x.rstrip() for x in t.replace("​", "").replace(" ", " ").split("\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    got = [r[0] for r in spark.createDataFrame([(t,) for t in raw], "t string").select(T.clean_text(F.col("t"))).collect()]
    assert got == [None if t is None else plain(t) for t in raw]


def test_stats_and_tokens(spark):
    chunks = spark.createDataFrame([("a", "s", 10, 3), ("a", "t", 13, 4), ("b", "s", 5, 2)], "source_name string, section string, n_chars int, approx_tokens int")
    assert sorted(map(tuple, C.chunk_stats(chunks).collect())) == [("a", 2, 10, 11, 13, 7, 2), ("b", 1, 5, 5, 5, 2, 1)]
    n = spark.range(1, 20).select("id", T.approx_tokens(F.col("id")).alias("t")).collect()
    assert all(r["t"] == round(r["id"] / 3.0) for r in n)


def test_ids_follow_source_and_index(spark):
    rows = [("b", 1), ("a", 0), ("b", 0), ("c", 0), ("a", 1), ("a", 2)]
    got = C.with_ids(spark.createDataFrame(rows, "source_name string, chunk_index int").repartition(3)).collect()
    assert {tuple(r) for r in got} == {(*r, k) for k, r in enumerate(sorted(rows), 1)}


def test_ids_of_a_large_source_come_from_ranges(spark):
    """A source of two thirds of all chunks; no window without a partition, and no task with more than its range."""
    from lodestone.operators.ordering import numbered

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, concat('s', id % 7), 'big') as source_name", "cast(id as int) as chunk_index", "id % 5 as tie").repartition(5)
    got = C.with_ids(rows)
    assert "Window" not in got._jdf.queryExecution().toString()
    assert [tuple(r)[:2] for r in sorted(got.collect(), key=lambda r: r["id"])] == sorted(tuple(r)[:2] for r in rows.collect())
    assert {r["id"] for r in got.collect()} == set(range(1, 3001))
    down = numbered(rows, F.col("tie").desc(), "chunk_index", name="place").collect()
    assert {r["chunk_index"]: r["place"] for r in down} == {r["chunk_index"]: k for k, r in enumerate(sorted(down, key=lambda r: (-r["tie"], r["chunk_index"])), 1)}
    assert C.with_ids(rows.limit(0)).count() == 0


def test_strip_takes_all_white_space_and_no_more(spark):
    """Every character of the basic plane, at both ends of a text, against the pattern that names the property."""
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(f"{c}{c}a {c}b{c}",) for c in every] + [("",), (None,), (" \u3000\n",)], "t string")
    assert rows.where(~T.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_clean_text_reads_long_white_space_once(spark):
    run = " \t" * 500_000
    texts = [f"a{run}b", f"a{run}\nb{run}", run, "\n" * 1_000_000 + "x" + "\n" * 1_000_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_text(F.col("t"))).collect()]
    assert got == [texts[0], "a\nb", "", "x"]


def test_ids_are_given_to_chunks_made_in_small_batches(spark):
    def small(batches):
        for batch in batches:
            assert batch.num_rows <= C.CHUNKED_ROWS
            yield batch

    rows = spark.range(1000).select(F.col("id").cast("string").alias("source_name"), F.lit(0).alias("chunk_index")).coalesce(1)
    found = C.with_ids(rows.mapInArrow(small, rows.schema)).collect()
    assert [r["source_name"] for r in sorted(found, key=lambda r: r["id"])] == sorted(map(str, range(1000)))
