from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, graph
from lodestone.plans.queries import QUERIES, part_documents

FIRST = """- Trước Đề: dòng đứng trước tiêu đề
# Đảo Gió (Wind Isle)

## Tổng quan
Đảo Gió là một trò chơi. Có Thần Mây.

## Mục tiêu lớn
- Thần Mây (Cloud God / CG, Ab): cho sức mạnh
  tiếp nối không thuộc định nghĩa
- Thần mây (Sky God): định nghĩa thứ hai
- AB: tên quá ngắn
- K: một chữ

## Đấu trường và bản đồ
1. Sân Cát (Sand), gồm hai phần: rộng
* Bo3, Bo5: thể thức
"""
SECOND = """# Núi Lửa

## Mục tiêu
- Thần Lửa: đối thủ của Sân Cát
- Thần Mây: trùng tên với nơi khác

## Khác
- Điều lạ: không có loại
- (chỉ ngoặc): không phải bí danh
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("dao.txt", FIRST), ("nui.txt", SECOND), ("rong.txt", None)], "source_name string, text string")


@pytest.fixture(scope="module")
def found(docs):
    return graph.extract_mentions_of_definitions(docs).cache()


@pytest.fixture(scope="module")
def entities(found):
    return graph.unique_entities(found).cache()


def test_entities(entities):
    rows = {r["key"]: r for r in entities.collect()}
    assert set(rows) == {"dao.txt#trước đề", "dao.txt#đảo gió", "dao.txt#thần mây", "dao.txt#sân cát", "dao.txt#bo3, bo5", "nui.txt#núi lửa", "nui.txt#thần lửa", "nui.txt#thần mây", "nui.txt#điều lạ", "nui.txt#(chỉ ngoặc)"}
    assert (rows["dao.txt#đảo gió"]["kind"], rows["nui.txt#núi lửa"]["kind"]) == ("game", "chủ đề")
    god = rows["dao.txt#thần mây"]
    assert (god["name"], god["definition"], god["kind"], god["aliases"]) == ("Thần Mây", "cho sức mạnh", "mục tiêu trung lập", ["Cloud God", "Sky God"])
    assert rows["dao.txt#sân cát"]["kind"] == "bản đồ thi đấu" and rows["dao.txt#sân cát"]["definition"] == "rộng"
    assert rows["nui.txt#điều lạ"]["kind"] == "khái niệm"


def test_edges(found):
    belongs = {tuple(r)[:2] for r in graph.belongs_edges(found).collect()}
    assert ("dao.txt#trước đề", "dao.txt#đảo gió") not in belongs and ("dao.txt#sân cát", "dao.txt#đảo gió") in belongs
    raw = graph.similar_edges(found)
    pairs = sorted(tuple(r)[:2] for r in raw.collect())
    assert pairs == sorted([("dao.txt#thần mây", "nui.txt#thần lửa")] * 2 + [("dao.txt#thần mây", "nui.txt#thần mây")] * 2)
    assert graph.upsert_edges(raw).count() == 2


def test_build_and_queries(spark, docs, entities):
    built = graph.build_graph(docs, chunking.with_ids(chunking.chunk_documents(docs)))
    counts = built["counts"].first()
    assert counts["entities"] == 10 and counts["aliases"] == 4 and counts["edges"] > counts["stored_edges"] > 10
    seeds = spark.createDataFrame([(1, "Thần Lửa"), (2, "Thần Mây"), (3, "không có")], "qid long, name string")
    near = sorted((r["qid"], r["name"], r["source_name"], r["from_name"]) for r in graph.similar_neighbors(built["similar"], built["entities"], seeds).collect())
    assert near == [(1, "Thần Mây", "dao.txt", "Thần Lửa"), (2, "Thần Lửa", "nui.txt", "Thần Mây")]
    ranked = graph.chunks_mentioning(built["mentions"], built["entities"], seeds, 2).collect()
    assert {r["qid"] for r in ranked} == {1, 2} and all(r["rank"] <= 2 for r in ranked)
    notes = graph.similar_notes(built["similar"], built["entities"], seeds).where("qid = 1").first()["notes"]
    assert notes == ['Thần Lửa cùng vai trò "mục tiêu trung lập" với: Thần Mây (dao)']
    kinds = {r["source_name"]: (r["n"], r["samples"][0]) for r in graph.communities(entities).collect()}
    assert kinds["nui.txt"][0] == 5 and kinds["dao.txt"][0] == 5


def test_together(spark):
    mentions = spark.createDataFrame([("a", 1), ("b", 1), ("a", 1), ("b", 2), ("a", 2), ("c", 3)], "entity_key string, chunk_id long")
    assert [tuple(r) for r in graph.together_edges(mentions).collect()] == [("a", "b", graph.TOGETHER, 2.0)]


def test_found_names_keep_their_order(spark, entities):
    lexicon = graph.surfaces(entities)
    texts = spark.createDataFrame([(1, "SAND rồi cloud god, Thần Mây; thần lửax"), (2, None)], "id long, t string")
    found = graph.found_entities(graph.match_surfaces(texts, lexicon, "id", "t"), lexicon, "id").collect()
    assert [tuple(r) for r in found] == [(1, ["Sân Cát", "Thần Mây"])]
    keys = graph.found_entities(graph.match_surfaces(texts, lexicon, "id", "t"), lexicon, "id", "key").first()["keys"]
    assert keys == ["dao.txt#sân cát", "dao.txt#thần mây", "nui.txt#thần mây"]


def test_cutting_of_aliases(spark):
    raw = ["Xạ thủ (ADC / Bot)", "Thánh Vật (Artifact), gồm năm", "Bo3, Bo5", "(only)", "A (b)", " Tên  "]
    got = [tuple(r[0]) for r in spark.createDataFrame([(x,) for x in raw], "x string").select(graph.split_alias(F.col("x"))).collect()]
    assert got == [("Xạ thủ", ["ADC", "Bot"]), ("Thánh Vật", ["Artifact"]), ("Bo3, Bo5", []), ("(only)", []), ("A", []), ("Tên", [])]


def plain_graph(sources, chunks):
    """Counts by plain loops, of definitions [(source, name, alias)] in order and chunks' texts."""
    aliases = {}
    for source, name, alias in sources:
        aliases.setdefault((source, name.lower()), [name]).append(alias)
    named = {}
    for key, names in aliases.items():
        for n in names:
            named.setdefault(n.lower(), set()).add(key)
    # no surface here is part of another one, and all stand between blanks or brackets
    mentioned = [{key for w in re.findall(r"[a-z]+ [a-z]+|\w+#\d+|P\d+|Brand name", text) for key in named.get(w.lower(), ())} for text in chunks]
    # documents are of one kind, parts of another
    raw = sum(a[0] < b[0] for a in sources for b in sources if ("Brand" in a[1]) == ("Brand" in b[1]))
    similar = {(a, b) for a in aliases for b in aliases if a[0] < b[0] and ("brand" in a[1]) == ("brand" in b[1])}
    together = {(a, b) for found in mentioned for a in found for b in found if a < b}
    belongs = [x for x in sources if "Brand" not in x[1]]
    stored = len(similar) + len(together) + len({x[:2] for x in belongs})
    return {"entities": len(aliases), "aliases": sum(len(dict.fromkeys(v[1:])) for v in aliases.values()), "mentions": sum(map(len, mentioned)), "edges": len(belongs) + raw + len(together), "stored_edges": stored}


@pytest.mark.parametrize("limit", [200_000, 100])
def test_registered_graph_is_that_of_all_sources(spark, sf_dir, monkeypatch, limit):
    """Also with a lexicon that must be matched in parts."""
    monkeypatch.setattr(graph, "MAX_LEXICON", limit)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").collect()
    sources = [(r["p_brand"], r["p_name"], f"P{r['p_partkey'] + 1000}") for r in parts] + [(b, b, "Brand name") for b in {r["p_brand"] for r in parts}]
    chunks = [r["content"] for r in chunking.chunk_documents(part_documents(spark, sf_dir)).collect()]
    assert QUERIES["build_graph"](spark, sf_dir).first().asDict() == plain_graph(sources, chunks)


ODD = ["a", "B", "ß", "SS", "_", "1", " ", " ", "-", "(", "é", "É", "ab", "ſ", ".", "İ", "i", "ı", "ﬅ", "ﬆ", "\n", "日", "\U0001f600", "Σ", "ς"]


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_a_large_lexicon_meets_texts_in_a_join(spark, monkeypatch, bits):
    """Equal to the lexicon that is sent, also where the filter lets nearly everything pass."""
    import random

    rng = random.Random(12)
    names = list(dict.fromkeys("".join(rng.choices(ODD, k=rng.randrange(1, 6))).lower() for _ in range(60)))
    lexicon = spark.createDataFrame([(n, str(k), n, f"s{k % 3}", k, 0) for k, n in enumerate(names)] + [(names[0], "x", "y", "s0", 0, 0)], "surface string, key string, name string, source_name string, pos int, nth int")
    texts = spark.createDataFrame([(i, "".join(rng.choices([*ODD, *names], k=rng.randrange(0, 40)))) for i in range(200)] + [(200, None), (201, "a " * 3000)], "id long, t string").repartition(3)
    whole = sorted(map(tuple, graph.match_surfaces(texts, lexicon, "id", "t").collect()))
    monkeypatch.setattr(graph, "MAX_LEXICON", 10)
    monkeypatch.setattr(graph, "FILTER_BITS", bits)
    ready = graph.Surfaces(lexicon)
    assert not ready.small
    for _ in range(2):
        assert sorted(map(tuple, graph.match_surfaces(texts, ready, "id", "t").collect())) == whole != []


def test_verification_with_a_large_lexicon(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, QUERIES["verify_entities"](spark, sf_dir).collect()))
    monkeypatch.setattr(graph, "MAX_LEXICON", 3)
    assert sorted(map(tuple, QUERIES["verify_entities"](spark, sf_dir).collect())) == whole


def test_folding_joins_what_case_joins():
    """Characters that a pattern takes for equal when case is ignored fold to one."""
    for c in map(chr, [*range(0x250), *range(0x370, 0x530), *range(0x1C80, 0x1C90), *range(0x1E00, 0x2000), 0x2126, 0x212A, 0x212B, *range(0xFB00, 0xFB07), *range(0xA640, 0xA7B0)]):
        for d in {*c.lower(), *c.upper(), *c.swapcase(), *c.upper().lower(), "s", "k", "i", "ι", "ß"}:
            assert graph.folded(c) == graph.folded(d) or not re.fullmatch(re.escape(c), d, re.IGNORECASE), (c, d)
            assert len(graph.folded(c)) == 1


def test_many_surfaces_of_one_first_word_take_time_in_proportion():
    import time

    surfaces = [f"north street {k}" for k in range(100_000)]
    text = "North Street 77, north street 123456; " * 5000
    began = time.perf_counter()
    match = graph.Matcher(surfaces)
    built = time.perf_counter()
    found = match(text)
    assert len(found) == 5000 and time.perf_counter() - built < 3 and built - began < 10


def test_similar_counts_are_those_of_listed_edges(spark, found):
    import random

    rng = random.Random(3)
    invented = [(f"{k}", rng.choice("xyz"), f"s{k % 4}", n) for n, k in enumerate(rng.choices(range(30), k=80))]
    other = spark.createDataFrame(invented, "key string, kind string, source_name string, pos int")
    for rows in (found, other, other.limit(0)):
        edges = graph.similar_edges(rows)
        listed = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        assert tuple(graph.similar_counts(graph.similar_members(rows)).first()) == (edges.count(), listed.distinct().count())


@pytest.fixture(scope="module", params=[1, 2])
def invented(spark, request):
    """Entities whose names several sources and kinds share, edges listed and factorised, mentions, seeds and hits."""
    import random

    rng = random.Random(request.param)
    rows = [(f"{s}#{n}", f"n{n}", rng.choice(["k1", "k2", "k3"]), f"{s}.txt") for s in "abcde" for n in rng.sample(range(25), 14)]
    entities = spark.createDataFrame(rows, "key string, name string, kind string, source_name string").cache()
    mentions = spark.createDataFrame(list({(rng.choice(rows)[0], rng.randrange(60)) for _ in range(400)}), "entity_key string, chunk_id long").cache()
    seeds = spark.createDataFrame([(q, f"n{rng.randrange(26)}") for q in range(30) for _ in range(rng.choice([1, 1, 2, 3]))], "qid long, name string").cache()
    hits = spark.createDataFrame([(q, rng.randrange(60)) for q in range(30) for _ in range(rng.randrange(12))], "qid long, id long").cache()
    edges = graph.similar_edges(entities, order=["key"], default=None).cache()
    return graph.similar_members(entities, default=None), entities, mentions, seeds, hits, graph.neighbors(edges, entities, seeds).cache()


def bag(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_factorised_neighbors(invented):
    members, entities, _, seeds, _, near = invented
    assert bag(graph.similar_neighbors(members, entities, seeds)) == bag(near) != []
    assert graph.similar_neighbors(members, entities, seeds.limit(0)).count() == 0


def test_factorised_notes(invented):
    members, entities, _, seeds, _, near = invented
    assert bag(graph.similar_notes(members, entities, seeds)) == bag(graph.relation_notes(near)) != []
    assert graph.similar_notes(members, entities, seeds.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [1, 5, 1000])
def test_factorised_expansion(invented, depth):
    """Also where the first lists settle hardly any question."""
    members, entities, mentions, seeds, hits, near = invented
    assert bag(graph.expand_similar(members, entities, mentions, seeds, hits, 3, depth)) == bag(graph.expand(near, mentions, entities, hits, 3)) != []
    assert graph.expand_similar(members, entities, mentions, seeds.limit(0), hits, 3, depth).count() == 0


def test_expansion_writes_a_chunk_once_for_all_sets_of_roles(spark, monkeypatch):
    """Fifteen sets of roles over 3,000 chunks: what is written grows with the chunks, not with the sets times the chunks."""
    entities = spark.createDataFrame([(f"e{k}", f"n{k}", f"k{k % 6}", f"s{k // 6 % 4}.txt") for k in range(96)], "key string, name string, kind string, source_name string").cache()
    mentions = spark.createDataFrame([(f"e{(c * 7 + k * 13) % 96}", c) for c in range(3000) for k in range(1 + c % 4)], "entity_key string, chunk_id long").cache()
    pairs = [(a, b) for a in range(6) for b in range(a)]
    seeds = spark.createDataFrame([(q, f"n{k}") for q, pair in enumerate(pairs) for k in pair], "qid long, name string").cache()
    hits = spark.createDataFrame([(q, c) for q in range(15) for c in range(q, 3000, 50)], "qid long, id long").cache()
    written, write = [], graph.materialize

    def counted(df, *rest, **more):
        table = write(df, *rest, **more)
        written.append(table.count())
        return table

    monkeypatch.setattr(graph, "materialize", counted)
    found = bag(graph.expand_similar(graph.similar_members(entities, default=None), entities, mentions, seeds, hits, 3))
    near = graph.neighbors(graph.similar_edges(entities, order=["key"], default=None), entities, seeds)
    assert found == bag(graph.expand(near, mentions, entities, hits, 3)) and len(found) == 45
    assert max(written) <= 3000


def test_heavy_chunks_are_dealt_to_blocks(spark):
    """A chunk of 400 entities in blocks of 50: the same edges, and no key of the join has more than about two blocks."""
    rows = [(f"e{k:03}", 0) for k in range(400)] + [(f"e{k:03}", 1 + k % 7) for k in range(0, 400, 3)] + [("e000", 0)]
    mentions = spark.createDataFrame(rows, "entity_key string, chunk_id long")
    light, heavy = (graph.together_edges(mentions, heavy=n) for n in (1000, 50))
    assert bag(heavy) == bag(light) and heavy.count() == 400 * 399 // 2
    blocks = spark.createDataFrame(rows, "e string, c long").distinct().where("c = 0").groupBy(F.pmod(F.xxhash64("e"), F.lit(8))).count()
    assert blocks.agg(F.max("count")).first()[0] < 2 * 50


def test_together_by_class(spark):
    rows = [("a", 1), ("b", 1), ("a", 1), ("b", 2), ("a", 2), ("c", 3), ("d", 2), ("e", 2), ("f", 3)]
    mentions = spark.createDataFrame(rows, "entity_key string, chunk_id long")
    assert sorted(map(tuple, graph.together_by_class(mentions).collect())) == sorted(map(tuple, graph.together_edges(mentions).collect()))


def test_similar_classes_count_edges(spark, found):
    ends = [x for r in graph.similar_edges(found).collect() for x in (r["src"], r["dst"])]
    rows = graph.similar_classes(found).collect()
    assert sorted(k for r in rows for k in [r["key"]] * r["links"]) == sorted(ends)


def test_edges_at_given_entities(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], f"s{k % 3}") for k in range(12)], "key long, kind string, source_name string")
    every = {tuple(r)[:2] for r in graph.similar_edges(rows, order=["key"]).collect()}
    some = [tuple(r)[:2] for r in graph.similar_edges(rows, order=["key"], at=spark.createDataFrame([(3,), (5,), (5,)], "key long")).collect()]
    assert sorted(some) == sorted(e for e in every if {3, 5} & set(e)) != []


def test_the_last_weight_stays(spark):
    edges = spark.createDataFrame([("a", "b", "r", 2.0, 1), ("a", "b", "r", 1.0, 2)], "src string, dst string, relation string, weight double, nth int")
    assert graph.upsert_edges(edges, "nth").first()["weight"] == 1.0 and graph.upsert_edges(edges).first()["weight"] == 2.0


def test_matcher_tries_every_place():
    """Against regular expressions for every surface, with words, marks and letters that change with case."""
    import random

    rng = random.Random(8)
    pieces = ["a", "B", "ß", "SS", "_", "1", " ", " ", "-", "(", "é", "É", "ab", "ſ", "."]
    for _ in range(1500):
        names = list(dict.fromkeys("".join(rng.choices(pieces, k=rng.randrange(1, 5))).lower() for _ in range(6)))
        text = "".join(rng.choices(pieces, k=rng.randrange(0, 25)))
        want = []
        for name in sorted(names, key=len, reverse=True):
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text, re.IGNORECASE):
                if all(m.end() <= a or b <= m.start() for a, b, _ in want):
                    want.append((m.start(), m.end(), name))
        assert graph.Matcher(names)(text) == sorted(want, key=lambda x: (x[0], x[2])), (names, text)


def test_a_document_is_read_once_not_for_each_of_its_lines(spark):
    """What is read from the whole text stands below the step that makes its lines."""
    docs = spark.createDataFrame([("a", "# A\n- bc: d")], "source_name string, text string")
    plan = graph.extract_mentions_of_definitions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Contains(text#") > plan.index("Generate posexplode(")


def test_listed_neighbors_are_not_shuffled(invented):
    """Only seeds and members are: nothing is exchanged above the join that makes the rows."""
    members, entities, _, seeds, _, _ = invented
    plan = graph.similar_neighbors(members, entities, seeds)._jdf.queryExecution().sparkPlan().toString()
    plan = plan.splitlines()
    made = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any(word in line for line in plan[:made] for word in ("Exchange", "Aggregate", "Sort "))
    assert "_block" in plan[made]


def test_neighbors_meet_as_lists(invented, spark):
    """Seeds meet lists of names, and what is near is said of a list: names are taken out above the join. Names may be null."""
    members, entities, _, seeds, _, _ = invented
    plan = graph.similar_neighbors(members, entities, seeds)._jdf.queryExecution().sparkPlan().toString()
    assert -1 < plan.find("Generate explode(_names") < plan.index("Join")
    rows = spark.createDataFrame([(k, k if k != "z" else None, "k", s) for k, s in zip("abzcd", ["s", "t", "t", "t", None])], "key string, name string, kind string, source_name string")
    found = graph.similar_neighbors(graph.similar_members(rows, default=None), rows, spark.createDataFrame([(1, "a")], "qid long, name string"))
    assert sorted(str(r["name"]) for r in found.collect()) == ["None", "b", "c"]


@pytest.mark.parametrize("blocks", [1, 3])
def test_neighbors_in_blocks(invented, monkeypatch, blocks):
    monkeypatch.setattr(graph, "BLOCK", 4)
    monkeypatch.setattr(graph, "BLOCKS", blocks)
    members, entities, _, seeds, _, near = invented
    assert bag(graph.similar_neighbors(members, entities, seeds)) == bag(near) != []


def test_edges_are_counted_by_tasks_of_one_size(spark, monkeypatch):
    """More mentions make more tasks, not larger ones, beyond the usual number of partitions."""
    from lodestone import session

    rows = spark.range(4000).select(F.col("id").alias("entity_key"), (F.col("id") / 4).cast("long").alias("chunk_id"))
    want = bag(graph.together_edges(rows))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 200)
    found = graph.together_edges(rows)
    assert bag(found) == want and found.rdd.getNumPartitions() == 6000 // 200
    heavy = graph.together_edges(rows, heavy=3)
    assert bag(heavy) == want


def test_tables_that_are_not_asked_for_are_not_built(docs, monkeypatch):
    chunks = chunking.with_ids(chunking.chunk_documents(docs))
    every = graph.build_graph(docs, chunks)
    monkeypatch.setattr(graph, "together_by_class", None)
    assert bag(graph.build_graph(docs, chunks, ["mentions"])["mentions"]) == bag(every["mentions"])
    monkeypatch.setattr(graph, "mentions", None)
    assert bag(graph.build_graph(docs, chunks, ["similar"])["similar"]) == bag(every["similar"])


@pytest.mark.parametrize("limit", [0, 200_000])
def test_mentions_are_not_shuffled_to_be_told_apart(spark, monkeypatch, limit):
    """Surfaces share keys and keys have several surfaces; each mention is one row, made above all exchanges where classes can be sent."""
    said = [("one", "a"), ("one", "b"), ("two", "b"), ("two", "c"), ("three", "a"), ("four", "d"), ("four", "b"), ("one", "c")]
    lexicon = spark.createDataFrame([(w, k, k, "s", n, 0) for n, (w, k) in enumerate(said)], "surface string, key string, name string, source_name string, pos int, nth int")
    texts = {1: "one two three one", 2: "four", 3: "two four", 4: "none", 5: "three"}
    chunks = spark.createDataFrame(list(texts.items()), "id long, content string")
    monkeypatch.setattr(graph, "MAX_LEXICON", limit)
    found = graph.mentions(chunks, lexicon)
    assert bag(found) == sorted(str(r) for r in spark.createDataFrame(list({(i, k) for i, t in texts.items() for w, k in said if w in t.split()}), "chunk_id long, entity_key string").collect())
    if limit:
        plan = found._jdf.queryExecution().sparkPlan().toString().splitlines()
        made = next(i for i, line in enumerate(plan) if "Join" in line)
        assert not any(word in line for line in plan[:made] for word in ("Exchange", "Aggregate"))
