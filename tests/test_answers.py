from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import grounding as G
from lodestone.functions import text
from lodestone.operators import context, evaluation, history
from lodestone.operators.verification import verify
from lodestone.plans.ask import ask
from lodestone.plans.ingest import graph_of
from lodestone.sources import services, tables
from lodestone.sources.files import read_documents, read_questions

CONTEXT = ["Màn hình 160/90, giá 1.5 đồng, Rồng Lớn ở phía bắc."]


def checked(spark, answer, question="", contents=CONTEXT, lexicon=None):
    rows = spark.createDataFrame([(1, question, answer, contents)], "qid long, question string, answer string, contents array<string>")
    return verify(rows, lexicon).first()


def test_citations(spark):
    r = checked(spark, "Có [1] và sai [7] . Thêm [07] nữa  đây [2].", contents=["a", "b", "c", "d"])
    assert r["text"] == "Có [1] và sai. Thêm nữa đây [2]." and r["invalid_citations"] == [7] and r["citation_coverage"] == 1.0
    assert checked(spark, None)["text"] == "" and checked(spark, "")["citation_coverage"] == 0.0


@pytest.mark.parametrize(
    "answer,question,bad",
    [("Độ phân giải 160/90 [1].", "", []), ("Giá 180.", "", ["180"]), ("Có 42 cái.", "42 cái?", []), ("Có 1 và 2.", "", []), ("Giá 1,50 đồng.", "", []), ("10,000 và 10 và 10,0", "", ["10,000"])],
)
def test_numbers(spark, answer, question, bad):
    r = checked(spark, answer, question)
    assert r["ungrounded_numbers"] == bad and r["escalate"] == bool(bad)


def test_names(spark):
    names = lambda a: checked(spark, a)["ungrounded_names"]
    assert names("Ở đó có Vua Bóng Đêm cai trị.") == ["Vua Bóng", "Bóng Đêm"]
    assert names("Trong Rồng Lớn có gì.") == [] and names("Ai Cập Cổ có gì.") == ["Cập Cổ"]
    assert names("gặp Vua Bóng, rồi đi") == []  # a name right before a comma loses its last word
    assert G.names_not_in("có Vua Bóng đây", "VUA BÓNG") == []


def test_flags_and_entities(spark):
    docs = spark.createDataFrame([("a.txt", "# A\n## Mục tiêu\n- Rồng Lớn: x\n- Thần Gió: y")], "source_name string, text string")
    from lodestone.operators.graph import extract_mentions_of_definitions, surfaces, unique_entities

    lexicon = surfaces(unique_entities(extract_mentions_of_definitions(docs)))
    r = checked(spark, "hai con: rồng lớn và thần gió.", question="Thần Gió?", lexicon=lexicon)
    assert r["ungrounded_entities"] == ["Thần Gió"] and r["escalate"]
    assert r["flags"] == ["thực thể không có trong ngữ cảnh: ['Thần Gió']"]


def test_citation_list_breaks_at_the_first_weak_hit(spark):
    hits = [(0.7, "vector", "a"), (0.5, "vector", "b"), (0.4, "graph", "c")]
    rows = spark.createDataFrame([([(s, v, n, "s", "t") for s, v, n in hits],)], "hits array<struct<similarity:double,via:string,source_name:string,section:string,content:string>>")
    assert rows.select(context.citations(F.col("hits"), 0.6)).first()[0] == ["a · s"]
    rows = rows.select(F.reverse("hits").alias("hits"))
    assert rows.select(context.citations(F.col("hits"), 0.6)).first()[0] == ["c · s"]
    assert spark.sql("select filter(array(named_struct('similarity',1d,'via','v','source_name','a','section','s')), x -> false) as hits").select(context.citations(F.col("hits"), 0.6)).first()[0] == []


def test_history(spark):
    rows = [("s", k, f"q{k}", f"a{k}", k == 3, False) for k in range(9)] + [("r", 0, "old", "x", False, False), ("r", 1, "", "", False, True), ("r", 2, "new", "y", False, False)]
    turns = spark.createDataFrame(rows, "session string, turn long, question string, answer string, refused boolean, reset boolean")
    got = {r["session"]: [m["text"] for m in r["history"]] for r in history.remembered(turns).collect()}
    assert got["s"] == [x for k in (2, 4, 5, 6, 7, 8) for x in (f"q{k}", f"a{k}")] and got["r"] == ["new", "y"]
    short = spark.sql("select array(1, 2) as a, array(1, 2, 3, 4, 5, 6) as b").select(history.last_messages(F.col("a")), history.last_messages(F.col("b"))).first()
    assert list(short) == [[1, 2], [3, 4, 5, 6]]


def streamed(spark, folder, batches, schema, **how):
    """What remember() puts out for each of the batches, one run after the other over the same state."""
    from lodestone.streaming.history import remember

    found = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        out = []
        stream = remember(spark.readStream.schema(schema).parquet(str(folder / "in")), **how)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(folder / "state")).foreachBatch(lambda df, _, out=out: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(120)
        found.append({r["session"]: [m["text"] for m in r["history"]] for r in out})
    return found


TURNS = "session string, turn long, question string, answer string, refused boolean, reset boolean"


def test_late_and_repeated_turns_lead_to_the_same_history(spark, tmp_path):
    import random

    rng = random.Random(6)
    turns = [(s, n, f"q{n}", f"a{n}", n % 4 == 1, n == {"x": 3, "y": 0, "z": 99}[s]) for s in "xyz" for n in range(9)]
    shuffled = turns + rng.sample(turns, 10)
    rng.shuffle(shuffled)
    batches = [shuffled[k::3] for k in range(3)]
    last = {}
    for out in streamed(spark, tmp_path, batches, TURNS, most_turns=3):
        last |= out
    want = history.remembered(spark.createDataFrame(turns, TURNS), 3).collect()
    assert last == {r["session"]: [m["text"] for m in r["history"]] for r in want}


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """A running query: a session that was idle starts anew when it comes back."""
    from lodestone.streaming.history import remember

    for idle_ms, want in ((1, ["q2", "a2"]), (3_600_000, ["q1", "a1", "q2", "a2"])):
        folder, out = tmp_path / str(idle_ms), []
        put = lambda s, n, folder=folder: spark.createDataFrame([(s, n, f"q{n}", f"a{n}", False, False)], TURNS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        put("x", 1)
        stream = remember(spark.readStream.schema(TURNS).parquet(str(folder / "in")), idle_ms=idle_ms)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(folder / "state")).foreachBatch(lambda df, _, out=out: out.extend(df.collect())).start()
        try:
            for turn in (("y", 1), ("x", 2)):
                for _ in range(200):
                    if any(r["session"] == ("x" if turn[0] == "y" else "y") for r in out):
                        break
                    time.sleep(0.2)
                time.sleep(1)
                put(*turn)
            for _ in range(200):
                if any(r["session"] == "x" and r["turn"] == 2 for r in out):
                    break
                time.sleep(0.2)
        finally:
            query.stop()
        assert [[m["text"] for m in r["history"]] for r in out if r["session"] == "x" and r["turn"] == 2] == [want]


def test_history_as_a_stream(spark, tmp_path):
    from lodestone.streaming.history import remember

    schema = "session string, turn long, question string, answer string, refused boolean, reset boolean"
    batches = [[("s", k, f"q{k}", f"a{k}", k == 1, False) for k in range(4)], [("s", 4, "q4", "a4", False, False), ("t", 0, "x", "y", False, False)], [("s", 5, "", "", False, True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = remember(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3)
        out = []
        query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _, out=out: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        got = {r["session"]: [m["text"] for m in r["history"]][::2] for r in out}
        assert got == [{"s": ["q0", "q2", "q3"]}, {"s": ["q2", "q3", "q4"], "t": ["x"]}, {"s": []}][k]


def test_documents_and_questions(spark, tmp_path):
    (tmp_path / "kb" / "below").mkdir(parents=True)
    (tmp_path / "kb" / "a b+%.txt").write_bytes("﻿xin \r\nchào".encode())
    (tmp_path / "kb" / "B.MD").write_text("# B")
    (tmp_path / "kb" / "c.json").write_text("{}")
    (tmp_path / "kb" / "below" / "d.txt").write_text("no")
    rows = {r["source_name"]: r["text"] for r in read_documents(spark, str(tmp_path / "kb")).collect()}
    assert rows == {"a b+%.txt": "xin\nchào", "B.MD": "# B"}
    assert [r["source_name"] for r in read_documents(spark, str(tmp_path / "kb"), ordered=True).collect()] == ["B.MD", "a b+%.txt"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception, match="no .txt|PATH"):
        read_documents(spark, str(tmp_path / "empty"))
    (tmp_path / "q.json").write_text('{"questions": [{"q": "a?", "type": "in_scope", "expect_source": "x"}, {"q": "b?", "type": "ambiguous", "expect_any_source": ["x", "y"]}], "graph": []}')
    asked = read_questions(spark, str(tmp_path / "q.json")).collect()
    assert [(r["pos"], r["q"], r["expect_any_source"]) for r in asked] == [(0, "a?", None), (1, "b?", ["x", "y"])]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "source_name string, chunk_index int, content string")
    new = spark.createDataFrame([("a", 0, "1", 1), ("a", 0, "2", 2)], "source_name string, chunk_index int, content string, at int")
    assert sorted(map(tuple, tables.upsert(old, new, ["source_name", "chunk_index"], "at").collect())) == [("a", 0, "2"), ("a", 1, "y"), ("b", 0, "z")]
    assert sorted(map(tuple, tables.replace_sources(old, new.where("at = 1")).collect())) == [("a", 0, "1"), ("b", 0, "z")]
    assert tables.insert_new(old, old.unionByName(old), ["source_name", "chunk_index"]).count() == 3
    tables.write(old, str(tmp_path), "t")
    assert tables.is_built(spark, str(tmp_path), "t") and not tables.is_built(spark, str(tmp_path), "nothing")
    tables.write(old.limit(0), str(tmp_path), "e")
    with pytest.raises(ValueError, match="empty"):
        tables.table(spark, str(tmp_path), "e", non_empty=True)
    vectors = spark.sql("select 1 as id, array(1f, 0f) as embedding")
    assert tables.check_dimension(vectors, 2) is vectors
    with pytest.raises(ValueError, match="dimensions"):
        tables.check_dimension(vectors, 3)
    with pytest.raises(ValueError, match="match"):
        tables.paired(spark.sql("select 2 as id, 'x' as content"), vectors)
    tables.write_results(spark.sql("select 'đúng' as reason"), str(tmp_path / "r"))
    assert any("đúng" in p.read_text() for p in (tmp_path / "r").glob("*.json"))
    tables.write_results(spark.sql("select 1 as n"), str(tmp_path / "s"), {"top_k": 4, "model": "m"})
    assert [p.read_text() for p in (tmp_path / "s.config").glob("*.json")] == ['{"top_k":4,"model":"m"}\n']
    both = [(r["n"], r["settings"].asDict()) for r in tables.read_results(spark, str(tmp_path / "s"), "n int").collect()]
    assert both == [(1, {"top_k": 4, "model": "m"})]
    assert [tuple(r) for r in tables.read_results(spark, str(tmp_path / "r"), "reason string").collect()] == [("đúng", None)]


def test_keyed_tables_change_only_what_is_touched(spark, tmp_path):
    rows = spark.createDataFrame([(f"s{k % 20}", k, "old") for k in range(200)], "source_name string, chunk_index int, content string")
    path, by, keys = str(tmp_path / "chunks"), ["source_name"], ["source_name", "chunk_index"]
    tables.create_keyed(rows, path, by, 8)
    files = lambda: {str(p.relative_to(path)) for p in (tmp_path / "chunks").rglob("*.parquet")}
    shown = lambda: sorted(map(tuple, tables.read_keyed(spark, path).select(rows.columns).collect()))
    before = files()
    new = spark.createDataFrame([("s3", 3, "new"), ("s3", 999, "new")], rows.schema)
    touched = tables.change_keyed(new, path, by, lambda a, b: tables.upsert(a, b, keys))
    want = {(s, c): t for s, c, t in map(tuple, rows.collect())} | {("s3", 3): "new", ("s3", 999): "new"}
    assert shown() == sorted((*k, t) for k, t in want.items()) and len(touched) == 1
    changed = before ^ files()
    assert changed and {f.split("/")[0] for f in changed} == {f"bucket_of_8={touched[0]}"}

    stands, after = shown(), files()
    failing = lambda a, b: tables.upsert(a, b, keys).withColumn("content", F.when(F.col("chunk_index") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        tables.change_keyed(new, path, by, failing)
    assert shown() == stands and files() == after
    assert tables.change_keyed(new.limit(0), path, by, failing) == [] and files() == after

    tables.change_keyed(new.where("chunk_index = 999"), path, by, tables.replace_sources)
    assert [r for r in shown() if r[0] == "s3"] == [("s3", 999, "new")] and len(shown()) == 191
    tables.change_keyed(new, path, by, lambda a, b: tables.insert_new(a, b, keys))
    assert [r for r in shown() if r[0] == "s3"] == [("s3", 3, "new"), ("s3", 999, "new")]


def test_services(monkeypatch):
    calls, waits = [], []

    def busy():
        calls.append(1)
        raise RuntimeError("429 RESOURCE_EXHAUSTED, retry in 3.5s")

    with pytest.raises(services.RateLimited):
        services.retried(busy, waits.append)
    assert len(calls) == 3 and waits == [4.5, 4.5]
    assert services.wait_for(RuntimeError("429")) == 20 and services.wait_for(RuntimeError("retry in 100s")) == 65
    with pytest.raises(KeyError):
        services.retried(lambda: {}["x"], waits.append)
    assert services.with_fallback([("a", busy), ("b", lambda: 5)], waits.append) == ("b", 5)
    monkeypatch.setenv("SOME_SETTING", " ")
    assert services.setting("SOME_SETTING", "usual") == "usual"


def test_tasks_reach_the_embedder(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "content string")
    told = lambda some, task: [[1.0, 0.0] if task == services.QUESTIONS else [0.0, 1.0] for _ in some]
    first = lambda task: {r["embedding"][0] for r in services.embed(texts, told, task=task).collect()}
    assert first(services.QUESTIONS) == {1.0} and first(services.DOCUMENTS) == {0.0}


def test_trials_of_models_and_embedders():
    def blocked(prompt):
        raise RuntimeError("404 no longer available\nmore")

    calls = []
    models = [("a", blocked), ("b", lambda p: " \n"), ("c", lambda p: calls.append(p) or "two sentences"), ("d", blocked)]
    assert services.usable(models, "say it") == ("c", [("a", "404 no longer available"), ("b", "empty answer")]) and calls == ["say it"]
    assert services.usable(models[:1], "x") == (None, [("a", "404 no longer available")]) and services.usable([], "x") == (None, [])
    found = services.embedding_trial(services.hashed_embedder(4096), "con rồng lửa", "rồng lửa ở hang", "nấu phở bò", most_dims=2000)
    assert found["dims"] == 4096 and not found["fits"] and found["ordered"] and found["near"] > 0.3 > 0.1 > found["far"]
    assert not services.embedding_trial(lambda some: [[1.0, 0.0]], "a", "b", "c")["ordered"]
    with pytest.raises(ValueError, match="zero"):
        services.embedding_trial(lambda some: [[0.0, 0.0]], "a", "b", "c")
    with pytest.raises(ValueError, match="dimensions"):
        services.embedding_trial(lambda some: [[1.0] * len(some[0])], "a", "bb", "c")


def test_quota_spaces_the_calls_of_a_task():
    now, made = [100.0], []
    quota = services.Quota(2.0, 4, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    for cost in (0.0, 0.5, 5.0, 0.0, 0.0):
        quota(lambda cost=cost: (made.append(now[0]), now.__setitem__(0, now[0] + cost)))
    assert made == [100.0, 102.0, 104.0, 109.0, 111.0]  # four tasks at two calls a second: one in two seconds each
    outcomes = iter([RuntimeError("429, retry in 1s"), None])

    def busy():
        made.append(now[0])
        if error := next(outcomes):
            raise error

    quota(busy)
    assert made[5:] == [113.0, 115.0]  # a second attempt keeps the distance too


def test_a_failed_run_keeps_what_its_calls_returned(spark, tmp_path):
    """Over several tasks and steps: no text is called for twice, neither within a run nor by the next."""
    log, broken = tmp_path / "calls", tmp_path / "broken"
    log.mkdir()
    broken.touch()
    path = str(tmp_path / "kept")

    def embedder(some, task=None):
        import os
        import uuid

        if os.path.exists(broken) and any(t in ("text 7", "text 31") for t in some):
            raise ValueError("cannot read this one")
        (log / uuid.uuid4().hex).write_text("\n".join(some))
        return [[float(len(t)), float(ord(t[-1])), 1.0] for t in some]

    rows = [(k, f"text {k}") for k in range(60)] + [(100 + k, "text 5") for k in range(40)] + [(200, None)]
    texts = spark.createDataFrame(rows, "id long, content string").repartition(5)
    called = lambda: [t for f in log.iterdir() for t in f.read_text().split("\n")]
    again = 0
    while broken.exists():
        with pytest.raises(services.NotAll, match="cannot read this one"):
            services.embed_kept(texts, embedder, path, steps=3, tasks=4, size=5)
        if again == 1:
            broken.unlink()
        again += 1
    before = len(called())
    assert before and len(set(called())) == before < 60
    got = {r["id"]: r["embedding"] for r in services.embed_kept(texts, embedder, path, steps=3, tasks=4, size=5).collect()}
    assert sorted(called()) == sorted({t for _, t in rows if t})
    plain = {r["id"]: r["embedding"] for r in services.embed(texts.where("content is not null"), embedder).collect()}
    assert got == plain | {200: None}
    more = texts.unionByName(spark.createDataFrame([(300, "another")], texts.schema))
    assert services.embed_kept(more, embedder, path, steps=2, tasks=2).count() == len(rows) + 1
    assert sorted(called())[0] == "another"
    assert services.embed_kept(texts.limit(0), embedder, path).count() == 0


def test_tasks_share_the_rate(spark, tmp_path):
    """Calls of four tasks, by their own clocks: never more in a second than the rate allows for all of them."""
    import time

    log = tmp_path / "calls"
    log.mkdir()

    def embedder(some):
        import uuid

        (log / uuid.uuid4().hex).write_text(repr(time.time()))
        return [[1.0, float(len(t))] for t in some]

    texts = spark.createDataFrame([(f"t{k}",) for k in range(48)], "content string")
    assert services.embed_kept(texts, embedder, str(tmp_path / "kept"), steps=1, rate=20.0, tasks=4, size=1).count() == 48
    at = sorted(float(f.read_text()) for f in log.iterdir())
    assert len(at) == 48 and max(sum(a <= b < a + 1 for b in at) for a in at) <= 20 + 4


def test_limited_requests_are_not_split(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def embedder(some):
        import uuid

        (log / uuid.uuid4().hex).write_text(str(len(some)))
        raise RuntimeError("429, retry in 0s")

    texts = spark.createDataFrame([(f"t{k}",) for k in range(6)], "content string")
    with pytest.raises(services.NotAll, match="limited in all"):
        services.embed_kept(texts, embedder, str(tmp_path / "kept"), steps=1, tasks=1, size=6)
    assert [f.read_text() for f in log.iterdir()] == ["6"] * 3


def test_ask_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame(
        [("dao.txt", "# Đảo\n\n## Mục tiêu\n- Thần Mây: đứng ở phía bắc của đảo."), ("nui.txt", "# Núi\n\n## Mục tiêu\n- Thần Lửa: sống trong hang núi đá."), ("bien.txt", "# Biển\n\n## Thuật ngữ\n- Sóng: nước dâng lên cao.")],
        "source_name string, text string",
    )
    from lodestone.operators.chunking import chunk_documents, with_ids

    embedder = services.hashed_embedder(2048)
    chunks = services.embed(with_ids(chunk_documents(docs)), embedder).cache()
    history_type = "array<struct<role:string,text:string>>"
    rows = [(1, "So sánh Thần Mây với các mục tiêu khác nhé", []), (2, "zzz qqq www vvv", []), (3, "nó ở đâu?", [("user", "Thần Lửa"), ("model", "...")])]
    questions = spark.createDataFrame(rows, f"qid long, question string, history {history_type}")

    log = tmp_path / "calls"

    def model(prompt: str) -> str:
        with log.open("a") as file:
            file.write("call\n")
        if prompt.startswith("Viết lại"):
            return ' "Thần Lửa sống ở đâu trong núi?" '
        return "Thần Mây ở phía bắc [1]. Cao 180 mét [9]." if "So sánh" in prompt else "Tôi không tìm thấy thông tin này ở đây."

    answers = {r["qid"]: r for r in ask(questions, chunks, embedder, [("m", model)], graph_of(docs), threshold=0.2, verifier=[("v", lambda p: "- Cao 180 mét\n")]).collect()}
    first = answers[1]
    assert first["text"].startswith("Thần Mây ở phía bắc [1]. Cao 180 mét.\n\n⚠") and first["invalid_citations"] == [9]
    assert first["entailment_ran"] and first["unsupported"] == ["Cao 180 mét"] and not first["refused"] and not first["verified"]
    assert answers[2]["refused"] and answers[2]["model_used"] == "" and answers[2]["citations"] == []
    assert answers[3]["refused"] and answers[3]["search_query"] == "Thần Lửa sống ở đâu trong núi?" and answers[3]["flags"] == []
    assert log.read_text().count("call") == 3  # a rewrite and two answers: none for the refused question, none twice


def test_middle_values_of_any_group(spark):
    import random

    from lodestone.operators.evaluation import latency_summary, middle_values

    rng = random.Random(9)
    groups = {n: [round(rng.gauss(0, 10), rng.choice([0, 3])) for _ in range(n)] for n in (1, 2, 3, 4, 9, 10, 1001, 6000)}
    groups |= {50: [1.0] * 30 + [2.0] * 20, 40: [1.0] * 20 + [3.0] * 20, None: [4.0, 6.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [(77, None)]
    got = {r["g"]: tuple(r)[1:] for r in middle_values(spark.createDataFrame(rows, "g long, v double").repartition(5), "g", "v").collect()}
    assert got == {g: (len(v), min(v), max(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) for g, v in groups.items()}
    few = spark.createDataFrame([(1.0, 0.0), (4.0, 0.0)], "a double, b double")
    assert [tuple(r) for r in latency_summary(few, ["a", "b"]).collect()] == [("a", 2, 2.5, 1.0, 4.0)]


def test_three_decimals_are_those_of_c(spark):
    values = [0.8125, 0.5005, 0.0005, -0.0005, 0.0015, -0.0625, 0.9995, 1.0, 0.123456, -1e-9]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(text.fixed(F.col("x"))).collect()
    assert [r[0] for r in got] == [f"{v:.3f}" for v in values]


def test_context_rounds_ties_by_the_binary_value(spark):
    hit = "named_struct('source_name', 's', 'section', 'm', 'similarity', {}D, 'via', 'vector', 'content', 'c')"
    block = spark.range(1).select(context.context_block(F.expr(f"array({hit.format(0.8125)}, {hit.format(0.5005)})"))).first()[0]
    assert "liên quan: 0.812)" in block and f"liên quan: {0.5005:.3f})" in block


def test_few_groups_do_not_gather_their_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = evaluation.middle_values(rows, "g", "v")
        assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
        assert sorted((r["g"], r["lower"], r["upper"]) for r in found.collect()) == [(0, 498.0, 500.0), (1, 499.0, 501.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
