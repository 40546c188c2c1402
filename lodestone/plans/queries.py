"""The registered queries over the star-schema tables, and SQL for DuckDB that gives the same rows.

Stand-ins: embeddings are chunks, and every one whose vec_id is divisible by 50 is a question to all others; labels are
their sources; parts are entities (type: kind, brand: source), and every one whose key is divisible by 50 is a question's
seed; order lines are mentions (order: chunk); conversations are histories; events carry metrics.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import grounding, routing, text, vectors
from lodestone.operators import chunking, context, evaluation, graph, history, ivf, search, summary, verification
from lodestone.plans import ask
from lodestone.session import checkpoint_dir, dealt, materialize, ship
from lodestone.sources import services, tables
from lodestone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EVERY, TOP, TAU = 50, 5, 0.6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors and evaluation

HITS_SQL = f"""
q AS (SELECT vec_id AS qid, label AS q_label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {EVERY} = 0),
s AS (SELECT qid, q_label, vec_id AS id, label, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings WHERE vec_id <> qid),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= {TOP})
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, q_label, id, label, similarity (six places), rank: the top TOP of each question, ranked by the rounded value."""
    ship(spark)
    vectors_ = table(spark, sf_dir, "embeddings")
    questions = vectors_.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")
    chunks = vectors_.withColumnRenamed("vec_id", "id")
    found = search.top_k(questions, chunks, TOP + 4).where("id <> qid")  # a few more, as rounding may change the order of near ties
    found = search.ranked(found.select("qid", "id", F.round("similarity", 6).alias("similarity")), TOP)
    labelled = found.join(questions.select("qid", F.col("label").alias("q_label")), "qid")
    return labelled.join(chunks.select("id", "label"), "id").select("qid", "q_label", "id", "label", "similarity", "rank")


@query(f"WITH {HITS_SQL} SELECT qid, id, similarity, rank FROM hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select("qid", "id", "similarity", F.col("rank").cast("long").alias("rank"))


@query("""
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, len(v)::INT AS dims, round(n, 6) AS norm, round(v[1] / n, 6) AS first,
  round(v[1] / sqrt(list_sum(list_transform(v[1:16], lambda x: x * x))), 5) AS first_of_16 FROM n
""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    first = lambda a: F.get(a, F.lit(0))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).alias("dims"), F.round(vectors.norm(v), 6).alias("norm"), F.round(first(vectors.normalize(v)), 6).alias("first"), F.round(first(vectors.truncate(v, 16)), 5).alias("first_of_16")
    )


@query("""
SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dimension,
  round(max(abs(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) - 1)), 9) AS max_deviation FROM embeddings
""")
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vector_stats(table(spark, sf_dir, "embeddings"), 64).withColumn("max_deviation", F.round("max_deviation", 9))


@query(f"WITH {HITS_SQL} SELECT qid, max(similarity) AS top_similarity, max(similarity) < {TAU} AS refused FROM hits GROUP BY qid")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(spark, sf_dir)
    return search.gate(found.select("qid").distinct(), found, TAU)


@query(f"""
WITH {HITS_SQL}, f AS (SELECT qid, min(rank) FILTER (WHERE label = q_label) AS first FROM hits GROUP BY qid)
SELECT k::INT AS k, count(*) AS questions, count(*) FILTER (WHERE first <= k) AS found, count(*) FILTER (WHERE first <= k) / count(*)::DOUBLE AS recall
FROM f, (VALUES (1), (3), (5)) t(k) GROUP BY k
""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_at(hits(spark, sf_dir).withColumn("acceptable", F.col("label") == F.col("q_label")))


@query(f"WITH {HITS_SQL} SELECT qid, id, similarity FROM hits h WHERE rank = 1 AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.qid = h.qid AND x.label = x.q_label AND x.rank <= 3)")
def recall_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.misses(hits(spark, sf_dir).withColumn("acceptable", F.col("label") == F.col("q_label")), 3)


@query(f"""
WITH {HITS_SQL}, f AS (SELECT qid, min(rank) FILTER (WHERE label = q_label AND id % 4 = qid % 4) AS first FROM hits GROUP BY qid)
SELECT k::INT AS k, count(*) AS questions, count(*) FILTER (WHERE first <= k) AS found, count(*) FILTER (WHERE first <= k) / count(*)::DOUBLE AS recall
FROM f, (VALUES (1), (3), (5)) t(k) GROUP BY k
""")
def section_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall where the section, here the id's remainder, must be right besides the source."""
    right = (F.col("label") == F.col("q_label")) & (F.col("id") % 4 == F.col("qid") % 4)
    return evaluation.recall_at(hits(spark, sf_dir).withColumn("acceptable", right))


@query(f"""
WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {EVERY} = 0)
SELECT qid, vec_id AS id, (vec_id - qid)::INT AS position, round(list_cosine_similarity(qv, embedding::DOUBLE[]), 6) AS similarity, 'graph' AS via FROM q JOIN embeddings ON vec_id BETWEEN qid + 1 AND qid + 3
""")
def hits_for_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true similarity of chunks that a graph gives, here the three after each question."""
    rows = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    asked = rows.where(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "qid")
    wanted = asked.select("qid", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("position")).select("qid", (F.col("qid") + F.col("position")).alias("id"), "position")
    return search.hits_for_ids(wanted, asked, rows.withColumnRenamed("vec_id", "id")).withColumn("similarity", F.round("similarity", 6))


TOPS_SQL = f"{HITS_SQL}, tops AS (SELECT qid, similarity AS top_similarity, label = q_label AS matched, CASE WHEN q_label < 7 THEN 'in_scope' ELSE 'out_of_scope' END AS type FROM hits WHERE rank = 1)"


def tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's best score, whether it is right, and a type: labels under 7 count as answerable."""
    kind = F.when(F.col("q_label") < 7, "in_scope").otherwise("out_of_scope")
    return hits(spark, sf_dir).where("rank = 1").select("qid", F.col("similarity").alias("top_similarity"), (F.col("label") == F.col("q_label")).alias("matched"), kind.alias("type"))


@query(f"WITH {TOPS_SQL} SELECT type, count(*) AS n, min(top_similarity) AS least, list_sort(list(top_similarity))[count(*)::INT // 2 + 1] AS median, max(top_similarity) AS largest FROM tops GROUP BY type")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.score_distribution(tops(spark, sf_dir))


@query(f"""
WITH {TOPS_SQL}, i AS (SELECT * FROM tops WHERE type = 'in_scope' ORDER BY top_similarity, qid LIMIT 1), o AS (SELECT * FROM tops WHERE type <> 'in_scope' ORDER BY top_similarity DESC, qid LIMIT 1)
SELECT round(i.top_similarity - o.top_similarity, 6) AS gap, i.top_similarity > o.top_similarity AS apart, i.qid AS lowest_inside, o.qid AS highest_outside FROM i, o
""")
def score_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.col("type") == "in_scope"
    return evaluation.score_gap(tops(spark, sf_dir), inside, ~inside).withColumn("gap", F.round("gap", 6))


SWEEP_SQL = f"""
WITH RECURSIVE {TOPS_SQL}, t(i, tau) AS (SELECT 1, 0.40::DOUBLE UNION ALL SELECT i + 1, tau + 0.02::DOUBLE FROM t WHERE i < 21),
sweep AS (SELECT tau, count(*) FILTER (WHERE type = 'in_scope' AND top_similarity >= tau AND matched) AS correct,
  count(*) FILTER (WHERE type = 'in_scope' AND top_similarity >= tau AND NOT matched) AS wrong,
  count(*) FILTER (WHERE type = 'in_scope' AND top_similarity < tau) AS missed,
  count(*) FILTER (WHERE type <> 'in_scope' AND top_similarity < tau) AS good_refusal,
  count(*) FILTER (WHERE type <> 'in_scope' AND top_similarity >= tau) AS bad_answer, count(*) AS n FROM tops, t GROUP BY tau)
"""


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_sweep(tops(spark, sf_dir).select("top_similarity", (F.col("type") == "in_scope").alias("answerable"), F.col("matched").alias("right")))


@query(f"{SWEEP_SQL} SELECT tau, correct, wrong, missed, good_refusal, bad_answer, (correct + good_refusal) / n::DOUBLE AS accuracy FROM sweep")
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep(spark, sf_dir)


@query(f"""
{SWEEP_SQL}, a AS (SELECT tau, (correct + good_refusal) / n::DOUBLE AS accuracy FROM sweep ORDER BY accuracy DESC, tau LIMIT 1),
f AS (SELECT tau, correct FROM sweep WHERE wrong + bad_answer = 0 ORDER BY correct DESC, tau LIMIT 1)
SELECT a.tau AS best_tau, a.accuracy AS best_accuracy, f.tau AS safe_tau, f.correct AS safe_correct FROM a LEFT JOIN f ON true
""")
def tau_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_thresholds(sweep(spark, sf_dir))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) SELECT doc_id, lang FROM r ORDER BY nth, lang LIMIT 50")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stratified_sample(table(spark, sf_dir, "documents", ["doc_id", "lang"]), 50, "lang", "doc_id")


JUDGED_SQL = """
a AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'in_scope' WHEN 1 THEN 'out_of_scope' ELSE 'ambiguous' END AS type, value < 30 AS refused, round(value / 1000, 6) + 0.0000001::DOUBLE AS top_similarity,
  [event_type] AS cited, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'click' END AS expect, CASE WHEN event_id % 3 = 2 THEN ['click', 'view'] ELSE [] END AS any_of FROM events),
j AS (SELECT *, CASE WHEN type = 'out_of_scope' THEN refused WHEN refused THEN false WHEN type = 'ambiguous' THEN list_has_any(cited, any_of) ELSE expect IS NULL OR list_contains(cited, expect) END AS ok FROM a)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as judged answers: the id's remainder gives the type, the value whether it was refused."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 3 == 0, "in_scope").when(e % 3 == 1, "out_of_scope").otherwise("ambiguous").alias("type"),
        (F.col("value") < 30).alias("refused"),
        (F.round(F.col("value") / 1000, 6) + 1e-7).alias("top_similarity"),  # off the ties, where printing rounds differently
        F.array("event_type").alias("cited_sources"),
        F.when((e % 3 == 0) & (e % 2 == 0), "click").alias("expect_source"),
        F.when(e % 3 == 2, F.array(F.lit("click"), F.lit("view"))).otherwise(F.array().cast("array<string>")).alias("expect_any_source"),
    )
    return evaluation.judge(rows)


@query(f"""
WITH {JUDGED_SQL} SELECT event_id, ok, CASE WHEN type = 'out_of_scope' AND refused THEN 'từ chối đúng' WHEN type = 'out_of_scope' THEN 'PHẢI từ chối nhưng đã trả lời'
  WHEN refused THEN 'bỏ sót (điểm cao nhất ' || format('{{:.3f}}', top_similarity) || ' < τ)' WHEN ok THEN 'trích ' || cited[1]
  WHEN type = 'ambiguous' THEN 'trích [''' || cited[1] || '''], kỳ vọng một trong [''click'', ''view'']' ELSE 'trích [''' || cited[1] || '''], kỳ vọng click' END AS reason FROM j
""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("event_id", "ok", "reason")


@query(f"WITH {JUDGED_SQL} SELECT type, count(*) FILTER (WHERE ok) AS passed, count(*) AS total FROM j GROUP BY ROLLUP (type)")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.pass_summary(judged(spark, sf_dir))


@query(f"""
WITH {JUDGED_SQL} SELECT count(*) FILTER (WHERE type = 'out_of_scope' AND NOT refused) AS fabricated, count(*) FILTER (WHERE event_id % 7 = 0) AS flagged,
  count(*) FILTER (WHERE event_id % 11 = 0) AS entailment_ran, count(*) FILTER (WHERE event_id % 4 > 0) AS graph_expanded FROM j
""")
def safety_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = judged(spark, sf_dir).withColumns({"flags": F.when(e % 7 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")), "entailment_ran": e % 11 == 0, "graph_expanded": e % 4})
    return evaluation.safety_summary(rows)


@query("""
WITH m AS (SELECT value AS retrieval_ms, value * 2 AS llm_ms, 0.0::DOUBLE AS verify_ms FROM events), l AS (UNPIVOT m ON retrieval_ms, llm_ms, verify_ms INTO NAME metric VALUE value)
SELECT metric, count(*) AS n, median(value) AS median, min(value) AS least, max(value) AS largest FROM l GROUP BY metric HAVING min(value) <> 0 OR max(value) <> 0
""")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("retrieval_ms"), (F.col("value") * 2).alias("llm_ms"), F.lit(0.0).alias("verify_ms"))
    return evaluation.latency_summary(rows, ["retrieval_ms", "llm_ms", "verify_ms"])


# ---------------------------------------------------------------- citations and contexts

CITED_SQL = f"""
{HITS_SQL}, h AS (SELECT qid, rank, similarity, CASE WHEN id % 5 = 0 THEN 'graph' ELSE 'vector' END AS via, 'src' || label || ' · s' || id % 2 AS label FROM hits)
"""


def labelled_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir).select(
        "qid", "rank", "id", "similarity", F.when(F.col("id") % 5 == 0, "graph").otherwise("vector").alias("via"), F.concat(F.lit("src"), "label").alias("source_name"), F.concat(F.lit("s"), F.col("id") % 2).alias("section"), F.concat(F.lit("text "), "id").alias("content")
    )


@query(f"""
WITH {CITED_SQL}, k AS (SELECT *, min((rank = 1 OR via = 'graph' OR similarity >= {TAU})::INT) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS go FROM h)
SELECT qid, label, min(rank)::INT AS rank FROM k WHERE go = 1 GROUP BY qid, label
""")
def citation_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_hits(spark, sf_dir).withColumn("label", context.label(F.col("source_name"), F.col("section")))
    return context.citation_rows(rows, TAU)


@query(f"""
WITH {CITED_SQL}, k AS (SELECT *, min((rank = 1 OR via = 'graph' OR similarity >= {TAU})::INT) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS go FROM h),
f AS (SELECT qid, label, min(rank) AS rank FROM k WHERE go = 1 GROUP BY qid, label), l AS (SELECT qid, string_agg(label, '; ' ORDER BY rank) AS citations FROM f GROUP BY qid),
c AS (SELECT h.qid, count(*) AS shown FROM h JOIN f ON h.qid = f.qid AND h.label = f.label GROUP BY h.qid) SELECT qid, citations, shown::INT AS shown FROM l JOIN c USING (qid)
""")
def citation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.gathered(labelled_hits(spark, sf_dir)).withColumn("c", context.citations(F.col("hits"), TAU))
    return rows.select("qid", F.array_join("c", "; ").alias("citations"), F.size(context.cited_hits(F.col("hits"), F.col("c"))).alias("shown"))


@query(f"""
WITH {HITS_SQL}, b AS (SELECT qid, string_agg('[' || rank || '] (nguồn: src' || label || ' · mục: s' || id % 2 || ' · độ liên quan: ' || format('{{:.3f}}', similarity) ||
  CASE WHEN id % 5 = 0 THEN ' · bổ sung qua đồ thị tri thức' ELSE '' END || ')' || chr(10) || 'text ' || id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS block FROM hits GROUP BY qid)
SELECT qid, 'NGỮ CẢNH:' || chr(10) || chr(10) || block || chr(10) || chr(10) || CASE WHEN qid % 2 = 0 THEN 'QUAN HỆ RÚT TỪ CẤU TRÚC TÀI LIỆU (dùng để đối chiếu, không phải nguồn để trích dẫn):' || chr(10) || '- note ' || qid || chr(10) || chr(10) ELSE '' END
  || repeat('=', 60) || chr(10) || chr(10) || 'CÂU HỎI: question ' || qid AS message FROM b
""")
def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.gathered(labelled_hits(spark, sf_dir))
    notes = F.when(F.col("qid") % 2 == 0, F.array(F.concat(F.lit("note "), "qid"))).otherwise(F.array().cast("array<string>"))
    return rows.select("qid", context.user_message(F.concat(F.lit("question "), "qid"), F.col("hits"), notes).alias("message"))


# ---------------------------------------------------------------- text and chunks


@query(r"""
WITH d AS (SELECT doc_id, chr(65279) || replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', chr(160) || ' ,' || chr(8203) || 'e' || chr(769) || chr(9) || chr(13)) || chr(10) || chr(10) || chr(10) || chr(10) || ' end ' AS t FROM documents),
a AS (SELECT doc_id, nfc_normalize(replace(replace(replace(t, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS t FROM d),
b AS (SELECT doc_id, regexp_replace(replace(replace(t, chr(8203), ''), chr(160), ' '), '[\t\f\v \x85\p{Z}]+\n', chr(10), 'g') AS t FROM a)
SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[\t\f\v \p{Z}]+$', ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || ' ') AS text FROM b
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit("  ,​é\t\r"))
    dirty = F.concat(F.lit("﻿"), t, F.lit("\n\n\n\n end "))
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(dirty).alias("text"))


UNITS_SQL = r"""
p AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10)) AS body FROM documents),
f AS (SELECT doc_id, regexp_replace(body, '\s*\n\s*', ' ', 'g') AS flat FROM p),
u AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(flat, '([.!?:])\s+([A-ZĐÀ-Ỹ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS units FROM f)
"""


@query(rf"WITH {UNITS_SQL} SELECT doc_id, len(units)::INT AS n_units, md5(array_to_string(units, chr(10))) AS digest FROM u")
def sentence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", chunking.units(text.strip(F.col("text"))).alias("u"))
    return rows.select("doc_id", F.size("u").alias("n_units"), F.md5(F.array_join("u", "\n")).alias("digest"))


#: Packs h (doc_id, units, header) into chunks, each a range (s, b) of units.
PACK_SQL = """
e AS (SELECT doc_id, units, header, greatest({target} - length(header) - 1, 80) AS budget, list_prepend(0, list_transform(range(1, len(units) + 1), lambda i: list_sum(list_transform(units[:i], lambda x: length(x) + 1))::BIGINT)) AS ends FROM h),
c(doc_id, nth, s, i) AS (SELECT doc_id, 0, 0::BIGINT, 0::BIGINT FROM e
  UNION ALL SELECT c.doc_id, nth + 1, list_min(list_filter(range(c.s, x.b + 1), lambda k: ends[x.b + 1] - ends[k + 1] <= {overlap} + 1))::BIGINT, x.b FROM c JOIN e USING (doc_id),
  LATERAL (SELECT coalesce(list_min(list_filter(range(CASE WHEN nth = 0 THEN 1 ELSE c.i + 1 END, len(units)), lambda k: ends[k + 2] - ends[c.s + 1] > budget)), -1)::BIGINT AS b) x WHERE x.b > 0),
ranges AS (SELECT doc_id, nth, s, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY nth), len(units)) AS b, units, header FROM c JOIN e USING (doc_id)),
t AS (SELECT doc_id, nth, header, array_to_string(units[s + 1:b], chr(10)) AS piece FROM ranges),
l AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, lead(piece) OVER (PARTITION BY doc_id ORDER BY nth) AS after FROM t),
m AS (SELECT doc_id, nth, header, CASE WHEN nth = n - 2 AND length(after) < 80 THEN piece || chr(10) || after ELSE piece END AS piece FROM l WHERE NOT (n > 1 AND nth = n - 1 AND length(piece) < 80))
"""
CHUNKS_SQL = f"""
WITH RECURSIVE {UNITS_SQL}, h AS (SELECT doc_id, units, doc_id || ' — Mở đầu' AS header FROM u WHERE len(units) > 0),
{PACK_SQL.format(target=1800, overlap=300)},
chunks AS (SELECT doc_id::VARCHAR AS source_name, 'Mở đầu' AS section, nth::INT AS chunk_index, header || chr(10) || piece AS content FROM m)
"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_name"), "text"))


@query(f"{CHUNKS_SQL} SELECT source_name, section, chunk_index, md5(content) AS digest, length(content)::INT AS n_chars FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("source_name", "section", "chunk_index", F.md5("content").alias("digest"), "n_chars")


@query(f"""
{CHUNKS_SQL} SELECT source_name, count(*) AS n_chunks, min(length(content))::INT AS min_chars, floor(sum(length(content)) / count(*))::BIGINT AS avg_chars, max(length(content))::INT AS max_chars,
  sum(round_even(length(content) / 3.0, 0))::BIGINT AS tokens, count(DISTINCT section) AS n_sections FROM chunks GROUP BY source_name
""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_stats(chunks(spark, sf_dir))


def headed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as documents with a title, an opening, a section for each first word of a type, and bullets of which some go on in a second line."""
    p = table(spark, sf_dir, "part").withColumn("s", F.substring_index("p_type", " ", 1))
    line = F.concat(F.lit("- "), "p_name", F.lit(". Size "), "p_size", F.when(F.col("p_partkey") % 3 == 0, F.lit("\n  second line.")).otherwise(F.lit("")))
    lines = p.groupBy("p_brand", "s").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    section = F.concat(F.lit("### "), "s", F.lit(" \n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    body = lines.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", section.alias("t")))), lambda x: x["t"]), "\n\n").alias("b"))
    return body.select(F.col("p_brand").alias("source_name"), F.concat(F.lit("Opening words. Second sentence\n# The "), "p_brand", F.lit("\n"), "b").alias("text"))


@query(f"""
WITH RECURSIVE p AS (SELECT p_brand, split_part(p_type, ' ', 1) AS s, p_partkey, '- ' || p_name || '. Size ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN ' second line.' ELSE '' END AS line FROM part),
h AS (SELECT p_brand || '|' || s AS doc_id, list(line ORDER BY p_partkey) AS units, 'The ' || p_brand || ' — ' || s AS header FROM p GROUP BY p_brand, s
  UNION ALL SELECT DISTINCT p_brand || '|', ['Opening words.', 'Second sentence'], 'The ' || p_brand || ' — Mở đầu' FROM p),
{PACK_SQL.format(target=300, overlap=80)}
SELECT split_part(doc_id, '|', 1) AS source_name, coalesce(nullif(split_part(doc_id, '|', 2), ''), 'Mở đầu') AS section,
  (row_number() OVER (PARTITION BY split_part(doc_id, '|', 1) ORDER BY split_part(doc_id, '|', 2), nth) - 1)::INT AS chunk_index, header || chr(10) || piece AS content FROM m
""")
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents with headings and lists, packed small so that sections have several."""
    docs = headed_documents(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_name")
    return chunking.chunk_documents(docs, 300, 80).select("source_name", "section", "chunk_index", "content")


@query("SELECT doc_id, substr(regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '\\s+', ' ', 'g'), 1, 160) AS preview, replace(source || '.txt', '.txt', '') AS name, regexp_replace(lang || '/' || source, '^[^/]*/', '') AS short FROM documents")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.collapse(F.col("text"), 160).alias("preview"), text.without_suffix(F.concat("source", F.lit(".txt"))).alias("name"), text.short_name(F.concat_ws("/", "lang", "source")).alias("short"))


@query("""
WITH o AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, source || '!' AS source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
""")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("!")).alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return tables.upsert(docs.where("doc_id % 3 <> 0"), new, ["doc_id"])


@query("""
WITH o AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, source || '!' AS source, n_chars + 1 AS n_chars FROM documents WHERE doc_id % 2 = 0)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
""")
def upsert_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """upsert_chunks through a keyed table that is written, changed folder by folder and read again."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    new = docs.where("doc_id % 2 = 0").select("doc_id", F.concat("source", F.lit("!")).alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    path = f"{checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex}"
    tables.create_keyed(docs.where("doc_id % 3 <> 0"), path, ["doc_id"], 16)
    tables.change_keyed(new, path, ["doc_id"], lambda old, new: tables.upsert(old, new, ["doc_id"]))
    return tables.read_keyed(spark, path).select("doc_id", "source", "n_chars")


@query(f"""
{CHUNKS_SQL} SELECT source_name, chunk_index, row_number() OVER (ORDER BY source_name, chunk_index) AS id FROM chunks
""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's place among all, by source and index."""
    return chunking.with_ids(chunks(spark, sf_dir).select("source_name", "chunk_index"))


@query("""
WITH o AS (SELECT doc_id, source, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, source, upper(lang) AS lang FROM documents WHERE doc_id % 6 = 0 AND source < (SELECT max(source) FROM documents))
SELECT * FROM n UNION ALL SELECT * FROM o WHERE source IS NULL OR source NOT IN (SELECT source FROM n WHERE source IS NOT NULL)
""")
def replace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is dropped and rebuilt, then has all rows of those sources replaced that come anew, and is read with its checks."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "lang"])
    folder = f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"
    tables.write(docs, folder, "docs")
    tables.write(docs.where("doc_id % 3 <> 0"), folder, "docs")
    new = docs.where("doc_id % 6 = 0").join(docs.agg(F.max("source").alias("_last")), F.col("source") < F.col("_last")).select("doc_id", "source", F.upper("lang").alias("lang"))
    tables.write(tables.replace_sources(table(spark, folder, "docs", non_empty=True), new, "source"), folder, "changed")
    return table(spark, folder, "changed", non_empty=tables.is_built(spark, folder, "changed"))


@query(f"WITH {JUDGED_SQL} SELECT type, ok, count(*) AS n, {TAU}::DOUBLE AS threshold, {TOP}::BIGINT AS top_k FROM j GROUP BY type, ok")
def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers written as JSON lines beside their settings, read again and counted by what the file says."""
    rows = judged(spark, sf_dir).select("type", "ok")
    path = f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    tables.write_results(rows, path, {"threshold": TAU, "top_k": TOP})
    return tables.read_results(spark, path, rows.schema).groupBy("type", "ok", "settings.threshold", "settings.top_k").agg(F.count("*").alias("n"))


@query("""
SELECT vec_id AS id, coalesce(source, '') AS source, len(text) AS n_chars, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings JOIN documents ON doc_id = vec_id
""")
def paired_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents beside the vectors of their ids, after a check that each has its other."""
    v, d = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]), table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    d = d.join(v, F.col("doc_id") == F.col("vec_id"), "left_semi").select(F.col("doc_id").alias("id"), "source", F.coalesce("text", F.lit("")).alias("content"))
    v = v.join(d, F.col("vec_id") == F.col("id"), "left_semi").select(F.col("vec_id").alias("id"), "embedding")
    rows = tables.paired(d, v)
    return rows.select("id", F.coalesce("source", F.lit("")).alias("source"), F.length("content").cast("long").alias("n_chars"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber >= 2) SELECT * FROM o UNION SELECT * FROM n")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    pair = ["l_orderkey", "l_partkey"]
    return tables.insert_new(lines.where("l_linenumber <= 2").select(pair).distinct(), lines.where("l_linenumber >= 2").select(pair), pair)


@query("""
WITH c AS (SELECT doc_id, 1.0 + len(text) - len(replace(text, 'e', '')) AS e, 1.0 + len(text) - len(replace(text, 'a', '')) AS a, len(text)::DOUBLE AS n FROM documents)
SELECT doc_id, round((e / sqrt(e * e + a * a + n * n))::FLOAT::DOUBLE, 5) AS first, round((n / sqrt(e * e + a * a + n * n))::FLOAT::DOUBLE, 5) AS last FROM c
""")
def kept_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vectors that are kept at a path: half of the documents first, then all, which calls only for new texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
    letters = lambda some: [[1.0 + t.count("e"), 1.0 + t.count("a"), float(len(t))] for t in some]
    services.embed_kept(docs.where("doc_id % 2 = 0"), letters, path, text="text", steps=2)
    v = F.col("embedding").cast("array<double>")
    return services.embed_kept(docs, letters, path, text="text", steps=2).select("doc_id", F.round(F.get(v, F.lit(0)), 5).alias("first"), F.round(F.get(v, F.lit(2)), 5).alias("last"))


@query("SELECT count(*) AS n, count(*) > 0 AS built FROM documents")
def table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("built"))


# ---------------------------------------------------------------- graph

#: Parts as entities. Two neighbouring keys of one name make a name that two sources may share.
PARTS_SQL = "e AS (SELECT p_partkey, p_name || ' ' || (p_partkey // 2) AS p_name, p_brand, p_type AS kind, p_size FROM part)"
SIMILAR_SQL = f"""
{PARTS_SQL},
similar_edges AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM e a JOIN e b ON a.kind = b.kind AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand)
"""
MENTIONS_SQL = "mentions AS (SELECT DISTINCT l_partkey AS entity_key, l_orderkey AS chunk_id FROM lineitem)"


def similar_count() -> Column:
    """How many edges similar_classes() stands for: each is counted at both ends."""
    return F.expr("coalesce(sum(links) div 2, 0)")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities: key, name, kind, definition, source_name."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("key"), F.concat_ws(" ", "p_name", F.floor(F.col("p_partkey") / 2)).alias("name"), F.col("p_type").alias("kind"), F.repeat(F.lit("x"), F.col("p_size")).alias("definition"), F.col("p_brand").alias("source_name"))


def part_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_partkey", "l_orderkey"]).select(F.col("l_partkey").alias("entity_key"), F.col("l_orderkey").alias("chunk_id"))
    return dealt(lines, lines.count(), "entity_key", "chunk_id").distinct()


def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_classes(parts(spark, sf_dir), default=None)


@query("""
WITH e AS (SELECT p_partkey, p_brand, p_type FROM part)
SELECT a.p_partkey AS key, a.p_type AS kind, a.p_brand AS source_name, count(b.p_partkey) AS links FROM e a LEFT JOIN e b ON a.p_type = b.p_type AND a.p_brand <> b.p_brand GROUP BY ALL
""")
def similar_role_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's class (kind and source) and number of similar parts: all edges, without listing the pairs of a kind."""
    return part_classes(spark, sf_dir)


@query(f"WITH {MENTIONS_SQL} SELECT a.entity_key AS src, b.entity_key AS dst, 'đồng_xuất_hiện' AS relation, count(*)::FLOAT AS weight FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.entity_key < b.entity_key GROUP BY ALL")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.together_edges(part_mentions(spark, sf_dir))


@query(f"""
WITH {SIMILAR_SQL}, {MENTIONS_SQL}, t AS (SELECT a.entity_key AS src, b.entity_key AS dst FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.entity_key < b.entity_key GROUP BY ALL)
SELECT 'tương_tự' AS relation, count(*) AS n FROM similar_edges UNION ALL SELECT 'đồng_xuất_hiện', count(*) FROM t
""")
def graph_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    similar = part_classes(spark, sf_dir).agg(F.lit(graph.SIMILAR).alias("relation"), similar_count().alias("n"))
    together = graph.upsert_edges(graph.together_edges(part_mentions(spark, sf_dir)))
    return similar.where("n > 0").unionByName(graph.histogram(together, "relation"))


SEEDS_SQL = f"seeds AS (SELECT p_partkey AS qid, p_name AS name FROM e WHERE p_partkey % {EVERY} = 0)"
NEAR_SQL = f"""
{SIMILAR_SQL}, {SEEDS_SQL}, near AS (
  SELECT qid, d.p_name AS name, d.p_brand AS source_name, d.kind, s.p_name AS from_name FROM similar_edges g JOIN e s ON s.p_partkey = g.src JOIN e d ON d.p_partkey = g.dst JOIN seeds ON s.p_name = seeds.name
  UNION SELECT qid, s.p_name, s.p_brand, s.kind, d.p_name FROM similar_edges g JOIN e s ON s.p_partkey = g.src JOIN e d ON d.p_partkey = g.dst JOIN seeds ON d.p_name = seeds.name),
n AS (SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.qid = near.qid AND seeds.name = near.name))
"""


def part_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every part whose key is divisible by EVERY."""
    return parts(spark, sf_dir).where(F.col("key") % EVERY == 0).select(F.col("key").alias("qid"), "name")


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_members(parts(spark, sf_dir), default=None)


@query(f"WITH {NEAR_SQL} SELECT qid, name, source_name, kind, 'tương_tự' AS relation, 1.0::FLOAT AS weight, from_name FROM n")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_neighbors(part_members(spark, sf_dir), parts(spark, sf_dir), part_seeds(spark, sf_dir))


@query(f"""
WITH {PARTS_SQL}, {SEEDS_SQL}, {MENTIONS_SQL}, c AS (SELECT qid, chunk_id, count(*) AS n FROM (SELECT DISTINCT qid, name FROM seeds) s JOIN e ON p_name = name JOIN mentions ON entity_key = p_partkey GROUP BY ALL)
SELECT qid, chunk_id, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, chunk_id)::INT AS rank FROM c QUALIFY rank <= 3
""")
def chunks_mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunks_mentioning(part_mentions(spark, sf_dir), parts(spark, sf_dir), part_seeds(spark, sf_dir))


@query(f"""
WITH {HITS_SQL}, {PARTS_SQL}, {SEEDS_SQL}, {MENTIONS_SQL}, c AS (SELECT qid, chunk_id, count(*) AS n FROM (SELECT DISTINCT qid, name FROM seeds) s JOIN e ON p_name = name JOIN mentions ON entity_key = p_partkey GROUP BY ALL),
g AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY n DESC, chunk_id) AS position FROM c QUALIFY position <= 3), l AS (SELECT qid, max(rank) AS last FROM hits GROUP BY qid)
SELECT qid, id, similarity, 'vector' AS via, rank FROM hits UNION ALL SELECT g.qid, chunk_id, NULL, 'graph', coalesce(last, 0) + position FROM g LEFT JOIN l ON g.qid = l.qid
""")
def appended_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's vector hits, then the chunks that mention its part: of questions without the one or the other, what there is."""
    found = hits(spark, sf_dir).select("qid", "id", "similarity", F.lit("vector").alias("via"), F.col("rank").cast("long").alias("rank"))
    more = graph.chunks_mentioning(part_mentions(spark, sf_dir), parts(spark, sf_dir), part_seeds(spark, sf_dir))
    more = more.select("qid", F.col("chunk_id").alias("id"), F.lit(None).cast("double").alias("similarity"), F.lit("graph").alias("via"), F.col("rank").alias("position"))
    return context.appended(found, more)


@query(f"""
WITH {NEAR_SQL}, {MENTIONS_SQL}, hits AS (SELECT DISTINCT qid, chunk_id AS id FROM seeds JOIN e ON p_name = name JOIN mentions ON entity_key = p_partkey),
c AS (SELECT qid, chunk_id, count(*) AS n FROM (SELECT DISTINCT qid, name FROM n) s JOIN e ON p_name = name JOIN mentions ON entity_key = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, chunk_id) AS rank FROM c),
f AS (SELECT * FROM r WHERE rank <= 3 + (SELECT count(*) FROM hits WHERE hits.qid = r.qid) AND NOT EXISTS (SELECT 1 FROM hits WHERE hits.qid = r.qid AND id = chunk_id))
SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY rank)::INT AS position FROM f QUALIFY position <= 3
""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three chunks that mention a seed's neighbours, besides the question's hits: all chunks that mention the seed."""
    mentioned, entities = materialize(part_mentions(spark, sf_dir)), parts(spark, sf_dir)
    found = graph.chunks_mentioning(mentioned, entities, part_seeds(spark, sf_dir), None).select("qid", F.col("chunk_id").alias("id"))
    return graph.expand_similar(part_members(spark, sf_dir), entities, mentioned, part_seeds(spark, sf_dir), found, 3)


@query(f"""
WITH {NEAR_SQL}, g AS (SELECT qid, from_name, kind, array_to_string(list_sort(list(DISTINCT name || ' (' || source_name || ')'))[1:5], ', ') AS t FROM n GROUP BY ALL)
SELECT qid, string_agg(from_name || ' cùng vai trò "' || kind || '" với: ' || t, chr(10) ORDER BY from_name, kind) AS notes FROM g GROUP BY qid
""")
def relation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similar_notes(part_members(spark, sf_dir), parts(spark, sf_dir), part_seeds(spark, sf_dir)).select("qid", F.array_join("notes", "\n").alias("notes"))


@query(f"""
WITH {PARTS_SQL} SELECT p_brand AS source_name, count(*) AS n, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, array_to_string(list(p_name ORDER BY p_size DESC, p_name)[1:6], ',') AS samples FROM e GROUP BY p_brand
""")
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.communities(parts(spark, sf_dir)).withColumns({"kinds": F.array_join("kinds", ","), "samples": F.array_join("samples", ",")})


@query("""
SELECT s_suppkey AS id, s_name AS name, coalesce(array_to_string(list(n_name ORDER BY n_name) FILTER (WHERE n_name IS NOT NULL), ','), '') AS aliases
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3 GROUP BY ALL
""")
def load_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey")
    nations = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    aliases = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("id").alias("entity_id"), F.col("n_name").alias("alias"))
    return graph.load_lexicon(suppliers.select("id", "name"), aliases).select("id", "name", F.array_join("aliases", ",").alias("aliases"))


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as documents: a title, then for each type a section with a definition line for each part."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("- "), "p_name", F.lit(" (P"), F.col("p_partkey") + 1000, F.lit("): size "), "p_size")
    sections = p.groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("l"))
    head = F.concat(F.lit("## mục tiêu "), "p_type", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    body = sections.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_type", head.alias("s")))), lambda x: x["s"]), "\n\n").alias("b"))
    return body.select(F.concat("p_brand", F.lit(".txt")).alias("source_name"), F.concat(F.lit("# "), "p_brand", F.lit(" (Brand name)\n\n"), "b").alias("text"))


@query("""
WITH e AS (SELECT p_brand || '.txt' AS source_name, p_name AS name, 'mục tiêu trung lập' AS kind, 'size ' || p_size AS definition, 'mục tiêu ' || p_type AS section, 'P' || (p_partkey + 1000) AS alias, p_partkey, p_type FROM part),
f AS (SELECT source_name, lower(name) AS low, arg_min(struct_pack(n := name, d := definition, s := section), (p_type, p_partkey)) AS x, count(DISTINCT alias) AS n_aliases FROM e GROUP BY ALL)
SELECT source_name || '#' || low AS key, x.n AS name, 'mục tiêu trung lập' AS kind, x.d AS definition, source_name, x.s AS section, n_aliases::INT AS n_aliases FROM f
UNION ALL SELECT DISTINCT p_brand || '.txt#' || lower(p_brand), p_brand, 'chủ đề', '', p_brand || '.txt', p_brand || ' (Brand name)', 1 FROM part
""")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.unique_entities(graph.extract_mentions_of_definitions(part_documents(spark, sf_dir)))
    return rows.select("key", "name", "kind", "definition", "source_name", "section", F.size("aliases").alias("n_aliases"))


@query("SELECT p_brand || '.txt#' || lower(p_name) AS src, p_brand || '.txt#' || lower(p_brand) AS dst, 'thuộc_về' AS relation, 1.0::FLOAT AS weight FROM part")
def belongs_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge from a definition to its document, as found."""
    return graph.belongs_edges(graph.extract_mentions_of_definitions(part_documents(spark, sf_dir)))


@query("SELECT count(*) AS n, count(DISTINCT lower(p_name) || p_brand) AS sources, count(DISTINCT p_brand) AS targets FROM part")
def belongs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.belongs_edges(graph.extract_mentions_of_definitions(part_documents(spark, sf_dir)))
    return edges.agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


#: Names of which one contains the other, or overlap; matched against conversations.
NAMES = ("the on", "on the", "the", "and that", "that the", "of the and", "is it", "for the", "in the", "are of")


def _marked(sql: str) -> str:
    """sql's text with each of NAMES, longest first, put as _k_: what one takes no later one finds. Letters beyond ASCII are z."""
    marked = f"regexp_replace(lower({sql}), '[À-ÖØ-öø-ÿĀ-ɏ]', 'z', 'g')"
    for k, name in sorted(enumerate(NAMES), key=lambda x: -len(x[1])):
        marked = f"regexp_replace({marked}, '\\b{name}\\b', '_{k}_', 'g')"
    return marked


FOUND_SQL = f"""
m AS (SELECT conv_id, turn, regexp_extract_all({_marked('text')}, '_([0-9]+)_', 1) AS k FROM conversations),
u AS (SELECT conv_id, turn, unnest(k)::INT AS k, generate_subscripts(k, 1) AS pos FROM m),
found AS (SELECT conv_id, turn, {list(NAMES)}[k + 1] AS name, min(pos) AS pos FROM u GROUP BY ALL)
"""


def name_lexicon(spark: SparkSession) -> DataFrame:
    names = spark.range(len(NAMES)).select(F.get(F.array(*map(F.lit, NAMES)), F.col("id").cast("int")).alias("name"), F.col("id").alias("pos"))
    entities = names.select(graph.entity_key(F.lit("s"), F.col("name")).alias("key"), "name", F.lit("s").alias("source_name"), "pos", F.array().cast("array<string>").alias("aliases"))
    return graph.surfaces(entities)


@query(f"WITH {FOUND_SQL} SELECT conv_id * 1000 + turn AS id, string_agg(name, ',' ORDER BY pos) AS names FROM found GROUP BY conv_id, turn")
def match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names of a small lexicon in each conversation turn, longest first, in the order of their first match."""
    lexicon = name_lexicon(spark)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = graph.found_entities(graph.match_surfaces(turns, lexicon, "id", "text"), lexicon, "id")
    return found.select("id", F.array_join("names", ",").alias("names"))


def turns_with_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns (qid, conv_id, turn, answer) with their conversation's first one as the only passage."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"))
    return turns.join(first, "conv_id").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "conv_id", "turn", F.lit("").alias("question"), F.col("text").alias("answer"), F.array("first").alias("contents"))


@query(f"""
WITH {FOUND_SQL}, f AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id),
new AS (SELECT a.* FROM found a JOIN f ON f.conv_id = a.conv_id WHERE NOT EXISTS (SELECT 1 FROM found b WHERE b.conv_id = a.conv_id AND b.turn = f.turn AND b.name = a.name)),
l AS (SELECT conv_id, turn, string_agg(chr(39) || name || chr(39), ', ' ORDER BY pos) AS names FROM new GROUP BY ALL),
x AS (SELECT conv_id, turn, text AS answer, list_filter(list_distinct(regexp_extract_all(text, '\\[\\d+\\]')), lambda s: replace(replace(s, '[', ''), ']', '')::INT <> 1) AS bad FROM conversations),
r AS (SELECT conv_id, turn, list_reduce(list_prepend(answer, bad), lambda t, s: replace(t, s, '')) AS text FROM x)
SELECT conv_id * 1000 + turn AS qid, trim(regexp_replace(regexp_replace(text, ' {{2,}}', ' ', 'g'), '\\s+([.,;:!?])', '\\1', 'g'), ' ' || chr(10) || chr(9)) AS text,
  CASE WHEN names IS NULL THEN '' ELSE 'thực thể không có trong ngữ cảnh: [' || names || ']' END AS flag FROM r LEFT JOIN l USING (conv_id, turn)
""")
def verify_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify() on each turn as an answer from its conversation's first turn: the cleaned text, and the lexicon's names that this hasn't."""
    rows = verification.verify(turns_with_first(spark, sf_dir), name_lexicon(spark))
    return rows.select("qid", "text", F.array_join(F.filter("flags", lambda f: f.startswith("thực thể")), "|").alias("flag"))


#: Chunks of part_documents() and what they mention; a section is a document there.
GRAPH_SQL = f"""
d AS (SELECT p_brand, p_type, p_partkey, p_name, lower(p_name) AS low, '- ' || p_name || ' (P' || (p_partkey + 1000) || '): size ' || p_size AS line FROM part),
h AS (SELECT p_brand || '|' || p_type AS doc_id, p_brand, list(line ORDER BY p_partkey) AS units, list(low ORDER BY p_partkey) AS lows, p_brand || ' (Brand name) — mục tiêu ' || p_type AS header FROM d GROUP BY p_brand, p_type),
{PACK_SQL.format(target=1800, overlap=300)},
w AS (SELECT r.doc_id, p_brand, nth, lows[s + 1:b] AS lows FROM ranges r JOIN h USING (doc_id)),
entities AS (SELECT DISTINCT p_brand || '.txt#' || low AS key, low FROM d), brands AS (SELECT DISTINCT p_brand || '.txt#' || lower(p_brand) AS key, p_brand FROM d),
mentions AS (SELECT DISTINCT doc_id, nth, key FROM (SELECT doc_id, nth, unnest(lows) AS low FROM w) x JOIN entities USING (low) UNION SELECT doc_id, nth, key FROM w, brands),
together AS (SELECT a.key AS src, b.key AS dst, count(*) AS n FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND a.nth = b.nth AND a.key < b.key GROUP BY ALL)
"""


def part_graph(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the graph of all brands' documents and their chunks."""
    docs = part_documents(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_name")
    chunks_ = chunking.chunk_documents(docs).withColumn("id", F.concat_ws("#", "source_name", "chunk_index"))
    return graph.build_graph(docs, chunks_, [name])[name]


@query(f"""
WITH RECURSIVE {GRAPH_SQL},
per AS (SELECT p_brand, count(*) AS n, count(DISTINCT low) AS k FROM d GROUP BY p_brand)
SELECT (SELECT count(*) FROM entities) + (SELECT count(*) FROM brands) AS entities, (SELECT count(*) FROM d) + (SELECT count(*) FROM brands) AS aliases, (SELECT count(*) FROM mentions) AS mentions,
  ((SELECT count(*) FROM d) + (SELECT (sum(n) * sum(n) - sum(n * n)) // 2 FROM per) + (SELECT count(*) * (count(*) - 1) // 2 FROM brands) + (SELECT count(*) FROM together))::BIGINT AS edges,
  ((SELECT count(*) FROM entities) + (SELECT (sum(k) * sum(k) - sum(k * k)) // 2 FROM per) + (SELECT count(*) * (count(*) - 1) // 2 FROM brands) + (SELECT count(*) FROM together))::BIGINT AS stored_edges
""")
def build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a graph built from all brands' documents and their chunks."""
    return part_graph(spark, sf_dir, "counts")


@query(f"""
WITH RECURSIVE {GRAPH_SQL}, numbered AS (SELECT doc_id, nth, p_brand || '.txt#' || (row_number() OVER (PARTITION BY p_brand ORDER BY doc_id, nth) - 1) AS chunk_id FROM w)
SELECT key AS entity_key, chunk_id FROM mentions JOIN numbered USING (doc_id, nth)
""")
def graph_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the built graph's mentions."""
    return part_graph(spark, sf_dir, "mentions").select("entity_key", "chunk_id")


@query(f"""
WITH RECURSIVE {GRAPH_SQL} SELECT src, dst, 'đồng_xuất_hiện' AS relation, n::FLOAT AS weight FROM together
UNION ALL SELECT DISTINCT p_brand || '.txt#' || low, p_brand || '.txt#' || lower(p_brand), 'thuộc_về', 1.0::FLOAT FROM d
""")
def graph_edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge that the built graph lists: what belongs to a document, and what stands together, with its count of chunks."""
    return part_graph(spark, sf_dir, "edges").select("src", "dst", "relation", "weight")


@query("""
WITH d AS (SELECT DISTINCT p_brand, lower(p_name) AS low, 'mục tiêu trung lập' AS kind FROM part), b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand || '.txt#' || low AS key, kind AS role, p_brand || '.txt' AS source_name FROM d UNION ALL SELECT p_brand || '.txt#' || lower(p_brand), 'chủ đề', p_brand || '.txt' FROM b
""")
def graph_similar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the built graph's factorised edges: members of a role of different sources are linked."""
    return part_graph(spark, sf_dir, "similar").select("key", "role", "source_name").distinct()


@query(f"""
WITH {SIMILAR_SQL} SELECT (SELECT count(*) FROM documents) AS chunks, (SELECT count(DISTINCT source) FROM documents) AS sources, (SELECT count(*) FROM part) AS entities,
  (SELECT count(*) FROM similar_edges) AS edges, (SELECT count(*) > 0 FROM part) AS graph_built, {TAU}::DOUBLE AS threshold, {TOP}::INT AS top_k
""")
def health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"))
    return summary.health(docs, parts(spark, sf_dir), part_classes(spark, sf_dir), {"threshold": TAU, "top_k": TOP}, similar_count())


@query("""
WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) SELECT count(*) > 0 AS built, string_agg(p_brand || ':' || n, ',' ORDER BY n DESC, p_brand) AS communities FROM c
""")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("communities", lambda c: F.concat(c["source_name"], F.lit(":"), c["n"]))
    return summary.graph_summary(parts(spark, sf_dir)).select("built", F.array_join(listed, ",").alias("communities"))


def indexed_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ivf.Index]:
    """The questions (qid, embedding) and the index of all vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return rows.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "qid"), ivf.build(rows, ivf.fit(rows))


@query()
def vector_topk_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk through an index of cells; a test measures its recall against the exact result."""
    asked, index = indexed_vectors(spark, sf_dir)
    return search.ranked(ivf.search(asked, index, TOP + 1).where("id <> qid").drop("rank"), TOP)


@query(f"WITH {HITS_SQL} SELECT qid, id, similarity, rank FROM hits")
def vector_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_topk through the index with certain bounds: the same rows, cells left out that can't hold any of them."""
    asked, index = indexed_vectors(spark, sf_dir)
    found = ivf.search(asked, index, TOP + 4, sure=None).where("id <> qid")
    return search.ranked(found.select("qid", "id", F.round("similarity", 6).alias("similarity")), TOP).select("qid", "id", "similarity", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- routing, verification, history


def _any(sql: str, markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({sql}), '{m}')" for m in markers) + ")"


@query(f"""
SELECT conv_id, turn, length(lower(text)) < 30 OR {_any('text', routing.DEPENDENT_MARKERS)} OR {_any('text', ('this', 'that'))} AS needs_rewrite,
  {_any('text', routing.COMPARE_MARKERS)} OR {_any('text', ('both', 'or'))} AS needs_expansion, length(text) BETWEEN 1 AND 2000 AS valid FROM conversations
""")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rewrite = routing.needs_rewrite(t, (*routing.DEPENDENT_MARKERS, "this", "that"))
    expand = routing.needs_expansion(t, (*routing.COMPARE_MARKERS, "both", "or"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rewrite.alias("needs_rewrite"), expand.alias("needs_expansion"), routing.valid_request(F.lit("s"), t).alias("valid"))


@query("""
SELECT p_partkey, CASE WHEN contains(s, 'mục tiêu') THEN 'mục tiêu trung lập' WHEN contains(s, 'đấu trường') THEN 'bản đồ thi đấu' WHEN contains(s, 'vị trí') OR contains(s, 'bản đồ') THEN 'vị trí' ELSE 'khái niệm' END AS kind,
  CASE WHEN p_size % 2 = 0 THEN 'game' ELSE 'chủ đề' END AS document_kind
FROM (SELECT p_partkey, p_size, lower(['Mục tiêu lớn', 'Đấu trường và bản đồ', 'Bản đồ', 'Khác'][p_size % 4 + 1]) AS s FROM part)
""")
def kind_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = F.get(F.array(*map(F.lit, ("Mục tiêu lớn", "Đấu trường và bản đồ", "Bản đồ", "Khác"))), F.col("p_size") % 4)
    document = F.when(F.col("p_size") % 2 == 0, "x\n## Tổng quan\ny").otherwise("x")
    return table(spark, sf_dir, "part").select("p_partkey", routing.classify(titles).alias("kind"), routing.document_kind(document).alias("document_kind"))


@query("""
WITH m AS (SELECT DISTINCT p_type || '/' || p_name || CASE p_size % 3 WHEN 0 THEN '-preview' WHEN 1 THEN '-flash' ELSE '' END AS name FROM part),
s AS (SELECT regexp_replace(name, '^[^/]*/', '') AS name FROM m WHERE NOT contains(name, 'PROMO'))
SELECT name, row_number() OVER (ORDER BY contains(name, 'preview') OR contains(name, 'exp'), NOT contains(name, 'flash'), name)::INT AS place FROM s QUALIFY place <= 20
""")
def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("p_size") % 3 == 0, "-preview").when(F.col("p_size") % 3 == 1, "-flash").otherwise("")
    models = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), "p_name", tail).alias("name")).distinct()
    short = models.where(routing.usable_model(F.col("name"), ["PROMO"])).select(text.short_name(F.col("name")).alias("name"))
    return short.withColumn("place", F.row_number().over(Window.orderBy(*routing.model_order(F.col("name"))))).where("place <= 20")


@query("""
WITH r AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN chr(10) || ' "' || text || ' more" ' WHEN 1 THEN ' "" ' WHEN 2 THEN text || repeat('x', 200) ELSE text || repeat('x', 199) END AS given FROM conversations),
t AS (SELECT *, trim(trim(given, ' ' || chr(10) || chr(9)), '"') AS clean FROM r)
SELECT conv_id, turn, CASE WHEN length(clean) > 0 AND length(clean) < length(text) + 200 THEN clean ELSE text END AS question FROM t
""")
def accepted_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten questions, quoted, empty or too long, as they are taken over or not."""
    t, k = F.col("text"), F.col("turn") % 4
    longer = lambda n: F.concat(t, F.lit("x" * n))
    given = F.when(k == 0, F.concat(F.lit('\n "'), t, F.lit(' more" '))).when(k == 1, F.lit(' "" ')).when(k == 2, longer(200)).otherwise(longer(199))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", routing.accepted_rewrite(t, given).alias("question"))


@query("""
WITH r AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN '  đạt mọi ý' WHEN 1 THEN ' - ' || text || chr(10) || 'x' || chr(10) || '-- second' WHEN 2 THEN 'x - y' ELSE '' END AS given FROM conversations),
c AS (SELECT *, CASE WHEN turn % 4 = 1 THEN [trim(split_part(text, chr(10), 1)), 'second'] ELSE [] END AS claims FROM r)
SELECT conv_id, turn, array_to_string(claims, '|') AS claims, turn % 4 = 3 AS refused,
  CASE WHEN turn % 4 = 3 THEN 'Tôi không tìm thấy thông tin này.' ELSE text END || CASE WHEN len(claims) > 0 THEN chr(10) || chr(10) || '⚠ Chưa đối chiếu được với tài liệu:' || chr(10) || '  • ' || claims[1] || chr(10) || '  • second' ELSE '' END AS shown FROM c
""")
def entailment_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a verifier's responses list, answers with them, and which answers are refusals."""
    t, k = F.col("text"), F.col("turn") % 4
    given = F.when(k == 0, F.lit("  đạt mọi ý")).when(k == 1, F.concat(F.lit(" - "), t, F.lit("\nx\n-- second"))).when(k == 2, F.lit("x - y")).otherwise(F.lit(""))
    answer = F.when(k == 3, F.lit("Tôi không tìm thấy thông tin này.")).otherwise(t)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", grounding.entailment_claims(given).alias("c"), answer.alias("answer"))
    return rows.select("conv_id", "turn", F.array_join("c", "|").alias("claims"), context.is_refusal(F.col("answer")).alias("refused"), context.with_unsupported(F.col("answer"), F.col("c")).alias("shown"))


#: Conversation turns as answers: every third sentence end gets a citation, of which some don't exist.
ANSWERS_SQL = r"answers AS (SELECT conv_id * 1000 + turn AS id, replace(replace(text, '. ', ' [1]. '), ', ', ' [' || (turn + 3) || '] , ') || ' 1,50 [07]' AS answer FROM conversations)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(" [1]. ")), F.lit(", "), F.concat(F.lit(" ["), F.col("turn") + 3, F.lit("] , ")))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(t, F.lit(" 1,50 [07]")).alias("answer"))


@query(rf"""
WITH {ANSWERS_SQL}, x AS (SELECT id, answer, list_filter(list_distinct(regexp_extract_all(answer, '\[\d+\]')), lambda s: replace(replace(s, '[', ''), ']', '')::INT NOT BETWEEN 1 AND 4) AS bad FROM answers),
r AS (SELECT id, answer, list_reduce(list_prepend(answer, bad), lambda t, s: replace(t, s, '')) AS t FROM x)
SELECT id, trim(regexp_replace(regexp_replace(t, ' {{2,}}', ' ', 'g'), '\s+([.,;:!?])', '\1', 'g'), ' ' || chr(10) || chr(9)) AS text,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda n: n::INT), lambda n: n NOT BETWEEN 1 AND 4))), ','), '') AS invalid FROM r
""")
def strip_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, four = F.col("answer"), F.lit(4)
    bad = grounding.distinct_sorted(grounding.invalid_citations(a, four))
    return answers(spark, sf_dir).select("id", grounding.strip_citations(a, four).alias("text"), F.array_join(bad.cast("array<string>"), ",").alias("invalid"))


_UPPER = text.UPPER


@query(rf"""
WITH {ANSWERS_SQL}, s AS (SELECT id, list_filter(list_transform(string_split(regexp_replace(answer, '([.!?:])\s+([{_UPPER}0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS s FROM answers)
SELECT id, CASE WHEN len(s) = 0 THEN 0 ELSE round(len(list_filter(s, lambda x: regexp_matches(x, '\[\d+\]'))) / len(s)::DOUBLE, 9) END AS coverage FROM s
""")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("id", F.round(grounding.citation_coverage(F.col("answer")), 9).alias("coverage"))


@query(r"""
WITH n AS (SELECT doc_id, regexp_extract_all(text, '\d+(?:[.,]\d+)?') AS found FROM documents),
s AS (SELECT a.doc_id, a.found, coalesce(b.found, []) AS known FROM n a LEFT JOIN n b ON b.doc_id = a.doc_id + 1 WHERE len(a.found) > 0),
u AS (SELECT doc_id, unnest(found) AS raw, generate_subscripts(found, 1) AS pos, known FROM s),
m AS (SELECT doc_id, raw, pos, CASE WHEN regexp_matches(raw, '[.,]') THEN regexp_replace(regexp_replace(replace(raw, ',', '.'), '0+$', ''), '\.+$', '') ELSE raw END AS norm,
  list_transform(known, lambda k: CASE WHEN regexp_matches(k, '[.,]') THEN regexp_replace(regexp_replace(replace(k, ',', '.'), '0+$', ''), '\.+$', '') ELSE k END) AS known FROM u),
f AS (SELECT doc_id, norm, arg_min(raw, pos) AS raw, min(pos) AS pos, any_value(known) AS known FROM m GROUP BY doc_id, norm)
SELECT doc_id, string_agg(raw, ' ' ORDER BY pos) AS numbers FROM f WHERE norm NOT IN ('0', '1', '2') AND NOT list_contains(known, norm) GROUP BY doc_id
""")
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document that the next one, by id, hasn't."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    contexts = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("hay"))
    # what has a digit is joined to what has one: the rest has no number to compare
    pairs = docs.where(F.col("text").rlike("[0-9]")).join(contexts.where(F.col("hay").rlike("[0-9]")), "doc_id", "left")
    bare = F.regexp_replace("text", r"\[(\d+)\]", "")
    return pairs.select("doc_id", F.array_join(grounding.ungrounded_numbers(bare, F.coalesce("hay", F.lit(""))), " ").alias("numbers")).where("numbers <> ''")


#: A run of capitalised words, each with white space or the end behind it.
_RUN = rf"(?:[{_UPPER}][\p{{L}}\p{{N}}_]*(?:\s+|$)){{2,}}"


@query(rf"""
WITH t AS (SELECT conv_id, turn, array_to_string(list_transform(string_split(lower(text), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS text FROM conversations),
f AS (SELECT conv_id, lower(arg_min(text, turn)) AS hay FROM t GROUP BY conv_id),
r AS (SELECT conv_id, turn, hay, regexp_extract_all(text, '{_RUN}') AS runs, string_split_regex(text, '{_RUN}') AS between FROM t JOIN f USING (conv_id)),
u AS (SELECT conv_id, turn, hay, unnest(runs) AS run, generate_subscripts(runs, 1) AS k, runs, between FROM r),
a AS (SELECT conv_id, turn, hay, k, trim(run, ' ' || chr(10) || chr(9)) AS run, rtrim(array_to_string(list_transform(range(1, k + 1), lambda i: between[i] || CASE WHEN i < k THEN runs[i] ELSE '' END), ''), ' ' || chr(9)) AS ahead FROM u),
w AS (SELECT *, regexp_split_to_array(run, '\s+') AS words FROM a WHERE length(run) >= 6 AND NOT contains(hay, lower(run))),
c AS (SELECT conv_id, turn, hay, k, CASE WHEN regexp_matches(ahead, '^\s*$') OR contains(chr(10) || '.!?:-•', ahead[-1]) THEN words[2:] ELSE words END AS words FROM w),
p AS (SELECT conv_id, turn, hay, k, unnest(range(1, len(words))) AS i, words FROM c),
n AS (SELECT conv_id, turn, words[i] || ' ' || words[i + 1] AS pair, min((k, i)) AS pos FROM p WHERE NOT contains(hay, lower(words[i] || ' ' || words[i + 1])) GROUP BY ALL),
g AS (SELECT conv_id, turn, string_agg(pair, ',' ORDER BY pos) AS names FROM n GROUP BY ALL)
SELECT conv_id, turn, coalesce(names, '') AS names FROM t LEFT JOIN g USING (conv_id, turn)
""")
def ungrounded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised pairs of each turn, its words' first letters as capitals, that its conversation's first turn hasn't."""
    ship(spark)
    capitals = F.array_join(F.transform(F.split(F.lower("text"), " "), lambda x: F.when(x.startswith("ß"), x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 2**31 - 1)))), " ")
    turns = table(spark, sf_dir, "conversations").withColumn("text", capitals)
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("hay"))
    rows = turns.join(first, "conv_id").select("conv_id", "turn", grounding.ungrounded_names(F.col("text"), F.col("hay")).alias("n"))
    return rows.select("conv_id", "turn", F.array_join("n", ",").alias("names"))


@query("""
SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN 'trích dẫn không tồn tại: [7, 9]|' ELSE '' END) || (CASE WHEN event_id % 3 = 0 THEN 'số không có trong ngữ cảnh: [''180'']|' ELSE '' END) ||
  (CASE WHEN event_id % 5 = 0 THEN 'tên riêng không có trong ngữ cảnh: [''A B'', ''B C'']|' ELSE '' END) AS flags, event_id % 2 = 0 OR event_id % 3 = 0 AS escalate, event_id % 2 <> 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AS verified FROM events
""")
def verify_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")

    def some(condition: Column, *values: object) -> Column:
        full = F.array(*map(F.lit, values))
        return F.when(condition, full).otherwise(F.slice(full, 1, 0))

    rows = table(spark, sf_dir, "events").select("event_id", some(e % 2 == 0, 7, 9).alias("invalid_citations"), some(e % 3 == 0, "180").alias("ungrounded_numbers"), some(F.lit(False), "x").alias("ungrounded_entities"), some(e % 5 == 0, "A B", "B C").alias("ungrounded_names"), some(F.lit(False), "x").alias("unsupported"))
    rows = rows.withColumn("f", verification.flags())
    joined = F.array_join(F.transform("f", lambda f: F.concat(f, F.lit("|"))), "")
    return rows.select("event_id", joined.alias("flags"), verification.needs_entailment().alias("escalate"), verification.verified("f").alias("verified"))


TURNS_SQL = """
turns AS (SELECT conv_id::VARCHAR AS session, turn, text AS question, 'a' || turn AS answer, turn % 5 = 3 AS refused, role = 'system' AND turn > 0 AS reset FROM conversations),
r AS (SELECT session, max(turn) AS reset_at FROM turns WHERE reset GROUP BY session),
k AS (SELECT t.*, row_number() OVER (PARTITION BY t.session ORDER BY turn DESC) AS back FROM turns t LEFT JOIN r USING (session) WHERE NOT refused AND NOT reset AND (reset_at IS NULL OR turn > reset_at) QUALIFY back <= 2)
"""


@query(f"""
WITH {TURNS_SQL}, h AS (SELECT session, string_agg('Người dùng: ' || question || chr(10) || 'Trợ lý: ' || answer, chr(10) ORDER BY turn) AS history, 2 * count(*) AS n, arg_max(answer, turn) AS last FROM k GROUP BY session)
SELECT session, history, n::INT AS n_messages, last AS last_message FROM h
""")
def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").cast("string").alias("session"), "turn", F.col("text").alias("question"), F.concat(F.lit("a"), "turn").alias("answer"), (F.col("turn") % 5 == 3).alias("refused"), ((F.col("role") == "system") & (F.col("turn") > 0)).alias("reset"))
    rows = history.remembered(turns, 2)
    last = F.element_at(history.last_messages(F.col("history")), -1)["text"]
    return rows.select("session", history.transcript(F.col("history")).alias("history"), F.size("history").alias("n_messages"), last.alias("last_message"))


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS following FROM conversations QUALIFY following IS NOT NULL")
def neighbouring_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.neighbouring_pairs(table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"]), "conv_id", "turn", "role")


# ---------------------------------------------------------------- the whole way from questions to answers

#: Vectors read backwards are questions to all; chunks are the documents with the vectors' ids.
ANSWER_TAU, REFUSES, CLAIM = 0.37, "Tôi không tìm thấy thông tin này ở đoạn nào", "7777777 dòng"


def stand_in(prompt: str) -> str:
    """A generator without a model: a rewritten question, or one of five answers by the question's number."""
    n = int(re.search(r"\d+", prompt.rsplit(context.QUESTION_TITLE, 1)[1])[0])
    if prompt.startswith(context.REWRITE_PROMPT[:8]):
        return f' "đoạn {n} nằm ở đâu trong kho tài liệu?" '
    first = re.search(r"\)\nđoạn (\d+)", prompt)[1]
    return (f"{REFUSES} [9].", "  ", f"đoạn {first} nói điều đó [1].", f"có {CLAIM} [1] [9].", f"chừng {CLAIM} [1].")[n // EVERY % 5]


def stand_in_verifier(prompt: str) -> str:
    return f"- {CLAIM}" if prompt.endswith(f"có {CLAIM} [1].") else "Đạt"


@query(f"""
WITH q AS (SELECT vec_id AS qid, list_reverse(embedding::DOUBLE[]) AS qv FROM embeddings WHERE vec_id % {EVERY} = 0),
s AS (SELECT qid, vec_id AS id, coalesce(source, 'không rõ') || ' · nhãn ' || label AS label, list_cosine_similarity(qv, embedding::DOUBLE[]) AS similarity FROM q, embeddings LEFT JOIN documents ON doc_id = vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 4),
w AS (SELECT qid, max(similarity) AS top, arg_min(id, rank) AS first, min(rank) FILTER (WHERE rank > 1 AND similarity < {ANSWER_TAU}) AS stop FROM h GROUP BY qid),
l AS (SELECT qid, label, min(rank) AS rank FROM h JOIN w USING (qid) WHERE stop IS NULL OR rank < stop GROUP BY qid, label),
c AS (SELECT qid, string_agg(label, '|' ORDER BY rank) AS labels FROM l GROUP BY qid),
a AS (SELECT *, CASE WHEN top < {ANSWER_TAU} THEN 5 ELSE qid // {EVERY} % 5 END AS k FROM w JOIN c USING (qid))
SELECT qid, CASE WHEN qid % 100 = 0 THEN 'nó ' || qid || ' ở đâu?' ELSE 'đoạn ' || qid || ' nằm ở đâu trong kho tài liệu?' END AS search_query,
  CASE k WHEN 0 THEN '{REFUSES}.' WHEN 2 THEN 'đoạn ' || first || ' nói điều đó [1].' WHEN 3 THEN 'có {CLAIM} [1].' || chr(10) || chr(10) || '⚠ Chưa đối chiếu được với tài liệu:' || chr(10) || '  • {CLAIM}'
    WHEN 4 THEN 'chừng {CLAIM} [1].' ELSE 'Tôi không tìm thấy thông tin này trong tài liệu hiện có.' END AS text,
  CASE WHEN k IN (2, 3, 4) THEN labels ELSE '' END AS citations, k NOT IN (2, 3, 4) AS refused, round(top, 6) AS top_similarity,
  CASE k WHEN 3 THEN 'trích dẫn không tồn tại: [9]|' ELSE '' END || CASE WHEN k IN (3, 4) THEN 'số không có trong ngữ cảnh: [''7777777'']' ELSE '' END AS flags,
  CASE k WHEN 3 THEN '{CLAIM}' ELSE '' END AS unsupported, k IN (3, 4) AS entailment_ran, CASE WHEN k IN (0, 3) THEN '9' ELSE '' END AS invalid_citations, CASE k WHEN 5 THEN '' ELSE 'stand-in' END AS model_used, k NOT IN (3, 4) AS verified FROM a
""")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all kinds: refused by the gate, in the generator's own words or for want of them, clean, doubtful and refuted."""
    vectors_ = table(spark, sf_dir, "embeddings")
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("đoạn nào?").alias("text")))
    questions = vectors_.where(F.col("vec_id") % EVERY == 0).select(
        F.col("vec_id").alias("qid"), F.format_string("nó %d ở đâu?", "vec_id").alias("question"), F.when(F.col("vec_id") % 100 == 0, F.slice(said, 1, 0)).otherwise(said).alias("history"), F.reverse("embedding").alias("embedding")
    )
    docs = table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    content = F.concat(F.lit("đoạn "), "vec_id", F.lit(": "), F.coalesce("text", F.lit("")))
    chunks_ = vectors_.join(docs, F.col("doc_id") == F.col("vec_id"), "left")
    chunks_ = chunks_.select(F.col("vec_id").alias("id"), F.coalesce("source", F.lit("không rõ")).alias("source_name"), F.concat(F.lit("nhãn "), "label").alias("section"), content.alias("content"), "embedding")
    models = [("stand-in", stand_in)]
    rows = ask.answered(materialize(ask.rewritten(questions, models)), chunks_, models, threshold=ANSWER_TAU, verifier=[("verifier", stand_in_verifier)])
    listed = {c: F.array_join(c, "|") for c in ("citations", "flags", "unsupported", "invalid_citations")}
    return rows.withColumns(listed | {"top_similarity": F.round("top_similarity", 6)}).drop("graph_expanded")
