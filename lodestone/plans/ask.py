"""Answering a table of questions: gate, retrieval, graph expansion, generation, verification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.grounding import distinct_sorted, entailment_claims
from lodestone.functions.routing import accepted_rewrite, needs_expansion, needs_rewrite
from lodestone.operators import context as C
from lodestone.operators.graph import Surfaces, expand_similar, found_entities, match_surfaces, similar_notes, surfaces
from lodestone.operators.history import last_messages, transcript
from lodestone.operators.search import gate, hits_for_ids, top_k
from lodestone.operators.verification import needs_entailment, verified, verify
from lodestone.session import materialize
from lodestone.sources.services import QUESTIONS, embed, generate

Model = tuple[str, Callable[[str], str]]
TOP_K, THRESHOLD, EXTRA_CHUNKS = 4, 0.60, 3


def rewritten(questions: DataFrame, models: Sequence[Model]) -> DataFrame:
    """questions (qid, question, history) with search_query; only those that may depend on their history cost a call."""
    asks = (F.size("history") > 0) & needs_rewrite(F.col("question"))
    prompt = F.format_string(C.REWRITE_PROMPT, transcript(last_messages(F.col("history"))), F.col("question"))
    done = materialize(generate(questions.where(asks).withColumn("prompt", prompt), models))
    done = done.withColumn("search_query", accepted_rewrite(F.col("question"), F.col("response"))).select(*questions.columns, "search_query")
    return done.unionByName(questions.where(F.coalesce(~asks, F.lit(True))).withColumn("search_query", F.col("question")))


def retrieve(questions: DataFrame, chunks: DataFrame, graph: dict[str, DataFrame] | None = None, k: int = TOP_K, threshold: float = THRESHOLD, extra: int = EXTRA_CHUNKS, ready: Surfaces | None = None) -> DataFrame:
    """Per question (qid, question, search_query, embedding): top_similarity, refused, hits and notes.

    The gate looks at vector hits only and comes first: refused questions are neither expanded nor answered. Accepted ones
    that compare get up to extra chunks over the graph's similarity edges, from names in the question.
    """
    found = top_k(questions, chunks, k).join(chunks.select("id", "source_name", "section", "content"), "id").withColumn("via", F.lit("vector"))
    found = found.select("qid", "id", "source_name", "section", "content", "similarity", "via", "rank")
    gated = questions.join(gate(questions, found, threshold), "qid")
    hits, notes = found, None
    if graph is not None:
        lexicon = surfaces(graph["entities"])
        open_ = gated.where(~F.col("refused") & needs_expansion(F.col("search_query")))
        matches = match_surfaces(open_, ready or lexicon, "qid", "search_query")
        seeds = found_entities(matches, lexicon, "qid").select("qid", F.explode("names").alias("name"))
        seeds = materialize(seeds)
        more = expand_similar(graph["similar"], graph["entities"], graph["mentions"], seeds, found, extra).withColumnRenamed("chunk_id", "id")
        more = hits_for_ids(more, questions, chunks).join(chunks.select("id", "source_name", "section", "content"), "id")
        hits, notes = C.appended(found, more), similar_notes(graph["similar"], graph["entities"], seeds)
    gated = gated.join(C.gathered(hits), "qid", "left")
    return gated.withColumn("notes", F.array().cast("array<string>")) if notes is None else gated.join(notes, "qid", "left")


def ask(questions: DataFrame, chunks: DataFrame, embedder: Callable[[list[str], str], list[Sequence[float]]], models: Sequence[Model], graph: dict[str, DataFrame] | None = None, threshold: float = THRESHOLD, entailment: str = "auto", verifier: Sequence[Model] | None = None) -> DataFrame:
    """answered() for questions (qid, question, history): rewritten where they need it, and embedded.

    The embedder is given texts and the task QUESTIONS.
    """
    asked = materialize(embed(rewritten(questions, models), embedder, "search_query", task=QUESTIONS))
    return answered(asked, chunks, models, graph, threshold, entailment, verifier)


def answered(asked: DataFrame, chunks: DataFrame, models: Sequence[Model], graph: dict[str, DataFrame] | None = None, threshold: float = THRESHOLD, entailment: str = "auto", verifier: Sequence[Model] | None = None) -> DataFrame:
    """An answer for each question (qid, question, search_query, embedding): text, citations, refused, flags and how it came about.

    Refusals, by the gate or in the model's own words, have no citations and no flags. Only answers that fail a cheap check
    are sent to the verifier in mode auto; what it finds unsupported is said under the answer. What calls have returned is
    written to the shared folder before it is used, so that no call is made twice for a plan that reads it twice.
    """
    none = F.array().cast("array<string>")
    lexicon = None if graph is None else materialize(surfaces(graph["entities"]))
    matcher = None if lexicon is None else Surfaces(lexicon)
    ready = materialize(retrieve(asked, chunks, graph, threshold=threshold, ready=matcher))
    prompt = C.user_message(F.col("question"), F.col("hits"), F.coalesce("notes", none))
    made = materialize(generate(ready.where("not refused").withColumn("prompt", prompt), models))
    made = made.withColumn("answer", F.when(F.trim("response") == "", C.REFUSAL_MESSAGE).otherwise(F.trim("response")))
    checked = verify(made.withColumn("contents", F.transform("hits", lambda h: h["content"])), lexicon, matcher)
    checked = materialize(checked.withColumn("self_refused", C.is_refusal(F.col("text"))))
    runs = ~F.col("self_refused") & needs_entailment(entailment)
    todo = checked.where(runs).withColumn("prompt", F.format_string(C.ENTAILMENT_PROMPT, C.context_block(F.col("hits")), F.col("text")))
    judged = materialize(generate(todo.drop("response", "model_used", "llm_ms"), verifier or models).select("qid", entailment_claims(F.col("response")).alias("unsupported")))
    checked = checked.join(judged.withColumn("entailment_ran", F.lit(True)), "qid", "left")
    own = F.col("self_refused")
    answered = checked.select(
        "qid",
        F.when(own, F.col("text")).otherwise(C.with_unsupported(F.col("text"), F.coalesce("unsupported", none))).alias("text"),
        F.when(own, none).otherwise(C.citations(F.col("hits"), threshold)).alias("citations"),
        own.alias("refused"),
        "top_similarity",
        F.when(own, none).otherwise(F.col("flags")).alias("flags"),
        F.coalesce("unsupported", none).alias("unsupported"),
        F.coalesce("entailment_ran", F.lit(False)).alias("entailment_ran"),
        F.size(F.filter("hits", lambda h: h["via"] == "graph")).alias("graph_expanded"),
        "search_query",
        "model_used",
        distinct_sorted(F.col("invalid_citations")).alias("invalid_citations"),
    )
    refused = ready.where("refused").select(
        "qid", F.lit(C.REFUSAL_MESSAGE).alias("text"), none.alias("citations"), F.lit(True).alias("refused"), "top_similarity", none.alias("flags"), none.alias("unsupported"),
        F.lit(False).alias("entailment_ran"), F.lit(0).alias("graph_expanded"), "search_query", F.lit("").alias("model_used"), F.array().cast("array<int>").alias("invalid_citations"),
    )
    return answered.unionByName(refused).withColumn("verified", verified())
