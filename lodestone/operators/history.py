"""Conversation history: what a session still remembers, and its last messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Turns that are remembered (a question and an answer each), and messages that a rewrite sees.
MAX_TURNS, REWRITE_MESSAGES = 6, 4
USER, MODEL = "Người dùng", "Trợ lý"


def recent(messages: DataFrame, session: str = "session", order: str = "turn", most: int = 2 * MAX_TURNS) -> DataFrame:
    """The last messages of each session. A rank limits each partition before it is shuffled."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def remembered(turns: DataFrame, most_turns: int = MAX_TURNS) -> DataFrame:
    """session, history: the last answered turns (session, turn, question, answer, refused, reset) as messages in order.

    Refused turns are not remembered, nor any before a session's last reset, nor the reset itself.
    """
    reset = turns.where("reset").groupBy("session").agg(F.max("turn").alias("_reset"))
    kept = turns.join(reset, "session", "left").where("not refused and not reset and (_reset is null or turn > _reset)")
    kept = recent(kept, most=most_turns)
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("model").alias("role"), F.col("answer").alias("text")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", pair.alias("pair"))))
    return kept.groupBy("session").agg(F.flatten(F.transform(ordered, lambda x: x["pair"])).alias("history"))


def last_messages(history: Column, n: int = REWRITE_MESSAGES) -> Column:
    """The last n elements of an array, or all."""
    return F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), F.lit(n))


def transcript(history: Column) -> Column:
    """A conversation as lines, each with who says it."""
    speaker = lambda m: F.when(m["role"] == "user", USER).otherwise(MODEL)
    return F.array_join(F.transform(history, lambda m: F.concat(speaker(m), F.lit(": "), m["text"])), "\n")


def neighbouring_pairs(rows: DataFrame, partition: str, order: str, value: str) -> DataFrame:
    """partition, order, value and the value that follows it."""
    follows = F.lead(value).over(Window.partitionBy(partition).orderBy(order))
    return rows.select(partition, order, value, follows.alias("following")).where("following is not null")
