"""Conversation history as a stream: each session's state is its last answered turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.operators.history import MAX_TURNS
from lodestone.session import ship

OUT = "session string, turn long, history array<struct<role:string,text:string>>"
STATE = "turns array<struct<turn:long,question:string,answer:string>>, reset long"


def remember(turns: DataFrame, most_turns: int = MAX_TURNS, idle_ms: int | None = None) -> DataFrame:
    """For each session of a micro-batch of turns (session, turn, question, answer, refused, reset): its history afterwards.

    Turns count by their number, not by when they come: a late one takes its place, one that comes again changes nothing, and
    a reset empties what is numbered up to it. So any order and repetition of micro-batches leads to what remembered()
    gives for all turns at once. Refused turns are not remembered. A session's state is bounded by most_turns. With idle_ms it
    leaves the store once so many milliseconds have passed without a turn of it; that needs a query that keeps running,
    since Spark doesn't end one with such a time-out when its input is used up. A row with the batch's last turn of the session and its history
    is put out for every batch that has turns of it.
    """
    ship(turns.sparkSession)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, reset = ({t[0]: tuple(t) for t in state.get[0]}, state.get[1]) if state.exists else ({}, None)
        rows = pd.concat(batches)
        for row in rows.itertuples():
            if row.reset:
                reset = int(row.turn) if reset is None else max(reset, int(row.turn))
            elif not row.refused:
                kept.setdefault(int(row.turn), (int(row.turn), row.question, row.answer))
        last = sorted(t for n, t in kept.items() if reset is None or n > reset)[-most_turns:]
        state.update((last, reset))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        messages = [{"role": role, "text": text} for _, q, a in last for role, text in (("user", q), ("model", a))]
        yield pd.DataFrame({"session": [key[0]], "turn": [int(rows["turn"].max())], "history": [messages]})

    return turns.groupBy("session").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
