"""State of conversations on Structured Streaming: a window of the last messages and a pinned data set.

State is kept for each conversation in the checkpoint: it is bounded by the window whatever the length of the conversation, and a
restart goes on from it. Messages of one batch are taken in order of their turn, role and text; batches are taken to come in order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Messages that are remembered unless asked otherwise, the most that are, and the turns a choice lasts: fixed values.
WINDOW, MOST, PIN_TURNS = 10, 20, 3
STATE = T.StructType([T.StructField("said", T.StringType()), T.StructField("pin", T.StringType()), T.StructField("left", T.IntegerType())])


class Memory:
    """The last ``most`` messages, evicted by count, and a data set that answers the ``turns`` messages after its choice."""

    def __init__(self, said: list[str] | None = None, pin: str | None = None, left: int = 0, most: int = MOST, turns: int = PIN_TURNS):
        self.said, self.pin, self.left, self.most, self.turns = list(said or []), pin, left, most, turns

    def context(self, asked: int) -> list[str]:
        n = max(0, min(asked, self.most))
        return self.said[max(0, len(self.said) - n) :]

    def current(self) -> str | None:
        """The pinned data set for this message; each one counts down, and with the last the pin is gone."""
        if self.left <= 0:
            self.pin = None
            return None
        self.left -= 1
        return self.pin

    def take(self, message: str, choice: str | None) -> None:
        self.said = (self.said + [message])[-self.most :]
        if choice is not None:
            self.pin, self.left = choice, self.turns


def remembering(stream: DataFrame, key: str, order: list[str], message: str, asked: str, choice: str, most: int = MOST, turns: int = PIN_TURNS) -> DataFrame:
    """The rows of ``stream`` with ``context``, the messages before each (as many as ``asked``, ``most`` at most, one to a line), and ``pinned``, the data
    set chosen in one of the ``turns`` messages before. ``choice`` is the data set a message chooses or null.

    Defined results: null messages are remembered as empty ones; a null ``asked`` is the usual window; rows with a null key share one
    conversation."""
    out = T.StructType([*stream.schema.fields, T.StructField("context", T.StringType()), T.StructField("pinned", T.StringType())])

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        said, pin, left = state.get if state.exists else ("[]", None, 0)
        memory = Memory(json.loads(said), pin, left, most, turns)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable", na_position="first")
        contexts, pins = [], []
        for text, n, chosen in zip(rows[message], rows[asked], rows[choice], strict=True):
            contexts.append("\n".join(memory.context(WINDOW if pd.isna(n) else int(n))))
            pins.append(memory.current())
            memory.take("" if text is None else text, None if chosen is None or pd.isna(chosen) else chosen)
        state.update((json.dumps(memory.said), memory.pin, memory.left))
        yield rows.assign(context=contexts, pinned=pins)[out.names]

    return stream.groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


#: Seconds an answer is kept and how many of one user's are: fixed values.
KEPT_SECONDS, KEPT_ANSWERS = 300, 1000


def answering(stream: DataFrame, owner: str, question: str, at: str, tie: str, seconds: int = KEPT_SECONDS, most: int = KEPT_ANSWERS) -> DataFrame:
    """The rows of ``stream`` with ``hit``: whether an answer to ``question`` that the owner got within ``seconds`` before (``at`` in microseconds) is still kept. A
    question without one is answered and its answer kept from then on; beyond ``most`` the one kept longest goes. Rows of a batch are taken in
    order of ``at`` and ``tie``."""
    out = T.StructType([*stream.schema.fields, T.StructField("hit", T.BooleanType())])

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str, int] = dict(json.loads(state.get[0])) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([at, tie], kind="stable")
        hits = []
        for asked, now in zip(rows[question].astype(str), rows[at].astype("int64"), strict=True):
            now = int(now)
            hits.append(asked in kept and now - kept[asked] <= seconds * 1_000_000)
            if not hits[-1]:
                kept.pop(asked, None)
                kept[asked] = now
                if len(kept) > most:
                    del kept[next(iter(kept))]
        state.update((json.dumps(list(kept.items())),))
        yield rows.assign(hit=hits)[out.names]

    return stream.groupBy(owner).applyInPandasWithState(step, out, T.StructType([T.StructField("kept", T.StringType())]), "append", GroupStateTimeout.NoTimeout)


def in_runs(spark, df: DataFrame, order: str, path: str, runs: int, run: Callable[[], None]) -> None:
    """Hands ``df`` out as files in the order of ``order``, a part for each run: what a run leaves in its checkpoint is all that the next one has."""
    bounds = df.approxQuantile(order, [i / runs for i in range(1, runs)], 0.0)
    low = None
    for high in [*bounds, None]:
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.write.mode("append").parquet(path)
        run()
        low = high
