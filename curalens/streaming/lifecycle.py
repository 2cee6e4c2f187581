"""Run registries and sessions as reductions over event logs, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def reservations(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """The first event of each run wins; later attempts to reserve it are absent."""
    others = [c for c in events.columns if c != run]
    first = events.groupBy(run).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))  # combined map side
    return first.select(run, "_row.*").select(*events.columns)


def run_state(events: DataFrame, run: str, order: str, kind: str, terminal: str, interrupted: str) -> DataFrame:
    """State of each run: its last event up to the first terminal one, and how often it was interrupted until then.
    A terminal record is final: events after it don't count."""
    end = events.where(F.col(kind) == terminal).groupBy(run).agg(F.min(order).alias("_end"))
    live = events.join(end, run, "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end")))
    return live.groupBy(run).agg(
        F.max_by(kind, F.struct(order, F.col(kind))).alias("state"), F.count_if(F.col(kind) == interrupted).alias("interruptions"), F.count("*").alias("events")
    )


def heartbeat_gaps(events: DataFrame, run: str, ts: str, most_seconds: int) -> DataFrame:
    """Heartbeats that follow the one before by more than `most_seconds`."""
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    last = F.lag(at).over(Window.partitionBy(run).orderBy(ts))
    return events.withColumn("gap", at - last).where(F.col("gap") > most_seconds)


def resume_point(expected: DataFrame, saved: DataFrame) -> DataFrame:
    """expected(ordinal, id), saved(ordinal, id): saved rows must be the first k expected ones, in order.
    (done, valid): how many are saved, and whether they are that prefix."""
    joined = saved.select("ordinal", F.col("id").alias("saved_id")).join(expected, "ordinal", "left")
    good = F.bool_and(F.col("saved_id").eqNullSafe(F.col("id"))) & (F.count("*") == F.max("ordinal") + 1)
    return joined.agg(F.count("*").alias("done"), F.coalesce(good, F.lit(True)).alias("valid"))


def turn_states(turns: DataFrame, session: str, turn: str, state: str) -> DataFrame:
    """Each turn with the state before it, null at a session's start."""
    return turns.withColumn("state_before", F.lag(state).over(Window.partitionBy(session).orderBy(turn))).withColumnRenamed(state, "state_after")


class TurnStates(StatefulProcessor):
    """turn_states on a stream: the last turn and state of each session are kept as value state, for `expiry_ms` after the last turn. A
    turn that isn't after the last one is late: it comes out with a null state before it and changes nothing."""

    def __init__(self, expiry_ms: int | None = None) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "turn long, state string", self.expiry_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seen, state = self.last.get() if self.last.exists() else (None, None)
        batch = pd.concat(list(rows)).sort_values("turn", ignore_index=True)
        before = []
        for turn, now in zip(batch["turn"], batch["state"], strict=True):
            if seen is not None and turn <= seen:
                before.append(None)
                continue
            before.append(state)
            seen, state = int(turn), now
        batch["state_before"] = before
        self.last.update((seen, state))
        yield batch[["session", "turn", "state_before", "state"]]

    def close(self) -> None:
        pass


def stream_turn_states(turns: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """turns(session, turn, state) as a stream -> (session, turn, state_before, state)."""
    mode = "processingTime" if expiry_ms else "none"
    return turns.groupBy("session").transformWithStateInPandas(TurnStates(expiry_ms), "session long, turn long, state_before string, state string", "append", mode)
