"""Task conversations: a state machine over the turns of each session, as a stream and in batch.

Everything that depends on one turn alone (what the request asks for, what it names, whether the proposed call may serve it)
is worked out in columns before the fold. The fold itself only moves between states and changes the session's tasks, and
says what to reply by a code; the reply's text is a column again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import replies, requests
from ..functions.deadlines import local_day_start, parse_deadline
from ..sources.tables import exists

#: The state that each kind of an incomplete request leads to.
WAITS = {
    "missing_create": "awaiting_create_content", "missing_complete": "awaiting_complete_id", "multiple_complete": "awaiting_complete_id",
    "missing_edit_id": "awaiting_edit_id", "multiple_edit": "awaiting_edit_id", "missing_edit_content": "awaiting_edit_content",
    "missing_delete_id": "awaiting_delete_id", "multiple_delete": "awaiting_delete_id", "missing_deadline_id": "awaiting_deadline_id",
    "multiple_deadline": "awaiting_deadline_id", "missing_deadline_time": "awaiting_deadline_text", "missing_deadline_scope": "awaiting_deadline_scope",
}
#: The same for a proposed call that needs clarification, by tool and reason.
CLARIFIES = {
    ("list_tasks_by_deadline", "missing_deadline_scope"): "awaiting_deadline_scope", ("set_task_deadline", "missing_deadline_id"): "awaiting_deadline_id",
    ("set_task_deadline", "multiple_task_ids"): "awaiting_deadline_id", ("set_task_deadline", "missing_deadline_time"): "awaiting_deadline_text",
    ("set_task_deadline", "invalid_deadline_time"): "awaiting_deadline_text", ("complete_task", "missing_task_id"): "awaiting_complete_id",
    ("complete_task", "multiple_task_ids"): "awaiting_complete_id", ("update_task", "missing_update_id"): "awaiting_edit_id",
    ("update_task", "missing_update_content"): "awaiting_edit_content", ("delete_task", "missing_delete_id"): "awaiting_delete_id",
    ("create_task", "missing_content"): "awaiting_create_content",
}
#: Proposed calls that are asked back about without a state to wait in.
ASKED_BACK = {("update_task", "multiple_task_ids"): "awaiting_edit_id", ("delete_task", "multiple_task_ids"): "awaiting_delete_id"}
#: Words that are a whole turn, with or without a final mark.
CANCEL, YES, NO = ("thôi", "hủy", "huỷ"), ("có", "đồng ý", "xác nhận", "xóa", "xoá"), ("không", "thôi", "hủy", "huỷ")

TASK = "struct<id:long,content:string,completed:boolean,due_at:long>"
OUTCOME = f"session long, turn long, state_before string, state_after string, status string, source string, say string, tool string, result string, named long, scope string, task {TASK}, shown array<{TASK}>, tasks array<{TASK}>, error_stage string"
NAMES = [c.split()[0] for c in OUTCOME.replace(TASK, "x").split(", ")]


@dataclass
class State:
    """A session between two turns. A field that its state has no use for is empty; the deadline is kept as the moment that it
    meant when it was said. ends: when a stream by event time forgets the session, in milliseconds."""

    name: str = "idle"
    task_id: int | None = None
    content: str | None = None
    when: str | None = None
    due_at: int | None = None
    snapshot: dict | None = None
    tasks: dict[int, dict] = field(default_factory=dict)
    next_id: int = 1
    turn: int | None = None
    ends: int | None = None

    def go(self, name: str, **kept: object) -> None:
        """Enter a state: what the last one kept is dropped, and only what is named here is kept."""
        self.name, self.task_id, self.content, self.when, self.due_at, self.snapshot = name, None, None, None, None, None
        for k, v in kept.items():
            setattr(self, k, v)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> State:
        held = State(**json.loads(text))
        held.tasks = {int(k): v for k, v in held.tasks.items()}
        return held


class Failed(Exception):
    """A change that failed before it was committed, or whose reply failed after."""


def change(state: State, e: dict, tool: str, *, task_id: int | None = None, content: str | None = None, due_at: int | None = None, scope: str | None = None) -> dict:
    """Apply one allowed call to the session's tasks. A fault `before` leaves them as they were."""
    if e["fault"] == "before":
        raise Failed("commit")
    tasks, old = state.tasks, state.tasks.get(task_id)
    if tool == "create_task":
        lines = [x for x in content.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()]
        new = [{"id": state.next_id + k, "content": x, "completed": False, "due_at": None} for k, x in enumerate(lines)]
        state.next_id += len(new)
        tasks.update({t["id"]: t for t in new})
        return {"result": "created", "shown": new}
    if tool == "list_tasks":
        return {"result": "listed", "shown": [tasks[k] for k in sorted(tasks)]}
    if tool == "list_tasks_by_deadline":
        low, to = {"today": (e["day0"], e["day1"]), "tomorrow": (e["day1"], e["day2"]), "overdue": (float("-inf"), e["now"])}[scope]
        found = [t for t in tasks.values() if not t["completed"] and t["due_at"] is not None and low <= t["due_at"] < to]
        return {"result": "listed", "scope": scope, "shown": sorted(found, key=lambda t: (t["due_at"], t["id"]))}
    if old is None:
        return {"result": "not_found"}
    if tool == "complete_task":
        said, new = ("already_completed" if old["completed"] else "completed"), old | {"completed": True}
    elif tool == "update_task":
        said, new = ("unchanged" if old["content"] == content else "updated"), old | {"content": content}
    elif tool == "set_task_deadline":
        said, new = ("set" if old["due_at"] is None else "unchanged" if old["due_at"] == due_at else "updated"), old | {"due_at": due_at}
    elif old != state.snapshot:
        return {"result": "stale", "task": old}
    else:
        said, new = "deleted", None
        del tasks[task_id]
    if new is not None:
        tasks[task_id] = new
    return {"result": said, "task": new or old}


def run(state: State, e: dict, tool: str, source: str, **arguments: object) -> dict:
    """A call and the turn's outcome: the state is left only once the change is committed, and is left even if the reply to it
    fails afterwards."""
    found = change(state, e, tool, **arguments)
    if found["result"] == "stale":
        state.go("awaiting_delete_confirmation", snapshot=found["task"], task_id=found["task"]["id"])
        return {"status": "needs_confirmation", "source": source, "say": "result", "tool": tool, **found}
    state.go("idle")
    if e["fault"] == "after":
        raise Failed("response_formatting")
    missing = found["result"] == "not_found" and tool in ("set_task_deadline", "delete_task") and source != "model"
    return {"status": "not_found" if missing else "executed", "source": source, "say": "result", "tool": tool, **found}


def ask(state: State, source: str = "session") -> dict:
    """The question of the state that the session is in."""
    if state.name == "awaiting_delete_confirmation":
        return {"status": "needs_confirmation", "source": source, "say": "confirm_delete", "task": state.snapshot}
    return {"status": "needs_clarification", "source": source, "say": state.name, "named": state.task_id}


def confirm(state: State, task_id: int, source: str) -> dict:
    """Keep a snapshot of the task that is to go, and ask."""
    task = state.tasks.get(task_id)
    if task is None:
        state.go("idle")
        return {"status": "not_found", "source": source if source == "model" else "session", "say": "not_found"}
    state.go("awaiting_delete_confirmation", snapshot=dict(task), task_id=task_id)
    return ask(state, source)


def wait(state: State, name: str, e: dict) -> None:
    """Wait for what an incomplete request lacks, keeping what it gave."""
    kept = {
        "awaiting_edit_id": {"content": e["edit_content"]}, "awaiting_edit_content": {"task_id": e["edit_id"]},
        "awaiting_deadline_id": {"when": e["when_text"], "due_at": e["when_due"]}, "awaiting_deadline_text": {"task_id": e["when_id"]},
    }
    state.go(name, **kept.get(name, {}))


def answer(state: State, e: dict) -> dict:
    """A turn that is no request of its own, as the answer to the session's question."""
    name, found, own = state.name, e["reply_id"], "session_continuation"
    task_id = found if found is not None and found > 0 else None
    if name == "awaiting_create_content":
        return run(state, e, "create_task", own, content=e["prompt"])
    if name == "awaiting_deadline_scope":
        return ask(state) if e["said_scope"] is None else run(state, e, "list_tasks_by_deadline", own, scope=e["said_scope"])
    if name == "awaiting_edit_content":
        return run(state, e, "update_task", own, task_id=state.task_id, content=e["prompt"]) if e["one_line"] else ask(state)
    if name == "awaiting_deadline_text":
        return ask(state) if e["own_due"] is None else run(state, e, "set_task_deadline", own, task_id=state.task_id, due_at=e["own_due"])
    if task_id is None or name == "awaiting_delete_confirmation":
        return ask(state)
    if name == "awaiting_complete_id":
        return run(state, e, "complete_task", own, task_id=task_id)
    if name == "awaiting_delete_id":
        return confirm(state, task_id, own)
    if name == "awaiting_edit_id" and state.content is not None:
        return run(state, e, "update_task", own, task_id=task_id, content=state.content)
    if name == "awaiting_deadline_id" and state.due_at is not None:
        return run(state, e, "set_task_deadline", own, task_id=task_id, due_at=state.due_at)
    state.go("awaiting_edit_content" if name == "awaiting_edit_id" else "awaiting_deadline_text", task_id=task_id)
    return ask(state)


def propose(state: State, e: dict) -> dict:
    """A request of its own: the proposed call, as far as the decision on it allows."""
    state.go("idle")
    tool, decided = e["tool"], e["result"]
    if tool is None:
        return {"status": "no_tool", "source": "model", "say": "no_action"}
    if decided == "allow":
        arguments = {"task_id": e["arg_id"], "content": e["arg_content"], "due_at": e["arg_due"], "scope": e["arg_scope"]}
        return run(state, e, tool, "model", **arguments)
    if decided == "requires_confirmation":
        return confirm(state, e["arg_id"], "model")
    if decided == "needs_clarification":
        name = CLARIFIES.get((tool, e["reason"]))
        if name is not None:
            wait(state, name, e)
        return ask(state, "model") if name is not None else {"status": "needs_clarification", "source": "model", "say": ASKED_BACK.get((tool, e["reason"]), "awaiting_create_content")}
    return {"status": "rejected", "source": "model", "say": f"rejected:{e['reason']}"}


def step(state: State, e: dict) -> dict:
    """One turn: the outcome, with `state` moved on."""
    kind, name = e["kind"], state.name
    if not e["present"]:
        return ask(state) if name != "idle" else {"status": "no_tool", "source": "session", "say": "no_action"}
    if name != "idle" and (e["cancel"] or name == "awaiting_delete_confirmation" and e["no"] and not e["yes"]):
        state.go("idle")
        return {"status": "cancelled", "source": "session", "say": f"cancelled:{name}"}
    if name == "awaiting_delete_confirmation" and e["yes"]:
        return run(state, e, "delete_task", "session_confirmation", task_id=state.task_id)
    if kind in WAITS:
        wait(state, WAITS[kind], e)
        return ask(state)
    if kind in ("unsupported", "negated"):
        state.go("idle")
        if kind == "negated" and name != "idle":
            return {"status": "cancelled", "source": "session", "say": f"cancelled:{name}"}
        return {"status": "rejected", "source": "session", "say": "rejected:unsupported_action" if kind == "unsupported" else "no_action"}
    if kind == "other" and name != "idle":
        return answer(state, e)
    return propose(state, e)


def fold(state: State, events: list[dict]) -> list[dict]:
    """The outcomes of a session's turns, in order of the turn. A turn at or before the last one seen is late: it is told so
    and changes nothing."""
    out = []
    for e in sorted(events, key=lambda e: e["turn"]):
        before, error = state.name, None
        if state.turn is not None and e["turn"] <= state.turn:
            found = {"status": "late", "source": "session", "say": "no_action"}
        else:
            state.turn = e["turn"]
            try:
                found = step(state, e)
            except Failed as failure:
                found, error = {"status": "error", "source": "session", "say": "error"}, str(failure)
        found = dict.fromkeys(("tool", "result", "named", "scope", "task", "shown")) | found
        tasks = [dict(state.tasks[k]) for k in sorted(state.tasks)]
        out.append({"session": e["session"], "turn": e["turn"], "state_before": before, "state_after": state.name, "tasks": tasks, "error_stage": error} | found)
    return out


def with_events(turns: DataFrame) -> DataFrame:
    """turns(session, turn, at timestamp, prompt, tool, arguments, fault) -> what the fold reads, all of it columns. tool and
    arguments (JSON text): the call that a model proposed, if any; fault: null, before or after."""
    p, at = F.col("prompt"), F.col("at")
    said = requests.turn_words(p)
    held = requests.with_request(turns, "prompt", at, "request")
    held = held.withColumn("decision", requests.decide(p, F.col("tool"), F.col("arguments"), at))
    r = lambda path: F.col(f"request.{path}")
    argument = lambda key, kind: requests._typed(F.col("arguments"), key, kind)
    columns: dict[str, Column] = {
        "kind": r("kind"), "present": requests.present(p), "cancel": said.isin(*CANCEL), "yes": said.isin(*YES), "no": said.isin(*NO),
        "one_line": ~p.rlike(r"[\r\n]"), "reply_id": requests.replied_id(p), "said_scope": requests.scope_of(p), "own_due": parse_deadline(p, at),
        "edit_id": r("edit.id"), "edit_content": r("edit.content"), "when_id": r("deadline.id"), "when_text": r("deadline.when"),
        "when_due": parse_deadline(r("deadline.when"), at), "result": F.col("decision.result"), "reason": F.col("decision.reason"),
        "arg_id": argument("id", "bigint"), "arg_content": argument("content", "string"), "arg_due": parse_deadline(argument("when", "string"), at),
        "arg_scope": argument("scope", "string"), "now": F.unix_seconds(at), **{f"day{k}": local_day_start(at, k) for k in range(3)},
    }
    return held.select("session", "turn", "prompt", "tool", "fault", *[c.alias(k) for k, c in columns.items()])


def records(frame: pd.DataFrame) -> list[dict]:
    """Rows as dicts with plain numbers, and None for what is missing."""
    return [{k: None if v is None or v != v else int(v) if isinstance(v, float) else v for k, v in row.items()} for row in frame.to_dict("records")]


def with_reply(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("reply", replies.reply())


def outcomes(events: DataFrame) -> DataFrame:
    """The fold over all `with_events` rows at once."""
    return events.groupBy("session").applyInPandas(lambda frame: pd.DataFrame(fold(State(), records(frame)), columns=NAMES), OUTCOME)


def session_turns(turns: DataFrame) -> DataFrame:
    """The outcome of every turn, in batch: one row a turn with its states, status, reply and the session's tasks after it. A
    session's turns are folded in one task; sessions are dealt by their key."""

    return with_reply(outcomes(with_events(turns)))


class Sessions(StatefulProcessor):
    """The fold on a stream: a session's state is kept between batches, and forgotten `expiry_ms` after its last turn: by the clock of the
    machine, or with `by_event` by the time of the turns, once the stream's watermark has passed it.

    By event time a session has one timer. A turn only moves the end that the state names; a timer that goes off before that end is set to it."""

    def __init__(self, expiry_ms: int | None = None, by_event: bool = False) -> None:
        self.expiry_ms, self.by_event = expiry_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("state", "state string", None if self.by_event else self.expiry_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = self.held.get()
        state = State() if held is None else State.load(held[0])
        events = [r.asDict() for r in rows]
        out = fold(state, events)
        if self.by_event:
            ends = 1000 * max(e["now"] for e in events) + self.expiry_ms
            if state.ends is None:
                self.handle.registerTimer(ends)
            state.ends = max(ends, state.ends or ends)  # a late turn doesn't shorten a session's life
        self.held.update((state.dump(),))
        return (Row(**{k: o[k] for k in NAMES}) for o in out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        held = self.held.get()
        ends = None if held is None else State.load(held[0]).ends
        if ends is not None and ends >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ends)
        else:
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_outcomes(events: DataFrame, expiry_ms: int | None = None, by_event: bool = False) -> DataFrame:
    """The fold over a stream of `with_events` rows. With `by_event` a session is forgotten once the newest turn of the stream is `expiry_ms`
    later than its own last one, and a turn that is farther behind the newest is dropped."""
    if by_event:
        events = events.withColumn("_at", F.timestamp_seconds("now")).withWatermark("_at", f"{expiry_ms} milliseconds")
    mode = ("eventTime" if by_event else "processingTime") if expiry_ms else "none"
    return events.groupBy("session").transformWithState(Sessions(expiry_ms, by_event), OUTCOME, "append", mode)


def stream_session_turns(turns: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """session_turns for a streaming `turns`; a state that no turn has touched for `expiry_ms` is dropped."""
    return with_reply(stream_outcomes(with_events(turns), expiry_ms))


def replayed(events: DataFrame, folder: str, slices: int, expiry_ms: int | None = None) -> DataFrame:
    """The outcomes of `with_events` rows that arrive as files, in `slices` slices by turn, oldest first, each taken up by a new start of
    the stream; `expiry_ms` counts by the turns' own time.

    Below `folder`, which driver and executors share, lie the slices, the stream's checkpoint and its outcomes. Slices that were
    written whole and batches that were committed aren't done again, so a replay that was cut off goes on from there when it is
    called again. Without events there are no outcomes."""
    spark = events.sparkSession
    ends = events.agg(F.min("turn").alias("low"), F.max("turn").alias("high")).first()
    if ends["low"] is None:
        return spark.createDataFrame([], OUTCOME)
    wide, provider = (ends["high"] - ends["low"]) // slices + 1, "spark.sql.streaming.stateStore.providerClass"
    saved = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(slices):
            if not exists(spark, f"{folder}/turns/{k}/_SUCCESS"):
                events.where(F.floor((F.col("turn") - ends["low"]) / wide) == k).write.mode("overwrite").parquet(f"{folder}/turns/{k}")
            found = stream_outcomes(spark.readStream.schema(events.schema).parquet(f"{folder}/turns/*"), expiry_ms, bool(expiry_ms))
            sink = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/outcomes")
            sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider) if saved is None else spark.conf.set(provider, saved)
    return spark.read.schema(OUTCOME).parquet(f"{folder}/outcomes")
