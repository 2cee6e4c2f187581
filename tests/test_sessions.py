"""Task conversations: the state machine, its faults, and the stream against the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from curalens.functions import replies, requests
from curalens.plans.conversations import SCRIPTS
from curalens.streaming import sessions

TURNS = "session long, turn long, at timestamp, prompt string, tool string, arguments string, fault string"
NOW = "2026-09-27 03:00:00"


def turns(spark, said, at=NOW):
    """said: (session, turn, prompt, tool, arguments, fault[, time])."""
    rows = [(s, t, p, tool, a, f, *(more or [at])) for s, t, p, tool, a, f, *more in said]
    frame = spark.createDataFrame(rows, "session long, turn long, prompt string, tool string, arguments string, fault string, at string")
    return frame.select("session", "turn", F.col("at").cast("timestamp").alias("at"), "prompt", "tool", "arguments", "fault")


def scripted():
    return [(s, k, *turn[:4]) for s, script in enumerate(SCRIPTS) for k, turn in enumerate(script)]


def event(**told):
    names = ("session", "turn", "kind", "present", "cancel", "yes", "no", "one_line", "reply_id", "said_scope", "own_due", "edit_id", "edit_content", "when_id", "when_text", "when_due", "result", "reason", "arg_id")
    return dict.fromkeys((*names, "arg_content", "arg_due", "arg_scope", "now", "day0", "day1", "day2", "prompt", "tool", "fault")) | {"kind": "other", "present": True, "session": 1} | told


def test_a_changed_task_is_asked_about_again():
    task = {"id": 1, "content": "a", "completed": False, "due_at": None}
    state = sessions.State(tasks={1: dict(task)}, next_id=2)
    sessions.fold(state, [event(turn=1, kind="delete", tool="delete_task", result="requires_confirmation", arg_id=1)])
    assert state.name == "awaiting_delete_confirmation" and state.snapshot == task
    state.tasks[1]["content"] = "b"  # by someone else
    (stale,) = sessions.fold(state, [event(turn=2, yes=True)])
    assert (stale["status"], stale["result"], state.name, state.snapshot["content"]) == ("needs_confirmation", "stale", "awaiting_delete_confirmation", "b") and 1 in state.tasks
    (gone,) = sessions.fold(state, [event(turn=3, yes=True)])
    assert (gone["status"], gone["result"], state.name, state.tasks) == ("executed", "deleted", "idle", {})


def test_a_fault_before_the_commit_keeps_everything_and_one_after_it_nothing_pending():
    for fault, name, n, stage in (("before", "awaiting_create_content", 0, "commit"), ("after", "idle", 1, "response_formatting")):
        state = sessions.State(name="awaiting_create_content")
        (out,) = sessions.fold(state, [event(turn=1, prompt="x", fault=fault)])
        assert (out["status"], out["error_stage"], state.name, len(out["tasks"])) == ("error", stage, name, n)


def test_only_what_a_state_needs_is_kept():
    state = sessions.State()
    sessions.fold(state, [event(turn=1, kind="missing_edit_id", edit_content="new")])
    assert (state.name, state.content) == ("awaiting_edit_id", "new")
    sessions.fold(state, [event(turn=2, kind="missing_complete")])
    assert (state.name, state.content, state.task_id) == ("awaiting_complete_id", None, None)
    again = sessions.State.load(state.dump())
    assert again == state


def test_late_turns_change_nothing():
    state = sessions.State()
    out = sessions.fold(state, [event(turn=5, kind="missing_create"), event(turn=5, prompt="x"), event(turn=4, prompt="x")])
    assert [o["status"] for o in out] == ["late", "needs_clarification", "late"] or [o["turn"] for o in out] == [4, 5, 5]
    assert state.name in ("awaiting_create_content", "idle") and state.turn == 5


def test_a_relative_time_means_the_day_it_was_said_on(spark):
    said = [(1, 0, "Thêm việc: x", "create_task", '{"content": "x"}', None), (1, 1, "đặt hạn vào 8:00 mai", None, None, None), (1, 2, "1", None, None, None, "2026-09-29 03:00:00")]
    rows = sessions.session_turns(turns(spark, said)).orderBy("turn").collect()
    assert [r["status"] for r in rows] == ["executed", "needs_clarification", "executed"]
    assert rows[2]["reply"] == "Đã đặt hạn [1] vào 28/09/2026 08:00: x" and rows[1]["reply"] == replies.QUESTIONS["awaiting_deadline_id"]


def test_replies_of_a_session(spark):
    said = [(1, 0, "Thêm việc", None, None, None), (1, 1, "a\nb", None, None, None), (1, 2, "xem danh sách", "list_tasks", "{}", None), (1, 3, "sửa việc 2", None, None, None), (1, 4, "c", None, None, None),
            (1, 5, "xóa việc 2", "delete_task", '{"id": 2}', None), (1, 6, "thôi", None, None, None), (1, 7, "xem việc đến hạn mai", "list_tasks_by_deadline", '{"scope": "tomorrow"}', None), (1, 8, "sắp xếp danh sách", None, None, None),
            (1, 9, "Thêm việc: x", "create_task", '{"content": "y"}', None)]
    got = [r["reply"] for r in sessions.session_turns(turns(spark, said)).orderBy("turn").collect()]
    assert got == [
        "Bạn muốn thêm việc gì?", "Đã thêm 2 việc:\n[1] a\n[2] b", "Danh sách hiện có 2 việc:\n[1] [ ] a\n[2] [ ] b", "Bạn muốn đổi nội dung việc 2 thành gì?", "Đã sửa [2] thành: c", "Bạn có chắc muốn xóa [2] [ ] c?",
        "Đã hủy yêu cầu xóa việc. Không có việc nào bị xóa.", "Không có việc chưa hoàn thành đến hạn ngày mai.",
        "Trợ lý hiện chỉ hỗ trợ thêm, xem, hoàn thành, sửa và xóa việc theo ID; ngoài ra có thể đặt hạn theo ID hoặc xem việc theo hạn.", "Tôi chưa lưu việc vì nội dung không khớp lời bạn. Hãy viết lại yêu cầu.",
    ]


def streamed(spark, frame, where, batches, **options):
    """The outcomes of a stream that reads the turns in as many files as `batches` says."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, part in enumerate(batches):
        frame.where(part).coalesce(1).write.parquet(str(where / f"in/{k}"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(where / "in/*"))
    sink = sessions.stream_session_turns(stream, **options).writeStream.format("parquet").option("checkpointLocation", str(where / "cp")).option("path", str(where / "out"))
    sink.trigger(availableNow=True).start().awaitTermination(180)
    return spark.read.parquet(str(where / "out"))


def test_the_stream_gives_the_batch(spark, tmp_path):
    frame = turns(spark, scripted())
    got = streamed(spark, frame, tmp_path, [F.col("turn") < 4, F.col("turn") >= 4])
    columns = ["session", "turn", "state_before", "state_after", "status", "say", "reply"]
    want = sessions.session_turns(frame)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)


def test_a_forgotten_session_begins_anew(spark, tmp_path):
    frame = turns(spark, [(1, 0, "Thêm việc", None, None, None), (1, 1, "mua sữa", None, None, None)])
    got = streamed(spark, frame, tmp_path, [F.col("turn") == 0, F.col("turn") == 1], expiry_ms=1)
    assert {(r["turn"], r["state_before"], r["status"]) for r in got.collect()} == {(0, "idle", "needs_clarification"), (1, "idle", "no_tool")}


EVENT = """session long, turn long, kind string, present boolean, cancel boolean, yes boolean, no boolean, one_line boolean, reply_id long, said_scope string, own_due long,
    edit_id long, edit_content string, when_id long, when_text string, when_due long, result string, reason string, arg_id long, arg_content string, arg_due long, arg_scope string,
    now long, day0 long, day1 long, day2 long, prompt string, tool string, fault string"""


def told(spark):
    """Sessions of six turns: one is asked for a content, gives it, completes the task twice and creates another."""
    rows = []
    for s in range(5):
        add = {"tool": "create_task", "result": "allow", "arg_content": f"task {s}"}
        done = {"tool": "complete_task", "result": "allow", "arg_id": 1}
        plan = [{"kind": "missing_create"}, {"prompt": f"line {s}"}, done, done, add, {"kind": "missing_delete_id"}]
        rows += [event(session=s, turn=k, now=1000 + 60 * k, **e) for k, e in enumerate(plan)]
    names = [c.split()[0] for c in EVENT.replace("\n", " ").split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT)


def facts(found):
    return sorted(((r["session"], r["turn"], r["state_before"], r["state_after"], r["status"], r["result"], len(r["tasks"])) for r in found.collect()), key=lambda r: r[:2])


def test_a_replay_gives_the_batch_also_after_it_was_cut_off(spark, tmp_path, monkeypatch):
    rows, folder = told(spark), f"file://{tmp_path}/s"
    want = facts(sessions.outcomes(rows))
    real, seen = sessions.stream_outcomes, []

    def cut(events, *options):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("cut off")
        return real(events, *options)

    monkeypatch.setattr(sessions, "stream_outcomes", cut)
    with pytest.raises(RuntimeError, match="cut off"):
        sessions.replayed(rows, folder, 3, 86_400_000)
    assert {r["turn"] for r in spark.read.parquet(f"{folder}/outcomes").collect()} == {0, 1}
    assert facts(sessions.replayed(rows, folder, 3, 86_400_000)) == want
    assert facts(sessions.replayed(rows, folder, 3, 86_400_000)) == want  # nothing is done twice
    assert sessions.replayed(rows.limit(0), f"{folder}0", 3).collect() == []


def test_a_session_ends_by_the_time_of_the_turns(spark, tmp_path):
    rows = told(spark).where("turn < 2").withColumn("now", F.expr("now + turn * 7200 + session"))
    got = facts(sessions.replayed(rows.where("turn = 0 OR session < 2"), f"file://{tmp_path}/s", 2, 3_600_000))
    assert {(s, t, before) for s, t, before, *_ in got if t == 1} == {(0, 1, "awaiting_create_content"), (1, 1, "awaiting_create_content")}
    late = rows.where("turn = 1 AND session > 1").withColumn("turn", F.lit(2).cast("long")).withColumn("now", F.expr("now + 7200"))
    got = facts(sessions.replayed(rows.where("turn = 0 OR session < 2").unionByName(late), f"file://{tmp_path}/t", 3, 3_600_000))
    assert {(s, before) for s, t, before, *_ in got if t == 2} == {(2, "idle"), (3, "idle"), (4, "idle")}


@pytest.mark.parametrize("mode, tools, fallback", [(True, ["update_task"], False), (False, list(requests.TOOLS), False)])
def test_tools_of_a_kind(spark, mode, tools, fallback):
    row = spark.range(1).select(*requests.tools_for(F.lit("multiple_edit"), mode)).first()
    assert (row[0], row[1]) == (tools, fallback)


def test_a_turn_takes_two_calls_of_the_state():
    """One timer a session, moved only when it goes off: turns neither list, delete nor set timers after the first."""
    calls, kept = [], {}

    class Held:
        def get(self):
            calls.append("get")
            return kept.get("state")

        def update(self, value):
            calls.append("update")
            kept["state"] = value

        def clear(self):
            kept.clear()

    class Handle:
        def getValueState(self, *_):
            return Held()

        def registerTimer(self, ends):
            calls.append(ends)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    events = [Row(**event(turn=k, now=k)) for k in range(3)]
    own = sessions.Sessions(1000, by_event=True)
    own.init(Handle())
    first, *_, last = (1000 * e["now"] + 1000 for e in events)
    out = [o for e in events for o in own.handleInputRows((0,), iter([e]), Times(0))]
    assert calls == ["get", first, "update", "get", "update", "get", "update"] and [o["turn"] for o in out] == [0, 1, 2]
    calls.clear()
    assert not list(own.handleExpiredTimer((0,), Times(last - 1), None)) and calls == ["get", last] and kept
    assert not list(own.handleExpiredTimer((0,), Times(last + 1), None)) and calls == ["get", last, "get"] and not kept
