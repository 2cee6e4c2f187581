"""Registered queries over task requests: kinds, routes, decisions, sessions and replies.

Requests are dealt over the rows of a table: a row's key picks one of the cases, and its id and content are filled in, so every
row of the table is read and every case is met many times. The SQL states what each case must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies, requests
from ..operators import rollups
from ..sources.tables import read, shared_folder
from ..streaming import sessions
from .catalogue import NOW, ORACLE_SQL, now, query

#: (request, its kind). {n}, {m}: two ids; {c}: a content.
KINDS = (
    ("Thêm việc: {c}", "create"), ("Thêm việc {c} giúp tôi nhé.", "create"), ("ghi lại task {c}", "create"), ("Thêm việc", "missing_create"), ("tạo giúp mình task:", "missing_create"),
    ("Thêm 3 việc sau:\n{c}\ngọi mẹ", "create"), ("lưu một task mới có nội dung {c}", "create"), ("bỏ vào todo {c}", "create"), ("cho việc {c} vào danh sách nhé", "create"),
    ("cho việc {c}", "create"), ("đừng thêm việc {c}", "negated"), ("THÊM VIỆC: {c}", "create"), ("thêm việc {c} nhưng đừng lưu vội", "create"), ("note giúp tôi {c}", "create"),
    ("hãy thêm các việc, mỗi dòng một việc:\n{c}", "create"), ("thêm việc nhé", "missing_create"), ("ví dụ: thêm việc {c}", "other"),
    ("hoàn thành việc {n}", "complete"), ("đánh dấu task #{n} là đã xong nhé", "complete"), ("hoàn thành việc", "missing_complete"), ("hoàn thành việc {n} và {m}", "multiple_complete"),
    ("hoàn thành việc {n} ngay", "complete"), ("tôi làm xong việc {n} rồi; cập nhật trạng thái", "complete"), ("đừng hoàn thành việc {n}", "other"), ("hoàn thành việc 0", "complete"),
    ("vui lòng hoàn thành task {n}.", "complete"),
    ("sửa việc {n} thành {c}", "edit"), ("sửa việc {n}", "missing_edit_content"), ("sửa việc thành {c}", "missing_edit_id"), ("sửa việc {n} {m} thành {c}", "multiple_edit"),
    ("đổi nội dung task #{n} thành: {c}.", "edit"), ("đừng sửa việc {n}", "negated"), ("sửa việc mua sữa thành {c}", "edit"), ("sửa việc {n} thành {c} rồi xóa việc {m}", "edit"),
    ("cập nhật nội dung việc {n} thành {c}?", "edit"), ("sửa việc {n} thành .", "missing_edit_content"),
    ("xóa việc {n}", "delete"), ("xoá task #{n} khỏi danh sách giúp mình.", "delete"), ("xóa việc", "missing_delete_id"), ("xóa việc {n} và {m}", "multiple_delete"),
    ("bỏ hẳn việc {n}; ứng dụng hãy hỏi xác nhận", "delete"), ("xóa việc mua sữa", "delete"), ("không xóa việc {n}", "negated"), ("xóa việc {n}a", "delete"),
    ("đặt hạn việc {n} vào 8 giờ sáng mai", "deadline"), ("đặt hạn cho việc {n}", "missing_deadline_time"), ("đặt hạn vào 8 giờ sáng mai", "missing_deadline_id"),
    ("đặt hạn việc {n} vào một lúc khác", "missing_deadline_time"), ("đừng đặt hạn việc {n}", "negated"), ("việc {n}: đặt hạn 8 giờ sáng mai", "deadline"),
    ("hạn của việc {n}, hãy chuyển sang 9:30 mai", "deadline"), ("với task ID {n}, hạn mới là 15/10/2026 14:00; ghi lại", "deadline"), ("cập nhật hạn của việc {n} thành 7:05 hôm nay", "deadline"),
    ("đặt hạn việc {n} {m} vào 8:00 mai", "multiple_deadline"), ("đặt hạn việc {n} vào 30/02/2026 08:00", "missing_deadline_time"), ("đặt deadline task #{n} lúc 12 giờ chiều mai.", "deadline"),
    ("xem các việc đến hạn hôm nay", "deadline_query"), ("ngày mai có những việc nào tới hạn?", "deadline_query"), ("cho tôi biết việc nào đã quá hạn", "deadline_query"),
    ("xem việc theo hạn", "missing_deadline_scope"), ("không xem việc đến hạn hôm nay", "negated"), ("liệt kê task đã trễ hạn", "deadline_query"),
    ("xem danh sách", "list"), ("cho mình xem các việc", "list"), ("bây giờ tôi có những việc gì?", "list"), ("xem danh sách, chỉ việc đã hoàn thành", "list"), ("đừng xem danh sách", "negated"),
    ("kiểm tra todo", "list"), ("mình còn đầu việc nào chưa làm, có gì không", "list"),
    ("sắp xếp danh sách", "unsupported"), ("tắt thông báo", "unsupported"), ("đặt nhắc nhở", "unsupported"),
    ("chào bạn", "other"), ("", "other"), (" \u00a0 ", "other"), ("hôm nay trời đẹp", "other"), ("có những việc nào giúp tôi ngủ ngon", "other"), ("tất cả việc kèm thời hạn", "other"), ("{n}", "other"),
)
#: (request, tool, arguments, reason); the result follows from the reason.
DECISIONS = (
    ("Thêm việc: {c}", "create_task", '{{"content": "{c}"}}', "explicit_create"), ("Thêm việc {c} nhé", "create_task", '{{"content": "{c}"}}', "explicit_create"),
    ("Thêm việc {c}.", "create_task", '{{"content": "{c}."}}', "explicit_create"), ("Thêm việc {c}.", "create_task", '{{"content": "{c}"}}', "explicit_create"),
    ("Thêm việc: {c}.", "create_task", '{{"content": "{c}"}}', "content_boundary_mismatch"), ("Thêm việc: {c}", "create_task", '{{"content": "mua trà"}}', "content_not_grounded"),
    ("Thêm việc: {c}", "create_task", '{{"content": "{c}", "id": 1}}', "invalid_arguments"), ("Thêm việc: {c}", "create_task", '{{"content": 5}}', "invalid_arguments"),
    ("Thêm việc: {c}", "create_task", '["{c}"]', "invalid_arguments"), ("Thêm việc: {c}", "create_task", '{{"content": " "}}', "invalid_arguments"), ("Thêm việc", "create_task", "{{}}", "missing_content"),
    ("đừng thêm việc {c}", "create_task", '{{"content": "{c}"}}', "negated_request"), ("chào bạn", "create_task", '{{"content": "chào"}}', "bare_statement"), ("xóa các việc", "create_task", "{{}}", "unsupported_action"),
    ("hoàn thành việc {n}", "complete_task", '{{"id": {n}}}', "explicit_complete"), ("hoàn thành việc {n}", "complete_task", '{{"id": {m}}}', "task_id_mismatch"),
    ("hoàn thành việc {n}", "complete_task", '{{"id": "{n}"}}', "invalid_arguments"), ("hoàn thành việc {n}", "complete_task", '{{"id": true}}', "invalid_arguments"),
    ("hoàn thành việc {n}", "complete_task", '{{"id": {n}.0}}', "invalid_arguments"), ("hoàn thành việc", "complete_task", '{{"id": {n}}}', "missing_task_id"),
    ("hoàn thành việc {n} và {m}", "complete_task", '{{"id": {n}}}', "multiple_task_ids"), ("hoàn thành việc {n}", "delete_task", '{{"id": {n}}}', "bare_statement"),
    ("sửa việc {n} thành {c}", "update_task", '{{"id": {n}, "content": "{c}"}}', "explicit_update"), ("sửa việc {n} thành {c}!", "update_task", '{{"id": {n}, "content": "{c}!"}}', "explicit_update"),
    ("sửa việc {n} thành: {c}!", "update_task", '{{"id": {n}, "content": "{c}"}}', "content_boundary_mismatch"), ("sửa việc {n} thành {c}", "update_task", '{{"id": {m}, "content": "{c}"}}', "task_id_mismatch"),
    ("sửa việc {n}", "update_task", '{{"id": {n}, "content": "{c}"}}', "missing_update_content"), ("sửa việc {n} thành {c}, xóa việc {m}", "update_task", '{{"id": {n}, "content": "{c}"}}', "unsupported_action"),
    ("xóa việc {n}", "delete_task", '{{"id": {n}}}', "explicit_delete"), ("xóa việc {n}", "delete_task", '{{"id": -{n}}}', "invalid_arguments"), ("không xóa việc {n}", "delete_task", '{{"id": {n}}}', "negated_request"),
    ("đặt hạn việc {n} vào 8:00 mai", "set_task_deadline", '{{"id": {n}, "when": "8:00 mai"}}', "explicit_deadline"), ("đặt hạn việc {n} vào 8:00 mai.", "set_task_deadline", '{{"id": {n}, "when": "8:00 mai."}}', "explicit_deadline"),
    ("việc {n}: đặt hạn 8:00 mai!", "set_task_deadline", '{{"id": {n}, "when": "8:00 mai!"}}', "explicit_deadline"), ("đặt hạn việc {n} vào 8:00 mai", "set_task_deadline", '{{"id": {n}, "when": "8:00"}}', "content_boundary_mismatch"),
    ("đặt hạn việc {n} vào 8:00 mai", "set_task_deadline", '{{"id": {n}, "when": "9:00 mai"}}', "content_not_grounded"), ("đặt hạn việc {n} vào khi nào", "set_task_deadline", '{{"id": {n}, "when": "khi nào"}}', "invalid_deadline_time"),
    ("đặt hạn việc {n}", "set_task_deadline", "{{}}", "missing_deadline_time"), ("xem việc đến hạn mai", "list_tasks_by_deadline", '{{"scope": "tomorrow"}}', "explicit_deadline_query"),
    ("xem việc đến hạn mai", "list_tasks_by_deadline", '{{"scope": "today"}}', "deadline_scope_mismatch"), ("xem việc đến hạn mai", "list_tasks_by_deadline", '{{"scope": "never"}}', "invalid_arguments"),
    ("xem việc theo hạn", "list_tasks_by_deadline", '{{"scope": "today"}}', "missing_deadline_scope"), ("xem danh sách", "list_tasks", "{{}}", "explicit_list"), ("xem danh sách", "list_tasks", '{{"a": 1}}', "invalid_arguments"),
    ("xem việc đến hạn mai", "list_tasks", "{{}}", "deadline_scope_mismatch"), ("xem danh sách đến hạn", "list_tasks", "{{}}", "deadline_scope_mismatch"), ("xem danh sách và xóa việc {n}", "list_tasks", "{{}}", "unsupported_action"),
    ("đừng mở danh sách", "list_tasks", "{{}}", "negated_request"), ("xem danh sách việc đã thêm", "list_tasks", "{{}}", "bare_statement"), ("xem danh sách", "drop_table", "{{}}", "unsupported_tool"), ("xem danh sách", " ", "{{}}", "invalid_arguments"),
    ("", "list_tasks", "{{}}", "invalid_arguments"),
)
KIND_TOOLS = {kind: tool for tool, kinds in requests.ROUTES.items() for kind in kinds}
RESULT_OF = {reason: result for result, reasons in requests.RESULTS.items() for reason in reasons}


def values(rows: list[tuple]) -> str:
    told = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(told, r)) + ")" for r in rows) + ")"


def filled(pattern: Column, n: Column, m: Column, content: Column) -> Column:
    out = F.replace(F.replace(pattern, F.lit("{n}"), n.cast("string")), F.lit("{m}"), m.cast("string"))
    return F.replace(F.replace(F.replace(out, F.lit("{c}"), content), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def dealt(spark: SparkSession, d: str, cases: tuple, names: tuple[str, ...]) -> DataFrame:
    """orders with a case each, by their key; the ids and the content come from the row."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lower(F.regexp_replace("o_orderpriority", "[^A-Z]+", " ")).alias("content"))
    n, at = F.col("id") % 97 + 1, (F.col("id") % len(cases) + 1).cast("int")
    content = F.concat(F.lit("mua "), F.trim("content"))
    return rows.select("id", *[filled(F.element_at(F.array(*[F.lit(c[k]) for c in cases]), at), n, n + 1, content).alias(name) for k, name in enumerate(names)])


@query("request_kinds", f"""SELECT o_orderkey AS id, kind, CASE WHEN tool IS NULL THEN 7 ELSE 1 END AS tools, coalesce(tool, 'create_task') AS first_tool, tool IS NULL AS fallback
    FROM orders JOIN {values([(k, kind, KIND_TOOLS.get(kind)) for k, (_, kind) in enumerate(KINDS)])} c(k, kind, tool) ON o_orderkey % {len(KINDS)} = k""")
def request_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.with_request(dealt(spark, d, KINDS, ("prompt",)), "prompt", now())
    tools, fallback = requests.tools_for(F.col("request.kind"), True)
    return rows.select("id", F.col("request.kind").alias("kind"), F.size(tools).alias("tools"), F.element_at(tools, 1).alias("first_tool"), fallback.alias("fallback"))


@query("request_spans", f"""SELECT o_orderkey AS id, CASE WHEN k IN (26, 30, 34, 44, 49, 50, 51, 52, 55) THEN o_orderkey % 97 + 1 END AS task_id,
    CASE WHEN k IN (0, 1, 2, 6, 7, 8, 11, 13, 26, 34) THEN 'mua ' || content WHEN k = 30 THEN 'mua ' || content || '.' WHEN k IN (44, 49) THEN '8 giờ sáng mai' WHEN k = 50 THEN '9:30 mai'
      WHEN k = 51 THEN '15/10/2026 14:00' WHEN k = 52 THEN '7:05 hôm nay' WHEN k = 55 THEN '12 giờ chiều mai' END AS span
    FROM (SELECT o_orderkey, o_orderkey % {len(KINDS)} AS k, trim(lower(regexp_replace(o_orderpriority, '[^A-Z]+', ' ', 'g'))) AS content FROM orders)
    WHERE k IN (0, 1, 2, 6, 7, 8, 11, 13, 26, 30, 34, 44, 49, 50, 51, 52, 55)""")
def request_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.with_request(dealt(spark, d, KINDS, ("prompt",)), "prompt", now())
    r = lambda path: F.col(f"request.{path}")
    plain = rows.where((F.col("id") % len(KINDS)).isin(0, 1, 2, 6, 7, 8, 11, 13, 26, 30, 34, 44, 49, 50, 51, 52, 55))
    return plain.select("id", F.when(r("kind") == "edit", r("edit.id")).when(r("kind") == "deadline", r("deadline.id")).alias("task_id"),
                        F.when(r("kind") == "create", r("create.content")).when(r("kind") == "edit", r("edit.content")).otherwise(r("deadline.when")).alias("span"))


#: What a turn says, as the content of a request: whole, in lines, whatever its words.
TURN_TEXT = "regexp_replace(coalesce(text, ''), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"


@query("request_contents", f"""SELECT conv_id, turn, role, CASE WHEN t = '' THEN 'missing_create' ELSE 'create' END AS kind, t AS content,
    CASE WHEN t = '' THEN 'invalid_arguments' WHEN role = 'user' THEN 'explicit_create' ELSE 'content_not_grounded' END AS reason FROM (SELECT *, {TURN_TEXT} AS t FROM conversations)""")
def request_contents(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said"))
    bare = requests.strip(F.col("said"))
    proposed = F.when(F.col("role") == "user", bare).otherwise(F.concat(bare, F.lit(" và \u2603")))
    arguments = F.to_json(F.struct(F.when(bare == "", F.lit(" ")).otherwise(proposed).alias("content")))
    rows = requests.with_request(turns.withColumns({"prompt": F.concat(F.lit("Thêm việc: "), "said"), "arguments": arguments}), "prompt", now())
    reason = F.when(bare == "", "invalid_arguments").otherwise(requests.decide(F.col("prompt"), F.lit("create_task"), F.col("arguments"), now())["reason"])
    return rows.select("conv_id", "turn", "role", F.col("request.kind").alias("kind"), F.col("request.create.content").alias("content"), reason.alias("reason"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = requests.with_request(dealt(spark, d, DECISIONS, ("prompt", "tool", "arguments")), "prompt", now())
    return rows.select("id", "tool", requests.decide(F.col("prompt"), F.col("tool"), F.col("arguments"), now()).alias("decision")).select("id", "tool", "decision.*")


DECIDED = f"(SELECT o_orderkey AS id, c.tool, result, reason FROM orders JOIN {values([(k, tool, RESULT_OF[reason], reason) for k, (_, tool, _, reason) in enumerate(DECISIONS)])} c(k, tool, result, reason) ON o_orderkey % {len(DECISIONS)} = k)"


@query("policy_decisions", f"SELECT id, result, reason FROM {DECIDED}")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(spark, d).select("id", "result", "reason")


@query("policy_compatibility", f"SELECT tool, count(*) AS calls, count(*) FILTER (result IN ('allow', 'requires_confirmation')) AS served, min(id) FILTER (result NOT IN ('allow', 'requires_confirmation')) AS first_gap FROM {DECIDED} GROUP BY tool")
def policy_compatibility(spark: SparkSession, d: str) -> DataFrame:
    served = F.col("result").isin("allow", "requires_confirmation")
    return rollups.compatibility(decisions(spark, d).withColumn("served", served), "tool", "served", "id")


# -- sessions -----------------------------------------------------------------------------------------------------------

#: Turns of five scripts: (request, proposed tool, arguments, fault, state after, status, tasks after). Every session follows one
#: of them for as many turns as it has; each begins idle and without tasks.
SCRIPTS = (
    (
        ("Thêm việc", None, None, None, "awaiting_create_content", "needs_clarification", 0), ("", None, None, None, "awaiting_create_content", "needs_clarification", 0),
        ("mua sữa\n\ngọi mẹ", None, None, None, "idle", "executed", 2), ("xóa việc", None, None, None, "awaiting_delete_id", "needs_clarification", 2),
        ("#1", None, None, None, "awaiting_delete_confirmation", "needs_confirmation", 2), ("sao cũng được", None, None, None, "awaiting_delete_confirmation", "needs_confirmation", 2),
        ("có", None, None, "before", "awaiting_delete_confirmation", "error", 2), ("đồng ý", None, None, None, "idle", "executed", 1),
        ("xóa việc 1", "delete_task", '{"id": 1}', None, "idle", "not_found", 1), ("Thêm việc: đọc sách", "create_task", '{"content": "đọc sách"}', None, "idle", "executed", 2),
    ),
    (
        ("Thêm việc: mua sữa", "create_task", '{"content": "mua sữa"}', None, "idle", "executed", 1), ("sửa việc thành mua trà", None, None, None, "awaiting_edit_id", "needs_clarification", 1),
        ("một", None, None, None, "awaiting_edit_id", "needs_clarification", 1), ("việc 1.", None, None, None, "idle", "executed", 1), ("sửa việc 1", None, None, None, "awaiting_edit_content", "needs_clarification", 1),
        ("hai\ndòng", None, None, None, "awaiting_edit_content", "needs_clarification", 1), ("mua cà phê", None, None, "after", "idle", "error", 1), ("thôi", None, None, None, "idle", "no_tool", 1),
        ("hoàn thành việc", None, None, None, "awaiting_complete_id", "needs_clarification", 1), ("hủy", None, None, None, "idle", "cancelled", 1),
    ),
    (
        ("Thêm việc: nộp bài", "create_task", '{"content": "nộp bài"}', None, "idle", "executed", 1), ("đặt hạn vào 8:00 mai", None, None, None, "awaiting_deadline_id", "needs_clarification", 1),
        ("1", None, None, None, "idle", "executed", 1), ("đặt hạn cho việc 1", None, None, None, "awaiting_deadline_text", "needs_clarification", 1), ("lúc nào đó", None, None, None, "awaiting_deadline_text", "needs_clarification", 1),
        ("9 giờ sáng mai", None, None, None, "idle", "executed", 1), ("xem việc theo hạn", None, None, None, "awaiting_deadline_scope", "needs_clarification", 1), ("tuần sau", None, None, None, "awaiting_deadline_scope", "needs_clarification", 1),
        ("mai", None, None, None, "idle", "executed", 1), ("đặt hạn việc 7 vào 8:00 mai", "set_task_deadline", '{"id": 7, "when": "8:00 mai"}', None, "idle", "executed", 1),
    ),
    (
        ("hoàn thành việc", None, None, None, "awaiting_complete_id", "needs_clarification", 0), ("đừng thêm việc mua sữa", None, None, None, "idle", "cancelled", 0), ("sắp xếp danh sách", None, None, None, "idle", "rejected", 0),
        ("chào bạn", None, None, None, "idle", "no_tool", 0), ("Thêm việc: mua sữa", "create_task", '{"content": "mua trà"}', None, "idle", "rejected", 0), ("Thêm việc: mua sữa", "create_task", '{"content": "mua sữa"}', "before", "idle", "error", 0),
        ("Thêm việc: mua sữa", "create_task", '{"content": "mua sữa"}', None, "idle", "executed", 1), ("xem danh sách", "list_tasks", "{}", None, "idle", "executed", 1), ("hoàn thành việc 1", "complete_task", '{"id": 1}', None, "idle", "executed", 1),
        ("hoàn thành việc 1 và 2", None, None, None, "awaiting_complete_id", "needs_clarification", 1),
    ),
    (
        ("Thêm việc: mua sữa", "create_task", '{"content": "mua sữa"}', None, "idle", "executed", 1), ("xóa việc 1", "delete_task", '{"id": 1}', None, "awaiting_delete_confirmation", "needs_confirmation", 1),
        ("sửa việc 1 thành mua trà", "update_task", '{"id": 1, "content": "mua trà"}', None, "idle", "executed", 1), ("xóa việc", None, None, None, "awaiting_delete_id", "needs_clarification", 1), ("9", None, None, None, "idle", "not_found", 1),
        ("xóa việc 1", "delete_task", '{"id": 1}', None, "awaiting_delete_confirmation", "needs_confirmation", 1), ("không", None, None, None, "idle", "cancelled", 1), ("chào bạn", "delete_task", '{"id": 1}', None, "idle", "rejected", 1),
        ("xóa việc 1", "delete_task", '{"id": 1}', None, "awaiting_delete_confirmation", "needs_confirmation", 1), ("xóa", None, None, None, "idle", "executed", 0),
    ),
)
LONGEST = max(len(s) for s in SCRIPTS)
SCRIPTED = values([(s, t, SCRIPTS[s][t - 1][4] if t else "idle", *turn[4:]) for s, script in enumerate(SCRIPTS) for t, turn in enumerate(script)])


def scripted(spark: SparkSession, d: str) -> DataFrame:
    """conversations as sessions: a conversation follows the script that its id picks; turns beyond its end are left out."""
    turns = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))  # a turn once
    script, at = F.col("conv_id") % len(SCRIPTS), (F.col("turn") % LONGEST).cast("int")
    kind = "array<struct<prompt:string,tool:string,arguments:string,fault:string>>"
    told = F.array(*[F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(("prompt", "tool", "arguments", "fault"), t[:4], strict=True)]) for t in s]).cast(kind) for s in SCRIPTS])
    rows = turns.where(F.col("turn") < LONGEST).select(F.col("conv_id").alias("session"), "turn", F.get(F.get(told, script.cast("int")), at).alias("t"))
    return rows.select("session", "turn", (F.lit(NOW).cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))).alias("at"), "t.*")


@query("session_turns", f"""SELECT conv_id AS session, turn, state_before, state_after, status, n AS tasks FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn < {LONGEST})
    JOIN {SCRIPTED} s(script, t, state_before, state_after, status, n) ON conv_id % {len(SCRIPTS)} = script AND turn = t""")
def session_turns(spark: SparkSession, d: str) -> DataFrame:
    found = sessions.session_turns(scripted(spark, d))
    return found.select("session", "turn", "state_before", "state_after", "status", F.size("tasks").alias("tasks"))


@query("session_stream", ORACLE_SQL["session_turns"])
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """session_turns through a stream that is started three times over one checkpoint. What a turn alone decides is worked out once, as it
    arrives; the stream holds the states. A day without a turn ends a session."""
    folder = shared_folder(spark, "sessions")
    sessions.with_events(scripted(spark, d)).write.parquet(f"{folder}/events")
    found = sessions.replayed(spark.read.parquet(f"{folder}/events"), f"{folder}/stream", 3, expiry_ms=86_400_000)
    return found.select("session", "turn", "state_before", "state_after", "status", F.size("tasks").alias("tasks"))


# -- replies ------------------------------------------------------------------------------------------------------------


def told_results(spark: SparkSession, d: str) -> DataFrame:
    """orders as results of calls: each with a tool and a status by its key."""
    tasks = read(spark, d, "orders").select(
        F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"), (F.col("o_orderstatus") == "F").alias("completed"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("due_at")).alias("task")
    )
    cases = [(tool, status) for tool, statuses in replies.STATUSES.items() for status in statuses] + [("create_task", "created"), ("list_tasks", "listed")]
    pair = F.element_at(F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(s).alias("result")) for t, s in cases]), (F.col("task.id") % len(cases) + 1).cast("int"))
    rows = tasks.select("task", pair.alias("p")).select("task", "p.*")
    gone = F.col("result") == "not_found"
    return rows.select(F.col("task.id").alias("id"), "tool", "result", F.when(~gone, F.col("task")).alias("task"), F.array("task").alias("shown"), F.lit(None).cast("string").alias("scope"))


TOLD_CASES = [(t, s) for t, ss in replies.STATUSES.items() for s in ss] + [("create_task", "created"), ("list_tasks", "listed")]


@query("replies", f"""SELECT id, CASE s WHEN 'not_found' THEN '{replies.NOT_FOUND}' WHEN 'completed' THEN 'Đã hoàn thành [' || id || '] ' || content WHEN 'already_completed' THEN 'Việc [' || id || '] đã hoàn thành trước đó: ' || content
    WHEN 'deleted' THEN 'Đã xóa [' || id || '] ' || content WHEN 'created' THEN 'Đã thêm [' || id || '] ' || content WHEN 'set' THEN 'Đã đặt hạn [' || id || '] vào ' || due || ': ' || content
    WHEN 'stale' THEN 'Việc [' || id || '] đã thay đổi thành [' || mark || '] ' || content || ' — hạn ' || due || '. Hãy xác nhận lại nếu bạn vẫn muốn xóa.'
    WHEN 'listed' THEN 'Danh sách hiện có 1 việc:' || chr(10) || '[' || id || '] [' || mark || '] ' || content || ' — hạn ' || due
    WHEN 'updated' THEN CASE t WHEN 'update_task' THEN 'Đã sửa [' || id || '] thành: ' || content ELSE 'Đã đổi hạn [' || id || '] thành ' || due || ': ' || content END
    WHEN 'unchanged' THEN CASE t WHEN 'update_task' THEN 'Việc [' || id || '] đã có nội dung này: ' || content ELSE 'Việc [' || id || '] đã có hạn ' || due || ': ' || content END END AS reply,
    list_concat(CASE WHEN t = 'complete_task' AND s <> 'not_found' AND mark = ' ' THEN ['not_completed'] ELSE [] END, CASE WHEN s <> 'not_found' AND id <= 0 THEN ['invalid_id'] ELSE [] END) AS errors
    FROM (SELECT o_orderkey AS id, o_orderpriority AS content, CASE o_orderstatus WHEN 'F' THEN 'x' ELSE ' ' END AS mark, strftime(timezone('Asia/Ho_Chi_Minh', o_orderdate AT TIME ZONE 'UTC'), '%d/%m/%Y %H:%M') AS due, c.t, c.s
      FROM orders JOIN {values([(k, t, s) for k, (t, s) in enumerate(TOLD_CASES)])} c(k, t, s) ON o_orderkey % {len(TOLD_CASES)} = k)""")
def reply_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = told_results(spark, d)
    c = [F.col(x) for x in ("tool", "result", "scope", "task", "shown")]
    return rows.select("id", replies.result_reply(*c).alias("reply"), replies.result_errors(*c).alias("errors"))
