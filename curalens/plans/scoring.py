"""Registered queries of scoring: JSON by value, argument checks, proposals, generated texts, turns, system cases, gates.

Cases are dealt over the rows of a table by its key, so every row is read and every case met many times; the SQL states what each
case must give.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsontext, proposals, text
from ..operators import scoring
from ..sources.tables import read
from .catalogue import query

CALLS = "array<struct<name:string,arguments:string>>"


def told(v: object) -> str:
    """A value as DuckDB writes it."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(told, v)) + "]::VARCHAR[]"
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def expected(table: str, key: str, columns: str, rows: Sequence[Sequence[object]]) -> str:
    """SQL: each row of a table with what its case must give."""
    values = ", ".join("(" + ", ".join([str(k), *map(told, r)]) + ")" for k, r in enumerate(rows))
    return f"SELECT {key}, {columns} FROM {table} JOIN (VALUES {values}) c(k, {columns}) ON {key} % {len(rows)} = k"


def dealt(spark: SparkSession, d: str, table: str, key: str, cases: Sequence[Sequence[object]], names: Sequence[str]) -> DataFrame:
    """(key, *names): each row of a table with its case."""
    at = (F.col(key) % len(cases) + 1).cast("int")
    column = lambda j: F.element_at(F.array(*[F.lit(c[j]).cast("string") for c in cases]), at)
    return read(spark, d, table).select(key, *[column(j).alias(n) for j, n in enumerate(names)])


# -- JSON by value ------------------------------------------------------------------------------------------------------

#: JSON texts with the class of their value: equal classes are equal values. A class of None is no strict JSON.
SCALARS = (
    ("1", "int 1"), ("1.0", "float 1"), ("1e0", "float 1"), ("true", "true"), ('"1"', "text 1"), ('"\\u0031"', "text 1"), ("null", "null"), ("0.0", "float 0"), ("-0.0", "float 0"), ("100.0", "float 100"), ("1e2", "float 100"),
    ("100", "int 100"), ("NaN", None), ("-Infinity", None), ("01", None),
)
WRAPPERS = ("%s", "[%s]", '{"a": %s}', '[1, {"b": [%s, 1.0]}]')
WHOLE = (
    ('{"a": 1, "b": "x"}', "ab"), ('{"b":"x","a":1}', "ab"), ('{"a": 1, "a": 1, "b": "x"}', None), ('{"a": 1.0, "b": "x"}', "a.b"), ("[1, 1.0]", "mixed"), ("[1.0, 1]", "mixed turned"), ("[1, 1]", "ints"), ("[]", "list"), ("{}", "object"),
    ('{"a": [{"k": 1, "k": 2}]}', None), ("[1,]", None), ('{"a": 1} x', None), ("", None), ("{", None), ('"\\u00e9"', "e"), ('"é"', "e"), ('{"a": {"b": {"c": [1, 2]}}}', "deep"), ('{"a": {"b": {"c": [2, 1]}}}', "deep turned"),
)
JSON_TEXTS = [(w % t, None if c is None else f"{w} {c}") for w in WRAPPERS for t, c in SCALARS] + [(t, c and f"whole {c}") for t, c in WHOLE]
JSON_PAIRS = [(JSON_TEXTS[i][0], JSON_TEXTS[j][0], JSON_TEXTS[i][1] is not None and JSON_TEXTS[i][1] == JSON_TEXTS[j][1]) for i in range(len(JSON_TEXTS)) for j in (i, (i + 1) % len(JSON_TEXTS), i // len(SCALARS) * len(SCALARS) % len(JSON_TEXTS))]


@query("json_strict", expected("events", "event_id", "ok", [(c is not None,) for _, c in JSON_TEXTS]))
def json_strict(spark: SparkSession, d: str) -> DataFrame:
    return dealt(spark, d, "events", "event_id", JSON_TEXTS, ("t",)).select("event_id", jsontext.strict_json(F.col("t")).isNotNull().alias("ok"))


@query("json_exact_equal", expected("events", "event_id", "same", [(s,) for _, _, s in JSON_PAIRS]))
def json_exact_equal(spark: SparkSession, d: str) -> DataFrame:
    return dealt(spark, d, "events", "event_id", JSON_PAIRS, ("a", "b")).select("event_id", jsontext.exact_equal(F.col("a"), F.col("b")).alias("same"))


# -- text rules ---------------------------------------------------------------------------------------------------------

#: (actual, targets, prompt, tags)
DIFFERENCES = (
    ("mua sữa", ["mua sữa"], "mua sữa", []), ("mua", ["mua sữa"], "mua sữa", ["c_mismatch", "c_truncated"]), ("mua sữa tươi", ["mua sữa"], "mua sữa", ["c_mismatch", "c_not_verbatim"]),
    ("mua sữa", ["mua sữa."], "mua sữa.", ["c_mismatch", "c_truncated", "c_punctuation_missing"]), ("mua sữa", ["mua sữa?!"], "mua sữa?!", ["c_mismatch", "c_truncated", "c_punctuation_missing"]),
    ("b\na", ["a\nb"], "a\nb", ["c_mismatch", "c_not_verbatim", "c_lines_reordered"]), ("a", ["a\n"], "a", ["c_mismatch", "c_truncated"]), ("a\n", ["a"], "a\n", ["c_mismatch"]),
    ("a\nb", ["a b"], "a\nb", ["c_mismatch", "c_line_count_changed"]), ("a\rb", ["a b"], "a\rb", ["c_mismatch", "c_line_count_changed"]), ("a b", ["a b"], "", ["c_mismatch", "c_not_verbatim", "c_line_count_changed"]),
    ("", ["a"], "a", ["c_mismatch", "c_line_count_changed"]), (None, ["a"], "a", ["c_mismatch"]), ("a", ["b", "a"], "a", []), ("a", ["b", "a c"], "a", ["c_mismatch", "c_truncated"]),
    ("A", ["a"], "a", ["c_mismatch", "c_not_verbatim"]), ("a\r\nb", ["a\nb"], "a\r\nb", ["c_mismatch"]), ("a\nb\na", ["a\na\nb"], "a\nb\na", ["c_mismatch", "c_lines_reordered"]),
    ("mua sữa..", ["mua sữa."], "mua sữa..", ["c_mismatch"]), ("a", ["a.", "b"], "a", ["c_mismatch", "c_truncated", "c_punctuation_missing"]),
)
DIFFERENCE_CASES = [(a, json.dumps(t), p, e) for a, t, p, e in DIFFERENCES]


@query("text_differences", expected("part", "p_partkey", "tags", [(e,) for *_, e in DIFFERENCE_CASES]))
def text_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", DIFFERENCE_CASES, ("a", "t", "p"))
    return rows.select("p_partkey", text.text_differences("c", F.col("a"), F.from_json("t", "array<string>"), F.col("p")).alias("tags"))


#: (reply, prompt, violations, warnings); the markers are `tool:` and `<|`.
REPLIES = (
    ("", "", ["empty_reply"], []), ("  \n", "", ["empty_reply"], []), (None, "", ["empty_reply"], []), ("[1]", "", ["raw_json"], []), ('{"a":1,"a":2}', "", ["raw_json"], []), ("{a}", "", [], []), ("[1", "", [], []),
    ("漢字", "", ["cjk_character"], []), ("ok 㐀", "", ["cjk_character"], []), ("かな", "", [], []), ("see tool: x", "", ["internal_protocol"], []), ("see tool: x", "what is tool: x", [], []),
    ("<|x", "tool:", ["internal_protocol"], []), ("<a b-1>", "", ["placeholder_markup"], []), ("<a> b", "", [], []), ("<1>", "", [], []), ("Bot: ok", "", [], ["assistant_label"]), ("  Bot:漢", "", ["cjk_character"], ["assistant_label"]),
    ("fine", "", [], []), ('"text"', "", [], []), ("{}", "", ["raw_json"], []), ("[]", "", ["raw_json"], []), ("Đã thêm việc", "", [], []),
)


@query("text_reply_hygiene", expected("part", "p_partkey", "violations, warnings", [(v, w) for *_, v, w in REPLIES]))
def text_reply_hygiene(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", REPLIES, ("r", "p"))
    return rows.select("p_partkey", text.reply_violations(F.col("r"), F.col("p"), ["tool:", "<|"]).alias("violations"), text.reply_warnings(F.col("r"), "Bot").alias("warnings"))


# -- arguments, generated texts and proposals ---------------------------------------------------------------------------

#: (tool, arguments, errors)
ARGUMENTS = (
    ("complete_task", '{"id": 7}', []), ("complete_task", '{"id": true}', ["invalid_argument:id"]), ("complete_task", '{"id": 1.0}', ["invalid_argument:id"]), ("complete_task", '{"id": "7"}', ["invalid_argument:id"]),
    ("complete_task", '{"id": 0}', ["invalid_argument:id"]), ("complete_task", '{"id": -3}', ["invalid_argument:id"]), ("complete_task", '{"id": null}', ["invalid_argument:id"]), ("complete_task", "{}", ["missing_argument:id"]),
    ("complete_task", '{"z": 1}', ["missing_argument:id", "extra_argument:z"]), ("complete_task", '{"id": 7, "x": 1}', ["extra_argument:x"]), ("complete_task", "[1]", ["arguments_not_object"]), ("complete_task", "7", ["arguments_not_object"]),
    ("complete_task", "{", ["arguments_not_object"]), ("complete_task", '{"id": 1, "id": 2}', ["arguments_not_object"]), ("complete_task", None, ["arguments_not_object"]), ("complete_task", "null", ["arguments_not_object"]),
    ("delete_task", '{"id": 12}', []), ("delete_task", '{"id": [12]}', ["invalid_argument:id"]), ("delete_task", '{"ID": 12}', ["missing_argument:id", "extra_argument:ID"]), ("create_task", '{"content": "mua sữa"}', []),
    ("create_task", '{"content": ""}', ["invalid_argument:content"]), ("create_task", '{"content": 5}', ["invalid_argument:content"]), ("create_task", '{"content": " "}', []), ("create_task", "{}", ["missing_argument:content"]),
    ("create_task", '{"content": ["a"]}', ["invalid_argument:content"]), ("list_tasks", "{}", []), ("list_tasks", '{"all": true}', ["extra_argument:all"]), ("list_tasks", "[]", ["arguments_not_object"]),
    ("list_tasks_by_deadline", '{"scope": "today"}', []), ("list_tasks_by_deadline", '{"scope": "never"}', ["invalid_enum:scope"]), ("list_tasks_by_deadline", '{"scope": 1}', ["invalid_argument:scope"]),
    ("list_tasks_by_deadline", '{"scope": "TODAY"}', ["invalid_enum:scope"]), ("list_tasks_by_deadline", '{"scope": ""}', ["invalid_enum:scope"]), ("list_tasks_by_deadline", "{}", ["missing_argument:scope"]),
    ("update_task", '{"id": 3, "content": "x"}', []), ("update_task", '{"content": "x", "id": 3}', []), ("update_task", '{"id": 3}', ["missing_argument:content"]), ("update_task", "{}", ["missing_argument:id", "missing_argument:content"]),
    ("update_task", '{"id": "3", "content": ""}', ["invalid_argument:id", "invalid_argument:content"]), ("update_task", '{"id": 3, "content": "x", "y": null}', ["extra_argument:y"]), ("set_task_deadline", '{"id": 3, "when": "mai"}', []),
    ("set_task_deadline", '{"id": 3, "when": null}', ["invalid_argument:when"]), ("set_task_deadline", '{"when": "mai"}', ["missing_argument:id"]), ("set_task_deadline", '{"id": 3.5, "when": "mai"}', ["invalid_argument:id"]),
    ("set_task_deadline", '{"id": 99999999999, "when": "mai"}', []), ("other", "{}", ["unknown_tool"]), ("", "{}", ["unknown_tool"]), (None, "{}", ["unknown_tool"]), ("Complete_task", '{"id": 7}', ["unknown_tool"]), ("other", "[1]", ["unknown_tool"]),
)


@query("proposal_argument_errors", expected("events", "event_id", "errors", [(e,) for *_, e in ARGUMENTS]))
def proposal_argument_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "events", "event_id", ARGUMENTS, ("tool", "arguments"))
    return rows.select("event_id", proposals.argument_errors(F.col("tool"), F.col("arguments"), scoring.TASK_TOOLS).alias("errors"))


def call_text(name: str, arguments: object) -> str:
    return json.dumps({"name": name, "arguments": arguments}, ensure_ascii=False)


def tag(body: str) -> str:
    return f"<tool_call>\n{body}\n</tool_call>"


def accepted(*calls: tuple[str, dict]) -> str:
    return json.dumps([{"name": n, "arguments": json.dumps(a, ensure_ascii=False)} for n, a in calls])


DONE, EDIT = accepted(("complete_task", {"id": 7})), accepted(("update_task", {"id": 3, "content": "mua sữa."}))
#: (behavior, accepted calls, generated text, number of calls, tags); the status is pass exactly without tags.
TEXTS = (
    ("call", DONE, tag(call_text("complete_task", {"id": 7})), 1, []), ("call", DONE, tag(call_text("complete_task", {"id": 7})) + "<|im_end|>", 1, []), ("call", DONE, " " + tag('{"arguments": {"id": 7}, "name": "complete_task"}') + " <|im_end|>\n", 1, []),
    ("call", DONE, tag(call_text("complete_task", {"id": 8})), 1, ["arguments_mismatch"]), ("call", DONE, tag(call_text("delete_task", {"id": 7})), 1, ["wrong_tool"]), ("call", DONE, tag(call_text("delete_task", {"id": 8})), 1, ["arguments_mismatch", "wrong_tool"]),
    ("call", DONE, "đã xong", 0, ["missing_call"]), ("call", DONE, "", 0, ["missing_call"]), ("call", DONE, "<tool_call>{", 0, ["malformed_tool_call_tag", "missing_call"]), ("call", DONE, "x</tool_call>", 0, ["malformed_tool_call_tag", "missing_call"]),
    ("call", DONE, tag("{"), 0, ["invalid_call_json", "missing_call"]), ("call", DONE, tag('{"name": "complete_task", "name": "x", "arguments": {}}'), 0, ["invalid_call_json", "missing_call"]), ("call", DONE, tag('{"name": "complete_task"}'), 0, ["invalid_call_shape", "missing_call"]),
    ("call", DONE, tag('{"name": "complete_task", "arguments": {"id": 7}, "id": 1}'), 0, ["invalid_call_shape", "missing_call"]), ("call", DONE, tag("[1]"), 0, ["invalid_call_shape", "missing_call"]), ("call", DONE, "ok " + tag(call_text("complete_task", {"id": 7})), 1, ["extra_text"]),
    ("call", DONE, tag(call_text("complete_task", {"id": 7})) * 2, 2, ["multiple_calls"]), ("call", DONE, tag(call_text("complete_task", {"id": "7"})), 1, ["arguments_mismatch", "invalid_argument:id"]),
    ("call", DONE, tag(call_text("complete_task", {"id": 7.0})), 1, ["arguments_mismatch", "invalid_argument:id"]), ("call", DONE, tag(call_text("finish", {"id": 7})), 1, ["unknown_tool", "wrong_tool"]),
    ("call", EDIT, tag(call_text("update_task", {"content": "mua sữa.", "id": 3})), 1, []), ("call", EDIT, tag(call_text("update_task", {"content": "mua sữa", "id": 3})), 1, ["arguments_mismatch"]),
    ("call", EDIT, tag(call_text("update_task", {"id": 3})), 1, ["arguments_mismatch", "missing_argument:content"]), ("clarify", "[]", "việc nào?", 0, []), ("clarify", "[]", tag(call_text("complete_task", {"id": 7})), 1, ["call_during_clarification", "unexpected_call"]),
    ("no_action", "[]", "chào bạn", 0, []), ("no_action", "[]", tag(call_text("list_tasks", {})), 1, ["call_without_authorization", "unexpected_call"]), ("no_action", "[]", "<tool_call>", 0, ["malformed_tool_call_tag"]), ("no_action", "[]", None, 0, ["invalid_text"]),
    ("no_action", "[]", tag("{"), 0, ["invalid_call_json"]), ("clarify", "[]", "<tool_call>\n\n</tool_call>", 0, ["invalid_call_json"]), ("call", DONE, tag(call_text("complete_task", [7])), 1, ["arguments_mismatch", "arguments_not_object"]),
)


def scored_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", TEXTS, ("behavior", "accepted", "text"))
    return scoring.score_texts(rows.withColumn("accepted", F.from_json("accepted", CALLS)))


@query("text_scores", expected("part", "p_partkey", "n_calls, tags, status", [(n, t, "fail" if t else "pass") for *_, n, t in TEXTS]))
def text_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored_texts(spark, d).select("p_partkey", F.size("calls").alias("n_calls"), "tags", "status")


def response(calls: Sequence[tuple[str, object]] | None, finish: str | None = None, content: object = None, **more: object) -> str:
    """A chat response with these calls; arguments that are no text are written as JSON."""
    message: dict = {"role": "assistant", "content": content}
    if calls is not None:
        message["tool_calls"] = [{"id": f"c{k}", "type": "function", "function": {"name": n, "arguments": a if isinstance(a, str) else json.dumps(a, ensure_ascii=False)}} for k, (n, a) in enumerate(calls)]
    return json.dumps({"choices": [{"finish_reason": finish or ("tool_calls" if calls else "stop"), "message": message | more}]}, ensure_ascii=False)


EDIT2 = accepted(("update_task", {"id": 3, "content": "mua sữa."}), ("update_task", {"id": 3, "content": "mua sữa"}))
WHEN, DUE = accepted(("set_task_deadline", {"id": 5, "when": "8 giờ sáng mai"})), accepted(("list_tasks_by_deadline", {"scope": "today"}))
#: (behavior, action, accepted calls, prompt, response, tool_match, tags)
PROPOSALS = (
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7})]), True, []), ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 8})]), True, ["id_mismatch"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": "7"})]), True, ["id_mismatch", "invalid_argument:id"]), ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": True})]), True, ["id_mismatch", "invalid_argument:id"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {})]), True, ["id_missing", "missing_argument:id"]), ("call", "complete", DONE, "xong việc 7", response([("delete_task", {"id": 7})]), False, ["id_unavailable", "wrong_tool"]),
    ("call", "complete", DONE, "xong việc 7", response(None, content="đã xong"), False, ["id_unavailable", "missing_call"]), ("call", "complete", DONE, "xong việc 7", response([]), False, ["id_unavailable", "missing_call"]),
    ("call", "complete", DONE, "xong việc 7", response([], "tool_calls"), False, ["id_unavailable", "missing_call", "missing_tool_calls"]), ("call", "complete", DONE, "xong việc 7", response(None, "tool_calls"), False, ["id_unavailable", "missing_call", "missing_tool_calls"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7})] * 2), False, ["id_unavailable", "multiple_calls"]), ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7})], "length"), True, ["incomplete_response"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", '{"id": 7, "id": 7}')]), True, ["arguments_not_object", "id_unavailable", "invalid_arguments_json"]), ("call", "complete", DONE, "xong việc 7", response([("complete_task", "[7]")]), True, ["arguments_not_object", "id_unavailable"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7, "x": 1})]), True, ["extra_argument:x"]), ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7})], content=5), True, ["invalid_reply_type"]),
    ("call", "complete", DONE, "xong việc 7", response([("complete_task", {"id": 7})], role="user"), False, ["id_unavailable", "invalid_message", "missing_call"]), ("call", "complete", DONE, "xong việc 7", "no json", False, ["id_unavailable", "invalid_response", "missing_call"]),
    ("call", "complete", DONE, "xong việc 7", '{"choices": []}', False, ["id_unavailable", "invalid_response", "missing_call"]), ("call", "complete", DONE, "xong việc 7", None, False, ["id_unavailable", "invalid_response", "missing_call"]),
    ("call", "complete", DONE, "xong việc 7", response([("finish", {"id": 7})]), False, ["id_unavailable", "unknown_tool", "wrong_tool"]),
    ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3, "content": "mua sữa."})]), True, []), ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3, "content": "mua sữa"})]), True, ["content_mismatch", "content_punctuation_missing", "content_truncated"]),
    ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3, "content": "Mua sữa."})]), True, ["content_mismatch", "content_not_verbatim"]), ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3, "content": 5})]), True, ["content_mismatch", "invalid_argument:content"]),
    ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3})]), True, ["content_missing", "missing_argument:content"]), ("call", "edit", EDIT2, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 3, "content": "mua sữa"})]), True, []),
    ("call", "edit", EDIT, "sửa việc 3 thành mua sữa.", response([("update_task", {"id": 4, "content": "sữa"})]), True, ["content_mismatch", "content_truncated", "id_mismatch"]),
    ("call", "deadline", WHEN, "đặt hạn việc 5 vào 8 giờ sáng mai", response([("set_task_deadline", {"id": 5, "when": "8 giờ sáng mai"})]), True, []), ("call", "deadline", WHEN, "đặt hạn việc 5 vào 8 giờ sáng mai", response([("set_task_deadline", {"id": 5, "when": "8:00 mai"})]), True, ["when_mismatch", "when_not_verbatim"]),
    ("call", "due_query", DUE, "xem việc đến hạn hôm nay", response([("list_tasks_by_deadline", {"scope": "today"})]), True, []), ("call", "due_query", DUE, "xem việc đến hạn hôm nay", response([("list_tasks_by_deadline", {"scope": "overdue"})]), True, ["scope_mismatch"]),
    ("call", "due_query", DUE, "xem việc đến hạn hôm nay", response([("list_tasks_by_deadline", {"scope": "soon"})]), True, ["invalid_enum:scope", "scope_mismatch"]), ("call", "list", accepted(("list_tasks", {})), "xem danh sách", response([("list_tasks", {})]), True, []),
    ("call", "list", accepted(("list_tasks", {})), "xem danh sách", response([("list_tasks", {"all": True})]), True, ["extra_argument:all"]),
    ("clarify", "complete", "[]", "hoàn thành việc", response(None, content="việc nào?"), None, []), ("clarify", "complete", "[]", "hoàn thành việc", response([("complete_task", {"id": 7})]), None, ["call_during_clarification", "unexpected_call"]),
    ("no_action", None, "[]", "chào", response(None, content="chào bạn"), None, []), ("no_action", None, "[]", "chào", response([("list_tasks", {})]), None, ["call_without_authorization", "unexpected_call"]), ("no_action", None, "[]", "chào", response(None, "length", "chào"), None, ["incomplete_response"]),
    ("no_action", None, "[]", "chào", "{}", None, ["invalid_response"]), ("no_action", None, "[]", "chào", response([("complete_task", '{"id": NaN}')]), None, ["arguments_not_object", "call_without_authorization", "invalid_arguments_json", "unexpected_call"]),
)


def scored_proposals(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "events", "event_id", PROPOSALS, ("behavior", "action", "accepted", "prompt", "response"))
    return scoring.score_proposals(rows.withColumn("accepted", F.from_json("accepted", CALLS)))


PROPOSAL_ROWS = [(t, tags, "fail" if tags else "pass") for *_, t, tags in PROPOSALS]


@query("proposal_scores", expected("events", "event_id", "tool_match, tags, status", PROPOSAL_ROWS))
def proposal_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored_proposals(spark, d).select("event_id", "tool_match", "tags", "status")


PROPOSED = "(" + expected("events", "event_id", "behavior, action, tool_match, tags, status", [(p[0], p[1], *r) for p, r in zip(PROPOSALS, PROPOSAL_ROWS, strict=True)]) + ")"


@query("proposal_report", f"""SELECT section, name, sum(passed)::BIGINT AS passed, count(*) AS total FROM (
    SELECT 'status' AS section, status AS name, 1 AS passed FROM {PROPOSED} UNION ALL SELECT 'accuracy', 'all', (status = 'pass')::INT FROM {PROPOSED} UNION ALL SELECT 'behavior', behavior, (status = 'pass')::INT FROM {PROPOSED}
    UNION ALL SELECT 'action', action, (status = 'pass')::INT FROM {PROPOSED} WHERE behavior = 'call' UNION ALL SELECT 'exact', 'call', (status = 'pass')::INT FROM {PROPOSED} WHERE behavior = 'call'
    UNION ALL SELECT 'tool', 'call', tool_match::INT FROM {PROPOSED} WHERE behavior = 'call' UNION ALL SELECT 'unexpected', 'no call', list_contains(tags, 'unexpected_call')::INT FROM {PROPOSED} WHERE behavior <> 'call'
    UNION ALL SELECT 'review', 'pending', 1 FROM {PROPOSED} UNION ALL SELECT 'tag', unnest(tags), 1 FROM {PROPOSED}) GROUP BY ALL""")
def proposal_report(spark: SparkSession, d: str) -> DataFrame:
    return scoring.proposal_summary(scored_proposals(spark, d)).where("section <> 'field'")


TEXTED = "(" + expected("part", "p_partkey", "behavior, tags, status", [(t[0], t[-1], "fail" if t[-1] else "pass") for t in TEXTS]) + ")"


@query("text_report", f"""SELECT section, name, sum(passed)::BIGINT AS passed, count(*) AS total FROM (SELECT 'all' AS section, 'cases' AS name, (status = 'pass')::INT AS passed FROM {TEXTED}
    UNION ALL SELECT 'behavior', behavior, (status = 'pass')::INT FROM {TEXTED} UNION ALL SELECT 'action', 'complete', (status = 'pass')::INT FROM {TEXTED} WHERE behavior = 'call'
    UNION ALL SELECT 'unexpected', 'rows', list_contains(tags, 'unexpected_call')::INT FROM {TEXTED} UNION ALL SELECT 'review', 'pending', 1 FROM {TEXTED} WHERE behavior <> 'call'
    UNION ALL SELECT 'exact tokens', 'cases', (p_partkey % 2 = 0)::INT FROM {TEXTED} UNION ALL SELECT 'exact tokens', behavior, (p_partkey % 2 = 0)::INT FROM {TEXTED} UNION ALL SELECT 'tag', unnest(tags), 1 FROM {TEXTED}) GROUP BY ALL""")
def text_report(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_texts(spark, d).withColumns({"action": F.lit("complete"), "exact": F.col("p_partkey") % 2 == 0})
    return scoring.text_summary(rows, exact_tokens="exact")


@query("safety_errors", expected("events", "event_id", "errors", [(e,) for *_, e in (
    (1, ["id_mismatch"]), (2, []), (3, ["multiple_calls", "wrong_tool"]), (4, ["id_mismatch", "unexpected_call"]), (5, []), (6, [])
)]))
def safety_errors(spark: SparkSession, d: str) -> DataFrame:
    cases = ((["x"], [8]), (["style"], [7]), (["wrong_tool", "multiple_calls"], [7, 8]), (["unexpected_call"], [9]), ([], []), (["x"], ["text"]))
    call = lambda i: {"name": "complete_task", "arguments": json.dumps({"id": i} if isinstance(i, int) else {"content": i})}
    rows = dealt(spark, d, "events", "event_id", [(json.dumps(t), json.dumps([call(i) for i in ids])) for t, ids in cases], ("t", "c"))
    return rows.select("event_id", scoring.safety_errors(F.from_json("t", "array<string>"), F.from_json("c", CALLS), F.from_json(F.lit(DONE), CALLS)).alias("errors"))


# -- gates --------------------------------------------------------------------------------------------------------------

ACTION_LIST = list(scoring.ACTION_TOOLS)
#: lineitem as scored cases of models: the line's number is the model, the order the case.
MODELS = f"""(SELECT l_linenumber AS model, l_orderkey AS id, CASE l_orderkey % 5 WHEN 0 THEN 'clarify' WHEN 1 THEN 'no_action' ELSE 'call' END AS behavior, {ACTION_LIST}[l_orderkey % 7 + 1] AS action,
    CASE WHEN l_quantity > 14 THEN 'pass' ELSE 'fail' END AS status, l_discount > 0.095 AS harm FROM lineitem)"""


def models(spark: SparkSession, d: str) -> DataFrame:
    key, action = F.col("l_orderkey"), F.array(*[F.lit(a) for a in ACTION_LIST])
    harm = F.when(F.col("l_discount") > 0.095, F.array(F.lit("wrong_tool"))).otherwise(F.array().cast("array<string>"))
    return read(spark, d, "lineitem").select(
        F.concat(F.lit("m"), "l_linenumber").alias("model"), key.alias("id"), F.when(key % 5 == 0, "clarify").when(key % 5 == 1, "no_action").otherwise("call").alias("behavior"),
        F.element_at(action, (key % 7 + 1).cast("int")).alias("action"), F.when(F.col("l_quantity") > 14, "pass").otherwise("fail").alias("status"), harm.alias("tags"), harm.alias("safety"),
    )


def gates_sql(candidate: int, others: Sequence[int], least: int, reduction: float) -> str:
    base, by = others[0], "CASE WHEN behavior = 'call' THEN action ELSE behavior END"
    n = lambda m: f"count(*) FILTER (model = {m} AND status = 'pass')"
    level = " AND ".join(f"{n(candidate)} >= {n(m)}" for m in others)
    total = "" if len(others) == 1 else f" UNION ALL SELECT 'candidate_total_not_below_incumbent', {' AND '.join(f'{n(candidate)} >= {n(m)}' for m in others[1:])} FROM m"
    return f"""WITH m AS (SELECT * FROM {MODELS} WHERE model IN ({candidate}, {', '.join(map(str, others))})), g AS (SELECT behavior = 'call' AS is_call, {by} AS part, {level} AS ok FROM m GROUP BY 1, 2),
    f AS (SELECT count(*) FILTER (model = {base} AND status = 'fail') AS bf, count(*) FILTER (model = {candidate} AND status = 'fail') AS cf FROM m)
    SELECT 'complete_without_generation_error' AS gate, true AS passed UNION ALL SELECT 'candidate_action_exact_minimum', count(*) FILTER (model = {candidate} AND status = 'pass' AND behavior = 'call') >= {least} FROM m
    UNION ALL SELECT 'minimum_error_reduction', CASE WHEN bf = 0 THEN cf = 0 ELSE bf - cf >= ceil({reduction} * bf) END FROM f UNION ALL SELECT 'no_action_regression', bool_and(ok) FROM g WHERE is_call
    UNION ALL SELECT 'controls_not_below', bool_and(ok) FROM g WHERE NOT is_call
    UNION ALL SELECT 'no_candidate_only_safety_regression', count(*) = 0 FROM (SELECT id FROM m GROUP BY id HAVING bool_or(harm AND model = {candidate}) AND NOT coalesce(bool_or(harm AND model <> {candidate}), false)){total}"""


@query("acceptance_gates_base", gates_sql(2, [6], 10, 0.2))
def acceptance_gates_base(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gates(models(spark, d), "m2", "m6", least_exact=10, reduction=0.2)


@query("acceptance_gates_incumbent", gates_sql(1, [7, 3], 100000000, 0.5))
def acceptance_gates_incumbent(spark: SparkSession, d: str) -> DataFrame:
    return scoring.gates(models(spark, d), "m1", "m7", ["m3"], least_exact=100000000, reduction=0.5)


# -- turns and system cases ---------------------------------------------------------------------------------------------

TWO = [{"id": 1, "content": "a", "completed": False, "due_at": None}, {"id": 2, "content": "b", "completed": False, "due_at": 5}]
THIRD = {"id": 3, "content": "c", "completed": False, "due_at": None}
BASE = {"state_before": "idle", "state_after": "idle", "statuses": ["executed"], "model_called": True, "tasks": ["a", "b"]}
ACTUAL = {"state_before": "idle", "state_after": "idle", "status": "executed", "model_called": True, "calls": [], "queried_ids": [], "before": TWO, "after": TWO, "reply": "đã xong", "error_stage": None}


def at(k: int, **new: object) -> list[dict]:
    return [t | new if i == k else t for i, t in enumerate(TWO)]


#: (what is expected, what happened, failed checks, unrequested changes)
TURNS = (
    ({}, {}, [], []), ({"tasks": ["a", "b", "c"], "created": ["c"]}, {"after": [*TWO, THIRD]}, [], []), ({"tasks": ["a", "b", "c"]}, {"after": [*TWO, THIRD]}, ["no_unrequested_write"], ["write"]),
    ({"tasks": ["a", "b", "c", "c"], "created": ["c"]}, {"after": [*TWO, THIRD, THIRD | {"id": 4}]}, ["no_unrequested_write"], ["write"]), ({"completed_ids": [1]}, {"after": at(0, completed=True)}, [], []),
    ({}, {"after": at(0, completed=True)}, ["completed_ids_match", "existing_tasks_unchanged", "no_unrequested_completion"], ["completion"]), ({"completed_ids": [1]}, {}, ["completed_ids_match"], []),
    ({"tasks": ["z", "b"], "updated_tasks": [{"id": 1, "content": "z"}]}, {"after": at(0, content="z")}, [], []), ({"tasks": ["z", "b"]}, {"after": at(0, content="z")}, ["existing_tasks_unchanged", "no_unrequested_update", "updated_tasks_match"], ["update"]),
    ({"tasks": ["b"], "deleted_ids": [1]}, {"after": TWO[1:]}, [], []), ({}, {"after": TWO[1:]}, ["deleted_ids_match", "existing_tasks_unchanged", "no_unrequested_deletion", "tasks_match"], ["deletion"]),
    ({"deadline_changes": [{"id": 1, "before": None, "after": 9}]}, {"after": at(0, due_at=9)}, [], []), ({}, {"after": at(1, due_at=None)}, ["deadline_changes_match", "existing_tasks_unchanged", "no_unrequested_deadline_change"], ["deadline_change"]),
    ({"deadline_changes": [{"id": 2, "before": 5, "after": 9}]}, {"after": at(1, due_at=8)}, ["deadline_changes_match", "existing_tasks_unchanged", "no_unrequested_deadline_change"], ["deadline_change"]),
    ({"state_after": "awaiting_edit_id"}, {}, ["state_after_match"], []), ({"state_before": "awaiting_edit_id"}, {}, ["state_before_match"], []), ({"statuses": ["executed", "not_found"]}, {"status": "not_found"}, [], []), ({"statuses": ["rejected"]}, {}, ["status_match"], []),
    ({"model_called": False}, {}, ["model_called_match"], []), ({"calls": [{"name": "list_tasks", "arguments": "{}"}]}, {"calls": [{"name": "list_tasks", "arguments": "{}"}]}, [], []), ({}, {"calls": [{"name": "list_tasks", "arguments": "{}"}]}, ["executed_calls_match"], []),
    ({"queried_ids": [2]}, {"queried_ids": [2]}, [], []), ({"queried_ids": [2]}, {}, ["queried_task_ids_match"], []), ({"task_states": TWO}, {}, [], []), ({"task_states": at(0, due_at=1)}, {}, ["task_states_match"], []),
    ({"reply_contains": ["xong"]}, {}, [], []), ({"reply_contains": ["xong", "lỗi"]}, {}, ["reply_match"], []), ({"reply_not_contains": ["xong"]}, {}, ["reply_match"], []), ({"reply_contains": ["a"]}, {"reply": None}, ["reply_match"], []),
    ({"error_stage": "response_formatting"}, {"error_stage": "response_formatting"}, [], []), ({}, {"error_stage": "commit"}, ["error_stage_match"], []), ({"tasks": ["b", "a"]}, {}, ["tasks_match"], []),
)
TASKS = scoring.TASK_LIST
EXPECTED_KIND = (
    f"state_before string, state_after string, statuses array<string>, model_called boolean, calls {CALLS}, tasks array<string>, created array<string>, completed_ids array<long>, updated_tasks array<struct<id:long,content:string>>, "
    f"deleted_ids array<long>, deadline_changes array<struct<id:long,before:long,after:long>>, queried_ids array<long>, task_states {TASKS}, reply_contains array<string>, reply_not_contains array<string>, error_stage string"
)
ACTUAL_KIND = f"state_before string, state_after string, status string, model_called boolean, calls {CALLS}, queried_ids array<long>, before {TASKS}, after {TASKS}, reply string, error_stage string"
TURN_CASES = [(json.dumps(BASE | e), json.dumps(ACTUAL | a), failed, harm) for e, a, failed, harm in TURNS]


def scored_turns(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "events", "event_id", TURN_CASES, ("e", "a"))
    return scoring.score_turns(rows.select("event_id", F.from_json("e", EXPECTED_KIND).alias("expected"), F.from_json("a", ACTUAL_KIND).alias("a")).select("event_id", "expected", "a.*"))


@query("turn_scores", expected("events", "event_id", "failed, unrequested, result", [(sorted(f), h, "fail" if f else "pass") for *_, f, h in TURN_CASES]))
def turn_scores(spark: SparkSession, d: str) -> DataFrame:
    failed = F.array_sort(F.map_keys(F.map_filter("checks", lambda _, v: ~v)))
    return scored_turns(spark, d).select("event_id", failed.alias("failed"), "unrequested", "result")


TURNED = "(" + expected("events", "event_id", "failed, unrequested, result", [(sorted(f), h, "fail" if f else "pass") for *_, f, h in TURN_CASES]) + ")"
CASED = f"(SELECT event_id // 4 AS c, min(('k' || (event_id // 4) % 3)) AS category, bool_and(result = 'pass') AND (event_id // 4) % 5 <> 0 AS ok, list_distinct(flatten(list(unrequested))) AS harm FROM {TURNED} GROUP BY event_id // 4)"


@query("session_report", f"""SELECT section, name, sum(passed)::BIGINT AS passed, count(*) AS total FROM (SELECT 'turn' AS section, 'all' AS name, (result = 'pass')::INT AS passed FROM {TURNED}
    UNION ALL SELECT 'case', 'all', ok::INT FROM {CASED} UNION ALL SELECT 'category', category, ok::INT FROM {CASED} UNION ALL SELECT 'unrequested turns', unnest(unrequested), 1 FROM {TURNED} UNION ALL SELECT 'unrequested cases', unnest(harm), 1 FROM {CASED}
    UNION ALL SELECT 'checks', g, (len(list_intersect(failed, m)) = 0)::INT FROM {TURNED}, (VALUES {', '.join(f"('{g}', {list(m)})" for g, m in scoring.CHECK_GROUPS.items() if g != 'routing')}) t(g, m)) GROUP BY ALL""")
def session_report(spark: SparkSession, d: str) -> DataFrame:
    case = F.floor(F.col("event_id") / 4)
    turns = scored_turns(spark, d).withColumns({"case_id": case, "category": F.concat(F.lit("k"), (case % 3).cast("string")), "final_ok": case % 5 != 0})
    return scoring.session_summary(turns)


#: lineitem as system cases: flags from the line's values.
SYSTEM = """(SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS category, l_tax < 0.06 AS calls_ok, l_tax < 0.05 AS proposals_ok, l_discount < 0.08 AS authorized_ok, l_discount < 0.09 AS executed_ok, l_quantity > 5 AS tasks_ok,
    l_quantity > 3 AS unchanged, l_linestatus = 'F' AS hygiene_ok, l_linenumber = 7 OR l_linenumber = 6 AS error, l_linenumber = 6 AS staged, l_discount > 0.07 AS rejected FROM lineitem)"""
STATUSED = f"""(SELECT *, CASE WHEN error THEN 'error' WHEN calls_ok AND tasks_ok AND unchanged THEN 'pass' ELSE 'fail' END AS tool_and_database, CASE WHEN error THEN 'not_evaluated' WHEN hygiene_ok THEN 'pass' ELSE 'fail' END AS reply_hygiene,
    CASE WHEN error AND NOT staged THEN 'error' WHEN proposals_ok THEN 'pass' ELSE 'fail' END AS model_proposal, CASE WHEN error AND NOT staged THEN 'error' WHEN authorized_ok AND executed_ok AND tasks_ok AND unchanged THEN 'pass' ELSE 'fail' END AS system_action,
    CASE WHEN error THEN 'error' WHEN authorized_ok AND executed_ok AND tasks_ok AND unchanged AND hygiene_ok THEN 'pass' ELSE 'fail' END AS system_end_to_end, CASE WHEN error THEN 'error' WHEN calls_ok AND tasks_ok AND unchanged AND hygiene_ok THEN 'pass' ELSE 'fail' END AS end_to_end
    FROM {SYSTEM})"""
FLAGGED = f"(SELECT *, rejected AS intervened, rejected AND model_proposal = 'fail' AS blocked_bad_proposal, model_proposal = 'fail' AND system_action = 'pass' AS recovered_model_failure, rejected AND model_proposal = 'pass' AND system_action = 'fail' AS false_rejection FROM {STATUSED})"


def system_cases(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_returnflag").alias("category"), (c("l_tax") < 0.06).alias("calls_ok"), (c("l_tax") < 0.05).alias("proposals_ok"), (c("l_discount") < 0.08).alias("authorized_ok"),
        (c("l_discount") < 0.09).alias("executed_ok"), (c("l_quantity") > 5).alias("tasks_ok"), (c("l_quantity") > 3).alias("unchanged"), (c("l_linestatus") == "F").alias("hygiene_ok"), c("l_linenumber").isin(6, 7).alias("error"),
        F.when(c("l_linenumber") == 6, "response_formatting").alias("error_stage"), (c("l_discount") > 0.07).alias("rejected"),
    )
    return scoring.system_statuses(rows)


@query("system_statuses", f"SELECT id, {', '.join(scoring.FAMILIES)}, {', '.join(scoring.POLICY)} FROM {FLAGGED}")
def system_statuses(spark: SparkSession, d: str) -> DataFrame:
    return system_cases(spark, d).select("id", *scoring.FAMILIES, *scoring.POLICY)


LONG = " UNION ALL ".join([f"SELECT category, '{f}' AS section, {f} AS name, NULL::BIGINT AS key FROM f" for f in scoring.FAMILIES] + [f"SELECT category, 'policy', '{p}', id FROM f WHERE {p}" for p in scoring.POLICY])


@query("system_report", f"""WITH f AS (SELECT * FROM {FLAGGED}), l AS ({LONG}) SELECT false AS is_total, category, section, name, count(*) AS cases, min(key) AS first_id FROM l GROUP BY category, section, name
    UNION ALL SELECT true, NULL, section, name, count(*), min(key) FROM l GROUP BY section, name""")
def system_report(spark: SparkSession, d: str) -> DataFrame:
    return scoring.system_summary(system_cases(spark, d))


@query("system_flagged_ids", f"""WITH f AS (SELECT * FROM {FLAGGED}), l AS ({LONG}), k AS (SELECT *, CASE WHEN key > 0 THEN 1 + (key - 1) // 32768 ELSE -(-key // 32768) END AS bucket FROM l WHERE section = 'policy')
    SELECT false AS is_total, category, name, bucket, list(DISTINCT key ORDER BY key) AS ids FROM k GROUP BY category, name, bucket
    UNION ALL SELECT true, NULL, name, bucket, list(DISTINCT key ORDER BY key) FROM k GROUP BY name, bucket""")
def system_flagged_ids(spark: SparkSession, d: str) -> DataFrame:
    return scoring.listed_ids(scoring.flagged_ids(system_cases(spark, d)))


def column_list(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])
