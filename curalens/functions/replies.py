"""Replies to task requests in Vietnamese, as columns over the outcome of a turn, and checks of results before they are told."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .deadlines import format_deadline
from .text import blank, tags

# What is said. %s stand for ids, contents, times and counts, in order.
NO_ACTION, NOT_FOUND = "Không có thao tác nào được thực hiện.", "Không tìm thấy việc có ID đã yêu cầu."
QUESTIONS = {
    "awaiting_create_content": "Bạn muốn thêm việc gì?",
    "awaiting_complete_id": "Bạn muốn hoàn thành việc có ID nào?",
    "awaiting_edit_id": "Bạn muốn sửa việc có ID nào?",
    "awaiting_edit_content": "Bạn muốn đổi nội dung việc %s thành gì?",
    "awaiting_delete_id": "Bạn muốn xóa việc có ID nào?",
    "awaiting_deadline_id": "Bạn muốn đặt hạn cho việc có ID nào?",
    "awaiting_deadline_text": "Bạn muốn đặt thời hạn khi nào? Ví dụ: 8 giờ sáng mai.",
    "awaiting_deadline_scope": "Bạn muốn xem việc đến hạn hôm nay, ngày mai hay đã quá hạn?",
}
CANCELLED = {
    "Đã hủy yêu cầu thêm việc. Không có việc nào được lưu.": ("awaiting_create_content",),
    "Đã hủy yêu cầu hoàn thành việc. Không có thay đổi nào được lưu.": ("awaiting_complete_id",),
    "Đã hủy yêu cầu sửa việc. Không có thay đổi nào được lưu.": ("awaiting_edit_id", "awaiting_edit_content"),
    "Đã hủy yêu cầu đặt thời hạn. Không có thay đổi nào được lưu.": ("awaiting_deadline_id", "awaiting_deadline_text"),
    "Đã hủy yêu cầu xem việc theo hạn.": ("awaiting_deadline_scope",),
    "Đã hủy yêu cầu xóa việc. Không có việc nào bị xóa.": ("awaiting_delete_id", "awaiting_delete_confirmation"),
}
REJECTED = {
    "%s hiện chỉ hỗ trợ thêm, xem, hoàn thành, sửa và xóa việc theo ID; ngoài ra có thể đặt hạn theo ID hoặc xem việc theo hạn.": ("unsupported_action", "unsupported_tool"),
    "Tôi chưa lưu việc vì nội dung không khớp lời bạn. Hãy viết lại yêu cầu.": ("content_not_grounded", "content_boundary_mismatch"),
}
CONFIRM_DELETE = "Bạn có chắc muốn xóa [%s] [%s] %s?"
#: By tool and status: id and content, or id, time and content.
TOLD = {
    ("complete_task", "completed"): "Đã hoàn thành [%s] %s", ("complete_task", "already_completed"): "Việc [%s] đã hoàn thành trước đó: %s",
    ("update_task", "updated"): "Đã sửa [%s] thành: %s", ("update_task", "unchanged"): "Việc [%s] đã có nội dung này: %s", ("delete_task", "deleted"): "Đã xóa [%s] %s",
    ("set_task_deadline", "set"): "Đã đặt hạn [%s] vào %s: %s", ("set_task_deadline", "updated"): "Đã đổi hạn [%s] thành %s: %s",
    ("set_task_deadline", "unchanged"): "Việc [%s] đã có hạn %s: %s",
}
STALE = "Việc [%s] đã thay đổi thành [%s] %s. Hãy xác nhận lại nếu bạn vẫn muốn xóa."
ADDED_ONE, ADDED_LINE, ADDED_MANY = "Đã thêm [%s] %s", "[%s] %s", "Đã thêm %s việc:"
LIST_EMPTY, LIST_HEAD, LIST_LINE, DUE_TAIL = "Danh sách trống.", "Danh sách hiện có %s việc:", "[%s] [%s] %s", " — hạn %s"
SCOPE_LABELS = {"today": "đến hạn hôm nay", "tomorrow": "đến hạn ngày mai", "overdue": "quá hạn"}
DUE_EMPTY, DUE_HEAD = "Không có việc chưa hoàn thành %s.", "Có %s việc chưa hoàn thành %s:"
#: Statuses that each changing tool may return; not_found goes with no task, all others with one.
STATUSES = {
    "complete_task": ("completed", "already_completed", "not_found"), "update_task": ("updated", "unchanged", "not_found"),
    "delete_task": ("deleted", "stale", "not_found"), "set_task_deadline": ("set", "updated", "unchanged", "not_found"),
}


def said(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *[v.cast("string") for v in values])


def marker(task: Column) -> Column:
    return F.when(task["completed"], "x").otherwise(" ")


def due_tail(task: Column) -> Column:
    return F.when(task["due_at"].isNull(), "").otherwise(said(DUE_TAIL, format_deadline(task["due_at"])))


def lines(head: Column, tasks: Column, line: Callable[[Column], Column]) -> Column:
    return F.array_join(F.concat(F.array(head), F.transform(tasks, line)), "\n")


def result_reply(tool: Column, status: Column, scope: Column, task: Column, shown: Column) -> Column:
    """The reply to an executed call: task, the one that it changed; shown, those that it created or lists."""
    n, one = F.size(shown), F.get(shown, F.lit(0))
    full = lambda t: F.concat(said(LIST_LINE, t["id"], marker(t), t["content"]), due_tail(t))
    out = F.when((tool == "create_task") & (n == 1), said(ADDED_ONE, one["id"], one["content"]))
    out = out.when(tool == "create_task", lines(said(ADDED_MANY, n), shown, lambda t: said(ADDED_LINE, t["id"], t["content"])))
    out = out.when((tool == "list_tasks") & (n == 0), LIST_EMPTY).when(tool == "list_tasks", lines(said(LIST_HEAD, n), shown, full))
    for name, label in SCOPE_LABELS.items():
        own = (tool == "list_tasks_by_deadline") & (scope == name)
        out = out.when(own & (n == 0), DUE_EMPTY % label).when(own, lines(said(DUE_HEAD, n, F.lit(label)), shown, full))
    out = out.when(status == "not_found", NOT_FOUND)
    out = out.when((tool == "delete_task") & (status == "stale"), said(STALE, task["id"], marker(task), F.concat(task["content"], due_tail(task))))
    for (name, value), pattern in TOLD.items():
        values = [task["id"], format_deadline(task["due_at"]), task["content"]] if name == "set_task_deadline" else [task["id"], task["content"]]
        out = out.when((tool == name) & (status == value), said(pattern, *values))
    return out


def reply(say: str = "say", tool: str = "tool", status: str = "result", scope: str = "scope", task: str = "task", shown: str = "shown", named: str = "named", assistant: str = "Trợ lý") -> Column:
    """The text of an outcome's code: a question, a cancellation, a rejection, the result of a call, or that nothing was done.
    An error has no reply. assistant: the name by which the assistant speaks of itself."""
    code, one = F.col(say), F.col(task)
    out = F.when(code == "result", result_reply(F.col(tool), F.col(status), F.col(scope), one, F.col(shown)))
    out = out.when(code == "confirm_delete", said(CONFIRM_DELETE, one["id"], marker(one), F.concat(one["content"], due_tail(one)))).when(code == "not_found", NOT_FOUND)
    for state, text in QUESTIONS.items():
        out = out.when(code == state, said(text, F.col(named)) if "%s" in text else F.lit(text))
    for text, states in CANCELLED.items():
        out = out.when(code.isin(*[f"cancelled:{s}" for s in states]), text)
    for text, reasons in REJECTED.items():
        out = out.when(code.isin(*[f"rejected:{r}" for r in reasons]), text.replace("%s", assistant))
    return out.when(code == "error", F.lit(None).cast("string")).otherwise(NO_ACTION)


def task_errors(task: Column) -> Column:
    """What makes a task unfit to be told: a missing or non-positive id, blank content, no completed flag."""
    return tags(
        (F.coalesce(task["id"] <= 0, F.lit(True)), "invalid_id"), (F.coalesce(blank(task["content"]), F.lit(True)), "blank_content"), (task["completed"].isNull(), "invalid_completed")
    )


def result_errors(tool: Column, status: Column, scope: Column, task: Column, shown: Column) -> Column:
    """What makes a call's result unfit to be told; empty if nothing does."""
    none, lists = F.array().cast("array<string>"), ("create_task", "list_tasks", "list_tasks_by_deadline")
    listed = F.array_distinct(F.flatten(F.transform(F.coalesce(shown, F.array().cast(shown_type())), task_errors)))
    out = F.when(~F.coalesce(tool.isin(*lists, *STATUSES), F.lit(False)), F.array(F.lit("unknown_tool")))
    for name, allowed in STATUSES.items():
        own = F.concat(
            tags(
                (~F.coalesce(status.isin(*allowed), F.lit(False)), "unknown_status"), ((status == "not_found") & task.isNotNull(), "task_of_not_found"),
                (status.isin(*[s for s in allowed if s != "not_found"]) & task.isNull(), "missing_task"),
                (task.isNotNull() & (F.lit(name == "complete_task") & ~F.coalesce(task["completed"], F.lit(False))), "not_completed"),
                (task.isNotNull() & F.lit(name == "set_task_deadline") & task["due_at"].isNull(), "missing_due_at"),
            ),
            F.when(task.isNull(), none).otherwise(task_errors(task)),
        )
        out = out.when(tool == name, own)
    bad_due = F.exists(shown, lambda t: t["completed"] | t["due_at"].isNull())
    return out.otherwise(F.concat(
        tags(
            (shown.isNull(), "missing_tasks"), ((tool == "create_task") & (F.size(shown) == 0), "nothing_created"),
            ((tool == "list_tasks_by_deadline") & ~F.coalesce(scope.isin(*SCOPE_LABELS), F.lit(False)), "unknown_scope"),
            ((tool == "list_tasks_by_deadline") & F.coalesce(bad_due, F.lit(False)), "not_due"),
        ),
        listed,
    ))


def shown_type() -> str:
    return "array<struct<id:long,content:string,completed:boolean,due_at:long>>"
