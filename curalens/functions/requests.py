"""Task requests in Vietnamese: what a request asks for, which spans it names, and whether a tool call may serve it.

A request is lexed once (see `lexer`), then read in a few projections over its lexemes and their classes: each fills one struct column per frame (create, complete, edit, ...), with the
outcome of the frame as a reason and the spans that it names. Kind, route and decision are then ordered tables of
(condition, value) over those structs, all inside the engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexer
from .deadlines import parse_deadline
from .lexer import fits, letters_from, reach, span
from .text import id_tokens

#: Letter case is ignored, classes are those of Unicode, and a line feed alone ends a line.
FLAGS = "(?iUd)"
# Frames over the classes of `lexer.VOCABULARY`: what may stand before a command, after it, and what one is about.
ASK, END, REFUSED = "p?", r"(?:hm|e)*\.*$", "^m?x"
THING = "[qn]*t(?:s?,E(?=[:%]|$)|s(?=[:%]|$))?"
CREATE = rf"^(?:p|y|mM)?(?:A|a(?:hm?)?{THING}|ohm?(?:{THING})?|b|(g[qn]*t))(?=[^,;.\-]|\.?$)"
CREATE_GIVEN, CREATE_TAIL = r"vl(?:hm|e)*\.*$", r"^(.*?)((?:vl|hm|e)*)(\.*)$"
CREATE_REFUSED, CHANGE_OF_LIST = r"x\w{0,2}?[aobBHP]", r"[dcku]\w{0,2}?[tlT]"
COMPLETE, COMPLETE_ONE, COMPLETE_TOLD = f"^{ASK}[ck]t", f"^{ASK}(?:ctn|ktnL?[Fc]){END}", r"^mWtnR;U\.*$"
EDIT, EDIT_MORE = f"^{ASK}(?:uN?|O)t", "[,;jR](?:d|a|c|k|SD)"
DELETE, DELETE_ONE, DELETE_TOLD = f"^{ASK}[dBH]t", f"^{ASK}[dB]tn(?:xl)?{END}", r"^Htn;Q\.*$"
DEADLINE, DEADLINE_TASK = f"^{ASK}S[D5]", "^g?(?:tn?)?$"
#: Whole frames of a deadline that name the task first: (what comes before the time)(the time)(what may follow it).
DEADLINE_WHOLE = (
    r"^((?:gm|p)?[SCu][D5][Kg]?tn[:ivLZ])(.+?)((?:,J)?\.*)$", r"^(tn:S[D5])(.+?)(\.*)$", r"^([D5]Ktn,G)(.+?)(\.*)$", r"^(etIn,Y)(.+?)((?:;a)?\.*)$",
)
DUE_WHOLE = (rf"^{ASK}(?:gm)?rq?t(4[12]|3)\.*$", r"^([12])6q?t74\.*$", r"^gm8t7(3)\.*$")
DUE_OPEN = rf"^{ASK}(?:gm)?rq?t[45]\.*$"
LOOK = "(?:[rV]|gm[r8])"
LIST = f"^{ASK}{LOOK}(?:[lT]|qt|t[*])"
LIST_ASKED, LIST_OPENED = r"^>?m6q?[tT]7\w*\.*$", f"^(?:{ASK}{LOOK}|y?V|>?m(?:M?r|9|0r|[*])|[lT]|t|6qt7)"
LIST_REFUSED = (f"{REFUSED}[rV]", "xP", "<x[rV]")
LIST_PARTLY = ("@.*F", "x[rV]q?t!", "[,;jR][duack]")
#: A request about deadlines, and the one that wants the whole list and deadlines beside it.
BY_DUE, ALL_WITH_DUE = "[345]|D[v12]|fv?[12]", r"&[ltT].*\+[5D]|\+[5D].*&[ltT]"
NO_ACTION = r"^(?:p|y)?(?:[dckuO$]\w{0,2}?[tlT]|=)"
REFUSED_COMMAND = rf"{REFUSED}(?:a(?:hm?)?[qn]*t|[rV][lTt])"
SCOPES = ("today", "tomorrow", "overdue")
TOOLS = ("create_task", "list_tasks", "complete_task", "update_task", "delete_task", "set_task_deadline", "list_tasks_by_deadline")
#: The result that each reason belongs to.
RESULTS = {
    "allow": ("explicit_create", "explicit_list", "explicit_complete", "explicit_update", "explicit_deadline", "explicit_deadline_query"),
    "requires_confirmation": ("explicit_delete",),
    "needs_clarification": (
        "missing_content", "missing_task_id", "multiple_task_ids", "missing_update_id", "missing_update_content", "missing_delete_id", "missing_deadline_id",
        "missing_deadline_time", "invalid_deadline_time", "missing_deadline_scope",
    ),
    "reject": (
        "negated_request", "unsupported_action", "unsupported_tool", "tool_not_available", "bare_statement", "invalid_arguments", "content_not_grounded",
        "content_boundary_mismatch", "task_id_mismatch", "deadline_scope_mismatch",
    ),
}
#: The kinds that a frame's reason means, in the order in which the frames are asked.
KINDS = (
    ("create", "explicit_create", "create"), ("create", "missing_content", "missing_create"),
    ("complete", "explicit_complete", "complete"), ("complete", "missing_task_id", "missing_complete"), ("complete", "multiple_task_ids", "multiple_complete"),
    ("edit", "explicit_update", "edit"), ("edit", "missing_update_id", "missing_edit_id"), ("edit", "missing_update_content", "missing_edit_content"),
    ("edit", "multiple_task_ids", "multiple_edit"), ("edit", "negated_request", "negated"),
    ("delete", "explicit_delete", "delete"), ("delete", "missing_delete_id", "missing_delete_id"), ("delete", "multiple_task_ids", "multiple_delete"),
    ("delete", "negated_request", "negated"),
    ("deadline", "explicit_deadline", "deadline"), ("deadline", "missing_deadline_id", "missing_deadline_id"), ("deadline", "missing_deadline_time", "missing_deadline_time"),
    ("deadline", "invalid_deadline_time", "missing_deadline_time"), ("deadline", "multiple_task_ids", "multiple_deadline"), ("deadline", "negated_request", "negated"),
    ("due", "explicit_deadline_query", "deadline_query"), ("due", "missing_deadline_scope", "missing_deadline_scope"), ("due", "negated_request", "negated"),
    ("listing", "explicit_list", "list"),
)
#: The kinds of requests that no frame accepts, by how they begin, in order.
HEADS = ((REFUSED_COMMAND, "negated"), (CREATE, "create"), (LIST, "list"), (COMPLETE, "complete"), (EDIT, "edit"), (DELETE, "delete"), (DEADLINE, "deadline"), (NO_ACTION, "unsupported"))
#: The one tool that serves each kind.
ROUTES = {
    "create_task": ("create", "missing_create"), "list_tasks": ("list",), "complete_task": ("complete", "missing_complete", "multiple_complete"),
    "update_task": ("edit", "missing_edit_id", "missing_edit_content", "multiple_edit"), "delete_task": ("delete", "missing_delete_id", "multiple_delete"),
    "set_task_deadline": ("deadline", "missing_deadline_id", "missing_deadline_time", "multiple_deadline"),
    "list_tasks_by_deadline": ("deadline_query", "missing_deadline_scope"),
}


def cut(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, FLAGS + pattern, "")


def strip(text: Column) -> Column:
    return cut(text, r"^\s+|\s+\z")


def short(text: Column) -> Column:
    """Without final punctuation."""
    return cut(cut(text, r"[.?!]+\s*\z"), r"\s+\z")


def first_true(*cases: tuple[Column, str | Column]) -> Column:
    """The value of the first condition that holds; null conditions don't."""
    out: Column | None = None
    for test, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def present(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def numbers(text: Column) -> Column:
    return F.transform(id_tokens(text), lambda x: x.try_cast("long"))


def turn_words(text: Column) -> Column:
    """A short turn in comparable form: lower case, single spaces, without its final mark."""
    return F.lower(F.regexp_replace(strip(cut(strip(text), r"[.?!]\z")), FLAGS + r"\s+", " "))


def scope_of(words: Column) -> Column:
    """The scope that a short turn names, null if it names none."""
    said = turn_words(words)
    return first_true(*[(said.isin(*lexer.VOCABULARY[letter]), scope) for letter, scope in (("1", "today"), ("2", "tomorrow"), ("3", "overdue"))])


def replied_id(words: Column) -> Column:
    """The id that a short turn is: a number, with or without the word for a task before it."""
    said = turn_words(words)
    for word in lexer.VOCABULARY["t"]:
        said = F.when(said.startswith(word + " "), F.substring(said, len(word) + 2, 1000)).otherwise(said)
    return F.when(said.rlike("^#?[0-9]+$"), F.replace(said, F.lit("#"), F.lit("")).try_cast("long"))


def _create(p: Column, lex: Column, cls: Column) -> list[dict[str, Column]]:
    """Projections that read the create frame: head, then tail, then spans, then the reason."""
    c = lambda name: F.col(f"_c_{name}")
    payload = strip(F.when(c("literal"), cut(c("text"), r"^(?::|\r\n|\r|\n)")).otherwise(c("text")))
    polite = ~c("literal") & (reach(c("tail"), CREATE_TAIL, 2) > 0)
    bare = strip(span(lex, c("at"), reach(c("tail"), CREATE_TAIL, 1)))
    reason = first_true(
        (~c("found") & fits(cls, CREATE_REFUSED), "negated_request"),
        (~c("found") & fits(cls, CHANGE_OF_LIST), "unsupported_action"),
        (~c("found") | (c("given") & ~fits(c("tail"), CREATE_GIVEN)), "bare_statement"),
        (~c("literal") & fits(c("tail"), CREATE_REFUSED), "negated_request"),
        (~c("literal") & F.contains(c("tail"), F.lit("X")), "bare_statement"),
        (c("content") == "", "missing_content"),
        (F.lit(True), "explicit_create"),
    )
    return [
        {"_c_found": fits(cls, CREATE), "_c_given": reach(cls, CREATE, 1) > 0, "_c_at": reach(cls, CREATE)},
        {"_c_tail": letters_from(cls, c("at")), "_c_text": span(lex, c("at"))},
        {"_c_literal": fits(c("tail"), "^[:%]")},
        {"_c_payload": payload, "_c_polite": polite},
        {
            "_c_content": F.when(c("literal"), c("payload")).when(c("polite"), bare).otherwise(cut(c("payload"), r"[.?!]+\z")),
            "_c_whole": F.when(c("polite"), bare).otherwise(c("payload")),
        },
        {"create": F.struct(reason.alias("reason"), c("content").alias("content"), c("whole").alias("whole"))},
    ]


def _by_id(ids: Column, name: str, refused: Column, opened: Column, exact: Column, missing: Column, reason_missing: str, good: str) -> dict[str, Column]:
    """A frame that names one task and nothing else."""
    reason = first_true(
        (refused, "negated_request"), (~opened, "bare_statement"), ((F.size(ids) == 0) & ~missing, "bare_statement"), (F.size(ids) == 0, reason_missing),
        (F.size(ids) > 1, "multiple_task_ids"), (~exact | F.coalesce(F.get(ids, F.lit(0)) <= 0, F.lit(True)), "bare_statement"), (F.lit(True), good),
    )
    return {name: F.struct(reason.alias("reason"), F.get(ids, F.lit(0)).alias("id"))}


def _halves(lex: Column, cls: Column, name: str, head: str, joint: str) -> list[dict[str, Column]]:
    """Projections of a frame in two halves: its head, what stands before the first joint, and what follows it."""
    h = lambda field: F.col(f"{name}_{field}")
    first = reach(h("tail"), f"^(.*?){joint}", 1)
    return [
        {f"{name}_found": fits(cls, head), f"{name}_at": reach(cls, head)},
        {f"{name}_tail": letters_from(cls, h("at"))},
        {f"{name}_has": fits(h("tail"), joint), f"{name}_upto": first},
        {
            f"{name}_before": F.when(h("has"), strip(span(lex, h("at"), h("upto")))).otherwise(short(span(lex, h("at")))),
            f"{name}_rest": F.when(h("has"), strip(span(lex, h("at") + h("upto") + 1))).otherwise(""),
            f"{name}_more": F.when(h("has"), letters_from(h("tail"), h("upto") + 1)).otherwise(""),
            f"{name}_target": F.when(h("has"), F.substring(h("tail"), F.lit(1), h("upto"))).otherwise(F.regexp_replace(h("tail"), r"\.+$", "")),
        },
    ]


def _edit(p: Column, lex: Column, cls: Column) -> list[dict[str, Column]]:
    e = lambda name: F.col(f"_e_{name}")
    told = strip(F.regexp_replace(e("rest"), "^:", ""))
    reason = first_true(
        (fits(cls, REFUSED + "(?:uN?|O)"), "negated_request"), (~e("found"), "bare_statement"), (F.size(e("ids")) > 1, "multiple_task_ids"),
        ((F.size(e("ids")) == 0) & (e("before") != ""), "bare_statement"), (F.size(e("ids")) == 0, "missing_update_id"),
        (F.coalesce(F.get(e("ids"), F.lit(0)) <= 0, F.lit(True)) | ~fits(e("target"), "^n$"), "bare_statement"), (e("content").isNull(), "missing_update_content"),
        (~e("literal") & fits(e("more"), EDIT_MORE), "unsupported_action"), (F.lit(True), "explicit_update"),
    )
    return [
        *_halves(lex, cls, "_e", EDIT, "Z"),
        {"_e_literal": e("rest").startswith(":"), "_e_told": told, "_e_ids": numbers(e("before"))},
        {"_e_content": F.nullif(F.when(e("literal"), e("told")).otherwise(short(e("told"))), F.lit(""))},
        {"edit": F.struct(
            reason.alias("reason"), F.when(F.size(e("ids")) == 1, F.get(e("ids"), F.lit(0))).alias("id"), F.when(e("found"), e("content")).alias("content"), e("told").alias("whole")
        )},
    ]


def _deadline(p: Column, lex: Column, cls: Column, reference: Column) -> list[dict[str, Column]]:
    d, t = lambda name: F.col(f"_d_{name}"), lambda name: F.col(f"_t_{name}")

    def whole(frame: str) -> tuple[Column, Column]:
        at, length = reach(cls, frame, 1), reach(cls, frame, 2)
        end = F.when(F.regexp_extract(cls, frame, 3).rlike(r"^\.*$"), strip(span(lex, at + length))).otherwise("")
        when = strip(span(lex, at, length))
        return fits(cls, frame), F.struct(F.get(numbers(span(lex, F.lit(0), at)), F.lit(0)).alias("id"), when.alias("when"), F.concat(when, end).alias("whole"))

    own = d("found") & fits(d("target"), DEADLINE_TASK)
    framed = ~own & F.col("_f").isNotNull()
    ids = F.when(framed, F.array("_f.id")).otherwise(numbers(d("before")))
    reason = first_true(
        (fits(cls, REFUSED + "S[D5]"), "negated_request"), (~d("found") & F.col("_f").isNull(), "bare_statement"), (F.size(t("ids")) > 1, "multiple_task_ids"),
        (~t("target"), "bare_statement"), (F.size(t("ids")) == 0, "missing_deadline_id"), (F.coalesce(F.get(t("ids"), F.lit(0)) <= 0, F.lit(True)), "bare_statement"),
        (t("when").isNull(), "missing_deadline_time"), (t("late"), "invalid_deadline_time"), (F.lit(True), "explicit_deadline"),
    )
    known = d("found") | F.col("_f").isNotNull()
    return [
        *_halves(lex, cls, "_d", DEADLINE, "[iLv]"),
        {"_f": first_true(*[whole(frame) for frame in DEADLINE_WHOLE])},
        {
            "_t_ids": ids, "_t_target": own | framed, "_t_when": F.when(framed, F.col("_f.when")).otherwise(F.nullif(short(d("rest")), F.lit(""))),
            "_t_whole": F.when(framed, F.col("_f.whole")).otherwise(d("rest")),
        },
        {"_t_late": parse_deadline(t("when"), reference).isNull()},
        {"deadline": F.struct(
            reason.alias("reason"), F.when(F.size(t("ids")) == 1, F.get(t("ids"), F.lit(0))).alias("id"), F.when(known, t("when")).alias("when"), t("whole").alias("whole")
        )},
    ]


def _due(cls: Column) -> dict[str, Column]:
    said = F.concat(*[F.regexp_extract(cls, frame, 1) for frame in DUE_WHOLE])
    scope = first_true((F.contains(said, F.lit("3")), "overdue"), (F.contains(said, F.lit("1")), "today"), (F.contains(said, F.lit("2")), "tomorrow"))
    reason = first_true(
        (fits(cls, REFUSED + "r"), "negated_request"), (scope.isNotNull(), "explicit_deadline_query"), (fits(cls, DUE_OPEN), "missing_deadline_scope"), (F.lit(True), "bare_statement")
    )
    return {"due": F.struct(reason.alias("reason"), scope.alias("scope"))}


def _listing(cls: Column) -> dict[str, Column]:
    """Whether the request asks for the whole list; a scope, a filter or another action is not broadened into it."""
    any_of = lambda frames: fits(cls, "|".join(frames))
    asked = fits(cls, LIST_ASKED) | (fits(cls, LIST_OPENED) & fits(cls, "[rV7]") & fits(cls, "[lTt*]"))
    reason = first_true(
        (F.col("due.reason").isin("explicit_deadline_query", "missing_deadline_scope"), "deadline_scope_mismatch"),
        (~fits(cls, ALL_WITH_DUE) & fits(cls, BY_DUE), "deadline_scope_mismatch"),
        (any_of((REFUSED_COMMAND, *LIST_REFUSED)), "negated_request"),
        (any_of((*LIST_PARTLY, NO_ACTION, CREATE)), "unsupported_action"),
        (fits(cls, "lt~|X") | (fits(cls, "^6qt7") & ~fits(cls, "[l*]")), "bare_statement"),
        (asked, "explicit_list"),
        (F.lit(True), "bare_statement"),
    )
    return {"listing": F.struct(reason.alias("reason"))}


def with_request(df: DataFrame, prompt: str, reference: Column, name: str = "request") -> DataFrame:
    """Add the struct `name`: kind, and one struct for each frame (create, complete, edit, delete, deadline, due, listing) with
    its reason and spans. A null or blank prompt is of kind `other`. reference: the time that relative days count from."""
    p, lex, cls = F.col("_p"), F.col("_said.lexemes"), F.col("_said.letters")
    held = df.select(F.struct("*").alias("_row"), F.col(prompt).alias("_p"), reference.alias("_now")).withColumn("_said", lexer.lexed(strip(p)))
    # a lambda in each step keeps the steps out of one generated method, which would be larger than a method can be: each is compiled by itself
    held = held.withColumn("_apart", F.array(F.length(p)))
    steps = [*_create(p, lex, cls), *_edit(p, lex, cls), *_deadline(p, lex, cls, F.col("_now")), _due(cls)]
    done, told = fits(cls, COMPLETE_ONE), fits(cls, COMPLETE_TOLD)
    steps.append({"_ids": numbers(p)})
    nothing = fits(letters_from(cls, reach(cls, DELETE)), r"^\.*$")
    steps.append(
        _by_id(F.col("_ids"), "complete", fits(cls, REFUSED + "[ck]"), fits(cls, COMPLETE) | told, done | told, F.lit(True), "missing_task_id", "explicit_complete")
        | _by_id(F.col("_ids"), "delete", fits(cls, REFUSED + "[dBH]"), fits(cls, DELETE), fits(cls, DELETE_ONE) | fits(cls, DELETE_TOLD), nothing, "missing_delete_id", "explicit_delete")
    )
    steps.append(_listing(cls))
    for step in steps:
        held = held.withColumns(step | {"_apart": F.transform("_apart", lambda x: x)})
    kind = first_true((~present(p), "other"), *[(F.col(f"{frame}.reason") == reason, kind) for frame, reason, kind in KINDS], *[(fits(cls, head), kind) for head, kind in HEADS], (F.lit(True), "other"))
    frames = ("create", "complete", "edit", "delete", "deadline", "due", "listing")
    return held.withColumn("_kind", F.when(F.size("_apart") > 0, kind)).select("_row.*", F.struct(F.col("_kind").alias("kind"), *frames).alias(name))


def tools_for(kind: Column, classified: bool) -> tuple[Column, Column]:
    """(tools offered, whether the whole set is a fallback): the one tool of a classified kind, or all."""
    every = F.array(*[F.lit(t) for t in TOOLS])
    if not classified:
        return every, F.lit(False)
    one = first_true(*[(kind.isin(*kinds), tool) for tool, kinds in ROUTES.items()])
    return F.when(one.isNull(), every).otherwise(F.array(one)), one.isNull()


def result_of(reason: Column) -> Column:
    return first_true(*[(reason.isin(*reasons), result) for result, reasons in RESULTS.items()])


def _object(arguments: Column, keys: Sequence[str]) -> Column:
    """The arguments (JSON text) are an object of exactly these keys."""
    value = F.try_parse_json(arguments)
    found = F.array_sort(F.json_object_keys(arguments)) == F.array(*[F.lit(k) for k in sorted(keys)]).cast("array<string>")
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT") & found, F.lit(False))


def _typed(arguments: Column, key: str, kind: str) -> Column:
    """The argument as `kind` (bigint or string) if it is of that JSON type, else null: true, 1.0 and "1" are no integers."""
    value = F.try_parse_json(arguments)
    at = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == kind.upper(), F.try_variant_get(value, f"$.{key}", kind))


def decide(prompt: Column, tool: Column, arguments: Column, reference: Column, request: str = "request") -> Column:
    """struct(result, reason): whether a tool call (arguments as JSON text) may serve the request read by `with_request`.

    The request must be explicit, name the same task, and hold the argument's text exactly at the span it frames, with or
    without final punctuation. Nothing that the request doesn't say is allowed."""
    r = lambda path: F.col(f"{request}.{path}")
    no = F.lit(False)
    task, content, when, scope = _typed(arguments, "id", "bigint"), _typed(arguments, "content", "string"), _typed(arguments, "when", "string"), _typed(arguments, "scope", "string")
    one_line = lambda c: F.coalesce(present(c) & ~c.rlike(r"[\r\n]"), no)

    def checked(frame: str, good: str, valid: Column, *more: tuple[Column, str]) -> Column:
        return first_true((r(f"{frame}.reason") != good, r(f"{frame}.reason")), (~F.coalesce(valid, no), "invalid_arguments"), *more, (F.lit(True), good))

    def grounded(value: Column, *spans: Column) -> tuple[tuple[Column, str], ...]:
        exact = no
        for span in spans:
            exact = exact | F.coalesce(value == span, no)
        return (~F.contains(prompt, value), "content_not_grounded"), (~exact, "content_boundary_mismatch")

    mismatch = lambda frame: (task != r(f"{frame}.id"), "task_id_mismatch")
    reasons = {
        "create_task": checked("create", "explicit_create", _object(arguments, ["content"]) & present(content), *grounded(content, r("create.content"), r("create.whole"))),
        "list_tasks": first_true((~_object(arguments, []), "invalid_arguments"), (F.lit(True), r("listing.reason"))),
        "list_tasks_by_deadline": checked("due", "explicit_deadline_query", _object(arguments, ["scope"]) & scope.isin(*SCOPES), (scope != r("due.scope"), "deadline_scope_mismatch")),
        "complete_task": checked("complete", "explicit_complete", _object(arguments, ["id"]) & (task > 0), mismatch("complete")),
        "update_task": checked(
            "edit", "explicit_update", _object(arguments, ["id", "content"]) & (task > 0) & one_line(content), mismatch("edit"), *grounded(content, r("edit.content"), r("edit.whole"))
        ),
        "delete_task": checked("delete", "explicit_delete", _object(arguments, ["id"]) & (task > 0), mismatch("delete")),
        "set_task_deadline": checked(
            "deadline", "explicit_deadline", _object(arguments, ["id", "when"]) & (task > 0) & one_line(when), mismatch("deadline"), *grounded(when, r("deadline.when"), r("deadline.whole")),
            (parse_deadline(when, reference).isNull(), "invalid_deadline_time"),
        ),
    }
    reason = first_true(
        (~present(tool), "invalid_arguments"), (~tool.isin(*TOOLS), "unsupported_tool"), (~present(prompt), "invalid_arguments"), *[(tool == name, value) for name, value in reasons.items()]
    )
    return F.struct(result_of(reason).alias("result"), reason.alias("reason"))
