"""Text rules of evaluation and curation as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tag that wraps a generated call, and the token that ends a generated text.
CALL_OPEN, CALL_CLOSE, END_TOKEN = "<tool_call>", "</tool_call>", "<|im_end|>"
#: Fixed value: the line ends of Unicode.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def blank(text: Column) -> Column:
    """Empty after stripping Unicode white space."""
    return F.regexp_replace(text, r"(?U)\s+", "") == ""


def tags(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def lines_of(text: Column) -> Column:
    """Lines of a text with CRLF and CR as line feeds, without blank lines."""
    return F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: ~blank(x))


def id_tokens(text: Column) -> Column:
    """Numbers that stand alone, with an optional #."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)#?([0-9]+)(?!\w)"), F.lit(1))


def standalone_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)\d+(?!\d)"), F.lit(0)), lambda x: x.try_cast("long"))


def grounded(value: Column, prompt: Column) -> Column:
    """The value stands verbatim in the prompt."""
    return F.contains(prompt, value)


def id_grounded(task_id: Column, prompt: Column) -> Column:
    """The id is one of the prompt's whole numbers."""
    return F.array_contains(standalone_numbers(prompt), task_id)


def any_term(text: Column, terms: Sequence[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t))


def safe_run_id(run_id: Column) -> Column:
    """1 to 128 file-name characters."""
    return run_id.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def reply_violations(reply: Column, prompt: Column, markers: Sequence[str]) -> Column:
    """Hygiene of a reply: empty, raw JSON (of a plain reader, which lets keys repeat), CJK characters, leaked internal markers,
    placeholder markup."""
    text = F.coalesce(reply, F.lit(""))
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    leaked = F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m) & ~F.contains(prompt, m))
    is_json = (stripped.rlike(r"(?s)^\{.*\}\z") & F.json_object_keys(stripped).isNotNull()) | (stripped.rlike(r"(?s)^\[.*\]\z") & F.json_array_length(stripped).isNotNull())
    return tags(
        (stripped == "", "empty_reply"), (is_json, "raw_json"), (text.rlike("[㐀-䶿一-鿿]"), "cjk_character"), (leaked, "internal_protocol"),
        (stripped.rlike(r"^<[A-Za-z_][A-Za-z0-9_ -]*>\z"), "placeholder_markup"),
    )


def reply_warnings(reply: Column, label: str) -> Column:
    """What is odd in a reply without being wrong: it begins with the assistant's own label."""
    stripped = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?U)^\s+", "")
    return tags((stripped.startswith(f"{label}:"), "assistant_label"))


def split_lines(text: Column) -> Column:
    """Lines of a text by any line end of Unicode; the end of the last line opens no further one, and an empty text has none."""
    body = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def text_differences(field: str, actual: Column, targets: Column, prompt: Column) -> Column:
    """How a proposed text differs from its targets (an array): observable differences only, each told if any target shows it."""
    known, some = actual.isNotNull(), lambda test: F.coalesce(F.exists(targets, test), F.lit(False))
    lines = split_lines(actual)
    return F.when(F.coalesce(F.array_contains(targets, actual), F.lit(False)), F.array().cast("array<string>")).otherwise(tags(
        (F.lit(True), f"{field}_mismatch"),
        (known & ~F.contains(prompt, actual), f"{field}_not_verbatim"),
        (known & (actual != "") & some(lambda t: (t != actual) & F.contains(t, actual)), f"{field}_truncated"),
        (known & some(lambda t: (t != actual) & (F.regexp_replace(t, r"[.?!]+\z", "") == actual)), f"{field}_punctuation_missing"),
        (known & some(lambda t: F.size(split_lines(t)) != F.size(lines)), f"{field}_line_count_changed"),
        (known & some(lambda t: (split_lines(t) != lines) & (F.array_sort(split_lines(t)) == F.array_sort(lines))), f"{field}_lines_reordered"),
    ))


def strip_end_token(text: Column) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    end = END_TOKEN.replace("|", r"\|")
    return F.regexp_replace(trimmed, rf"(?U)\s*{end}$", "")


def generated_calls(text: Column, clean: Column | None = None) -> Column:
    """Bodies of the call tags in a generated text; clean: the text without its end token, where a column holds it."""
    return F.regexp_extract_all(strip_end_token(text) if clean is None else clean, F.lit(rf"(?sU){CALL_OPEN}\s*(.*?)\s*{CALL_CLOSE}"), F.lit(1))


def generated_errors(text: Column, values: Column, clean: Column | None = None, calls: Column | None = None) -> Column:
    """Errors of a generated text's envelope: tag without a body, several calls, text beside them, JSON that is invalid or
    not exactly a name and arguments. values: the canonical forms of its calls, null for what is no JSON. clean and calls: the text without its
    end token and the bodies of its calls, where columns hold them; else each check works them out."""
    clean = strip_end_token(text) if clean is None else clean
    calls = generated_calls(text, clean) if calls is None else calls
    tagged = F.contains(clean, F.lit(CALL_OPEN)) | F.contains(clean, F.lit(CALL_CLOSE))
    rest = F.regexp_replace(clean, rf"(?sU){CALL_OPEN}\s*(.*?)\s*{CALL_CLOSE}", "")
    shape = F.array(F.lit("arguments"), F.lit("name"))
    return tags(
        (text.isNull(), "invalid_text"),
        (tagged & (F.size(calls) == 0), "malformed_tool_call_tag"),
        (F.size(calls) > 1, "multiple_calls"),
        ((F.size(calls) > 0) & ~blank(rest), "extra_text"),
        (F.exists(values, lambda v: v.isNull()), "invalid_call_json"),
        (F.exists(values, lambda v: v.isNotNull() & ~F.array_sort(F.json_object_keys(v)).eqNullSafe(shape)), "invalid_call_shape"),
    )
