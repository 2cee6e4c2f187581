"""Proposals: argument checks, envelope parsing and scoring of tool calls held as JSON text, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, tags


@dataclass(frozen=True)
class Field:
    """A tool's argument: kind is integer or string; least is a minimum value or length; one of `choices`, if any."""

    name: str
    kind: str
    least: int = 0
    choices: tuple[str, ...] = ()
    required: bool = True


#: Tools by name. Arguments that aren't listed are rejected.
Tools = dict[str, tuple[Field, ...]]


def argument_errors(name: Column, arguments: Column, tools: Tools) -> Column:
    """Codes of what is wrong with a call's arguments (JSON text): the tool is unknown, they are no object, one is missing,
    extra, of the wrong type or size, or not among the choices. true and 1.0 are no integers. The text is read once, as the one element of
    an array whose checks are a lambda; else each check would read it."""
    read = F.array(F.struct(F.try_parse_json(arguments).alias("value"), F.json_object_keys(arguments).alias("keys")))
    return F.get(F.transform(read, lambda r: _read_errors(name, r["value"], r["keys"], tools)), F.lit(0))


def _read_errors(name: Column, value: Column, keys: Column, tools: Tools) -> Column:
    found = F.when(~F.coalesce(name.isin(*tools), F.lit(False)), F.array(F.lit("unknown_tool"))).when(
        ~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), F.array(F.lit("arguments_not_object"))
    )
    for tool, fields in tools.items():
        known = F.array(*[F.lit(f.name) for f in fields])
        extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("extra_argument:"), k))
        own = [tags(*[(~F.array_contains(keys, f.name), f"missing_argument:{f.name}") for f in fields if f.required]), extra]
        for f in fields:
            at = F.try_variant_get(value, f"$.{f.name}", "variant")
            kind = F.schema_of_variant(at)
            if f.kind == "integer":
                valid = (kind == "BIGINT") & (F.try_variant_get(value, f"$.{f.name}", "bigint") >= f.least)
            else:
                valid = (kind == "STRING") & (F.length(F.try_variant_get(value, f"$.{f.name}", "string")) >= f.least)
            valid, there = F.coalesce(valid, F.lit(False)), F.array_contains(keys, f.name)
            own.append(tags((there & ~valid, f"invalid_argument:{f.name}")))
            if f.choices:
                own.append(tags((there & valid & ~F.try_variant_get(value, f"$.{f.name}", "string").isin(*f.choices), f"invalid_enum:{f.name}")))
        found = found.when(name == tool, F.concat(*own))
    return found


def envelope_errors(response: Column) -> Column:
    """Errors of a chat response (JSON text) before its calls are looked at."""
    v = F.try_parse_json(response)
    text = lambda path: F.try_variant_get(v, path, "string")
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    one = kind("$.choices").startswith("ARRAY") & kind("$.choices[0]").startswith("OBJECT") & (kind("$.choices[1]") == "VOID")
    finish, message, calls = text("$.choices[0].finish_reason"), "$.choices[0].message", "$.choices[0].message.tool_calls"
    is_message = kind(message).startswith("OBJECT") & F.coalesce(text(message + ".role") == "assistant", F.lit(False))
    none = kind(calls).isin("VOID", "ARRAY<VOID>")
    return F.when(~F.coalesce(one, F.lit(False)), F.array(F.lit("invalid_response"))).otherwise(F.concat(
        tags((~F.coalesce(finish.isin("stop", "tool_calls"), F.lit(False)), "incomplete_response")),
        F.when(~is_message, F.array(F.lit("invalid_message"))).otherwise(tags(
            (~kind(message + ".content").isin("VOID", "STRING"), "invalid_reply_type"),
            (none & (finish == "tool_calls"), "missing_tool_calls"),
            (~none & ~kind(calls).startswith("ARRAY"), "invalid_tool_calls"),
            (kind(calls + "[1]") != "VOID", "multiple_calls"),
        )),
    ))


def calls_of(response: Column) -> Column:
    """Calls of a chat response: array of (name, arguments as JSON text, envelope_ok)."""
    kind = "array<struct<id:variant,type:string,function:struct<name:variant,arguments:variant>>>"
    raw = F.try_variant_get(F.try_parse_json(response), "$.choices[0].message.tool_calls", kind)
    is_text = lambda c: F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False))
    as_text = lambda c: F.try_variant_get(c, "$", "string")
    return F.transform(raw, lambda c: F.struct(
        as_text(c["function"]["name"]).alias("name"),
        F.when(is_text(c["function"]["arguments"]), as_text(c["function"]["arguments"])).alias("arguments"),
        ((c["type"] == "function") & is_text(c["id"]) & ~blank(as_text(c["id"])) & is_text(c["function"]["name"]) & (as_text(c["function"]["name"]) != "")).alias("envelope_ok"),
    ))
