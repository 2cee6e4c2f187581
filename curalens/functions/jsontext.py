"""JSON texts by value: a strict reading, a canonical form that keeps types apart, and equality and digests over it.

The engine's own variant merges the types of an array's elements and drops the fraction of 1.0, so values are compared by a
canonical text, made in Arrow batches.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key occurs twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def read_strict(text: str | None) -> Any:
    """The value of a JSON text; ValueError for a key that occurs twice, NaN and infinities, and what is no JSON at all. Negative
    zero is zero."""
    if text is None:
        raise ValueError("no text")
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant, parse_float=lambda x: float(x) + 0.0)


def _write(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical_of(text: str | None) -> str | None:
    try:
        return _write(read_strict(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Canonical form of a JSON text: sorted keys, no white space, one way to write each number; 1, 1.0, true and "1" stay apart.
    Null where the text isn't strict JSON."""
    return text.map(canonical_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonicals(texts: pd.Series) -> pd.Series:
    """`canonical` of each text of an array."""
    return texts.map(lambda many: None if many is None else [canonical_of(t) for t in many])


@F.pandas_udf(T.StringType())
def canonical_lenient(text: pd.Series) -> pd.Series:
    """Sorted, compact form of any text that a plain JSON reader accepts, where the last of equal keys wins. Null for others."""

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else _write(json.loads(t))
        except (ValueError, RecursionError):
            return None

    return text.map(one)


def strict_json(text: Column) -> Column:
    """The value of a JSON text, null where it isn't strict: duplicate keys, NaN, infinities and what follows the value are rejected,
    the last of which the engine's own reader lets pass."""
    return F.when(canonical(text).isNotNull(), F.try_parse_json(text))


def exact_equal(left: Column, right: Column) -> Column:
    """Equality of two JSON texts at any depth that keeps types apart (1 is neither 1.0 nor true) and ignores the order of keys.
    A text that isn't strict JSON equals nothing."""
    return F.coalesce(canonical(left) == canonical(right), F.lit(False))


def canonical_digest(document: Column, newline: bool = False) -> Column:
    """SHA-256 of the sorted, compact form, with a line feed after it if asked for; null where the text is no JSON."""
    form = canonical_lenient(document)
    return F.sha2((F.concat(form, F.lit("\n")) if newline else form).cast("binary"), 256)
