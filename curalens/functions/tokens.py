"""Training rows as token arrays: label masks, padding and truncation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the label of a token that isn't trained on.
IGNORED = -100


def assistant_labels(prefix: Column, whole: Column) -> Column:
    """Labels of a sequence whose prompt is an exact prefix: ignored up to there, the tokens after. Null if it is none."""
    n = F.size(prefix)
    return F.when(F.slice(whole, F.lit(1), n) == prefix, F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0)))))


def pad(tokens: Column, pad_id: int, longest: Column, multiple: int = 8) -> Column:
    """Pad to the batch's longest length, rounded up to a multiple."""
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    return F.concat(tokens, F.array_repeat(F.lit(pad_id), F.greatest(width - F.size(tokens), F.lit(0))))


def through_end(tokens: Column, end_id: int) -> Column:
    """Up to and with the first end token; all tokens if there is none."""
    at = F.array_position(tokens, end_id).cast("int")
    return F.when(at > 0, F.slice(tokens, F.lit(1), at)).otherwise(tokens)
