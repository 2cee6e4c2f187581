"""Validators as rows: what differs between the expected and the actual, all violations at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_cases(cases: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cases whose key is wanted, wanted keys that no case has). The second must be empty for the first to be used."""
    return cases.join(wanted, key, "left_semi"), wanted.join(cases, key, "left_anti")


def set_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has; empty if the sets are equal."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.exceptAll(a).select(key, F.lit("missing").alias("side")).unionByName(a.exceptAll(e).select(key, F.lit("extra").alias("side")))


def stored_differs(stored: DataFrame, again: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys whose stored values aren't those computed again, nulls compared as values, in either direction."""
    s, n = stored.select(key, F.struct(*values).alias("stored")), again.select(key, F.struct(*values).alias("again"))
    return s.join(n, key, "full_outer").where(~F.col("stored").eqNullSafe(F.col("again"))).select(key)


def undecided_flags(flags: DataFrame, decisions: DataFrame, key: str, bound: Sequence[str]) -> DataFrame:
    """Flags without a decision that names the same values, and decisions without a flag: (key, problem)."""
    d = decisions.select(key, F.struct(*bound).alias("_told"))
    joined = flags.select(key, F.struct(*bound).alias("_own")).join(d, key, "full_outer")
    problem = F.when(F.col("_told").isNull(), "undecided").when(F.col("_own").isNull(), "unknown").when(~F.col("_own").eqNullSafe(F.col("_told")), "changed")
    return joined.select(key, problem.alias("problem")).where(F.col("problem").isNotNull())


def review_completeness(cases: DataFrame, reviews: DataFrame, key: str, decision: str = "decision") -> DataFrame:
    """Counts of each decision over all cases (missing reviews are pending) and whether all are approved: one row."""
    said = F.coalesce(decision, F.lit("pending"))
    n = lambda v: F.count_if(said == v)
    joined = cases.select(key).join(reviews.select(key, decision), key, "left")
    return joined.agg(n("approved").alias("approved"), n("needs_correction").alias("needs_correction"), n("pending").alias("pending"), (n("approved") == F.count("*")).alias("complete"))


def latest_numbered(names: DataFrame, column: str, complete: Column, prefix: str) -> DataFrame:
    """The complete name with the greatest number after `prefix`, as one row."""
    number = F.regexp_extract(column, rf"^{prefix}([0-9]+)$", 1).try_cast("long")
    return names.withColumn("number", number).where(complete & F.col("number").isNotNull()).agg(F.max_by(column, "number").alias(column), F.max("number").alias("number"))


def budget(rows: DataFrame, seconds: str, rates: Sequence[str], cap: float, tolerance: float = 1e-12) -> DataFrame:
    """Total cost of seconds at summed rates, and whether it stays within the cap: one row."""
    rate = F.lit(0.0)
    for r in rates:
        rate = rate + F.col(r)
    total = F.sum(F.col(seconds) * rate)
    return rows.agg(total.alias("cost"), (total <= cap + tolerance).alias("within"))
