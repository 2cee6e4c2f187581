"""Roll-ups of scored rows: counts by group, accuracy, latency, quotas, families and review decisions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_summary(rows: DataFrame, group: Sequence[str], status: str = "status") -> DataFrame:
    """Totals, pass, fail and error counts by group, and accuracy over the rows without error (null if there are none)."""
    n = lambda s: F.count_if(F.col(status) == s)
    return rows.groupBy(*group).agg(
        F.count("*").alias("total"), n("pass").alias("pass"), n("fail").alias("fail"), n("error").alias("error"),
        F.try_divide(n("pass"), F.count_if(F.col(status) != "error")).alias("accuracy"),
    )


def with_total(rows: DataFrame, group: str, status: str = "status") -> DataFrame:
    """status_summary by one column with the overall row, in one pass over the rows. is_total tells the overall row from the group of
    rows without a value."""
    n = lambda s: F.count_if(F.col(status) == s)
    return rows.rollup(group).agg((F.grouping(group) == 1).alias("is_total"), F.count("*").alias("total"), n("pass").alias("pass"), n("fail").alias("fail"), n("error").alias("error"))


def ranked(counts: DataFrame, group: Sequence[str], value: str, count: str = "_c", ranges: int = 1000) -> DataFrame:
    """Add _upto, how many rows of the group have this value or less, and _n, how many it has, to a histogram (group, value, count).

    Values are dealt into ranges; sums are formed within each and then over the ranges' totals, so no task sees more than a range of one
    group's distinct values, or the list of ranges."""
    keys = [F.col(g) for g in group]
    bounds = counts.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum(count).alias("_n"))
    part = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (ranges - 1))).otherwise(F.lit(0))
    dealt = same_group(counts, bounds, group).withColumn("_r", part)
    earlier = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_r").agg(F.sum(count).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(earlier), F.lit(0))).drop("_t")
    upto = F.sum(count).over(Window.partitionBy(*keys, "_r").orderBy(value)) + F.col("_base")
    return same_group(dealt, totals, [*group, "_r"]).withColumn("_upto", upto)


def same_group(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """A join on group columns in which a missing value is a group of its own."""
    other = right.select(*[F.col(c).alias(f"_g_{c}") if c in group else F.col(c) for c in right.columns])
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return left.join(other, same).drop(*[f"_g_{g}" for g in group])


def reaches(value: str, rank: Column) -> Column:
    """The least value that `rank` rows have or fall below."""
    return F.min(F.when(F.col("_upto") >= rank, F.col(value)))


def median_of(value: str) -> Column:
    return (reaches(value, F.floor((F.col("_n") + 1) / 2)) + reaches(value, F.floor(F.col("_n") / 2) + 1)) / 2


def latency(rows: DataFrame, group: Sequence[str], seconds: str, tokens: str) -> DataFrame:
    """Interpolated median, nearest-rank 95th percentile, totals and tokens a second; nulls are left out. The percentiles come from the
    histogram of each group."""
    counts = rows.where(F.col(seconds).isNotNull()).groupBy(*group, seconds).agg(F.count("*").alias("_c"))
    ranks = ranked(counts, group, seconds).groupBy(*group).agg(median_of(seconds).alias("median_seconds"), reaches(seconds, F.ceil(F.col("_n") * 0.95)).alias("p95_seconds"))
    sums = rows.groupBy(*group).agg(F.sum(seconds).alias("total_seconds"), F.sum(tokens).alias("total_tokens"), F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_second"))
    return same_group(sums, ranks, group)


def length_stats(rows: DataFrame, length: str, key: str) -> DataFrame:
    """Least, median and greatest length and the sum, from the histogram of lengths, beside each key that reaches the greatest: one row
    a tie, so that no number of ties meets in one array."""
    counts = rows.where(F.col(length).isNotNull()).groupBy(F.lit(1).alias("_all"), length).agg(F.count("*").alias("_c"))
    whole = ranked(counts, ["_all"], length).agg(F.min(length).alias("least"), median_of(length).alias("median"), F.max(length).alias("greatest"), F.sum(F.col(length) * F.col("_c")).alias("total"))
    return rows.join(whole, F.col(length) == F.col("greatest")).select("least", "median", "greatest", "total", F.col(key).alias("greatest_key"))


def quota_check(rows: DataFrame, key: str, quota: DataFrame) -> DataFrame:
    """quota(key, expected) against the counts: one row for each key of either side."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    joined = counts.join(quota, key, "full_outer")
    n, expected = F.coalesce("n", F.lit(0)), F.coalesce("expected", F.lit(0))
    return joined.select(key, n.alias("n"), expected.alias("expected"), (n == expected).alias("ok"))


def family_check(rows: DataFrame, family: str, signature: Sequence[str], most: int = 4) -> DataFrame:
    """Members and distinct signatures of each family; consistent if there is one signature and at most `most` members."""
    signed = F.count_distinct(F.struct(*signature))
    return rows.groupBy(family).agg(F.count("*").alias("members"), signed.alias("signatures")).withColumn("ok", (F.col("signatures") == 1) & (F.col("members") <= most))


def count_of_counts(rows: DataFrame, family: str) -> DataFrame:
    """How many families have each size."""
    return rows.groupBy(family).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("families"))


def multi_valued(rows: DataFrame, values: Column, status: str = "status") -> DataFrame:
    """Counts by each value of a list column: a row counts in all of its values."""
    return rows.select(F.explode(values).alias("value"), status).groupBy("value").agg(F.count("*").alias("total"), F.count_if(F.col(status) == "pass").alias("pass"))


def most_frequent(rows: DataFrame, value: str, position: str, n: int = 8) -> DataFrame:
    """The n most frequent values; equal counts in the order first seen."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(position).alias("first_seen"))
    return counts.orderBy(F.desc("n"), "first_seen").limit(n)


def check_groups(turns: DataFrame, checks: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """turns with a map of boolean checks: for each group of checks, the turns that have one and those that pass.
    A turn passes if none of the group's checks it has is false."""
    def named(members: Sequence[str]) -> Callable[[Column, Column], Column]:
        return lambda k, _: k.isin(*members)

    rows = []
    for name, members in groups.items():
        own = F.map_filter(F.col(checks), named(members))
        rows.append(F.struct(F.lit(name).alias("group"), (F.size(own) > 0).alias("has"), F.forall(F.map_values(own), lambda v: v).alias("ok")))
    long = turns.select(F.explode(F.array(*rows)).alias("g")).select("g.*")
    return long.groupBy("group").agg(F.count_if("has").alias("applicable"), F.count_if(F.col("has") & F.col("ok")).alias("passed"))


def case_verdict(turns: DataFrame, case: str, ok: str, final_ok: str) -> DataFrame:
    """A case passes if all its turns and its final state do."""
    return turns.groupBy(case).agg((F.bool_and(ok) & F.bool_and(final_ok)).alias("passed"), F.count("*").alias("turns"))


def review_status(rows: DataFrame, criteria: str) -> Column:
    """Status of a map of criteria: not_evaluated before pending before fail before pass."""
    values = F.map_values(criteria)
    has = lambda v: F.array_contains(values, v)
    return F.when(has("not_evaluated"), "not_evaluated").when(has("pending"), "pending").when(has("fail"), "fail").otherwise("pass")


def compatibility(rows: DataFrame, group: str, served: str, key: str) -> DataFrame:
    """(group, calls, served, first_gap): how many rows of each group are served, and the least key of those that aren't."""
    return rows.groupBy(group).agg(F.count("*").alias("calls"), F.count_if(served).alias("served"), F.min(F.when(~F.col(served), F.col(key))).alias("first_gap"))
