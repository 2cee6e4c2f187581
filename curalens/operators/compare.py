"""Comparison of runs and snapshots: diffs, fixed and regressed cases, gates and checkpoint choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tasks import offsets


def diff(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """created, deleted and changed keys between two snapshots, by one full outer join; nulls compare as values."""
    b, a = before.select(key, F.struct(*values).alias("old")), after.select(key, F.struct(*values).alias("new"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return b.join(a, key, "full_outer").select(key, change.alias("change")).where(F.col("change").isNotNull())


def multiset_difference(actual: DataFrame, expected: DataFrame, value: str) -> DataFrame:
    """Values that `actual` holds more often than `expected`, with the surplus."""
    both = actual.select(value, F.lit(1).alias("d")).unionByName(expected.select(value, F.lit(-1).alias("d")))
    return both.groupBy(value).agg(F.sum("d").alias("surplus")).where("surplus > 0")


def fixed_regressed(baseline: DataFrame, candidate: DataFrame, key: str, status: str = "status") -> DataFrame:
    """(key, change): cases whose status went from fail to pass or from pass to fail."""
    joined = baseline.select(key, F.col(status).alias("before")).join(candidate.select(key, F.col(status).alias("after")), key)
    change = F.when((F.col("before") == "fail") & (F.col("after") == "pass"), "fixed").when((F.col("before") == "pass") & (F.col("after") == "fail"), "regressed")
    return joined.select(key, change.alias("change")).where(F.col("change").isNotNull())


def new_errors(baseline: DataFrame, candidate: DataFrame, key: str, tags: str, safety: Sequence[str]) -> DataFrame:
    """Safety errors that only the candidate has, by case."""
    names = F.array(*[F.lit(s) for s in safety])
    joined = baseline.select(key, F.col(tags).alias("old")).join(candidate.select(key, F.col(tags).alias("now")), key)
    found = F.array_sort(F.array_except(F.array_intersect("now", names), F.array_intersect("old", names)))
    return joined.select(key, found.alias("new_errors")).where(F.size("new_errors") > 0)


def acceptance_gates(baseline: DataFrame, candidate: DataFrame, key: str, group: str, least_pass: int, reduction: float) -> DataFrame:
    """(gate, passed): candidate passes at least `least_pass`; failures fall by ceil(reduction * failures), to none if the
    baseline had none; no group passes less often than in the baseline. Rows have a status of pass or fail."""
    joined = baseline.select(key, group, F.col("status").alias("before")).join(candidate.select(key, F.col("status").alias("after")), key)
    n = lambda c, s: F.count_if(F.col(c) == s)
    by = joined.groupBy(group).agg(n("before", "pass").alias("bp"), n("after", "pass").alias("ap"), n("before", "fail").alias("bf"), n("after", "fail").alias("af"))
    one = by.agg(F.sum("ap").alias("ap"), F.sum("bf").alias("bf"), F.sum("af").alias("af"), F.bool_and(F.col("ap") >= F.col("bp")).alias("level"))
    fewer = F.when(F.col("bf") == 0, F.col("af") == 0).otherwise(F.col("bf") - F.col("af") >= F.ceil(F.lit(reduction) * F.col("bf")))
    gates = {"minimum_pass": F.col("ap") >= least_pass, "minimum_error_reduction": fewer, "no_group_regression": F.col("level")}
    rows = F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("passed")) for k, v in gates.items()])
    return one.select(F.explode(rows).alias("g")).select("g.gate", "g.passed")


def choose_checkpoint(rows: DataFrame, baseline_pass: int, baseline_unsafe: int) -> DataFrame:
    """rows(step, passed, unsafe): of the checkpoints no worse than the baseline, the one with most passes, earliest first."""
    fit = rows.where((F.col("unsafe") <= baseline_unsafe) & (F.col("passed") >= baseline_pass))
    return fit.orderBy(F.desc("passed"), "step").limit(1)


def deltas(rows: DataFrame, model: str, baseline: str, values: Sequence[str]) -> DataFrame:
    """Each model's values less the baseline's. The baseline's values are summed into one row, whatever it has."""
    base = rows.where(F.col(model) == baseline).agg(*[F.sum(v).alias(f"_{v}") for v in values])
    return rows.where(F.col(model) != baseline).crossJoin(base).select(model, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_delta") for v in values])


def paired(rows: DataFrame, pair: str, variant: str, first: str, second: str, value: str) -> DataFrame:
    """Both variants of each pair side by side, and whether their values agree."""
    wide = rows.groupBy(pair).agg(F.min(F.when(F.col(variant) == first, F.col(value))).alias("a"), F.min(F.when(F.col(variant) == second, F.col(value))).alias("b"))
    return wide.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("same", F.col("a") == F.col("b"))


def bind_reviews(rows: DataFrame, reviews: DataFrame, key: str, content: str) -> DataFrame:
    """reviews(key, digest, decision) bound by id and SHA-256 of the content: (key, digest_ok, decision); reviews of
    unknown ids have a null digest_ok."""
    digest = rows.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_now"))
    return reviews.join(digest, key, "left").select(key, (F.col("digest") == F.col("_now")).alias("digest_ok"), "decision")


def prefix_equal(old: DataFrame, new: DataFrame, ordinal: str, values: Sequence[str]) -> DataFrame:
    """Ordinals at which a dataset doesn't extend an earlier one verbatim."""
    d = lambda df, n: df.select(ordinal, F.struct(*values).alias(n))
    return d(old, "x").join(d(new, "y"), ordinal, "left").where(~F.col("x").eqNullSafe(F.col("y"))).select(ordinal)


def cross_fill(frames: DataFrame, values: DataFrame, prefix: str) -> DataFrame:
    """frames(f, frame) x values(v, slot, value): filled templates with numbered ids. Their product is the result that is asked for;
    which side is sent around is left to the engine, by size."""
    both = frames.crossJoin(values)
    text = F.replace("frame", F.concat(F.lit("{"), F.col("slot"), F.lit("}")), F.col("value"))
    return both.select(F.format_string(f"{prefix}_%02d_%02d", F.col("f"), F.col("v")).alias("id"), text.alias("prompt"))


def chain_breaks(turns: DataFrame, session: str, turn: str, before: str, after: str) -> DataFrame:
    """Turns whose state before isn't the state after the turn before."""
    last = F.lag(after).over(Window.partitionBy(session).orderBy(turn))
    return turns.withColumn("_last", last).where(F.col("_last").isNotNull() & ~F.col(before).eqNullSafe(F.col("_last"))).drop("_last")


def positions(rows: DataFrame, ordinal: str, key: str, bucket: int = 10_000, fan: int = 10_000) -> DataFrame:
    """(position, key): the place of each row in order of a whole-number ordinal, from 0, equal ordinals by key. Rows are counted by
    buckets of ordinals and the counts added up level by level, so nothing is sorted as a whole and no task holds more than a bucket.
    Rows without an ordinal have no place."""
    here = rows.where(F.col(ordinal).isNotNull()).select(F.col(ordinal).cast("long").alias("_o"), F.col(key).alias("key"))
    ends = here.agg(F.min("_o").alias("low"), F.max("_o").alias("high")).first()
    low, last = (0, 0) if ends["low"] is None else (ends["low"], (ends["high"] - ends["low"]) // bucket)
    dealt = here.withColumn("b", F.floor((F.col("_o") - F.lit(low)) / bucket))
    base = offsets(dealt.groupBy("b").agg(F.count("*").alias("n")), last, fan)
    place = F.row_number().over(Window.partitionBy("b").orderBy("_o", "key")) - 1
    return dealt.withColumn("_place", place).join(base, "b").select((F.col("base") + F.col("_place")).cast("long").alias("position"), "key")


def order_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(position, expected, actual): the positions at which two lists by `positions` don't hold the same key."""
    e, a = expected.withColumnRenamed("key", "expected"), actual.withColumnRenamed("key", "actual")
    return e.join(a, "position", "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual"))).select("position", "expected", "actual")


def order_digest(list_of: DataFrame) -> DataFrame:
    """(n, members, ordered) of a list by `positions`, one row: sums of 60-bit digests of the keys, and of the keys with their positions.
    Sums of parts add up, so the parts of a list are digested where they lie. Equal members and another order are two lists of one set."""
    digest = lambda c: F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    name = F.coalesce(F.col("key").cast("string"), F.lit("\\N"))
    return list_of.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(digest(name)), F.lit(0)).alias("members"), F.coalesce(F.sum(digest(F.concat_ws(":", F.col("position").cast("string"), name))), F.lit(0)).alias("ordered")
    )


def order_gates(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(gate, passed): whether two lists by `positions` are as long, have the same members, and have them in the same order."""
    e, a = (order_digest(rows).select(F.struct("*").alias(n)) for rows, n in ((expected, "e"), (actual, "a")))
    gates = {"same_length": ("n",), "same_members": ("n", "members"), "same_order": ("n", "members", "ordered")}
    told = [F.struct(F.lit(g).alias("gate"), F.forall(F.array(*[F.col(f"e.{c}") == F.col(f"a.{c}") for c in names]), lambda v: v).alias("passed")) for g, names in gates.items()]
    return e.crossJoin(a).select(F.explode(F.array(*told)).alias("g")).select("g.gate", "g.passed")  # a row each
