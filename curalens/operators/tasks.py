"""The task store: scans, due scopes, and changes as functions of (tasks, commands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.deadlines import local_day_start
from ..functions.text import blank, lines_of

#: tasks(id long, content string, completed boolean, due_at long)
COLUMNS = ("id", "content", "completed", "due_at")


def due(tasks: DataFrame, scope: str, reference: Column) -> DataFrame:
    """Open tasks due today, tomorrow or before the reference (a timestamp). Days are half-open local days; a task due at
    the reference itself isn't overdue; a task of earlier today is in both `today` and `overdue`."""
    at = F.col("due_at")
    if scope == "overdue":
        fits = at < F.unix_seconds(reference)
    elif scope in ("today", "tomorrow"):
        first = 0 if scope == "today" else 1
        fits = (at >= local_day_start(reference, first)) & (at < local_day_start(reference, first + 1))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    return tasks.where(~F.col("completed") & at.isNotNull() & fits)


def matched(commands: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each command with the task it names, as struct `task`, null where there is none."""
    held = tasks.select(F.col("id").alias("_id"), F.struct(*COLUMNS).alias("task"))
    return commands.join(held, F.col("id") == F.col("_id"), "left").drop("_id")


def complete(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands(seq, id) -> (seq, id, status): completed, already_completed or not_found."""
    status = F.when(F.col("task").isNull(), "not_found").when(F.col("task.completed"), "already_completed").otherwise("completed")
    return matched(commands, tasks).select("seq", "id", status.alias("status"))


def update_content(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands(seq, id, content) -> updated, unchanged or not_found."""
    status = F.when(F.col("task").isNull(), "not_found").when(F.col("task.content") == F.col("content"), "unchanged").otherwise("updated")
    return matched(commands, tasks).select("seq", "id", status.alias("status"))


def set_deadline(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands(seq, id, due_at) -> set, updated, unchanged or not_found."""
    old, new = F.col("task.due_at"), F.col("due_at")
    status = F.when(F.col("task").isNull(), "not_found").when(old.isNull() & new.isNotNull(), "set").when(old.eqNullSafe(new), "unchanged").otherwise("updated")
    return matched(commands, tasks).select("seq", "id", status.alias("status"))


def guarded_delete(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """commands(seq, id, expected) -> deleted, stale or not_found; a null expected snapshot guards nothing."""
    same = F.lit(True)
    for c in COLUMNS:
        same = same & F.col(f"task.{c}").eqNullSafe(F.col(f"expected.{c}"))
    status = F.when(F.col("task").isNull(), "not_found").when(F.col("expected").isNull() | same, "deleted").otherwise("stale")
    return matched(commands, tasks).select("seq", "id", status.alias("status"))


def commands_in_order(tasks: DataFrame, commands: DataFrame, block: int = 100_000) -> DataFrame:
    """Run commands(seq, id, op, content, due_at, expected) one after the other in order of seq, which is unique, so that each sees what
    those before it left: (seq, id, op, status), one row a command. op: complete, update, deadline or delete; expected: a delete's
    snapshot, or null.

    Without deletes a task's state is its last content, its last deadline and whether anything completed it, and each is an associative
    fold. So blocks of `block` numbers are summed up first, map side; sums are carried from block to block; within a block a
    window brings every command the state before it. No task holds more than one block of one id or one row a block, so a
    task that a third of all commands name is spread like any other. A deletion is final: the first delete whose snapshot equals the state
    before it, or that has none, ends the task, and all that follow find nothing.

    An update without content changes nothing; commands on unknown ids find nothing; an op that isn't known has a null status."""
    base = tasks.select(F.col("id").alias("_id"), F.struct("content", "completed", "due_at").alias("_base"))
    known = commands.withColumn("_block", F.floor(F.col("seq") / block)).withColumns({
        "_text": F.when((F.col("op") == "update") & F.col("content").isNotNull(), F.struct("content")),
        "_due": F.when(F.col("op") == "deadline", F.struct("due_at")), "_done": F.col("op") == "complete",
    })
    sums = known.groupBy("id", "_block").agg(
        F.max_by("_text", F.when(F.col("_text").isNotNull(), F.col("seq"))).alias("_text"), F.max_by("_due", F.when(F.col("_due").isNotNull(), F.col("seq"))).alias("_due"), F.max("_done").alias("_done")
    )
    earlier = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda w: [F.last("_text", True).over(w).alias("_text0"), F.last("_due", True).over(w).alias("_due0"), F.max("_done").over(w).alias("_done0")]
    carried = sums.select("id", "_block", *before(earlier("id", by="_block")))
    inner = earlier("id", "_block", by="seq")
    here = known.select("*", F.last("_text", True).over(inner).alias("_text1"), F.last("_due", True).over(inner).alias("_due1"), F.max("_done").over(inner).alias("_done1"))
    here = here.join(carried, ["id", "_block"]).join(base, F.col("id") == F.col("_id"), "left")
    no, found = F.lit(False), F.col("_base").isNotNull()
    text = F.coalesce("_text1.content", "_text0.content", "_base.content")
    due_at = F.coalesce("_due1", "_due0", F.struct(F.col("_base.due_at").alias("due_at")))["due_at"]
    done = F.coalesce("_done1", no) | F.coalesce("_done0", no) | F.coalesce("_base.completed", no)
    same = F.col("expected.id").eqNullSafe(F.col("id")) & F.col("expected.content").eqNullSafe(text) & F.col("expected.completed").eqNullSafe(done) & F.col("expected.due_at").eqNullSafe(due_at)
    status = (
        F.when(F.col("op") == "complete", F.when(done, "already_completed").otherwise("completed"))
        .when(F.col("op") == "update", F.when(F.coalesce(F.col("content") != text, no), "updated").otherwise("unchanged"))
        .when(F.col("op") == "deadline", F.when(due_at.isNull() & F.col("due_at").isNotNull(), "set").when(due_at.eqNullSafe(F.col("due_at")), "unchanged").otherwise("updated"))
        .when(F.col("op") == "delete", F.when(F.col("expected").isNull() | same, "deleted").otherwise("stale"))
    )
    would = here.select("seq", "id", "op", F.when(found, status).otherwise("not_found").alias("_status"))
    ends = would.where("_status = 'deleted'").groupBy("id").agg(F.min("seq").alias("_end")).withColumnRenamed("id", "_gone")
    gone = F.coalesce(F.col("seq") > F.col("_end"), no)
    return would.join(ends, F.col("id") == F.col("_gone"), "left").select("seq", "id", "op", F.when(gone, "not_found").otherwise(F.col("_status")).alias("status"))


def after_commands(tasks: DataFrame, commands: DataFrame, results: DataFrame) -> DataFrame:
    """The next snapshot: tasks after all commands, from their results by `commands_in_order`."""
    told = results.where("status IN ('updated', 'set', 'completed', 'deleted')").select(F.col("seq").alias("_seq"))
    real = commands.join(told, F.col("seq") == F.col("_seq")).withColumns({"_text": F.when(F.col("op") == "update", F.struct("content")), "_due": F.when(F.col("op") == "deadline", F.struct("due_at"))})
    last = real.groupBy(F.col("id").alias("_id")).agg(
        F.max_by("_text", F.when(F.col("_text").isNotNull(), F.col("seq"))).alias("_text"), F.max_by("_due", F.when(F.col("_due").isNotNull(), F.col("seq"))).alias("_due"),
        F.max(F.col("op") == "complete").alias("_done"), F.max(F.col("op") == "delete").alias("_deleted"),
    )
    joined = tasks.join(last, F.col("id") == F.col("_id"), "left").where(~F.coalesce("_deleted", F.lit(False)))
    due_at = F.coalesce("_due", F.struct("due_at"))["due_at"]
    return joined.select("id", F.coalesce("_text.content", "content").alias("content"), (F.col("completed") | F.coalesce("_done", F.lit(False))).alias("completed"), due_at.alias("due_at"))


def apply_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """The next snapshot: changes(id, op, content, due_at), at most one for each id, in one join. op: complete, update,
    deadline or delete."""
    new = changes.select(F.col("id").alias("_id"), "op", F.col("content").alias("_content"), F.col("due_at").alias("_due"))
    joined = tasks.join(new, F.col("id") == F.col("_id"), "left").where(~F.col("op").eqNullSafe("delete"))
    op = F.coalesce("op", F.lit(""))
    return joined.select(
        "id", F.when(op == "update", F.col("_content")).otherwise(F.col("content")).alias("content"),
        (F.col("completed") | (op == "complete")).alias("completed"), F.when(op == "deadline", F.col("_due")).otherwise(F.col("due_at")).alias("due_at"),
    )


def offsets(counts: DataFrame, last: int, fan: int) -> DataFrame:
    """counts(b, n) with b from 0 to `last` -> (b, base): the sum of n over all smaller b. Sums of `fan` neighbours are added up level
    by level, so no task holds more than `fan` rows of one group, however many there are."""
    dealt = counts.withColumn("up", F.floor(F.col("b") / fan))
    earlier = Window.partitionBy("up").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.select("b", "up", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if last < fan:
        return here.drop("up")
    above = offsets(dealt.groupBy(F.col("up").alias("b")).agg(F.sum("n").alias("n")), last // fan, fan)
    return here.join(above.select(F.col("b").alias("up"), F.col("base").alias("_above")), "up").select("b", (F.col("base") + F.col("_above")).alias("base"))


def insert_lines(texts: DataFrame, high_water: int, bucket: int = 10_000, fan: int = 10_000) -> DataFrame:
    """texts(seq, text) -> new tasks, one per line that isn't blank, numbered in order after the high-water mark, which
    is kept by the caller and never derived from the surviving rows, so deleted ids aren't used again.

    Numbering is by prefix sums: over totals of buckets of `seq`, level by level, then within each bucket. Rows without a seq have no
    place in the order and give no task; null texts have no lines."""
    ends = texts.agg(F.min("seq").alias("low"), F.max("seq").alias("high")).first()
    low, last = (0, 0) if ends["low"] is None else (ends["low"], (ends["high"] - ends["low"]) // bucket)
    cut = texts.where("seq IS NOT NULL").select("seq", lines_of(F.coalesce("text", F.lit(""))).alias("lines"), F.floor((F.col("seq") - F.lit(low)) / bucket).alias("b"))
    totals = offsets(cut.groupBy("b").agg(F.sum(F.size("lines")).alias("n")), last, fan)
    within = Window.partitionBy("b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("before", F.coalesce(F.sum(F.size("lines")).over(within), F.lit(0))).join(totals, "b")
    placed = placed.select((F.col("base") + F.col("before")).alias("before"), F.posexplode("lines").alias("pos", "content"))
    return placed.select(
        (F.lit(high_water) + F.col("before") + F.col("pos") + 1).cast("long").alias("id"), "content", F.lit(False).alias("completed"), F.lit(None).cast("long").alias("due_at")
    )


def valid_line(content: Column) -> Column:
    """What a single insert accepts: one line that isn't blank."""
    return ~blank(content) & ~content.rlike(r"[\n\r]")


def migrate(df: DataFrame) -> DataFrame:
    """Bring an older layout (id, content[, completed]) to the current one; an unknown layout raises."""
    names = tuple(df.columns)
    if names not in (COLUMNS[:2], COLUMNS[:3], COLUMNS):
        raise ValueError(f"unknown task layout {names}")
    for name, kind in (("completed", "boolean"), ("due_at", "long")):
        if name not in names:
            df = df.withColumn(name, F.lit(False if name == "completed" else None).cast(kind))
    return df.select(F.col("id").cast("long"), "content", F.coalesce("completed", F.lit(False)).alias("completed"), F.col("due_at").cast("long"))
