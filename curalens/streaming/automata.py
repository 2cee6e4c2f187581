"""Run automata over event logs: each event's state before and after, and each run's record, by composing transitions.

A stretch of a run's events is a function: for each state at its beginning the state at its end and what was counted on the
way. Such functions compose associatively, so a run is cut into blocks of order numbers, blocks into blocks of blocks, and
no task ever holds more than one block of one run, whatever share of all events that run has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a run; `absent` before it is reserved.
STATES = ("absent", "reserved", "spawned", "spawn_failed", "running", "interrupted", "remote_failed", "complete")
#: Fixed values: (step, state, next state). Any other step is illegal in its state and changes nothing. A second reservation is refused;
#: polling a record without a call, or a completed one, leaves it; a failed call may be polled again.
TRANSITIONS = (
    ("reserve", "absent", "reserved"),
    ("spawn", "reserved", "spawned"), ("spawn_fail", "reserved", "spawn_failed"),
    ("poll", "reserved", "reserved"), ("poll", "spawn_failed", "spawn_failed"), ("poll", "spawned", "running"), ("poll", "running", "running"),
    ("poll", "remote_failed", "running"), ("poll", "complete", "complete"),
    ("fail", "spawned", "remote_failed"), ("fail", "running", "remote_failed"), ("fail", "interrupted", "remote_failed"), ("fail", "remote_failed", "remote_failed"),
    ("finish", "spawned", "complete"), ("finish", "running", "complete"), ("finish", "remote_failed", "complete"),
    ("interrupt", "spawned", "interrupted"), ("interrupt", "running", "interrupted"),
    ("resume", "running", "running"), ("resume", "interrupted", "running"),
)
#: What is counted beside the state, by the legal step that raises it; illegal steps are counted too.
COUNTED = {"resume_count": "resume", "interruptions": "interrupt"}
#: Order numbers in a block, and blocks in a block of the next level.
BLOCK, FAN = 512, 512
FIGURES = [*COUNTED, "illegal"]


def begin(state: Column) -> Column:
    return F.struct(state.cast("int").alias("state"), *[F.lit(0).cast("long").alias(c) for c in FIGURES])


def target(step: Column, state: Column) -> Column:
    """The next state's number, or null where the step is illegal or unknown."""
    steps = list(dict.fromkeys(s for s, _, _ in TRANSITIONS))
    table = F.array(*[F.array(*[F.lit(next((STATES.index(b) for s, a, b in TRANSITIONS if (s, a) == (step_, here)), None)).cast("int") for here in STATES]) for step_ in steps])
    number = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in steps]), step), F.lit(0)) - 1
    return F.get(F.get(table, number.cast("int")), state)


def moved(acc: Column, step: Column) -> Column:
    """The state and counts after one step."""
    to = target(step, acc["state"])
    legal = to.isNotNull()
    counts = [(acc[c] + (legal & step.eqNullSafe(s)).cast("long")).alias(c) for c, s in COUNTED.items()]
    return F.struct(F.coalesce(to, acc["state"]).alias("state"), *counts, (acc["illegal"] + (~legal).cast("long")).alias("illegal"))


def passed(acc: Column, block: Column) -> Column:
    """The state and counts after a whole block, whose function lists what becomes of each state."""
    end = F.get(block["becomes"], acc["state"])
    return F.struct(end["state"].alias("state"), *[(acc[c] + end[c]).alias(c) for c in FIGURES])


def summed(groups: DataFrame, parts: str, one: callable) -> DataFrame:
    """(run, block, becomes): the function of each group's parts in order."""
    each = F.transform(F.sequence(F.lit(0), F.lit(len(STATES) - 1)), lambda s: F.aggregate(parts, begin(s), one))
    return groups.select("run", "block", each.alias("becomes"))


def grouped(events: DataFrame, block: int, fan: int) -> list[DataFrame]:
    """Groups of each level: at the lowest (run, block, parts: events in order), above it parts are blocks of the level below."""
    ends = events.agg(F.min("order").alias("low"), F.max("order").alias("high")).first()
    span = 0 if ends["low"] is None else ends["high"] - ends["low"]
    dealt = events.withColumn("block", F.floor((F.col("order") - F.lit(ends["low"] or 0)) / block))
    levels = [dealt.groupBy("run", "block").agg(F.array_sort(F.collect_set(F.struct("order", "step"))).alias("parts"))]
    last, one = span // block, lambda a, e: moved(a, e["step"])
    while last > 0:
        below = summed(levels[-1], "parts", one).select("run", F.floor(F.col("block") / fan).alias("above"), F.struct("block", "becomes").alias("part"))
        levels.append(below.groupBy("run", F.col("above").alias("block")).agg(F.array_sort(F.collect_list("part")).alias("parts")))
        last, one = last // fan, passed
    return levels


def log_of(events: DataFrame, run: str, order: str, step: str) -> DataFrame:
    rows = events.select(F.col(run).alias("run"), F.col(order).cast("long").alias("order"), F.col(step).alias("step"))
    return rows.where("run IS NOT NULL AND order IS NOT NULL")


def named(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), number + 1)


def run_records(events: DataFrame, run: str, order: str, step: str, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(run, state, resume_count, interruptions, illegal): what each run's events lead to, applied in order.

    Events that share an order number are applied in order of the step's name; rows that repeat all three count once; rows
    without a run or an order are no events; unknown and null steps are illegal. An empty log has no records."""
    levels = grouped(log_of(events, run, order, step), block, fan)
    one = (lambda a, e: moved(a, e["step"])) if len(levels) == 1 else passed
    end = levels[-1].select("run", F.aggregate("parts", begin(F.lit(0)), one).alias("end"))
    return end.select(F.col("run").alias(run), named(F.col("end.state")).alias("state"), *[f"end.{c}" for c in FIGURES])


def run_steps(events: DataFrame, run: str, order: str, step: str, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(run, order, step, state_before, state_after, legal, resume_count, interruptions), one row an event, in the sense of
    `run_records`; the counts are those after the event, so a run's interruptions are its legal interrupt rows, numbered.

    Functions are composed upwards through the levels, then each block is told the state that it begins with, downwards."""
    levels = grouped(log_of(events, run, order, step), block, fan)
    told = levels[-1].withColumn("start", begin(F.lit(0)))

    def scanned(rows: DataFrame, keep: callable, after: callable) -> DataFrame:
        """Each part with the state before it; `now` and `out` are what the fold carries."""
        kind = rows.select(F.array(keep(F.get("parts", 0), F.col("start"))).alias("o")).schema["o"].dataType
        empty = F.struct(F.col("start").alias("now"), F.array().cast(kind).alias("out"))
        fold = F.aggregate("parts", empty, lambda a, p: F.struct(after(a["now"], p).alias("now"), F.array_append(a["out"], keep(p, a["now"])).alias("out")))
        return rows.select("run", F.explode(fold["out"]).alias("o")).select("run", "o.*")

    for below in reversed(levels[:-1]):
        starts = scanned(told, lambda p, now: F.struct(p["block"].alias("block"), now.alias("start")), passed)
        told = below.join(starts, ["run", "block"])
    step_of = lambda a, e: moved(a, e["step"])
    met = scanned(told, lambda e, now: F.struct(e["order"].alias("order"), e["step"].alias("step"), now.alias("was"), step_of(now, e).alias("now")), step_of)
    return met.select(
        F.col("run").alias(run), F.col("order").alias(order), F.col("step").alias(step), named(F.col("was.state")).alias("state_before"), named(F.col("now.state")).alias("state_after"),
        (F.col("now.illegal") == F.col("was.illegal")).alias("legal"), *[f"now.{c}" for c in COUNTED],
    )
