"""Distinct counts of unions, intersections and differences from HyperMinHash sketches, and the exact counts beside them.

A sketch has at most `BUCKETS` registers. A register keeps, of the hashes that fall into its bucket, the smallest: its
leading-zero exponent and the `MANTISSA` bits after the leading one, packed so that the smaller hash has the larger code. Merging
sketches is then a maximum by register, which compares exponents first and mantissas next, and any aggregation may do it.

Rows with a null in any key are not used. Repeated rows change nothing; an empty table gives empty results; other columns are
ignored, whatever their names; members are compared by their text, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch; mantissa bits; bits of the hash that choose a register, and that it describes.
BUCKETS, MANTISSA, BUCKET_BITS, VALUE_BITS = 512, 10, 9, 46
#: Standard deviations that an error bound spans.
SPAN = 3.0
#: Days of a window, and days of a block whose bits are one long.
WINDOW_DAYS, BLOCK_DAYS = 7, 56


def member_hash(member: Column) -> tuple[Column, Column]:
    """(bucket, value) of a member: 9 and 46 bits of the MD5 of its decimal text, which any SQL engine has."""
    bits = F.conv(F.substring(F.md5(member.cast("string").cast("binary")), 1, 14), 16, 10).cast("long")  # 56 bits
    return bits.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"), F.shiftright(bits, 56 - VALUE_BITS)


def bit_length(value: Column) -> Column:
    """Bits of a non-negative long below 2^63, 0 for 0: all bits below the leading one are set, then counted."""
    for step in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseOR(F.shiftright(value, step))
    return F.bit_count(value)


def sketch(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """(*keys, bucket, code): the registers that the members of each key fill. Codes are made where the rows lie, and only
    the largest of a register leaves a task, so a key with a third of the rows is as light as any other."""
    bucket, value = member_hash(F.col(member))
    seen = rows.select(*keys, bucket.alias("bucket"), value.alias("value")).withColumn("bits", bit_length(F.col("value")))
    # the bits after the leading one, at the width of a mantissa
    wide = f"shiftright(value, greatest(bits - {MANTISSA + 1}, 0))"
    tail = F.expr(f"cast(shiftleft({wide}, greatest({MANTISSA + 1} - bits, 0)) & {(1 << MANTISSA) - 1} as int)")
    exponent = F.lit(VALUE_BITS + 1) - F.col("bits")
    code = exponent * (1 << MANTISSA) + ((1 << MANTISSA) - 1 - tail)
    return seen.select(*keys, "bucket", code.cast("int").alias("code")).groupBy(*keys, "bucket").agg(F.max("code").alias("code"))


def merge(registers: DataFrame, keys: list[str]) -> DataFrame:
    """Registers that share keys become one sketch."""
    return registers.groupBy(*keys, "bucket").agg(F.max("code").alias("code"))


def as_array(registers: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row a sketch: its registers in an array by bucket, 0 where none was filled."""
    listed = registers.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "code"))).alias("filled"))
    every = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    return listed.select(*keys, F.transform(every, lambda b: F.coalesce(F.col("filled")[b], F.lit(0))).alias(name))


def place(code: Column) -> Column:
    """The hash that a register stands for, as a part of the whole range: the middle of its cell; 1 for an empty one."""
    tail = F.lit((1 << MANTISSA) - 1) - code.bitwiseAND(F.lit((1 << MANTISSA) - 1))
    found = F.pow(F.lit(2.0), -F.shiftright(code, MANTISSA).cast("double")) * (1 + (tail + 0.5) / (1 << MANTISSA))
    return F.when(code == 0, F.lit(1.0)).otherwise(F.least(found, F.lit(1.0)))


def total(array: Column, what) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + what(x))


def set_algebra(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add est_union, est_both, est_only_a and err_* to rows that hold the register arrays `a` and `b`; both arrays go.

    Union: the LogLog-type estimate over the merged registers, k (m - 1) / (sum of m places), k of m filled; for m
    filled ones this is the harmonic mean of 2^exponent refined by the mantissa, and empty ones count as whole places, so no
    range needs another rule. Intersection: the part of the filled registers that agree, less the registers that agree by
    chance. Difference: the part that A alone decides. A variance combines that of the union, n^2 / m (1 / (1 - e^-t) - 1 / t)
    for t = n / m, with that of the part, p (1 - p) / k, as far as registers don't show each member. An error spans three deviations."""
    m, taken = float(BUCKETS), {c.lower() for c in pairs.columns}
    helpers = []
    for name in ("_x", "_k", "_n", "_c", "_p", "_q", "_u", "_na", "_nb"):
        while name in taken:
            name += "_"
        helpers.append(name)
    x, k, n, chance, both, only, spread, na, nb = helpers
    col = F.col

    def size(array: Column, filled: Column) -> Column:
        return filled * (m - 1) / total(array, place)

    def filled(array: Column) -> Column:
        return total(array, lambda v: (v > 0).cast("double"))

    row = pairs.withColumn(x, F.zip_with(col(a), col(b), lambda u, v: F.greatest(u, v)))
    row = row.withColumn(k, filled(col(x))).withColumn(n, size(col(x), col(k)))
    row = row.withColumn(na, size(col(a), filled(col(a)))).withColumn(nb, size(col(b), filled(col(b))))
    agree = total(F.zip_with(col(a), col(b), lambda u, v: ((u > 0) & (u == v)).cast("double")), lambda v: v)
    first = total(F.zip_with(col(a), col(b), lambda u, v: (u > v).cast("double")), lambda v: v)
    # two unlike smallest hashes share a cell of width 2^(-i - MANTISSA) with densities of rates la and lb
    la, lb = col(na) / m, col(nb) / m
    cells = F.aggregate(
        F.sequence(F.lit(1), F.lit(VALUE_BITS)), F.lit(0.0),
        lambda s, i: s + F.pow(F.lit(2.0), -(i + MANTISSA).cast("double")) * (F.exp(-(la + lb) * F.pow(F.lit(2.0), -i.cast("double"))) - F.exp(-(la + lb) * F.pow(F.lit(2.0), (1 - i).cast("double")))),
    )
    row = row.withColumn(chance, F.when((la > 0) & (lb > 0), m * la * lb / (la + lb) * cells).otherwise(0.0))
    # c seen to agree = truly equal ones + chance among the rest
    part = (agree - col(chance)) / F.greatest(col(k) - col(chance), F.lit(1.0))
    row = row.withColumn(both, F.when(col(k) > 0, F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))).otherwise(0.0))
    row = row.withColumn(only, F.when(col(k) > 0, (1 - col(both)) * F.coalesce(first / F.nullif(col(k) - agree, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
    t = F.greatest(col(n), F.lit(1e-9)) / m
    bracket = F.when(t < 0.01, 0.5 + t / 12).otherwise(1 / (1 - F.exp(-t)) - 1 / t)
    row = row.withColumn(spread, col(n) * col(n) / m * bracket)
    unseen = F.greatest(1 - col(k) / F.greatest(col(n), F.lit(1.0)), F.lit(0.02))

    def error(p: Column) -> Column:
        own = col(n) * col(n) * p * (1 - p) / F.greatest(col(k), F.lit(1.0)) * unseen
        return F.least(SPAN * F.sqrt(own + p * p * col(spread)) + 0.5 * (col(n) > 0).cast("double"), 8 * col(n) / F.sqrt(F.lit(m)) + 3)

    names = [c for c in pairs.columns if c not in (a, b)]
    found = {
        "est_union": col(n), "est_both": col(n) * col(both), "est_only_a": col(n) * col(only),
        "err_union": error(F.lit(1.0)), "err_both": error(col(both)), "err_only_a": error(col(only)),
    }
    return row.select(*names, *(F.round(v, 6).alias(c) for c, v in found.items()))


def day_of(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long")


def used_clicks(clicks: DataFrame) -> DataFrame:
    """(client_id, kind, day) of rows that have a client, a kind and a time."""
    whole = clicks.where(F.col("client_id").isNotNull() & F.col("kind").isNotNull() & F.col("ts").isNotNull())
    return whole.select("client_id", "kind", day_of(F.col("ts")).alias("day"))


def smear(days: Column, width: int = WINDOW_DAYS) -> Column:
    """Bits of the days whose window of `width` days holds one of `days`, those beyond the block included."""
    found = days
    for k in range(1, width):
        found = found.bitwiseOR(F.shiftleft(days, k))
    return found


def exact_both(used: DataFrame) -> DataFrame:
    """(day, kind_a, kind_b, n_both): members active in the window of kind_a that ends with the day and in that of kind_b
    that ends a day earlier; kind_b null for (day, kind_a, null, n): the members of the window alone.

    A member's days of a kind are the bits of one long per block of 56 days, which leaves room for windows that begin in a block
    and end in the next. A click sets the bits of all windows that hold it, here and, near the border, in the next block, so
    members are brought together once, by aggregation, and a member with a third of the rows costs no task more than others."""
    block = F.floor(F.col("day") / BLOCK_DAYS)
    bit = F.expr(f"shiftleft(1L, cast(pmod(day, {BLOCK_DAYS}) as int))")
    low = F.lit((1 << BLOCK_DAYS) - 1).cast("long")
    marked = used.select("client_id", "kind", block.cast("long").alias("block"), bit.alias("bit"))
    marked = marked.groupBy("client_id", "kind", "block").agg(F.bit_or("bit").alias("days"))
    own = smear(F.col("days"))
    parts = F.array(
        F.struct(F.col("block").alias("block"), own.bitwiseAND(low).alias("a"), F.shiftleft(own, 1).bitwiseAND(low).alias("b")),
        F.struct((F.col("block") + 1).alias("block"), F.shiftright(own, BLOCK_DAYS).alias("a"), F.shiftright(F.shiftleft(own, 1), BLOCK_DAYS).alias("b")),
    )
    spread = marked.select("client_id", "kind", F.explode(parts).alias("x")).select("client_id", "kind", "x.*").where("a <> 0 or b <> 0")
    spread = spread.groupBy("client_id", "block", "kind").agg(F.bit_or("a").alias("a"), F.bit_or("b").alias("b"))
    kinds = spread.groupBy("client_id", "block").agg(F.collect_list(F.struct("kind", "a", "b")).alias("kinds"))
    one = kinds.select("block", "kinds", F.explode("kinds").alias("p"))
    seconds = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))), F.col("kinds"))
    two = one.select("block", "p", F.explode(seconds).alias("q"))
    two = two.select("block", F.col("p.kind").alias("kind_a"), F.col("q.kind").alias("kind_b"), F.col("p.a").bitwiseAND(F.col("q.b")).alias("days")).where("days <> 0")
    # members with the same days of a pair are counted together before their days are told apart
    two = two.groupBy("block", "kind_a", "kind_b", "days").agg(F.count("*").alias("n"))
    every = F.filter(F.sequence(F.lit(0), F.lit(BLOCK_DAYS - 1)), lambda i: F.getbit(F.col("days"), i) == 1)
    told = two.select("block", "kind_a", "kind_b", "n", F.explode(every).alias("i"))
    return told.groupBy((F.col("block") * BLOCK_DAYS + F.col("i")).alias("day"), "kind_a", "kind_b").agg(F.sum("n").alias("n"))


def window_algebra(clicks: DataFrame, window: int = WINDOW_DAYS) -> DataFrame:
    """(day, kind_a, kind_b, n_union, n_both, n_only_a, est_*, err_*) for each day that holds a used click and each ordered
    pair of kinds: A is kind_a's members in the `window` days that end with the day, B kind_b's in those that end a day before."""
    if window != WINDOW_DAYS:
        raise ValueError(f"windows have {WINDOW_DAYS} days")
    used = used_clicks(clicks)
    registers = sketch(used, ["kind", "day"], "client_id")
    held = registers.select("day").distinct()
    kinds = registers.agg(F.sort_array(F.collect_set("kind")).alias("kinds"))  # one short row, whose square is the result
    # windows: a day's registers belong to the windows that end on it and on the six days after it
    wide = merge(registers.withColumn("day", F.explode(F.sequence(F.col("day"), F.col("day") + window - 1))), ["kind", "day"])
    arrays = as_array(wide, ["kind", "day"], "codes")
    frame = held.crossJoin(kinds).select("day", F.explode("kinds").alias("kind_a"), "kinds").select("day", "kind_a", F.explode("kinds").alias("kind_b"))
    none = F.array_repeat(F.lit(0), BUCKETS)
    left = arrays.select("day", F.col("kind").alias("kind_a"), F.col("codes").alias("a"))
    right = arrays.select((F.col("day") + 1).alias("day"), F.col("kind").alias("kind_b"), F.col("codes").alias("b"))
    pairs = frame.join(left, ["day", "kind_a"], "left").join(right, ["day", "kind_b"], "left")
    pairs = pairs.select("day", "kind_a", "kind_b", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    counts = exact_both(used)
    alone = counts.where(F.col("kind_b").isNull())
    size_a = alone.select("day", "kind_a", F.col("n").alias("n_a"))
    size_b = alone.select((F.col("day") + 1).alias("day"), F.col("kind_a").alias("kind_b"), F.col("n").alias("n_b"))
    both = counts.where(F.col("kind_b").isNotNull()).withColumnRenamed("n", "n_both")
    whole = set_algebra(pairs).join(both, ["day", "kind_a", "kind_b"], "left").join(size_a, ["day", "kind_a"], "left").join(size_b, ["day", "kind_b"], "left")
    n_a, n_b, n_both = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_a", "n_b", "n_both"))
    estimates = [f"{x}_{y}" for x in ("est", "err") for y in ("union", "both", "only_a")]
    return whole.select("day", "kind_a", "kind_b", (n_a + n_b - n_both).alias("n_union"), n_both.alias("n_both"), (n_a - n_both).alias("n_only_a"), *estimates)
