"""Benchmark decontamination by template canonicalisation (columns only, no Python).

Numbers, names and units become typed placeholders, windows of five template words are joined by hash, and the values in
the slots must correspond one to one, so a benchmark question is found verbatim or with its parameters changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, unlike

#: Default parameters: template words in a window, least share of an item's words that matched windows must cover, least
#: literal words in a window, and the most benchmark windows that travel with the plan (some hundred bytes each).
SIZE, COVERAGE, LITERAL, BROADCAST_WINDOWS = 5, 0.8, 2, 500_000
#: Least words of an item for which a document is removed: a word or two alone are an answer that any text may hold.
SHORTEST = 3
#: Most words that stay literal where they begin a sentence; rarer ones of the benchmark are names there, in all texts alike.
OPENERS = 20_000
#: Placeholders, and a mark before the first word of a sentence: characters of the private use area, which the cleaning below keeps.
NUMBER, NAME, UNIT, FIRST = "", "", "", ""
#: Units of measure, money and time that may follow a number.
UNITS = (
    "percent", "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "gram", "grams", "kg",
    "kilogram", "kilograms", "ounce", "ounces", "oz", "pound", "pounds", "lb", "lbs", "ton", "tons", "ml", "cl", "l", "liter", "liters", "litre",
    "litres", "meter", "meters", "metre", "metres", "second", "seconds", "minute", "minutes", "min", "hour", "hours", "h", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "kmh", "mph", "watt", "watts",
)


def with_templates(df: DataFrame, text: Column, openers: list[str] | None) -> DataFrame:
    """Add _raw and _template: arrays of one length, the words of the text and their template words.

    Digit groups are joined (1,000.5 is one number), a number is cut from a unit written against it, other punctuation is
    dropped, and case is folded. A name is a capitalised word that follows a lower-case word or a comma, and any other word of a
    capital and small letters, as at the beginning of a sentence, unless it is one of `openers`. Without `openers` such words
    keep the mark FIRST."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[0-9])[.,:/](?=[0-9])", "")
    plain = F.regexp_replace(joined, r"(?<=[0-9])(?=\p{L})", " ")
    named = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{Ll}\p{N},;]\s.)\p{L}+", NAME)
    named = F.regexp_replace(named, r"\p{Lu}(?<!\p{L}.)\p{Ll}+(?!\p{L})", f"{FIRST}$0")
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{NUMBER}-{FIRST}]+", " "))
    template = F.regexp_replace(clean(named), r"(?<!\S)\p{N}+(?!\S)", NUMBER)
    template = F.split(F.regexp_replace(template, rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?!\S)", UNIT), " ")
    if openers is not None:
        own = lambda w: F.substring(w, F.lit(2), F.length(w))
        name = lambda w: F.when(own(w).isin(openers), own(w)).otherwise(NAME) if openers else F.lit(NAME)
        template = F.transform(template, lambda w: F.when(w.startswith(FIRST), name(w)).otherwise(w))
    return df.withColumns({"_raw": F.split(clean(plain), " "), "_template": template})


def sentence_openers(benchmark: DataFrame, most: int = OPENERS) -> list[str]:
    """The words of benchmark(_text) that begin sentences there and are written small elsewhere, so that they are no names: the
    `most` of them that begin the most sentences."""
    words = with_templates(benchmark.select("_text").distinct(), F.col("_text"), None).select(F.explode("_template").alias("w"))
    first = F.col("w").startswith(FIRST)
    words = words.groupBy(F.when(first, F.expr("substring(w, 2)")).otherwise(F.col("w")).alias("word")).agg(F.count_if(first).alias("n"), F.count_if(~first).alias("small"))
    return [r["word"] for r in words.where("n > 0 AND small > 0").orderBy(F.desc("n"), "word").limit(most).collect()]


def windows(words: str, size: int, tag: str) -> Column:
    """Hash of each run of `size` words of an array, in order, told apart by `tag`; none where there are fewer."""
    run = ", ".join(f"element_at(w, i + {k})" for k in range(size))
    hashed = f"transform({words}, x -> xxhash64(x))"  # each word once
    return F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(array({hashed}), w -> transform(sequence(1, size({words}) - {size - 1}), i -> xxhash64('{tag}', {run})))[0] ELSE array() END")


def item_windows(benchmark: DataFrame, openers: list[str], size: int, literal: int, shortest: int) -> DataFrame:
    """(item_id, item_pos, h, item_raw, marks, len, raw) of the windows by which benchmark(item_id, _text) is found.

    They are the runs of `size` template words with at least `literal` words that are no placeholder. An item that has none
    is found by its own words instead, of which no slot may change: by runs of `size` words, or by all its words if it has
    fewer, down to `shortest`."""
    whole = with_templates(benchmark.distinct(), F.col("_text"), openers).where(F.col("_template") != F.array(F.lit(""))).withColumn("n", F.size("_template"))
    own = lambda words, n: F.slice(words, F.col("item_pos") + 1, n)

    def cut(rows: DataFrame, words: str, n: int) -> DataFrame:
        rows = rows.select("item_id", "n", "_raw", "_template", F.posexplode(windows(words, n, f"{words}{n}")).alias("item_pos", "h"))
        marks = F.transform(own("_template", n), lambda w: w.isin(NUMBER, NAME, UNIT) & F.lit(words == "_template"))
        return rows.select("item_id", "item_pos", "h", own("_raw", n).alias("item_raw"), marks.alias("marks"), F.lit(n).alias("len"), F.lit(words == "_raw").alias("raw"))

    found = cut(whole, "_template", size).where(F.size(F.filter("marks", lambda x: ~x)) >= min(literal, size))
    rest = whole.join(found.select(F.col("item_id").alias("_has")).distinct(), F.col("item_id").eqNullSafe(F.col("_has")), "left_anti")
    found = found.unionByName(cut(rest, "_raw", size))
    for n in range(max(1, shortest), size):
        found = found.unionByName(cut(rest.where(F.col("n") == n), "_raw", n))
    return found


def presence(items: DataFrame, n_windows: int) -> Column | None:
    """Whether a hash may be that of an item's window, by a table of bytes that is part of the plan: 8 slots a window. None
    where the windows are too many to be sent along."""
    if n_windows > BROADCAST_WINDOWS:
        return None
    slots = bytearray(max(1 << 12, 8 * n_windows))
    for r in items.select("h").distinct().collect():
        slots[r["h"] % len(slots)] = 1
    return F.lit(bytes(slots))


def judged(found: DataFrame, spread: Callable[[Column], Column]) -> DataFrame:
    """Add coverage, n_windows, n_slots, verbatim and _fits to found(words, at, slots): the item's positions of the matched
    windows, and the distinct pairs of an item's value and the document's."""
    changed = F.filter("slots", lambda x: x["item"] != x["doc"])
    same = F.transform(F.filter("slots", lambda x: x["item"] == x["doc"]), lambda x: x["item"])
    # a document may hold the item verbatim and its numbers elsewhere too: values found unchanged need no second match
    other = F.filter(changed, lambda x: ~F.array_contains(same, x["item"]))
    values = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["item"])))
    return found.withColumns({
        "coverage": spread(F.col("at")) / F.col("words"), "n_windows": F.size("at").cast("long"), "n_slots": values(F.col("slots")).cast("long"),
        "verbatim": F.size(other) == 0, "_fits": values(other) == F.size(other),
    })


def nearby(rest: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each window of rest(doc_id, item_id, words, shift) beside the anchors of its pair that lie within an item's length, dealt
    by bins of that length. Null ids are ids here."""
    a, r = anchors.alias("a"), rest.withColumn("_bin", F.floor(F.col("shift") / F.col("words"))).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & F.col("r.item_id").eqNullSafe(F.col("a.item_id")) & (F.col("r._bin") == F.col("a._bin"))
    return r.join(a, same).select("r.*", "anchor").drop("_bin")


def hits_of(hashes: str, size: int, slots: Column | None) -> Column:
    """(pos, h, doc_raw) of the windows of a document that may be an item's, by the table of bytes; of all of them without one."""
    at = F.sequence(F.lit(0), F.size(hashes) - 1)
    if slots is not None:
        at = F.filter(at, lambda i: F.substring(slots, (F.pmod(F.get(hashes, i), F.length(slots)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))
    hit = F.transform(at, lambda i: F.struct(i.cast("int").alias("pos"), F.get(hashes, i).alias("h"), F.slice("_raw", i + 1, size).alias("doc_raw")))
    return F.when(F.size(hashes) > 0, hit)


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, size: int = SIZE, coverage: float = COVERAGE, literal: int = LITERAL, shortest: int = 1,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Pairs (doc_id, item_id, coverage, n_windows, n_slots, verbatim) of documents that hold a benchmark item.

    An item's windows are its runs of `size` template words with at least `literal` words that are no placeholder. A
    document holds the item if the windows they share cover at least `coverage` of the item's words that its windows
    cover at all, and the values in the shared windows' slots correspond one to one: an item's value always to the same
    document value. Windows whose values are equal on both sides always agree. `verbatim` tells that all values are equal.
    Where the whole document fails that test of values, each occurrence is tested by itself, so that a document may hold
    variants of one item side by side: around each alignment (position in the document less that in the item), the
    nearest window for each position of the item, of that alignment alone, within `size` words and within the item's
    length. The pair is reported with its best occurrence if any passes. Items that have no such window, such as short ones
    or mere numbers, are found by their own words, unchanged but for case and punctuation, down to `shortest` words.
    Names are slots wherever they stand: a word that begins a sentence is one unless the benchmark also writes it small.

    Null and empty texts give no pair; texts of any length are read whole, each window once. Rows with one id are one document
    (or item); null ids form one too. An empty table gives an empty result; other columns are ignored.

    The benchmark's windows are counted: up to BROADCAST_WINDOWS they travel with the plan, so documents aren't shuffled at all
    and only windows that are likely to match become rows; beyond it both sides are dealt by hash. Only matched windows
    are grouped, with map-side sums per document and item."""
    scratch = Scratch(documents.sparkSession, "leaks")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("_text"))
    openers = sentence_openers(items)
    items = scratch.write(item_windows(items, openers, size, literal, shortest), "items")
    spread = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + F.col("len") - 1)))))
    totals = items.groupBy("item_id", "len").agg(spread(F.collect_set("item_pos")).alias("words"))
    n_windows = items.count()
    near_to_all = n_windows <= BROADCAST_WINDOWS
    slots, side = presence(items, n_windows), F.broadcast(items) if near_to_all else items

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    docs, hits = with_templates(docs, F.col("_text"), openers), []
    for k, r in enumerate(sorted(items.select("len", "raw").distinct().collect())):
        words = "_raw" if r["raw"] else "_template"
        docs = docs.withColumn(f"_h{k}", windows(words, r["len"], f"{words}{r['len']}"))
        hits.append(hits_of(f"_h{k}", r["len"], slots))
    none = F.array().cast("array<struct<pos:int,h:bigint,doc_raw:array<string>>>")
    docs = docs.select("doc_id", F.explode(F.concat(*[F.coalesce(h, none) for h in hits], none)).alias("hit")).select("doc_id", "hit.*")
    met = docs.join(side, "h")
    changing = F.filter(F.arrays_zip("item_raw", "doc_raw", "marks"), lambda x: x["marks"])
    met = met.select(
        "doc_id", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.transform(changing, lambda x: F.struct(x["item_raw"].alias("item"), x["doc_raw"].alias("doc"))).alias("slots"),
    )
    met = scratch.write(met, "windows")  # so that the table of bytes stands in this one plan alone
    windows_met = F.collect_set(F.struct("item_pos", "shift", "slots"))
    found = met.groupBy("doc_id", "item_id").agg(windows_met.alias("met"))
    totals = totals.withColumnRenamed("item_id", "_item")
    found = found.join(F.broadcast(totals) if near_to_all else totals, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    found = found.where(spread(F.array_distinct(F.col("met.item_pos"))) / F.col("words") >= coverage)
    key, figures = ["doc_id", "item_id"], ["coverage", "n_windows", "n_slots", "verbatim"]
    found = scratch.write(found, "met")
    whole = judged(found.withColumns({"at": F.array_distinct("met.item_pos"), "slots": F.array_distinct(F.flatten("met.slots"))}), spread)
    fits = whole.where("_fits").select(*key, *figures)
    # the others may hold the item once or more often beside values that differ: each occurrence is judged by itself
    held = [*key, "words", "len"]
    rest = whole.where(~F.col("_fits")).select(*held, F.explode("met").alias("w")).select(*held, "w.*")
    anchors = rest.select(*key, "words", F.col("shift").alias("anchor")).distinct()
    anchors = anchors.select(*key, "anchor", F.explode(F.sequence(F.floor(F.col("anchor") / F.col("words")) - 1, F.floor(F.col("anchor") / F.col("words")) + 1)).alias("_bin"))
    near = nearby(rest, anchors)
    far = F.abs(F.col("shift") - F.col("anchor"))
    near = near.where(far <= F.col("words")).groupBy(*held, "anchor", "item_pos").agg(F.min(F.struct(far.alias("far"), "shift", "slots")).alias("w"))
    near = near.groupBy(*held, "anchor").agg(F.collect_list(F.struct("item_pos", "w.far", "w.slots")).alias("all"))
    near = near.withColumn("reach", F.explode(F.array_distinct(F.array(F.lit(0), F.lit(size), "words")))).withColumn("own", F.filter("all", lambda x: x["far"] <= F.col("reach")))
    near = judged(near.withColumns({"at": F.array_distinct("own.item_pos"), "slots": F.array_distinct(F.flatten("own.slots"))}), spread)
    best = near.where(F.col("_fits") & (F.col("coverage") >= coverage)).groupBy(*key).agg(F.max(F.struct("verbatim", "coverage", "n_windows", "n_slots")).alias("b"))
    return fits.unionByName(best.select(*key, *[F.col(f"b.{x}").alias(x) for x in figures]))


def remove_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no benchmark item of SHORTEST words or more, with all their columns, whatever their names. Rows with
    a null id stay; rows that repeat an id are one document, which goes if any of them holds an item."""
    (leaked,) = unlike(documents, "_leaked")
    found = find_leaks(documents, benchmark, id_col=id_col, **{"shortest": SHORTEST} | options).select(F.col("doc_id").alias(leaked)).where(F.col(leaked).isNotNull()).distinct()
    return documents.join(found, F.col(id_col).cast("long") == F.col(leaked), "left_anti")
