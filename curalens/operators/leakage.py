"""Train and test leakage: exact, masked and near matches of short texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import shared_folder

#: Segments that a pair must share before it is compared, and bits of the filter of the reference's segments (8 MB, whatever the input).
#: Thresholds up to LEAST_INDEXED leave no segment worth a name, and bands of length serve.
SHARED, FILTER_BITS, LEAST_INDEXED = 2, 1 << 26, 0.7
#: Bits of one bitmap of Spark's functions.
BITMAP = 1 << 15


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC, case folding and collapsed white space."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def masked(text: str | None, payloads: list[str] | None) -> str | None:
    """NFKC and case folding; payloads, longest first, and numbers as placeholders; other punctuation as one space."""
    if text is None:
        return None
    out = unicodedata.normalize("NFKC", text).casefold()
    for p in sorted({p for p in payloads or [] if p}, key=lambda p: (-len(p), p)):
        out = out.replace(unicodedata.normalize("NFKC", p).casefold(), " <payload> ")
    return re.sub(r"[^\w<>]+", " ", re.sub(r"\d+", " <id> ", out)).strip()


@F.pandas_udf(T.StringType())
def shape(text: pd.Series, payloads: pd.Series) -> pd.Series:
    return pd.Series([masked(t, None if p is None else list(p)) for t, p in zip(text, payloads, strict=True)])


def gram_bound(a: list[str], b: list[str], least: float, size: int = 2, slots: int = 1024) -> np.ndarray:
    """Whether the grams of `size` characters that two texts share, counted in buckets of a hash, allow the ratio `least`: an exact bound.
    With x and y characters outside the matching blocks of m and n, at most q x + (q - 1) y of the first text's grams aren't whole in a block, and
    the other way round; whole ones are common, so at least (m + n) / 2 - q + 1 - (2 q - 1) (x + y) / 2 are, and x + y is at most (1 - least)(m + n)."""
    held, lengths = [], []
    for texts in (a, b):
        grams, text, length = gram_keys(texts, size)
        held.append(np.bincount(text * slots + (grams % np.uint64(slots)).astype(np.int64), minlength=len(texts) * slots))
        lengths.append(length)
    common = np.minimum(*held).reshape(len(a), slots).sum(1)
    both = lengths[0] + lengths[1]
    return common >= both / 2 - size + 1 - (2 * size - 1) / 2 * np.floor((1 - least) * both + 1e-9) - 1e-9


def similarity(a: Column | str, b: Column | str, least: float = 0.0) -> Column:
    """Matching-blocks ratio (Ratcliff and Obershelp), first text against second; it isn't symmetric. Null where it stays below `least`:
    the pairs of letters that both have, and then their letters, in any order, bound the ratio, and most pairs end there."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, matcher = [], None, SequenceMatcher(autojunk=False)
        for begin, end in stretches(a.str.len().to_numpy() + b.str.len().to_numpy()):
            x, y = a.iloc[begin:end].tolist(), b.iloc[begin:end].tolist()
            for first, second, may in zip(x, y, gram_bound(x, y, least).tolist(), strict=True):
                found = -1.0
                if may:
                    if second != last:
                        matcher.set_seq2(second)  # the second text's index is kept while it stays the same
                        last = second
                    matcher.set_seq1(first)
                    found = matcher.ratio() if matcher.quick_ratio() >= least else -1.0
                out.append(found if found >= least else None)
        return pd.Series(out, dtype="float64")

    return ratio.asNondeterministic()(a, b)  # so that a condition on it doesn't work it out again


def stretches(sizes: np.ndarray, most: int = 1_000_000, rows: int = 2_000) -> Iterator[tuple[int, int]]:
    """Stretches (begin, end) of rows of these sizes, each of about `most` and of `rows` rows at most; one row at least."""
    whole, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = int(whole[begin - 1]) if begin else 0
        end = min(begin + rows, max(begin + 1, int(np.searchsorted(whole, done + most, "right"))))
        yield begin, end
        begin = end


def normalized(text: str | None) -> str | None:
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def masked_fields(text: str | None, content: str | None, when: str | None) -> str | None:
    """The other mask: white space collapsed, content and when as placeholders of their own, standing numbers as ids, punctuation kept."""
    if text is None:
        return None
    out = normalized(text)
    for name, raw in (("content", content), ("when", when)):
        if raw:
            out = out.replace(normalized(raw), f"<{name}>")
    return re.sub(r"(?<!\w)\d+(?!\w)", "<id>", out)


@F.pandas_udf(T.StringType())
def field_mask(text: pd.Series, content: pd.Series, when: pd.Series) -> pd.Series:
    return pd.Series([masked_fields(t, c, w) for t, c, w in zip(text, content, when, strict=True)])


def exact_matches(audited: DataFrame, reference: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, ref_id, refs): each audited row whose text is in the reference, after folding, with the smallest id of the texts that it
    equals and their number. A folded text is one class, whatever its copies on either side, so the result is linear in the
    audited rows; the reference has one row a class by then, so copies of one text are split like any skewed side."""
    a = audited.select(F.col(key).alias("id"), fold(F.col(text)).alias("folded"))
    b = reference.select(F.col(key).alias("ref_id"), fold(F.col(text)).alias("folded"))
    classes = b.groupBy("folded").agg(F.min("ref_id").alias("ref_id"), F.count("*").alias("refs"))
    return a.join(classes, "folded").select("id", "ref_id", "refs")


def exact_classes(rows: DataFrame, text: str) -> DataFrame:
    """(id, is_reference, class_id, links): every row of rows(id, is_reference, text) with the class of its text, named by the smallest id of the
    reference rows in it, and the number of rows of the other side that have the text. The pairs are those of an audited and a reference
    row of one class, so none is lost, and the result is linear in the rows, whatever the copies. Rows whose text is null or empty, and
    audited rows without a match, have no class and no links; a key of their own keeps them from meeting in one task."""
    known, side = F.when(F.col(text) != "", F.sha2(F.col(text).cast("binary"), 256)), F.col("is_reference")
    rows = rows.select("id", "is_reference", known.alias("_text"))
    counted = rows.where(F.col("_text").isNotNull()).groupBy("_text").agg(F.min(F.when(side, F.col("id"))).alias("class_id"), F.count_if(side).alias("_refs"), F.count_if(~side).alias("_audited"))
    key = F.coalesce("_text", F.concat(F.lit("none "), F.col("id").cast("string")))
    links = F.coalesce(F.when(side, F.col("_audited")).otherwise(F.col("_refs")), F.lit(0).cast("long"))
    return rows.withColumn("_text", key).join(counted, "_text", "left").select("id", "is_reference", "class_id", links.alias("links"))


def length_band(audited: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose lengths allow a ratio of `threshold`: 2 min / (min + max) >= threshold, an exact bound.

    Lengths are dealt into bands of ratio r = threshold / (2 - threshold): a pair that may pass lies in the same or an
    adjacent band, so this is an equi-join. audited(id, text), reference(ref_id, ref_text); texts aren't empty."""
    ratio = threshold / (2 - threshold)
    step = F.log(F.lit(1 / ratio)) if ratio < 1 else F.lit(1e-9)
    a = audited.withColumns({"la": F.length("text"), "ba": F.floor(F.log(F.length("text").cast("double")) / step)}).where("la > 0")
    b = reference.withColumns({"lb": F.length("ref_text"), "bb": F.floor(F.log(F.length("ref_text").cast("double")) / step)}).where("lb > 0")
    b = b.withColumn("ba", F.explode(F.array(F.col("bb") - 1, F.col("bb"), F.col("bb") + 1)))
    fits = 2 * F.least("la", "lb") >= F.lit(threshold) * (F.col("la") + F.col("lb")) - 1e-9
    return a.join(b, "ba").where(fits).drop("ba", "bb", "la", "lb")


def letters(text: Column) -> Column:
    """How often each character of a text occurs, in order of the characters: the sorted text, whose common part with another's bounds the
    matching blocks that the two can have."""
    return F.array_sort(F.split(text, ""))


def may_reach(a: Column, b: Column, la: Column, lb: Column, threshold: float) -> Column:
    """Whether two texts' characters, whatever their order, allow the ratio: an exact bound. The common part of two sorted lists of
    characters is their lengths less half of what each has beyond the other, counted by character."""
    kinds = F.array_distinct(a)
    n = lambda where, c: F.size(F.filter(where, lambda x: x == c))
    common = F.aggregate(kinds, F.lit(0), lambda total, c: total + F.least(n(a, c), n(b, c)))
    return 2 * common >= F.lit(threshold) * (la + lb) - 1e-9


def hashes(codes: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each stretch of `size` characters that begins at `begin`."""
    found = np.full(len(begin), size, np.uint64)
    for k in range(size):
        found = found * np.uint64(0x100000001B3) + codes[begin + k] + np.uint64(1)
    return mixed(found)


def mixed(found: np.ndarray) -> np.ndarray:
    for _ in range(2):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(32))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and where each text begins and how long it is."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.cumsum(lengths) - lengths, lengths


def counted(each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, k): each text's number as often as `each` says, counted from 0."""
    text = np.repeat(np.arange(len(each)), each)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)


def gram_keys(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, lengths) of all grams of `size` characters: the number of each one's text, and the texts' lengths."""
    codes, starts, lengths = codes_of(texts)
    text, at = counted(np.maximum(lengths - size + 1, 0))
    return hashes(codes, starts[text] + at, size), text, lengths


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into parts by the bytes of a text column."""
    for batch in batches:
        for begin, end in stretches(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), rows=batch.num_rows):
            yield batch.slice(begin, end - begin)


def segments(lengths: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(number, need) for texts of these lengths: the segments that each is cut into, and how many of them any text that reaches the
    threshold must hold."""
    most = (2 * lengths * (1 - threshold) / threshold + 1e-9).astype(np.int64)
    need = np.minimum(SHARED, np.maximum(lengths - most, 1))
    return most + need, need


def bands_of(lengths: np.ndarray, threshold: float) -> np.ndarray:
    """The band of each length: two that allow the threshold lie in one or in neighbours."""
    return np.floor(np.log(np.maximum(lengths, 1)) / (np.log((2 - threshold) / threshold) * (1 + 1e-9) + 1e-12)).astype(np.int64)


def key_of(found: np.ndarray, bands: np.ndarray) -> np.ndarray:
    return mixed(found + bands.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def reference_segments(texts: DataFrame, threshold: float) -> DataFrame:
    """(ref_id, ref_length, key, ref_at, need) of texts(id, text): each segment, for texts of its band and of both neighbours.

    A ratio of t or more leaves at most d = (1 - t)(m + n) characters outside the matching blocks, for m and n the lengths, and m is
    at most n (2 - t) / t, so at most d = 2 n (1 - t) / t. Each of them spoils at most one segment: it lies in it, or between two of its
    characters. So of d + k segments k are whole in the other text, at places at most d apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            codes, starts, lengths = codes_of(batch.column(1).to_pylist())
            number, need = segments(lengths, threshold)
            text, k = counted(np.where(lengths > 0, number, 0))
            at, end = k * lengths[text] // number[text], (k + 1) * lengths[text] // number[text]
            found = np.zeros(len(text), np.uint64)
            for size in np.unique(end - at).tolist():
                here = end - at == size
                found[here] = hashes(codes, starts[text[here]] + at[here], size)
            bands = bands_of(lengths, threshold)[text]
            for by in (-1, 0, 1):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(text)), pa.array(lengths[text].astype(np.int32)), pa.array(key_of(found, bands + by)), pa.array(at.astype(np.int32)),
                    pa.array(need[text].astype(np.int32)),
                ], ["ref_id", "ref_length", "key", "ref_at", "need"])

    return texts.select("id", "text").mapInArrow(run, "ref_id long, ref_length int, key long, ref_at int, need int")


def segment_filter(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with one for each key. Bitmaps are formed in the tasks, so the driver gets 8 MB at most. A large
    reference fills it and lets more through; what is found stays the same."""
    place, bits = F.pmod("key", F.lit(FILTER_BITS)), np.zeros(FILTER_BITS // 8, np.uint8)
    for r in keys.groupBy(F.floor(place / BITMAP).alias("part")).agg(F.bitmap_construct_agg((place % BITMAP).cast("long")).alias("bits")).toLocalIterator():
        bits[r["part"] * BITMAP // 8 : (r["part"] + 1) * BITMAP // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bits


def segment_sizes(length: int, threshold: float) -> list[int]:
    """The lengths of the segments of all texts that may be near one of this length."""
    near = np.arange(max(1, int(length * threshold / (2 - threshold) - 1e-6)), int(length * (2 - threshold) / threshold + 1e-6) + 1)
    number = segments(near, threshold)[0]
    return np.unique(np.r_[near // number, -(-near // number)]).tolist()


def audited_segments(texts: DataFrame, threshold: float, bits: np.ndarray) -> DataFrame:
    """(id, length, key, at) of texts(id, text): every stretch that the filter takes for a segment of a reference text in a band beside its own."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, list[int]] = {}
        for batch in pieces(batches, 1):
            batch = batch.take(pa.array(sorted({(i, t): k for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if t}.values()), pa.int64()))  # copies once
            codes, starts, lengths = codes_of(batch.column(1).to_pylist())
            bands, use = bands_of(lengths, threshold), {}
            for k, m in enumerate(lengths.tolist()):
                if m not in sizes:
                    sizes[m] = segment_sizes(m, threshold) if m else []
                for size in sizes[m]:
                    use.setdefault(size, []).append(k)
            for size, which in use.items():
                own = np.array(which)
                text, at = counted(np.maximum(lengths[own] - size + 1, 0))
                text = own[text]
                key = key_of(hashes(codes, starts[text] + at, size), bands[text])
                place = key % FILTER_BITS
                held = shared.value[place >> 3] >> (place & 7) & 1 > 0
                text = text[held]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array(lengths[text].astype(np.int32)), pa.array(key[held]), pa.array(at[held].astype(np.int32))], ["id", "length", "key", "at"])

    return texts.select("id", "text").mapInArrow(run, "id long, length int, key long, at int")


def named(texts: DataFrame) -> DataFrame:
    """Texts with a number each, a hash: where it is shared by chance, both texts are compared."""
    return texts.withColumn("id", F.xxhash64("text"))


def near_ids(audited: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """(id, ref_id): the numbers of every pair of texts that may reach the ratio `threshold`, equal ones too, and of few others.

    Rows of audited(id, text) and reference(id, text) may repeat a text; empty ones meet nothing. The reference's texts are cut into segments; an audited
    text meets them at the stretches that pass the filter, within a band of length, and then places and lengths must agree, at as many
    segments as both must share. All bounds are exact. Numbers alone move, and only of stretches that the filter takes for segments; a
    frequent one's side with more rows is split by Spark's skew handling, as a plain equi-join allows."""
    b = reference_segments(reference, threshold)
    a = audited_segments(audited, threshold, segment_filter(b))
    both = F.col("length") + F.col("ref_length")
    apart = F.floor((1 - threshold) * both + 1e-9)
    close = (F.abs(F.col("at") - F.col("ref_at")) <= apart) & (2 * F.least("length", "ref_length") >= F.lit(threshold) * both - 1e-9)
    met = a.join(b, "key").where(close)
    met = met.groupBy("id", "ref_id").agg(F.size(F.collect_set("ref_at")).alias("shared"), F.min("need").alias("need"))
    return met.where("shared >= need").select("id", "ref_id")


def near_candidates(audited: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """(text, ref_text): every pair of different texts that may reach the ratio `threshold`, and few others. audited(text) and
    reference(ref_text) are distinct texts that aren't empty. Equal texts are no candidates: they are found as classes."""
    if threshold <= LEAST_INDEXED:
        return length_band(audited, reference, threshold).where("text <> ref_text").select("text", "ref_text")
    a, b = named(audited.select("text")), named(reference.select(F.col("ref_text").alias("text")))
    met = near_ids(a, b, threshold)
    return met.join(a, "id").join(b.select(F.col("id").alias("ref_id"), F.col("text").alias("ref_text")), "ref_id").where("text <> ref_text").select("text", "ref_text")


def nearest(audited: DataFrame, reference: DataFrame, threshold: float, key: list[str], ties: list[str], last: bool = False) -> DataFrame:
    """The most similar reference text of each audited row at `threshold` or more. Of equal scores the first in the order of `ties` wins,
    or the last.

    Texts are compared once, however many rows have them: a reference text is reduced to the row that wins among its own; pairs of
    texts come from an index of segments, by numbers, so of the audited rows only those in a pair are dealt out. These are written
    once, so the audited rows are worked out twice. The ratio is worked out for distinct texts, and rows join their text's winner at the end.
    Empty texts match nothing."""
    pick = F.max if last else F.min
    others = [c for c in reference.columns if c != "ref_text"]
    order = F.struct(*[F.col(t).alias(f"_t{k}") for k, t in enumerate(ties)], F.struct(*others).alias("_ref"))
    refs = reference.where("ref_text <> ''").groupBy("ref_text").agg(pick(order).alias("_o"))
    known = refs.select("ref_text")
    if threshold <= LEAST_INDEXED:
        rows = audited.where("text <> ''")
        met = near_candidates(rows.select("text").distinct(), known, threshold)
    else:
        b = named(known.select(F.col("ref_text").alias("text")))
        ids = kept(near_ids(named(audited.select("text")), b, threshold))
        rows = kept(audited.withColumn("_id", F.xxhash64("text")).join(ids.select(F.col("id").alias("_id")).distinct(), "_id", "left_semi"))
        pairs = rows.select(F.col("_id").alias("id"), "text").distinct().join(ids, "id").join(b.select(F.col("id").alias("ref_id"), F.col("text").alias("ref_text")), "ref_id")
        met = pairs.where("text <> ref_text").select("text", "ref_text")
    scored = met.withColumn("score", similarity("text", "ref_text", threshold)).where(F.col("score").isNotNull())
    equal = rows.select("text").distinct().join(known, F.col("text") == F.col("ref_text")).withColumn("score", F.lit(1.0))
    pairs = scored.unionByName(equal).join(refs, "ref_text")
    best = F.struct((F.col("score") if last else -F.col("score")).alias("_s"), "_o", "ref_text", "score")
    won = pairs.groupBy("text").agg(pick(best).alias("_b")).select(F.col("text").alias("_text"), "_b.ref_text", "_b.score", "_b._o._ref.*")
    extra = [c for c in audited.columns if c not in (*key, "text")]
    return rows.join(won, F.col("text") == F.col("_text")).select(*key, "text", *extra, "ref_text", *others, "score")


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are written once and read again."""
    path = shared_folder(rows.sparkSession, "leakage")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def last_of_each(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Deduplicate by key, keeping the last row: found by map-side aggregation, so a key's rows never meet."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(ordinal)).alias("_row")).select(*key, "_row.*").select(*rows.columns)


def union_last(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """One corpus of several: rows that agree in `key` are one, the last of them, in the order of the parts and of `ordinal` within them."""
    whole = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return last_of_each(whole.withColumn("_at", F.struct("_part", "ordinal")), key, "_at").drop("_part", "_at")
