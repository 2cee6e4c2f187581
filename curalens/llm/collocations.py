"""Phrase collocations: n-grams counted by language, scored exactly at their weakest cut, without those that a longer phrase covers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, Scratch, give_back, portions

#: Default parameters: words of a phrase, least count, percent of a phrase's count at which a longer one covers it, rows a language.
MOST_WORDS, LEAST_COUNT, COVER_PERCENT, TOP = 3, 10, 50, 2000
#: Bits of the filter of frequent phrases (8 MB, whatever the input), and bits of one bitmap of Spark's functions.
FILTER_BITS, BITMAP_BITS = 1 << 26, 1 << 15
#: Words that a task counts together before it hands rows on, and rows that it hands on at once.
COUNTED_WORDS, SENT_ROWS = 700_000, 20_000
#: Characters that end a piece of text; a language's name where there is none.
PIECE_ENDS, NO_LANG = ".,;:!?\n\x0b\x0c\r", "und"
#: One byte for one: letters folded, ends of pieces as line feeds.
FOLD = bytes.maketrans((UPPER + PIECE_ENDS).encode(), LOWER.encode() + b"\n" * len(PIECE_ENDS))


class Pieces:
    """Words of whole texts as numbers, and the pieces that they lie in."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        folded = pa.py_buffer(memoryview(data.to_pybytes().translate(FOLD))) if data is not None else pa.py_buffer(b"")
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, folded], offset=texts.offset)
        split = pc.ascii_split_whitespace(pc.split_pattern(texts, "\n").flatten())
        words, ends = split.flatten(), np.asarray(split.offsets)
        solid = np.asarray(pc.not_equal(words, ""))
        ends = np.concatenate([[0], np.cumsum(solid)])[ends - ends[0]]
        coded = words.filter(pa.array(solid)).dictionary_encode()
        self.words, self.ids = coded.dictionary, np.asarray(coded.indices)
        self.end = np.repeat(ends[1:].astype(np.int32), np.diff(ends))  # of the piece that each word lies in

    def grams(self, sizes: tuple[int, int], frequent=None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(distinct phrases of n words, their counts) for n from sizes[0] to sizes[1]. `frequent` keeps, of the phrases one word shorter than
        sizes[0], those that may be frequent; longer ones are only built on them."""
        here, names = self.ids, self.words
        at = np.arange(len(here), dtype=np.int32)
        if sizes[0] == 1:
            yield names, np.bincount(here, minlength=len(names))
        for n in range(2, sizes[1] + 1):
            last = at + n - 1
            on = last < self.end[at]
            if n == sizes[0] and frequent is not None:
                keep = frequent(names)[here]
                follows = np.zeros(len(self.ids) + 1, bool)
                follows[at[keep]] = True
                on &= keep & follows[at + 1]
            at, here = at[on], here[on]
            keys = here.astype(np.int64) * len(self.words) + self.ids[at + n - 1]
            if n == sizes[1]:
                found, counts = np.unique(keys, return_counts=True)
            else:
                found, here, counts = np.unique(keys, return_inverse=True, return_counts=True)
            head, tail = np.divmod(found, max(1, len(self.words)))
            names = pc.binary_join_element_wise(names.take(pa.array(head)), self.words.take(pa.array(tail)), pa.scalar(" ", pa.large_string()))
            if n >= sizes[0]:
                yield names, counts


def frequent_bits(grams: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits with a bit for each (lang, phrase): built by Spark's bitmap aggregation, so that the driver gets
    at most 2,048 rows of 4 KB, however many phrases there are. A fuller filter lets more through and loses nothing."""
    place = F.pmod(F.xxhash64("lang", "phrase"), F.lit(FILTER_BITS)) + 1
    parts = grams.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    size, filled = BITMAP_BITS // 8, bytearray(FILTER_BITS // 8)
    for row in parts.toLocalIterator():
        filled[(row["part"] - 1) * size : row["part"] * size] = row["bits"]
    return bytes(filled)


def count_grams(docs: DataFrame, sizes: tuple[int, int], filter_bits=None) -> DataFrame:
    """(lang, phrase, f): rows of every n-gram with n in `sizes`, counted in each task first, then by hash aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_bits is None else np.frombuffer(filter_bits.value, np.uint8)
        held: dict[str, list[pa.Array]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                pieces, names, counts = Pieces(pa.concat_arrays(held.pop(lang))), None, None
                seed = xxhash.xxh64_intdigest(lang.encode(), 42)  # as Spark's xxhash64 goes on from column to column

                def frequent(names: pa.Array, seed: int = seed) -> np.ndarray:
                    at = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names)) % np.uint64(FILTER_BITS)
                    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

                for names, counts in pieces.grams(sizes, None if bits is None else frequent):
                    for at in range(0, len(names), SENT_ROWS):
                        part = names.slice(at, SENT_ROWS).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), part, pa.array(counts[at : at + SENT_ROWS], pa.int64())], ["lang", "phrase", "f"])
                del pieces, names, counts
            give_back()

        for batch in (p for whole in batches for p in portions(whole, 1)):
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                held.setdefault(lang, []).append(batch.column(1).filter(pc.equal(langs, lang)).cast(pa.large_string()))
            size += batch.column(1).nbytes
            if size >= 6 * COUNTED_WORDS:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def collocations(documents: DataFrame, most_words: int = MOST_WORDS, least_count: int = LEAST_COUNT, cover_percent: int = COVER_PERCENT, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to `most_words` words.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and those into words at spaces and tabs. Words and pairs
    become rows and are counted by hash aggregation; a longer n-gram is counted in a further pass wherever the n-grams of one word less
    at both of its ends may be frequent, as it can't be frequent otherwise: that is asked of a filter of fixed size, which errs on the
    safe side alone. A candidate with count a is cut after each word; l and r are the counts of both parts, and the lowest
    floor(1000000 a a / (l r)) counts, first cut first. Decimals hold 38 digits, so counts up to 10^16 are exact; beyond,
    Spark raises an error and never rounds. Candidates that a phrase longer by one word covers go by an anti-join; one that is longer still is
    never more frequent than the one between them, so it needs no look.

    Null and empty texts have no words, a null lang is `und`, repeated rows count as often, ties go to the smaller phrase in byte
    order, very long texts are counted whole, an empty table gives no rows, other columns are ignored whatever their names."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "collocations")
    docs = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = count_grams(docs, (1, min(2, most_words))).where((F.col("f") >= least_count) | (F.instr("phrase", " ") == 0))
    grams = scratch.write(pairs.withColumn("n", F.when(F.instr("phrase", " ") == 0, 1).otherwise(2)), "grams2")
    totals = grams.where("n = 1").groupBy("lang").agg(F.sum("f").alias("total"))
    grams = grams.where(F.col("f") >= least_count)
    for n in range(3, most_words + 1):
        sent = spark.sparkContext.broadcast(frequent_bits(grams.where(F.col("n") == n - 1)))
        longer = scratch.write(count_grams(docs, (n, n), sent).where(F.col("f") >= least_count).withColumn("n", F.lit(n)), f"grams{n}")
        sent.unpersist()
        grams = grams.unionByName(longer)
    phrases = grams.where("n > 1")
    # every cut of every candidate: the first k words and the rest
    cuts = phrases.select("lang", "phrase", "n", "f", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - n)"))
    known = grams.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("f", "l", "r")}
    cuts = cuts.withColumn("square", exact["f"] * exact["f"] * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("product", exact["l"] * exact["r"])
    weakest = F.min(F.struct(F.expr("square div product").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "n", "f").agg(weakest).select("lang", "phrase", "n", "f", "cut.score", "cut.l", "cut.r")
    # one-word extensions: a longer candidate covers its first and its last words
    inner = F.expr("array(substring_index(phrase, ' ', n - 1), substring_index(phrase, ' ', 1 - n))")
    wider = phrases.where("n > 2").select("lang", F.explode(inner).alias("inside"), F.col("f").alias("wider"))
    wider = wider.groupBy("lang", "inside").agg(F.max("wider").alias("wider")).withColumnRenamed("lang", "lang_")
    covered = (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inside")) & (100 * F.col("wider") >= cover_percent * F.col("f"))
    left = scored.join(wider, covered, "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score")
