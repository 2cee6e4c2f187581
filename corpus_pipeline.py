"""From raw documents to packed training sequences.

Stages, in order: toxic documents go; documents of low quality go; one document of each near-duplicate group stays;
documents that hold a benchmark item go; the rest is packed into windows. Each stage works on all that its predecessor
kept and is written as Parquet in the shared folder, so a lost executor never costs more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalens.llm import quality, toxicity
from curalens.llm.common import Scratch, materialize, table, unlike
from curalens.llm.decontaminate import remove_leaks
from curalens.llm.minhash import near_duplicates
from curalens.llm.packing import pack_documents
from curalens.llm.queries import tokenizer_path


#: Least Jaccard similarity of near duplicates, in hundredths; op8_minhash has a threshold of its own.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: reject documents that the toxic-segment model scores 0.5 or more. Null and empty texts score the floor and
    stay; repeated rows are judged alike; an empty table stays empty."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: reject documents that the rule ensemble scores below 0.5. Null and empty texts are judged by their all-zero
    statistics; repeated rows are judged alike; an empty table stays empty."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each near-duplicate group stays, that with the smallest id.

    A row is told by its id and its text's hash, so rows that repeat an id with other texts are judged by their own texts; of
    several rows of one group with the smallest id, that with the least hash stays, and of rows equal in both, one. Texts
    without words are in no group and go only as repeated rows; rows with a null id stay. Only ids and hashes are joined, so
    texts move for repeated rows alone."""
    same = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = materialize(near_duplicates(docs, percent=NEAR_PERCENT, carry=same).where(F.col("doc_id").isNotNull()), "groups")
    rows = found.where("kept").groupBy("doc_id", "carried").agg(F.count("*").alias("n"), F.max("n_shingles").alias("words"))
    first = rows.where("words > 0").groupBy("doc_id").agg(F.min("carried").alias("first"), F.count("*").alias("texts")).where("texts > 1")
    others = rows.where("words > 0").join(first, "doc_id").where("carried <> first").select("doc_id", "carried")
    ident, mark = unlike(docs, "_id", "_same")
    here = (F.col("doc_id").cast("long") == F.col(ident)) & (same == F.col(mark))

    def listed(ids: DataFrame, name: str) -> DataFrame:
        # written first, so that a short list is seen to be short and is broadcast by size
        return materialize(ids.select(F.col("doc_id").alias(ident), F.col("carried").alias(mark)).distinct(), name)

    kept = docs.join(listed(found.where("not kept").select("doc_id", "carried").unionByName(others), "copies"), here, "left_anti")
    again = listed(rows.where("n > 1").join(others, ["doc_id", "carried"], "left_anti"), "again")
    if again.isEmpty():
        return kept
    (key,) = unlike(docs, "_key")
    once = kept.join(again, here, "left_semi").withColumn(key, same).dropDuplicates(["doc_id", key]).drop(key)
    return kept.join(again, here, "left_anti").unionByName(once)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: reject documents that hold a benchmark item, verbatim or with its parameters changed. Null and empty texts hold
    none; rows that repeat an id are one document; rows with a null id stay; an empty table stays empty."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the packing, one row per piece. Null and empty texts have the end alone; repeated rows are packed as often."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_windows),
]

#: The learned scores and the tokenizer's ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents: each result is written as Parquet and reread as the next stage's input."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), "stage")  # replaces the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
