"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case and lower-case ASCII letters, the only ones that the word contracts fold.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one process, as in tests, a temporary folder is used; on a cluster a
    missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark, "_curalens_scratch", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="curalens-")
        spark._curalens_scratch = own
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/curalens-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs only the tasks that ran on it, never a whole upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder on whatever file system holds it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """The written tables of one run, by name. Writing a name again deletes the table that had it, after the new one is
    complete, so the new one may be made from the old; `drop` deletes tables that no later plan reads."""

    def __init__(self, spark: SparkSession, run: str) -> None:
        self.spark, self.run = spark, run
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.run}-{name}")
        df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            drop_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))


def give_back() -> None:
    """Return memory that a fit on the driver no longer uses to the system, where its allocator can be told to."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: The one cache of a Python worker: workers live on from task to task and from operator to operator.
_CACHE: dict[str, Any] = {}


def worker_cache(name: str, make: Callable[[], Any]) -> Any:
    """The worker's cache of that name. A worker keeps one cache alone: another name's is dropped first, so the caches of
    operators that run one after the other don't add up."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def portions(batch: pa.RecordBatch, at: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose column `at`, of text or binary, holds about `most_bytes`; one row at least."""
    column = batch.column(at)
    if batch.num_rows < 2 or column.nbytes <= most_bytes:
        yield batch
        return
    step = max(1, batch.num_rows * most_bytes // column.nbytes)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def unlike(df: DataFrame, *names: str) -> list[str]:
    """Each name, made longer until no column of `df` has it: helper columns that can't clash, whatever the case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges(a, b) of longs -> (node, component), component = smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., 2014). A step only ever links a node to the
    smallest node it knows, so the edge count never grows beyond that of the input. The smallest neighbour of each node is
    found by map-side aggregation; the edges of a hub meet it in a sort-merge join, whose skewed partitions Spark splits, as
    the side of the minima has one row a node. Every round is a table in the shared folder, which the next one replaces.
    """
    a, b = F.col("a"), F.col("b")
    scratch = Scratch(edges.sparkSession, "cc")
    edges = scratch.write(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        # settled when the edges are stars: no node has two roots, and no root hangs on another
        seen = edges.select("a").unionByName(edges.select(b.alias("a")).distinct())
        if seen.groupBy("a").count().where("count > 1").isEmpty():
            break
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(b.alias("a"), F.col("m").alias("b")).unionByName(small.select(a, F.col("m").alias("b")))
        edges = scratch.write(small.where(a != b).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(b.alias("node"), b.alias("component"))
    found = materialize(edges.select(a.alias("node"), b.alias("component")).unionByName(roots.distinct()), "components")
    scratch.drop("edges")
    return found
