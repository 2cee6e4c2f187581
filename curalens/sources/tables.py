"""Readers: the driver's tables in the roles of tasks, turns and corpora, newest reports, and tables as sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. A local session without that setting, as in tests, gets a
    temporary one; on a cluster the setting must be there."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        place = f"file://{tempfile.mkdtemp(prefix='curalens-')}"
    return f"{place.rstrip('/')}/curalens-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as tasks: open unless the status is F, due at the order date (epoch seconds, UTC)."""
    due = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("content"), (F.col("o_orderstatus") == "F").alias("completed"), due.alias("due_at")
    )


def json_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases of multi-line JSON documents, each a list or an object with `cases`."""
    texts = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    cases = F.coalesce(F.try_variant_get("v", "$.cases", f"array<{schema}>"), F.try_variant_get("v", "$", f"array<{schema}>"))
    return texts.select(F.posexplode(cases).alias("ordinal", "case"))


def latest_report(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """The newest file that parses as a JSON object: path and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    texts = files.select("path", "modificationTime", F.decode("content", "UTF-8").alias("text"))
    return texts.where(F.try_parse_json("text").isNotNull() & F.col("text").rlike(r"^\s*\{")).orderBy(F.desc("modificationTime"), "path").limit(1).select("path", "text")


def scripted_responses(cases: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Cases with the response that a script gives for them, by id; a case without one has a null response."""
    return cases.join(responses, key, "left")


def write_new(df: DataFrame, path: str) -> None:
    """Write a report that must not exist yet. Spark's committer makes it visible whole or not at all."""
    df.write.mode("errorifexists").parquet(path)


def replace_whole(df: DataFrame, path: str) -> None:
    """Replace a plain Parquet folder by another. The new one is written beside it, the old one set aside and deleted last, so neither is
    ever lost; but between the two moves the folder is absent. Where readers or a crash may come between, use `commit_snapshot`."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.partial")
    at = spark._jvm.org.apache.hadoop.fs.Path
    new, here, aside = at(f"{path}.partial"), at(path), at(f"{path}.old")
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(here):
        files.delete(aside, True)
        if not files.rename(here, aside):
            raise OSError(f"cannot move {here} to {aside}")
    if not files.rename(new, here):
        raise OSError(f"cannot move {new} to {here}")
    files.delete(aside, True)


def snapshots(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, folder) of a snapshot table's committed versions, oldest first. An entry that was begun and never finished is none."""
    if not exists(spark, f"{path}/log"):
        return []
    rows = spark.read.text(f"{path}/log", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()  # one short line a version
    return sorted((int(r["name"]), r["value"].rstrip("\n")) for r in rows if r["value"].endswith("\n"))


def commit_snapshot(df: DataFrame, path: str, after: int | None = None) -> int:
    """Write `df` as the next version of the snapshot table at `path` and return its number.

    The rows go to a folder of their own; then one entry of the log is created, which must not exist yet, and names it. Readers see the
    old version until the entry is whole and the new one from then on; a writer that dies before leaves the table as it was. With `after`
    the version must follow that one directly, else FileExistsError: someone else was first. The creation is as indivisible as that of
    the file system. The rows may be computed from the version that they replace."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    at = spark._jvm.org.apache.hadoop.fs.Path
    log = at(f"{path}/log")
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(log)
    version = after + 1 if after is not None else 1 + max([int(f.getPath().getName()) for f in files.listStatus(log)], default=-1)
    entry = at(f"{path}/log/{version:020d}")
    try:
        out = files.create(entry, False)
    except Exception as error:
        files.delete(at(f"{path}/{folder}"), True)
        if files.exists(entry):
            raise FileExistsError(f"version {version} of {path} is already there") from error
        raise
    out.write(bytearray(f"{folder}\n".encode()))
    out.close()
    return version


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a snapshot table, or the one named."""
    found = dict(snapshots(spark, path))
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no such version of {path}: {version}")
    return spark.read.parquet(f"{path}/{found[max(found) if version is None else version]}")


def append_slice(df: DataFrame, path: str, ordinal: str, first: int, size: int) -> None:
    """Add the rows of one slice of ordinals to a growing result: what a job that is cut off loses is one slice at most, and a slice
    that is written again replaces itself."""
    part = df.where((F.col(ordinal) >= first) & (F.col(ordinal) < first + size))
    part.write.mode("overwrite").parquet(f"{path}/slice={first}")
