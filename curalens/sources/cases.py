"""Case files: JSON documents read strictly, with every fault as a row, and files by digest, whatever their size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsontext import _write, read_strict

#: Bytes of a file that is read as one value, and of one block of a longer one.
WHOLE_FILE, BLOCK = 64 << 20, 8 << 20


def write_json_files(rows: DataFrame, name: str, value: str, path: str) -> None:
    """One file for each row, in the folder `name`=its name: the text `value` and a line feed."""
    rows.select(name, value).write.partitionBy(name).option("maxRecordsPerFile", 1).text(path)


def case_rows(spark: SparkSession, path: str, pattern: str = "*", id_field: str = "id") -> DataFrame:
    """(file, ordinal, record_id, record, fault) of the JSON files below a folder, each a list of cases or an object with `cases`.

    Files are listed and read by the engine's own text source, one value a file, so any file system will do and a lost task reads
    its files again. They are parsed strictly in Arrow batches. record is a case's canonical JSON. A file that can't be used is one row
    without an ordinal whose fault says why: `not strict JSON` or `no cases`. A case that is no object, or whose id is no whole number
    and no text with a letter or digit, has a fault too: `not an object`, `no id`. A file without bytes isn't listed by the
    engine's sources and gives no row, nor does an empty list; ids that repeat are told by `case_faults`."""
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    kind = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), ("record_id", pa.string()), ("record", pa.string()), ("fault", pa.string())])

    def cases(text: str) -> Iterator[tuple]:
        try:
            value = read_strict(text)
        except (ValueError, RecursionError):
            yield None, None, None, "not strict JSON"
            return
        held = value.get("cases") if isinstance(value, dict) else value
        if not isinstance(held, list):
            yield None, None, None, "no cases"
            return
        for at, case in enumerate(held):
            if not isinstance(case, dict):
                yield at, None, _write(case), "not an object"
                continue
            own = case.get(id_field)
            good = isinstance(own, int) and not isinstance(own, bool) or isinstance(own, str) and any(c.isalnum() for c in own)
            yield at, str(own) if good else None, _write(case), None if good else "no id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, *case) for case in cases(text.as_py())]
                for low in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[low : low + 10_000], strict=True), kind, strict=True)], schema=kind)

    return texts.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, "file string, ordinal long, record_id string, record string, fault string")


def good_cases(rows: DataFrame) -> DataFrame:
    """The cases of `case_rows` that have no fault of their own."""
    return rows.where("fault IS NULL").drop("fault")


def case_faults(rows: DataFrame) -> DataFrame:
    """(fault, record_id, file, n): all faults of `case_rows`, one row for each file and kind, and one for each id that more than one case
    has, with its first file. Ids are counted before they move, so one that most cases share is no single task."""
    own = rows.where("fault IS NOT NULL").groupBy("fault", "file").agg(F.count("*").alias("n")).select("fault", F.lit(None).cast("string").alias("record_id"), "file", "n")
    again = good_cases(rows).groupBy("record_id").agg(F.min("file").alias("file"), F.count("*").alias("n")).where("n > 1")
    return own.unionByName(again.select(F.lit("repeated id").alias("fault"), "record_id", "file", "n"))


def block_digest(path: str, block: int = BLOCK) -> str:
    """SHA-256 of a file, a block at a time."""
    from pyarrow import fs

    if path.startswith("file:"):  # paths of the engine are not escaped
        files, where = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        scheme, rest = path.split("://", 1)
        host, _, inner = rest.partition("/")
        files, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        where = f"{root.rstrip('/')}/{inner}"
    total = hashlib.sha256()
    with files.open_input_stream(where) as source:
        while piece := source.read(block):
            total.update(piece)
    return total.hexdigest()


def file_digests(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE_FILE) -> DataFrame:
    """(path, length, sha256) of the files below a folder, one row a file. The engine's sources don't list files without
    bytes; against a manifest these are missing.

    Files of at most `whole` bytes are values of the binary source, whose reader is told the bound; of longer ones only the names are
    read there, and a task hashes them a block at a time, so a file's size is bounded by no value and no memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    short = files.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([block_digest(p) for p in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["path", "length", "sha256"])

    long = files.where(F.col("length") > whole).select("path", "length").mapInArrow(run, "path string, length long, sha256 string")
    return short.unionByName(long)


def folder_digest(files: DataFrame) -> DataFrame:
    """files(folder, path, sha256) -> (folder, digest): SHA-256 over the sorted relative paths, each as its 8-byte length,
    its bytes and its file's digest. The digest is sequential by its definition, so a folder is one stretch of one task; its files
    stream through it in the order of an external sort and are never held together."""
    name = F.col("path").cast("binary")
    spread = files.select("folder", name.alias("path"), F.unhex("sha256").alias("sha256")).repartition("folder").sortWithinPartitions("folder", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, total = None, None
        for batch in batches:
            names, digests = [], []
            for at, path, digest in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if total is None or at != folder:
                    if total is not None:
                        names.append(folder)
                        digests.append(total.hexdigest())
                    folder, total = at, hashlib.sha256()
                total.update(len(path).to_bytes(8, "big") + path + digest)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string())], ["folder", "digest"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([folder], pa.string()), pa.array([total.hexdigest()], pa.string())], ["folder", "digest"])

    return spread.mapInArrow(run, "folder string, digest string")


def named(path: str | Column, name: str) -> Column:
    """The name that `write_json_files` gave a file."""
    return F.regexp_extract(path, rf"{name}=([^/]+)/", 1)
