"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots). Inverted lists are kept by triples of these pivots, so
that vectors that meet in a list share three pivots or more; each pair is then verified once, by its cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

#: Default parameters: least cosine, nearest pivots that describe a vector, pivots that a pair must share, bounds on the
#: number of pivots, and rows of a list that are compared in one block.
COSINE, NEAREST, SHARED, LEAST_PIVOTS, MOST_PIVOTS, BLOCK = 0.95, 7, 3, 128, 4096, 1024
#: Pivots are less alike than this, so that a large group of copies can't take them all.
APART = 0.6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow for very large or small components."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and bool(np.isfinite(a := np.array(vector, np.float64)).all()) and bool(a.any())


def read_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dim, digest): digest of the components, null for vectors that can't be compared."""
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, digests = [], []
            for v in batch.column(1).to_pylist():
                good = usable(v)
                dims.append(len(v) if good else None)
                digests.append(hashlib.blake2b((np.array(v, np.float64) + 0.0).tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(digests, pa.binary())], ["vec_id", "v", "dim", "digest"])

    return chosen.mapInArrow(run, "vec_id long, v array<double>, dim int, digest binary")


def choose_pivots(sample: np.ndarray, wanted: int, apart: float = APART) -> np.ndarray:
    """Pivots from a sample of unit vectors, in order, each of cosine under `apart` to those before; the limit is relaxed
    until there are enough or the sample is used up."""
    chosen: list[int] = []
    best = np.full(len(sample), -1.0)
    while len(chosen) < wanted and apart < 1.0:
        for i in range(len(sample)):
            if len(chosen) < wanted and best[i] < apart:
                chosen.append(i)
                best = np.maximum(best, sample @ sample[i])
        apart += 0.1
    return sample[chosen]


def describe(vectors: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Add perm: the numbers of the `nearest` pivots, ascending."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    at, k = vectors.columns.index("v"), min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                x = unit(np.array(part.column(at).to_pylist(), np.float64))
                close = np.sort(np.argsort(-(x @ shared.value.T), axis=1, kind="stable")[:, :k], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(close), pa.list_(pa.int32()))], [*part.schema.names, "perm"])

    inner = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInArrow(run, f"{inner}, perm array<int>")


def least_common(a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
    """The `shared` smallest pivots that each pair of ascending descriptions has in common; -1 where there are fewer."""
    both = (a[:, :, None] == b[:, None, :]).any(2)
    rank = np.where(both, np.cumsum(both, 1), 0)
    out = np.full((len(a), shared), -1, np.int64)
    for r in range(shared):
        hit = rank == r + 1
        out[:, r] = np.where(hit.any(1), np.take_along_axis(a, hit.argmax(1)[:, None], 1)[:, 0], -1)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for nodes 0 to n - 1 and edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: dict[str, np.ndarray], pivots: int, cosine: float, shared: int, most_pairs: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Compare the rows of each list block with each other: yields (rep, vectors linked, a smaller linked rep or itself).

    rows are sorted by list and block pair. A pair that meets in several lists counts in one alone: that of the smallest
    pivots the two share. Pairs are formed and verified in bounded portions and never leave this function."""
    group, side, rep, copies, perm, x = (rows[k] for k in ("group", "side", "rep", "copies", "perm", "x"))
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(group)]
    last = np.repeat(end, end - start)
    later = last - np.arange(len(group)) - 1  # partners of each row: those after it in its group
    total = np.cumsum(later)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most_pairs, side="right")))
        a = np.repeat(np.arange(at, to), later[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[at:to]) - later[at:to], later[at:to])
        at = to
        keep = (side[a] != side[b]) | (side[a] == 2)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        close = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[close], b[close]
        own = least_common(perm[a], perm[b], shared) == rows["key"][a]
        a, b = a[own.all(1)], b[own.all(1)]
        if not len(a):
            continue
        ids, place = np.unique(np.r_[rep[a], rep[b]], return_inverse=True)
        pa_, pb = place[: len(a)], place[len(a) :]
        count = np.bincount(pa_, copies[b], len(ids)) + np.bincount(pb, copies[a], len(ids))
        yield ids, count.astype(np.int64), ids[forest(pa_, pb, len(ids))]


def links_of(described: DataFrame, pivots: int, cosine: float, shared: int, block: int) -> DataFrame:
    """described(rep, copies, v, perm) -> (rep, n, root): sums of linked vectors and edges of a spanning forest. rep is the
    number of a class of equal vectors."""
    spark = described.sparkSession
    width = described.select(F.size("perm")).first()
    k = width[0] if width else 0
    shared = min(shared, k)
    triples = F.array(*[
        sum((F.element_at("perm", i + 1).cast("long") * F.lit(pivots ** (shared - 1 - j)) for j, i in enumerate(c)), F.lit(0).cast("long")) for c in combinations(range(k), shared)
    ])
    listed = described.select("rep", F.explode(triples).alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    met = listed.join(sizes, "key").select("key", "rep", blocks.alias("nb"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("bi"))
    # a long list is dealt into blocks, and every pair of blocks is compared by itself
    met = met.withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    met = met.select("key", "rep", F.least("bi", "bj").alias("lo"), F.greatest("bi", "bj").alias("hi"), F.when(F.col("bi") == F.col("bj"), 2).when(F.col("bi") < F.col("bj"), 0).otherwise(1).alias("side"))
    whole = met.join(described, "rep").select("key", "lo", "hi", "side", "rep", "copies", "perm", "v")
    # rows of an inner comparison are needed once; those of block pairs (i, j) come from both blocks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = whole.repartition(parts, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def out(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, lo, hi = (part.column(n).to_numpy() for n in ("key", "lo", "hi"))
            change = np.r_[True, (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]
            digits = np.stack([key // pivots ** (shared - 1 - j) % pivots for j in range(shared)], 1)
            rows = {
                "group": np.cumsum(change), "key": digits, "side": part.column("side").to_numpy(), "rep": part.column("rep").to_numpy(), "copies": part.column("copies").to_numpy(),
                "perm": np.array(part.column("perm").to_pylist(), np.int64), "x": unit(np.array(part.column("v").to_pylist(), np.float64)),
            }
            for ids, count, root in compare(rows, pivots, cosine, shared):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count), pa.array(root)], ["rep", "n", "root"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key, lo, hi = (held.column(n).to_numpy() for n in ("key", "lo", "hi"))
            same = (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1])  # the last group may go on in the next batch
            cut = int(np.argmax(same))
            if cut:
                yield from out(held.slice(0, cut).combine_chunks())
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from out(held)

    return dealt.mapInArrow(run, "rep long, n long, root long")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector, whatever its label.

    Equal vectors are one class and are linked with each other. The number of pivots grows with the square root of the
    classes, from LEAST_PIVOTS to MOST_PIVOTS, which keeps the lists short; they are chosen from a sample of four times as many
    classes in a hash order, the only vectors that reach the driver. Every class is indexed, and `nearest` grows by one with
    each fourfold of the pivots beyond LEAST_PIVOTS, as a pair's descriptions agree less the finer they are.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, as do rows with a null
    id. Only vectors of one dimension are compared. Rows that repeat an id are vectors of their own, each with its own links
    and component. An empty table gives an empty result; other columns are ignored."""
    scratch = Scratch(vectors.sparkSession, "pivots")
    read = scratch.write(read_vectors(vectors, id_col, vector_col), "vectors")
    good = read.where(F.col("digest").isNotNull() & F.col("vec_id").isNotNull())
    # equal digests are equal vectors, so any row of a class gives its vector
    classes = good.groupBy("dim", "digest").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("rep"), "*"), "classes")
    found = None
    for row in sorted(classes.groupBy("dim").count().collect()):
        part = classes.where(F.col("dim") == row["dim"]).select("rep", "copies", "v")
        wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2.5 * row["count"] ** 0.5)))
        sample = part.orderBy(F.xxhash64("v"), "rep").limit(4 * wanted).select("v").collect()
        pivots = choose_pivots(unit(np.array([r["v"] for r in sample], np.float64)), wanted)
        close = nearest + max(0, round(np.log2(len(pivots) / LEAST_PIVOTS) / 2))
        described = scratch.write(describe(part, pivots, close), f"described{row['dim']}")
        links = links_of(described, len(pivots), cosine, shared, block)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return read.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = scratch.write(found, "links")
    scratch.drop(*[name for name in scratch.paths if name.startswith("described")])
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("n").alias("others"))
    label = classes.drop("v").join(counted, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    label = scratch.write(label.withColumn("component", F.coalesce("component", "rep")), "label")
    scratch.drop("links")
    ids = label.groupBy("component").agg(F.min("least_id").alias("part"), F.count("*").alias("size")).where("size > 1")
    label = label.join(ids, "component", "left").select("dim", "digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("part", "least_id").alias("part"))
    whole = read.drop("v").join(label, ["dim", "digest"], "left")
    linked = F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("part", "vec_id"))
    return whole.select(
        "vec_id", F.when(linked, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
