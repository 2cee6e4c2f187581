"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, give_back, portions, worker_cache

#: Default parameters: words in a shingle, least Jaccard similarity in hundredths, bands and bins in each band. At 0.85 a
#: pair shares a bucket with probability 1 - (1 - 0.85^5)^25, over 0.9999995.
SHINGLE, PERCENT, BANDS, ROWS = 5, 85, 25, 5
#: Odd multipliers of the 64-bit mixing step, and the words whose hashes a worker keeps.
MIX1, MIX2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
CACHE = 200_000
#: Bands of the first stars, stars that a bucket gives after them, and the bins of the histogram that orders shingles
#: from rare to frequent.
FIRST, STARS, BINS = 4, 3, 1 << 20


class Hashes(dict):
    """Word -> 64-bit hash, filled on demand."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the contract: bytes.lower() folds A-Z alone and bytes.split() cuts at 0x20 and 0x09-0x0D alone."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = worker_cache("word hashes", Hashes)
    if len(known) > CACHE:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    h = word_hashes(words_of(text))
    if not len(h):
        return h
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total * ODD + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def probes(bins: int, tries: int = 64) -> np.ndarray:
    """For each empty bin, the bins to borrow from in order: independent uniform draws, the same for every document."""
    at = np.arange(bins * tries, dtype=np.uint64) + np.uint64(bins)
    return (mix(at * ODD) % np.uint64(bins)).astype(np.int64).reshape(bins, tries)


def one_permutation(shingles: np.ndarray, bins: int, borrow: np.ndarray) -> np.ndarray:
    """The least hash of each bin under one permutation; empty bins borrow by optimal densification."""
    h = np.sort(mix(shingles + ODD))
    where = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    out, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[where[first]], full[where[first]] = h[first], True
    if not full.all():
        source = np.arange(bins)
        empty = np.flatnonzero(~full)
        hit = full[borrow[empty]]
        found = hit.any(1)
        source[empty] = np.where(found, borrow[empty, hit.argmax(1)], where[first[0]])
        out = out[source]
    return out


def signatures(documents: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """documents(doc_id, text as binary, carried long) -> (doc_id, carried, n_shingles, digest of the shingle set, one bucket key
    for each band). Texts without words have nulls."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borrow, salt = probes(bins), np.arange(bands, dtype=np.uint64)
        for batch in (p for whole in batches for p in portions(whole, 1)):
            sizes, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, size)
                sizes.append(len(own))
                if not len(own):
                    digests.append(None)
                    keys.append(None)
                    continue
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                least = one_permutation(own, bins, borrow).reshape(bands, rows)
                key = mix(salt + ODD)
                for k in range(rows):
                    key = mix(key * ODD + least[:, k])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "carried", "n_shingles", "digest", "keys"],
            )

    return documents.select("doc_id", "text", "carried").mapInArrow(run, "doc_id long, carried long, n_shingles long, digest binary, keys array<long>")


def shingles(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, shingles) of documents(doc_id, text as binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in portions(whole, 1)):
            sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "digest", "shingles"])

    return documents.mapInArrow(run, "doc_id long, digest binary, shingles array<long>")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b, ...) whose full shingle sets have 100 * intersection >= percent * union. Sets travel along pairs."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    shared = F.size(F.array_intersect("s", "t")).cast("long")
    return both.where(100 * shared >= percent * (F.size("s") + F.size("t") - shared)).select(pairs.columns)


def ordered(x: Column, y: Column) -> tuple[Column, ...]:
    """a, b, ca, cb of a pair of structs (node, component)."""
    return F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), F.least(x["component"], y["component"]).alias("ca"), F.greatest(x["component"], y["component"]).alias("cb")


def members_of(classes: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, n, weight, component): one row for each class and band."""
    return classes.select("node", "n", "keys").join(label, "node").select(F.explode("keys").alias("key"), "node", "n", "weight", "component")


def stars(members: DataFrame, percent: int, more: int) -> DataFrame:
    """Candidate pairs (a, b, ca, cb) of members(key, node, n, weight, component): every bucket whose members lie in several
    components gives a star from its heaviest member, and `more` from members that a hash picks. A pair whose sizes rule it
    out, or that lies in one component already, isn't made at all. So a bucket gives at most 1 + more pairs for each of
    its members, and none for those that an earlier star has joined; centers are found in one map-side aggregation,
    however large the bucket."""
    held = ("node", "n", "component")
    picks = [F.max(F.struct("weight" if k == 0 else F.xxhash64("node", "key", F.lit(k)), *held)).alias(f"c{k}") for k in range(1 + more)]
    centers = members.groupBy("key").agg(*picks, (F.min("component") < F.max("component")).alias("several")).where("several")
    centers = centers.select("key", F.array_distinct(F.array(*[F.struct(*[F.col(f"c{k}.{x}") for x in held]) for k in range(1 + more)])).alias("centers"))
    fit = lambda c: (
        (c["component"] != F.col("m.component")) & (100 * F.least(c["n"], F.col("m.n")) >= percent * F.greatest(c["n"], F.col("m.n")))
    )
    useful = members.alias("m").join(centers.alias("c"), (F.col("m.key") == F.col("c.key")) & F.exists("centers", fit))
    pairs = useful.select(F.struct("m.node", "m.component").alias("x"), F.explode(F.filter("centers", fit)).alias("c"))
    return pairs.select(*ordered(F.col("x"), F.col("c"))).distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, at, node, n, component, indexed) of sets(node, component, shingles): each set's first shingles in one order of
    all shingles, rare ones first. Two sets of n and m shingles that are similar enough share at least
    s = ceil(percent * (n + m) / (100 + percent)), so they meet among the first n - s + 1 of the one and m - s + 1 of the
    other, whatever the order. `indexed` marks the part that is enough for the smaller set of a pair. The order follows a
    histogram of hashed shingles: it decides how many pairs meet in vain, never whether a similar pair meets."""
    bins = sets.select(F.explode("shingles").alias("t")).groupBy(F.pmod("t", F.lit(BINS)).alias("bin")).count().toArrow()
    often = np.zeros(BINS, np.int64)
    often[bins.column(0).to_numpy()] = bins.column(1).to_numpy()
    del bins
    give_back()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, component, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = own.values.to_numpy()
                n = len(own)
                probe, index = n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1
                token = own[np.lexsort((own, shared.value[own % BINS]))[:probe]]
                at = np.arange(probe)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(at), *(pa.array(np.full(probe, x)) for x in (node, n, component)), pa.array(at < index)], ["token", "at", "node", "n", "component", "indexed"])

    return sets.select("node", "component", "shingles").mapInArrow(run, "token long, at long, node long, n long, component long, indexed boolean")


def untested(placed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Every pair (a, b, ca, cb) of placed(node, component) in two components that can reach the similarity: an exact
    prefix-filter join. A token's largest component isn't joined with itself, so a large group of copies costs no pair."""
    rows = scratch.write(prefixes(sets.join(placed, "node"), percent), "prefixes")
    tokens = rows.groupBy("token", "component").agg(F.count("*").alias("size"), F.max("indexed").alias("indexed"))
    tokens = tokens.groupBy("token").agg(F.max(F.struct("size", "component"))["component"].alias("top"), F.count("*").alias("parts"), F.max("indexed").alias("any"))
    rows = scratch.write(rows.join(tokens.where((F.col("parts") > 1) & F.col("any")).select("token", "top"), "token"), "prefixes")
    x, y = rows.where("indexed").alias("x"), rows.alias("y")
    least = F.ceil(percent * (F.col("x.n") + F.col("y.n")) / (100 + percent) - 1e-9)
    fits = (
        (F.col("x.component") != F.col("y.component")) & (F.col("x.n") <= F.col("y.n")) & (100 * F.col("x.n") >= percent * F.col("y.n"))
        & (F.col("x.at") + least <= F.col("x.n")) & (F.col("y.at") + least <= F.col("y.n"))
    )
    same = F.col("x.token") == F.col("y.token")
    ends = F.struct("x.node", "x.component").alias("x"), F.struct("y.node", "y.component").alias("y")
    pairs = x.where("component <> top").join(y, same & fits).select(*ends)
    pairs = pairs.unionByName(x.where("component = top").join(y.where("component <> top"), same & fits).select(*ends))
    return pairs.select(*ordered(F.col("x"), F.col("y"))).distinct()


def contract(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(node, weight, component) after the components that links(ca, cb) join have become one."""
    parts = connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = label.join(parts.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    return joined.select("node", "weight", F.coalesce("into", "component").alias("component"))


class Sets:
    """The shingle sets of classes(node, digest, least_id), made from the texts for the nodes that are asked for, once each."""

    def __init__(self, source: DataFrame, classes: DataFrame, size: int, scratch: Scratch) -> None:
        self.source, self.size, self.scratch = source.select("doc_id", "text"), size, scratch
        self.classes, self.tables = classes.select("node", "digest", F.col("least_id").alias("doc_id")), []

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of these nodes and of all asked for before."""
        for held in self.tables:
            nodes = nodes.join(held.select("node"), "node", "left_anti")
        named = self.scratch.write(self.classes.join(nodes, "node", "left_semi"), "named")
        if not named.isEmpty() or not self.tables:
            texts = self.source.join(named.select("doc_id").distinct(), "doc_id", "left_semi")
            found = shingles(texts, self.size).join(named, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
            self.tables.append(self.scratch.write(found.select("node", "shingles"), f"sets{len(self.tables)}"))
        whole = self.tables[0]
        for held in self.tables[1:]:
            whole = whole.unionByName(held)
        return whole


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, carried) of every row. carry: a long of the row that is handed through, by which
    a caller can tell rows that repeat an id apart; null by default.

    Equal shingle sets are one class. Classes that share a bucket are candidates: each bucket gives stars, never all pairs.
    A first star, over FIRST bands, has the member with most company as its center, which is the text that the others were
    copied from if there is one, and joins most of a group. Stars over all bands follow, only to members that lie in
    another component than the center. Links are confirmed on full sets. Stars only make the components large early:
    where a bucket's members lie in several components even then, all members of these components are joined exactly, by the
    rare shingles that similar sets must share, and every pair left is tested. So every pair at the threshold that shares
    a bucket is linked or lies in one component.

    A component's id is the smallest doc_id of its rows. Texts that are null, empty or without words link with nothing, and
    neither does a null id, which is kept. Rows that repeat an id are rows of their own: with one text they are in one
    class, with several they may lie in several components, and each is kept where the id is its component's. Texts of any
    length are read whole; a set takes 8 bytes a word. An empty table gives an empty result; other columns are ignored."""
    carry = F.lit(None) if carry is None else carry
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), carry.cast("long").alias("carried"))
    scratch = Scratch(documents.sparkSession, "minhash")
    signed = scratch.write(signatures(source, size, bands, rows), "signed")
    usable = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "keys")).alias("r"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("r.doc_id").alias("least_id"), F.col("r.n_shingles").alias("n"), F.col("r.keys").alias("keys"))
    classes = scratch.write(classes, "classes")  # from here on the numbers of the classes stand
    sets = Sets(source, classes, size, scratch)

    few = classes.select(F.explode(F.slice("keys", 1, FIRST)).alias("key"), "node", "n")
    shared = few.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    company = F.sum("size").over(Window.partitionBy("node"))  # FIRST rows a node at most
    few = scratch.write(few.join(shared, "key").select("key", "node", "n", company.alias("weight"), F.col("node").alias("component")), "few")
    weights = few.groupBy("node").agg(F.max("weight").alias("weight"))
    label = classes.select("node").join(weights, "node", "left").select("node", F.coalesce("weight", F.lit(0)).alias("weight"), F.col("node").alias("component"))
    label, tested = scratch.write(label, "label"), None
    for turn in range(2):
        pairs = stars(few, percent, 0) if turn == 0 else stars(members_of(classes, label), percent, STARS - 1)
        pairs = scratch.write(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), f"pairs{turn}")
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        links = scratch.write(verify(pairs, sets.of(ends), percent), "links")
        if not links.isEmpty():
            label = scratch.write(contract(label, links), "label")
    parts = members_of(classes, label).groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("size")).where("parts > 1 and size > 2").select("key")
    open_parts = scratch.write(parts.join(mixed, "key", "left_semi").select("component").distinct(), "open")
    if not open_parts.isEmpty():
        placed = scratch.write(label.join(open_parts, "component", "left_semi").select("node", "component"), "placed")
        last = untested(placed, sets.of(placed.select("node")), percent, scratch).join(tested, ["a", "b"], "left_anti")
        last = scratch.write(last, "last")
        ends = last.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        links = scratch.write(verify(last, sets.of(ends), percent), "links")
        if not links.isEmpty():
            label = scratch.write(contract(label, links), "label")
    scratch.drop(*[name for name in scratch.paths if name not in ("signed", "classes", "label")])
    placed = classes.select("node", "digest", "least_id").join(label.select("node", "component"), "node")
    ids = placed.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("size")).where("size > 1")
    names = placed.join(ids, "component", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    whole = signed.select("doc_id", "n_shingles", "digest", "carried").join(names, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "carried")
