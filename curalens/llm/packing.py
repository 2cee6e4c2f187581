"""Pack documents' token ids into fixed windows by best-fit decreasing."""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, portions, unlike, worker_cache

#: Default parameters: window length, the id that ends a document, pieces that are packed together, bytes of cached words.
WINDOW, END_ID, SHARD_PIECES, CACHE_BYTES = 2048, 1, 4096, 80_000_000
#: Fixed values of byte-level BPE: the characters that stand for the 256 bytes; printable bytes stand for themselves.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the pieces that the byte-level BPE cuts a text into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters before this one are cut into pieces alike by both libraries, whatever their tables of Unicode.
LATIN_END = "\u0250"
#: About what a cached word takes beside its characters and ids.
ENTRY_BYTES = 130


def byte_alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def splitter(path: str) -> tuple[Callable[[str], list[int]], int]:
    """(subword ids of a text, number of subwords) by a byte-level BPE file of `tokenizers`, read by `tiktoken`: the same ids at half
    the cost for single words. Ids are the ranks of the merges; special tokens are ordinary text here."""
    from tiktoken import Encoding
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = {t.content for t in whole.get_added_tokens_decoder().values()}
    byte_of = {c: b for b, c in byte_alphabet().items()}
    vocabulary = whole.get_vocab()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
    return Encoding("subwords", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, len(vocabulary)


class Spaced(dict):
    """Word -> ids of the word after a space, filled on demand. Words are kept in two generations of about `limit` bytes each: a full
    younger one takes the place of the older one, so frequent words stay."""

    def __init__(self, own: Encoder, limit: int) -> None:
        super().__init__()
        self.own, self.limit, self.held, self.older = own, limit, 0, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.own.ids(f" {word}")
        if len(word) <= 64:
            self[word] = found
            self.held += ENTRY_BYTES + len(word) + len(found)
            if self.held > self.limit:
                self.older = dict(self)
                self.clear()
                self.held = 0
        return found


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, by a byte-level BPE file of `tokenizers`: the ids
    that the tokenizer's own `encode` gives, the strings of its special tokens included.

    The pre-tokenizer never joins across a single space between two non-space characters, nor across a single line feed
    between them, so words are encoded once and kept. Printable words of Latin letters go to `splitter`, which has the same ids for
    them, and all others to the tokenizer. The cache is bounded in bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.spaced = splitter(path)[0], Spaced(self, cache_bytes // 2)
        self.cuts, self.runs = re.compile(r"(?<=\S)([ \n])(?=\S)"), re.compile(r"\s\s")
        # special tokens are cut out of a text before anything else is looked at
        self.marks = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, self.marks))})")

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, chunk: str) -> bytes:
        """Ids of a chunk that holds no space but may begin with one."""
        if chunk.isprintable() and max(chunk) < LATIN_END:
            return array("I", self.split(chunk)).tobytes()
        body = chunk[1:] if chunk[:1] == " " else chunk
        if "\n" in body and body[0] != "\n" and body[-1] != "\n" and not self.runs.search(body):
            first, *rest = chunk.split("\n")
            feed = self._whole("\n")
            return self.ids(first) + b"".join(feed + self.ids(line) for line in rest)
        return self._whole(chunk)

    def word(self, chunk: str) -> bytes:
        """`ids`, through the cache where the chunk begins with a space."""
        return self.spaced[chunk[1:]] if chunk[:1] == " " and len(chunk) > 1 else self.ids(chunk)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(m in text for m in self.marks):
            parts = self.special.split(text)  # text, special token, text, ...
            return b"".join(self._whole(p) if k % 2 else self._plain_text(p) for k, p in enumerate(parts) if p)
        return self._plain_text(text)

    def _plain_text(self, text: str) -> bytes:
        if self.runs.search(text) or text[0] == " " or text[-1] == " ":
            parts = self.cuts.split(text)  # text, separator, text, ...
            out, lead = [self.word(parts[0]) if self._solid(parts[0]) else self._whole(parts[0])], ""
            for k in range(1, len(parts), 2):
                lead = parts[k]
                if lead == "\n":
                    out.append(self._whole("\n"))
                    lead = ""
                chunk = lead + parts[k + 1]
                out.append(self.word(chunk) if self._solid(parts[k + 1]) else self._whole(chunk))
            return b"".join(out)
        first, *rest = text.split(" ")
        return self.ids(first) + b"".join(map(self.spaced.__getitem__, rest))

    def _solid(self, chunk: str) -> bool:
        return not any(c.isspace() for c in chunk)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, as its one cache."""
    return worker_cache(f"encoder {path}", lambda: Encoder(path))


def pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole documents, end each with `end_id`, and cut the overlong ones into full windows and a rest.

    (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of each piece. Null text counts as empty: its only token is
    the end. Repeated rows give repeated pieces."""
    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = array("I", [end_id]).tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in (p for whole in batches for p in portions(whole, 1)):
            columns: list[list] = [[] for _ in names]
            ids: list[np.ndarray] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = own.encode(text) + end
                total = len(data) // 4
                for at in range(0, total, window):
                    part = data[at * 4 : (at + window) * 4]
                    for column, value in zip(columns, (doc, at, len(part) // 4, zlib.crc32(part), total), strict=True):
                        column.append(value)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(c, pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    return chosen.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", ids array<int>" * with_ids)


class Capacities:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that fits."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)  # open windows below each node
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, which: int) -> None:
        self.open[capacity].append(which)
        k = capacity + self.size
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(window, its capacity) with the least capacity of `length` or more, removed from the tree."""
        tree, k = self.tree, length + self.size
        while not tree[k]:
            while k & 1:
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:  # past the last leaf of a level
                return None
        while k < self.size:
            k = 2 * k if tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        while k:
            tree[k] -= 1
            k >>= 1
        return self.open[capacity].pop(), capacity


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, in the order given. Pieces are placed longest first, equal ones in that order."""
    tree, placed, n = Capacities(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        got = tree.take(length)
        if got is None:
            got = n, window
            n += 1
        which, capacity = got
        placed[i] = which, window - capacity
        if capacity > length:
            tree.put(capacity - length, which)
    return placed


def pack(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add sequence_id and offset to written pieces. Pieces are dealt into shards of about `shard_pieces` by a hash of their
    row's number, so that repeated rows spread like any others, and each shard is packed by itself: the work is linear, no
    task holds more than one shard, and what sharding costs is less than a window a shard. A sequence's id is its shard
    times 2^32 plus its number there."""
    shards = max(1, round(cut.count() / shard_pieces))
    names, (shard_col,) = cut.columns, unlike(cut, "_shard")
    kind = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    # the pieces are a table, whose rows have the same number whenever a task is run again
    dealt = cut.withColumn(shard_col, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))

    def run(shard: pa.Table) -> pa.Table:
        number = shard.column(shard_col)[0].as_py()
        shard = shard.select(names).sort_by([("doc_id", "ascending"), ("start", "ascending")])
        placed = best_fit_decreasing(shard.column("length").to_pylist(), window)
        shard = shard.append_column("sequence_id", pa.array([(number << 32) + s for s, _ in placed], pa.int64()))
        return shard.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy(shard_col).applyInArrow(run, kind)


def pack_documents(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack: one row per piece, with sequence_id and offset. The pieces are written once to the shared
    folder, so the text is encoded once however often the packing is retried.

    Null and empty texts have the end alone; a text of any length is encoded whole and cut into full windows and a rest; rows
    that repeat are packed as often; a null id is kept; an empty table gives no pieces; other columns are ignored."""
    cut = materialize(pieces(documents, tokenizer_path, window, end_id, id_col, text_col, with_ids), "pieces")
    return pack(cut, window, shard_pieces)
