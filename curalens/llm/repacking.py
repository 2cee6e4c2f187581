"""Pack documents into as few windows as can be: best-fit decreasing by partition, each result certified by lower bounds from
dual-feasible functions; partitions that miss their bound exchange documents and pack again."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, portions, unlike, worker_cache
from .packing import CACHE_BYTES, ENTRY_BYTES, LATIN_END, SHARD_PIECES, WINDOW, best_fit_decreasing, byte_alphabet

#: Default parameters: the id that ends a document, rounds of exchange, parameters k of the rounding bounds.
END_ID, ROUNDS, MOST_K = 0, 6, 40
#: Fixed value: the pieces that the word BPE cuts a normalised word into.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A byte that UTF-8 never has, in the place of the mark that ends a word.
WORD_END = b"\xff"
#: What Python takes for white space and the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: White space of the tokenizer.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Letters beyond this many bytes are left to the tokenizer, whose merging is quicker for long ones.
LONG_PIECE = 200


class WordEncoder(dict):
    """Ids of whole texts by a BPE file of `tokenizers` whose words end with a mark and whose white space is dropped, as
    little-endian unsigned 32-bit bytes: the ids of the tokenizer's own `encode`, the strings of its special tokens included.

    Nothing in the tokenizer reaches across white space, so words are encoded once and kept, in two generations of
    `cache_bytes` / 2 each. Words of Latin letters are merged by `tiktoken` from the ranks of the same file; its last letter and
    the mark are merged first there, as ids of letters with a mark lie below those of all merges. Others go to the tokenizer."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        import regex
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of, ranks = {c: b for b, c in byte_alphabet().items()}, {}
        for token, rank in self.tokenizer.get_vocab().items():
            if token not in self.special:
                body, end = (token[:-4], WORD_END) if token.endswith("</w>") and len(token) > 4 else (token, b"")
                ranks[bytes(byte_of[c] for c in body) + end] = rank
        # the class offers whole texts alone; a piece of bytes with its mark is not text
        self.merge = Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.cut = regex.compile(PIECES).findall
        self.limit, self.held, self.older = cache_bytes // 2, 0, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.ids(word)
        if len(word) <= 64:
            self[word] = found
            self.held += ENTRY_BYTES + len(word) + len(found)
            if self.held > self.limit:
                self.older = dict(self)
                self.clear()
                self.held = 0
        return found

    def ids(self, word: str) -> bytes:
        """Ids of a text without white space."""
        low = word.lower()
        if max(low) >= LATIN_END or any(s in word for s in self.special):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        found: list[int] = []
        for piece in self.cut(low):
            data = piece.encode()
            found += self.merge(data + WORD_END) if len(data) <= LONG_PIECE else self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", found).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = [w for w in SPACES.split(text) if w] if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def document_pieces(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's pieces: whole if it has at most `window` ids with its end,
    else cut into full windows and a rest. Null text counts as empty: its only id is the end."""
    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = array("I", [end_id]).tobytes()
    kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_cache(f"words {tokenizer_path}", lambda: WordEncoder(tokenizer_path))
        for batch in (p for whole in batches for p in portions(whole, 1)):
            columns: list[list] = [[] for _ in kinds]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = own.encode(text) + end
                for number, at in enumerate(range(0, len(data), window * 4)):
                    part = data[at : at + window * 4]
                    for column, value in zip(columns, (doc, number, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return chosen.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_windows(lengths: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> int:
    """A number of windows that no packing of `counts` pieces of each length can go below: the largest bound that any of
    three families of dual-feasible functions gives (Fekete and Schepers, 2001). All sums are exact integers.

    A dual-feasible function weighs lengths so that what fits into a window weighs one window at most; the weight of all
    pieces is then a bound. The families: small pieces dropped and large ones rounded up to a window (for each size that counts as
    small), each large piece weighed by the small ones that it keeps out, and multiples of 1 / (k + 1) rounded down to 1 / k."""
    if not len(lengths):
        return 0
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((lengths * counts).sum()) // window)
    for small in np.unique(np.concatenate([lengths, window - lengths + 1])):
        if not 0 < small <= window // 2:
            continue
        weight = np.where(lengths > window - small, window, np.where(lengths >= small, lengths, 0))
        best = max(best, -(-int((weight * counts).sum()) // window))
        per = window // int(small)
        weight = np.where(2 * lengths > window, per - (window - lengths) // small, np.where(lengths >= small, 1, 0))
        best = max(best, -(-int((weight * counts).sum()) // per))
    for k in range(1, MOST_K + 1):
        weight = np.where((k + 1) * lengths % window == 0, k * lengths, (k + 1) * lengths // window * window)
        best = max(best, -(-int((weight * counts).sum()) // (k * window)))
    return best


def certificate(packed: DataFrame, window: int = WINDOW) -> tuple[int, int]:
    """(windows used, windows that any packing of the same pieces needs). Only counts by length, at most `window` of them, go to
    the driver."""
    seen = packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("windows")).collect()
    return sum(r["windows"] for r in seen), least_windows(np.array([r["length"] for r in seen]), np.array([r["n"] for r in seen]), window)


def pack_certified(cut: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id, offset and certified to written pieces (a table, so that a task that is run again sees the same rows).

    Round 0 deals pieces into partitions of about `shard_pieces` by a hash of their row's number, so repeated rows spread like
    any others. Each partition is packed by best-fit decreasing and compared with its own bound: equal counts are certified, and
    so is every full window. A partition with a gap opens all windows that aren't full; a certified one has lost less than a
    window, to rounding, and opens its emptiest. Open windows are dealt anew, window by window, so that each new partition has
    documents of many old ones; it packs them again and keeps what it was given where that needs no more windows. So the total never
    grows. Rounds end when nothing is open, when one has saved no window, when one partition held all that was open, or after
    `rounds` of them. A task holds one partition; a round moves only rows of short numbers."""
    scratch, names = Scratch(cut.sparkSession, "repack"), cut.columns
    key, open_ = unlike(cut, "_part", "_open")
    left, done, bins = cut.count(), [], None
    kind = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + f", sequence_id long, offset long, certified boolean, {open_} boolean"

    def pack(turn: int):
        def run(part: pa.Table) -> pa.Table:
            number = part.column(key)[0].as_py()
            part = part.drop_columns([key])
            part = part.sort_by([(n, "ascending") for n in ("doc_id", "piece", "start", "ids_crc32", *(["sequence_id"] if turn else []))])
            lengths = part.column("length").to_numpy()
            placed = np.array(best_fit_decreasing(lengths.tolist(), window), np.int64).reshape(-1, 2)
            sequence, offset = (turn << 56) + (number << 20) + placed[:, 0], placed[:, 1]
            count = int(placed[:, 0].max()) + 1
            if turn:
                given = part.column("sequence_id").to_numpy()
                if count >= len(np.unique(given)):
                    sequence, offset, count = given, part.column("offset").to_numpy(), len(np.unique(given))
            met = count == least_windows(*np.unique(lengths, return_counts=True), window)
            _, which = np.unique(sequence, return_inverse=True)
            filled = np.bincount(which, weights=lengths)
            again = (filled < window) & ((np.arange(len(filled)) == filled.argmin()) | (not met))
            part = part.select(names)
            for name, values in (("sequence_id", sequence), ("offset", offset), ("certified", (filled == window)[which] | met), (open_, again[which])):
                part = part.append_column(name, pa.array(values))
            return part

        return run

    first = F.col("offset") == 0
    rest = cut.withColumn(key, F.xxhash64(F.monotonically_increasing_id()))
    for turn in range(rounds + 1):
        parts = max(1, round(left / shard_pieces))
        dealt = rest.withColumn(key, F.pmod(F.col(key), F.lit(parts)).cast("long"))
        packed = scratch.write(dealt.groupBy(key).applyInArrow(pack(turn), kind), f"round{turn}")
        seen = packed.agg(F.count_if(first).alias("bins"), F.count_if(F.col(open_)).alias("left"), F.count_if(F.col(open_) & first).alias("again")).first()
        if not seen["left"] or seen["bins"] == bins or turn == rounds or parts == 1:
            done.append(packed.drop(open_))
            break
        done.append(packed.where(~F.col(open_)).drop(open_))
        rest = packed.where(open_).drop(open_).withColumn(key, F.xxhash64(F.lit(turn), "sequence_id"))
        left, bins = seen["left"], seen["again"]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def repack_documents(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, cut where longer than a window, and pack into few windows: one row a piece, with sequence_id, offset and certified
    (its window is part of a packing that its bound proves to be the least, or is full).

    Null and empty texts, and texts of white space, have the end alone; a text of any length is encoded whole; rows that repeat
    are packed as often; a null id is kept; an empty table gives no rows; other columns are ignored, whatever their names."""
    scratch = Scratch(documents.sparkSession, "repack")
    cut = scratch.write(document_pieces(documents, tokenizer_path, window, end_id, id_col, text_col), "pieces")
    packed = pack_certified(cut, window, shard_pieces, rounds)
    scratch.drop("pieces")
    return packed
