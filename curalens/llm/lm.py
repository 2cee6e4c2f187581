"""Language-model scores of whole texts: a causal self-attention model on subwords, mixed word by word with the corpus's word
counts."""

from __future__ import annotations

import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import filterfalse, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention_lm
from .common import Scratch, give_back, portions, worker_cache
from .packing import byte_alphabet, splitter

#: Default parameters of the counts: words whose counts travel with the tasks (the others are joined), words that a task
#: counts before it sends them on, and words whose subwords a worker keeps.
HOT_WORDS, FLUSH, CACHE = 300_000, 250_000, 250_000
#: Bytes of the longest words that are kept.
KEPT_BYTES = 64
#: Default parameters of the training: the weights begin on about WARM_BLOCKS blocks of runs of words that are drawn from every training
#: text, and go on over all blocks of all training texts, where they lie.
WARM_BLOCKS, RUN_BYTES, LEAD_BYTES = 120_000, 120, 90
#: Rate and blocks of a round of that second part, and the partial sums of weights from which one task forms the sum that reaches the driver.
REFINE_RATE, REFINE_BLOCKS, SUMS = 3e-3, 16_384, 16
#: For the weight of the mixture each training word's ratio of both shares is counted to one part in MIXTURE_STEPS of a natural logarithm.
MIXTURE_STEPS = 64
#: Bytes of the texts that a task goes through at once, one text at least.
PART_BYTES = 600_000


@dataclass
class Scorer:
    """model: the attention model; hot: counts of the most frequent words; weight: of the word counts in the mixture, if it is set."""

    model: attention_lm.Model
    hot: dict[bytes, int]
    n_docs: int
    tokens: int
    distinct: int
    weight: float | None
    path: str
    name: str = ""

    def known(self) -> Subwords:
        """The worker's cache for this scorer."""
        held = worker_cache(f"counted {self.path} {self.name}", lambda: Subwords(self.path, self.hot, (self.n_docs, self.model.end)))
        held.renew()
        return held


def words_of(text: bytes | None) -> list[bytes]:
    """Words of the contract: bytes.lower() folds A-Z alone and bytes.split() cuts at 0x20 and 0x09-0x0D alone."""
    return text.lower().split() if text else []


def made(word: bytes, path: str) -> bytes:
    """Subword ids of a word after a space, as little-endian unsigned 32-bit bytes."""
    return array("I", splitter(path)[0](" " + word.decode("utf-8", "replace"))).tobytes()


class Subwords(dict):
    """Word -> its subword ids as little-endian unsigned 32-bit bytes, filled on demand; with `hot`, a map of counts, after the word's
    count as a double. Words are kept in two generations: when the younger one has `limit` words it takes the place of the older one,
    so frequent words stay."""

    def __init__(self, path: str, hot: dict[bytes, int] | None = None, end: tuple[int, int] | None = None, limit: int = CACHE) -> None:
        super().__init__()
        self.split, self.hot, self.limit, self.older = splitter(path)[0], hot, limit, {}
        self.fixed = {} if end is None else {None: struct.pack("<dI", *end)}  # a text's end
        self.update(self.fixed)

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("I", self.split(" " + word.decode("utf-8", "replace"))).tobytes()
            if self.hot is not None:
                found = struct.pack("<d", self.hot.get(word, 0)) + found
        if len(word) <= KEPT_BYTES:
            self[word] = found
        return found

    def meet(self, words: list[bytes], first: np.ndarray) -> None:
        """Cut those of the words that aren't known yet in one call, which costs half of a call a word. first: whether a subword begins a word; words
        that can't be told apart by it are left to be cut alone."""
        new = [w for w in filterfalse(self.__contains__, set(words)) if w is not None and len(w) <= KEPT_BYTES]
        known = [w for w in new if w in self.older]
        self.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new = list(filterfalse(self.__contains__, new)) if known else new
        if not new:
            return
        try:
            ids = np.array(self.split(" " + b" ".join(new).decode()), "<u4")
        except UnicodeDecodeError:
            return
        begin = np.flatnonzero(first[ids])
        if len(begin) != len(new):
            return
        if self.hot is not None:
            counts = np.fromiter(map(self.hot.get, new, repeat(0)), "<f8", len(new)).view("<u4")
            ids = np.insert(ids, np.repeat(begin, 2), counts)
            begin = begin + 2 * np.arange(len(begin))
        data, at = ids.tobytes(), [*(begin * 4).tolist(), ids.nbytes]
        self.update(zip(new, map(data.__getitem__, map(slice, at, at[1:])), strict=True))

    def renew(self) -> None:
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
            self.update(self.fixed)


def starts_of(path: str) -> np.ndarray:
    """Whether each subword begins a word, that is with a space; the end mark, after all of them, does too."""
    from tokenizers import Tokenizer

    space, first = byte_alphabet()[32], np.ones(splitter(path)[1] + 1, bool)
    for piece, i in Tokenizer.from_file(path).get_vocab().items():
        first[i] = piece[:1] == space
    return first


def subwords(path: str) -> Subwords:
    known = worker_cache(f"subwords {path}", lambda: Subwords(path))
    known.renew()
    return known


def ids_of(words: list[bytes], path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Subword ids with the end mark, and the number of them in each word and the end."""
    parts = list(map(subwords(path).__getitem__, words))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.r_[np.frombuffer(b"".join(parts), "<u4").astype(np.int64), end], np.r_[sizes, 1]


def text_ids(texts: list[list[bytes]], path: str, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids with the end mark, one text after the other, number of them in each text). first: as `Subwords.meet` has it; the end mark is its last."""
    known, end = subwords(path), array("I", [len(first) - 1]).tobytes()
    known.meet([w for words in texts for w in words], first)
    parts = [p for words in texts for p in (*map(known.__getitem__, words), end)]
    held = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)
    return np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.diff(held[np.cumsum([len(words) + 1 for words in texts]) - 1], prepend=0)


def count_words(documents: DataFrame) -> DataFrame:
    """(word, c) of documents(text as binary); the null word counts the documents, that is their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in (p for whole in batches for p in portions(whole, 0)):
            seen[None] += batch.num_rows
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return documents.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def count_pairs(counts: DataFrame, path: str) -> DataFrame:
    """(before, after, c): corpus counts of each subword after the one before it in its word, -1 at a word's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, held = [], [], 0

        def out() -> pa.RecordBatch:
            key, place = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(place, np.concatenate(weights)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((key >> 32) - 1), pa.array(key & 0xFFFFFFFF), pa.array(c)], ["before", "after", "c"])

        for batch in batches:
            parts = [made(w, path) for w in batch.column(0).to_pylist()]  # each word once, so none is kept
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            ids = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
            if not len(ids):
                continue
            before = np.r_[-1, ids[:-1]]
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
            keys.append((before + 1 << 32) + ids)
            weights.append(np.repeat(batch.column(1).to_numpy(), sizes))
            held += len(ids)
            if held > 1_500_000:
                yield out()
                keys, weights, held = [], [], 0
        if keys:
            yield out()

    words = counts.where(F.col("word").isNotNull()).select("word", "c")
    return words.mapInArrow(run, "before long, after long, c long").groupBy("before", "after").agg(F.sum("c").alias("c"))


def word_logs(scorer: Scorer, texts: list[list[bytes]]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """(words, counts of the frequent ones, natural log probabilities by the attention model alone) of the words and the end (None) of
    each text, one after the other.

    A word's probability is that of its subwords and of a word's end after them; what opens the next word is counted there,
    given that one opens. So the probabilities of all words and of the end sum to 1 at each place."""
    flat = [w for words in texts for w in (*words, None)]
    known = scorer.known()
    if isinstance(known, Subwords):
        known.meet(flat, scorer.model.first)
    parts = list(map(known.__getitem__, flat))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4 - 2
    data = np.frombuffer(b"".join(parts), "<u4")
    begin = np.cumsum(sizes + 2) - sizes - 2
    counts = np.stack([data[begin], data[begin + 1]], 1).view("<f8")[:, 0]
    held = np.ones(len(data), bool)
    held[begin] = held[begin + 1] = False
    last = np.cumsum([len(words) + 1 for words in texts]) - 1
    at = np.cumsum(sizes) - sizes
    lengths = np.diff(np.r_[0, at[last] + 1])
    logs, edge = attention_lm.score_ids(scorer.model, data[held].astype(np.int64), lengths)
    opens = edge[at]
    closes = np.r_[opens[1:], 0.0]
    closes[last] = 0.0
    return flat, counts, np.add.reduceat(logs, at) - opens + closes


def mixture_ratios(scorer: Scorer, texts: DataFrame, counts: DataFrame) -> DataFrame:
    """`ratios_of` all words and ends of texts(doc_id, text as binary), which are gone over for it."""
    scored = scored_texts(scorer, texts.select("doc_id", "text", F.lit(True).alias("train")))
    return ratios_of(scored, cold_words(scored, counts), scorer.tokens)


def ratios_of(scored: DataFrame, cold: DataFrame, tokens: int) -> DataFrame:
    """(ratio, n) of all words and ends of the training texts: how often the share of a word's count, less the occurrences in its own
    text, is exp(ratio / MIXTURE_STEPS) times the attention model's probability; null where nothing is left of the count. Frequent
    words were counted in the tasks; the others have their counts by a join, so all take part."""
    counted = scored.select(F.explode(F.arrays_zip("ratio", "n")).alias("r")).select("r.ratio", "r.n")
    left = F.coalesce("c", F.lit(0)) - F.col("own")
    ratio = F.round((F.log(left / F.lit(max(tokens, 1))) - F.col("log")) * MIXTURE_STEPS).cast("long")
    met = cold.where("train").select(F.when(left > 0, ratio).alias("ratio"), F.lit(1).cast("long").alias("n"))
    return counted.unionByName(met).groupBy("ratio").agg(F.sum("n").alias("n"))


def mixture_weight(ratios: list[tuple[int | None, int]], rounds: int = 12) -> float:
    """Weight of the word counts by expectation maximisation over (ratio, n) of `mixture_ratios`."""
    n = np.array([k for _, k in ratios], float)
    if not n.sum():
        return 0.5
    times = np.array([0.0 if r is None else np.exp(min(r / MIXTURE_STEPS, 600)) for r, _ in ratios])
    weight = 0.5
    for _ in range(rounds):
        weight = float(np.clip((weight * times / (weight * times + 1 - weight)) @ n / n.sum(), 0.01, 0.99))
    return weight


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The most frequent words with their counts, `most` at most: all words of at least the least count that so many reach.
    The count is read from a histogram of counts, so that no more than these words come to the driver."""
    words = counts.where(F.col("word").isNotNull())
    least, held = None, 0
    for r in words.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).collect():
        held += r["n"]
        if held > most:
            break
        least = r["c"]
    if least is None:
        return {}
    found = words.where(F.col("c") >= least).select("word", "c").toArrow()
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def runs_of(text: bytes, share: float, rng: np.random.Generator) -> Iterator[tuple[list[bytes], bool, bool]]:
    """Runs of words drawn from a text, wherever they stand: (words, whether words stand before them, whether the text ends with
    them). Each run of RUN_BYTES bytes is drawn with probability `share`, with some words before it for its context, and is widened to whole
    words."""
    for k in np.flatnonzero(rng.random(len(text) // RUN_BYTES + 1) < share).tolist():
        low, to = k * RUN_BYTES - LEAD_BYTES, (k + 1) * RUN_BYTES
        part = text[max(0, low) : to].lower()
        words, cut = part.split(), to < len(text)
        if cut and words and not part[-1:].isspace() and not text[to : to + 1].isspace():
            words.pop()  # cut in two
        if low > 0 and words and not part[:1].isspace() and not text[low - 1 : low].isspace():
            words.pop(0)
        if words or not cut:
            yield words, low > 0, not cut


def training_blocks(training: DataFrame, model: attention_lm.Model, path: str, share: float) -> DataFrame:
    """(x, first, y): blocks of runs of words that are drawn from every training text."""
    small = replace(model, pairs=model.pairs[:, :0], params={"q": model.params["q"][:, :1]})
    shared, seed = training.sparkSession.sparkContext.broadcast(small), attention_lm.SEED
    kind = pa.schema([("x", pa.list_(pa.int32())), ("first", pa.bool_()), ("y", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId() if TaskContext.get() else 0])
        for batch in (p for whole in batches for p in portions(whole, 0)):
            runs, led = [], []
            for text in batch.column(0).to_pylist():
                for words, before, ends in runs_of(text, share, rng):
                    ids = ids_of(words, path, shared.value.end)[0]
                    runs.append(ids if ends else ids[:-1])
                    led.append(before)
            if not runs:
                continue
            x, first, y, text = attention_lm.blocks_of(runs, shared.value)
            keep = ~(first & np.array(led, bool)[text])  # the first block of a run within a text lacks its context
            yield pa.RecordBatch.from_arrays([pa.array(list(x[keep]), kind[0].type), pa.array(first[keep]), pa.array(list(y[keep]), kind[2].type)], schema=kind)

    return training.select("text").mapInArrow(run, "x array<int>, first boolean, y array<int>")


def block_arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, flat = table.num_rows, lambda c: np.asarray((c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).flatten())
    if not n:
        return np.zeros((0, 2 * attention_lm.BLOCK), np.int32), np.zeros(0, bool), np.zeros((0, attention_lm.BLOCK), np.int32)
    return flat(table.column(0)).reshape(n, -1), np.asarray(table.column(1)), flat(table.column(2)).reshape(n, -1)


def refine(model: attention_lm.Model, training: DataFrame, path: str, scratch: Scratch) -> attention_lm.Model:
    """Train on all blocks of all training(text as binary) where they lie: each task goes on from the same weights over the whole texts that
    it has, and the weights are averaged by the tasks' blocks. Sums are formed in two steps, so the driver gets one row however many tasks
    there are."""
    shared, names = training.sparkSession.sparkContext.broadcast(model), sorted(model.params)
    kind = "n long, weights binary"

    def packed(n: int, params: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b"".join(params[k].astype(np.float64).tobytes() for k in names)], pa.binary())], ["n", "weights"])

    def learn_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, seen, rounds = attention_lm.copy_of(shared.value), [], 0, 0

        def go_on() -> None:
            whole = tuple(np.concatenate(parts) for parts in zip(*held, strict=True))
            attention_lm.train(own, whole, -(-len(whole[0]) // attention_lm.BATCH), rate=REFINE_RATE / np.sqrt(1 + rounds))
            held.clear()

        for batch in (p for whole in batches for p in portions(whole, 0, PART_BYTES)):
            held.append(attention_lm.cut_blocks(*text_ids([words_of(t) for t in batch.column(0).to_pylist()], path, own.first), own)[:3])
            seen += len(held[-1][0])
            if sum(len(h[0]) for h in held) >= REFINE_BLOCKS:
                go_on()
                rounds += 1
        if seen:
            if held:
                go_on()
            yield packed(seen, {k: v.astype(np.float64) * seen for k, v in own.params.items()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for k, weights in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(weights.as_buffer(), np.float64)
                n, total = n + k, part.copy() if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "weights"])

    trained = scratch.write(training.select("text").mapInArrow(learn_part, kind), "weights")
    shared.destroy()
    rows = trained.repartition(SUMS).mapInArrow(add, kind).repartition(1).mapInArrow(add, kind).toArrow()
    if not rows.num_rows:
        return model
    mean, at, params = np.frombuffer(rows.column(1)[0].as_buffer(), np.float64) / rows.column(0)[0].as_py(), 0, {}
    for k in names:
        size = model.params[k].size
        params[k] = mean[at : at + size].reshape(model.params[k].shape).astype(np.float32)
        at += size
    scratch.drop("weights")
    return replace(model, params=params)


def learn(training: DataFrame, counts: DataFrame, path: str, scratch: Scratch, hot_words: int = HOT_WORDS, steps: int = attention_lm.STEPS) -> Scorer:
    """All of it comes from the whole of training(doc_id, text as binary) and its word counts: the counts of words and of
    subword pairs from every word, the classes from the pairs, the attention weights from every subword of every text. Only the
    state that the weights begin with comes from runs of words drawn from all texts. The weight of the mixture is not set yet."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("d")).first()
    hot = frequent(counts, hot_words)
    size, own = splitter(path)[1], attention_lm.OWN
    pairs = scratch.write(count_pairs(counts, path), "pairs")
    seen = np.zeros(size + 1)
    for r in pairs.groupBy("after").agg(F.sum("c").alias("c")).collect():  # at most one row for each subword
        seen[r["after"]] = r["c"]
    seen[size] = total["d"] or 0
    first = starts_of(path)
    top = [int(i) for i in np.argsort(-seen[:-1], kind="stable")[:own]]  # so at most own * (own + 1) pairs reach the driver
    near = pairs.where(F.col("after").isin(top) & ((F.col("before") < 0) | F.col("before").isin(top)))
    near = near.select(F.col("before").cast("int"), F.col("after").cast("int"), F.col("c").cast("float")).toArrow()
    model = attention_lm.start(seen, first, tuple(near.column(k).to_numpy() for k in range(3)))
    del near
    scratch.drop("pairs")
    drawn = training_blocks(training, model, path, min(1.0, WARM_BLOCKS * attention_lm.BLOCK / max(1.0, seen.sum())))
    warm = block_arrays(drawn.toArrow())
    attention_lm.train(model, warm, steps)
    del warm
    model = refine(model, training, path, scratch)
    scorer = Scorer(model, hot, total["d"] or 0, total["n"] or 0, total["v"] or 0, None, path, uuid.uuid4().hex)
    give_back()
    return scorer


SCORED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ("cold", pa.list_(pa.binary())), ("logs", pa.list_(pa.float64())), ("own", pa.list_(pa.int64())), ("train", pa.bool_()), ("held", pa.float64()), ("told", pa.binary()),
    ("ratio", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
])
SCORED_SQL = (
    "row long, doc_id long, n_tokens long, known long, base double, score double, cold array<binary>, logs array<double>, own array<long>, train boolean, held double, told binary, "
    "ratio array<long>, n array<long>"
)


def mixed(text: np.ndarray, held: np.ndarray, told: np.ndarray, weight: float) -> np.ndarray:
    """Log10 probability of each text by the mixture. held: by the attention model alone; told: of each word, and text: its text, how many
    natural logarithms its share lies above the attention model's probability."""
    with np.errstate(divide="ignore"):
        return (held + np.bincount(text, np.logaddexp(np.log(weight) + told, np.log1p(-weight)), len(held))) / np.log(10)


def score_batch(scorer: Scorer, row: int, ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
    """`score_words` of texts that aren't for training."""
    many = [words_of(t) for t in texts]
    return score_words(scorer, row, ids, many, [False] * len(many), word_logs(scorer, many))


def score_words(scorer: Scorer, row: int, ids: pa.Array, many: list[list[bytes]], trains: list[bool], found: tuple[list[bytes | None], np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """For each text, of its words and what `word_logs` found for them: tokens, known tokens, base and model log10 probabilities without the words that aren't hot (the latter null while
    the mixture has no weight), those words, each occurrence with its natural log probability by the attention model and its
    occurrences in the text, and what `mixed` needs of the other words. The first row has the ratios of the training texts' other words."""
    flat, c, logs = found
    sizes, trains = np.array([len(words) + 1 for words in many]), np.array(trains, bool)
    text, known = np.repeat(np.arange(len(many)), sizes), c > 0
    known[np.cumsum(sizes) - 1] = True  # the end is never joined
    own = np.zeros(len(flat), np.int64)
    own[trains[text]] = [k for words, train in zip(many, trains.tolist(), strict=True) if train for mates in (Counter(words),) for k in (*map(mates.__getitem__, words), 1)]
    total = lambda values: np.bincount(text[known], values, len(many))
    base, held = total(np.log(c[known] + 1) - np.log(scorer.tokens + scorer.distinct + 1)), total(logs[known])
    mine = known & trains[text]
    with np.errstate(divide="ignore"):
        told = np.log(c[known] / max(scorer.tokens, 1)) - logs[known]
        ratio = np.log(np.maximum(c[mine] - own[mine], 0) / max(scorer.tokens, 1)) - logs[mine]
    sure = np.isfinite(ratio)
    ratio, n = np.unique(np.round(ratio[sure] * MIXTURE_STEPS).astype(np.int64), return_counts=True)
    ratios, n = pa.array([*ratio.tolist(), None], pa.int64()), pa.array(np.r_[n, (~sure).sum()].astype(np.int64))
    score = [None] * len(many) if scorer.weight is None else mixed(text[known], held, told, scorer.weight)
    cold, kept, ends = np.flatnonzero(~known), told.astype("<f4"), np.cumsum(np.bincount(text[known], minlength=len(many)))
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(text[cold], minlength=len(many)))].astype(np.int32))
    at_first = pa.array(np.r_[0, np.full(len(many), len(ratios))].astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(np.arange(row, row + len(many))), ids, pa.array(sizes), pa.array(np.bincount(text[c > 0], minlength=len(many))), pa.array(base / np.log(10)), pa.array(score, pa.float64()),
        pa.ListArray.from_arrays(offsets, pa.array([flat[k] for k in cold.tolist()], pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(logs[cold])), pa.ListArray.from_arrays(offsets, pa.array(own[cold])),
        pa.array(trains), pa.array(held), pa.array([part.tobytes() for part in np.split(kept, ends[:-1])], pa.binary()),
        pa.ListArray.from_arrays(at_first, ratios), pa.ListArray.from_arrays(at_first, n),
    ], schema=SCORED)


def scored_texts(scorer: Scorer, texts: DataFrame) -> DataFrame:
    """`score_words` of texts(doc_id, text as binary, train); each row gets a number."""
    shared = texts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in (p for whole in batches for p in portions(whole, 1, PART_BYTES)):
            if batch.num_rows:
                many = [words_of(t) for t in batch.column(1).to_pylist()]
                yield score_words(shared.value, row, batch.column(0), many, batch.column(2).to_pylist(), word_logs(shared.value, many))
                row += batch.num_rows

    return texts.select("doc_id", "text", "train").mapInArrow(run, SCORED_SQL)


def cold_words(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, train, log, own, c) of each occurrence of a word that isn't hot, with the word's count, null if it has none."""
    met = scored.select("row", "train", F.explode(F.arrays_zip("cold", "logs", "own")).alias("p"))
    met = met.select("row", "train", F.col("p.cold").alias("word"), F.col("p.logs").alias("log"), F.col("p.own").alias("own"))
    return met.join(counts.where(F.col("word").isNotNull()), "word", "left").select("row", "train", "log", "own", "c")


def mixed_scores(scored: DataFrame, weight: float) -> DataFrame:
    """(row, doc_id, n_tokens, known, base, score): the scores without cold words, by a mixture of that weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(t.as_buffer(), "<f4") for t in batch.column(6)]
            text = np.repeat(np.arange(len(parts)), [len(t) for t in parts])
            told = np.concatenate([*parts, np.zeros(0, "<f4")]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(mixed(text, batch.column(5).to_numpy(), told, weight))], ["row", "doc_id", "n_tokens", "known", "base", "score"])

    return scored.select("row", "doc_id", "n_tokens", "known", "base", "held", "told").mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double")


def lm_scores(documents: DataFrame, train_where: Column, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row, from its whole text.

    Learns from the rows where `train_where` (a column of the ids) holds. The base is the add-one unigram score over words.
    score is the log10 probability of the text: at each place a word, or the end, has the mixture of its share among the training
    tokens and of its probability by the attention model, both of which sum to 1. Counts of the most frequent words, a
    bounded number, travel with the tasks; the others are joined by word for both scores, so neither side is gathered and no
    word is hot in that join.

    Null and empty texts have the end alone; texts of any length are scored whole, in overlapping contexts; rows that repeat an
    id stay rows of their own; without training rows every count is zero. An empty table gives an empty result; other
    columns are ignored."""
    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), F.coalesce(train_where, F.lit(False)).alias("train"))
    training, scratch = source.where("train").select("doc_id", "text"), Scratch(documents.sparkSession, "lm")
    counts = scratch.write(count_words(training), "words")
    scorer = learn(training, counts, tokenizer_path, scratch, **options)
    # each text is gone over once by the model that is learned; what the weight of the mixture needs of it is kept
    scored = scratch.write(scored_texts(scorer, source), "scored")
    cold = scratch.write(cold_words(scored, counts), "cold")
    ratios = scratch.write(ratios_of(scored, cold, scorer.tokens), "ratios")
    weight = mixture_weight([(r["ratio"], r["n"]) for r in ratios.collect()])  # one row a ratio, of which some 100,000 can be told apart
    scratch.drop("ratios", "words")
    gain = F.log10(F.coalesce("c", F.lit(0)) + 1) - F.lit(float(np.log10(scorer.tokens + scorer.distinct + 1)))
    share, other, ten = weight / max(scorer.tokens, 1), 1 - weight, float(np.log(10))
    both = F.when(F.col("c") > 0, F.log10(F.lit(share) * F.col("c") + F.lit(other) * F.exp("log"))).otherwise(F.lit(float(np.log10(other))) + F.col("log") / F.lit(ten))
    rest = cold.groupBy("row").agg(F.sum(gain).alias("gain"), F.sum(both).alias("mixed"), F.sum(F.when(F.col("c") > 0, 1)).alias("found"))
    whole = mixed_scores(scored, weight).join(rest, "row", "left")
    return whole.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(scorer.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("mixed", F.lit(0.0))).alias("score"),
    )
