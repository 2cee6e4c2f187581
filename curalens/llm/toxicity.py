"""Toxic passages by maximum-scoring segments of token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, portions, remainder

#: Bounds of the labelled sample: rows of each class, and characters of a text and of all texts.
MAX_ROWS_PER_CLASS, MAX_TEXT_CHARS, MAX_SAMPLE_CHARS = 5_000, 200_000, 40_000_000
TOKEN = re.compile(r"\w+")
#: Prefixes of these lengths stand in for words that the sample has seen too rarely.
PREFIXES = (7, 5, 4)
#: What a token scores that speaks neither way.
DRIFT = -0.5


@dataclass
class ToxicModel:
    """scores: tokens that speak for or against toxicity; every other token scores `drift`. lam, k: the Karlin-Altschul
    parameters of chance segments; a, b: the logistic from a document's extreme value to the probability of label 1."""

    scores: dict[str, float]
    prefixes: dict[str, float]
    drift: float
    lam: float
    k: float
    a: float
    b: float

    def of(self, word: str) -> float:
        got = self.scores.get(word)
        if got is not None:
            return got
        for n in PREFIXES:
            if len(word) > n and (got := self.prefixes.get(word[:n])) is not None:
                return got
        return self.drift


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int, mass: float = 1.0) -> tuple[float, float]:
    """Log-odds of a token between toxic and clean documents under an informative Dirichlet prior, and its deviation.

    The prior is `mass` pseudo-documents, split as the classes are (Monroe et al., 2008), so a token that is seen rarely
    or evenly is pulled to zero."""
    share = n_toxic / (n_toxic + n_clean)
    y1, y0 = toxic + mass * share, clean + mass * (1 - share)
    d = math.log(y1 / (n_toxic + mass - toxic + 1e-9)) - math.log(y0 / (n_clean + mass - clean + 1e-9))
    return d, math.sqrt(1 / y1 + 1 / y0)


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a token sequence, best-first merges in linear time.

    hits: (position, score) of the tokens whose score isn't `drift`, in order. Every token between two hits scores
    `drift` < 0. This is the scan of Ruzzo and Tompa (1999); runs of equal tokens are taken in one step."""
    stack: list[list[float]] = []  # first, last, cumulative score before, cumulative score after
    total, at = 0.0, -1
    for place, score in hits:
        total += drift * (place - at - 1)
        at = place
        before, total = total, total + score
        if score <= 0:
            continue
        now = [place, place, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= now[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= now[3]:
                stack.append([*now, j])
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(int(s[0]), int(s[1]), s[3] - s[2]) for s in stack]


def scan_words(words: list[str], model: ToxicModel) -> list[tuple[int, int, float]]:
    """The maximal segments of a token list."""
    scores, prefixes, (p1, p2, p3) = model.scores, model.prefixes, PREFIXES
    return segments([
        (i, model.of(w)) for i, w in enumerate(words)
        if w in scores or w[:p1] in prefixes or w[:p2] in prefixes or w[:p3] in prefixes
    ], model.drift)


def scan(text: str | None, model: ToxicModel) -> tuple[int, list[tuple[int, int, float]]]:
    """Token count and the maximal segments of a whole text."""
    words = TOKEN.findall((text or "").lower())
    return len(words), scan_words(words, model)


def p_value(model: ToxicModel, score: float, n: int) -> float:
    """Chance that a clean text of n tokens has a segment of this score: 1 - exp(-K n exp(-lambda s))."""
    return -math.expm1(-model.k * max(n, 1) * math.exp(-model.lam * score))


def extreme(model: ToxicModel, n: int, found: list[tuple[int, int, float]]) -> float:
    """A document's evidence: the normalised score lambda s - ln K of its best segment less half the log of its length
    (the Gumbel location shifts by ln n), and what further segments have over chance. No segment is no evidence."""
    if not found:
        return 0.0
    shift = math.log(model.k) + 0.5 * math.log(max(n, 1))
    values = [max(0.0, model.lam * s - shift) for _, _, s in found]
    best = max(values)
    return best + 0.25 * (sum(values) - best)


class Words(dict):
    """Word -> number, in the order first seen."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


@dataclass
class Sample:
    """Labelled texts as arrays of word numbers, with what is known of each word: its hash, and the numbers of its prefixes (-1
    where it is no longer than the prefix)."""

    names: list[str]
    texts: list[np.ndarray]
    labels: np.ndarray
    hashes: np.ndarray
    heads: list[str]
    head_of: np.ndarray

    @classmethod
    def read(cls, rows: Iterable[tuple[str | None, int]]) -> Sample:
        known, texts, labels = Words(), [], []
        for text, y in rows:
            words = TOKEN.findall((text or "").lower())
            texts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            labels.append(y)
        names, heads = list(known), Words()
        del known
        head_of = np.fromiter((heads[w[:n]] if len(w) > n else -1 for w in names for n in PREFIXES), np.int32, len(names) * len(PREFIXES)).reshape(-1, len(PREFIXES))
        return cls(names, texts, np.array(labels, int), np.array([zlib.crc32(w.encode()) for w in names], np.uint64), list(heads), head_of)

    def distinct(self, checks: int = 3) -> list[int]:
        """The texts without copies: not those whose least word-triple hash, under any of `checks` hashes, an earlier text had.
        The words of a text that was copied many times would otherwise look like evidence."""
        seen: set[tuple[int, int]] = set()
        found, odd = [], np.uint64(0x9E3779B1)
        for i, ids in enumerate(self.texts):
            own = self.hashes[ids] if len(ids) else np.zeros(1, np.uint64)
            grams = own if len(own) < 3 else own[:-2] * odd ** np.uint64(2) + own[1:-1] * odd + own[2:]
            keys = {(k, int((grams * np.uint64(m)).min())) for k, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:checks])}
            if seen.isdisjoint(keys):
                found.append(i)
            seen |= keys
        return found


@dataclass
class Lexicon:
    """Scores of a sample's words (nan where the prefixes decide) and prefixes (nan where they say nothing), and of each word
    altogether; lambda."""

    words: np.ndarray
    heads: np.ndarray
    score: np.ndarray
    lam: float


def lexicon(sample: Sample, rows: list[int], z: float = 1.0, drift: float = DRIFT) -> Lexicon | None:
    """Scores of words and prefixes from these rows of a sample: the lower bound d - z * deviation of their log-odds.

    Kept are words whose bound exceeds 1.6 and prefixes, for rare words, whose bound exceeds 2.2.
    All other words drift. lambda solves E[exp(lambda s)] = 1 on the clean rows' mix of scores."""
    labels = sample.labels[rows]
    n_toxic = int(labels.sum())
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return None
    counts, heads = np.zeros((2, len(sample.names)), int), np.zeros((2, len(sample.heads)), int)
    for i in rows:
        own = np.unique(sample.texts[i])
        counts[sample.labels[i], own] += 1
        begin = np.unique(sample.head_of[own])
        heads[sample.labels[i], begin[begin >= 0]] += 1

    def bounds(by: np.ndarray, least: int, over: float) -> np.ndarray:
        found = np.full(by.shape[1], np.nan)
        for k in np.flatnonzero(by[1] >= least):
            d, deviation = log_odds(int(by[1, k]), int(by[0, k]), n_toxic, n_clean)
            if d - z * deviation > over:
                found[k] = d - z * deviation
        return found

    words, begins = bounds(counts, 2, 1.6), bounds(heads, 4, 2.2)
    score = words.copy()
    for n in range(len(PREFIXES)):
        by_head = np.where(sample.head_of[:, n] >= 0, begins[sample.head_of[:, n]] if len(begins) else np.nan, np.nan)
        score = np.where(np.isnan(score), by_head, score)
    score = np.where(np.isnan(score), drift, score)
    seen = np.zeros(len(score))
    for i in rows:
        if not sample.labels[i]:
            seen += np.bincount(sample.texts[i], minlength=len(score))
    lam = 1.0
    if seen.any() and score[seen > 0].max() > 0:
        lo, hi = 0.0, 20.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (seen * np.exp(np.minimum(mid * score, 700))).sum() < seen.sum() else (lo, mid)
        lam = max(lo, 0.05)
    return Lexicon(words, begins, score, lam)


def fit(rows: Iterable[tuple[str | None, int]], folds: int = 3) -> ToxicModel:
    """rows: (whole text, label). Word counts are by document, as one passage makes a document toxic.

    K is fitted to the best segments of clean rows, and the logistic to the extreme values of all rows; both use rows
    that the scoring lexicon has not seen, by `folds` folds. Without rows of both classes every text scores the share
    of label 1."""
    sample = Sample.read(rows)
    own = sample.distinct()
    share = (float(sample.labels[own].sum()) + 0.5) / (len(own) + 1)
    whole = lexicon(sample, own)
    if whole is None:
        return ToxicModel({}, {}, -1.0, 1.0, 1.0, 0.0, math.log(share / (1 - share)))
    kept = lambda names, scores: {names[k]: float(scores[k]) for k in np.flatnonzero(~np.isnan(scores))}
    model = ToxicModel(kept(sample.names, whole.words), kept(sample.heads, whole.heads), DRIFT, whole.lam, 1.0, 1.0, 0.0)
    found = []
    for k in range(folds):
        part = lexicon(sample, [i for at, i in enumerate(own) if at % folds != k])
        if part is not None:
            for i in own[k::folds]:
                at = np.flatnonzero(part.score[sample.texts[i]] != DRIFT)
                hits = list(zip(at.tolist(), part.score[sample.texts[i][at]].tolist(), strict=True))
                found.append((len(sample.texts[i]), segments(hits, DRIFT), int(sample.labels[i])))
    # the count of chance segments over s is K n exp(-lambda s); each clean row's best segments give one estimate
    chance = [(n, max(s for _, _, s in got)) for n, got, y in found if got and not y]
    clean_tokens = sum(n for n, _, y in found if not y)
    model.k = min(1.0, max(1e-9, sum(math.exp(model.lam * min(s, 1.0)) for _, s in chance) / max(clean_tokens, 1)))
    x = np.array([extreme(model, n, got) for n, got, _ in found])
    model.a, model.b = platt(x, np.array([y for _, _, y in found], float))
    return model


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of a one-variable logistic by Newton steps."""
    a, b = 0.0, 0.0
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * np.array([a, b]))
        step /= max(1.0, np.abs(step).max() / 2)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def score_text(text: str | None, model: ToxicModel) -> tuple[float, list[tuple[int, int, float]], int]:
    n, found = scan(text, model)
    v = model.a * extreme(model, n, found) + model.b
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, v)))), found, n


def train(documents: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS_PER_CLASS, label: str = "toxic") -> ToxicModel:
    """Fit on labelled rows whose crc32(doc_id) mod `modulus` isn't `held_out`: at most `max_rows` of each class, in a
    hash order of the id. Only this sample, bounded in rows and characters, is read into the driver."""
    model = fit(sample_labelled(documents, labels, modulus, held_out, max_rows, label))
    give_back()
    return model


def sample_labelled(documents: DataFrame, labels: DataFrame, modulus: int, held_out: int, max_rows: int, label: str) -> Iterator[tuple[str | None, int]]:
    """(whole text, label) of a bounded sample, one by one in a hash order of the id, one text for each id. Texts beyond
    MAX_TEXT_CHARS are no part of it, and it ends at MAX_SAMPLE_CHARS."""
    known = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held_out)).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.dropDuplicates(["doc_id", "y"])
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    short = documents.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_TEXT_CHARS)
    texts = short.join(F.broadcast(picked), "doc_id")  # at most 2 * max_rows narrow rows
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "y")
    held = 0
    for r in texts.toLocalIterator():
        held += len(r["text"] or "")
        if held > MAX_SAMPLE_CHARS:
            break
        yield r["text"], r["y"]


def find_passages(documents: DataFrame, model: ToxicModel, significance: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted, n_tokens, and its significant toxic passages
    (first and last token, score, p value), by a linear scan of the whole text.

    Null and empty texts have no segment and score the calibrated floor; a text of any length is scanned whole, and all its
    passages count; equal texts score the same; repeated rows stay repeated; an empty table gives an empty result; other
    columns are ignored. Nothing is shuffled: the model, bounded by its training sample, travels with the task."""
    chosen = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = "doc_id long, score double, predicted int, n_tokens long, passages array<struct<first:long,last:long,score:double,p_value:double>>"
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (p for whole in batches for p in portions(whole, 1)):
            scores, sizes, passages = [], [], []
            for text in batch.column(1).to_pylist():
                score, found, n = score_text(text, m)
                scores.append(score)
                sizes.append(n)
                told = [{"first": a, "last": b, "score": s, "p_value": p_value(m, s, n)} for a, b, s in found]
                passages.append([t for t in told if t["p_value"] <= significance])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(sizes, pa.int64()), pa.array(passages, spans)],
                ["doc_id", "score", "predicted", "n_tokens", "passages"],
            )

    return chosen.mapInArrow(run, kind)


def remove_toxic(documents: DataFrame, model: ToxicModel, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score under `limit`, with all their columns as they were, whatever their names. Null and empty texts
    score the floor; repeated rows are judged alike; an empty table stays empty. Nothing is shuffled."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in portions(whole, at)):
            keep = [score_text(text, shared.value)[0] < limit for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
