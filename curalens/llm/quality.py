"""Text quality by a sparse rule ensemble: tree paths as rules, lasso logistic weights, compiled into columns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, remainder

#: Bound of the labelled sample, in rows of each class, and the size of the rule search.
MAX_ROWS_PER_CLASS = 8_000
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
#: Statistics that the rules are about, in order.
STATISTICS = (
    "n_chars", "n_words", "word_length", "upper_share", "symbol_share", "digit_share", "distinct_words", "repeat_share",
    "distinct_lines", "line_words", "stop_share", "sentence_words", "longest_word",
)


def with_statistics(df: DataFrame, text_col: str, prefix: str = "_s_") -> DataFrame:
    """Add the statistics of a whole text, named prefix + name. Null counts as empty, and an empty text has all zeros.
    Word and line lists are computed once per row and dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = F.col("_words"), F.col("_lines")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    chars, n = F.length(text).cast("double"), F.size(words).cast("double")
    df = df.withColumn("_words", F.filter(F.split(text, r"\s+"), lambda w: w != "")).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x != ""))
    found = {
        "n_chars": chars,
        "n_words": n,
        "word_length": per(F.length(F.array_join(words, "")).cast("double"), n),
        "upper_share": per(F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"), chars),
        "symbol_share": per(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")).cast("double"), chars),
        "digit_share": per(F.regexp_count(text, F.lit(r"[0-9]")).cast("double"), chars),
        "distinct_words": per(F.size(F.array_distinct(words)).cast("double"), n),
        "repeat_share": per(F.expr("size(filter(zip_with(_words, slice(_words, 2, 2147483647), (a, b) -> a = b), x -> x))").cast("double"), n),
        "distinct_lines": per(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
        "line_words": per(n, F.size(lines).cast("double")),
        "stop_share": per(F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("double"), n),
        "sentence_words": per(n, F.regexp_count(text, F.lit(r"[.!?](?:\s|$)")).cast("double") + 1),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)).cast("double"), F.lit(0.0)),
    }
    return df.withColumns({prefix + k: found[k] for k in STATISTICS}).drop("_words", "_lines")


@dataclass
class Rule:
    """A conjunction of (statistic, is_greater, threshold) with its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def text(self) -> str:
        return " and ".join(f"{n} {'>' if g else '<='} {t:.6g}" for n, g, t in self.terms)


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)


def grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: int, names: tuple[str, ...]) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on gradients: its paths, inner nodes included, and its Newton step for each row."""
    rules, out = [], np.zeros(len(g))

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        out[rows] = gs / (hs + 1.0)
        if terms:
            rules.append(Rule(terms))
        if not left or len(rows) < 2 * least:
            return
        best = (1e-3, -1, 0)
        for j in range(x.shape[1]):
            size = len(edges[j]) + 1
            cg = np.bincount(x[rows, j], g[rows], size).cumsum()[:-1]
            ch = np.bincount(x[rows, j], h[rows], size).cumsum()[:-1]
            cn = np.bincount(x[rows, j], minlength=size).cumsum()[:-1]
            if len(cg):
                gain = cg**2 / (ch + 1) + (gs - cg) ** 2 / (hs - ch + 1) - gs**2 / (hs + 1)
                gain[(cn < least) | (len(rows) - cn < least)] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
        _, j, k = best
        if j >= 0:
            low = x[rows, j] <= k
            split(rows[low], (*terms, (names[j], False, float(edges[j][k]))), left - 1)
            split(rows[~low], (*terms, (names[j], True, float(edges[j][k]))), left - 1)

    split(np.arange(len(g)), (), depth)
    return rules, out


def holds(rule: Rule, x: np.ndarray, at: dict[str, int]) -> np.ndarray:
    found = np.ones(len(x), bool)
    for name, greater, t in rule.terms:
        found &= x[:, at[name]] > t if greater else x[:, at[name]] <= t
    return found


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient steps; the intercept is free."""
    n, m = z.shape
    bound = np.linalg.norm(z.T @ z / n, 2) / 4 + 0.25 + 1e-9
    w, b, v, c, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        u = v - z.T @ r / n / bound
        w1, b1 = np.sign(u) * np.maximum(np.abs(u) - penalty / bound, 0), c - r.mean() / bound
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, b


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = STATISTICS, prior: float | None = None, trees: int = TREES, penalty: float = 2e-4) -> RuleModel:
    """Boost shallow trees, take every path of them as a rule, keep those that the lasso gives a weight.

    x: one row of statistics per labelled text; y: 0 or 1; prior: the share of label 1 among all labelled rows, which
    the intercept is shifted to if the sample was balanced otherwise. With one class only, or no rows, there are no rules."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = share if prior is None else prior
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(float(np.log(prior / (1 - prior))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, found = np.full(len(y), np.log(share / (1 - share))), {}
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rules, step = grow(binned, edges, y - p, p * (1 - p), DEPTH, least, names)
        margin += RATE * step
        found |= {r.terms: r for r in rules}
    at, rules, columns, seen = {n: j for j, n in enumerate(names)}, [], [], set()
    for rule in found.values():
        column = holds(rule, x, at)
        key = column.tobytes()
        if key not in seen and 0 < column.sum() < len(y):
            seen.add(key)
            rules.append(rule)
            columns.append(column)
    if not rules:
        return RuleModel(float(np.log(prior / (1 - prior))))
    z = np.stack(columns, 1).astype(float)
    scale = np.sqrt(z.mean(0) * (1 - z.mean(0)))
    w, b = lasso_logistic(z / scale, y, penalty)
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return RuleModel(float(b + shift), [Rule(r.terms, float(v)) for r, v in zip(rules, w / scale, strict=True) if abs(v) > 1e-6])


def compile_score(model: RuleModel, prefix: str = "_s_") -> Column:
    """The model as one column: the logistic of the intercept and the weights of the rules that hold."""
    parts = [f"({model.intercept!r}D)"]
    for rule in model.rules:
        test = " AND ".join(f"{prefix}{n} {'>' if g else '<='} {t!r}D" for n, g, t in rule.terms)
        parts.append(f"(CASE WHEN {test} THEN {rule.weight!r}D ELSE 0D END)")
    while len(parts) > 1:  # a balanced sum keeps the expression tree shallow
        parts = [f"({' + '.join(parts[i : i + 8])})" for i in range(0, len(parts), 8)]
    return F.expr(f"1D / (1D + exp(-{parts[0]}))")


def score_quality(documents: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every document, from its whole text, in columns only.

    Null and empty texts have all-zero statistics and are scored by them; repeated rows stay repeated; other columns are
    ignored, whatever their names. Nothing is shuffled."""
    chosen = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    scored = with_statistics(chosen, "_text").select("doc_id", compile_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(documents: DataFrame, model: RuleModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score `least` or more, with all their columns as they were. Nothing is shuffled.

    The score passes through a generator of one row: a filter would otherwise be pushed below the projection of the
    statistics, each of which would then be computed again in every rule that names it."""
    held = documents.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    scored = with_statistics(held, "_text").select("_row", F.explode(F.array(compile_score(model))).alias("_score"))
    return scored.where(F.col("_score") >= least).select("_row.*")


def train(documents: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS_PER_CLASS, label: str = "quality") -> RuleModel:
    """Fit on labelled rows whose crc32(doc_id) mod `modulus` isn't `held_out`: at most `max_rows` of each class, in a
    hash order of the id, each with one text, the least of those that have its id. Only their statistics, a few numbers a row, reach the
    driver. Empty tables give a model without rules."""
    known = labels.where(F.col(label).isin(0, 1) & (remainder("doc_id", modulus) != held_out)).select("doc_id", F.col(label).cast("int").alias("_y"))
    known = known.dropDuplicates(["doc_id", "_y"])
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    parts = [known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    texts = documents.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "_y").agg(F.min("_text").alias("_text"))
    rows = with_statistics(texts, "_text").select("_y", *[f"_s_{n}" for n in STATISTICS]).collect()
    data = np.array([list(r) for r in rows], float).reshape(-1, 1 + len(STATISTICS))
    del rows
    prior = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    model = fit(data[:, 1:], data[:, 0], prior=prior)
    give_back()
    return model
