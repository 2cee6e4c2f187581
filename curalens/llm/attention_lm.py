"""A small causal self-attention language model on subword ids, in numpy.

One attention head over the last one to two blocks of subwords, with a query for each place, gives with the last subword a
state for each position. The state predicts the class of the next subword and the subword within its class, where the corpus shares
after the subword before it are a bias that the state's logits shift. All steps are normalised, so a text's score is the exact log
probability that the model gives its subwords, and classes tell the beginnings of words from what goes on inside them, so the
probability that a word ends is known too.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from dataclasses import dataclass, fields, replace
from pathlib import Path

import numpy as np

#: Default parameters: width of the head, block (a context holds one to two), classes, subwords that are a class by themselves,
#: subwords with rows of their own, and the weight, in counts, of a class's own shares against the counts after a given subword.
WIDTH, BLOCK, CLASSES, SINGLE, OWN, BACKOFF = 32, 16, 64, 24, 2500, 20.0
#: Default parameters of training: steps, blocks in a step, learning rate, and the seed.
STEPS, BATCH, RATE, SEED = 1000, 256, 1e-2, 7
#: Blocks of one portion of the attention, which fits a core's cache, and of one portion of the subwords within classes.
PORTION, GROUP = 192, 768


@functools.cache
def one_thread() -> None:
    """Hold numpy's matrix library to one thread, where it can be told so: the matrices here are small, and Spark already
    runs a task on each core."""
    for path in Path(np.__file__).parents[1].glob("numpy.libs/*openblas*"):
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


@dataclass
class Model:
    """place: subword -> row of the tables, rows of one class side by side; kind: subword -> class; inside: log share of a
    subword in its class. first: whether a subword begins a word; begins: whether a class does. spans: first and last row of
    each class, empty for classes of rare subwords. pairs: log share of a subword (column) in its class after the subword
    before it in its word; its last two rows are a word's start and any rare subword. The last subword is the end mark, which
    ends words too; the last table row is the start. rows: those table rows that a part of a model has, by which its contexts are numbered; all of them, if
    it is null. All logarithms are natural."""

    place: np.ndarray
    kind: np.ndarray
    inside: np.ndarray
    first: np.ndarray
    begins: np.ndarray
    spans: np.ndarray
    pairs: np.ndarray
    params: dict[str, np.ndarray]
    rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        """Tables that are made from the others aren't sent with them."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def share(self, other: Model) -> None:
        """Take over the tables of another model that are made from what training leaves alone."""
        self.inner, self.group, self.bounds = other.inner, other.group, other.bounds

    @property
    def end(self) -> int:
        return len(self.kind) - 1

    @property
    def own(self) -> int:
        return self.pairs.shape[1]

    @functools.cached_property
    def both(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys, scaled, and values, mixed. Only for a model that isn't trained any more."""
        p = self.params
        return p["k"] * np.float32(1 / np.sqrt(p["k"].shape[1])), p["v"] @ p["mix"]

    @functools.cached_property
    def inner(self) -> list[np.ndarray]:
        """The columns of the pairs table that each class has, side by side in memory."""
        return [np.ascontiguousarray(self.pairs[:, lo:hi]) for lo, hi in self.spans]

    @functools.cached_property
    def bounds(self) -> list[list[int]]:
        """The spans, as Python's numbers."""
        return self.spans.tolist()

    @functools.cached_property
    def steep(self) -> bool:
        """Whether any score or logit may lie beyond what exp holds."""
        p = self.params
        length = lambda t: float(np.sqrt((p[t].astype(np.float64) ** 2).sum(1).max()))
        heat = length("q") * length("k") / np.sqrt(p["q"].shape[1]) + float(np.abs(p["near"]).max())
        top = float((np.abs(p["out"]).sum(0) + np.abs(p["bias"])).max())
        return max(heat, top, float(np.abs(p["sub"]).sum(1).max(initial=0))) > 50

    @functools.cached_property
    def group(self) -> np.ndarray:
        """The class of each subword whose place within its class the state has a say in, else -1: those that share their class with others
        that have rows of their own."""
        several = (self.spans[:, 1] - self.spans[:, 0] > 1)[self.kind] & (self.place < self.own)
        return np.where(several, self.kind, -1).astype(np.int16)


def group_subwords(features: np.ndarray, mass: np.ndarray, k: int, rounds: int = 25, seed: int = SEED) -> np.ndarray:
    """k-means with rows weighted by mass; the first centers are the heaviest rows, spread by distance."""
    k = min(k, len(features))
    rng = np.random.default_rng(seed)
    chosen = [int(np.argmax(mass))]
    far = ((features - features[chosen[0]]) ** 2).sum(1)
    for _ in range(1, k):
        p = far * mass + 1e-12
        chosen.append(int(rng.choice(len(features), p=p / p.sum())))
        far = np.minimum(far, ((features - features[chosen[-1]]) ** 2).sum(1))
    centers = features[chosen]
    for _ in range(rounds):
        near = ((features[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        total = np.bincount(near, mass, k)
        for j in range(features.shape[1]):
            centers[:, j] = np.where(total > 0, np.bincount(near, mass * features[:, j], k) / np.maximum(total, 1e-9), centers[:, j])
    return near


def classes_of(counts: np.ndarray, first: np.ndarray, before: np.ndarray, after: np.ndarray, pairs: np.ndarray, n_classes: int = CLASSES, own: int = OWN, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, kind, inside) from the corpus counts of subwords and of subword pairs. Subwords that stand beside the same others
    are grouped, but for the most frequent ones: their profiles of neighbours are projected, reduced by a singular value decomposition and clustered, word
    starts and continuations apart. Rare subwords form two classes; the end mark is one. Shares are smoothed by a tenth of
    a count."""
    smooth = counts + 0.1
    order = np.argsort(-smooth[:-1], kind="stable")[:own]
    row = np.full(len(counts) + 1, -1)
    row[order] = np.arange(len(order))
    table = np.zeros((len(order) + 1, len(order) + 1), np.float32)  # a word's start and rare subwords share the last row
    table[row[before], row[after]] = np.sqrt(pairs)
    aim = np.random.default_rng(seed).standard_normal((2, len(order) + 1, 96)).astype(np.float32)
    profile = (table.T @ aim[0] + table @ aim[1])[:-1]
    profile /= np.linalg.norm(profile, axis=1, keepdims=True) + 1e-9
    u, s, _ = np.linalg.svd(profile - profile.mean(0), full_matrices=False)
    features = u[:, :12] * s[:12]
    features = features / (np.linalg.norm(features, axis=1, keepdims=True) + 1e-9)
    kind = np.full(len(counts), -1)
    at = min(SINGLE, n_classes // 3, len(order))
    kind[order[:at]] = np.arange(at)  # the most frequent ones
    for begins in (False, True):
        part = np.flatnonzero((first[order] == begins) & (kind[order] < 0))
        if len(part):
            heavy = np.log(smooth[order[part]])[:, None] * 0.15
            near = group_subwords(np.concatenate([features[part], heavy], 1).astype(float), smooth[order[part]], max(1, (n_classes - SINGLE) // 2 - 1))
            kind[order[part]] = at + near
            at += int(near.max()) + 1
        rest = (kind < 0) & (first == begins)
        rest[-1] = False
        kind[rest] = at
        at += 1
    kind[-1] = at
    _, kind = np.unique(kind, return_inverse=True)
    total = np.bincount(kind, smooth)
    order = order[np.argsort(kind[order], kind="stable")]
    row[order] = np.arange(len(order))
    place = np.where(row[:-1] >= 0, row[:-1], len(order) + kind)
    return place, kind, np.log(smooth / total[kind])


def pair_logs(place: np.ndarray, kind: np.ndarray, inside: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, counts: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """log share of each own subword in its class after each own subword, a word's start, or a rare subword (which tells
    nothing): the pair counts, backed off to the class's own shares by `backoff` counts."""
    inner = np.zeros(own, int)
    inner[place[place < own]] = np.flatnonzero(place < own)
    table = np.zeros((own + 2, own), np.float32)
    b = np.where(before < 0, own, np.where(place[before] < own, place[before], -1))
    good = (b >= 0) & (place[after] < own)
    np.add.at(table, (b[good], place[after[good]]), counts[good].astype(np.float32))
    # pairs with a rare second subword count in the class's total
    totals = np.zeros((own + 2, int(kind.max()) + 1), np.float32)
    np.add.at(totals, (b[b >= 0], kind[after[b >= 0]]), counts[b >= 0].astype(np.float32))
    table += backoff * np.exp(inside[inner]).astype(np.float32)
    table /= totals[:, kind[inner]] + backoff
    return np.log(table, out=table)


def start(
    counts: np.ndarray, first: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
    width: int = WIDTH, block: int = BLOCK, n_classes: int = CLASSES, own: int = OWN, seed: int = SEED,
) -> Model:
    """A model before training. counts: of all subwords, the end mark last; pairs: (before, after, count), before -1 at a
    word's start; both of the whole training corpus."""
    place, kind, inside = classes_of(counts, first, *pairs, n_classes, own)
    own = min(own, len(counts) - 1)
    rows, n = int(place.max()) + 2, int(kind.max()) + 1
    begins = np.zeros(n, bool)
    begins[kind[first]] = True
    held = np.bincount(kind[place < own], minlength=n)
    spans = np.stack([np.cumsum(held) - held, np.cumsum(held)], 1)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(width)).astype(np.float32)
    mass = np.bincount(kind, counts + 0.1)
    params = {
        "q": draw(rows, width), "k": draw(rows, width), "v": draw(rows, width), "u": draw(rows, width), "mix": draw(width, width), "out": draw(width, n) * 0.1,
        "bias": np.log(mass / mass.sum()).astype(np.float32), "near": np.zeros(2 * block, np.float32), "sub": draw(own, width) * 0.01,
    }
    return Model(place, kind, inside, first, begins, spans, pair_logs(place, kind, inside, own, *pairs), params)


def before_rows(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row of the pairs table for each target: the subword before it in its word, a word's start, or a rare subword. x: the
    table rows of the contexts' second half, y: the targets."""
    own = model.own
    x = x if model.rows is None else model.rows[x]
    return np.where(model.first[y], own, np.where(x < own, x, own + 1))


def blocks_of(texts: list[np.ndarray], model: Model, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`cut_blocks` of a list of texts."""
    return cut_blocks(np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(t) for t in texts], np.int64), model, block)


def cut_blocks(ids: np.ndarray, lengths: np.ndarray, model: Model, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts (subword ids with the end mark, one after the other) into blocks: (context rows, first flags, targets, text number).

    A block's context is the block before it in its text and itself, shifted by one: the inputs are the start mark and all
    subwords but the last. Targets past a text's end are -1. Each subword is the target of one block."""
    rows = len(model.params["q"]) - 1
    sizes = -(-lengths // block)
    n = int(sizes.sum())
    x, y = np.full(n * block + 1, rows, np.int32), np.full(n * block, -1, np.int32)
    begin = np.cumsum(sizes) - sizes
    at = np.arange(len(ids)) + np.repeat(begin * block - (np.cumsum(lengths) - lengths), lengths)
    y[at] = ids
    x[at + 1] = model.place[ids]
    x[begin[sizes > 0] * block] = rows  # a text begins anew, whatever ended before it
    x, y = x[:-1].reshape(n, block), y.reshape(n, block)
    text = np.repeat(np.arange(len(lengths)), sizes)
    first = np.zeros(n, bool)
    first[begin[sizes > 0]] = True
    before = np.concatenate([np.full((1, block), rows, np.int32), x[:-1]]) if n else x
    return np.concatenate([before, x], 1), first, y, text


@functools.cache
def attention_mask(block: int) -> np.ndarray:
    """Distance of each context position from each query of the second half; -1 where it lies ahead."""
    d = block + np.arange(block)[:, None] - np.arange(2 * block)[None, :]
    return np.where(d < 0, -1, d)


def total(values: np.ndarray) -> np.ndarray:
    """Sums of the rows, as a product, which is the faster way for short rows."""
    return values @ np.ones(values.shape[-1], values.dtype)


def bend(values: np.ndarray) -> None:
    """tanh in place, from exp, which takes half its time."""
    kind = values.dtype.type
    with np.errstate(over="ignore"):  # beyond what exp holds the result is -1
        values *= kind(-2)
        np.exp(values, out=values)
    values += kind(1)
    np.divide(kind(2), values, out=values)
    values -= kind(1)


def exponentiate(values: np.ndarray, most: float = 60.0) -> None:
    """exp of rows that are normalised afterwards, in place; rows are shifted only where exp might not hold them."""
    if max(float(values.max(initial=0)), -float(values.min(initial=0))) > most:
        values -= values.max(-1, keepdims=True)
    np.exp(values, out=values)


def forward(model: Model, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """The attention's shares, states and logits of the classes. Values are mixed, and keys scaled, as a table, before they are looked up."""
    p, block = model.params, x.shape[1] // 2
    here, distance = x[:, block:], attention_mask(block)
    kind = p["q"].dtype.type
    q, k, v = np.take(p["q"], here, 0), np.take(p["k"] * kind(1 / np.sqrt(p["k"].shape[1])), x, 0), np.take(p["v"] @ p["mix"], x, 0)
    s = np.matmul(q, k.transpose(0, 2, 1))
    steep = max(float(s.max(initial=0)), -float(s.min(initial=0))) + float(np.abs(p["near"]).max()) > 60  # beyond what exp may hold
    s += np.where(distance < 0, kind(-1e9), p["near"][distance])
    if steep:
        s[first, :, :block] = -1e9
        s -= s.max(2, keepdims=True)
    np.exp(s, out=s)
    s[first, :, :block] = 0
    s *= (1 / total(s))[..., None]
    h = np.matmul(s, v)
    z = np.take(p["u"], here, 0)
    z += h
    bend(z)
    logits = z.reshape(-1, z.shape[2]) @ p["out"]
    logits += p["bias"]
    return {"q": q, "k": k, "v": v, "a": s, "h": h, "z": z, "logits": logits}


def class_logs(model: Model, x: np.ndarray, first: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of each target class, log probability that a word begins or the text ends there, states), as `forward`
    gives them, with fewer passes over memory.

    Attention scores and logits are bounded by the small tables, so they are exponentiated without shifting them first;
    they are clipped only if the tables have grown so far that exp might not hold them."""
    p, block = model.params, x.shape[1] // 2
    here, distance = x[:, block:], attention_mask(block)
    s = np.matmul(np.take(p["q"], here, 0), np.take(model.both[0], x, 0).transpose(0, 2, 1))
    s += np.where(distance < 0, np.float32(-1e9), p["near"][distance])
    if model.steep:
        np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s[first, :, :block] = 0
    z = np.matmul(s, np.take(model.both[1], x, 0))
    z *= (1 / total(s))[..., None]
    z += np.take(p["u"], here, 0)
    bend(z)
    z = z.reshape(-1, z.shape[2])
    logits = z @ p["out"]
    logits += p["bias"]
    if model.steep:
        np.clip(logits, -60, 60, out=logits)
    chosen = logits[np.arange(len(logits)), target.ravel()]
    np.exp(logits, out=logits)
    sums = np.log(logits @ np.stack([np.ones(len(model.begins)), model.begins], 1).astype(np.float32))
    return (chosen - sums[:, 0]).reshape(target.shape), (sums[:, 1] - sums[:, 0]).reshape(target.shape), z


def by_class(model: Model, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, slice]]]:
    """(positions in the order of the classes, (class, first row, last row, stretch of them) of each class) among the targets y whose
    subwords the state tells apart."""
    kind = model.group[y]
    order = np.argsort(kind, kind="stable")
    sizes = np.bincount(kind + 1, minlength=len(model.spans) + 1)
    at = (np.cumsum(sizes) - sizes[0]).tolist()
    found = [(c, *model.bounds[c], slice(at[c], at[c + 1])) for c in np.flatnonzero(sizes[1:]).tolist()]
    return order[sizes[0] :], found


def within(model: Model, z: np.ndarray, before: np.ndarray, y: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, np.ndarray, np.ndarray]:
    """(positions in the order of the classes, their states, parts, logits, where the targets' logits lie) of the subwords within their classes: a state's logits
    shift the shares after the subword before it in its word. The logits of all classes lie side by side, so that what is alike for them is done at once; a part is
    (first row, last row, stretch of positions, logits as a table) of a class."""
    order, classes = by_class(model, y)
    states, rows, kind = np.take(z, order, 0), before[order], model.kind[y[order]]
    low = model.spans[:, 0][kind]
    size = model.spans[:, 1][kind] - low
    ends = np.cumsum(size)
    logits, parts = np.empty(int(size.sum()), z.dtype), []
    for c, lo, hi, at in classes:
        part = logits[ends[at.start] - (hi - lo) : ends[at.stop - 1]].reshape(-1, hi - lo)
        np.matmul(states[at], model.params["sub"][lo:hi].T, out=part)
        part += np.take(model.inner[c], rows[at], 0)
        parts.append((lo, hi, at, part))
    return order, states, parts, logits, ends - size + place[order] - low


def part_totals(parts: list, n: int, dtype: np.dtype) -> np.ndarray:
    """Sum of the numbers of each position, of `parts` as `within` gives them."""
    sums, ones = np.empty(n, dtype), np.ones(max([hi - lo for lo, hi, *_ in parts], default=0), dtype)
    for lo, hi, at, part in parts:
        np.matmul(part, ones[: hi - lo], out=sums[at])
    return sums


def inside_logs(model: Model, z: np.ndarray, before: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log probability of each target within its class. Rare subwords have their shares of the corpus."""
    place = model.place[y]
    own = place < model.own
    out = np.where(own, model.pairs[before, np.where(own, place, 0)], model.inside[y])
    order, _, parts, logits, mine = within(model, z, before, y, place)
    if model.steep:
        np.clip(logits, -80, 80, out=logits)
    chosen = logits[mine]
    np.exp(logits, out=logits)
    out[order] = chosen - np.log(part_totals(parts, len(order), logits.dtype))
    return out


def score(model: Model, texts: list[np.ndarray], **sizes: int) -> tuple[np.ndarray, np.ndarray]:
    """`score_ids` of a list of texts."""
    return score_ids(model, np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(t) for t in texts], np.int64), **sizes)


def score_ids(model: Model, ids: np.ndarray, lengths: np.ndarray, portion: int = PORTION, group: int = GROUP, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(log probability, log probability that a word begins or the text ends there) of each subword of the texts (ids with the
    end mark, one after the other), each scored once."""
    one_thread()
    x, first, y, _ = cut_blocks(ids, lengths, model, block)
    out, edge = np.empty(y.shape, np.float64), np.empty(y.shape, np.float32)
    width = model.params["q"].shape[1]
    for top in range(0, len(x), group):
        to = min(top + group, len(x))
        z = np.empty(((to - top) * block, width), np.float32)
        for at in range(top, to, portion):
            part = slice(at, min(at + portion, to))
            out[part], edge[part], z[(part.start - top) * block : (part.stop - top) * block] = class_logs(model, x[part], first[part], model.kind[y[part]])
        target = y[top:to].ravel()
        out[top:to] += inside_logs(model, z, before_rows(model, x[top:to, block:].ravel(), target), target).reshape(-1, block)
    own = y >= 0
    return out[own], edge[own].astype(np.float64)


@functools.cache
def row_places(width: int) -> np.ndarray:
    """Places of the numbers of each row in a flat table of rows of that width."""
    return np.arange((1 << 12) * width).reshape(-1, width)


def spread(rows: np.ndarray, n: int, width: int, dtype: np.dtype) -> tuple[np.ndarray, np.dtype]:
    """Where the numbers of each of the rows lie in a flat table of n rows, two side by side as one complex number, which are added at once."""
    pair = np.dtype(dtype.char.upper()) if width % 2 == 0 and dtype.char in "fd" else dtype
    width = width * dtype.itemsize // pair.itemsize
    if n > len(row_places(width)):
        return np.add.outer(rows.ravel().astype(np.intp) * width, np.arange(width)).ravel(), pair
    return np.take(row_places(width), rows.ravel(), 0).ravel(), pair


def gather(places: tuple[np.ndarray, np.dtype], grads: np.ndarray, n: int) -> np.ndarray:
    """Sum the gradients of each of n table rows, which lie at the places by `spread`."""
    at, pair = places
    out = np.zeros((n, grads.shape[-1]), grads.dtype)
    np.add.at(out.view(pair).ravel(), at, grads.view(pair).ravel())
    return out


def inside_back(model: Model, z: np.ndarray, before: np.ndarray, y: np.ndarray, place: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, gradient of the table "sub", positions, gradient of their states) of the predictions of subwords within their classes."""
    sub = model.params["sub"]
    order, states, parts, share, mine = within(model, z, before, y, place)
    weight, back, grad = weight[order], np.empty_like(states), np.zeros_like(sub)
    if max(float(share.max(initial=0)), -float(share.min(initial=0))) > 60:
        for *_, part in parts:
            part -= part.max(1, keepdims=True)
    np.exp(share, out=share)
    sums = part_totals(parts, len(order), share.dtype)
    loss = -float(np.log(np.maximum(share[mine] / sums, 1e-30)) @ weight)
    sums = (weight / sums)[:, None]
    for *_, at, part in parts:
        part *= sums[at]
    share[mine] -= weight
    for lo, hi, at, part in parts:
        np.matmul(part.T, states[at], out=grad[lo:hi])
        np.matmul(part, sub[lo:hi], out=back[at])
    return loss, grad, order, back


def gradients(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss in nats of the predictions of classes and of subwords within them, and its gradients."""
    p, block = model.params, x.shape[1] // 2
    f = forward(model, x, first)
    flat, seen = np.where(y >= 0, y, model.end).ravel(), (y >= 0).ravel()
    n, dl = max(1, int(seen.sum())), f["logits"]
    weight = (seen / n).astype(dl.dtype)
    mine = np.arange(len(flat)) * dl.shape[1] + model.kind[flat]
    exponentiate(dl)
    sums, prob = total(dl), dl.ravel()[mine]
    loss = float(-np.log(np.maximum(prob / sums, 1e-30))[seen].sum() / n)
    dl *= (weight / sums)[:, None]
    dl.ravel()[mine] -= weight
    rows, width = p["q"].shape
    z = f["z"].reshape(-1, width)
    g = {"out": z.T @ dl, "bias": total(dl.T)}
    before = before_rows(model, x[:, block:].ravel(), flat)
    place = model.place[flat]
    told = np.flatnonzero(seen & (model.group[flat] < 0))  # a class's share that nothing learns
    at = place[told]
    loss -= float(np.where(at < model.own, model.pairs[before[told], np.where(at < model.own, at, 0)], model.inside[flat[told]]).sum() / n)
    more, g["sub"], order, back = inside_back(model, z, before, flat, place, weight)
    loss += more
    dz = np.zeros_like(z)
    dz[order] = back
    dz += dl @ p["out"].T
    np.multiply(z, z, out=z)  # the states aren't used any more
    z *= dz
    dz -= z
    da = dz.reshape(f["z"].shape)
    dv = np.matmul(f["a"].transpose(0, 2, 1), da)
    ds = np.matmul(da, f["v"].transpose(0, 2, 1))
    ds -= np.einsum("ijk,ijk->ij", da, f["h"])[..., None]
    ds *= f["a"]
    distance = attention_mask(block)
    g["near"] = np.bincount(distance[distance >= 0], ds.sum(0)[distance >= 0], len(p["near"])).astype(ds.dtype)
    places = spread(x[:, block:], rows, width, ds.dtype)
    g |= {"q": gather(places, np.matmul(ds, f["k"]), rows), "u": gather(places, da, rows)}
    places = spread(x, rows, width, ds.dtype)
    mixed = gather(places, dv, rows)
    g |= {"k": gather(places, np.matmul(ds.transpose(0, 2, 1), f["q"]), rows), "v": mixed @ p["mix"].T, "mix": p["v"].T @ mixed}
    g["k"] *= ds.dtype.type(1 / np.sqrt(width))
    return loss, g


#: Tables with a row for each subword that has rows of its own; a step changes those of its blocks' subwords alone.
TABLES = ("q", "k", "v", "u")
#: Shares of the means of gradients and of their squares that a step leaves.
KEEP, KEEP_SQUARES = 0.9, 0.98


def descend(p: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray, pace: float, least: float) -> None:
    """A step of Adam, in place. a, b: sums of gradients and of their squares, which have lost their shares; g is used up."""
    a += g
    g *= g
    b += g
    np.sqrt(b, out=g)
    g += least
    np.divide(a, g, out=g)
    g *= pace
    p -= g


def train(model: Model, blocks: tuple[np.ndarray, np.ndarray, np.ndarray], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
    """Adam on blocks (contexts, first flags, targets) in a random order, with a cosine learning rate; returns the losses. All blocks are
    gone through, the last ones in a smaller step, before any comes again.
    Without blocks the model keeps its first state, whose predictions are close to the corpus shares.

    A row of the tables that a step's blocks don't use has no gradient there; it goes on by what it had, which is worked out for all such steps at
    once when the row is used again: in each its mean gradient and the root of its squares shrink by fixed shares."""
    one_thread()
    x, first, y = blocks
    losses: list[float] = []
    if not len(x) or steps < 1:
        return losses
    rng, names, width = np.random.default_rng(seed), list(model.params), model.params["q"].shape[1]
    rest = [k for k in names if k not in TABLES]
    table, flat = np.concatenate([model.params[k] for k in TABLES], 1), np.concatenate([model.params[k].ravel() for k in rest])
    ends = np.cumsum([model.params[k].size for k in rest]).tolist()
    own = {k: flat[to - model.params[k].size : to].reshape(model.params[k].shape) for k, to in zip(rest, ends, strict=True)}
    t = np.arange(1, steps + 1)
    scale = np.sqrt((1 - KEEP_SQUARES) / (1 - KEEP_SQUARES**t))
    now = rate * np.minimum(1.0, t / 50) * (0.02 + 0.98 * (0.5 + 0.5 * np.cos(np.pi * t / steps)))
    pace, least = (now * (1 - KEEP) / (1 - KEEP**t) / scale).tolist(), (1e-9 / scale).tolist()
    small = np.r_[1e-9, 1e-9 / scale].astype(model.params["q"].dtype)
    # ahead[t]: of a row that isn't used any more after step t, how far it still goes, in units of its ratio then
    shrink, ahead = KEEP / np.sqrt(KEEP_SQUARES), np.zeros(steps + 1)
    for k in range(steps - 1, -1, -1):
        ahead[k] = shrink * (pace[k] + ahead[k + 1])
    am, bm, last = np.zeros_like(table), np.zeros_like(table), np.zeros(len(table), np.int64)
    a, b, g, spare = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat), np.empty(len(table), np.int32)

    def caught_up(rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows, and their sums, as they are after a step."""
        since = step - last[rows]
        q, c, d = np.take(table, rows, 0), np.take(am, rows, 0), np.take(bm, rows, 0)
        move = np.sqrt(d)
        move += small[last[rows]][:, None]
        np.divide(c, move, out=move)
        move *= (ahead[last[rows]] - shrink**since * ahead[step]).astype(q.dtype)[:, None]
        q -= move
        c *= (KEEP**since).astype(q.dtype)[:, None]
        d *= (KEEP_SQUARES**since).astype(q.dtype)[:, None]
        return q, c, d

    order, at = np.zeros(0, np.int64), 0
    for step in range(1, steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(x)), 0
        pick = order[at : at + batch]
        at += batch
        used = np.zeros(len(table), bool)
        used[x[pick]] = True
        rows = np.flatnonzero(used)
        spare[rows] = np.arange(len(rows))
        q, c, d = caught_up(rows, step - 1)
        part = replace(model, params=own | {k: np.ascontiguousarray(q[:, i * width : (i + 1) * width]) for i, k in enumerate(TABLES)}, rows=rows)
        part.share(model)
        loss, grads = gradients(part, spare[x[pick]], first[pick], y[pick])
        losses.append(loss)
        c *= KEEP
        d *= KEEP_SQUARES
        descend(q, c, d, np.concatenate([grads[k] for k in TABLES], 1), pace[step - 1], least[step - 1])
        table[rows], am[rows], bm[rows], last[rows] = q, c, d, step
        np.concatenate([grads[k].ravel() for k in rest], out=g)
        a *= KEEP
        b *= KEEP_SQUARES
        descend(flat, a, b, g, pace[step - 1], least[step - 1])
    table = caught_up(np.arange(len(table)), steps)[0]
    model.params = {k: own[k] if k in own else np.ascontiguousarray(table[:, TABLES.index(k) * width :][:, :width]) for k in names}
    return losses


def copy_of(model: Model) -> Model:
    """A copy that is trained on its own; it shares the tables that training leaves alone."""
    copy = replace(model, params={k: v.copy() for k, v in model.params.items()})
    copy.share(model)
    return copy
