"""Training-data operators against brute force, and on nulls, empty and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from curalens.llm import attention_lm, decontaminate, html_text, lm, minhash, packing, pivots, quality, toxicity, url_filter, warc
from curalens.llm.common import connected_components
from curalens.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, _words string, _text string, score int, component int"


def docs(spark, texts):
    """Documents whose extra columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "w", "x", 5, 6) for i, t in texts], DOCS)


def prose(rng, n, words=60):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(rng.randint(n // 2, n) if n else words))


EDGE = [(None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "One\x0bTWO"), (6, "é " * 3000)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert all(label[k] == v for k, v in got.items()) and {a for a, b in edges if a != b} <= got.keys()


def brute_minhash(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = minhash.words_of(None if t is None else t.encode())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    ids = list(sets)
    for _ in ids:
        changed = False
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        if not changed:
            break
    return sets, label


def test_minhash_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for k in range(12):
        base = prose(rng, 160).split()
        for j in range(7):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = "zz" + str(rng.random())
            rows.append((100 + 10 * k + j, " ".join(copy)))
    rows += [(i, t) for i, t in EDGE if i is not None]
    sets, label = brute_minhash(rows)
    got = minhash.near_duplicates(docs(spark, rows + [EDGE[0]])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] and r["n_shingles"] == 0
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"])
    assert minhash.near_duplicates(docs(spark, [])).collect() == []


def test_minhash_tests_every_pair_of_mixed_buckets(spark):
    rng = random.Random(5)
    template = [f"w{k}" for k in range(400)]

    def changed(words, places):
        return [f"{k}x{rng.random()}" if k in places else w for k, w in enumerate(words)]

    rows = [(i, changed(template, range(20, 400, 48))) for i in range(200)]  # of one template, with 8 words each of their own
    for k in range(2):  # near copies, hardly nearer than any two documents
        rows.append((1000 + k, changed(rows[40 * k + 7][1], range(40, 400, 64))))
    rows = [(i, " ".join(w)) for i, w in rows]
    sets = {i: set(minhash.shingle_set(t.encode()).tolist()) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.85 < alike(1000 + k, 40 * k + 7) < 0.87 for k in range(2)) and 0.8 < alike(0, 1) < 0.85
    # in a single bucket, so that few stars can't come to test all pairs by chance
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), bands=1, rows=1).collect()}
    assert got == {i: i if i < 1000 else 40 * (i - 1000) + 7 for i, _ in rows}


def test_minhash_of_ids_with_several_texts(spark):
    a, b = ([f"{x}{k}" for k in range(300)] for x in "ab")
    near = lambda w: " ".join([*w[:-2], "y", "z"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (7, " ".join(b)), (4, near(b) + " x")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [(4, 4, True), (5, 4, False), (5, 5, True), (6, 5, False), (7, 4, False), (7, 4, False)]


def test_minhash_finds_links_among_boilerplate(spark):
    rng, rows = random.Random(11), []
    template = [f"w{k}" for k in range(250)]
    own = lambda words, k: [f"{rng.random()}" if at % (len(words) // k) == 3 else w for at, w in enumerate(words)]
    for i in range(600):
        rows.append((i, own(template, 6)))  # any two share about 0.80
    pairs = [(17 * k, 1000 + k) for k in range(12)]
    for at, new in pairs:
        rows.append((new, own(rows[at][1], 3)))
    rows = [(i, " ".join(w)) for i, w in rows]
    sets = {i: set(minhash.shingle_set(t.encode()).tolist()) for i, t in rows}
    label = {i: i for i, _ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(5):
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
    assert len(linked) >= 12
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows)).collect()} == label


def test_optimal_densification_fills_every_bin():
    borrow = minhash.probes(125)
    for n in (1, 3, 40, 4000):
        own = minhash.mix(np.arange(n, dtype=np.uint64))
        out = minhash.one_permutation(own, 125, borrow)
        assert len(out) == 125 and set(out) <= set(minhash.mix(own + minhash.ODD))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16))
    near = np.concatenate([x, x[:80] + 0.05 * rng.standard_normal((80, 16)), np.repeat(x[:1], 60, 0) + 0.02 * rng.standard_normal((60, 16)), x[:5], 3 * x[5:8]]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(near)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] * 16, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, v int")
    got = {r["vec_id"]: r for r in pivots.near_vectors(frame, block=16).collect()}
    u = near.astype(np.float64) / np.linalg.norm(near.astype(np.float64), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    label = np.arange(len(u))
    for _ in range(20):
        label = np.array([label[link[i]].min() for i in range(len(u))])
    want = link.sum(1) - 1
    hits = sum(got[i]["n_links"] for i in range(len(u)))
    assert all(got[i]["n_links"] <= want[i] for i in range(len(u))) and hits >= 0.97 * want.sum()
    assert np.mean([got[i]["component_id"] == label[i] for i in range(len(u))]) > 0.97
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert pivots.near_vectors(frame.limit(0)).collect() == []


def test_vectors_that_repeat_an_id(spark):
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 16))
    rows = [(1, a), (1, b), (2, a + 0.01 * rng.standard_normal(16)), (3, b + 0.01 * rng.standard_normal(16)), (3, a), (4, b)]
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in pivots.near_vectors(frame).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 1), (4, 2, 1)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    own, rng = packing.Encoder(PATH, cache_bytes=60_000), random.Random(2)
    same = lambda t: np.frombuffer(own.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
    parts = [*"ab é,.!'\n\t  1\xa0\x1c\u3000s-𝒳", "don't", " the", "  ", "\n\n", "<|endoftext|>", "<|endof", " 's", "\x85", "\x7f", "ß", "ſ", "漢", "²", "\u200b"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert same(text), repr(text)
    assert own.spaced.held <= 30_000 + 400
    lines = [prose(rng, 4).split()[0] for _ in range(20_000)]
    assert same("\n".join(lines)) and same(" x".join(lines)) and np.frombuffer(own.encode("a<|endoftext|>"), "<u4").tolist() == [64, 50256]


def test_packing_round_trip(spark):
    rng = random.Random(4)
    rows = [(100 + i, prose(rng, rng.choice([3, 40, 300]))) for i in range(120)] + EDGE
    got = packing.pack_documents(docs(spark, rows), PATH, window=64, shard_pieces=80, with_ids=True).collect()
    own, sequences, texts = packing.Encoder(PATH), collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        texts[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    for i, t in rows:
        ids = np.frombuffer(own.encode(t), "<u4").tolist() + [1]
        if i not in (None, 4):
            parts = sorted(texts[i], key=lambda r: r["start"])
            assert [x for r in parts for x in r["ids"]] == ids and parts[0]["doc_tokens"] == len(ids)
    assert len(texts[4]) == 2
    assert sum(r["length"] for r in got) / (64 * len(sequences)) > 0.93
    assert packing.pack_documents(docs(spark, []), PATH).collect() == []


def test_subwords_are_those_of_the_tokenizer():
    rng, own = random.Random(12), packing.Encoder(PATH)
    words = ["".join(rng.choices([*"abcdefgxyz", "é", "ß", "漢", "'s", ".", "1", "\xa0", "-", "tion"], k=rng.randint(1, 9))) for _ in range(4000)] + ["a\x00b", "\u3000", "it's", "x\x85y"]
    assert all(lm.made(w.encode(), PATH) == own.ids(" " + w) for w in words)
    kept = lm.Subwords(PATH, {b"ab": 7}, (5, 50257), limit=100)
    for w in [w for w in words[:1000] if w != "ab"]:
        kept.renew()
        assert kept[w.encode()] == struct.pack("<d", 0.0) + lm.made(w.encode(), PATH)
    assert len(kept) <= 101 and kept[b"ab"][:8] == struct.pack("<d", 7.0) and kept[None] == struct.pack("<dI", 5, 50257)


def test_subwords_of_many_words_at_once():
    first, code = lm.starts_of(PATH), "abz09.,'_-\u00e9\u00a0\u2003\u4e2d\u0085\u0301\U0001f600"
    rng = random.Random(3)
    words = list({"".join(rng.choices(code, k=rng.randint(1, 9))).encode() for _ in range(4000)})
    for odd in ([], [b"\xff\xc3", b"\xe2\x82"], [b"x" * 65]):
        many = [words[:1500] + odd, [], words[1000:] + [b"\xc2\xa0"]]
        for known in (lm.Subwords(PATH), lm.Subwords(PATH, {w: k for k, w in enumerate(words)}, (5, 50257))):
            alone = lm.Subwords(PATH, known.hot, (5, 50257))
            known.meet([w for part in many for w in part], first)
            assert all(known[w] == alone[w] for part in many for w in part)
            assert odd or len(known) >= len(words)  # they were cut together
        ids, lengths = lm.text_ids(many, PATH, first)
        parts = [lm.ids_of(part, PATH, 50257)[0] for part in many]
        assert ids.tolist() == np.concatenate(parts).tolist() and lengths.tolist() == [len(p) for p in parts]


def test_repeated_rows_spread_over_shards(spark):
    got = packing.pack_documents(docs(spark, [(None, "")] * 400 + [(7, "a b c")] * 400), PATH, shard_pieces=100).collect()
    shards = collections.Counter(r["sequence_id"] >> 32 for r in got)
    assert len(got) == 800 and len(shards) == 8 and max(shards.values()) < 160


def test_best_fit_takes_the_tightest():
    placed = packing.best_fit_decreasing([6, 5, 4, 3, 2, 10], 10)
    assert placed[5] == (0, 0) and placed[0][0] == placed[2][0] and placed[1][0] == placed[3][0] == placed[4][0]
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [(c, k) for k, c in enumerate(bins) if c >= n]
        if fit:
            bins[min(fit)[1]] -= n
        else:
            bins.append(100 - n)
    assert len({s for s, _ in packing.best_fit_decreasing(lengths, 100)}) == len(bins)


def all_maximal(scores, at=0):
    """The best segment, and those of what lies before and after it."""
    best = max(((sum(scores[i : j + 1]), -i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0, 0, 0))
    total, i, j = best[0], -best[1], best[2]
    if total <= 0:
        return []
    return [*all_maximal(scores[:i], at), (at + i, at + j, total), *all_maximal(scores[j + 1 :], at + j + 1)]


def test_all_segments_and_the_score_against_brute_force():
    rng = random.Random(16)
    words = [f"w{k}" for k in range(30)]
    model = toxicity.ToxicModel({w: rng.uniform(-2, 3) for w in words[:20]}, {}, toxicity.DRIFT, 0.8, 0.3, 1.7, -2.0)
    for _ in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 45))]
        want = all_maximal([model.of(w) for w in text])
        score, found, n = toxicity.score_text(" ".join(text), model)
        assert n == len(text) and [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in found], [s for *_, s in want])
        shift = np.log(0.3) + 0.5 * np.log(max(n, 1))
        values = sorted((max(0.0, 0.8 * s - shift) for *_, s in want), reverse=True) or [0.0]
        assert abs(score - 1 / (1 + np.exp(-(1.7 * (values[0] + 0.25 * sum(values[1:])) - 2.0)))) < 1e-9


def test_every_passage_counts():
    model = toxicity.ToxicModel({"bad": 3.0}, {}, toxicity.DRIFT, 1.0, 0.01, 1.0, -30.0)
    passage = "bad " + "fine " * 20
    assert toxicity.score_text(passage * 9, model)[0] < toxicity.score_text(passage * 12, model)[0] < toxicity.score_text(passage * 40, model)[0]


def test_segments_against_quadratic_search():
    rng = random.Random(6)
    for _ in range(200):
        scores = [rng.choice([-0.5, -0.5, -0.5, 1.0, 2.5, -2.0]) for _ in range(rng.randrange(1, 40))]
        found = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.5], -0.5)
        best = max((sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))), default=0)
        if best > 0:
            assert abs(max(s for _, _, s in found) - best) < 1e-9
        assert all(abs(sum(scores[a : b + 1]) - s) < 1e-9 for a, b, s in found)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def labelled(rng):
    rows = []
    for i in range(600):
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        text = prose(rng, 120)
        if toxic:
            text += " grokk snarf " + prose(rng, 20)
        if not good:
            text = " ".join(w + "!!" for w in text.upper().split())
        rows.append((100 + i, text, toxic, good))
    return rows


def test_classifiers_on_held_out_rows(spark):
    rows = labelled(random.Random(8))
    frame = docs(spark, [(i, t) for i, t, _, _ in rows] + EDGE)
    labels = spark.createDataFrame([(i, q, t) for i, _, t, q in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    toxic = {r["doc_id"]: r for r in toxicity.find_passages(frame, toxicity.train(frame, labels)).collect()}
    good_model = quality.train(frame, labels)
    good = {r["doc_id"]: r for r in quality.score_quality(frame, good_model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 15 in (0, 10)]
    assert held and np.mean([toxic[i]["predicted"] == t for i, _, t, _ in held]) > 0.95 and np.mean([good[i]["predicted"] == q for i, _, _, q in held]) > 0.95
    for found in (toxic, good):
        assert all(0 <= found[i]["score"] <= 1 for i in (None, 1, 2, 3, 4, 5, 6))
    kept = quality.keep_good(frame, good_model)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] for r in quality.score_quality(frame, good_model).collect())
    model = toxicity.train(frame, labels)
    assert toxicity.remove_toxic(frame, model).count() == sum(1 - r["predicted"] for r in toxicity.find_passages(frame, model).collect())
    none = labels.limit(0)
    assert toxicity.find_passages(frame, toxicity.train(frame, none)).count() == frame.count() == quality.score_quality(frame, quality.train(frame, none)).count()
    assert toxicity.find_passages(docs(spark, []), model).collect() == quality.score_quality(docs(spark, []), good_model).collect() == []


def test_compiled_score_equals_the_rules(spark):
    rng = random.Random(14)
    texts = [(100 + i, prose(rng, rng.choice([4, 30, 90])).upper() if i % 3 else prose(rng, 40) + " 12 34! a\nb") for i in range(250)] + EDGE
    frame = docs(spark, texts)
    rows = quality.with_statistics(frame, "text").select("doc_id", "text", *[f"_s_{n}" for n in quality.STATISTICS], quality.compile_score(quality.RuleModel(0.25)).alias("flat")).collect()
    x = np.array([[r[f"_s_{n}"] for n in quality.STATISTICS] for r in rows])
    words = [(r["text"] or "").split() for r in rows]
    plain = [i for i, r in enumerate(rows) if r["text"] and r["text"].isascii() and "\x0b" not in r["text"]]
    at = {n: j for j, n in enumerate(quality.STATISTICS)}
    assert all(x[i, at["n_words"]] == len(words[i]) and x[i, at["distinct_words"]] == (len(set(words[i])) / len(words[i]) if words[i] else 0) for i in plain)
    model = quality.fit(x[:200], np.array([i % 3 > 0 for i in range(200)], float), trees=8)
    assert model.rules
    z = model.intercept + sum(r.weight * quality.holds(r, x, at) for r in model.rules)
    got = quality.score_quality(frame, model).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert np.allclose([r["score"] for r in got], 1 / (1 + np.exp(-z)), atol=1e-12) and [r["predicted"] for r in got] == [int(v >= 0) for v in z]
    assert all(abs(r["flat"] - 1 / (1 + np.exp(-0.25))) < 1e-12 for r in rows)


def test_lasso_drops_useless_rules():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] > 0.6).astype(float)
    model = quality.fit(x, y, names=("a", "b", "c"), trees=10, penalty=5e-3)
    assert model.rules and sum(abs(r.weight) for r in model.rules if r.terms[0][0] == "a") > 0.9 * sum(abs(r.weight) for r in model.rules)


def small_model(rng, n=41, **sizes):
    """A model of n - 1 subwords, every third of which begins a word, with random weights."""
    counts = rng.integers(1, 50, n).astype(float)
    at = np.unique(rng.integers(0, n * n, 300))
    before, after = at // n - 1, np.minimum(at % n, n - 2)
    _, one = np.unique(before * n + after, return_index=True)
    first = np.arange(n) % 3 == 0
    first[-1] = True
    model = attention_lm.start(counts, first, (before[one], after[one], rng.integers(1, 9, len(one)).astype(float)), width=4, block=4, **sizes)
    model.params = {k: v.astype(np.float64) + 0.3 * rng.standard_normal(v.shape) for k, v in model.params.items()}
    return model


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    model = small_model(rng, n_classes=8, own=20)
    texts = [np.r_[rng.integers(0, 40, n), 40] for n in (1, 7, 30)]
    x, first, y, _ = attention_lm.blocks_of(texts, model, 4)
    _, grads = attention_lm.gradients(model, x, first, y)
    assert grads.keys() == model.params.keys()
    for name, g in grads.items():
        p = model.params[name]
        for at in [np.unravel_index(int(i), p.shape) for i in rng.integers(0, p.size, 6)]:
            old = p[at]
            p[at] = old + 1e-5
            up = attention_lm.gradients(model, x, first, y)[0]
            p[at] = old - 1e-5
            down = attention_lm.gradients(model, x, first, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 2e-3


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    model = small_model(rng, 31, n_classes=8, own=12)
    for begin in (np.array([], int), np.array([3, 4]), np.array([3, 1, 9, 0, 17, 6, 2, 5, 8])):
        logs = [attention_lm.score(model, [np.r_[begin, i]], block=4) for i in range(31)]
        assert abs(sum(np.exp(own[-1]) for own, _ in logs) - 1) < 1e-5
        opens = sum(np.exp(own[-1]) for i, (own, _) in enumerate(logs) if i % 3 == 0)  # 30 is the end
        assert all(abs(np.exp(edge[-1]) - opens) < 1e-5 for _, edge in logs)
    texts = [np.r_[rng.integers(0, 30, n), 30] for n in (0, 3, 4, 5, 21)]
    together = attention_lm.score(model, texts, portion=2, group=4, block=4)
    apart = [attention_lm.score(model, [t], block=4) for t in texts]
    assert all(np.allclose(together[k], np.concatenate([a[k] for a in apart])) for k in (0, 1))


def place_by_place(model, text, block):
    """Log probability of each subword of a text, one place and one context position after the other, in plain loops."""
    p, start = model.params, len(model.params["q"]) - 1
    seen, out = [start, *(int(model.place[i]) for i in text)], []
    for t, target in enumerate(text):
        low = max(0, (t // block - 1) * block)
        heat = [p["q"][seen[t]] @ p["k"][seen[j]] / np.sqrt(p["q"].shape[1]) + p["near"][t - j] for j in range(low, t + 1)]
        share = np.exp(np.array(heat) - max(heat))
        share /= share.sum()
        state = np.tanh(sum(a * p["v"][seen[low + j]] for j, a in enumerate(share)) @ p["mix"] + p["u"][seen[t]])
        logits = state @ p["out"] + p["bias"]
        log = logits[model.kind[target]] - np.log(np.exp(logits).sum())
        at, mates = model.place[target], [m for m in range(model.own) if model.kind[list(model.place).index(m)] == model.kind[target]]
        before = model.own if model.first[target] else seen[t] if seen[t] < model.own else model.own + 1
        if at < model.own and len(mates) > 1:
            inner = {m: model.pairs[before, m] + state @ p["sub"][m] for m in mates}
            log += inner[at] - np.log(sum(np.exp(v) for v in inner.values()))
        else:
            log += model.pairs[before, at] if at < model.own else model.inside[target]
        out.append(log)
    return out


def test_score_against_a_forward_pass_in_loops():
    rng = np.random.default_rng(11)
    model = small_model(rng, 31, n_classes=8, own=14)
    texts = [np.r_[rng.integers(0, 30, n), 30] for n in (0, 1, 4, 9, 26)]
    got, _ = attention_lm.score(model, texts, portion=2, group=4, block=4)
    assert np.allclose(got, np.concatenate([place_by_place(model, t, 4) for t in texts]), atol=1e-5)


def test_mixture_weight_by_ratios(spark, monkeypatch):
    """The weight from counted ratios is that of expectation maximisation word by word, whichever words travel with the tasks."""
    rng = random.Random(4)
    words = ["".join(rng.choices(["ba", "do", "ki"], k=rng.randint(1, 4))) for _ in range(80)]
    rows = docs(spark, [(i, " ".join(rng.choices(words, k=30))) for i in range(40)] + [(90, None), (91, "once-only")])
    texts = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = lm.count_words(texts)
    held = {r["word"] and bytes(r["word"]): r["c"] for r in counts.collect()}

    def fixed(scorer, many):
        flat = [w for t in many for w in (*t, None)]
        return flat, np.array([42.0 if w is None else scorer.hot.get(w, 0) for w in flat]), np.array([-3.0 - len(w or b"") / 4 for w in flat])

    monkeypatch.setattr(lm, "word_logs", fixed)
    many = [lm.words_of(bytes(r["text"])) for r in texts.collect()]
    tokens, weight = sum(held.values()), 0.5
    pairs = [((held[w] - (t.count(w) if w else 1)) / tokens, np.exp(-3.0 - len(w or b"") / 4)) for t in many for w in (*t, None)]
    for _ in range(12):
        weight = float(np.clip(np.mean([weight * p / (weight * p + (1 - weight) * q) for p, q in pairs]), 0.01, 0.99))
    for hot in (0, 20, 200):
        kept = dict(sorted(((w, c) for w, c in held.items() if w), key=lambda x: -x[1])[:hot])
        told = lm.mixture_ratios(lm.Scorer(None, kept, 42, tokens, len(held), 0.5, ""), texts, counts).collect()
        assert sum(r["n"] for r in told) == tokens and abs(lm.mixture_weight([(r["ratio"], r["n"]) for r in told]) - weight) < 0.005
    assert lm.mixture_weight([]) == 0.5


def test_scores_of_all_words_sum_to_one(monkeypatch):
    """Subwords 0, 3 and 6 begin words, 9 is the end. Words of up to four subwords, the end, and what goes on after four
    subwords have probability 1 together, by the attention model and in the mixture."""
    model = small_model(np.random.default_rng(6), 10, n_classes=6, own=6)
    grown, code = [(0,), (3,), (6,)], {}
    for _ in range(4):
        code |= {bytes(w): w for w in grown}
        grown = [(*w, r) for w in grown for r in range(9) if r % 3]
    real = attention_lm.score_ids
    monkeypatch.setattr(attention_lm, "score_ids", lambda m, ids, n, block=4: real(m, ids, n, block=block))
    hot = {w: k % 7 for k, w in enumerate(code)}
    scorer = lm.Scorer(model, {w: c for w, c in hot.items() if c}, 11, sum(hot.values()) + 11, 0, 0.3, "")
    known = {None: struct.pack("<dI", 11, 9)} | {w: struct.pack("<d", hot[w]) + np.array(ids, "<u4").tobytes() for w, ids in code.items()}
    monkeypatch.setattr(lm.Scorer, "known", lambda self: known)
    lead = [bytes((3, 1)), bytes((0, 2, 4))]
    flat, _, logs = lm.word_logs(scorer, [[*lead, w] for w in code])
    assert flat[2::4] == list(code)
    own = np.exp(logs[2::4])
    end = np.exp(lm.word_logs(scorer, [lead])[2][2])
    closes = [np.exp(attention_lm.score(model, [np.array([3, 1, 0, 2, 4, *w, 9])], block=4)[1][-1]) for w in code.values()]
    longer = sum(p * (1 / c - 1) for p, c, w in zip(own, closes, code.values(), strict=True) if len(w) == 4)
    assert abs(own.sum() + end + longer - 1) < 1e-5 and longer < 0.9
    batch = lm.score_batch(scorer, 0, pa.array([1, 2, 3]), [b" ".join(lead), None, b""])
    told = lm.word_logs(scorer, [lead, []])[2]
    mixed = lambda c, p: np.log10(0.3 * c / scorer.tokens + 0.7 * np.exp(p))
    cold = sum(hot[w] == 0 for w in lead)
    want = sum(mixed(hot[w], p) for w, p in zip(lead, told, strict=False) if hot[w]) + mixed(11, told[2])
    assert abs(batch.column(5)[0].as_py() - want) < 1e-6 and abs(batch.column(5)[2].as_py() - mixed(11, told[3])) < 1e-6 and len(batch.column(6)[0]) == cold


def test_runs_cover_the_text():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in range(500)).encode()
    whole, seen = text.split(), set()
    for words, before, ends in lm.runs_of(text, 1.0, rng):
        at = whole.index(words[0])
        assert whole[at : at + len(words)] == words and before == (at > 0 or len(text) < 90) and ends == (words[-1] == whole[-1])
        seen.update(words)
    assert len(seen) == 500 and list(lm.runs_of(b"", 1.0, rng)) == [([], False, True)]


def test_lm_base_is_exact(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices(["ba", "do", "ki", "lu"], k=rng.randint(1, 7))) for _ in range(2000)]
    rows = [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 80)))) for i in range(300)] + [e for e in EDGE if e[0] != 4] + [(900, "unseen-word-x")]
    train = F.coalesce(F.col("doc_id") % 5 != 2, F.lit(True))
    got = lm.lm_scores(docs(spark, rows), train, PATH, hot_words=20, steps=60).collect()
    counts, n = collections.Counter(), 0
    for i, t in rows:
        if i is None or i % 5 != 2:
            counts.update(lm.words_of((t or "").encode()))
            n += 1
    total, distinct = sum(counts.values()) + n, len(counts) + 1
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, t in rows:
        w, r = lm.words_of((t or "").encode()), by_id[i]
        base = sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in w) + np.log10((n + 1) / (total + distinct + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert abs(r["base_score"] - base) < 1e-9 * abs(base) + 1e-9 and r["score"] < 0


def test_lm_score_counts_every_word(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices(["ba", "do", "ki", "lu"], k=rng.randint(1, 5))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(120)]
    few, all_hot = (
        {r["doc_id"]: r["score"] for r in lm.lm_scores(docs(spark, rows), F.col("doc_id") % 5 != 2, PATH, hot_words=n, steps=20).collect()} for n in (10, 100_000)
    )
    assert len(few) == 120 and all(abs(few[i] - all_hot[i]) < 1e-6 * abs(all_hot[i]) for i in few)


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    """The weights are trained on all blocks of all training texts, and the mixture is set on all their words, however few are drawn to begin with."""
    for name in ("WARM_BLOCKS", "LEAST_BLOCKS", "MIXTURE_DOCS"):
        monkeypatch.setattr(lm, name, 8, raising=False)
    rng, seen, real = random.Random(8), {}, lm.Scratch.write
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice((0, 3, 40, 200))))) for i in range(240)] + [(1000, None)]

    def write(self, df, name):
        out = real(self, df, name)
        if name in ("weights", "ratios"):
            seen[name] = out.agg(F.sum("n")).first()[0]
        return out

    monkeypatch.setattr(lm.Scratch, "write", write)
    assert lm.lm_scores(docs(spark, rows), F.col("doc_id") % 5 != 2, PATH, hot_words=50, steps=5).count() == 241
    many = [lm.words_of((t or "").encode()) for i, t in rows if i % 5 != 2]
    assert seen["weights"] == sum(-(-len(lm.ids_of(words, PATH, 0)[0]) // attention_lm.BLOCK) for words in many)
    assert seen["ratios"] == sum(len(words) + 1 for words in many)


def test_training_goes_over_all_blocks_before_any_comes_again(monkeypatch):
    seen = []
    monkeypatch.setattr(attention_lm, "gradients", lambda model, x, first, y: (seen.append(y[:, 0].tolist()), (0.0, {k: np.zeros_like(v) for k, v in model.params.items()}))[1])
    y = np.arange(44 * 4).reshape(44, 4)
    attention_lm.train(small_model(np.random.default_rng(2), n_classes=8, own=20), (np.zeros((44, 8), int), np.zeros(44, bool), y), steps=6, batch=16)
    assert [len(s) for s in seen] == [16, 16, 12] * 2
    assert sorted(sum(seen[:3], [])) == sorted(sum(seen[3:], [])) == y[:, 0].tolist()


def test_training_steps_are_those_of_adam_and_touch_the_rows_of_their_blocks_alone(monkeypatch):
    rng = np.random.default_rng(12)
    model = small_model(rng, n_classes=8, own=20)
    x, first, y, _ = attention_lm.blocks_of([np.r_[rng.integers(0, 40, 14), 40] for _ in range(10)], model, 4)
    plain = attention_lm.copy_of(model)
    mean, square = ({k: np.zeros_like(v) for k, v in plain.params.items()} for _ in range(2))
    order, at, seed = np.zeros(0, int), 0, np.random.default_rng(attention_lm.SEED)
    for t in range(1, 91):
        if at >= len(order):
            order, at = seed.permutation(len(x)), 0
        pick, at = order[at : at + 3], at + 3
        _, grads = attention_lm.gradients(plain, x[pick], first[pick], y[pick])
        rate = 1e-2 * min(1, t / 50) * (0.02 + 0.98 * (0.5 + 0.5 * np.cos(np.pi * t / 90)))
        for k, g in grads.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.02 * (g * g - square[k])
            plain.params[k] = plain.params[k] - rate * mean[k] / (1 - 0.9**t) / (np.sqrt(square[k] / (1 - 0.98**t)) + 1e-9)
    real, held = attention_lm.gradients, []

    def told(part, x, first, y):
        held.append((len(part.params["q"]), len(np.unique(x))))
        return real(part, x, first, y)

    monkeypatch.setattr(attention_lm, "gradients", told)
    attention_lm.train(model, (x, first, y), steps=90, batch=3)
    assert len(held) == 90 and all(rows == used for rows, used in held)
    assert all(np.abs(model.params[k] - plain.params[k]).max() < 1e-3 for k in plain.params)


def test_one_row_of_weights_reaches_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rows, rng = [], random.Random(4)
    for name in ("collect", "toArrow"):
        real = getattr(DataFrame, name)

        def told(df, real=real):
            found = real(df)
            if "weights" in df.columns:
                rows.append(len(found))
            return found

        monkeypatch.setattr(DataFrame, name, told)
    monkeypatch.setattr(lm, "WARM_BLOCKS", 8)
    texts = docs(spark, [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(12))) for i in range(60)]).repartition(12)
    assert lm.lm_scores(texts, F.col("doc_id") % 5 != 2, PATH, hot_words=10, steps=2).count() == 60
    assert rows == [1]


def test_lm_goes_over_each_text_once_with_what_it_learned(spark, monkeypatch):
    """Neither the weight of the mixture nor the words whose counts are joined take the model over a text again."""
    told = spark.sparkContext.accumulator(0)

    def counted(scorer, many):
        told.add(len(many))
        flat = [w for t in many for w in (*t, None)]
        return flat, np.array([40.0 if w is None else scorer.hot.get(w, 0) for w in flat]), np.array([-3.0 - len(w or b"") / 4 for w in flat])

    monkeypatch.setattr(lm, "word_logs", counted)
    monkeypatch.setattr(lm, "WARM_BLOCKS", 8)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(12))) for i in range(50)]
    got = lm.lm_scores(docs(spark, rows), F.col("doc_id") % 5 != 2, PATH, hot_words=10, steps=2).collect()
    assert len(got) == 50 and told.value == 50


def test_lm_beats_the_base_on_held_out_documents(spark):
    held = QUERIES["op3_attention_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(held) > 100 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_warc_round_trip(spark, tmp_path):
    html = ["x" * 99, "x" * 99, "long " * 40, "long " * 40, "é" * 60, "é" * 60, None, "", "WARC/1.1\r\n\r\n" * 20, "long " * 40]
    rows = [(10 - i, None if i == 4 else f"https://h.example/{i}\r\nX: y", h, "c") for i, h in enumerate(html)] + [(1, "u", "long " * 40, "c"), (None, "u", "long " * 40, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    warc.write_warc(pages, str(tmp_path / "w"), file_captures=3)
    records = warc.read_warc(spark, str(tmp_path / "w"))
    got = warc.assemble(records).collect()
    assert len(got) == len(rows) and all(len(r["metadata"]) == 1 and r["request"]["type"] == "request" for r in got)
    least = {}
    for p, _, h, _ in rows:
        if p is not None and h and len(h.encode()) >= 100:
            least[h] = min(p, least.get(h, p))
    by_page = collections.defaultdict(list)
    for r in got:
        by_page[r["capture_id"].split(":")[2]].append(r["response"])
    for p, _, h, _ in rows:
        for a in by_page[str(p) if p is not None else "null"]:
            payload = (h or "").encode()
            assert (a["payload_bytes"], a["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
            first = least.get(h)
            assert a["type"] == ("response" if first in (None, p) else "revisit")
            assert first in (None, p) or a["refers_to"] == f"<{warc.URN}{first}:0:response>"
            assert a["type"] == "revisit" or bytes(a["block"]).partition(b"\r\n\r\n")[2] == payload
    warc.write_warc(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_warc(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort"))


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title></head><body><header>Site name here</header><nav><ul><li><a href='/'>Home page</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies on this site for you</div><main><article><h1>Title</h1><p>One &amp; two&nbsp;three <b>fo</b>ur.<p>Short."
    "<aside>promoted text stands here</aside><form><label>Your name</label><input></form><script>if (a<b) document.write('<p>no</p>')</script>"
    "<ul><li>item a<li>item b</ul><section id='comments'><p>First comment by a reader, long enough to count</section></article></main><footer>Foot</footer>"
)


def test_main_text(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "plain &lt;text&gt; <i>here</i>", "t"), (4, "u", "<div>" * 5000 + "deep", "t"), (None, "u", "<p>a<p>b c", "t")], "page_id long, url string, html string, text string")
    for weights in (html_text.Weights(), html_text.learn([(PAGE, "Title One & two three four. Short. item a item b")] * 30)):
        got = [(r["text"], r["n_chars"]) for r in html_text.extract_main_text(pages, weights).collect()]
        texts = ["Title\nOne & two three four.\nShort.\nitem a\nitem b", "", "", "plain <text> here", "deep", "a\nb c"]
        assert got == [(t, len(t)) for t in texts]
    assert html_text.extract_main_text(pages.limit(0), html_text.Weights()).collect() == []


def test_best_run_against_quadratic_search():
    rng = random.Random(12)
    for _ in range(400):
        scores = [rng.choice([-3.0, -1.0, -0.5, 0.0, 1.0, 2.0]) for _ in range(rng.randrange(0, 30))]
        sums = {(i, j): sum(scores[i : j + 1]) for i in range(len(scores)) for j in range(i, len(scores))}
        best, got = max(sums.values(), default=0), html_text.best_run(scores)
        assert (got is None) if best <= 0 else (abs(sums[got] - best) < 1e-9 and scores[got[0]] > 0 < scores[got[1]])


#: Furniture without any name that tells it: only the scores of words and tags set the borders.
UNNAMED = (
    "<div><a href=/>Home</a> <a href=/n>News here</a> <a href=/c>Contact</a></div><div><div>Est. 1999</div></div>"
    "<div class='search-results-and-comment-guide'><h2>How it works</h2><p>The first part of a long and quiet text with a <a href=/x>link</a> in it.</p>"
    "<div id='notice-board-history'><p>The second part, on the history of the notice board, is long too and stays.</p></div>"
    "<p title='%s > x'>The last part has an attribute of any length.</p></div><div><a href=/1>One more</a></div><div><a href=/2>Another one</a></div>"
) % ("y" * 30_000)


def test_the_scan_sets_the_borders(monkeypatch):
    want = "How it works\nThe first part of a long and quiet text with a link in it.\nThe second part, on the history of the notice board, is long too and stays.\nThe last part has an attribute of any length."
    weights = html_text.learn([(PAGE, "Title One & two three four. Short. item a item b")] * 30)
    for w in (html_text.Weights(), weights):
        assert html_text.main_text(UNNAMED, w) == want
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores) - 1))
    assert html_text.main_text(UNNAMED, weights) != want and html_text.main_text(PAGE, weights).startswith("Site name here")


def test_labelled_pages_outweigh_the_names():
    page = "<body><div class='widget'><p>%s</p></div><div class='zzz'>%s</div><div class='promo'>buy it</div></body>"
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    weights = html_text.learn([(page % (text(k), "only here today"), text(k)) for k in range(40)])
    assert html_text.main_text(page % (text(99), "and not here"), weights) == text(99)
    lead = "<article><header><h1>Head</h1><p class='intro'>A lead paragraph.</p></header><p>Body text.</p><div class='ad'>Buy now</div><p>End.</p><footer>By line</footer></article>"
    assert html_text.main_text(lead, html_text.Weights()) == "Head\nA lead paragraph.\nBody text.\nEnd."


def test_leaks(spark):
    item = "A farmer named John has 12 apples and 3.5 kg of pears, how many apples does John sell to Mary after 2 hours?"
    other = item.replace("John", "Peter").replace("12", "99").replace("3.5 kg", "7lb").replace("Mary", "Anna").replace("2 hours", "5 days")
    texts = [(10, "Intro. " + item + " More text."), (11, other), (12, other.replace("does Peter", "does Olaf")), (13, "A clean text about 12 apples."), (14, item.upper()), *EDGE]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "too short", "x"), (None, "", "x")], "item_id long, text string, h string")
    for most in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, saved = most, decontaminate.BROADCAST_WINDOWS
        got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
        decontaminate.BROADCAST_WINDOWS = saved
        assert {k: v for k, v in got.items() if k[0] != 14} == {(10, 1): True, (11, 1): False}
    kept = decontaminate.remove_leaks(docs(spark, texts), bench)
    assert kept.columns == docs(spark, []).columns and {10, 11}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.where("doc_id IS NULL").count() == 1
    assert decontaminate.find_leaks(docs(spark, []), bench).collect() == decontaminate.find_leaks(docs(spark, texts), bench.limit(0)).collect() == []


def openers_of(items):
    """Words that begin a sentence in some item and are written small in some item."""
    marks = regex.compile(r"(?<=[\p{Ll}\p{N},;]\s)\p{Lu}\p{L}+")
    first = {w.lower() for t in items for w in regex.findall(r"(?<!\p{L})\p{Lu}\p{Ll}+(?!\p{L})", marks.sub("", t))}
    return first & {w for t in items for w in regex.findall(r"(?<!\p{L})\p{Ll}+(?!\p{L})", t)}


def templates(text, openers=()):
    """Words and template words of a text, one after the other, as the docstring of decontaminate.with_templates says."""
    text = regex.sub(r"(?<=[0-9])[.,:/](?=[0-9])", "", text)
    text = regex.sub(r"(?<=[0-9])(?=\p{L})", " ", text)
    named = regex.sub(r"(?<=[\p{Ll}\p{N},;]\s)\p{Lu}\p{L}+", decontaminate.NAME, text)
    named = regex.sub(r"(?<!\p{L})\p{Lu}\p{Ll}+(?!\p{L})", lambda m: m.group() if m.group().lower() in openers else decontaminate.NAME, named)
    clean = lambda t: regex.sub(rf"[^\p{{L}}\p{{N}}{decontaminate.NUMBER}-{decontaminate.UNIT}]+", " ", t.lower()).split()
    raw, template = clean(text), [decontaminate.NUMBER if regex.fullmatch(r"\p{N}+", w) else w for w in clean(named)]
    for k in range(1, len(template)):
        if template[k - 1] == decontaminate.NUMBER and template[k] in decontaminate.UNITS:
            template[k] = decontaminate.UNIT
    return raw, template


def brute_leak(doc, item, openers=(), size=5):
    """(coverage, whether values fit, verbatim) of an item in a whole document; None for an item without windows."""
    (draw, dt), (iraw, it) = templates(doc, openers), templates(item, openers)
    marks = {decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT}
    own = [p for p in range(len(it) - size + 1) if sum(w not in marks for w in it[p : p + size]) >= 2]
    if not own:
        return None
    met = [(p, q) for p in own for q in range(len(dt) - size + 1) if dt[q : q + size] == it[p : p + size]]
    cover = lambda places: len({p + k for p in places for k in range(size)})
    slots = {(iraw[p + k], draw[q + k]) for p, q in met for k in range(size) if it[p + k] in marks}
    same = {a for a, b in slots if a == b}
    other = {(a, b) for a, b in slots if a != b and a not in same}
    return cover({p for p, _ in met}) / cover(own), len({a for a, _ in other}) == len(other), not other


def test_leaks_against_brute_force(spark):
    rng = random.Random(21)
    names, units = ["John", "Mary", "Olaf", "Anna"], ["kg", "miles", "hours", "dollars"]
    word = lambda: rng.choice(["the", "farmer", "sold", "bought", "apples", "pears", "red", "old", "market", "boat", "train", "then", "went", "home", "again", "many"])

    def sentence(n):
        out = [word() for _ in range(n)]
        for _ in range(n // 6):
            out[rng.randrange(1, n)] = rng.choice([str(rng.randint(2, 99)), rng.choice(names), f"{rng.randint(2, 99)} {rng.choice(units)}"])
        return " ".join(out)

    items = [sentence(rng.randint(6, 22)) for _ in range(12)]
    texts = []
    for k in range(90):
        item = rng.choice(items)
        if k % 3 == 1:
            item = regex.sub(r"[0-9]+", lambda m: str(int(m.group()) + 100 + k), item)
        if k % 5 == 2:
            item = " ".join(w if rng.random() > 0.15 else word() for w in item.split())
        texts.append((k, f"{sentence(30)}. {item if k % 7 else ''} . {sentence(20)}"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    hits, openers = 0, openers_of(items)
    for i, text in texts:
        for j, item in enumerate(items):
            found = brute_leak(text, item, openers)
            if found is None or found[0] >= 0.8 and not found[1]:
                continue  # found by its own words, or occurrence by occurrence
            assert ((i, j) in got) == (found[0] >= 0.8)
            if (i, j) in got:
                hits += 1
                assert abs(got[i, j]["coverage"] - found[0]) < 1e-9 and got[i, j]["verbatim"] == found[2]
    assert hits > 30


def test_leaks_with_names_that_begin_sentences(spark):
    """Items of several sentences, some of which a name begins; documents change names and numbers, alike or not."""
    rng = random.Random(8)
    names, verbs, things = ["Tom", "Ann", "Olaf", "Mary", "Ida", "Jack", "Ruth"], ["buys", "sells", "paints", "finds", "takes"], ["pens", "red boats", "old books", "apples", "green chairs"]

    def item():
        who = rng.choice(names)
        told = [f"{rng.choice([who, 'Then ' + who, 'The farmer'])} {rng.choice(verbs)} {rng.randint(2, 90)} {rng.choice(things)} {rng.choice(['at the market', 'and then goes home', 'for the school'])}" for _ in range(4)]
        return ". ".join(told) + f". {who} has how many of each now?"

    def other(text, alike):
        turn = dict(zip(names, rng.sample(names, len(names)), strict=True))
        text = regex.sub(r"[0-9]+", lambda m: str(int(m.group()) + 100), text)
        return regex.sub("|".join(names), lambda m: turn[m.group()] if alike else rng.choice(names), text)

    items = [item() for _ in range(10)] + ["Tom buys 4 pens. Tom pays 8 dollars for the pens. Tom then sells 2 pens. Tom has how many pens?"]
    openers = openers_of(items)
    assert sorted(openers) == ["the", "then"]
    texts = [(k, f"Some words go here. {[items[k % 11], other(items[k % 11], True), other(items[k % 11], False), item()][k % 4]} More words.") for k in range(88)]
    texts.append((99, "Jack buys 7 pens. Jack pays 9 dollars for the pens. Jack then sells 5 pens. Jack has how many pens?"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(decontaminate.sentence_openers(bench.selectExpr("text AS _text"))) == sorted(openers)
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    for i, text in texts:
        for j, one in enumerate(items):
            found = brute_leak(text, one, openers)
            if found[0] >= 0.8 and not found[1]:
                continue  # occurrence by occurrence
            assert ((i, j) in got) == (found[0] >= 0.8)
            if (i, j) in got:
                assert abs(got[i, j]["coverage"] - found[0]) < 1e-9 and got[i, j]["verbatim"] == found[2]
    assert (99, 10) in got and all((i, i % 11) in got for i in range(88) if i % 4 < 2)


def test_leaks_of_short_items(spark):
    bench = spark.createDataFrame([(1, "Where is Paris?"), (2, "12 34 56 78 90 11"), (3, "yes"), (4, ""), (None, "one two three four")], "item_id long, text string")
    texts = [(10, "Tell me: where is paris, now?"), (11, "where is London"), (12, "x 12 34 56 78 90 11 y"), (13, "x 12 34 56 78 91 11 y"), (14, "oh yes"), (15, "One, two three four five"), (16, "")]
    for most in (decontaminate.BROADCAST_WINDOWS, 0):
        decontaminate.BROADCAST_WINDOWS, saved = most, decontaminate.BROADCAST_WINDOWS
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
        decontaminate.BROADCAST_WINDOWS = saved
        assert got == {(10, 1), (12, 2), (14, 3), (15, None)}
    assert {r["doc_id"] for r in decontaminate.remove_leaks(docs(spark, texts), bench).collect()} == {11, 13, 14, 16}


def test_leaks_of_several_variants_in_one_document(spark):
    item = "the farmer sold 12 baskets of apples and then he bought 30 chickens at the old market for 45 dollars before going home again"
    first = item.replace("12", "17").replace("30", "81").replace("45", "99")
    second = item.replace("12", "23").replace("30", "64").replace("45", "77")
    broken = item.replace("12", "23").replace("then he", "then quite happily he")
    clash = "a clerk sold 5 pens . the farmer sold 88 baskets of apples and left"
    texts = [(1, f"{first}. some other words in between. {second}."), (2, f"{first}. {'many more words here ' * 50}{clash}"), (3, "nothing of the kind is here"), (4, f"{broken}. and now {second}."), (5, clash)]
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    assert got.keys() == {(1, 7), (2, 7), (4, 7)} and all(r["coverage"] >= 0.8 for r in got.values()) and not any(got[i, 7]["verbatim"] for i in (1, 2))


def test_url_rules_and_reputation(spark):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]
    urls = ["http://a.example.com/en/1", "HTTPS://WWW.Example.com/en/x?q", "http://x.com", "http://x.com/", "http://notexample.com/en/", "http://s.net/es/1", "http://bad.org/1", "http://ok.org/2", None, "nothing", "x://"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    seen = spark.createDataFrame([("http://bad.org/a", 1)] * 60 + [("http://ok.org/a", 0)] * 300 + [("http://ok.org/b", None), (None, 1)], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, seen, rules).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("x.com", "", None, "allow") and got[3][2] == "com/" and got[4][2] == "com/" and got[5][3] == "block"
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "allow") and got[8][:2] == got[9][:2] == got[10][:2] == ("", "")
    assert {r["verdict"] for r in url_filter.judge_urls(pages.where("page_id > 5"), seen.limit(0), rules).collect()} == {"allow"}
