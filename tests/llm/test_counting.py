"""Collocations, certified packing and set algebra against brute force, and on odd rows."""

from __future__ import annotations

import collections
import datetime
import itertools
import random
import re
from array import array

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curalens.llm import collocations, quality, repacking, set_sketch

WORDS = public_tokenizers.path("word_bpe_49k.json")


def brute_collocations(rows, most=3, least=3, cover=50, top=40):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, most + 1):
                counts[lang].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if " " in p and a >= least}
        kept = []
        for p, a in cands.items():
            w = p.split(" ")
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if not any(f" {p} " in f" {q} " and len(q.split(" ")) > len(w) and 100 * b >= cover * a for q, b in cands.items()):
                kept.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])], score))
        out += [(lang, i + 1, *r[3:7], totals[lang], r[7]) for i, r in enumerate(sorted(kept)[:top])]
    return sorted(out)


def test_collocations_against_brute_force(spark):
    rng = random.Random(2)
    vocab = ["new", "York", "the", "of", "é", "a b", "x\x1fy", "ñ"]
    rows = [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " . , "), ("xx", "new york")] + [("en", "New York the of")] * 9
    df = spark.createDataFrame([(lang, t, "x", 1) for lang, t in rows], "lang string, text string, phrase string, n int")
    for most in (2, 3, 4):
        got = collocations.collocations(df, most_words=most, least_count=3, top=40).collect()
        want = brute_collocations(rows, most)
        assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == want and len(want) > 40
    assert collocations.collocations(df.limit(0)).count() == 0


def test_counts_don_t_depend_on_how_rows_are_counted(spark, monkeypatch):
    df = spark.createDataFrame([("en", "a b c d " * 40), ("de", "a b. c d " * 30)] * 5, "lang string, text string").coalesce(1)
    want = sorted(map(tuple, collocations.collocations(df).collect()))
    texts = [r["text"] for r in df.collect()]
    pieces = collocations.Pieces(collocations.pa.array(texts))
    assert len(pieces.ids) == sum(len(re.split("[ .]+", t.strip())) for t in texts)
    assert want and want == sorted(map(tuple, collocations.collocations(df.repartition(4)).collect()))


def test_the_filter_uses_spark_s_hash(spark):
    rows = [("en", "a b"), ("und", "é ñ"), ("", "x" * 40)]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string, phrase string").select(F.xxhash64("lang", "phrase")).collect()]
    own = [xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(lang.encode(), 42)) for lang, p in rows]
    assert [x % (1 << 64) for x in got] == own
    bits = collocations.frequent_bits(spark.createDataFrame(rows, "lang string, phrase string"))
    assert sum(bin(b).count("1") for b in bits) == 3 and all(bits[h % collocations.FILTER_BITS // 8] >> (h % 8) & 1 for h in own)


def test_ids_of_the_word_tokenizer():
    own, whole = repacking.WordEncoder(WORDS, cache_bytes=4000), Tokenizer.from_file(WORDS)
    rng = random.Random(7)
    texts = ["".join(rng.choices("aBİßſéÉ́ǅ'sS tTreve \n\t\x1c\x85\xa0 　你😀Ω１2٣Kﬁ힣가", k=rng.randint(1, 50))) for _ in range(2000)]
    texts += ["", " ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "x" * 5000, "it's we'LL \x00\x01ÿ", "word " * 3000]
    for text in texts:
        assert own.encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes(), text[:80]


def least_by_search(lengths, window):
    """Windows of a best packing, by trying everything."""
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins)}.values()):
            if bins[k] + lengths[i] <= window:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_bounds_never_exceed_the_best_packing():
    rng, tight = random.Random(5), 0
    for _ in range(300):
        window = rng.choice([10, 12, 30])
        lengths = [rng.randint(1, window) for _ in range(rng.randint(1, 9))]
        bound = repacking.least_windows(*np.unique(lengths, return_counts=True), window)
        best = least_by_search(lengths, window)
        assert -(-sum(lengths) // window) <= bound <= best
        tight += bound == best
    assert tight > 240 and repacking.least_windows(np.array([6]), np.array([5]), 10) == 5


def test_packing_places_every_piece_once(spark):
    rng = random.Random(6)
    lengths = [rng.choice([rng.randint(1, 64), rng.randint(20, 40), 64]) for _ in range(900)]
    rows = [(i, 0, 0, n, i, "x") for i, n in enumerate(lengths)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _part string")
    used = {}
    for rounds in (0, 4):
        packed = repacking.pack_certified(cut, window=64, shard_pieces=60, rounds=rounds)
        found = collections.defaultdict(list)
        for r in packed.collect():
            found[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
        assert sorted(d for f in found.values() for _, _, d in f) == list(range(900))
        for f in found.values():
            f.sort()
            assert f[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in itertools.pairwise(f)) and f[-1][0] + f[-1][1] <= 64
        used[rounds], bound = repacking.certificate(packed, 64)
        assert used[rounds] == len(found) >= bound
    assert used[4] <= used[0] and used[4] <= 1.02 * bound + 1


def test_repacking_of_odd_documents(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "  \n"), (3, "word " * 5000), (3, "word " * 5000), (4, "a b")], "doc_id long, text string").withColumn("sequence_id", F.lit("x"))
    got = repacking.repack_documents(docs, WORDS).collect()
    by = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in got)
    assert by == {(None, 0, 0, 1): 1, (1, 0, 0, 1): 1, (2, 0, 0, 1): 1, (4, 0, 0, 3): 1, (3, 0, 0, 2048): 2, (3, 1, 2048, 2048): 2, (3, 2, 4096, 905): 2}
    assert repacking.repack_documents(docs.limit(0), WORDS).count() == 0


def clicks(spark, rows):
    return spark.createDataFrame([(c, k, t, "x") for c, k, t in rows], "client_id long, kind string, ts timestamp_ntz, bucket string")


def test_set_algebra_counts_are_exact(spark):
    rng, start = random.Random(8), datetime.datetime(2024, 2, 20)
    rows = [(rng.randint(1, 30), rng.choice("abc"), start + datetime.timedelta(days=rng.choice([0, 1, 2, 3, 8, 9, 30, 58, 64]), hours=rng.randint(0, 23))) for _ in range(160)]
    rows += [(None, "a", start), (1, None, start), (1, "a", None), (9, "d", datetime.datetime(1969, 12, 30, 23))] + rows[:20]
    used = {(c, k, (t - datetime.datetime(1970, 1, 1)).days) for c, k, t in rows if None not in (c, k, t)}
    kinds, days = {k for _, k, _ in used}, {d for _, _, d in used}
    within = lambda kind, day: {c for c, k, d in used if k == kind and day - 6 <= d <= day}
    got = {(r["day"], r["kind_a"], r["kind_b"]): r for r in set_sketch.window_algebra(clicks(spark, rows)).collect()}
    assert got.keys() == set(itertools.product(days, kinds, kinds))
    for (day, a, b), r in got.items():
        x, y = within(a, day), within(b, day - 1)
        assert (r["n_union"], r["n_both"], r["n_only_a"]) == (len(x | y), len(x & y), len(x - y))
        for name in ("union", "both", "only_a"):
            assert r[f"est_{name}"] >= 0 and 0 <= r[f"err_{name}"] <= 8 * r["est_union"] / 512**0.5 + 3
            assert abs(r[f"est_{name}"] - r[f"n_{name}"]) <= 3
    assert set_sketch.window_algebra(clicks(spark, [])).count() == 0


def test_sketches_of_many_members(spark):
    """Registers against hashes worked out here, and estimates within their errors."""
    ids = spark.range(60_000).select(F.lit("k").alias("key"), F.col("id").alias("member"))
    parts = [ids.where("member < 40000"), ids.where("member >= 25000")]
    one, two = (set_sketch.sketch(p, ["key"], "member") for p in parts)
    whole = {r["bucket"]: r["code"] for r in set_sketch.sketch(ids, ["key"], "member").collect()}
    assert {r["bucket"]: r["code"] for r in set_sketch.merge(one.unionByName(two), ["key"]).collect()} == whole and len(whole) <= 512
    both = set_sketch.as_array(one, ["key"], "a").join(set_sketch.as_array(two, ["key"], "b"), "key")
    r = set_sketch.set_algebra(both).first()
    for name, true in (("union", 60_000), ("both", 15_000), ("only_a", 25_000)):
        assert abs(r[f"est_{name}"] - true) <= r[f"err_{name}"] <= 0.2 * 60_000
    bits = [r["b"] for r in spark.sql("SELECT explode(array(0L, 1L, 2L, 3L, 1023L, 1024L, 70368744177663L)) AS v").select(set_sketch.bit_length(F.col("v")).alias("b")).collect()]
    assert bits == [0, 1, 2, 2, 10, 11, 46]


def test_one_text_an_id_reaches_the_fit(spark, monkeypatch):
    rows = [(i, f"text {i} " * 20) for i in range(40)] + [(0, f"again {k}") for k in range(500)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y, prior: seen.append(len(x)) or quality.RuleModel(0.0, []))
    quality.train(docs, labels, modulus=1, held_out=5)
    assert seen == [40]
