"""The pipeline's stages against brute force at the smallest scale, and the entry without the pipeline."""

from __future__ import annotations

import subprocess
import sys
import zlib
from pathlib import Path

import corpus_pipeline
from curalens.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).cache()
        assert kept.columns == source.columns
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in kept.collect()}
        assert after.items() <= before.items()
        gone = before.keys() - after.keys()
        if name == "quality":
            known = [i for i in before if i in labels]
            assert sum((i in gone) == (labels[i]["quality"] == 0) for i in known) > 0.95 * len(known)
        if name == "decontamination":
            leaky = {i for i, r in before.items() if any(b in r["text"] for b in bench)}
            assert leaky <= gone and len(gone) <= len(leaky) + 1
        if name == "minhash":
            texts = [r["text"].lower().split() for r in after.values()]
            assert len({tuple(t) for t in texts if t}) == len([t for t in texts if t])
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "ids_crc32").collect()))


def test_near_copies_above_four_fifths_go(spark):
    words = [f"w{k}" for k in range(200)]
    near = [f"x{k}" if k in (10, 50, 90, 130) else w for k, w in enumerate(words)]  # 20 of 196 shingles change: 176 / 216 = 0.815
    far = [f"y{k}" if k in (10, 50, 90, 130, 170, 185) else w for k, w in enumerate(words)]  # 30 change: 166 / 226 = 0.735
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {1, 3}


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, columns that clash with helpers, and no rows at all."""
    text = " ".join(f"Word{k % 70} and w{k}" for k in range(120)) + "."
    near = text.replace("w50", "other")
    rows = [(None, None), (None, text), (1, None), (2, ""), (2, ""), (3, text), (3, text), (4, near), (5, text), (5, "A quite different text about the sea, and nothing else. " * 3), (6, "line\n" * 20_000), (7, " \n")]
    names = ("doc_id", "text", "_gone", "_again", "_leaked", "_id", "_same", "_key", "_row", "_score", "_text", "_shard", "kept", "carried")
    kind = "doc_id long, text string, " + ", ".join(f"{n} int" for n in names[2:])
    frame = spark.createDataFrame([(*r, *range(len(names) - 2)) for r in rows], kind)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, frame, SF).collect(), stage(spark, frame.limit(0), SF).collect()
        assert none == [], name
        if name == "packing":
            assert sum(r["start"] == 0 for r in out) == len(rows) and all(0 < r["length"] <= 2048 for r in out)
            continue
        left = sorted(((r["doc_id"], r["text"]) for r in out), key=repr)
        assert all(r in rows for r in left) and all(len(r) == len(names) and list(r)[2:] == list(range(len(names) - 2)) for r in out), name
        if name == "minhash":  # 3, 4 and a text of 5 are one group; the other text of 5 stands for itself
            assert left == sorted([(None, None), (None, text), (1, None), (2, ""), (3, text), (5, rows[9][1]), rows[10], (7, " \n")], key=repr)
        if name == "decontamination":
            assert left == sorted(rows, key=repr)
        if name == "toxicity":
            assert {(None, None), (1, None), (2, ""), (7, " \n")} <= set(left)


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11)) and ORACLE_SQL.keys() <= QUERIES.keys()
    assert zlib.crc32(b"") == 0


def test_entry_without_llm(tmp_path):
    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['curalens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'tasks_list' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
