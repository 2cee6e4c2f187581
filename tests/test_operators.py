"""Hand-written cases of the operators, and what a changed field must change."""

from __future__ import annotations

import hashlib
import random
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curalens.functions import deadlines, jsontext, lexer, proposals, text
from curalens.operators import audits, compare, leakage, rollups, scoring, tasks
from curalens.sources import documents, tables
from curalens.sources.cases import case_faults, case_rows, file_digests, folder_digest, good_cases
from curalens.sources.tables import latest_report
from curalens.streaming import lifecycle

TASK = "id long, content string, completed boolean, due_at long"


def now():
    """10:00 local on 27 September 2026."""
    return F.lit("2026-09-27 03:00:00").cast("timestamp")


def epoch(day: int, hour: int, minute: int = 0, second: int = 0) -> int:
    """September 2026, local time at UTC+7."""
    return 1788220800 + (day - 1) * 86400 + (hour - 7) * 3600 + minute * 60 + second


@pytest.fixture
def store(spark):
    rows = [
        (1, "past today", False, epoch(27, 9)), (2, "later today", False, epoch(27, 15)), (3, "same time", False, epoch(27, 15)), (4, "tomorrow", False, epoch(28, 8)),
        (5, "yesterday", False, epoch(26, 8)), (6, "done", True, epoch(27, 12)), (7, "no deadline", False, None), (8, "midnight", False, epoch(27, 0)),
        (9, "now", False, epoch(27, 10)), (10, "last second", False, epoch(27, 23, 59, 59)), (11, "next midnight", False, epoch(28, 0)),
    ]
    return spark.createDataFrame(rows, TASK)


@pytest.mark.parametrize("scope, ids", [("today", [1, 2, 3, 8, 9, 10]), ("tomorrow", [4, 11]), ("overdue", [1, 5, 8])])
def test_due_scopes(store, scope, ids):
    assert sorted(r["id"] for r in tasks.due(store, scope, now()).collect()) == ids


def test_unknown_scope(store):
    with pytest.raises(ValueError):
        tasks.due(store, "someday", now())


@pytest.mark.parametrize(
    "said, want",
    [
        ("27/09/2026 08:00", epoch(27, 8)), ("08:00 ngày 27/09/2026", epoch(27, 8)), ("8:05 mai", epoch(28, 8, 5)), ("8 giờ sáng mai", epoch(28, 8)),
        ("12 giờ sáng hôm nay", epoch(27, 0)), ("12 giờ chiều hôm nay", epoch(27, 12)), ("7 giờ 30 phút tối ngày mai.", epoch(28, 19, 30)), ("  8:00   MAI?! ", epoch(28, 8)),
        ("30/02/2026 08:00", None), ("24:00 mai", None), ("13 giờ sáng mai", None), ("0 giờ sáng mai", None), ("8:60 mai", None), ("soon", None), ("", None), ("8:00\nmai", None), (None, None),
    ],
)
def test_parse_deadline(spark, said, want):
    df = spark.createDataFrame([(said,)], "t string").select(deadlines.parse_deadline(F.col("t"), now()).alias("x"))
    assert df.first()["x"] == want


def test_format_is_the_inverse(spark):
    df = spark.createDataFrame([(epoch(27, 8, 5),)], "t long").select(deadlines.format_deadline(F.col("t")).alias("s"))
    again = df.select("s", deadlines.parse_deadline(F.col("s"), now()).alias("x")).first()
    assert (again["s"], again["x"]) == ("27/09/2026 08:05", epoch(27, 8, 5))


def test_guarded_delete_and_snapshot(spark, store):
    good = (2, 2, (2, "later today", False, epoch(27, 15)))
    commands = spark.createDataFrame([good, (3, 3, (3, "other", False, None)), (4, 99, None), (5, 4, None)], f"seq int, id long, expected struct<{TASK.replace(' ', ':').replace(',:', ',')}>")
    assert {r["id"]: r["status"] for r in tasks.guarded_delete(store, commands).collect()} == {2: "deleted", 3: "stale", 99: "not_found", 4: "deleted"}
    changes = spark.createDataFrame([(2, "delete", None, None), (1, "complete", None, None), (4, "update", "x", None), (5, "deadline", None, 7)], "id long, op string, content string, due_at long")
    after = {r["id"]: r for r in tasks.apply_changes(store, changes).collect()}
    assert 2 not in after and after[1]["completed"] and after[4]["content"] == "x" and after[5]["due_at"] == 7 and after[7]["due_at"] is None


def test_insert_keeps_numbers_unused(spark):
    rows = tasks.insert_lines(spark.createDataFrame([(1, "a\r\nb\r\r c"), (2, "   "), (20001, "d")], "seq long, text string"), 40, bucket=10).orderBy("id").collect()
    assert [(r["id"], r["content"]) for r in rows] == [(41, "a"), (42, "b"), (43, " c"), (44, "d")]


def test_lines_are_numbered_level_by_level(spark):
    told = [(k * 7 - 300, "\n".join(["x", "", "y"][: k % 4])) for k in range(90)] + [(None, "lost"), (5000, None)]
    lines = [line for k, text in sorted(x for x in told if x[0] is not None and x[1] is not None) for line in text.split("\n") if line]
    got = tasks.insert_lines(spark.createDataFrame(told, "seq long, text string"), 50, bucket=10, fan=3)
    assert [(r["id"], r["content"]) for r in got.orderBy("id").collect()] == [(51 + i, line) for i, line in enumerate(lines)]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert tasks.insert_lines(spark.createDataFrame([], "seq long, text string"), 50).collect() == []


def test_migrate_rejects_unknown(spark):
    with pytest.raises(ValueError):
        tasks.migrate(spark.createDataFrame([(1, "a")], "id int, name string"))


def test_text_rules(spark):
    df = spark.createDataFrame([("xoá #12 và 7, không phải a5",)], "t string")
    assert df.select(text.id_tokens(F.col("t")).alias("x")).first()["x"] == ["12", "7"]
    replies = spark.createDataFrame([("",), ("[1]",), ("漢",), ("see tool:x",), ("<a b>",), ("fine",)], "r string")
    found = [r["v"] for r in replies.select(text.reply_violations(F.col("r"), F.lit("q"), ["tool:"]).alias("v")).collect()]
    assert found == [["empty_reply"], ["raw_json"], ["cjk_character"], ["internal_protocol"], ["placeholder_markup"], []]
    d = spark.createDataFrame([("b\na", "a\nb"), ("buy", "buy."), (None, "x"), ("x", "x")], "a string, t string")
    tags = [r["v"] for r in d.select(text.text_differences("f", F.col("a"), F.array("t"), F.col("t")).alias("v")).collect()]
    assert tags == [["f_mismatch", "f_not_verbatim", "f_lines_reordered"], ["f_mismatch", "f_truncated", "f_punctuation_missing"], ["f_mismatch"], []]


def test_leakage_against_difflib(spark):
    audited = ["pay the rent tomorrow", "call mum", "pay the rent today", "ＰＡＹ the rent"]
    reference = ["pay the rent tomorow", "call dad", "pay the rent"]
    a = spark.createDataFrame(list(enumerate(audited)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(reference)), "ref_id long, ref_text string")
    got = {r["id"]: (r["ref_id"], r["score"]) for r in leakage.nearest(a, b, 0.75, ["id"], ["ref_id"]).collect()}
    want = {}
    for i, x in enumerate(audited):
        scores = [(SequenceMatcher(None, x, y, autojunk=False).ratio(), -j) for j, y in enumerate(reference)]
        best, j = max(scores)
        if best >= 0.75:
            want[i] = (-j, best)
    assert got == want
    folded = leakage.exact_matches(a, b.select(F.col("ref_id").alias("id"), F.col("ref_text").alias("text"))).collect()
    assert [(r["id"], r["ref_id"]) for r in folded] == [(3, 2)] and unicodedata.normalize("NFKC", audited[3]).casefold() == reference[2]
    assert leakage.masked("Xoá task 12: Mua SỮA!", ["mua sữa"]) == "xoá task <id> <payload>"


def test_gates_react_to_one_changed_row(spark):
    old = spark.createDataFrame([(i, "pass" if i < 6 else "fail", i % 2) for i in range(10)], "id int, status string, action int")
    new = old.withColumn("status", F.when(F.col("id") < 8, "pass").otherwise("fail")).drop("action")
    gates = lambda n: {r["gate"]: r["passed"] for r in compare.acceptance_gates(old, n, "id", "action", 8, 0.25).collect()}
    assert all(gates(new).values())
    worse = new.withColumn("status", F.when(F.col("id") == 0, "fail").otherwise(F.col("status")))
    assert not gates(worse)["minimum_pass"]


def test_lifecycle(spark):
    log = [("a", 1, "running"), ("a", 2, "interrupted"), ("a", 3, "running"), ("a", 4, "complete"), ("a", 5, "interrupted"), ("b", 1, "running")]
    events = spark.createDataFrame(log, "run string, seq int, kind string")
    got = {r["run"]: (r["state"], r["interruptions"]) for r in lifecycle.run_state(events, "run", "seq", "kind", "complete", "interrupted").collect()}
    assert got == {"a": ("complete", 1), "b": ("running", 0)}
    expected = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "ordinal int, id string")
    assert lifecycle.resume_point(expected, expected.where("ordinal < 2")).first()["valid"]
    assert not lifecycle.resume_point(expected, expected.where("ordinal > 0")).first()["valid"]


def test_streamed_states_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    turns = spark.createDataFrame([(s, t, f"{s}{t}") for s in range(3) for t in range(4)], "session long, turn long, state string")
    for k in range(2):
        turns.where(F.floor(F.col("turn") / 2) == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink = lifecycle.stream_turn_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
    sink.trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 12 and {(s, t) for s, t, _, _ in got} == {(s, t) for s in range(3) for t in range(4)}
    batch = lifecycle.turn_states(turns, "session", "turn", "state").select("session", "turn", "state_before", "state_after")
    assert got == {tuple(r) for r in batch.collect()}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}')
    (tmp_path / "b.json").write_text("not json")
    assert file_digests(spark, str(tmp_path), "*.json").count() == 2
    assert latest_report(spark, str(tmp_path)).first()["text"] == '{"k": 1}'


def test_documents(spark):
    nested = spark.createDataFrame([(1, '{"cases": [{"prompt": "a", "x": {"user_message": "b"}}], "prompt": 3}'), (2, None), (3, "{")], "id int, doc string").where("id < 3")
    assert [(r["id"], r["text"], r["path"]) for r in documents.harvest(nested, "doc").collect()] == [(1, "a", "$.cases[0]"), (1, "b", "$.cases[0].x")]
    pair = spark.createDataFrame([('{"a": 1, "b": [1.5, "é"]}',), ('{"b":[1.5,"é"],"a":1}',), ("{",)], "doc string")
    digests = [r["d"] for r in pair.select(jsontext.canonical_digest(F.col("doc")).alias("d")).collect()]
    assert digests[0] == digests[1] == hashlib.sha256('{"a":1,"b":[1.5,"é"]}'.encode()).hexdigest() and digests[2] is None
    files = [("f", "b", "00" * 32), ("f", "a", "11" * 32)]
    want = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p.encode() + bytes.fromhex(h) for _, p, h in sorted(files))).hexdigest()
    assert folder_digest(spark.createDataFrame(files, "folder string, path string, sha256 string")).first()["digest"] == want


def test_case_files(spark, tmp_path):
    texts = {
        "a": '[{"id": 1, "x": 1.0}, {"id": "b"}, 3, {"id": true}, {"id": " "}, {}]', "b": '{"cases": [{"id": "b", "y": [1]}, {"id": "1"}]}', "c": '{"cases": {}}', "d": "", "e": "[]",
        "f": '[{"id": 1, "id": 2}]', "g": "[NaN]", "h": '"text"', "i": "[" * 100_000,
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = case_rows(spark, str(tmp_path), "*.json").withColumn("file", F.regexp_extract("file", r"(.)\.json$", 1))
    assert [tuple(r) for r in good_cases(rows).orderBy("file", "ordinal").collect()] == [
        ("a", 0, "1", '{"id":1,"x":1.0}'), ("a", 1, "b", '{"id":"b"}'), ("b", 0, "b", '{"id":"b","y":[1]}'), ("b", 1, "1", '{"id":"1"}')
    ]
    assert {tuple(r) for r in case_faults(rows).collect()} == {
        ("not an object", None, "a", 1), ("no id", None, "a", 3), ("no cases", None, "c", 1), ("no cases", None, "h", 1), ("repeated id", "1", "a", 2), ("repeated id", "b", "a", 2),
        *(("not strict JSON", None, f, 1) for f in "fgi"),  # d is empty
    }


def test_digests_in_blocks(spark, tmp_path):
    """Files beyond the bound are hashed in blocks, to the same digests; a folder's files stream through its digest in byte order."""
    for name, size in (("a", 0), ("b b", 10), ("c%20", 11), ("é", 100_000)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (size // 256) + b"x" * (size % 256))
    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir() if p.stat().st_size}
    for whole in (-1, 10, 1 << 20):
        assert {(r["path"].rsplit("/", 1)[1], r["length"], r["sha256"]) for r in file_digests(spark, str(tmp_path), whole=whole).collect()} == want
    rng = random.Random(2)
    files = [(f"f{k % 3}", f"p{rng.randint(0, 10**9)}{'é' * (k % 2)}", f"{k:064x}") for k in range(500)]
    told = {r["folder"]: r["digest"] for r in folder_digest(spark.createDataFrame(files, "folder string, path string, sha256 string")).collect()}
    assert told == {
        f: hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p + bytes.fromhex(h) for p, h in sorted((p.encode(), h) for g, p, h in files if g == f))).hexdigest() for f in ("f0", "f1", "f2")
    }
    assert folder_digest(spark.createDataFrame([], "folder string, path string, sha256 string")).count() == 0


def test_order_of_two_lists(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(-40, 900)]), rng.randint(0, 60)) for _ in range(400)] + [(7, 7)] * 3
    place = lambda r: compare.positions(spark.createDataFrame(r, "o long, k long"), "o", "k", bucket=9, fan=4)
    want = [(p, k) for p, (_, k) in enumerate(sorted(r for r in rows if r[0] is not None))]
    assert sorted(tuple(r) for r in place(rows).collect()) == want
    listed = lambda keys: spark.createDataFrame(list(enumerate(keys)), "position long, key long")
    gates = lambda a, b: {r["gate"]: r["passed"] for r in compare.order_gates(listed(a), listed(b)).collect()}
    names = ("same_length", "same_members", "same_order")
    for other, told in (([3, 1, 2], (1, 1, 1)), ([1, 3, 2], (1, 1, 0)), ([3, 1, 1], (1, 0, 0)), ([3, 1], (0, 0, 0)), ([], (0, 0, 0))):
        assert gates([3, 1, 2], other) == dict(zip(names, map(bool, told), strict=True))
    assert gates([], []) == dict.fromkeys(names, True) and place([]).count() == 0
    assert [tuple(r) for r in compare.order_differences(listed([3, 1, 2]), listed([3, 2])).orderBy("position").collect()] == [(1, 1, 2), (2, 2, None)]


def test_whole_id_sets(spark):
    ids = [1, 2, 32_768, 32_769, 65_536, 0, -1, -32_768, -40_000, 10**12, None]
    rows = [(i, "ab"[k % 2], k % 3 == 0, None if k % 4 else True) for k, i in enumerate(ids)] * 2
    sets = scoring.listed_ids(scoring.flagged_ids(spark.createDataFrame(rows, "id long, category string, x boolean, y boolean"), flags=("x", "y")))
    got = {}
    for r in sets.collect():
        assert r["ids"] == sorted(set(r["ids"]))
        got.setdefault((r["is_total"], r["category"], r["name"]), []).extend(r["ids"])
    want = {}
    for i, c, x, y in rows:
        for name in [n for n, v in (("x", x), ("y", y)) if v and i is not None]:
            want.setdefault((False, c, name), set()).add(i)
            want.setdefault((True, None, name), set()).add(i)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def one_by_one(held, told):
    """The store's rules, a command at a time."""
    state, out = {t[0]: list(t[1:]) for t in held}, []
    for seq, i, op, content, due, expected in sorted(told, key=lambda c: c[0]):
        now = state.get(i)
        if now is None:
            status = "not_found"
        elif op == "complete":
            status, now[1] = "already_completed" if now[1] else "completed", True
        elif op == "update":
            status, now[0] = ("unchanged", now[0]) if content in (None, now[0]) else ("updated", content)
        elif op == "deadline":
            status, now[2] = "unchanged" if now[2] == due else "set" if now[2] is None else "updated", due
        else:
            status = "deleted" if expected is None or expected == (i, *now) else "stale"
            if status == "deleted":
                del state[i]
        out.append((seq, i, status))
    return out, sorted((i, *s) for i, s in state.items())


def test_commands_in_order_against_one_by_one(spark):
    rng = random.Random(12)
    held = [(i, f"c{i % 2}", i % 5 == 0, None if i % 3 == 0 else i % 2) for i in range(1, 40)]
    told = []
    for seq in rng.sample(range(5000), 900):
        i, op = rng.choice([7, 7, rng.randint(1, 45)]), rng.choice(["complete", "update", "update", "deadline", "deadline", "delete"])
        guard = (i, f"c{rng.randint(0, 1)}", rng.random() < 0.8, rng.randint(0, 1)) if i == 7 or rng.random() < 0.8 else None
        told.append((seq, i, op, rng.choice(["c0", "c1", None]), rng.randint(0, 1), guard if op == "delete" else None))
    kind = "id long, content string, completed boolean, due_at long"
    a, b = spark.createDataFrame(held, kind), spark.createDataFrame(told, f"seq long, id long, op string, content string, due_at long, expected struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    want, left = one_by_one(held, told)
    for block in (1, 50, 100_000):
        done = tasks.commands_in_order(a, b, block)
        assert sorted((r["seq"], r["id"], r["status"]) for r in done.collect()) == want
    assert sorted(tuple(r) for r in tasks.after_commands(a, b, done).collect()) == left
    assert {s for _, _, s in want} == {"updated", "unchanged", "set", "stale", "deleted", "not_found", "completed", "already_completed"}
    assert tasks.commands_in_order(a, b.limit(0)).count() == 0


def test_the_nearest_against_every_pair(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcde ", k=rng.choice([1, 2, 3, 5, 6, 8, 12, 30, 60]))).strip() or "a" for _ in range(60)]

    def changed(t):
        for _ in range(rng.randint(0, max(1, len(t) // 9))):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "x", "a"]) + t[at + rng.randint(0, 1) :]
        return t

    audited, reference = [changed(t) for t in texts for _ in range(3)] + ["", None], texts + [changed(t) for t in texts] + [""]
    a = spark.createDataFrame(list(enumerate(audited)), "id long, text string")
    b = spark.createDataFrame(list(enumerate(reference)), "ref_id long, ref_text string")
    for threshold in (0.6, 0.75, 0.92, 0.97):
        want = {}
        for i, x in enumerate(audited):
            scores = [(SequenceMatcher(None, x, y, autojunk=False).ratio(), -j) for j, y in enumerate(reference) if x and y]
            if scores and max(scores)[0] >= threshold:
                want[i] = (-max(scores)[1], max(scores)[0])
        got = {r["id"]: (r["ref_id"], r["score"]) for r in leakage.nearest(a, b, threshold, ["id"], ["ref_id"]).collect()}
        assert got == want and len(want) > 20


def test_few_pairs_are_compared(spark):
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(12))
    reference = [line() for _ in range(200)]
    audited = [line() for _ in range(400)] + [t[:-1] + "x" for t in reference[:50]]
    a, b = spark.createDataFrame([(t,) for t in audited], "text string"), spark.createDataFrame([(t,) for t in reference], "ref_text string")
    met, band = leakage.near_candidates(a, b, 0.92).count(), leakage.length_band(a, b, 0.92).count()
    assert 50 <= met < band / 50


def test_a_class_a_text_and_not_every_pair(spark):
    rows = spark.createDataFrame([(i, "Same  Text" if i % 2 else "same text") for i in range(200)], "id long, text string")
    found = leakage.exact_matches(rows, rows).collect()
    assert len(found) == 200 and {(r["ref_id"], r["refs"]) for r in found} == {(0, 200)}


def test_ties_of_the_nearest(spark):
    a = spark.createDataFrame([(1, "pay the rent")], "id long, text string")
    b = spark.createDataFrame([(1, "pay the rent!"), (2, "pay the rent?"), (3, "call mum")], "ref_id long, ref_text string")
    assert leakage.nearest(a, b, 0.75, ["id"], ["ref_id"]).first()["ref_id"] == 1 and leakage.nearest(a, b, 0.75, ["id"], ["ref_id"], last=True).first()["ref_id"] == 2


def test_the_bound_by_characters_loses_no_pair(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc d", k=rng.randint(1, 14))), "".join(rng.choices("abc d", k=rng.randint(1, 14)))) for _ in range(400)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    a, b = leakage.letters(F.col("a")), leakage.letters(F.col("b"))
    got = [r["ok"] for r in frame.select(leakage.may_reach(a, b, F.length("a"), F.length("b"), 0.75).alias("ok")).collect()]
    near = [SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.75 for x, y in pairs]
    assert all(ok for ok, n in zip(got, near, strict=True) if n) and sum(got) < len(got) and any(near)


def test_both_masks():
    assert leakage.masked_fields("  Đặt HẠN việc 12a, 12: Mua  sữa lúc 8:00!", "mua sữa", "8:00") == "đặt hạn việc 12a, <id>: <content> lúc <when>!"
    assert leakage.masked("Đặt HẠN việc 12a, 12: Mua sữa", ["mua sữa"]) == "đặt hạn việc <id> a <id> <payload>"


def test_sinks(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "ordinal")
    path = str(tmp_path / "report")
    tables.write_new(rows, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        tables.write_new(rows, path)
    tables.replace_whole(rows.where("ordinal < 3"), path)
    assert spark.read.parquet(path).count() == 3
    progress = str(tmp_path / "progress")
    for first in (0, 4, 4, 8):  # the second slice is written again after a failure
        tables.append_slice(rows, progress, "ordinal", first, 4)
    assert sorted(r["ordinal"] for r in spark.read.parquet(progress).collect()) == list(range(10))


def test_a_killed_replacement_leaves_a_whole_version(spark, tmp_path):
    rows, path = spark.range(10), f"file://{tmp_path}/t"
    assert tables.snapshots(spark, path) == [] and tables.commit_snapshot(rows, path) == 0
    with pytest.raises(FileNotFoundError):
        tables.read_snapshot(spark, path, 7)
    broken = rows.select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):  # while the rows are written
        tables.commit_snapshot(broken, path)
    (tmp_path / "t/data/left").mkdir()  # before the entry
    assert tables.read_snapshot(spark, path).count() == 10
    (tmp_path / f"t/log/{1:020d}").write_text("data/le")  # within the entry
    assert tables.read_snapshot(spark, path).count() == 10
    assert tables.commit_snapshot(tables.read_snapshot(spark, path).where("id < 4"), path) == 2 and tables.read_snapshot(spark, path).count() == 4
    with pytest.raises(FileExistsError):  # two writers that both read version 0
        tables.commit_snapshot(rows, path, after=1)
    assert tables.read_snapshot(spark, path).count() == 4 and tables.read_snapshot(spark, path, 0).count() == 10
    assert [v for v, _ in tables.snapshots(spark, path)] == [0, 2] and len(list((tmp_path / "t/data").iterdir())) == 4


def test_resume_audit(spark):
    files = spark.createDataFrame([("done", "in-1\n"), ("state.json", '{"global_step": 25}')], "path string, content string")
    folder = spark.createDataFrame([("ab",)], "digest string")
    told = lambda **k: {r["check"]: r["ok"] for r in audits.resume_audit(files, ["done", "state.json"], **({"marker_name": "done", "marker": "in-1", "state_name": "state.json", "step": 25, "digest": "ab", "folder": folder} | k)).collect()}
    assert all(told().values()) and not told(step=50)["step"] and not told(marker="x")["marker"] and not told(digest="cd")["digest"]
    assert not {r["check"]: r["ok"] for r in audits.resume_audit(files, ["weights"], "done", "in-1", "state.json", 25, "ab", folder).collect()}["missing_file"]


def test_percentiles_against_the_engine(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, 9.25, rng.random() * 1e6, None]), k) for k in range(2000)], "g string, s double, t int")
    got = {r["g"]: (r["median_seconds"], r["p95_seconds"]) for r in rollups.latency(rows, ["g"], "s", "t").collect()}
    want = {r["g"]: (r["m"], r["p"]) for r in rows.groupBy("g").agg(F.median("s").alias("m"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY s)").alias("p")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def test_streamed_states_know_late_turns(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = "session long, turn long, state string"
    for k, rows in enumerate(([(1, 1, "a"), (1, 3, "c")], [(1, 2, "b"), (1, 4, "d")])):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    sink = lifecycle.stream_turn_states(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
    sink.trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, None, "a"), (1, 3, "a", "c"), (1, 2, None, "b"), (1, 4, "c", "d")}


def test_long_lines_are_indexed_in_little_time(spark):
    """A line's keys carry a number and not the line, and only those go on that the reference may have; pairs that meet by chance end at a bound that is worked out for many at once."""
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 6))) for _ in range(300)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    reference = [line(n) for n in (20, 20, 20, 4000)]
    audited = [line(20) for _ in range(300)] + [line(4000)] + [t[:-2] + "xy" for t in reference]
    a, b = spark.createDataFrame([(t,) for t in audited], "text string"), spark.createDataFrame([(t,) for t in reference], "ref_text string")
    found = {(r["text"], r["ref_text"]) for r in leakage.near_candidates(a, b, 0.92).collect()}
    assert set(zip(audited[-4:], reference, strict=True)) <= found
    named = leakage.named(b.selectExpr("ref_text AS text"))
    keys = leakage.audited_segments(leakage.named(a), 0.92, leakage.segment_filter(leakage.reference_segments(named, 0.92)))
    assert keys.count() < sum(map(len, audited)) / 2 and dict(keys.dtypes)["id"] == "bigint"
    pairs = [(x, y) for x in audited[:50] for y in audited[:50]]
    may = leakage.gram_bound([x for x, _ in pairs], [y for _, y in pairs], 0.92)
    true = [SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92 for x, y in pairs]
    assert all(m for m, t in zip(may, true, strict=True) if t) and may.sum() < 2 * sum(true)
    edited = [(t, "".join(c for c in t if rng.random() > 0.04)) for t in audited[:200]]
    may = leakage.gram_bound([x for x, _ in edited], [y for _, y in edited], 0.92)
    assert all(m for m, (x, y) in zip(may, edited, strict=True) if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.92)


def test_classes_hold_every_pair(spark):
    rng = random.Random(6)
    rows = [(i, i % 3 == 0, rng.choice(["a", "b", "c", "", None, f"own {i}"])) for i in range(120)]
    found = leakage.exact_classes(spark.createDataFrame(rows, "id long, is_reference boolean, text string"), "text").collect()
    pairs = {(x, y) for x, ref, t in rows for y, other, u in rows if not ref and other and t and t == u}
    assert len(found) == len(rows) and len(pairs) > 100
    assert {(x["id"], y["id"]) for x in found for y in found if not x["is_reference"] and y["is_reference"] and x["class_id"] is not None and x["class_id"] == y["class_id"]} == pairs
    assert all(r["links"] == sum(r["id"] == p[r["is_reference"]] for p in pairs) for r in found)


@pytest.mark.parametrize("name, sides", [("leak_exact", 1), ("leak_folded", 2)])
def test_leaks_have_a_row_for_each_row_read(spark, name, sides):
    from curalens.plans.catalogue import QUERIES

    where = "/root/testdata/sf0.001"
    read = spark.read.parquet(f"{where}/{'documents' if name == 'leak_exact' else 'part'}.parquet").count()
    assert QUERIES[name](spark, where).count() == sides * read


def test_few_sets_are_unfolded_at_once():
    full = pa.RecordBatch.from_arrays([pa.array(["x"] * 100), pa.array(range(-1, 99), pa.int64()), pa.array([b"\xff" * 4096] * 100)], ["name", "bucket", "bits"])
    parts = list(scoring.unfolded(iter([full]), ["name", "bucket"]))
    assert max(p.num_rows for p in parts) <= 16 and sum(p.num_rows for p in parts) == 100
    ids = [i for p in parts for row in p.column("ids").to_pylist() for i in row]
    assert ids == list(range(-65_535, 98 * 32_768 + 1))


def test_the_criteria_are_read_once(spark):
    """Not once for each check: the reader stands in one step of the plan, before the checks."""
    from curalens.plans.catalogue import QUERIES

    plan = QUERIES["review_criteria"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_long_requests_are_read_in_parts(spark):
    texts = ["thêm việc " * 4000, None, "", "xong việc 7"] * 6
    parts = list(lexer.pieces(texts))
    assert [t for part in parts for t in part] == [t or "" for t in texts] and max(sum(map(len, part)) for part in parts) <= lexer.PIECE
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1).select("k", lexer.lexed("t").alias("x")).select("k", "x.*").collect()
    assert [(r["k"], (r["lexemes"], r["letters"])) for r in sorted(rows)] == [(k, lexer.read(t or "")) for k, t in enumerate(texts)]


def test_turns_are_scored_once(spark):
    from curalens.plans.catalogue import QUERIES

    plan = QUERIES["session_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1


def test_a_text_is_stripped_once(spark):
    from curalens.plans.catalogue import QUERIES

    plan = QUERIES["text_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<\\|im_end\\|>") == 1


def test_arguments_are_read_once(spark):
    rows = spark.createDataFrame([("complete_task", '{"id": 7, "x": 1}'), ("sing", "{}"), ("update_task", "[7]"), ("update_task", '{"id": "7"}')], "n string, a string")
    found = rows.select("n", "a", proposals.argument_errors(F.col("n"), F.col("a"), scoring.TASK_TOOLS).alias("e"))
    assert found._jdf.queryExecution().analyzed().toString().lower().count("try_parse_json(a") == 1
    assert [sorted(r["e"]) for r in found.collect()] == [["extra_argument:x"], ["unknown_tool"], ["arguments_not_object"], ["invalid_argument:id", "missing_argument:content"]]
