"""Registered queries of contracts and audits, with the SQL that must give the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts, deadlines, text
from ..operators import audits, scoring
from ..operators import tasks as store
from ..sources.tables import read, scripted_responses
from .catalogue import query
from .scoring import CALLS, DONE, EDIT, WHEN, accepted, dealt, expected

# -- contracts ----------------------------------------------------------------------------------------------------------

#: (what differs from a good case, violations)
GOOD = {"id": "c1", "prompt": "xong việc 7", "family": "f", "rationale": "r", "behavior": "call", "action": "complete", "accepted": DONE, "missing": "[]"}
CASES = (
    ({}, []), ({"id": " "}, ["missing_id"]), ({"prompt": None}, ["missing_prompt"]), ({"prompt": " "}, ["missing_prompt"]), ({"family": ""}, ["missing_family"]), ({"rationale": None}, ["missing_rationale"]),
    ({"behavior": "dance"}, ["unknown_behavior", "calls_without_call"]), ({"action": "sing"}, ["unknown_action", "invalid_gold_call"]), ({"action": None}, ["call_without_gold", "invalid_gold_call"]), ({"accepted": "[]"}, ["call_without_gold"]),
    ({"accepted": None}, ["missing_lists", "call_without_gold"]), ({"missing": None}, ["missing_lists"]), ({"missing": '["id"]'}, ["missing_slots"]), ({"behavior": "clarify", "accepted": "[]", "missing": '["id"]'}, []),
    ({"behavior": "clarify", "accepted": "[]"}, ["missing_slots"]), ({"behavior": "clarify", "accepted": "[]", "missing": '["id", " "]'}, ["blank_slot"]), ({"behavior": "no_action", "action": None, "accepted": "[]"}, []),
    ({"behavior": "no_action", "action": None}, ["calls_without_call"]), ({"behavior": "no_action", "accepted": "[]", "missing": '["x"]'}, ["missing_slots"]), ({"action": "delete"}, ["invalid_gold_call"]),
    ({"accepted": accepted(("complete_task", {"id": "7"}))}, ["invalid_gold_call"]), ({"accepted": accepted(("complete_task", {"id": 7}), ("delete_task", {"id": 7}))}, ["invalid_gold_call"]), ({"action": "edit", "accepted": EDIT}, []), ({"action": "deadline", "accepted": WHEN}, []),
)
CASE_ROWS = [tuple((GOOD | d)[k] for k in GOOD) for d, _ in CASES]


@query("case_contract", expected("part", "p_partkey", "violations", [(v,) for _, v in CASES]))
def case_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", CASE_ROWS, tuple(GOOD))
    c = F.col
    found = contracts.case_violations(
        c("id"), c("prompt"), c("family"), c("rationale"), c("behavior"), c("action"), F.from_json("accepted", CALLS), F.from_json("missing", "array<string>"), scoring.TASK_TOOLS, scoring.action_tool(c("action"))
    )
    return rows.select("p_partkey", found.alias("violations"))


#: (behavior, action, user, content, calls, violations)
RECORDS = (
    ("call", "complete", "xong việc 7", "", DONE, []), ("call", "complete", "xong việc 8", "", DONE, ["id_not_grounded"]), ("call", "complete", "xong việc 17", "", DONE, ["id_not_grounded"]), ("call", "delete", "xong việc 7", "", DONE, ["wrong_tool"]),
    ("call", "complete", "xong việc 7", "ok", DONE, ["call_target"]), ("call", "complete", "xong việc 7", "", "[]", ["call_target"]), ("call", "complete", "xong việc 7", None, DONE, ["missing_content"]), ("call", "complete", " ", "", DONE, ["missing_user", "id_not_grounded"]),
    ("call", "complete", "xong việc 7", "", accepted(("complete_task", {"id": 7}), ("complete_task", {"id": 7})), ["multiple_calls", "call_target"]), ("call", "complete", "xong việc 7", "", accepted(("complete_task", {"id": "7"})), ["invalid_arguments"]),
    ("call", "edit", "sửa việc 3 thành mua sữa.", "", EDIT, []), ("call", "edit", "sửa việc 3 thành mua sữa", "", EDIT, ["content_not_verbatim"]), ("call", "deadline", "đặt hạn việc 5 vào 9 giờ sáng mai", "", WHEN, ["when_not_verbatim"]),
    ("call", "due_query", "xem việc HÔM NAY", "", accepted(("list_tasks_by_deadline", {"scope": "today"})), []), ("call", "due_query", "xem việc mai", "", accepted(("list_tasks_by_deadline", {"scope": "tomorrow"})), []),
    ("call", "due_query", "xem việc mai", "", accepted(("list_tasks_by_deadline", {"scope": "overdue"})), ["scope_not_grounded"]), ("clarify", "complete", "xong việc", "việc nào?", "[]", []), ("clarify", "complete", "xong việc", "", "[]", ["missing_reply"]),
    ("clarify", "complete", "xong việc", "việc nào?", DONE, ["call_of_other_behavior"]), ("clarify", None, "xong việc", "việc nào?", "[]", ["unknown_action"]), ("no_action", None, "chào", "chào bạn", "[]", []), ("no_action", "complete", "chào", "chào bạn", "[]", ["action_of_no_action"]),
    ("sing", "complete", "chào", "chào bạn", "[]", ["unknown_behavior"]),
)


@query("training_contract", expected("part", "p_partkey", "violations", [(r[-1],) for r in RECORDS]))
def training_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", RECORDS, ("behavior", "action", "user", "content", "calls"))
    c = F.col
    found = contracts.training_violations(c("behavior"), c("action"), c("user"), c("content"), F.from_json("calls", CALLS), scoring.TASK_TOOLS, scoring.action_tool(c("action")))
    return rows.select("p_partkey", found.alias("violations"))


#: (arguments, prompt, what isn't grounded, whether the id is written anywhere)
GROUNDS = (
    ('{"id": 7}', "việc 7", [], True), ('{"id": 7}', "việc 17", ["id_not_grounded"], True), ('{"id": 7}', "việc #7.", [], True), ('{"id": 7}', "việc 07", [], True), ('{"id": 7}', "", ["id_not_grounded"], False), ('{"content": "mua sữa"}', "thêm mua sữa", [], None),
    ('{"content": "Mua sữa"}', "thêm mua sữa", ["content_not_verbatim"], None), ('{"when": "8:00"}', "lúc 18:00", [], None), ('{"when": "9:00"}', "lúc 18:00", ["when_not_verbatim"], None), ('{"scope": "today"}', "việc hôm nay", [], None),
    ('{"scope": "overdue"}', "việc TRỄ HẠN", [], None), ('{"scope": "today"}', "việc mai", ["scope_not_grounded"], None), ('{"scope": "never"}', "việc mai", ["scope_not_grounded"], None), ("{}", "x", [], None), ('{"id": 3, "content": "a", "when": "b"}', "b 33", ["content_not_verbatim", "id_not_grounded"], True),
)


@query("grounding", expected("part", "p_partkey", "errors, written", [g[2:] for g in GROUNDS]))
def grounding(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", GROUNDS, ("a", "p"))
    return rows.select("p_partkey", contracts.grounding_errors(F.col("a"), F.col("p")).alias("errors"), contracts.id_written(F.col("a"), F.col("p")).alias("written"))


#: (behavior, reply, violations)
TARGETS = (
    ("clarify", "việc nào?", []), ("clarify", "cho tôi biết ID", ["no_question"]), ("clarify", "Tôi đã lưu. Việc nào?", ["implied_change"]), ("clarify", "Tôi sẽ xóa việc", ["no_question", "implied_change"]), ("no_action", "chào bạn", []),
    ("no_action", "Đã thêm việc", ["implied_change"]), ("no_action", "Vâng! ĐÃ HOÀN TẤT", ["implied_change"]), ("no_action", "bạn đã lưu việc này chưa", []), ("no_action", "Trợ lý sẽ cập nhật", ["implied_change"]), ("no_action", "việc đã thêm", []), ("call", "Tôi đã lưu", []),
    ("no_action", "đã  sửa", ["implied_change"]), ("no_action", "đã sửađổi", []),
)


@query("reply_contract", expected("part", "p_partkey", "violations", [(v,) for *_, v in TARGETS]))
def reply_contract(spark: SparkSession, d: str) -> DataFrame:
    return dealt(spark, d, "part", "p_partkey", TARGETS, ("b", "r")).select("p_partkey", contracts.reply_violations(F.col("b"), F.col("r")).alias("violations"))


@query("forbidden_markers", "SELECT doc_id, list_filter(['the ', '###', 'DER '], lambda m: contains(lower(text), lower(m))) AS markers FROM documents")
def forbidden_markers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", contracts.forbidden_markers(F.col("text"), ["the ", "###", "DER "]).alias("markers"))


def criteria(*told: tuple[str, str]) -> str:
    return json.dumps({c: {"result": r, "evidence": e} for c, (r, e) in zip(contracts.CRITERIA, told, strict=False)})


PENDING, NOT, SEEN = ("pending", ""), ("not_applicable", ""), ("pass", "seen")
#: (criteria, reviewable, behavior, reviewer, kind, violations)
REVIEWS = (
    (criteria(PENDING, PENDING, PENDING, PENDING), True, "clarify", "", "", []), (criteria(NOT, PENDING, PENDING, PENDING), True, "call", "", "", []), (criteria(PENDING, PENDING, PENDING, PENDING), True, "call", "", "", ["not_scorable:asks_missing"]),
    (criteria(NOT, NOT, NOT, NOT), False, "clarify", "", "", []), (criteria(NOT, SEEN, NOT, NOT), False, "call", "A", "human", ["not_scorable:avoids_reasking_known"]), (criteria(SEEN, SEEN, SEEN, SEEN), True, "clarify", "A", "human", []),
    (criteria(SEEN, SEEN, SEEN, SEEN), True, "clarify", "", "human", [f"no_reviewer:{c}" for c in contracts.CRITERIA]), (criteria(SEEN, SEEN, SEEN, SEEN), True, "clarify", "A", "robot", [f"no_reviewer:{c}" for c in contracts.CRITERIA]),
    (criteria(("pass", " "), PENDING, PENDING, PENDING), True, "clarify", "A", "human", ["no_evidence:asks_missing"]), (criteria(NOT, PENDING, PENDING, PENDING), True, "clarify", "A", "human", ["skipped:asks_missing", "no_evidence:asks_missing"]),
    (criteria(NOT, PENDING, NOT, PENDING), True, "call", "A", "human", ["skipped:no_premature_success", "no_evidence:no_premature_success"]), (criteria(NOT, ("not_applicable", "none known"), PENDING, PENDING), True, "call", "A", "assistant", []),
    (criteria(NOT, ("great", "x"), PENDING, PENDING), True, "call", "A", "human", ["unknown_result:avoids_reasking_known"]), (criteria(NOT, PENDING, PENDING), True, "call", "A", "human", ["criteria"]), (criteria(NOT, ("fail", "asks again"), PENDING, PENDING), True, "no_action", "A", "human", []),
)
CRITERIA_KIND = "map<string,struct<result:string,evidence:string>>"


@query("review_criteria", expected("part", "p_partkey", "violations, to_fill", [(r[-1], 0 if not r[1] else 4 if r[2] == "clarify" else 3) for r in REVIEWS]))
def review_criteria(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", [(r[0], str(r[1]).lower(), *r[2:]) for r in REVIEWS], ("c", "can", "b", "who", "kind"))
    rows = rows.withColumns({"read": F.from_json("c", CRITERIA_KIND), "can": F.col("can").cast("boolean")})  # a column of its own, as the checks ask for it many times
    can = F.col("can")
    found = contracts.criteria_violations(F.col("read"), can, F.col("b"), F.col("who"), F.col("kind"))
    blank = contracts.review_template(can, F.col("b"))
    return rows.select("p_partkey", found.alias("violations"), F.size(F.filter(F.map_values(blank), lambda v: v["result"] == "pending")).alias("to_fill"))


#: (id, behavior, prompt, status, response, violations)
REPORTS = (
    ("a", "call", "p", "pass", "{}", []), ("", "call", "p", "pass", "{}", ["missing_id"]), ("a", "sing", "p", "pass", "{}", ["unknown_behavior"]), ("a", "call", None, "pass", "{}", ["missing_prompt"]), ("a", "call", "p", "done", "{}", ["unknown_status"]),
    ("a", "call", "p", "error", None, []), ("a", "call", "p", "error", "{}", ["response_of_status"]), ("a", "call", "p", "fail", None, ["response_of_status"]), (None, None, None, None, None, ["missing_id", "unknown_behavior", "missing_prompt", "unknown_status"]),
)


@query("report_contract", expected("part", "p_partkey", "violations", [(r[-1],) for r in REPORTS]))
def report_contract(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", REPORTS, ("i", "b", "p", "s", "r"))
    return rows.select("p_partkey", contracts.report_violations(*[F.col(x) for x in "ibpsr"]).alias("violations"))


@query("case_digests", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","id":' || p_partkey || ',"name":"' || p_name || '"}') AS digest FROM part""")
def case_digests(spark: SparkSession, d: str) -> DataFrame:
    snapshot = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return read(spark, d, "part").select("p_partkey", contracts.case_digest(snapshot).alias("digest"))


@query("training_records", "SELECT conv_id, turn, 2 AS messages, 'You keep tasks.' AS first, text AS last, '[]' AS tools FROM conversations")
def training_records(spark: SparkSession, d: str) -> DataFrame:
    record = contracts.training_record("You keep tasks.", F.array(F.struct(F.col("role"), F.col("text").alias("content"))), "[]")
    rows = read(spark, d, "conversations").select("conv_id", "turn", record.alias("r"))
    return rows.select("conv_id", "turn", F.size("r.messages").alias("messages"), F.get("r.messages", F.lit(0))["content"].alias("first"), F.get("r.messages", F.lit(1))["content"].alias("last"), F.col("r.tools").alias("tools"))


#: (line, whether a single insert takes it); (run id, whether it is safe)
LINES = (("a", True), ("", False), ("  ", False), (" ", False), ("a\nb", False), ("a\rb", False), (" a ", True), ("a\n", False), ("é", True))
RUN_IDS = (("run-1", True), ("", False), (".hidden", False), ("a/b", False), ("a b", False), ("a" * 128, True), ("a" * 129, False), ("A_1.b-c", True), ("é", False))


@query("name_rules", expected("part", "p_partkey", "line_ok, run_ok", [(a, b) for (_, a), (_, b) in zip(LINES, RUN_IDS, strict=True)]))
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(spark, d, "part", "p_partkey", [(a, b) for (a, _), (b, _) in zip(LINES, RUN_IDS, strict=True)], ("line", "run"))
    return rows.select("p_partkey", store.valid_line(F.col("line")).alias("line_ok"), text.safe_run_id(F.col("run")).alias("run_ok"))


PERIODS = ("", "sáng", "chiều", "tối")


@query("deadline_clock", f"""SELECT o_orderkey, CASE p WHEN '' THEN CASE WHEN h <= 23 THEN h END ELSE CASE WHEN h BETWEEN 1 AND 12 THEN CASE WHEN p = 'sáng' THEN h % 12 WHEN h = 12 THEN 12 ELSE h + 12 END END END AS hour
    FROM (SELECT o_orderkey, (o_orderkey % 100 // 4)::INT AS h, {list(PERIODS)}[o_orderkey % 4 + 1] AS p FROM orders)""")
def deadline_clock(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    hour, period = F.floor(key % 100 / 4).cast("int"), F.element_at(F.array(*[F.lit(p) for p in PERIODS]), (key % 4 + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", deadlines.clock_24(hour, period).alias("hour"))


# -- audits -------------------------------------------------------------------------------------------------------------


@query("dataset_audit", """WITH dup AS (SELECT p_name AS x FROM part GROUP BY 1 HAVING count(*) > 1), quota AS (SELECT k || ' ' || n AS x FROM (SELECT coalesce(p_size::VARCHAR, k) AS k, coalesce(n, 0) AS n, coalesce(e, 0) AS e
      FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1) FULL JOIN (VALUES ('1', 4), ('2', 100000), ('99', 1)) q(k, e) ON p_size::VARCHAR = k) WHERE n <> e),
    fam AS (SELECT p_brand AS x FROM part GROUP BY 1 HAVING count(*) > 4 OR count(DISTINCT p_size) > 1), both_ AS (SELECT p_size::VARCHAR AS x FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_size::VARCHAR FROM part WHERE p_partkey % 2 = 1),
    kept AS (SELECT p_partkey::VARCHAR AS x FROM part WHERE p_partkey % 10 = 3), long AS (SELECT p_partkey || ' long' AS x FROM part WHERE length(p_name) > 12)
    SELECT 'repeated_id' AS "check", true AS ok, 0 AS offenders, NULL AS example UNION ALL SELECT 'repeated_name', count(*) = 0, count(*), min(x) FROM dup UNION ALL SELECT 'quota', count(*) = 0, count(*), min(x) FROM quota
    UNION ALL SELECT 'families', count(*) = 0, count(*), min(x) FROM fam UNION ALL SELECT 'shared', count(*) = 0, count(*), min(x) FROM both_ UNION ALL SELECT 'preserved', count(*) = 0, count(*), min(x) FROM kept UNION ALL SELECT 'contract', count(*) = 0, count(*), min(x) FROM long""")
def dataset_audit(spark: SparkSession, d: str) -> DataFrame:
    part, key = read(spark, d, "part"), F.col("p_partkey")
    changed = part.withColumn("p_name", F.when(key % 10 == 3, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")))
    return audits.check_rows({
        "repeated_id": audits.repeated(part, "p_partkey"), "repeated_name": audits.repeated(part, "p_name"), "quota": audits.unequal_counts(part, "p_size", {"1": 4, "2": 100000, "99": 1}),
        "families": audits.inconsistent_families(part, "p_brand", ["p_size"], 4), "shared": audits.shared(part.where(key % 2 == 0), part.where(key % 2 == 1), "p_size"),
        "preserved": audits.not_preserved(part, changed, "p_partkey", ["p_name", "p_size"]), "contract": audits.breaking(part, "p_partkey", text.tags((F.length("p_name") > 12, "long"))),
    })


@query("file_lock", "SELECT n_name AS path, CASE n_nationkey % 4 WHEN 1 THEN 'missing' ELSE 'changed' END AS problem FROM nation WHERE n_nationkey % 4 IN (1, 2)")
def file_lock(spark: SparkSession, d: str) -> DataFrame:
    nation, k = read(spark, d, "nation"), F.col("n_nationkey") % 4
    manifest = nation.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("sha256"))
    files = nation.where(k != 1).select(F.col("n_name").alias("path"), F.sha2(F.when(k == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")), 256).alias("sha256"))
    return audits.changed_files(manifest, files)


@query("manifest_differences", """SELECT coalesce(e.key, a.key) AS key, e.n AS expected, a.n AS actual FROM (SELECT p_brand AS key, count(*) AS n FROM part WHERE p_size <> 7 GROUP BY 1) e
    FULL JOIN (SELECT p_brand AS key, count(*) AS n FROM part WHERE p_size <> 9 GROUP BY 1) a USING (key) WHERE e.n IS DISTINCT FROM a.n""")
def manifest_differences(spark: SparkSession, d: str) -> DataFrame:
    counts = lambda rows: rows.groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("value"))
    part = read(spark, d, "part")
    return audits.manifest_differences(counts(part.where("p_size <> 7")), counts(part.where("p_size <> 9")))


@query("extended_dataset", "SELECT p_partkey % 2 AS part, p_partkey // 2 + CASE WHEN p_partkey % 2 = 1 THEN (SELECT max(p_partkey // 2) + 1 FROM part WHERE p_partkey % 2 = 0) ELSE 0 END AS ordinal FROM part")
def extended_dataset(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select((F.col("p_partkey") % 2).alias("part"), F.floor(F.col("p_partkey") / 2).alias("ordinal"))
    return audits.extend(rows.where("part = 0"), rows.where("part = 1"))


@query("scripted_responses", "SELECT p_partkey AS id, s_name AS response FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def scripted(spark: SparkSession, d: str) -> DataFrame:
    cases = read(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return scripted_responses(cases, read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("response")))


GATE_FLAGS = {
    "complete": "l_linestatus = 'F'", "all_steps": "l_linenumber = 3", "finite_loss": "l_linenumber <> 5", "ran": "l_quantity > 1", "same_tokens": "l_tax < 0.06", "loss_fell": "l_discount < 0.05", "accuracy": "l_discount <= 0.07",
    "weights_changed": "l_linenumber <> 2", "weights_reload": "l_linenumber <> 4",
}


@query("training_gates", " UNION ALL ".join(f"""SELECT l_orderkey * 10 + l_linenumber AS run, '{k}' AS "check", {v} AS ok FROM lineitem""" for k, v in GATE_FLAGS.items()))
def training_gates(spark: SparkSession, d: str) -> DataFrame:
    c, line = F.col, F.col("l_linenumber")
    report = read(spark, d, "lineitem").select(
        (c("l_orderkey") * 10 + line).alias("run"), F.when(c("l_linestatus") == "F", "complete").otherwise("running").alias("status"), line.alias("completed_steps"), F.when(line == 5, float("nan")).otherwise(0.5).alias("training_loss"),
        (c("l_quantity") - 1).alias("runtime_seconds"), F.lit(100).alias("tokens_before"), F.when(c("l_tax") < 0.06, 100).otherwise(99).alias("tokens_after"), F.lit(0.05).alias("loss_before"), c("l_discount").alias("loss_after"),
        (c("l_discount") - 0.07 + 1).alias("accuracy_raw"), F.lit("a").alias("state_before"), F.when(line == 2, "a").otherwise("b").alias("state_after"),
        F.when(line == 4, "c").when(line == 2, "a").otherwise("b").alias("state_reloaded"),
    )
    report = report.withColumn("accuracy_after", F.when(F.round("accuracy_raw", 6) <= 1, 0.5).otherwise(1.5))
    return audits.evidence_gates(report, audits.training_gates(3), "run")


#: lineitem as attributed failures: the order is the case, the line the configuration.
OWNERS, CAUSES, DISPOSITIONS, LABELS = ("model", "routing", "prompt"), ("wrong_slot", "routing_wrong_exposure", "missed_call"), ("sft_target", "architecture_only", "none"), ("accepted", "disputed")
FAILURES = f"""(SELECT l_orderkey AS "case", 'c' || l_linenumber AS configuration, {list(OWNERS)}[l_linenumber % 3 + 1] AS owner, {list(CAUSES)}[(l_linenumber + (l_orderkey % 50 = 0)::INT) % 3 + 1] AS cause,
    {list(DISPOSITIONS)}[l_orderkey % 3 + 1] AS disposition, {list(LABELS)}[(l_orderkey % 11 = 0)::INT + 1] AS label, l_quantity > 45 AS shown FROM lineitem)"""


def failures(spark: SparkSession, d: str) -> DataFrame:
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    return read(spark, d, "lineitem").select(
        key.alias("case"), F.concat(F.lit("c"), line).alias("configuration"), pick(OWNERS, line % 3).alias("owner"), pick(CAUSES, (line + (key % 50 == 0).cast("int")) % 3).alias("cause"),
        pick(DISPOSITIONS, key % 3).alias("disposition"), pick(LABELS, (key % 11 == 0).cast("int")).alias("label"), (F.col("l_quantity") > 45).alias("shown"),
    )


@query("attribution_summary", f"""SELECT 'owner' AS section, owner AS name, count(*) AS n FROM {FAILURES} GROUP BY owner UNION ALL SELECT 'cause', cause, count(*) FROM {FAILURES} GROUP BY cause UNION ALL SELECT 'configuration', configuration, count(*) FROM {FAILURES} GROUP BY configuration
    UNION ALL SELECT 'disposition', disposition, count(DISTINCT "case") FROM {FAILURES} GROUP BY disposition UNION ALL SELECT 'label', label, count(DISTINCT "case") FROM {FAILURES} GROUP BY label""")
def attribution_summary(spark: SparkSession, d: str) -> DataFrame:
    return audits.attribution_summary(failures(spark, d))


@query("attribution_audit", f"""WITH f AS (SELECT * FROM {FAILURES}), g AS (SELECT "case", bool_and(cause = 'routing_wrong_exposure') AS ex, bool_or(owner = 'model') AS md, min(disposition) AS dis, min(label) AS lab FROM f GROUP BY 1)
    SELECT 'missing_attribution' AS "check", count(*) = 0 AS ok, count(*) AS offenders FROM f WHERE shown AND configuration = 'c7' UNION ALL SELECT 'unknown_failure', count(*) = 0, count(*) FROM f WHERE NOT shown AND configuration <> 'c7'
    UNION ALL SELECT 'taxonomy', count(*) = 0, count(*) FROM f WHERE configuration <> 'c7' AND cause = 'missed_call' UNION ALL SELECT 'routing_owner', count(*) = 0, count(*) FROM f WHERE configuration <> 'c7' AND (cause = 'routing_wrong_exposure') <> (owner = 'routing')
    UNION ALL SELECT 'exposure_disposition', count(*) = 0, count(*) FROM h WHERE ex <> (dis = 'architecture_only') UNION ALL SELECT 'target_of_model', count(*) = 0, count(*) FROM h WHERE dis = 'sft_target' AND NOT md
    UNION ALL SELECT 'target_label', count(*) = 0, count(*) FROM h WHERE dis = 'sft_target' AND lab <> 'accepted'""".replace("g AS (SELECT", "h AS (SELECT").replace("FROM f GROUP BY 1)", "FROM f WHERE configuration <> 'c7' GROUP BY 1)"))
def attribution_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = failures(spark, d)
    taxonomy = {"owner": OWNERS, "cause": CAUSES[:2], "disposition": DISPOSITIONS, "label": LABELS}
    return audits.attribution_audit(rows.where("configuration <> 'c7'"), rows.where("shown"), taxonomy).drop("example")


@query("observations", """SELECT * FROM (SELECT l_orderkey AS "case", min(CASE WHEN l_linenumber = 1 THEN s END) AS c1, min(CASE WHEN l_linenumber = 2 THEN s END) AS c2, min(CASE WHEN l_linenumber = 3 THEN s END) AS c3,
    list_filter([min(CASE WHEN l_linenumber = 1 AND s = 'fail' THEN 'c1' END), min(CASE WHEN l_linenumber = 2 AND s = 'fail' THEN 'c2' END), min(CASE WHEN l_linenumber = 3 AND s = 'fail' THEN 'c3' END)], lambda x: x IS NOT NULL) AS failed
    FROM (SELECT *, CASE WHEN l_quantity > 30 THEN 'fail' ELSE 'pass' END AS s FROM lineitem WHERE l_linenumber <= 3) GROUP BY 1) WHERE len(failed) > 0""")
def observations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), F.concat(F.lit("c"), "l_linenumber").alias("configuration"), F.when(F.col("l_quantity") > 30, "fail").otherwise("pass").alias("status"))
    return audits.observations(rows, ["c1", "c2", "c3"])


SEMANTIC = "(SELECT 'm' || l_linenumber AS model, l_orderkey AS id, CASE WHEN l_quantity > 20 THEN 'pass' ELSE 'fail' END AS decision FROM lineitem)"


def semantic(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.concat(F.lit("m"), "l_linenumber").alias("model"), F.col("l_orderkey").alias("id"), F.when(F.col("l_quantity") > 20, "pass").otherwise("fail").alias("decision"))


@query("semantic_summary", f"""SELECT model, count(*) FILTER (decision = 'pass') AS "pass", count(*) FILTER (decision = 'fail') AS "fail", count(*) AS total FROM {SEMANTIC} GROUP BY model""")
def semantic_summary(spark: SparkSession, d: str) -> DataFrame:
    return audits.semantic_summary(semantic(spark, d))


@query("review_decision", f"""SELECT *, CASE WHEN automatic_eligible AND manual_not_below THEN 'eligible' ELSE 'rejected' END AS candidate_status FROM (SELECT *, true AS automatic_eligible, candidate_pass >= baseline_pass AS manual_not_below
    FROM (SELECT count(*) FILTER (model = 'm5' AND decision = 'pass') AS baseline_pass, count(*) FILTER (model = 'm2' AND decision = 'pass') AS candidate_pass FROM {SEMANTIC}))""")
def review_decision(spark: SparkSession, d: str) -> DataFrame:
    return audits.review_decision(semantic(spark, d), spark.range(1).select(F.lit(True).alias("eligible")), "m5", "m2")


@query("design_audit", """WITH e AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'dev' ELSE 'final' END AS split, o_custkey AS case_id, [o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE 'F' END] AS cats FROM orders),
    n AS (SELECT id, count(*) AS n FROM (SELECT unnest(cats) AS id FROM e) GROUP BY 1), t AS (SELECT * FROM (VALUES ('F', 5, 100), ('O', 1, 60), ('P', 1, 0)) t(id, evidence_cases, new_examples))
    SELECT 'unknown_case' AS "check", count(*) = 0 AS ok, count(*) AS offenders FROM e WHERE split = 'final' AND case_id % 3 = 0 UNION ALL SELECT 'repeated_case', count(*) = 0, count(*) FROM (SELECT 1 FROM e GROUP BY split, case_id HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_category', count(*) = 0, count(*) FROM (SELECT unnest(cats) AS id FROM e) WHERE id = 'X' UNION ALL SELECT 'repeated_category', true, 0
    UNION ALL SELECT 'evidence_count', count(*) = 0, count(*) FROM t LEFT JOIN n USING (id) WHERE evidence_cases <> coalesce(n, 0) UNION ALL SELECT 'no_new_examples', false, 1 UNION ALL SELECT 'allocation', false, 1""")
def design_audit(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("o_orderkey") % 2 == 0, "dev").otherwise("final")
    evidence = read(spark, d, "orders").select(split.alias("split"), F.col("o_custkey").alias("case_id"), F.array("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "X").otherwise("F")).alias("categories"))
    cases = read(spark, d, "orders").select(F.explode(F.array(F.lit("dev"), F.lit("final"))).alias("split"), F.col("o_custkey").alias("case_id")).distinct().where("split = 'dev' OR case_id % 3 <> 0")
    taxonomy = spark.createDataFrame([("F", 5, 100), ("O", 1, 60), ("P", 1, 0)], "id string, evidence_cases long, new_examples long")
    return audits.design_audit(evidence, cases, taxonomy, 200).drop("example")


@query("subset_audit", """WITH w AS (SELECT unnest([1, 2, 3, 3, 5, 100000000]) AS id), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT id FROM w)), c AS (SELECT p_size::VARCHAR AS k, count(*) AS n FROM p GROUP BY 1)
    SELECT 'unknown' AS "check", false AS ok, 1 + (SELECT count(*) FROM (VALUES (1), (2), (3), (3), (5)) v(x) WHERE x NOT IN (SELECT p_partkey FROM part)) AS offenders UNION ALL SELECT 'repeated', false, 1 UNION ALL SELECT 'size', true, 0
    UNION ALL SELECT 'quota:p_size', count(*) = 0, count(*) FROM (SELECT k FROM c WHERE k <> '7' OR n <> 1 UNION ALL SELECT '7' WHERE '7' NOT IN (SELECT k FROM c))""")
def subset_audit(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 3, 5, 100000000)], "p_partkey long")
    return audits.subset_audit(wanted, read(spark, d, "part"), "p_partkey", 6, {"p_size": {"7": 1}}).drop("example")
