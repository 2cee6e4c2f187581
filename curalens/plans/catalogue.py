"""Registered queries over the driver's tables, with the SQL that must give the same rows.

orders play the tasks, conversations the turns, documents and benchmark the corpora, labels the review decisions, lineitem
the scored rows (flag = behavior, status F = pass and O = fail), events the logs of runs (user = run).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import deadlines, jsontext, text, tokens
from ..operators import audits, compare, leakage, rollups, tasks, validate
from ..sources import cases as case_sources
from ..sources import documents
from ..sources.tables import commit_snapshot, read, read_snapshot, shared_folder
from ..sources.tables import tasks as task_table
from ..streaming import automata, lifecycle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The reference time of the due queries; orders' dates surround it.
NOW = "1998-06-15 10:00:00"
TASKS = "(SELECT o_orderkey AS id, o_orderpriority AS content, o_orderstatus = 'F' AS completed, epoch(o_orderdate)::BIGINT AS due_at FROM orders)"
DAY0 = f"epoch(timezone('Asia/Ho_Chi_Minh', date_trunc('day', timezone('Asia/Ho_Chi_Minh', TIMESTAMPTZ '{NOW}+00'))))::BIGINT"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


# -- task store ---------------------------------------------------------------------------------------------------------


@query("tasks_list", f"SELECT * FROM {TASKS} ORDER BY id")
def tasks_list(spark: SparkSession, d: str) -> DataFrame:
    return task_table(spark, d).orderBy("id")


@query("task_lookup", f"SELECT * FROM {TASKS} WHERE id = 7")
def task_lookup(spark: SparkSession, d: str) -> DataFrame:
    return task_table(spark, d).where(F.col("id") == 7)


for _scope, _test in (
    ("today", f"due_at >= {DAY0} AND due_at < {DAY0} + 86400"),
    ("tomorrow", f"due_at >= {DAY0} + 86400 AND due_at < {DAY0} + 172800"),
    ("overdue", f"due_at < epoch(TIMESTAMP '{NOW}')::BIGINT"),
):

    @query(f"tasks_{'overdue' if _scope == 'overdue' else 'due_' + _scope}", f"SELECT id, content, due_at FROM {TASKS} WHERE NOT completed AND due_at IS NOT NULL AND {_test}")
    def _due(spark: SparkSession, d: str, scope: str = _scope) -> DataFrame:
        return tasks.due(task_table(spark, d), scope, now()).select("id", "content", "due_at").orderBy("due_at", "id")


@query(
    "tasks_scopes_overlap",
    f"SELECT count(*) FILTER (due_at >= {DAY0} AND due_at < {DAY0} + 86400) AS today, count(*) FILTER (due_at < epoch(TIMESTAMP '{NOW}')::BIGINT) AS overdue, "
    f"count(*) FILTER (due_at >= {DAY0} AND due_at < epoch(TIMESTAMP '{NOW}')::BIGINT) AS both FROM {TASKS} WHERE NOT completed",
)
def tasks_scopes_overlap(spark: SparkSession, d: str) -> DataFrame:
    at, start, end = F.col("due_at"), deadlines.local_day_start(now()), deadlines.local_day_start(now(), 1)
    is_today, is_over = (at >= start) & (at < end), at < F.unix_seconds(now())
    open_tasks = task_table(spark, d).where(~F.col("completed"))
    return open_tasks.agg(F.count_if(is_today).alias("today"), F.count_if(is_over).alias("overdue"), F.count_if(is_today & is_over).alias("both"))


COMMANDS = "(SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS id FROM orders)"


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A command for every order; each fifth names a task that doesn't exist."""
    key = F.col("o_orderkey")
    return read(spark, d, "orders").select(key.alias("seq"), F.when(key % 5 == 0, key + 100000000).otherwise(key).alias("id"))


@query(
    "complete_commands",
    f"SELECT seq, c.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN completed THEN 'already_completed' ELSE 'completed' END AS status FROM {COMMANDS} c LEFT JOIN {TASKS} t ON c.id = t.id",
)
def complete_commands(spark: SparkSession, d: str) -> DataFrame:
    return tasks.complete(task_table(spark, d), commands(spark, d))


@query(
    "update_commands",
    f"SELECT seq, c.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN content = '1-URGENT' THEN 'unchanged' ELSE 'updated' END AS status FROM {COMMANDS} c LEFT JOIN {TASKS} t ON c.id = t.id",
)
def update_commands(spark: SparkSession, d: str) -> DataFrame:
    return tasks.update_content(task_table(spark, d), commands(spark, d).withColumn("content", F.lit("1-URGENT")))


UNSET = f"(SELECT id, content, completed, CASE WHEN id % 3 = 0 THEN NULL ELSE due_at END AS due_at FROM {TASKS})"


def some_without_deadline(spark: SparkSession, d: str) -> DataFrame:
    return task_table(spark, d).withColumn("due_at", F.when(F.col("id") % 3 != 0, F.col("due_at")))


@query(
    "deadline_commands",
    f"SELECT seq, c.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN due_at IS NULL THEN 'set' WHEN due_at = 900000000 THEN 'unchanged' ELSE 'updated' END AS status FROM {COMMANDS} c LEFT JOIN {UNSET} t ON c.id = t.id",
)
def deadline_commands(spark: SparkSession, d: str) -> DataFrame:
    return tasks.set_deadline(some_without_deadline(spark, d), commands(spark, d).withColumn("due_at", F.lit(900000000).cast("long")))


@query(
    "guarded_delete",
    f"SELECT seq, c.id, CASE WHEN t.id IS NULL THEN 'not_found' WHEN c.id % 2 = 0 OR (content = '1-URGENT' AND NOT completed AND due_at IS NULL) THEN 'deleted' ELSE 'stale' END AS status FROM {COMMANDS} c LEFT JOIN {UNSET} t ON c.id = t.id",
)
def guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    snapshot = F.struct(F.col("id"), F.lit("1-URGENT").alias("content"), F.lit(False).alias("completed"), F.lit(None).cast("long").alias("due_at"))
    return tasks.guarded_delete(some_without_deadline(spark, d), commands(spark, d).withColumn("expected", F.when(F.col("id") % 2 != 0, snapshot)))


@query(
    "next_snapshot",
    f"SELECT id, CASE WHEN id % 4 = 1 THEN 'new' ELSE content END AS content, completed OR id % 4 = 0 AS completed, CASE WHEN id % 4 = 2 THEN 5 ELSE due_at END AS due_at FROM {TASKS} WHERE id % 4 <> 3",
)
def next_snapshot(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 4
    op = F.when(k == 0, "complete").when(k == 1, "update").when(k == 2, "deadline").otherwise("delete")
    changes = task_table(spark, d).select("id", op.alias("op"), F.lit("new").alias("content"), F.lit(5).cast("long").alias("due_at"))
    return tasks.apply_changes(task_table(spark, d), changes)


#: Customers as tasks, and events as commands on them: several on each, on some after a deletion, on others without a task.
COMMAND_SQL = """WITH RECURSIVE cmds AS (
    SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'view' THEN 'update' WHEN 'click' THEN 'deadline' WHEN 'purchase' THEN 'complete' ELSE 'delete' END AS op,
      'A' || event_id % 2 AS content, event_id % 3 AS due, event_type = 'error' AS guarded, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  run AS (
    SELECT c_custkey AS id, 0 AS n, true AS alive, c_mktsegment AS content, c_acctbal < 0 AS done, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey::BIGINT END AS due_at, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS status FROM customer
    UNION ALL SELECT r.id, c.n, alive AND NOT (c.op = 'delete' AND (NOT guarded OR (r.content = c.content AND done AND due_at = due))),
      CASE WHEN c.op = 'update' THEN c.content ELSE r.content END, done OR c.op = 'complete', CASE WHEN c.op = 'deadline' THEN due ELSE due_at END, c.seq, c.op,
      CASE WHEN NOT alive THEN 'not_found' WHEN c.op = 'complete' THEN CASE WHEN done THEN 'already_completed' ELSE 'completed' END
        WHEN c.op = 'update' THEN CASE WHEN r.content <> c.content THEN 'updated' ELSE 'unchanged' END
        WHEN c.op = 'deadline' THEN CASE WHEN due_at IS NULL THEN 'set' WHEN due_at = due THEN 'unchanged' ELSE 'updated' END
        WHEN NOT guarded OR (r.content = c.content AND done AND due_at IS NOT DISTINCT FROM due) THEN 'deleted' ELSE 'stale' END
    FROM run r JOIN cmds c ON c.id = r.id AND c.n = r.n + 1)"""


def command_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    due_at = F.when(F.col("c_nationkey") % 3 > 0, F.col("c_nationkey").cast("long"))
    held = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("content"), (F.col("c_acctbal") < 0).alias("completed"), due_at.alias("due_at"))
    k, kind = F.col("event_id"), F.col("event_type")
    op = F.when(kind == "view", "update").when(kind == "click", "deadline").when(kind == "purchase", "complete").otherwise("delete")
    content, due = F.concat(F.lit("A"), (k % 2).cast("string")), k % 3
    snapshot = F.struct(F.col("user_id").alias("id"), content.alias("content"), F.lit(True).alias("completed"), due.alias("due_at"))
    told = read(spark, d, "events").select(
        k.alias("seq"), F.col("user_id").alias("id"), op.alias("op"), content.alias("content"), due.alias("due_at"), F.when(kind == "error", snapshot).alias("expected")
    )
    return held, told


@query("command_log", COMMAND_SQL + """SELECT seq, c.id, c.op, coalesce(r.status, 'not_found') AS status FROM cmds c LEFT JOIN (SELECT seq, status FROM run WHERE seq IS NOT NULL) r USING (seq)""")
def command_log(spark: SparkSession, d: str) -> DataFrame:
    return tasks.commands_in_order(*command_tables(spark, d), block=1000)


@query("command_snapshot", COMMAND_SQL + """SELECT id, content, done AS completed, due_at FROM run WHERE alive QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1
    AND id NOT IN (SELECT id FROM run WHERE NOT alive)""")
def command_snapshot(spark: SparkSession, d: str) -> DataFrame:
    held, told = command_tables(spark, d)
    return tasks.after_commands(held, told, tasks.commands_in_order(held, told, block=1000))


@query(
    "insert_lines",
    """SELECT (1000000 + row_number() OVER (ORDER BY doc_id, pos))::BIGINT AS id, content, false AS completed, NULL::BIGINT AS due_at FROM (
    SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS content, unnest(range(len(string_split_regex(text, '\\r\\n|\\r|\\n')))) AS pos FROM documents)
    WHERE trim(content, E' \\t\\n\\x0B\\f\\r') <> ''""",
)
def insert_lines(spark: SparkSession, d: str) -> DataFrame:
    return tasks.insert_lines(read(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text"), 1000000)


@query("replaced_snapshot", f"SELECT id, content, completed, due_at, 1 AS version FROM {TASKS} WHERE NOT completed UNION ALL SELECT id, content, completed, due_at, 0 FROM {TASKS}")
def replaced_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """A table of tasks that is replaced by its own open tasks: the newest version, and the one before, which can still be read."""
    path = shared_folder(spark, "snapshots")
    first = commit_snapshot(task_table(spark, d), path)
    second = commit_snapshot(read_snapshot(spark, path).where(~F.col("completed")), path, after=first)
    return read_snapshot(spark, path).withColumn("version", F.lit(second)).unionByName(read_snapshot(spark, path, first).withColumn("version", F.lit(first)))


@query("migrate_layout", f"SELECT id, content, false AS completed, NULL::BIGINT AS due_at FROM {TASKS}")
def migrate_layout(spark: SparkSession, d: str) -> DataFrame:
    return tasks.migrate(task_table(spark, d).select("id", "content"))


# -- deadlines and text rules -------------------------------------------------------------------------------------------


@query("deadline_format", f"SELECT id, strftime(timezone('Asia/Ho_Chi_Minh', to_timestamp(due_at)), '%d/%m/%Y %H:%M') AS shown FROM {TASKS}")
def deadline_format(spark: SparkSession, d: str) -> DataFrame:
    return task_table(spark, d).select("id", deadlines.format_deadline(F.col("due_at")).alias("shown"))


@query("deadline_parse", f"SELECT id, (due_at // 60) * 60 AS parsed, CASE id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'time' WHEN 2 THEN 'colon' ELSE 'bad' END AS form FROM {TASKS} WHERE id % 4 < 2 "
       f"UNION ALL SELECT id, epoch(timezone('Asia/Ho_Chi_Minh', date_trunc('day', timezone('Asia/Ho_Chi_Minh', TIMESTAMPTZ '{NOW}+00')) + INTERVAL 1 DAY + to_hours(id % 24)))::BIGINT, 'colon' FROM {TASKS} WHERE id % 4 = 2 "
       f"UNION ALL SELECT id, NULL, 'bad' FROM {TASKS} WHERE id % 4 = 3")  # fmt: skip
def deadline_parse(spark: SparkSession, d: str) -> DataFrame:
    local = F.from_utc_timestamp(F.timestamp_seconds("due_at"), deadlines.ZONE)
    form = F.element_at(F.array(*[F.lit(x) for x in ("date", "time", "colon", "bad")]), (F.col("id") % 4 + 1).cast("int"))
    shown = (
        F.when(form == "date", F.date_format(local, "d/M/yyyy H:mm")).when(form == "time", F.concat(F.date_format(local, "HH:mm"), F.lit(" ngày "), F.date_format(local, "dd/MM/yyyy.")))
        .when(form == "colon", F.concat((F.col("id") % 24).cast("string"), F.lit(":00 mai"))).otherwise(F.lit("30/02/2026 08:00"))
    )
    return task_table(spark, d).select("id", deadlines.parse_deadline(shown, now()).alias("parsed"), form.alias("form"))


@query("text_id_tokens", "SELECT event_id, regexp_extract_all(props, '[0-9]+')[1] AS first_id, len(regexp_extract_all(props, '[0-9]+'))::INT AS n FROM events")
def text_id_tokens(spark: SparkSession, d: str) -> DataFrame:
    found = text.id_tokens(F.col("props"))
    return read(spark, d, "events").select("event_id", F.get(found, F.lit(0)).alias("first_id"), F.size(found).alias("n"))


@query("text_id_grounded", "SELECT event_id, list_contains(list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: x::BIGINT), event_id % 100) AS ok FROM events")
def text_id_grounded(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", text.id_grounded(F.col("event_id") % 100, F.col("props")).alias("ok"))


@query("text_any_term", "SELECT conv_id, turn, contains(lower(text), 'the ') OR contains(lower(text), 'der ') AS hit FROM conversations")
def text_any_term(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.any_term(F.col("text"), ["the ", "der "]).alias("hit"))


def generated(spark: SparkSession, d: str) -> DataFrame:
    """Generated texts: a good call, one with text beside it, two calls, a tag without end, JSON with a key twice, a reply."""
    call = F.format_string('<tool_call>{"name": "get", "arguments": {"id": %d}}</tool_call>', F.col("p_partkey"))
    twice = F.lit('<tool_call>{"name": "a", "name": "b", "arguments": {}}</tool_call>')
    forms = F.array(F.concat(call, F.lit("<|im_end|>")), F.concat(F.lit("ok "), call), F.concat(call, F.lit("\n"), call), F.lit("<tool_call>{"), twice, F.lit("a reply"))
    return read(spark, d, "part").select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 6 + 1).cast("int")).alias("t"))


@query("tool_call_extract", """SELECT p_partkey, CASE p_partkey % 6 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 5 THEN 0 ELSE 1 END AS n_calls,
    CASE p_partkey % 6 WHEN 1 THEN ['extra_text'] WHEN 2 THEN ['multiple_calls'] WHEN 3 THEN ['malformed_tool_call_tag'] WHEN 4 THEN ['invalid_call_json'] ELSE [] END AS errors FROM part""")
def tool_call_extract(spark: SparkSession, d: str) -> DataFrame:
    return generated(spark, d).select("p_partkey", F.size(text.generated_calls(F.col("t"))).alias("n_calls"), text.generated_errors(F.col("t"), jsontext.canonicals(text.generated_calls(F.col("t")))).alias("errors"))


# -- roll-ups -----------------------------------------------------------------------------------------------------------

SCORED = "(SELECT l_returnflag AS behavior, CASE WHEN l_linenumber = 7 THEN 'error' WHEN l_linestatus = 'F' THEN 'pass' ELSE 'fail' END AS status, l_quantity AS seconds, l_linenumber AS tokens, l_orderkey AS family FROM lineitem)"
COUNTS = "count(*) AS total, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'error') AS error"


def scored(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("l_linenumber") == 7, "error").when(F.col("l_linestatus") == "F", "pass").otherwise("fail")
    return read(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("behavior"), status.alias("status"), F.col("l_quantity").alias("seconds"), F.col("l_linenumber").alias("tokens"), F.col("l_orderkey").alias("family")
    )


@query("proposal_summary", f"SELECT behavior, {COUNTS}, count(*) FILTER (status = 'pass') / nullif(count(*) FILTER (status <> 'error'), 0) AS accuracy FROM {SCORED} GROUP BY behavior")
def proposal_summary(spark: SparkSession, d: str) -> DataFrame:
    return rollups.status_summary(scored(spark, d), ["behavior"])


@query("category_rollup", f"SELECT behavior, grouping(behavior) = 1 AS is_total, {COUNTS} FROM {SCORED} GROUP BY ROLLUP (behavior)")
def category_rollup(spark: SparkSession, d: str) -> DataFrame:
    return rollups.with_total(scored(spark, d), "behavior")


@query("latency_metrics", f"""SELECT behavior, median(seconds) AS median_seconds, quantile_disc(seconds, 0.95) AS p95_seconds, sum(seconds) AS total_seconds, sum(tokens)::BIGINT AS total_tokens,
    sum(tokens) / sum(seconds) AS tokens_per_second FROM {SCORED} GROUP BY behavior""")
def latency_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rollups.latency(scored(spark, d), ["behavior"], "seconds", "tokens")


@query("length_stats", """WITH w AS (SELECT min(n_chars) AS least, median(n_chars) AS median, max(n_chars) AS greatest, sum(n_chars)::BIGINT AS total FROM documents)
    SELECT w.*, doc_id AS greatest_key FROM documents, w WHERE n_chars = greatest""")
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return rollups.length_stats(read(spark, d, "documents"), "n_chars", "doc_id")


@query("quota_check", """SELECT coalesce(a.lang, q.lang) AS lang, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS ok
    FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) a FULL JOIN (VALUES ('en', 600), ('de', 150), ('xx', 1)) q(lang, expected) ON a.lang = q.lang""")
def quota_check(spark: SparkSession, d: str) -> DataFrame:
    quota = spark.createDataFrame([("en", 600), ("de", 150), ("xx", 1)], "lang string, expected int")
    return rollups.quota_check(read(spark, d, "documents"), "lang", quota)


@query("family_consistency", f"SELECT family, count(*) AS members, count(DISTINCT (behavior, status)) AS signatures, count(DISTINCT (behavior, status)) = 1 AND count(*) <= 4 AS ok FROM {SCORED} GROUP BY family")
def family_consistency(spark: SparkSession, d: str) -> DataFrame:
    return rollups.family_check(scored(spark, d), "family", ["behavior", "status"])


@query("family_sizes", f"SELECT size, count(*) AS families FROM (SELECT count(*) AS size FROM {SCORED} GROUP BY family) GROUP BY size")
def family_sizes(spark: SparkSession, d: str) -> DataFrame:
    return rollups.count_of_counts(scored(spark, d), "family")


@query("multi_valued_summary", f"SELECT value, count(*) AS total, count(*) FILTER (status = 'pass') AS pass FROM (SELECT unnest([behavior, 'size' || tokens]) AS value, status FROM {SCORED}) GROUP BY value")
def multi_valued_summary(spark: SparkSession, d: str) -> DataFrame:
    return rollups.multi_valued(scored(spark, d), F.array("behavior", F.concat(F.lit("size"), F.col("tokens").cast("string"))))


@query("most_frequent", "SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY event_type ORDER BY n DESC, first_seen LIMIT 8")
def most_frequent(spark: SparkSession, d: str) -> DataFrame:
    return rollups.most_frequent(read(spark, d, "events"), "event_type", "event_id")


@query("check_groups", """SELECT * FROM (SELECT 'money' AS "group", count(*) AS applicable, count(*) FILTER (l_tax < 0.05 AND l_discount < 0.05) AS passed FROM lineitem
    UNION ALL SELECT 'size', count(*) FILTER (l_linenumber > 1), count(*) FILTER (l_linenumber > 1 AND l_quantity < 25) FROM lineitem UNION ALL SELECT 'none', 0, 0)""")
def check_groups(spark: SparkSession, d: str) -> DataFrame:
    entries = [F.struct(F.lit("tax").alias("key"), (F.col("l_tax") < 0.05).alias("value")), F.struct(F.lit("discount").alias("key"), (F.col("l_discount") < 0.05).alias("value"))]
    quantity = F.struct(F.lit("quantity").alias("key"), (F.col("l_quantity") < 25).alias("value"))
    checks = F.when(F.col("l_linenumber") > 1, F.map_from_entries(F.array(*entries, quantity))).otherwise(F.map_from_entries(F.array(*entries)))
    turns = read(spark, d, "lineitem").select(checks.alias("checks"))
    return rollups.check_groups(turns, "checks", {"money": ["tax", "discount"], "size": ["quantity"], "none": ["absent"]})


@query("case_verdicts", "SELECT l_orderkey, bool_and(l_quantity > 2) AND bool_and(l_discount < 0.1) AS passed, count(*) AS turns FROM lineitem GROUP BY l_orderkey")
def case_verdicts(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") > 2).alias("ok"), (F.col("l_discount") < 0.1).alias("final"))
    return rollups.case_verdict(turns, "l_orderkey", "ok", "final")


@query("review_status", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'not_evaluated' WHEN quality = 0 THEN 'pending' WHEN toxic = 1 THEN 'fail' ELSE 'pass' END AS status FROM labels) GROUP BY status""")
def review_status(spark: SparkSession, d: str) -> DataFrame:
    criteria = F.create_map(
        F.lit("quality"), F.when(F.col("quality").isNull(), "not_evaluated").when(F.col("quality") == 0, "pending").otherwise("pass"), F.lit("safety"), F.when(F.col("toxic") == 1, "fail").otherwise("pass")
    )
    rows = read(spark, d, "labels").withColumn("criteria", criteria)
    return rows.select(rollups.review_status(rows, "criteria").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


# -- comparison and gates -----------------------------------------------------------------------------------------------

OLD = "(SELECT doc_id AS id, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS status, doc_id % 5 AS action FROM labels)"
NEW = "(SELECT doc_id AS id, CASE toxic WHEN 0 THEN 'pass' ELSE 'fail' END AS status FROM labels)"


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = read(spark, d, "labels")
    old = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"), (F.col("doc_id") % 5).alias("action"))
    return old, labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, "pass").otherwise("fail").alias("status"))


@query("fixed_regressed", f"SELECT o.id, CASE WHEN o.status = 'fail' THEN 'fixed' ELSE 'regressed' END AS change FROM {OLD} o JOIN {NEW} n USING (id) WHERE o.status <> n.status")
def fixed_regressed(spark: SparkSession, d: str) -> DataFrame:
    return compare.fixed_regressed(*runs(spark, d), "id")


@query("acceptance_gates", f"""WITH j AS (SELECT action, o.status AS b, n.status AS a FROM {OLD} o JOIN {NEW} n USING (id)),
    g AS (SELECT count(*) FILTER (b = 'pass') AS bp, count(*) FILTER (a = 'pass') AS ap, count(*) FILTER (b = 'fail') AS bf, count(*) FILTER (a = 'fail') AS af FROM j GROUP BY action),
    t AS (SELECT sum(ap) AS ap, sum(bf) AS bf, sum(af) AS af, bool_and(ap >= bp) AS ok FROM g)
    SELECT 'minimum_pass' AS gate, ap >= 100 AS passed FROM t UNION ALL SELECT 'minimum_error_reduction', CASE WHEN bf = 0 THEN af = 0 ELSE bf - af >= ceil(0.25 * bf) END FROM t
    UNION ALL SELECT 'no_group_regression', ok FROM t""")
def acceptance_gates(spark: SparkSession, d: str) -> DataFrame:
    return compare.acceptance_gates(*runs(spark, d), "id", "action", 100, 0.25)


@query("safety_new_errors", """SELECT o_orderkey AS id, ['wrong_tool'] AS new_errors FROM orders WHERE o_totalprice > 50000 AND NOT o_custkey % 2 = 0""")
def safety_new_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    old = rows.select("id", text.tags((F.col("o_custkey") % 2 == 0, "wrong_tool")).alias("tags"))
    now_tags = rows.select("id", text.tags((F.col("o_totalprice") > 50000, "wrong_tool"), (F.col("o_orderstatus") == "F", "style")).alias("tags"))
    return compare.new_errors(old, now_tags, "id", "tags", ["wrong_tool", "unexpected_call"])


AFTER = f"(SELECT CASE WHEN id % 11 = 0 THEN id + 100000000 ELSE id END AS id, CASE WHEN id % 7 = 0 THEN 'x' ELSE content END AS content, completed, due_at FROM {TASKS} WHERE id % 5 <> 0)"


@query("before_after_diff", f"""SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'deleted' ELSE 'changed' END AS change
    FROM {TASKS} b FULL JOIN {AFTER} a ON b.id = a.id WHERE b.id IS NULL OR a.id IS NULL OR b.content <> a.content""")
def before_after_diff(spark: SparkSession, d: str) -> DataFrame:
    before, k = task_table(spark, d), F.col("id")
    after = before.where(k % 5 != 0).withColumn("content", F.when(k % 7 == 0, "x").otherwise(F.col("content"))).withColumn("id", F.when(k % 11 == 0, k + 100000000).otherwise(k))
    return compare.diff(before, after, "id", ["content", "completed", "due_at"])


@query("multiset_difference", """SELECT p_brand, a - e AS surplus FROM (SELECT p_brand, count(*) FILTER (p_size > 25) AS a, count(*) FILTER (p_size <= 25) AS e FROM part GROUP BY p_brand) WHERE a > e""")
def multiset_difference(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    return compare.multiset_difference(part.where("p_size > 25"), part.where("p_size <= 25"), "p_brand")


@query("choose_checkpoint", "SELECT * FROM (SELECT l_linenumber AS step, count(*) FILTER (l_discount < 0.08) AS passed, count(*) FILTER (l_tax > 0.07) AS unsafe FROM lineitem GROUP BY 1) WHERE passed >= 100 ORDER BY passed DESC, step LIMIT 1")
def choose_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.count_if(F.col("l_discount") < 0.08).alias("passed"), F.count_if(F.col("l_tax") > 0.07).alias("unsafe"))
    return compare.choose_checkpoint(rows, 100, 1 << 60)


@query("baseline_deltas", f"WITH s AS (SELECT behavior, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail FROM {SCORED} GROUP BY behavior) SELECT s.behavior, s.pass - b.pass AS pass_delta, s.fail - b.fail AS fail_delta FROM s, s b WHERE b.behavior = 'N' AND s.behavior <> 'N'")
def baseline_deltas(spark: SparkSession, d: str) -> DataFrame:
    return compare.deltas(rollups.status_summary(scored(spark, d), ["behavior"]), "behavior", "N", ["pass", "fail"])


@query("paired_variants", """SELECT a.o_orderkey // 2 AS pair_id, a.o_orderstatus AS a, b.o_orderstatus AS b, a.o_orderstatus = b.o_orderstatus AS same
    FROM orders a JOIN orders b ON a.o_orderkey // 2 = b.o_orderkey // 2 WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1""")
def paired_variants(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(F.floor(key / 2).alias("pair_id"), (key % 2).alias("variant"), "o_orderstatus")
    return compare.paired(rows, "pair_id", "variant", 0, 1, "o_orderstatus")


@query("review_binding", "SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE quality = 1 END AS digest_ok, CASE toxic WHEN 0 THEN 'approved' ELSE 'needs_correction' END AS decision FROM labels LEFT JOIN documents USING (doc_id)")
def review_binding(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    stored = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("now"))
    reviews = read(spark, d, "labels").join(stored, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, F.col("now")).otherwise(F.lit("0" * 64)).alias("digest"), F.when(F.col("toxic") == 0, "approved").otherwise("needs_correction").alias("decision")
    )
    return compare.bind_reviews(docs, reviews, "doc_id", "text")


@query("prefix_extension", "SELECT p_partkey FROM part WHERE p_partkey % 10 = 0")
def prefix_extension(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part")
    changed = part.withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")))
    return compare.prefix_equal(part, changed, "p_partkey", ["p_name", "p_size"])


@query("template_cross", "SELECT format('t_{:02d}_{:02d}', r_regionkey, n_nationkey) AS id, 'Go to ' || n_name || ' in ' || r_name AS prompt FROM region, nation")
def template_cross(spark: SparkSession, d: str) -> DataFrame:
    frames = read(spark, d, "region").select(F.col("r_regionkey").alias("f"), F.concat(F.lit("Go to {place} in "), F.col("r_name")).alias("frame"))
    values = read(spark, d, "nation").select(F.col("n_nationkey").alias("v"), F.lit("place").alias("slot"), F.col("n_name").alias("value"))
    return compare.cross_fill(frames, values, "t")


# -- leakage ------------------------------------------------------------------------------------------------------------


@query("leak_exact", """WITH c AS (SELECT text, min(doc_id) FILTER (doc_id % 2 = 1) AS class_id, count(*) FILTER (doc_id % 2 = 1) AS refs, count(*) FILTER (doc_id % 2 = 0) AS audited FROM documents WHERE text <> '' GROUP BY text)
    SELECT doc_id AS id, doc_id % 2 = 1 AS is_reference, class_id, coalesce(CASE WHEN doc_id % 2 = 1 THEN audited ELSE refs END, 0) AS links FROM documents LEFT JOIN c USING (text)""")
def leak_exact(spark: SparkSession, d: str) -> DataFrame:
    """Even documents against odd ones: every document with its class, so that each pair of equal texts is there."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 1).alias("is_reference"), "text")
    return leakage.exact_classes(docs, "text")


#: Names as other people write them: folding makes them equal, and little else does.
PART_VARIANTS = ("upper(p_name)", "'  ' || p_name || chr(9)", "replace(p_name, ' ', chr(10))", "p_name", "p_name || '!'")


@query("leak_folded", f"""WITH a AS (SELECT p_partkey AS id, false AS is_reference, [{', '.join(PART_VARIANTS)}][p_partkey % 5 + 1] AS t FROM part UNION ALL SELECT p_partkey, true, p_name FROM part),
    fold AS (SELECT id, is_reference, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS t FROM a),
    c AS (SELECT t, min(id) FILTER (is_reference) AS class_id, count(*) FILTER (is_reference) AS refs, count(*) FILTER (NOT is_reference) AS audited FROM fold WHERE t <> '' GROUP BY t)
    SELECT id, is_reference, class_id, coalesce(CASE WHEN is_reference THEN audited ELSE refs END, 0) AS links FROM fold LEFT JOIN c USING (t)""")
def leak_folded(spark: SparkSession, d: str) -> DataFrame:
    """Names as others write them against the names, after folding: every row of both sides with its class, so that each pair is there."""
    part = read(spark, d, "part")
    name = F.col("p_name")
    written = (F.upper(name), F.concat(F.lit("  "), name, F.lit("\t")), F.replace(name, F.lit(" "), F.lit("\n")), name, F.concat(name, F.lit("!")))
    audited = part.select(F.col("p_partkey").alias("id"), F.lit(False).alias("is_reference"), F.element_at(F.array(*written), (F.col("p_partkey") % 5 + 1).cast("int")).alias("text"))
    both = audited.unionByName(part.select(F.col("p_partkey").alias("id"), F.lit(True).alias("is_reference"), name.alias("text")))
    return leakage.exact_classes(both.select("id", "is_reference", leakage.fold("text").alias("text")), "text")


@query("leak_length_band", """SELECT conv_id, turn, role, count(*) AS candidates FROM conversations c JOIN benchmark b ON length(c.text) > 0 AND length(b.text) > 0
    AND 2 * least(length(c.text), length(b.text)) >= 0.92 * (length(c.text) + length(b.text)) - 1e-9 GROUP BY conv_id, turn, role""")
def leak_length_band(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("ref_text"))
    return leakage.length_band(read(spark, d, "conversations"), items, 0.92).groupBy("conv_id", "turn", "role").agg(F.count("*").alias("candidates"))


@query("leak_near_top1", """WITH a AS (SELECT n_nationkey AS id, n_name || ' goes to market number ' || n_nationkey AS t FROM nation), b AS (SELECT n_nationkey AS ref_id, n_name || ' goes to market number ' || n_nationkey || '.' AS t FROM nation)
    SELECT id, ref_id, round(2 * length(a.t) / (2.0 * length(a.t) + 1), 6) AS score FROM a JOIN b ON id = ref_id""")
def leak_near_top1(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.col("n_name"), F.lit(" goes to market number "), F.col("n_nationkey").cast("string"))
    nations = read(spark, d, "nation")
    audited, reference = nations.select(F.col("n_nationkey").alias("id"), said.alias("text")), nations.select(F.col("n_nationkey").alias("ref_id"), F.concat(said, F.lit(".")).alias("ref_text"))
    return leakage.nearest(audited, reference, 0.92, ["id"], ["ref_id"]).select("id", "ref_id", F.round("score", 6).alias("score"))


#: Least ratio of a near leak.
NEAR = 0.92


@query("leak_near_lines")
def leak_near_lines(spark: SparkSession, d: str) -> DataFrame:
    """The nearest benchmark line of every line of every document. The matching-blocks ratio has no SQL; a test works it out pair by pair."""
    lines = lambda name, key: read(spark, d, name).select(F.col(key).alias("k"), F.posexplode(text.lines_of(F.col("text"))).alias("line", "t"))
    audited = lines("documents", "doc_id").select(F.col("k").alias("doc_id"), "line", leakage.fold("t").alias("text"))
    reference = lines("benchmark", "item_id").select(F.col("k").alias("item_id"), F.col("line").alias("item_line"), leakage.fold("t").alias("ref_text"))
    found = leakage.nearest(audited, reference, NEAR, ["doc_id", "line"], ["item_id", "item_line"])
    return found.select("doc_id", "line", "item_id", "item_line", F.round("score", 6).alias("score"))


@query("leak_shapes", """SELECT 'buy <payload> <id> of <id> now' AS shape, 'buy <content> #<id> of x' || p_size || ', <id> now!' AS field_shape, count(*) AS n FROM part GROUP BY ALL""")
def leak_shapes(spark: SparkSession, d: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    first = leakage.shape(F.concat(F.lit("BUY  "), name, F.lit(" #"), size, F.lit(" of "), size, F.lit(", now!")), F.array("p_name"))
    second = leakage.field_mask(F.concat(F.lit("BUY  "), name, F.lit(" #"), size, F.lit(" of x"), size, F.lit(", "), size, F.lit(" now!")), name, F.lit(None).cast("string"))
    return read(spark, d, "part").select(first.alias("shape"), second.alias("field_shape")).groupBy("shape", "field_shape").agg(F.count("*").alias("n"))


@query("union_last", """SELECT p_size AS size, p_brand AS brand, max(p_partkey) AS ordinal FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL
    UNION ALL SELECT p_size, p_brand, max(p_partkey) FROM part p WHERE p_partkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 1 AND q.p_size = p.p_size AND q.p_brand = p.p_brand) GROUP BY ALL""")
def union_last(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_size").alias("size"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ordinal"))
    return leakage.union_last([part.where("ordinal % 2 = 0"), part.where("ordinal % 2 = 1")], ["size", "brand"])


@query("leak_families", "SELECT l_suppkey AS family FROM lineitem WHERE l_linenumber = 1 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_linenumber = 7")
def leak_families(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    return rows.where("l_linenumber = 1").select(F.col("l_suppkey").alias("family")).intersect(rows.where("l_linenumber = 7").select("l_suppkey"))


@query("dedupe_last", "SELECT max(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return leakage.last_of_each(read(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


# -- sessions and runs --------------------------------------------------------------------------------------------------


@query("turn_state_chain", "SELECT conv_id, turn, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS state_before, role AS state_after FROM conversations")
def turn_state_chain(spark: SparkSession, d: str) -> DataFrame:
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role")
    return lifecycle.turn_states(turns, "conv_id", "turn", "role")


@query("run_reservations", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def run_reservations(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reservations(read(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id")


@query("run_lifecycle", """WITH e AS (SELECT user_id, min(event_id) FILTER (event_type = 'purchase') AS fin FROM events GROUP BY user_id)
    SELECT user_id, arg_max(event_type, event_id) AS state, count(*) FILTER (event_type = 'error') AS interruptions, count(*) AS events
    FROM events JOIN e USING (user_id) WHERE fin IS NULL OR event_id <= fin GROUP BY user_id""")
def run_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.run_state(read(spark, d, "events"), "user_id", "event_id", "event_type", "purchase", "error")


@query("run_heartbeats", "SELECT * FROM (SELECT user_id, event_id, (floor(epoch(ts))::BIGINT - lag(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL)) WHERE gap > 86400")
def run_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    beats = read(spark, d, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return lifecycle.heartbeat_gaps(beats, "user_id", "ts", 86400).select("user_id", "event_id", "gap")


@query("resume_prefix", "SELECT count(*) AS done, true AS valid FROM part WHERE p_partkey <= 50")
def resume_prefix(spark: SparkSession, d: str) -> DataFrame:
    least = read(spark, d, "part").agg(F.min("p_partkey").alias("least"))
    expected = read(spark, d, "part").join(F.broadcast(least)).select((F.col("p_partkey") - F.col("least")).alias("ordinal"), F.col("p_name").alias("id"), "p_partkey")
    return lifecycle.resume_point(expected.select("ordinal", "id"), expected.where("p_partkey <= 50").select("ordinal", "id"))


#: What an event does to its user's run, by its type and value, in Spark and SQL alike.
STEP = """CASE event_type WHEN 'signup' THEN 'reserve' WHEN 'view' THEN CASE WHEN value < 20 THEN 'spawn' ELSE 'poll' END WHEN 'click' THEN CASE WHEN value < 20 THEN 'resume' ELSE 'poll' END
    WHEN 'error' THEN CASE WHEN value < 5 THEN 'spawn_fail' WHEN value < 25 THEN 'interrupt' ELSE 'fail' END WHEN 'purchase' THEN CASE WHEN value > 120 THEN 'finish' ELSE 'poll' END END"""
#: The same automaton, one event after the other by recursion.
STEPPED = f"""WITH RECURSIVE allowed AS (SELECT * FROM (VALUES {", ".join(map(str, automata.TRANSITIONS))}) a(step, state, after)),
    e AS (SELECT user_id, event_id, {STEP} AS step, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, e.step, n, 'absent' AS state_before, coalesce(after, 'absent') AS state_after, after IS NOT NULL AS legal FROM e LEFT JOIN allowed a ON a.step = e.step AND a.state = 'absent' WHERE n = 1
        UNION ALL SELECT e.user_id, e.event_id, e.step, e.n, r.state_after, coalesce(after, r.state_after), after IS NOT NULL FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN allowed a ON a.step = e.step AND a.state = r.state_after)"""


def run_log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id", "event_id", F.expr(STEP).alias("step"))


@query("run_steps", f"""{STEPPED} SELECT user_id, event_id, step, state_before, state_after, legal, count(*) FILTER (legal AND step = 'resume') OVER w AS resume_count,
    count(*) FILTER (legal AND step = 'interrupt') OVER w AS interruptions FROM r WINDOW w AS (PARTITION BY user_id ORDER BY n)""")
def run_steps(spark: SparkSession, d: str) -> DataFrame:
    return automata.run_steps(run_log(spark, d), "user_id", "event_id", "step")


@query("run_records", f"""{STEPPED} SELECT user_id, arg_max(state_after, n) AS state, count(*) FILTER (legal AND step = 'resume') AS resume_count,
    count(*) FILTER (legal AND step = 'interrupt') AS interruptions, count(*) FILTER (NOT legal) AS illegal FROM r GROUP BY user_id""")
def run_records(spark: SparkSession, d: str) -> DataFrame:
    return automata.run_records(run_log(spark, d), "user_id", "event_id", "step")


#: What a click does to its client's run.
CLICKED = """CASE kind WHEN 'signup' THEN 'reserve' WHEN 'view' THEN CASE WHEN value < 20 THEN 'spawn' ELSE 'poll' END WHEN 'click' THEN 'resume'
    WHEN 'error' THEN CASE WHEN value < 25 THEN 'interrupt' ELSE 'fail' END WHEN 'purchase' THEN CASE WHEN value > 300 THEN 'finish' ELSE 'poll' END END"""


@query("click_runs")  # one step after the other in SQL takes too long for a client with most of the clicks; a test does it in Python
def click_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records of runs of very uneven lengths, from a log with repeated rows and null steps."""
    return automata.run_records(read(spark, d, "clicks").select("client_id", "click_id", F.expr(CLICKED).alias("step")), "client_id", "click_id", "step")


# -- proposals, token arrays and nested documents -----------------------------------------------------------------------

@query("token_arrays", """SELECT l_orderkey, l_linenumber, l_linenumber || ':' || CASE WHEN l_linenumber > 3 THEN 3 ELSE l_linenumber END AS cut, 8 AS padded,
    CASE WHEN l_linenumber > 1 THEN 2 * -100 + (l_linenumber * (l_linenumber + 1)) / 2 - 3 END AS label_sum FROM lineitem""")
def token_arrays(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    ids = F.sequence(F.lit(1), n)
    rows = read(spark, d, "lineitem")
    cut = F.concat(n.cast("string"), F.lit(":"), F.size(tokens.through_end(ids, 3)).cast("string"))
    labels = tokens.assistant_labels(F.sequence(F.lit(1), F.lit(2)), ids)  # a line of one token doesn't begin with this prefix
    total = F.aggregate(labels, F.lit(0), lambda a, x: a + x).cast("double")
    return rows.select("l_orderkey", "l_linenumber", cut.alias("cut"), F.size(tokens.pad(ids, 0, F.lit(7))).alias("padded"), total.alias("label_sum"))


@query("json_digests", """SELECT sha256('{"a":' || p_size || ',"b":"x"}') AS digest, sha256('{"a":' || p_size || ',"b":"x"}' || chr(10)) AS with_newline, count(*) AS n FROM part GROUP BY 1, 2""")
def json_digests(spark: SparkSession, d: str) -> DataFrame:
    text_of = F.concat(F.lit('{"b": "x", "a": '), F.col("p_size").cast("string"), F.lit("}"))
    digests = jsontext.canonical_digest(text_of).alias("digest"), jsontext.canonical_digest(text_of, newline=True).alias("with_newline")
    return read(spark, d, "part").select(*digests).groupBy("digest", "with_newline").agg(F.count("*").alias("n"))


#: Nested documents, what they hold at which path, and the id there.
NESTED = (
    ('{"cases": [{"prompt": "%s", "x": {"user_message": "inner"}}]}', (("%s", "$.cases[0]", None), ("inner", "$.cases[0].x", None))), ('{"prompt": "", "user_message": "%s", "id": 5}', (("%s", "$", "5"),)), ('{"prompt": 5, "user_message": "%s"}', ()),
    ("{", ((None, "not strict JSON", None),)), ('{"a": 1, "a": 2}', ((None, "not strict JSON", None),)), ('[[{"user_message": "%s", "id": "u"}], {"prompt": null}]', (("%s", "$[0][0]", "u"),)), ('"%s"', ()), ("[]", ()), ('{"prompt": {"prompt": "%s"}}', (("%s", "$.prompt", None),)),
    ('{"prompt": "%s", "cases": [{"prompt": "b"}, 3]}', (("%s", "$", None), ("b", "$.cases[0]", None))),
)
HARVESTED = ", ".join(f"({k}, {'NULL' if t is None else repr(t)}, {path!r}, {'NULL' if i is None else repr(i)})" for k, (_, found) in enumerate(NESTED) for t, path, i in found)


@query("json_harvest", f"SELECT p_partkey, replace(t, '%s', p_name) AS text, path, i AS record_id FROM part JOIN (VALUES {HARVESTED}) h(k, t, path, i) ON p_partkey % {len(NESTED)} = k")
def json_harvest(spark: SparkSession, d: str) -> DataFrame:
    doc = F.element_at(F.array(*[F.lit(t) for t, _ in NESTED]), (F.col("p_partkey") % len(NESTED) + 1).cast("int"))
    rows = read(spark, d, "part").select("p_partkey", F.replace(doc, F.lit("%s"), F.col("p_name")).alias("doc"))
    return documents.harvest(rows, "doc").select("p_partkey", "text", "path", "record_id")


# -- validators ---------------------------------------------------------------------------------------------------------


@query("select_cases", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 50 = 3 AND p_partkey < 150")
def select_cases(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(0, 150).where("id % 50 = 3").withColumnRenamed("id", "p_partkey")
    return validate.select_cases(read(spark, d, "part").select("p_partkey", "p_name"), wanted, "p_partkey")[0]


@query("unknown_cases", "SELECT x AS p_partkey FROM range(0, 100000, 997) t(x) WHERE x NOT IN (SELECT p_partkey FROM part)")
def unknown_cases(spark: SparkSession, d: str) -> DataFrame:
    return validate.select_cases(read(spark, d, "part"), spark.range(0, 100000, 997).withColumnRenamed("id", "p_partkey"), "p_partkey")[1]


@query("set_differences", """(SELECT DISTINCT l_partkey, 'missing' AS side FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 2))
    UNION ALL (SELECT DISTINCT l_partkey, 'extra' FROM lineitem WHERE l_linenumber = 2 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1))""")
def set_differences(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem")
    return validate.set_differences(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 2"), "l_partkey")


@query("stored_differs", "SELECT DISTINCT l_orderkey AS family FROM lineitem WHERE l_orderkey % 9 = 0")
def stored_differs(spark: SparkSession, d: str) -> DataFrame:
    again = rollups.status_summary(scored(spark, d), ["family"])
    stored = again.withColumn("pass", F.when(F.col("family") % 9 == 0, F.col("pass") + 1).otherwise(F.col("pass")))
    return validate.stored_differs(stored, again, "family", ["total", "pass", "fail", "error", "accuracy"])


@query("undecided_flags", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'undecided' WHEN 1 THEN 'changed' ELSE 'unknown' END AS problem FROM labels WHERE doc_id % 4 < 3""")
def undecided_flags(spark: SparkSession, d: str) -> DataFrame:
    labels, k = read(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("score")), F.col("doc_id") % 4
    return validate.undecided_flags(labels.where(k != 2), labels.where(k != 0).withColumn("score", F.when(k == 1, 2).otherwise(F.col("score"))), "doc_id", ["quality", "score"])


@query("review_completeness", """SELECT count(*) FILTER (toxic = 0) AS approved, count(*) FILTER (toxic = 1) AS needs_correction, count(*) FILTER (toxic IS NULL) AS pending, count(*) FILTER (toxic = 0) = count(*) AS complete
    FROM documents LEFT JOIN labels USING (doc_id)""")
def review_completeness(spark: SparkSession, d: str) -> DataFrame:
    reviews = read(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 0, "approved").otherwise("needs_correction").alias("decision"))
    return validate.review_completeness(read(spark, d, "documents"), reviews, "doc_id")


#: orders as two lists: in the second one, orders of customers whose number is divisible by 5 come two places later.
LISTS = """WITH e AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey AS expected FROM orders),
    a AS (SELECT row_number() OVER (ORDER BY o_orderkey + CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 0 END, o_orderkey) - 1 AS position, o_orderkey AS actual FROM orders)"""


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, d, "orders").withColumn("later", F.col("o_orderkey") + F.when(F.col("o_custkey") % 5 == 0, 2).otherwise(0))
    return compare.positions(orders, "o_orderkey", "o_orderkey"), compare.positions(orders, "later", "o_orderkey")


@query("order_differences", f"{LISTS} SELECT position, expected, actual FROM e FULL JOIN a USING (position) WHERE expected IS DISTINCT FROM actual")
def order_differences(spark: SparkSession, d: str) -> DataFrame:
    return compare.order_differences(*two_lists(spark, d))


@query("order_gates", f"""{LISTS}, g AS (SELECT count(expected) = count(actual) AS l, bool_and(expected IS NOT DISTINCT FROM actual) AS o FROM e FULL JOIN a USING (position))
    SELECT unnest(['same_length', 'same_members', 'same_order']) AS gate, unnest([l, l AND NOT EXISTS (SELECT expected FROM e EXCEPT ALL SELECT actual FROM a), o]) AS passed FROM g""")
def order_gates(spark: SparkSession, d: str) -> DataFrame:
    return compare.order_gates(*two_lists(spark, d))


#: conversations as cases in files of about 200. One file in five is cut short, one in five is changed after it was locked; one case in
#: ten has no id, and the turns of one conversation in ten share theirs.
CASE_FILES = """t AS (SELECT *, conv_id::VARCHAR || ':' || turn::VARCHAR || ':' || coalesce(role, '') || ':' || coalesce(text, '') AS own FROM conversations),
    f AS (SELECT *, ('0x' || substr(md5(own), 1, 8))::BIGINT % ((SELECT count(*) FROM conversations) // 200 + 1) AS bucket,
        CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN NULL WHEN conv_id % 10 = 1 THEN conv_id::VARCHAR ELSE conv_id::VARCHAR || ':' || turn::VARCHAR END AS id FROM t)"""


def case_texts(spark: SparkSession, d: str) -> DataFrame:
    """(bucket, value): the JSON documents, every other one a list, the others objects with `cases`."""
    rows = read(spark, d, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    own = F.concat(conv, F.lit(":"), turn, F.lit(":"), F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    bucket = F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("long") % (rows.count() // 200 + 1)
    ident = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 0), None).when(F.col("conv_id") % 10 == 1, conv).otherwise(F.concat(conv, F.lit(":"), turn))
    cases = rows.select(bucket.alias("bucket"), F.to_json(F.struct(ident.alias("id"), "turn", "role", F.col("text").alias("prompt"))).alias("c"))
    whole = cases.groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("c"), ","), F.lit("]")).alias("v"))
    value = F.when(F.col("bucket") % 2 == 0, F.col("v")).otherwise(F.concat(F.lit('{"cases":'), "v", F.lit("}")))
    return whole.select("bucket", F.when(F.col("bucket") % 5 == 2, F.substring(value, 1, F.length(value) - 1)).otherwise(value).alias("value"))


@query("case_files", f"""WITH {CASE_FILES} SELECT 'case' AS kind, id AS record_id, NULL::BIGINT AS bucket, turn::BIGINT AS turn, text AS prompt, count(*) AS n FROM f WHERE bucket % 5 <> 2 AND id IS NOT NULL GROUP BY id, turn, role, text
    UNION ALL SELECT DISTINCT 'not strict JSON', NULL, bucket, NULL::BIGINT, NULL, 1 FROM f WHERE bucket % 5 = 2 UNION ALL SELECT 'no id', NULL, bucket, NULL, NULL, count(*) FROM f WHERE bucket % 5 <> 2 AND id IS NULL GROUP BY bucket
    UNION ALL SELECT 'repeated id', id, NULL, NULL, NULL, count(*) FROM f WHERE bucket % 5 <> 2 AND id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def case_files(spark: SparkSession, d: str) -> DataFrame:
    path = shared_folder(spark, "cases")
    case_sources.write_json_files(case_texts(spark, d), "bucket", "value", path)
    rows = case_sources.case_rows(spark, path)
    told = F.from_json("record", "turn long, role string, prompt string")
    good = case_sources.good_cases(rows).select("record_id", told.alias("c")).select("record_id", "c.*").groupBy("record_id", "turn", "role", "prompt").agg(F.count("*").alias("n"))
    none = F.lit(None)
    faults = case_sources.case_faults(rows).select(
        F.col("fault").alias("kind"), "record_id", F.when(F.col("record_id").isNull(), case_sources.named("file", "bucket")).cast("long").alias("bucket"), none.cast("long").alias("turn"), none.cast("string").alias("prompt"), "n"
    )
    return good.select(F.lit("case").alias("kind"), "record_id", none.cast("long").alias("bucket"), "turn", "prompt", "n").unionByName(faults)


@query("file_lock_on_disk", f"WITH {CASE_FILES} SELECT DISTINCT bucket, CASE bucket % 5 WHEN 1 THEN 'missing' ELSE 'changed' END AS problem FROM f WHERE bucket % 5 IN (1, 3)")
def file_lock_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Files are written and locked by their digests; then one in five is gone and one in five has another byte."""
    path, at = shared_folder(spark, "locked"), F.col("bucket") % 5
    case_sources.write_json_files(case_texts(spark, d).select("bucket", F.concat("value", F.lit(" ")).alias("value")), "bucket", "value", f"{path}/first")
    told = case_sources.file_digests(spark, f"{path}/first").select(case_sources.named("path", "bucket").cast("long").alias("bucket"), "sha256", "path")
    told.select("bucket", "sha256").write.parquet(f"{path}/manifest")
    texts = spark.read.text(f"{path}/first", wholetext=True).select(case_sources.named(F.col("_metadata.file_path"), "bucket").cast("long").alias("bucket"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    later = texts.where(at != 1).select("bucket", F.when(at == 3, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    case_sources.write_json_files(later, "bucket", "value", f"{path}/now")
    now = case_sources.file_digests(spark, f"{path}/now").select(case_sources.named("path", "bucket").cast("long").alias("bucket"), "sha256")
    return audits.changed_files(spark.read.parquet(f"{path}/manifest"), now, "bucket")


@query("latest_numbered", "SELECT 'checkpoint-' || max(p_partkey) AS name, max(p_partkey) AS number FROM part WHERE p_size > 10")
def latest_numbered(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "part").select(F.concat(F.lit("checkpoint-"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    return validate.latest_numbered(names, "name", F.col("p_size") > 10, "checkpoint-")


@query("budget_check", "SELECT sum(l_quantity * (l_tax + l_discount)) AS cost, sum(l_quantity * (l_tax + l_discount)) <= 1000 + 1e-12 AS within FROM lineitem")
def budget_check(spark: SparkSession, d: str) -> DataFrame:
    return validate.budget(read(spark, d, "lineitem"), "l_quantity", ["l_tax", "l_discount"], 1000.0)
