"""Audits of data sets, reports and runs as rows of (check, ok, offenders, example): all that is wrong at once, each check one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rows(offenders: Mapping[str, DataFrame]) -> DataFrame:
    """One row for each check over its offenders(detail string): ok if there is none; the least detail is the example."""
    one = lambda name, rows: rows.agg(F.count("*").alias("offenders"), F.min("detail").alias("example")).select(F.lit(name).alias("check"), (F.col("offenders") == 0).alias("ok"), "offenders", "example")
    return reduce(DataFrame.unionByName, [one(name, rows) for name, rows in offenders.items()])


def detail(rows: DataFrame, column: str | Column) -> DataFrame:
    return rows.select((F.col(column) if isinstance(column, str) else column).cast("string").alias("detail"))


def breaking(rows: DataFrame, key: str, violations: Column) -> DataFrame:
    """Keys of the rows that break a rule, with the rules."""
    return detail(rows.withColumn("_v", violations).where(F.size("_v") > 0), F.concat_ws(" ", F.col(key).cast("string"), F.array_join("_v", ",")))


def repeated(rows: DataFrame, column: str) -> DataFrame:
    return detail(rows.groupBy(column).count().where("count > 1"), column)


def unequal_counts(rows: DataFrame, key: str, expected: Mapping[str, int]) -> DataFrame:
    """Values of a column that occur more or less often than expected; those that aren't expected at all too."""
    want = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in expected.items() for x in pair]), F.col("_k")), F.lit(0)) if expected else F.lit(0)
    counts = rows.groupBy(F.col(key).cast("string").alias("_k")).agg(F.count("*").alias("_n"))
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(k,) for k in expected] or [], "_k string")
    return detail(wanted.join(counts, "_k", "full_outer").where(F.coalesce("_n", F.lit(0)) != want), F.concat_ws(" ", "_k", F.coalesce("_n", F.lit(0)).cast("string")))


def inconsistent_families(rows: DataFrame, family: str, signature: Sequence[str], most: int) -> DataFrame:
    """Families with more than `most` members, or with more than one signature."""
    struct = F.struct(*signature)
    both = rows.groupBy(family).agg(F.count("*").alias("n"), F.min(struct).alias("lo"), F.max(struct).alias("hi"))
    return detail(both.where((F.col("n") > most) | ~F.col("lo").eqNullSafe(F.col("hi"))), family)


def shared(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values that both sides have."""
    return detail(left.select(column).intersect(right.select(column)), column)


def not_preserved(subset: DataFrame, whole: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Keys of a subset that the whole doesn't have, or has with other values of these columns."""
    own = subset.select(key, F.struct(*values).alias("_own"))
    joined = own.join(whole.select(key, F.struct(*values).alias("_there")), key, "left")
    return detail(joined.where(~F.col("_own").eqNullSafe(F.col("_there"))), key)


def extend(old: DataFrame, new: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A data set with another one's rows after its own: ordinals go on from the greatest."""
    last = old.agg(F.coalesce(F.max(ordinal) + 1, F.lit(0)).alias("_base"))
    moved = new.crossJoin(F.broadcast(last)).withColumn(ordinal, F.col(ordinal) + F.col("_base")).drop("_base")  # one row
    return old.unionByName(moved)


def changed_files(manifest: DataFrame, files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, problem) of a manifest's paths whose file is missing or has another digest."""
    now = files.select(path, F.col(digest).alias("_now"))
    joined = manifest.join(now, path, "left")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col(digest), "changed")
    return joined.select(path, problem.alias("problem")).where(F.col("problem").isNotNull())


def manifest_differences(expected: DataFrame, actual: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """(key, expected, actual) of a manifest's entries that aren't those computed again, on either side."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    return e.join(a, key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("actual")))


def evidence_gates(report: DataFrame, gates: Mapping[str, Column], key: str) -> DataFrame:
    """(key, check, ok) for each gate over each row of a report; a gate that can't be told doesn't pass."""
    told = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in gates.items()])
    return report.select(key, F.explode(told).alias("g")).select(key, "g.*")


def training_gates(steps: int) -> dict[str, Column]:
    """Gates of a training report's row: all steps done, a finite loss that fell over the same tokens, accuracy within bounds, weights
    that changed and reload as they were."""
    c = F.col
    return {
        "complete": c("status") == "complete", "all_steps": c("completed_steps") == steps, "finite_loss": ~F.isnan("training_loss") & (F.abs("training_loss") < float("inf")),
        "ran": c("runtime_seconds") > 0, "same_tokens": (c("tokens_before") == c("tokens_after")) & (c("tokens_after") > 0), "loss_fell": c("loss_after") < c("loss_before"),
        "accuracy": c("accuracy_after").between(0, 1), "weights_changed": c("state_before") != c("state_after"), "weights_reload": c("state_after") == c("state_reloaded"),
    }


def attribution_summary(failures: DataFrame) -> DataFrame:
    """failures(case, configuration, owner, cause, disposition, label): one row an observed failure -> (section, name, n): owners, causes
    and configurations of the failures, dispositions and label statuses of the cases."""
    per_failure = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name")) for s, c in (("owner", "owner"), ("cause", "cause"), ("configuration", "configuration"))])
    cases = failures.groupBy("case").agg(F.min("disposition").alias("disposition"), F.min("label").alias("label"))
    per_case = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("name")) for s in ("disposition", "label")])
    count = lambda rows, told: rows.select(F.explode(told).alias("t")).select("t.*").groupBy("section", "name").agg(F.count("*").alias("n"))
    return count(failures, per_failure).unionByName(count(cases, per_case))


def observations(reports: DataFrame, configurations: Sequence[str], key: str = "case", configuration: str = "configuration", status: str = "status") -> DataFrame:
    """reports(case, configuration, status), aligned: one row for each case that any configuration failed, with every configuration's
    status and the list of those that failed it, in the order given. A case that a configuration lacks has a null there."""
    wide = reports.groupBy(key).pivot(configuration, list(configurations)).agg(F.min(status))
    failed = F.array_compact(F.array(*[F.when(F.col(f"`{c}`") == "fail", F.lit(c)) for c in configurations]))
    return wide.withColumn("failed", failed).where(F.size("failed") > 0)


def attribution_audit(failures: DataFrame, expected: DataFrame, taxonomy: Mapping[str, Sequence[str]], routing: str = "routing", exposure: str = "routing_wrong_exposure") -> DataFrame:
    """Checks of attributed failures against expected(case, configuration), the failures that the reports show: exact coverage, known
    names, causes that begin with `routing_` exactly where the owner is routing, and dispositions that the causes allow: a case of wrong exposure
    alone is for the architecture alone, a training target needs a failure of the model's own and an accepted label."""
    pair = F.struct("case", "configuration")
    unknown = F.lit(False)
    for column, names in taxonomy.items():
        unknown = unknown | ~F.coalesce(F.col(column).isin(*names), F.lit(False))
    routed = F.col("cause").startswith("routing_")
    cases = failures.groupBy("case").agg(
        F.bool_and(F.col("cause") == exposure).alias("only_exposure"), F.bool_or(F.col("owner") == "model").alias("of_model"), F.min("disposition").alias("disposition"), F.min("label").alias("label")
    )
    target, structure = F.col("disposition") == "sft_target", F.col("disposition") == "architecture_only"
    return check_rows({
        "missing_attribution": detail(expected.select("case", "configuration").exceptAll(failures.select("case", "configuration")), F.to_json(pair)),
        "unknown_failure": detail(failures.select("case", "configuration").exceptAll(expected.select("case", "configuration")), F.to_json(pair)),
        "taxonomy": detail(failures.where(unknown), "case"), "routing_owner": detail(failures.where(routed != (F.col("owner") == routing)), "case"),
        "exposure_disposition": detail(cases.where(F.col("only_exposure") != structure), "case"), "target_of_model": detail(cases.where(target & ~F.col("of_model")), "case"),
        "target_label": detail(cases.where(target & (F.col("label") != "accepted")), "case"),
    })


def review_decision(reviews: DataFrame, automatic: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """One row from reviews(model, id, decision) and automatic(eligible, one row): semantic passes of both models, whether the candidate's
    aren't fewer, and what follows for it."""
    n = lambda m: F.count_if((F.col("model") == m) & (F.col("decision") == "pass"))
    counts = reviews.agg(n(baseline).alias("baseline_pass"), n(candidate).alias("candidate_pass")).crossJoin(automatic.select("eligible"))  # one row each
    manual = F.col("candidate_pass") >= F.col("baseline_pass")
    return counts.select("baseline_pass", "candidate_pass", F.col("eligible").alias("automatic_eligible"), manual.alias("manual_not_below"), F.when(F.col("eligible") & manual, "eligible").otherwise("rejected").alias("candidate_status"))


def semantic_summary(reviews: DataFrame, model: str = "model", decision: str = "decision") -> DataFrame:
    """(model, pass, fail, total) of semantic decisions."""
    return reviews.groupBy(model).agg(F.count_if(F.col(decision) == "pass").alias("pass"), F.count_if(F.col(decision) == "fail").alias("fail"), F.count("*").alias("total"))


def design_audit(evidence: DataFrame, cases: DataFrame, taxonomy: DataFrame, total: int) -> DataFrame:
    """Checks of evidence(split, case_id, categories array) against cases(split, case_id) and taxonomy(id, evidence_cases, new_examples): known
    cases, each once, known categories, counts as stored, and new examples that add up to `total`."""
    named = evidence.select("split", "case_id", F.explode_outer("categories").alias("id"))
    counted = named.groupBy("id").agg(F.count("*").alias("_n"))
    key = F.concat_ws("/", F.col("split"), F.col("case_id").cast("string"))
    return check_rows({
        "unknown_case": detail(evidence.join(cases, ["split", "case_id"], "left_anti"), key), "repeated_case": detail(evidence.groupBy("split", "case_id").count().where("count > 1"), key),
        "unknown_category": detail(named.join(taxonomy.select("id"), "id", "left_anti"), "id"), "repeated_category": repeated(taxonomy, "id"),
        "evidence_count": detail(taxonomy.join(counted, "id", "left").where(F.col("evidence_cases") != F.coalesce("_n", F.lit(0))), "id"),
        "no_new_examples": detail(taxonomy.where(~F.coalesce(F.col("new_examples") > 0, F.lit(False))), "id"),
        "allocation": detail(taxonomy.agg(F.coalesce(F.sum("new_examples"), F.lit(0)).alias("n")).where(F.col("n") != total), "n"),
    })


def subset_audit(wanted: DataFrame, cases: DataFrame, key: str, size: int, quotas: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Checks of a fixed list of ids: known, each once, `size` of them, and quotas of columns over the cases that it picks."""
    picked = cases.join(wanted.select(key).distinct(), key, "left_semi")
    found = {
        "unknown": detail(wanted.join(cases, key, "left_anti"), key), "repeated": repeated(wanted, key),
        "size": detail(wanted.agg(F.count("*").alias("n")).where(F.col("n") != size), "n"),
    }
    return check_rows(found | {f"quota:{c}": unequal_counts(picked, c, q) for c, q in quotas.items()})


def resume_audit(files: DataFrame, required: Sequence[str], marker_name: str, marker: str, state_name: str, step: int, digest: str, folder: DataFrame) -> DataFrame:
    """Checks of a checkpoint before a run goes on from it: files(path, content text) hold the required names, the marker names the
    source, the state the step, and folder(digest) is the one that was recorded."""
    spark = files.sparkSession
    need = spark.createDataFrame([(r,) for r in required], "path string")
    told = F.try_variant_get(F.try_parse_json("content"), "$.global_step", "bigint")
    own = lambda name: files.where(F.col("path") == name)
    return check_rows({
        "missing_file": detail(need.join(files, "path", "left_anti"), "path"), "marker": detail(own(marker_name).where(F.regexp_replace("content", r"^\s+|\s+\z", "") != marker), "content"),
        "step": detail(own(state_name).where(~told.eqNullSafe(F.lit(step).cast("long"))), "content"), "digest": detail(folder.where(F.col("digest") != digest), "digest"),
    })
