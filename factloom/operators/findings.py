"""Findings of runs and quality metrics: profiles, bag and set differences, summaries, accuracy, ratchets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

c = F.col


def apply_rule_profile(findings: DataFrame, rules: DataFrame, profile: DataFrame) -> DataFrame:
    """Findings without those of disabled rules; severity from the profile, else their own, else the rule's. rules: (rule_id, severity); profile: (rule_id, disabled, severity)."""
    x = findings.join(rules.select("rule_id", c("severity").alias("_rule")), "rule_id", "left").join(profile.select("rule_id", "disabled", c("severity").alias("_profile")), "rule_id", "left")
    return x.where("not coalesce(disabled, false)").withColumn("severity", F.coalesce("_profile", "severity", "_rule")).select(findings.columns)


#: What a changed finding is compared by, where both runs have the column.
COMPARED = ("message", "severity", "confidence", "source", "analyzer", "artifact", "detail", "suggestion", "data")


def findings_diff(baseline: DataFrame, current: DataFrame, compared: tuple = COMPARED) -> DataFrame:
    """(status, rule_id, path, line, symbol, changed): two runs compared as bags.

    First the n-th finding of a fingerprint (rule, path, line, symbol, message) meets the n-th: unchanged, whatever else
    differs. What is left meets by (rule, path, line, symbol), in the order of the message: changed, with the compared
    columns that differ. The rest is new or resolved. Missing values are equal to each other.
    """
    anchor = ["rule_id", "path", "line", "symbol"]
    fields = [x for x in compared if x in baseline.columns and x in current.columns]

    def keyed(df: DataFrame, *parts: str):
        return F.concat_ws("\x1f", *(F.coalesce(c(x).cast("string"), F.lit("\x1e")) for x in parts))

    def paired(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
        side = lambda df, name: df.select(keyed(df, *key).alias("key"), F.struct(*anchor, *fields).alias(name)).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(*(c(f"{name}.{x}") for x in fields))))
        return side(a, "old").join(side(b, "new"), ["key", "n"], "full_outer")

    shown = lambda side: [c(f"{side}.{x}").alias(x) for x in anchor]
    first = paired(baseline, current, *anchor, "message")
    out = first.where("old is not null and new is not null").select(F.lit("unchanged").alias("status"), *shown("new"), F.lit("").alias("changed"))
    left = lambda side, other: first.where(f"{other} is null").select(f"{side}.*")
    second = paired(left("old", "new"), left("new", "old"), *anchor)
    changed = F.concat_ws(",", *(F.when(~c(f"old.{x}").eqNullSafe(c(f"new.{x}")), F.lit(x)) for x in fields))
    both = c("old").isNotNull() & c("new").isNotNull()
    status = F.when(c("old").isNull(), "new").when(c("new").isNull(), "resolved").otherwise("changed")
    at = [F.coalesce(c(f"new.{x}"), c(f"old.{x}")).alias(x) for x in anchor]
    return out.unionByName(second.select(status.alias("status"), *at, F.when(both, changed).otherwise("").alias("changed")))


def findings_set_diff(baseline: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys with their status: added, removed or surviving."""
    a, b = baseline.select(*key).distinct(), current.select(*key).distinct()
    s = lambda df, x: df.withColumn("status", F.lit(x))
    return s(b.join(a, key, "left_anti"), "added").unionByName(s(a.join(b, key, "left_anti"), "removed")).unionByName(s(a.join(b, key, "left_semi"), "surviving"))


def severity_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(rule_id) whose findings have other severities than before, counted: new rules and rules gone are among them. A missing severity is ''."""
    count = lambda df, n: df.where("rule_id is not null").groupBy("rule_id", F.coalesce("severity", F.lit("")).alias("severity")).agg(F.count("*").alias(n))
    x = count(baseline, "a").join(count(current, "b"), ["rule_id", "severity"], "full_outer")
    return x.where(~c("a").eqNullSafe(c("b"))).select("rule_id").distinct()


def findings_summary(findings: DataFrame, prefix: str = "semantic.") -> DataFrame:
    """(grp, value, n): counts per rule, category and severity, of rules with the prefix, in one pass of grouping sets."""
    f = findings.where(F.startswith("rule_id", F.lit(prefix)))
    x = f.groupingSets([["rule_id"], ["category"], ["severity"]], "rule_id", "category", "severity").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    grp = F.when(c("g") == 3, "rule").when(c("g") == 5, "category").otherwise("severity")
    return x.select(grp.alias("grp"), F.when(c("g") == 3, c("rule_id")).when(c("g") == 5, c("category")).otherwise(c("severity")).alias("value"), "n")


def rule_metrics(findings: DataFrame, registry: DataFrame) -> DataFrame:
    """(rule_id, fires, targets, never_triggered) for every registered rule."""
    per = findings.groupBy("rule_id").agg(F.count("*").alias("fires"), F.count_distinct("path").alias("targets"))
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    return registry.select("rule_id").distinct().join(per, "rule_id", "left").select("rule_id", zero("fires"), zero("targets"), c("fires").isNull().alias("never_triggered"))


def accuracy(findings: DataFrame, annotations: DataFrame) -> DataFrame:
    """(rule_id, correct, false_positive, missed_issue, total, precision) per rule, and of all (rule_id null).

    A finding's verdict is that of the annotation of its fingerprint (of several the greatest), counted for the
    annotation's rule; without one, high and critical findings are missed_issue and all others correct. A missing rule is
    unknown. precision: correct of total, to four digits. findings: (fingerprint, rule_id, severity); annotations: (fingerprint, annotation, rule_id).
    """
    told = annotations.groupBy("fingerprint").agg(F.max(F.struct("annotation", "rule_id")).alias("a"))
    x = findings.select("fingerprint", "rule_id", "severity").join(told, "fingerprint", "left")
    default = F.when(F.coalesce(c("severity").isin("high", "critical"), F.lit(False)), "missed_issue").otherwise("correct")
    x = x.select(F.coalesce(F.when(c("a").isNotNull(), c("a.rule_id")).otherwise(c("rule_id")), F.lit("unknown")).alias("rule_id"), F.coalesce("a.annotation", default).alias("verdict"))
    n = lambda v: F.count_if(c("verdict") == v).alias(v)
    per = x.rollup("rule_id").agg(n("correct"), n("false_positive"), n("missed_issue"), F.count("*").alias("total"))
    return per.where("total > 0").withColumn("precision", F.bround(c("correct") / c("total"), 4))


def findings_per_kloc(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(category, findings, per_kloc, ignored, fixed): findings over thousands of lines, one thousand at least, and how many fingerprints say ignored or fixed. files: (category, lines); findings: (category, fingerprint)."""
    k = files.groupBy("category").agg(F.greatest(F.expr("sum(lines) div 1000"), F.lit(1)).alias("k"))
    says = lambda x: F.count_if(F.contains(F.lower("fingerprint"), F.lit(x))).alias(x)
    n = findings.groupBy("category").agg(F.count("*").alias("findings"), says("ignored"), says("fixed"))
    zero = lambda x: F.coalesce(c(x), F.lit(0)).alias(x)
    return k.join(n, "category", "left").select("category", zero("findings"), F.bround(F.coalesce("findings", F.lit(0)) / c("k"), 2).alias("per_kloc"), zero("ignored"), zero("fixed"))


def rule_frequency(findings: DataFrame) -> DataFrame:
    """(category, rule_id, n): how often each rule fires; a missing rule is unknown."""
    return findings.groupBy("category", F.coalesce("rule_id", F.lit("unknown")).alias("rule_id")).agg(F.count("*").alias("n"))


def failure_runs(runs: DataFrame) -> DataFrame:
    """(signature, run_id, captured_at) of runs that didn't pass.

    runs: (run_id, captured_at, kind, status, surface, gate, failures, checks; the last two arrays). A signature is the kind
    (audit if missing), the surface, finish: and the gate's status, and the first five failures or, without any, the first five
    checks; blank ones are left out. A run with a kind alone has no signature.
    """
    some = lambda x: F.slice(F.filter(F.coalesce(c(x), F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != "")), 1, 5)
    parts = F.concat(
        F.array(F.coalesce("kind", F.lit("audit"))), F.array(F.when(c("surface") != "", c("surface")), F.when(c("gate") != "", F.concat(F.lit("finish:"), "gate"))), F.when(F.size(some("failures")) > 0, some("failures")).otherwise(some("checks"))
    )
    x = runs.where(~c("status").eqNullSafe(F.lit("pass"))).withColumn("parts", F.array_compact(parts)).where(F.size("parts") > 1)
    return x.select(F.array_join("parts", "|").alias("signature"), "run_id", "captured_at")


def failure_patterns(runs: DataFrame) -> DataFrame:
    """(signature, occurrences, latest_run, latest_at) of failure_runs; its rows are each pattern's runs."""
    f = failure_runs(runs)
    return f.groupBy("signature").agg(F.count("*").alias("occurrences"), F.max_by("run_id", F.struct("captured_at", "run_id")).alias("latest_run"), F.max("captured_at").alias("latest_at"))


def corpus_evaluation(cases: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, missing, forbidden_hits, passed): expected ids not found, forbidden ids found. cases: arrays expected, forbidden; found: (case_id, id)."""
    actual = found.groupBy("case_id").agg(F.collect_set("id").alias("actual"))
    x = cases.join(actual, "case_id", "left").withColumn("actual", F.coalesce("actual", F.array().cast("array<string>")))
    missing, hits = F.sort_array(F.array_except("expected", "actual")), F.sort_array(F.array_intersect("actual", "forbidden"))
    return x.select("case_id", F.array_join(missing, ",").alias("missing"), F.array_join(hits, ",").alias("forbidden_hits"), ((F.size(missing) == 0) & (F.size(hits) == 0)).alias("passed"))


def ratchet_check(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, value, max_value, min_value): metrics beyond a limit; a missing one is 0."""
    x = limits.join(metrics, "metric", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return x.where("value > max_value or value < min_value").select("metric", "value", "max_value", "min_value")


def change_coverage(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, measured, covered, unmeasured, reported): changed lines per file, and in total (path null; reported: whether any file is). lines: (path, line, hits); changed: (path, line)."""
    x = changed.distinct().join(lines.groupBy("path", "line").agg(F.max("hits").alias("hits")), ["path", "line"], "left")
    per = x.groupBy("path").agg(F.count("hits").alias("measured"), F.count_if(c("hits") > 0).alias("covered"), F.count_if(c("hits").isNull()).alias("unmeasured"))
    per = per.join(lines.select("path").distinct().withColumn("reported", F.lit(True)), "path", "left").withColumn("reported", F.coalesce("reported", F.lit(False)))
    n = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    total = per.agg(n("measured"), n("covered"), n("unmeasured"), F.coalesce(F.bool_or("reported"), F.lit(False)).alias("reported"))
    return per.unionByName(total.withColumn("path", F.lit(None).cast("string")))
