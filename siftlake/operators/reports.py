"""Aggregations over findings: counts, scores, gates, compliance, scan diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.severity import lookup, rank

LEVELS = ["critical", "high", "medium", "low", "info"]


def _level(severity: str = "severity") -> Column:
    low = F.lower(F.trim(severity))
    return F.when(low.isin(LEVELS), low).otherwise("info")


def severity_counts(findings: DataFrame, *group: str) -> DataFrame:
    """Number of findings of each level; unknown and null severities count as info."""
    return findings.groupBy(*group).agg(
        *[F.count_if(_level() == s).alias(s) for s in LEVELS], F.count("*").alias("total"), F.count_if(F.coalesce("auto_fix", F.lit(False))).alias("auto_fixable")
    )


def marker_groups(findings: DataFrame) -> DataFrame:
    """Counts by severity, by rule, by file and over all, from one pass with grouping sets."""
    view = findings.select(_level().alias("severity"), "rule_id", F.coalesce("file", F.lit("unknown")).alias("file"))
    sets = [[F.col("severity")], [F.col("rule_id")], [F.col("file")], []]
    return view.groupingSets(sets, "severity", "rule_id", "file").agg(F.count("*").alias("n"))


def rollup(findings: DataFrame, outer: str) -> DataFrame:
    return findings.select(F.coalesce(outer, F.lit("unknown")).alias(outer), _level().alias("severity")).rollup(outer, "severity").agg(F.count("*").alias("n"))


def score_grade(findings: DataFrame, group: str) -> DataFrame:
    """100 less 20, 10, 5 and 1 for each critical, high, medium and low finding, 0 at least; A from 95, B 85, C 70, D 50."""
    weights = findings.groupBy(group).agg(F.sum(rank("severity", "score_weight")).alias("weight"), F.count("*").alias("n"))
    score = F.greatest(F.lit(0), 100 - F.col("weight"))
    grade = F.when(score >= 95, "A").when(score >= 85, "B").when(score >= 70, "C").when(score >= 50, "D").otherwise("F")
    return weights.select(group, "n", score.cast("bigint").alias("score"), grade.alias("grade"))


def scan_hash(findings: DataFrame, group: str) -> DataFrame:
    """First 12 hex digits of the SHA-256 of the sorted keys of a scan, joined by bars. The keys are those of one scan."""
    key = F.concat_ws(":", "rule_id", "file", F.col("line").cast("string"))
    return findings.groupBy(group).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "|"), 256), 1, 12).alias("scan_hash"))


def scan_diff(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key of either scan with its status: new, remediated or unchanged; one aggregation over the tagged union. Null keys compare as equal."""
    both = previous.select(*keys, F.lit(1).alias("p"), F.lit(0).alias("c")).unionByName(current.select(*keys, F.lit(0).alias("p"), F.lit(1).alias("c")))
    status = F.when(F.max("p") == 0, "new").when(F.max("c") == 0, "remediated").otherwise("unchanged")
    return both.groupBy(*keys).agg(status.alias("status"))


def remediation_rate(diff: DataFrame, *group: str) -> DataFrame:
    """Percentage of the previous keys that are gone, to one place, ties to the even digit; 0 without previous keys."""
    gone, before = F.count_if(F.col("status") == "remediated"), F.count_if(F.col("status") != "new")
    return diff.groupBy(*group).agg(gone.alias("remediated"), before.alias("previous"), F.coalesce(F.bround(F.try_divide(gone * 100, before), 1), F.lit(0.0)).alias("rate"))


def policy_gate(findings: DataFrame, group: str, threshold: str, blocked: Sequence[str] = (), excluded: Sequence[str] = ()) -> DataFrame:
    """Violations of a policy and whether it passes: findings at the threshold or of a blocked rule, outside the excluded paths."""
    from siftlake.functions.severity import RANKS
    from siftlake.operators.findings import outside_paths

    hit = (rank("severity", "threshold") >= RANKS["threshold"][0][threshold]) | F.col("rule_id").isin(list(blocked))
    kept = outside_paths(findings, excluded)
    return kept.groupBy(group).agg(
        F.count_if(hit).alias("violations"), F.count_if(F.col("rule_id").isin(list(blocked))).alias("blocked"), (F.count_if(hit) == 0).alias("passed")
    )


def compliance(findings: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per framework: requirements, covered ones and score. A requirement is covered if a finding matches one of its
    CWEs, or any finding if it names none. Findings are first reduced to their distinct CWEs."""
    seen = findings.select("cwe_id").distinct()
    listed = requirements.select("framework", "req_id", F.explode_outer("cwe_ids").alias("cwe_id"))
    named = listed.where("cwe_id is not null").join(seen.where("cwe_id is not null"), "cwe_id", "left_semi").select("framework", "req_id").distinct()
    some = seen.agg((F.count("*") > 0).alias("some"))
    covered = requirements.join(named.withColumn("hit", F.lit(1)), ["framework", "req_id"], "left").crossJoin(F.broadcast(some))  # one row: an aggregate without keys
    covered = covered.withColumn("covered", F.col("hit").isNotNull() | ((F.size("cwe_ids") == 0) & F.col("some")))
    return covered.groupBy("framework").agg(
        F.count("*").alias("requirements"), F.count_if("covered").alias("covered"), F.round(F.count_if("covered") * 100 / F.count("*"), 1).alias("score")
    )


def check_run(findings: DataFrame, group: str) -> DataFrame:
    """Conclusion of a check: failure with a critical finding, action_required with a high one, neutral with any."""
    low = F.lower("severity")
    return findings.groupBy(group).agg(
        F.when(F.count_if(low == "critical") > 0, "failure").when(F.count_if(low == "high") > 0, "action_required").when(F.count("*") > 0, "neutral").otherwise("success").alias("conclusion")
    )


def levels(findings: DataFrame) -> DataFrame:
    """SARIF level of each severity that occurs, and how often."""
    from siftlake.functions.severity import SARIF_LEVEL

    return findings.groupBy(lookup("severity", *SARIF_LEVEL).alias("level")).agg(F.count("*").alias("n"))
