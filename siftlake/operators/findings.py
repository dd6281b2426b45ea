"""Operators on findings: filters, de-duplication, baselines, ignore lists, ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text
from siftlake.functions.severity import rank
from siftlake.session import checkpoint


def severity_in(findings: DataFrame, severities: Iterable[str], column: str = "severity") -> DataFrame:
    """Findings whose severity, in lower case, is in the set; an empty set keeps all. Null counts as info."""
    wanted = [s.lower() for s in severities]
    return findings.where(F.lower(F.coalesce(column, F.lit("info"))).isin(wanted)) if wanted else findings


def at_least(findings: DataFrame, threshold: str, column: str = "severity") -> DataFrame:
    """Findings whose rank by the threshold table reaches that of `threshold`."""
    from siftlake.functions.severity import RANKS

    return findings.where(rank(column, "threshold") >= RANKS["threshold"][0].get(threshold.lower(), 0))


def rules_in(findings: DataFrame, rules: Iterable[str]) -> DataFrame:
    """Findings of these rules; none named keeps all."""
    wanted = list(rules)
    return findings.where(F.col("rule_id").isin(wanted)) if wanted else findings


def outside_paths(findings: DataFrame, parts: Iterable[str], column: str = "file") -> DataFrame:
    """Without findings of files whose path contains any of the parts. A null path contains none."""
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.coalesce(F.col(column).contains(p), F.lit(False))
    return findings.where(~hit)


def strongest(findings: DataFrame, keys: tuple[str, ...] = ("file", "line", "rule_id"), first: tuple[str, ...] = ("finding_id",)) -> DataFrame:
    """One row per key: the one of the highest dedup rank, ties to the least of `first`.

    A pre-aggregated max_by over whole rows, so that a hot key is reduced before the shuffle.
    Nulls in keys are a key value of their own.
    """
    order = F.struct(rank("severity", "dedup").alias("r"), *[(-F.col(c)).alias(c) for c in first])
    rest = [c for c in findings.columns if c not in keys]
    best = findings.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return best.select(*keys, "x.*").select(*findings.columns)


def merged_across_layers(findings: DataFrame) -> DataFrame:
    """One row per file, category, line and snippet: the strongest rule, all rules and the number of duplicates avoided.

    Rules of different packs that speak of the same weakness share a category (SEC-001 and
    RUST-SEC-001). Snippets are told apart by eight digits of a hash; null and empty ones are alike. Of equally
    severe findings the first by finding_id leads. `file` is part of the key, since scans merge within a file.
    """
    snippet = F.coalesce("snippet", F.lit(""))
    key = ["file", text.category_key(F.col("rule_id")).alias("category"), "line", F.when(snippet == "", "empty").otherwise(F.substring(F.md5(snippet), 1, 8)).alias("snippet_hash")]
    order = F.struct(rank("severity", "cross_layer"), -F.col("finding_id"))
    return findings.groupBy(*key).agg(
        F.max_by("rule_id", order).alias("primary_rule_id"),
        F.max_by("severity", order).alias("severity"),
        F.array_sort(F.collect_set("rule_id")).alias("detected_by"),
    ).withColumn("avoided", F.size("detected_by") - 1)


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", text.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")))


def not_in_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint is not in the baseline (left anti join); null fingerprints are never in it."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def not_ignored(findings: DataFrame, ignores: Iterable[tuple[str, str | None, int | None]]) -> DataFrame:
    """Without findings that an ignore entry names: rule, file pattern as fnmatch has it or None, line or None.

    The entries are a configuration of the caller, not data; they become one predicate.
    """
    hit = F.lit(False)
    for rule, glob, line in ignores:
        one: Column = F.col("rule_id") == rule
        if glob is not None:
            one = one & F.col("file").rlike(text.glob_regex(glob))
        if line is not None:
            one = one & (F.col("line") == line)
        hit = hit | F.coalesce(one, F.lit(False))
    return findings.where(~hit)


def unchanged_skipped(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose (path, state) was not seen by the last scan."""
    return files.join(state.select("path", "state").distinct(), ["path", "state"], "left_anti")


def prioritised(findings: DataFrame, confidence: Column | None = None) -> DataFrame:
    """With priority: (5 - marker order) times confidence, and a fifth more if there is a fix."""
    weight = (F.lit(5) - rank("severity", "marker_order")).cast("double") * (F.lit(1.0) if confidence is None else confidence)
    return findings.withColumn("priority", weight * F.when(F.col("auto_fix"), 1.2).otherwise(1.0))


def top_per(findings: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in the given order, as a top-k report. Spark prunes the window by rank before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def marker_ids(findings: DataFrame, *order: str, prefix: str = "") -> DataFrame:
    """With marker_id: prefix, code of the category and a running number within it, of four digits at least.

    Categories are few and one may hold most rows, so numbers are not given by a window per
    category: rows are parted by ranges of (category, order), numbered within each part, and raised by the
    counts of the parts before, of which there are as many rows as parts. `order` must tell rows apart; equal rows get
    numbers of their own. Null rule ids are of the default category. Columns of the names used inside are replaced.
    """
    n = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    category = text.marker_category(F.col("rule_id"))
    parted = findings.withColumn("__cat", category).repartitionByRange(n, "__cat", *order)
    parted = checkpoint(parted.withColumn("__part", F.spark_partition_id()))
    counts = parted.groupBy("__cat", "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__cat").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__cat", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # One row for each part and the few categories in it.
    numbered = parted.join(F.broadcast(counts), ["__cat", "__part"])
    number = (F.row_number().over(Window.partitionBy("__part", "__cat").orderBy(*order)) + F.col("__base")).cast("string")
    code = text.lookup(F.col("__cat"), text.MARKER_CODES)
    digits = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    name = F.concat_ws("-", F.nullif(F.lit(prefix), F.lit("")), F.nullif(code, F.lit("")), digits)
    return numbered.withColumn("marker_id", name).drop("__cat", "__part", "__base")
