"""Findings as the documents of other tools. One document per group, built by aggregation; a group is one scan or repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import severity as sv
from siftlake.functions import text as tx


def _pair(severity: str, table: tuple) -> tuple[Column, Column]:
    mapping, default = table
    return tuple(sv.lookup(severity, {k: v[i] for k, v in mapping.items()}, default[i]) for i in (0, 1))


def json_lines(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct("rule_id", "severity", "cwe_id", "cvss_score", "owasp_id", "file", "line", "snippet", "problem", "fix_hint", "auto_fix")).alias("value"))


def codeclimate(findings: DataFrame) -> DataFrame:
    """The fields of a CodeClimate issue for each finding."""
    level, points = _pair("severity", sv.CODECLIMATE)
    return findings.select(
        F.lit("issue").alias("type"), F.col("rule_id").alias("check_name"), F.col("problem").alias("description"), level.alias("severity"),
        points.cast("bigint").alias("remediation_points"), F.col("file").alias("path"), F.col("line").alias("begin_line"), tx.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")).alias("fingerprint"),
    )


def sonar(findings: DataFrame) -> DataFrame:
    level, effort = _pair("severity", sv.SONAR)
    return findings.select(
        F.lit("siftlake").alias("engine_id"), "rule_id", level.alias("severity"), F.lit("VULNERABILITY").alias("type"), effort.cast("bigint").alias("effort_minutes"),
        F.col("problem").alias("message"), F.col("file").alias("file_path"), F.col("line").alias("start_line"),
    )


def gitlab_sast(findings: DataFrame, group: str = "scan_id") -> DataFrame:
    item = F.struct(
        tx.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")).alias("id"), F.lit("sast").alias("category"), F.col("problem").alias("name"), F.initcap("severity").alias("severity"),
        F.struct(F.col("file").alias("file"), F.col("line").alias("start_line")).alias("location"), F.array(F.struct(F.lit("cwe").alias("type"), F.col("cwe_id").alias("value"))).alias("identifiers"),
    )
    return findings.groupBy(group).agg(F.to_json(F.struct(F.lit("15.0.0").alias("version"), F.array_sort(F.collect_list(item)).alias("vulnerabilities"))).alias("document"))


def sarif(findings: DataFrame, group: str = "scan_id", tool: str = "siftlake") -> DataFrame:
    """One SARIF 2.1.0 log per group; results refer to the rules array by index."""
    level = sv.lookup("severity", *sv.SARIF_LEVEL)
    rules = F.array_sort(F.collect_set("rule_id"))
    results = F.array_sort(F.collect_list(F.struct("file", "line", "rule_id", level.alias("level"), F.coalesce("problem", F.lit("")).alias("problem"), tx.fingerprint(F.col("rule_id"), F.col("file"), F.col("line")).alias("print"))))
    grouped = findings.groupBy(group).agg(rules.alias("ids"), results.alias("found"))
    body = F.transform("found", lambda r: F.struct(
        r["rule_id"].alias("ruleId"), (F.array_position("ids", r["rule_id"]) - 1).cast("int").alias("ruleIndex"), r["level"].alias("level"), F.struct(r["problem"].alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(r["file"].alias("uri")).alias("artifactLocation"), F.struct(r["line"].alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(r["print"].alias("primary")).alias("partialFingerprints"),
    ))
    driver = F.struct(F.struct(F.lit(tool).alias("name"), F.transform("ids", lambda i: F.struct(i.alias("id"))).alias("rules")).alias("driver"))
    log = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), body.alias("results"))).alias("runs"))
    return grouped.select(group, F.size("found").alias("n_results"), F.to_json(log).alias("document"))


def junit(findings: DataFrame, group: str = "scan_id") -> DataFrame:
    case = F.concat(
        F.lit('<testcase classname="'), tx.xml_escape(F.coalesce("file", F.lit(""))), F.lit('" name="'), F.col("rule_id"), F.lit('"><failure message="'),
        tx.xml_escape(F.coalesce("problem", F.lit(""))), F.lit('"/></testcase>'),
    )
    return findings.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(case)).alias("cases")).select(
        group, F.concat(F.lit('<testsuite tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("n").cast("string"), F.lit('">'), F.array_join("cases", ""), F.lit("</testsuite>")).alias("document")
    )


def html(findings: DataFrame, group: str = "scan_id") -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), tx.xml_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in ("severity", "rule_id", "file", "line", "problem")], F.lit("</tr>"))
    return findings.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(group, F.concat(F.lit("<table>"), F.array_join("rows", ""), F.lit("</table>")).alias("document"))


def markdown(findings: DataFrame, group: str = "scan_id") -> DataFrame:
    row = F.concat(F.lit("| "), F.concat_ws(" | ", F.coalesce("severity", F.lit("info")), "rule_id", "file", F.col("line").cast("string"), F.replace(F.coalesce("problem", F.lit("")), F.lit("|"), F.lit("\\|"))), F.lit(" |"))
    return findings.groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("rows")).select(group, F.concat(F.lit("| severity | rule | file | line | problem |\n|---|---|---|---|---|\n"), F.array_join("rows", "\n")).alias("document"))


def text_report(findings: DataFrame, group: str = "scan_id") -> DataFrame:
    """Lines of a plain report, most severe first."""
    r = sv.rank("severity", "threshold")
    item = F.struct((-r).alias("r"), "file", "line", "rule_id", F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("severity", F.lit("info")).alias("severity"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.format_string("[%s] %s:%d %s %s", F.upper(x["severity"]), x["file"], x["line"], x["rule_id"], x["problem"]))
    return findings.groupBy(group).agg(F.array_join(lines, "\n").alias("document"))
