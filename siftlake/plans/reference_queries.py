"""Queries of the analysis engine's own operators over the project's tables, each with the same in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import severity as sv
from siftlake.functions import text as tx
from siftlake.operators import clean as cl
from siftlake.operators import code as cd
from siftlake.operators import dependencies as dp
from siftlake.operators import facts as lf
from siftlake.operators import findings as fd
from siftlake.operators import fixes as fx
from siftlake.operators import packs
from siftlake.operators import reports as rp
from siftlake.operators.scan import scan
from siftlake.plans import export
from siftlake.session import shared_dir, table
from siftlake.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _case(table_name: str, column: str = "severity") -> str:
    mapping, default = sv.RANKS[table_name]
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def _map(mapping: dict, default, column: str = "severity") -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {q(default)} END"


F0 = "(SELECT DISTINCT * FROM findings)"
_LEVEL = "CASE WHEN lower(trim(severity)) IN ('critical','high','medium','low','info') THEN lower(trim(severity)) ELSE 'info' END"
_PRINT = "sha256(concat_ws(':', coalesce(rule_id,''), coalesce(file,''), coalesce(CAST(line AS VARCHAR),'')))"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "findings").distinct()


def _lines_sql(source: str, key: str, body: str, extra: str = "") -> str:
    """Lines of a table; `extra` is a further expression, called lang."""
    more, lang = (f", {extra} AS lang", ", lang") if extra else ("", "")
    return (
        f"SELECT {key}{lang}, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM "
        f"(SELECT {key}{more}, string_split_regex(regexp_replace({body}, '\\r?\\n\\z', ''), '\\r?\\n') AS ls FROM {source} WHERE {body} IS NOT NULL)"
    )


def _scan_sql(rules, source: str, key: str, body: str, language: str | None = None) -> str:
    """The rules as one union over the lines, and over the texts for rules on whole texts."""
    lines = _lines_sql(source, key, body, language or "")
    q = lambda p: p.replace("'", "''")
    parts = []
    for r in rules:
        p, g = q(r.pattern), q(r.guard)
        if r.languages and not language:
            continue
        lang = " AND {} IN (" + ", ".join(f"'{x}'" for x in r.languages) + ")" if r.languages else ""
        head = f"SELECT {key} AS file_id, '{r.pack}' AS pack, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity"
        guard = f" AND regexp_matches({body}, '(?m){g}')" if g else ""
        if r.mode == "absent":
            parts.append(f"{head}, 1 AS line, '' AS match FROM {source} WHERE {body} IS NOT NULL AND NOT regexp_matches({body}, '(?m){p}'){guard}{lang.format(language)}")
        elif r.mode == "text":
            m = f"regexp_extract({body}, '(?m){p}', 0)"
            parts.append(f"{head}, len(string_split(substr({body}, 1, greatest(instr({body}, {m}) - 1, 0)), chr(10))) AS line, {m} AS match FROM {source} WHERE regexp_matches({body}, '(?m){p}'){guard}{lang.format(language)}")
        else:
            parts.append(f"{head}, CAST(n AS BIGINT) AS line, regexp_extract(l, '{p}', 0) AS match FROM ls WHERE regexp_matches(l, '{p}'){lang.format('lang')}")
    return f"WITH ls AS ({lines}) " + " UNION ALL ".join(parts)


# --- scans -----------------------------------------------------------------------------------

_HIT = ["file_id", "pack", "rule_id", "severity", "line", "match"]
_ENTERPRISE = [r for r in packs.RULES if r.pack == "enterprise"]
_AI = [r for r in packs.RULES if r.pack == "ai"]
_EXT = "CASE ext " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in tx.EXTENSIONS.items()) + " END"


@query(_scan_sql(_ENTERPRISE, "documents", "doc_id", "text"))
def scan_documents_enterprise(spark, d):
    return scan(table(spark, d, "documents"), _ENTERPRISE, "doc_id", "text").select(*_HIT)


@query(_scan_sql(_AI, "documents", "doc_id", "text"))
def scan_documents_ai(spark, d):
    return scan(table(spark, d, "documents"), _AI, "doc_id", "text").select(*_HIT)


def _scanned(spark, d):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return scan(files, packs.rules_of("all"), "file_id", "code", "language").select(*_HIT)


_ALL_SQL = _scan_sql(packs.RULES, "github_files", "file_id", "code", _EXT)


@query(_ALL_SQL)
def scan_files(spark, d):
    return _scanned(spark, d)


@query(f"SELECT pack, rule_id, severity, count(*) AS hits, count(DISTINCT file_id) AS files FROM ({_ALL_SQL}) GROUP BY ALL")
def scan_rule_counts(spark, d):
    return _scanned(spark, d).groupBy("pack", "rule_id", "severity").agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("files"))


@query(f"SELECT file_id, line, rule_id, max_by(severity, r) AS severity FROM (SELECT *, {_case('dedup')} AS r FROM ({_ALL_SQL})) GROUP BY ALL")
def scan_dedup(spark, d):
    hits = _scanned(spark, d)
    return hits.groupBy("file_id", "line", "rule_id").agg(F.max_by("severity", sv.rank("severity", "dedup")).alias("severity"))


@query(f"WITH ls AS ({_lines_sql('documents', 'doc_id', 'text')}) SELECT doc_id, CAST(n AS BIGINT) AS line, l AS text FROM ls WHERE regexp_matches(l, '(?i)\\blicen[cs]e')")
def license_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("n", "text"))
    return docs.where(F.col("text").rlike(r"(?i)\blicen[cs]e")).select("doc_id", (F.col("n") + 1).cast("bigint").alias("line"), "text")


@query("SELECT f.file_id FROM github_files f WHERE regexp_matches(code, '(?i)<html') AND NOT regexp_matches(code, 'Content-Security-Policy')")
def absence_rule(spark, d):
    return scan(table(spark, d, "github_files"), [packs.Rule("security", "SEC-034", "medium", "Content-Security-Policy", mode="absent", guard="(?i)<html")], "file_id", "code").select("file_id")


# --- filters ---------------------------------------------------------------------------------


@query(f"SELECT finding_id, severity FROM {F0} WHERE lower(coalesce(severity, 'info')) IN ('critical', 'high')")
def filter_severity(spark, d):
    return fd.severity_in(_findings(spark, d), ["critical", "HIGH"]).select("finding_id", "severity")


@query(f"SELECT finding_id FROM {F0} WHERE {_case('threshold')} >= 3")
def filter_threshold(spark, d):
    return fd.at_least(_findings(spark, d), "medium").select("finding_id")


@query(f"SELECT finding_id, rule_id FROM {F0} WHERE rule_id IN ('SEC-001', 'SEC-010', 'LNG-005')")
def filter_rules(spark, d):
    return fd.rules_in(_findings(spark, d), ["SEC-001", "SEC-010", "LNG-005"]).select("finding_id", "rule_id")


@query(f"SELECT finding_id FROM {F0} WHERE file IS NULL OR NOT (contains(file, 'vendor/') OR contains(file, 'node_modules') OR contains(file, 'test'))")
def filter_paths(spark, d):
    return fd.outside_paths(_findings(spark, d), ["vendor/", "node_modules", "test"]).select("finding_id")


@query(
    f"SELECT finding_id FROM {F0} WHERE NOT coalesce(rule_id = 'SEC-001' AND file GLOB 'src/*', false) AND NOT coalesce(rule_id = 'SEC-002', false) AND NOT coalesce(rule_id = 'LNG-010' AND line = 5, false)"
)
def ignore_list(spark, d):
    return fd.not_ignored(_findings(spark, d), [("SEC-001", "src/*", None), ("SEC-002", None, None), ("LNG-010", None, 5)]).select("finding_id")


@query(f"WITH b AS (SELECT {_PRINT} AS fp FROM findings WHERE finding_id % 3 = 0) SELECT finding_id FROM {F0} WHERE {_PRINT} NOT IN (SELECT fp FROM b)")
def baseline_new(spark, d):
    found = fd.with_fingerprint(_findings(spark, d))
    baseline = found.where("finding_id % 3 = 0")  # a baseline of a third of the findings, as an earlier run would have written
    return fd.not_in_baseline(found, baseline).select("finding_id")


@query("SELECT f.file_id FROM github_files f WHERE NOT EXISTS (SELECT 1 FROM github_files g WHERE g.file_id < f.file_id AND g.path = f.path AND g.repo = f.repo AND md5(g.code) = md5(f.code))")
def incremental_changed(spark, d):
    files = table(spark, d, "github_files").select("file_id", F.concat_ws("/", "repo", "path").alias("path"), F.md5("code").alias("state"))
    first = files.groupBy("path", "state").agg(F.min("file_id").alias("first"))
    return files.join(first, ["path", "state"]).where("file_id = first").select("file_id")


# --- de-duplication and ranking ----------------------------------------------------------------


@query(
    f"SELECT file, line, rule_id, severity, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule_id ORDER BY {_case('dedup')} DESC, finding_id) AS k FROM {F0}) WHERE k = 1"
)
def dedup_strongest(spark, d):
    return fd.strongest(_findings(spark, d)).select("file", "line", "rule_id", "severity", "finding_id")


_FAMILY = """CASE WHEN lower(rule_id) LIKE 'ai-%' THEN 'ai' WHEN lower(rule_id) LIKE 'taint-%' THEN 'taint'
    WHEN lower(rule_id) LIKE 'sec-%' OR lower(rule_id) LIKE 'rust-sec-%' OR lower(rule_id) LIKE 'py-sec-%' OR regexp_matches(lower(rule_id), 'injection|xss|sqli|ssrf|cmd|path') THEN 'security'
    WHEN lower(rule_id) LIKE 'rust-%' OR lower(rule_id) LIKE 'py-%' THEN array_to_string(string_split(rule_id, '-')[1:2], '-') ELSE rule_id END"""
_LAYERS = f"""SELECT category, file, line, snippet_hash, arg_max(rule_id, k) AS primary_rule_id, array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS detected_by, count(DISTINCT rule_id) - 1 AS avoided FROM (
    SELECT *, {_FAMILY} AS category, CASE WHEN coalesce(snippet, '') = '' THEN 'empty' ELSE substr(md5(snippet), 1, 8) END AS snippet_hash, {_case('cross_layer')} * 10000000000 - finding_id AS k FROM {F0}) GROUP BY ALL"""


@query(_LAYERS)
def dedup_across_layers(spark, d):
    m = fd.merged_across_layers(_findings(spark, d))
    return m.select("category", "file", "line", "snippet_hash", "primary_rule_id", F.array_join("detected_by", ",").alias("detected_by"), F.col("avoided").cast("bigint").alias("avoided"))


@query(f"SELECT CAST(sum(avoided) AS BIGINT) AS avoided, count(*) AS kept FROM ({_LAYERS})")
def duplicates_avoided(spark, d):
    return fd.merged_across_layers(_findings(spark, d)).agg(F.sum("avoided").alias("avoided"), F.count("*").alias("kept"))


@query(
    f"""SELECT finding_id, repo, round(priority, 4) AS priority, position FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority DESC, finding_id) AS position FROM (
    SELECT *, (5 - ({_case('marker_order')})) * CASE WHEN auto_fix THEN 1.2 ELSE 1.0 END::DOUBLE AS priority FROM {F0})) WHERE position <= 5"""
)
def priority_top5(spark, d):
    top = fd.top_per(fd.prioritised(_findings(spark, d)), "repo", 5, F.desc("priority"), F.asc("finding_id"))
    return top.select("finding_id", "repo", F.round("priority", 4).alias("priority"), F.col("position").cast("bigint").alias("position"))


_MARKER = "CASE " + " ".join(f"WHEN regexp_matches(lower(rule_id), '{w}') THEN '{tx.MARKER_CODES[n]}'" for n, w in tx.MARKER_WORDS) + " ELSE '' END"


@query(
    f"""SELECT finding_id, CASE WHEN c = '' THEN '' ELSE c || '-' END || CASE WHEN k < 10000 THEN lpad(CAST(k AS VARCHAR), 4, '0') ELSE CAST(k AS VARCHAR) END AS marker_id FROM (
    SELECT finding_id, c, row_number() OVER (PARTITION BY c ORDER BY finding_id) AS k FROM (SELECT finding_id, {_MARKER} AS c FROM {F0}))"""
)
def marker_id_sequence(spark, d):
    return fd.marker_ids(_findings(spark, d), "finding_id").select("finding_id", "marker_id")


# --- aggregations ------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER ({_LEVEL} = '{s}') AS {s}" for s in rp.LEVELS)


@query(f"SELECT repo, {_COUNTS}, count(*) AS total, count(*) FILTER (coalesce(auto_fix, false)) AS auto_fixable FROM {F0} GROUP BY repo")
def severity_by_repo(spark, d):
    return rp.severity_counts(_findings(spark, d), "repo")


@query(f"SELECT severity, rule_id, file, count(*) AS n FROM (SELECT {_LEVEL} AS severity, rule_id, coalesce(file, 'unknown') AS file FROM {F0}) GROUP BY GROUPING SETS ((severity), (rule_id), (file), ())")
def marker_groups(spark, d):
    return rp.marker_groups(_findings(spark, d))


@query(f"SELECT repo, severity, count(*) AS n FROM (SELECT coalesce(repo, 'unknown') AS repo, {_LEVEL} AS severity FROM {F0}) GROUP BY ROLLUP (repo, severity)")
def severity_rollup(spark, d):
    return rp.rollup(_findings(spark, d), "repo")


@query(
    f"""SELECT scan_id, n, greatest(0, 100 - w)::BIGINT AS score, CASE WHEN greatest(0, 100 - w) >= 95 THEN 'A' WHEN greatest(0, 100 - w) >= 85 THEN 'B' WHEN greatest(0, 100 - w) >= 70 THEN 'C' WHEN greatest(0, 100 - w) >= 50 THEN 'D' ELSE 'F' END AS grade
    FROM (SELECT scan_id, count(*) AS n, sum({_case('score_weight')}) AS w FROM {F0} GROUP BY scan_id)"""
)
def score_grade(spark, d):
    return rp.score_grade(_findings(spark, d), "scan_id")


@query(
    f"SELECT scan_id, substr(sha256(array_to_string(list_sort(list(DISTINCT concat_ws(':', rule_id, file, CAST(line AS VARCHAR)))), '|')), 1, 12) AS scan_hash FROM {F0} GROUP BY scan_id"
)
def scan_hash(spark, d):
    return rp.scan_hash(_findings(spark, d), "scan_id")


_HALVES = "(SELECT repo, rule_id, file, max(CASE WHEN finding_id % 2 = 0 THEN 1 ELSE 0 END) AS p, max(CASE WHEN finding_id % 3 > 0 THEN 1 ELSE 0 END) AS c FROM findings WHERE finding_id % 2 = 0 OR finding_id % 3 > 0 GROUP BY ALL)"
_STATUS = f"(SELECT repo, rule_id, file, CASE WHEN p = 0 THEN 'new' WHEN c = 0 THEN 'remediated' ELSE 'unchanged' END AS status FROM {_HALVES})"


def _two_scans(spark, d):
    """Two overlapping runs, told apart by id, as an earlier and a later scan of the same repositories would be."""
    found = _findings(spark, d)
    return rp.scan_diff(found.where("finding_id % 2 = 0"), found.where("finding_id % 3 > 0"), ["repo", "rule_id", "file"])


@query(f"SELECT * FROM {_STATUS}")
def scan_diff(spark, d):
    return _two_scans(spark, d)


@query(
    f"SELECT repo, count(*) FILTER (status = 'remediated') AS remediated, count(*) FILTER (status <> 'new') AS previous, coalesce(round_even(count(*) FILTER (status = 'remediated') * 100 / nullif(count(*) FILTER (status <> 'new'), 0), 1), 0.0) AS rate FROM {_STATUS} GROUP BY repo"
)
def remediation_rate(spark, d):
    return rp.remediation_rate(_two_scans(spark, d), "repo")


# Each scan of a file against the scan of that file before it, over whole tables; a first scan has nothing before it.
_BEFORE = "(SELECT scan_id, lead(scan_id) OVER (PARTITION BY file_id ORDER BY scanned_at, scan_id) AS later FROM scan_results)"
_SIDES = f"(SELECT scan_id, repo, rule_id, file, 0 AS p, 1 AS c FROM findings UNION ALL SELECT later, repo, rule_id, file, 1, 0 FROM findings JOIN {_BEFORE} USING (scan_id) WHERE later IS NOT NULL)"
_RESCANNED = f"(SELECT scan_id, repo, rule_id, file, CASE WHEN max(p) = 0 THEN 'new' WHEN max(c) = 0 THEN 'remediated' ELSE 'unchanged' END AS status FROM {_SIDES} GROUP BY ALL)"


def _earlier(spark, d, found):
    """The findings of each scan that was followed by another of its file, under the id of the one that followed."""
    order = Window.partitionBy("file_id").orderBy("scanned_at", "scan_id")
    later = table(spark, d, "scan_results").select("scan_id", F.lead("scan_id").over(order).alias("later")).where("later is not null")
    return found.join(later, "scan_id").drop("scan_id").withColumnRenamed("later", "scan_id")


def _rescans(spark, d):
    found = table(spark, d, "findings").select("scan_id", "repo", "rule_id", "file")  # repeated rows fall together in the comparison
    return rp.scan_diff(_earlier(spark, d, found), found, ["scan_id", "repo", "rule_id", "file"])


@query(f"SELECT * FROM {_RESCANNED}")
def rescan_diff(spark, d):
    return _rescans(spark, d)


@query(
    f"SELECT repo, count(*) FILTER (status = 'remediated') AS remediated, count(*) FILTER (status <> 'new') AS previous, coalesce(round_even(count(*) FILTER (status = 'remediated') * 100 / nullif(count(*) FILTER (status <> 'new'), 0), 1), 0.0) AS rate FROM {_RESCANNED} GROUP BY repo"
)
def rescan_remediation_rate(spark, d):
    return rp.remediation_rate(_rescans(spark, d), "repo")


@query(f"WITH f AS (SELECT *, {_PRINT} AS fp FROM {F0}), b AS (SELECT later, fp FROM f JOIN {_BEFORE} USING (scan_id)) SELECT finding_id FROM f WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.later = f.scan_id AND b.fp = f.fp)")
def rescan_baseline_new(spark, d):
    found = fd.with_fingerprint(_findings(spark, d))
    baseline = _earlier(spark, d, found).select("scan_id", "fingerprint").distinct()
    return found.join(baseline, ["scan_id", "fingerprint"], "left_anti").select("finding_id")


@query(
    f"""SELECT repo, count(*) FILTER (({_case('threshold')}) >= 4 OR rule_id IN ('SEC-010')) AS violations, count(*) FILTER (rule_id IN ('SEC-010')) AS blocked, count(*) FILTER (({_case('threshold')}) >= 4 OR rule_id IN ('SEC-010')) = 0 AS passed
    FROM {F0} WHERE file IS NULL OR NOT contains(file, 'test') GROUP BY repo"""
)
def policy_gate(spark, d):
    return rp.policy_gate(_findings(spark, d), "repo", "high", ["SEC-010"], ["test"])


_REQUIREMENTS = [
    ("SOC2", "CC6.1", ["CWE-287", "CWE-862"]), ("SOC2", "CC6.6", ["CWE-918", "CWE-611"]), ("SOC2", "CC7.1", []),
    ("GDPR", "ART-32", ["CWE-327", "CWE-311"]), ("GDPR", "ART-25", ["CWE-200"]), ("HIPAA", "164.312", ["CWE-319", "CWE-79", "CWE-89"]),
]
_REQ_SQL = " UNION ALL ".join(f"SELECT '{f}' AS framework, '{r}' AS req_id, {c if c else '[]::VARCHAR[]'} AS cwes" for f, r, c in _REQUIREMENTS)


@query(
    f"""SELECT framework, count(*) AS requirements, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) * 100 / count(*), 1) AS score FROM (
    SELECT framework, (len(cwes) = 0 AND EXISTS (SELECT 1 FROM findings)) OR EXISTS (SELECT 1 FROM findings WHERE list_contains(cwes, cwe_id)) AS hit FROM ({_REQ_SQL})) GROUP BY framework"""
)
def compliance_report(spark, d):
    reqs = spark.createDataFrame(_REQUIREMENTS, "framework string, req_id string, cwe_ids array<string>")
    return rp.compliance(_findings(spark, d), reqs)


@query(
    f"SELECT repo, CASE WHEN count(*) FILTER (lower(severity) = 'critical') > 0 THEN 'failure' WHEN count(*) FILTER (lower(severity) = 'high') > 0 THEN 'action_required' ELSE 'neutral' END AS conclusion FROM {F0} GROUP BY repo"
)
def check_run(spark, d):
    return rp.check_run(_findings(spark, d), "repo")


@query(f"SELECT {_map(*sv.SARIF_LEVEL)} AS level, count(*) AS n FROM {F0} GROUP BY 1")
def sarif_levels(spark, d):
    return rp.levels(_findings(spark, d))


@query(f"SELECT cwe, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(cwe_id, '') || ' ' || coalesce(problem, ''), 'CWE-[0-9]+')) AS cwe FROM {F0}) GROUP BY cwe")
def cwe_counts(spark, d):
    text = F.concat_ws(" ", F.coalesce("cwe_id", F.lit("")), F.coalesce("problem", F.lit("")))
    return _findings(spark, d).select(F.explode(F.regexp_extract_all(text, F.lit("(CWE-[0-9]+)"), F.lit(1))).alias("cwe")).groupBy("cwe").agg(F.count("*").alias("n"))


@query("SELECT sha, count(*) AS n, min(file_id) AS first_id, count(DISTINCT repo) AS repos FROM github_files GROUP BY sha HAVING count(*) > 1")
def duplicate_files(spark, d):
    g = table(spark, d, "github_files")
    return g.groupBy("sha").agg(F.count("*").alias("n"), F.min("file_id").alias("first_id"), F.countDistinct("repo").alias("repos")).where("n > 1")


# --- joins ---------------------------------------------------------------------------------------


@query(
    f"SELECT s.repo AS repo, s.language AS language, count(*) AS findings, count(DISTINCT f.file_id) AS files FROM {F0} f JOIN scan_results s ON f.scan_id = s.scan_id GROUP BY 1, 2"
)
def findings_by_language(spark, d):
    f, s = _findings(spark, d).select("scan_id", "file_id"), table(spark, d, "scan_results").select("scan_id", "repo", "language")
    return f.join(s, "scan_id").groupBy("repo", "language").agg(F.count("*").alias("findings"), F.countDistinct("file_id").alias("files"))


@query(f"SELECT g.file_id FROM github_files g WHERE NOT EXISTS (SELECT 1 FROM findings f WHERE f.file_id = g.file_id)")
def files_without_findings(spark, d):
    return table(spark, d, "github_files").select("file_id").join(table(spark, d, "findings").select("file_id"), "file_id", "left_anti")


@query(
    f"SELECT coalesce(f.rule_id, p.rule_id) AS rule_id, coalesce(nf, 0) AS found, coalesce(np, 0) AS sent FROM (SELECT rule_id, count(*) AS nf FROM {F0} GROUP BY 1) f FULL JOIN (SELECT rule_id, count(DISTINCT payload_id) AS np FROM finding_payloads GROUP BY 1) p ON f.rule_id = p.rule_id"
)
def rules_found_and_sent(spark, d):
    f = _findings(spark, d).groupBy("rule_id").agg(F.count("*").alias("found"))
    p = table(spark, d, "finding_payloads").groupBy("rule_id").agg(F.countDistinct("payload_id").alias("sent"))
    return f.join(p, "rule_id", "full").select("rule_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("sent", F.lit(0)).alias("sent"))


def _vkey(c: str) -> str:
    part = lambda k: f"coalesce(try_cast(regexp_replace(string_split_regex(regexp_replace(trim({c}), '^[vV=]', ''), '[-._+]')[{k}], '\\D+', '', 'g') AS INTEGER), 0)"
    return f"[{part(1)}, {part(2)}, {part(3)}]"


_AFFECTED = "(SELECT DISTINCT cve_id, p.ecosystem AS eco, p.package AS package, p.version AS version, p.fixed_version AS fixed FROM (SELECT cve_id, unnest(affected_packages) AS p FROM cve_records))"


@query(
    f"""SELECT DISTINCT a.ecosystem AS ecosystem, a.package AS name, a.patched_version AS version, v.cve_id AS vuln_id, v.fixed AS fixed FROM advisory_records a JOIN {_AFFECTED} v ON lower(a.ecosystem) = lower(v.eco) AND lower(a.package) = lower(v.package)
    WHERE a.patched_version IS NOT NULL AND (nullif(v.version, '*') IS NULL OR {_vkey("v.version")} <= {_vkey("a.patched_version")}) AND (v.fixed IS NULL OR {_vkey("a.patched_version")} < {_vkey("v.fixed")})"""
)
def vulnerable_versions(spark, d):
    packages = table(spark, d, "advisory_records").select("ecosystem", F.col("package").alias("name"), F.col("patched_version").alias("version"))
    v = table(spark, d, "cve_records").select(F.col("cve_id").alias("vuln_id"), "severity", F.inline("affected_packages"))
    v = v.select("vuln_id", "ecosystem", "package", F.nullif("version", F.lit("*")).alias("introduced"), F.col("fixed_version").alias("fixed"), F.lit("").alias("severity"))
    return dp.vulnerable(packages, v).select("ecosystem", "name", "version", "vuln_id", "fixed").distinct()


@query(
    f"SELECT DISTINCT a.package AS a, v.package AS b FROM (SELECT DISTINCT package FROM advisory_records WHERE package IS NOT NULL) a, (SELECT DISTINCT package FROM {_AFFECTED} WHERE package IS NOT NULL) v WHERE (contains(a.package, v.package) AND length(v.package) >= 4) OR (contains(v.package, a.package) AND length(a.package) >= 4) OR a.package = v.package"
)
def package_names_contained(spark, d):
    v = table(spark, d, "cve_records").select(F.inline("affected_packages")).select("package")
    return dp.names_contained(table(spark, d, "advisory_records"), v, "package", "package")


@query(
    f"""SELECT a.file_id AS file, a.finding_id AS a, b.finding_id AS b FROM {F0} a JOIN {F0} b ON a.file_id = b.file_id AND a.finding_id < b.finding_id AND a.start_byte < b.end_byte AND b.start_byte < a.end_byte
    WHERE a.start_byte < a.end_byte AND b.start_byte < b.end_byte"""
)
def overlapping_findings(spark, d):
    fixes = _findings(spark, d).select("file_id", F.col("finding_id").alias("fix_id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    return fx.conflicts(fixes)


@query()
def greedy_fixes(spark, d):
    """The fixes of auto-fixable findings that can be applied together, by file."""
    fixes = _findings(spark, d).where("auto_fix and start_byte < end_byte").select(
        "file_id", F.col("finding_id").alias("fix_id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.lit("/* fixed */").alias("replacement")
    )
    return fx.chosen(fixes).select("file", F.size("fixes").alias("n_kept"), F.transform("fixes", lambda x: x["fix_id"]).alias("kept"))


@query()
def fixed_files(spark, d):
    """Files with the chosen fixes applied from the last to the first."""
    fixes = _findings(spark, d).where("auto_fix and start_byte < end_byte").select(
        "file_id", F.col("finding_id").alias("fix_id"), F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.lit("").alias("replacement")
    )
    files = table(spark, d, "github_files").select("file_id", "code")
    return fx.applied(files, fx.chosen(fixes)).where("fixed_code <> code").select("file_id", F.length("code").alias("before"), F.length("fixed_code").alias("after"))


# --- metrics and structure -------------------------------------------------------------------------

_LS = f"SELECT file_id, coalesce({_EXT}, '') AS lang, code, CASE WHEN code = '' THEN [] ELSE string_split_regex(regexp_replace(code, '\\r?\\n\\z', ''), '\\r?\\n') END AS ls FROM github_files WHERE code IS NOT NULL"


def _by_lang(patterns: dict[str, str]) -> str:
    q = lambda p: p.replace("'", "''")
    return "CASE lang " + " ".join(f"WHEN '{n}' THEN regexp_matches(t, '{q(p)}')" for n, p in patterns.items() if n) + f" ELSE regexp_matches(t, '{q(patterns[''])}') END"


_STR, _EMPTY = cd.STRING.replace("'", "''"), cd.EMPTY_FUNCTION.replace("'", "''")
# The balance that never falls below 0 is the running sum less its least value so far, 0 included.
_METRICS = f"""WITH f AS ({_LS}), u AS (SELECT file_id, lang, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM f), t AS (SELECT *, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS t FROM u),
 w AS (SELECT *, sum(len(regexp_replace(l, '[^{{(]', '', 'g')) - len(regexp_replace(l, '[^}})]', '', 'g'))) OVER (PARTITION BY file_id ORDER BY n) AS s FROM t),
 x AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY file_id ORDER BY n)) AS depth FROM w),
 a AS (SELECT file_id, count(*) AS n_lines, count(*) FILTER ({_by_lang(cd.FUNCTION_LINES)}) AS function_count, count(*) FILTER ({_by_lang(cd.CLASS_LINES)}) AS class_count,
  CAST(greatest(max(depth), 0) AS BIGINT) AS max_nesting_depth, CAST(sum(len(regexp_extract_all(l, '{_STR}'))) AS BIGINT) AS string_count, count(*) FILTER (regexp_matches(l, '{cd.IMPORT}')) AS import_count,
  count(*) FILTER (regexp_matches(t, '^(#|//)')) AS comments, sum(strlen(l)) AS bytes, max(strlen(l)) AS max_line_len, count(*) FILTER (regexp_matches(l, '{cd.TODO}')) AS todo_count, count(*) FILTER (regexp_matches(l, '{cd.DEBUG}')) AS debug_stmts,
  count(*) FILTER (t <> '') AS filled, count(*) FILTER (t <> '' AND strlen(regexp_extract(l, '^\\s*', 0)) % 4 = 0) AS even FROM x GROUP BY file_id)
 SELECT f.file_id AS file_id, coalesce(n_lines, 0) AS n_lines, coalesce(function_count, 0) AS function_count, coalesce(class_count, 0) AS class_count,
  CASE WHEN function_count > 0 THEN n_lines / function_count ELSE coalesce(n_lines, 0) END AS avg_function_len, coalesce(max_nesting_depth, 0) AS max_nesting_depth, coalesce(string_count, 0) AS string_count, coalesce(import_count, 0) AS import_count,
  coalesce(comments / n_lines, 0) AS comment_density, coalesce(bytes / n_lines, 0) AS avg_line_len, coalesce(max_line_len, 0) AS max_line_len, coalesce(todo_count, 0) AS todo_count, coalesce(debug_stmts, 0) AS debug_stmts,
  coalesce((even + filled) * 0.5 / nullif(filled, 0), 1.0) AS indentation_score, coalesce(n_lines - filled, 0) AS blank_lines, CAST(len(regexp_extract_all(code, '{_EMPTY}')) AS BIGINT) AS empty_functions
 FROM f LEFT JOIN a ON f.file_id = a.file_id"""
_ANOMALIES = f"""WITH m AS ({_METRICS}) SELECT file_id, metric, severity, round(confidence, 6) AS confidence FROM (
 SELECT file_id, 'line_count' AS metric, 'medium' AS severity, least((n_lines - 500) / 500, 0.9) AS confidence FROM m WHERE n_lines > 500
 UNION ALL SELECT file_id, 'avg_function_len', 'medium', least((avg_function_len - 50) / 50, 0.85) FROM m WHERE avg_function_len > 50
 UNION ALL SELECT file_id, 'max_nesting_depth', 'high', least((max_nesting_depth - 5) / 5, 0.95) FROM m WHERE max_nesting_depth > 5
 UNION ALL SELECT file_id, 'max_line_len', 'low', least((max_line_len - 200) / 200, 0.7) FROM m WHERE max_line_len > 200
 UNION ALL SELECT file_id, 'indentation_score', 'low', 1 - indentation_score FROM m WHERE indentation_score < 0.5 AND n_lines > 20
 UNION ALL SELECT file_id, 'todo_density', 'info', least(todo_count / n_lines * 5, 0.8) FROM m WHERE todo_count / nullif(n_lines, 0) > 0.05 AND todo_count > 3
 UNION ALL SELECT file_id, 'debug_density', 'low', least(debug_stmts / n_lines * 10, 0.85) FROM m WHERE debug_stmts / nullif(n_lines, 0) > 0.03 AND debug_stmts > 5
 UNION ALL SELECT file_id, 'function_density', 'low', 0.65 FROM m WHERE n_lines > 50 AND function_count / n_lines > 0.15
 UNION ALL SELECT file_id, 'empty_function_ratio', 'low', empty_functions / function_count FROM m WHERE function_count > 5 AND empty_functions / function_count > 0.3)"""


def _metrics(spark, d):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return cd.metrics(files, "file_id", "code", "language")


@query(_METRICS)
def file_metrics(spark, d):
    m = _metrics(spark, d)
    return m.select([F.col(f.name).cast("bigint") if f.dataType.typeName() == "integer" else f.name for f in m.schema])


@query(_ANOMALIES)
def anomaly_findings(spark, d):
    return cd.anomalies(_metrics(spark, d))


_WEIGHT = "CASE severity WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.4 ELSE 0.2 END"


@query(f"SELECT file_id, least(1.0, round(avg({_WEIGHT} * confidence), 6)) AS score FROM ({_ANOMALIES}) GROUP BY file_id")
def anomaly_scores(spark, d):
    return cd.anomaly_score(cd.anomalies(_metrics(spark, d)))


_MARKS = " UNION ALL ".join(
    f"SELECT file_id, {k} AS k, '{n}' AS name, '{sev}' AS severity, {c} AS confidence, code, regexp_extract_all(code, '{p}') AS m, string_split_regex(code, '{p}') AS s FROM github_files"
    for k, (n, sev, c, p) in enumerate((n, sev, c, p.replace("'", "''")) for n, sev, c, p in cd.MACHINE_MARKS)
)


@query(
    f"""WITH u AS (SELECT file_id, k, name, severity, confidence, m, s, unnest(range(1, len(m) + 1)) AS i FROM ({_MARKS}) WHERE len(m) > 0),
    loc AS (SELECT file_id, k, name, severity, confidence, len(string_split(array_to_string(s[1:i], '') || array_to_string(m[1:i - 1], ''), chr(10))) AS line FROM u)
    SELECT file_id, line, 'pattern_match' AS metric, arg_min(name, k) AS name, arg_min(severity, k) AS severity, arg_min(confidence, k) AS confidence FROM loc GROUP BY file_id, line"""
)
def machine_marks(spark, d):
    return cd.machine_marks(table(spark, d, "github_files"), "file_id", "code").withColumn("line", F.col("line").cast("bigint"))


def _facts(spark, d):
    return cd.python_facts(table(spark, d, "github_files").where("ext = 'py'"), "file_id", "code")


@query()
def python_fact_counts(spark, d):
    return _facts(spark, d).groupBy("file_id", "kind").agg(F.count("*").alias("n"))


@query()
def unused_imports(spark, d):
    return cd.unused_imports(_facts(spark, d))


@query()
def unused_functions(spark, d):
    return cd.unused_functions(_facts(spark, d))


@query()
def duplicate_functions(spark, d):
    return cd.duplicate_functions(_facts(spark, d))


@query()
def repeated_calls(spark, d):
    return cd.repeated_calls(_facts(spark, d))


@query()
def mixed_naming(spark, d):
    return cd.mixed_naming(_facts(spark, d))


@query()
def calls_with_function(spark, d):
    return cd.enclosing_function(_facts(spark, d))


@query()
def tainted_sinks(spark, d):
    return cd.tainted_sinks(_facts(spark, d))


_FN = " ".join(f"WHEN '{lang}' THEN regexp_extract(l, '{p[0]}', 1)" for lang, p in lf.PATTERNS.items())


@query(f"WITH ls AS ({_lines_sql('github_files', 'file_id', 'code', _EXT)}) SELECT file_id, name, CAST(n AS BIGINT) AS line FROM (SELECT *, CASE lang {_FN} END AS name FROM ls) WHERE name <> ''")
def line_functions(spark, d):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return lf.line_facts(files, "file_id", "code", "language").where("kind = 'function'").select("file_id", "name", "line")


@query(f"WITH ls AS ({_lines_sql('github_files', 'file_id', 'code', _EXT)}) SELECT file_id, count(*) AS n FROM ls WHERE lang IN ({', '.join(repr(x) for x in lf.PATTERNS)}) AND regexp_matches(l, '\\b(TODO|FIXME|HACK|XXX)\\b') GROUP BY file_id")
def line_todos(spark, d):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return lf.line_facts(files, "file_id", "code", "language").where("kind = 'todo'").groupBy("file_id").agg(F.count("*").alias("n"))


@query()
def line_fact_counts(spark, d):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return lf.line_facts(files, "file_id", "code", "language").groupBy("file_id", "kind").agg(F.count("*").alias("n"))


def _clean(spark, d, package):
    files = table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))
    return cl.cleaned(files, package=package).where("fixed_code <> code")


@query(
    f"""SELECT file_id, md5(fixed) AS fixed_md5 FROM (SELECT file_id, code, regexp_replace(CASE WHEN {_EXT} = 'python' THEN regexp_replace(regexp_replace(code, '\\s==\\s*None\\b', ' is None', 'g'), '\\s!=\\s*None\\b', ' is not None', 'g') ELSE code END, '(?m)[ \\t]+$', '', 'g') AS fixed FROM github_files) WHERE fixed <> code"""
)
def clean_safe(spark, d):
    return _clean(spark, d, "safe").select("file_id", F.md5("fixed_code").alias("fixed_md5"))


@query()
def clean_destructive(spark, d):
    return _clean(spark, d, "destructive").select("file_id", "applied", F.length("code").alias("before"), F.length("fixed_code").alias("after"))


# --- exports -----------------------------------------------------------------------------------------


@query(
    f"SELECT 'issue' AS type, rule_id AS check_name, problem AS description, {_map({k: v[0] for k, v in sv.CODECLIMATE[0].items()}, sv.CODECLIMATE[1][0])} AS severity, CAST({_map({k: v[1] for k, v in sv.CODECLIMATE[0].items()}, sv.CODECLIMATE[1][1])} AS BIGINT) AS remediation_points, file AS path, line AS begin_line, {_PRINT} AS fingerprint FROM {F0}"
)
def export_codeclimate(spark, d):
    return export.codeclimate(_findings(spark, d))


@query(
    f"SELECT 'siftlake' AS engine_id, rule_id, {_map({k: v[0] for k, v in sv.SONAR[0].items()}, sv.SONAR[1][0])} AS severity, 'VULNERABILITY' AS type, CAST({_map({k: v[1] for k, v in sv.SONAR[0].items()}, sv.SONAR[1][1])} AS BIGINT) AS effort_minutes, problem AS message, file AS file_path, line AS start_line FROM {F0}"
)
def export_sonar(spark, d):
    return export.sonar(_findings(spark, d))


@query()
def export_json(spark, d):
    return export.json_lines(_findings(spark, d))


@query()
def export_sarif(spark, d):
    return export.sarif(_findings(spark, d))


@query()
def export_gitlab(spark, d):
    return export.gitlab_sast(_findings(spark, d))


@query()
def export_junit(spark, d):
    return export.junit(_findings(spark, d))


@query()
def export_html(spark, d):
    return export.html(_findings(spark, d))


@query()
def export_markdown(spark, d):
    return export.markdown(_findings(spark, d))


@query()
def export_text(spark, d):
    return export.text_report(_findings(spark, d))


# --- events ------------------------------------------------------------------------------------------

_US = "epoch_us(CAST(ts AS TIMESTAMP))"


@query(
    f"SELECT event_id, recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY {_US} RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 2"
)
def event_rate_limit(spark, d):
    return ev.over_limit(table(spark, d, "events"), "user_id", limit=2, seconds=600).select("event_id", "recent")


@query(
    f"""SELECT user_id, session, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM (SELECT user_id, us, sum(b) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS session FROM (
    SELECT user_id, {_US} AS us, coalesce(CASE WHEN {_US} - lag({_US}) OVER (PARTITION BY user_id ORDER BY {_US}) >= 3600000000 THEN 1 ELSE 0 END, 0) AS b FROM events)) GROUP BY user_id, session"""
)
def event_sessions(spark, d):
    return ev.sessions(table(spark, d, "events"), "user_id", 3600)


def _stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """The stream without repeated event ids, run until all that is there is done."""
    import uuid

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ev.run_available(ev.deduplicated(_stream(spark, d), ["event_id"], late="60 days").select("event_id", "user_id", "event_type"), folder, "dedup")
    return spark.read.parquet(f"{folder}/dedup")


@query(f"SELECT event_type, {_US} // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_hourly_counts(spark, d):
    """Counts by hour of event time, kept up to date by a stream; the last state is the result."""
    import uuid

    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    ev.run_available(ev.counts(_stream(spark, d), "event_type", late="60 days"), folder, "counts", mode="complete")
    return spark.read.parquet(f"{folder}/counts").select("event_type", F.floor(F.unix_micros("window.start") / 3_600_000_000).alias("hour"), "n")


# --- generic relational checks -------------------------------------------------------------------------


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name"""
)
def local_supplier_volume(spark, d):
    t = lambda n: table(spark, d, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    j = li.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    j = j.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("c_nationkey")), ["l_suppkey", "c_nationkey"])
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return j.join(n, "c_nationkey").groupBy("n_name").agg(F.round(F.sum("v"), 2).alias("revenue"))
