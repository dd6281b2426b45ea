"""Further queries of the analysis engine: orderings, lookups, differences, licences, bills of materials, taint rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import severity as sv
from siftlake.functions import text as tx
from siftlake.operators import clean as cl
from siftlake.operators import code as cd
from siftlake.operators import dependencies as dp
from siftlake.operators import diffs as df_
from siftlake.operators import findings as fd
from siftlake.operators import packs
from siftlake.operators.scan import scan
from siftlake.operators.taint_rules import taint_findings
from siftlake.plans.reference_queries import _EXT, _REQ_SQL, _REQUIREMENTS, F0, _case, _findings
from siftlake.session import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _files(spark, d) -> DataFrame:
    return table(spark, d, "github_files").withColumn("language", tx.lookup(F.lower("ext"), tx.EXTENSIONS))


# --- orderings ---------------------------------------------------------------------------------------


@query(f"SELECT finding_id, file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_byte NULLS FIRST, finding_id) AS position FROM {F0}")
def findings_by_offset(spark, d):
    """The findings of each file in the order of their bytes."""
    w = Window.partitionBy("file_id").orderBy(F.asc_nulls_first("start_byte"), "finding_id")
    return _findings(spark, d).select("finding_id", "file_id", F.row_number().over(w).cast("bigint").alias("position"))


@query(f"SELECT finding_id, repo, row_number() OVER (PARTITION BY repo ORDER BY {_case('ai_sort')} DESC, line NULLS FIRST, finding_id) AS position FROM {F0}")
def findings_by_severity(spark, d):
    """The findings of each repository, the most severe first, then by line."""
    w = Window.partitionBy("repo").orderBy(sv.rank("severity", "ai_sort").desc(), F.asc_nulls_first("line"), "finding_id")
    return _findings(spark, d).select("finding_id", "repo", F.row_number().over(w).cast("bigint").alias("position"))


@query(f"SELECT file, line, min(finding_id) AS finding_id, arg_min(rule_id, finding_id) AS rule_id FROM {F0} GROUP BY file, line")
def first_of_each_line(spark, d):
    """Of several findings on a line, the first."""
    return _findings(spark, d).groupBy("file", "line").agg(F.min("finding_id").alias("finding_id"), F.min_by("rule_id", "finding_id").alias("rule_id"))


@query(
    f"SELECT lower(p.ecosystem) AS ecosystem, lower(p.package) AS package, arg_max(cve_id, {_case('threshold')} * 1000000 - rec_id) AS cve_id, count(DISTINCT cve_id) AS cves FROM (SELECT rec_id, cve_id, severity, unnest(affected_packages) AS p FROM cve_records) WHERE p.package IS NOT NULL GROUP BY 1, 2"
)
def most_severe_cve(spark, d):
    """Per package, its most severe CVE; ties go to the earliest record."""
    v = table(spark, d, "cve_records").select("rec_id", "cve_id", "severity", F.inline("affected_packages")).where("package is not null")
    order = F.struct(sv.rank("severity", "threshold"), -F.col("rec_id"))
    return v.groupBy(F.lower("ecosystem").alias("ecosystem"), F.lower("package").alias("package")).agg(F.max_by("cve_id", order).alias("cve_id"), F.countDistinct("cve_id").alias("cves"))


# --- lookups and sets ----------------------------------------------------------------------------------

_RISK = "CASE " + " ".join(f"WHEN n IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in packs.RISKS.items()) + " END"


@query(f"SELECT risk, count(*) AS n FROM (SELECT {_RISK} AS risk FROM (SELECT try_cast(regexp_extract(cwe_id, '^CWE-([0-9]+)$', 1) AS INTEGER) AS n FROM {F0} WHERE cwe_id IS NOT NULL)) GROUP BY risk")
def findings_by_risk(spark, d):
    """Findings by the risk category of their weakness; as many rows in the lookup as there are weaknesses in it."""
    pairs = [(f"CWE-{n}", k) for k, v in packs.RISKS.items() for n in v]
    first = dict(reversed(pairs))
    risks = spark.createDataFrame(sorted(first.items()), "cwe_id string, risk string")
    return _findings(spark, d).where("cwe_id is not null").join(F.broadcast(risks), "cwe_id", "left").groupBy("risk").agg(F.count("*").alias("n"))


@query(f"SELECT framework, req_id FROM ({_REQ_SQL}) WHERE NOT ((len(cwes) = 0 AND EXISTS (SELECT 1 FROM findings)) OR EXISTS (SELECT 1 FROM findings WHERE list_contains(cwes, cwe_id)))")
def compliance_gaps(spark, d):
    """Requirements that no finding speaks to."""
    reqs = spark.createDataFrame(_REQUIREMENTS, "framework string, req_id string, cwe_ids array<string>")
    seen = _findings(spark, d).select("cwe_id").where("cwe_id is not null").distinct()
    named = reqs.where(F.size("cwe_ids") > 0).select("framework", "req_id", F.explode("cwe_ids").alias("cwe_id"))
    met = named.join(seen, "cwe_id", "left_semi").select("framework", "req_id").distinct()
    return named.select("framework", "req_id").distinct().join(met, ["framework", "req_id"], "left_anti")


@query(f"SELECT finding_id AS id, 'finding' AS origin, rule_id, severity, file, NULL AS marker_id FROM {F0} UNION ALL SELECT payload_id, 'marker', rule_id, severity, file, marker_id FROM (SELECT DISTINCT * FROM finding_payloads)")
def findings_and_markers(spark, d):
    f = _findings(spark, d).select(F.col("finding_id").alias("id"), F.lit("finding").alias("origin"), "rule_id", "severity", "file")
    m = table(spark, d, "finding_payloads").distinct().select(F.col("payload_id").alias("id"), F.lit("marker").alias("origin"), "rule_id", "severity", "file", "marker_id")
    return f.unionByName(m, allowMissingColumns=True)


@query("SELECT repo, folder, count(*) AS files, count(*) FILTER (scanned) AS scanned, count(*) FILTER (NOT scanned) AS failed FROM (SELECT repo, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS folder, EXISTS (SELECT 1 FROM scan_results s WHERE s.file_id = g.file_id) AS scanned FROM github_files g) GROUP BY repo, folder")
def directory_stats(spark, d):
    """Files of each top folder, with and without a scan."""
    done = table(spark, d, "scan_results").select("file_id").distinct().withColumn("scanned", F.lit(True))
    folder = F.when(F.contains("path", F.lit("/")), F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    g = table(spark, d, "github_files").select("file_id", "repo", folder.alias("folder")).join(done, "file_id", "left").withColumn("scanned", F.coalesce("scanned", F.lit(False)))
    return g.groupBy("repo", "folder").agg(F.count("*").alias("files"), F.count_if("scanned").alias("scanned"), F.count_if(~F.col("scanned")).alias("failed"))


_PACKS = " UNION ALL ".join(f"SELECT '{p}' AS pack, '{s}' AS severity" for p, s in ((r.pack, r.severity) for r in packs.RULES))


@query(f"SELECT pack, severity, count(*) AS rules FROM ({_PACKS}) GROUP BY pack, severity")
def rule_stats(spark, d):
    return packs.listing(spark).groupBy("pack", "severity").agg(F.count("*").alias("rules"))


@query()
def rule_listing(spark, d):
    """Every rule with what it looks for, its weakness and risk."""
    return packs.listing(spark)


# --- scalar functions ------------------------------------------------------------------------------------


@query(f"SELECT finding_id, CASE WHEN length(snippet) > 80 THEN substr(snippet, 1, 80) || '...' ELSE snippet END AS shown FROM {F0}")
def snippets_shortened(spark, d):
    return _findings(spark, d).select("finding_id", df_.shortened(F.col("snippet")).alias("shown"))


@query("SELECT file_id, md5(concat_ws(':', concat_ws('/', repo, path), CAST(epoch_us(CAST(fetched_at AS TIMESTAMP)) AS VARCHAR), CAST(size AS VARCHAR))) AS state FROM github_files")
def file_states(spark, d):
    g = table(spark, d, "github_files")
    return g.select("file_id", tx.state_hash(F.concat_ws("/", "repo", "path"), F.unix_micros(F.col("fetched_at").cast("timestamp")), F.col("size")).alias("state"))


@query("SELECT band, count(*) AS n FROM (SELECT CASE WHEN s >= 9 THEN 'critical' WHEN s >= 7 THEN 'high' WHEN s >= 4 THEN 'medium' WHEN s >= 0.1 THEN 'low' ELSE 'info' END AS band FROM (SELECT CASE WHEN isnan(cvss_score) THEN NULL ELSE CAST(cvss_score AS DOUBLE) END AS s FROM cve_records)) GROUP BY band")
def cvss_bands(spark, d):
    s = F.when(~F.isnan("cvss_score"), F.col("cvss_score").cast("double"))
    return table(spark, d, "cve_records").groupBy(tx.cvss_severity(s).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT rec_id, nullif(regexp_extract(upper(cvss_vector), '(?:^|/)AV:([A-Z])(?:/|$)', 1), '') AS access, nullif(regexp_extract(upper(cvss_vector), '(?:^|/)PR:([A-Z])(?:/|$)', 1), '') AS rights FROM cve_records")
def cvss_vector_parts(spark, d):
    parts = df_.vector_parts(F.col("cvss_vector"))
    return table(spark, d, "cve_records").select("rec_id", parts["AV"].alias("access"), parts["PR"].alias("rights"))


@query("SELECT file_id, replace(replace(replace(url_encode(path), '+', '%20'), '*', '%2A'), '%7E', '~') AS encoded FROM github_files")
def paths_encoded(spark, d):
    return table(spark, d, "github_files").select("file_id", df_.percent_encoded(F.col("path")).alias("encoded"))


@query(f"SELECT strftime(CAST(found_at AS TIMESTAMP), '%Y-%m-%d') AS day, count(*) AS n FROM {F0} GROUP BY 1")
def findings_by_day(spark, d):
    return _findings(spark, d).groupBy(F.date_format(F.col("found_at").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT finding_id, round(-sum(c / n * log2(c / n)), 6) AS bits FROM (SELECT finding_id, ch, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY finding_id) AS n FROM (SELECT finding_id, unnest(string_split(snippet, '')) AS ch FROM (SELECT DISTINCT finding_id, snippet FROM findings WHERE snippet <> '')) GROUP BY finding_id, ch) GROUP BY finding_id")
def snippet_entropy(spark, d):
    return _findings(spark, d).select("finding_id", "snippet").distinct().where("snippet <> ''").select("finding_id", F.round(df_.entropy(F.col("snippet")), 6).alias("bits"))


@query(f"SELECT finding_id, CASE WHEN {_EXT.replace('ext', 'e', 1)} IN ('javascript', 'typescript', 'go', 'java', 'rust', 'csharp', 'php') THEN '// ' ELSE '# ' END || regexp_replace(problem, '\\s*\\n\\s*', ' ', 'g') AS comment FROM (SELECT *, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM {F0}) WHERE problem IS NOT NULL")
def problems_as_comments(spark, d):
    return _findings(spark, d).where("problem is not null").select("finding_id", df_.as_comment(F.col("problem"), tx.language_of(F.col("file"))).alias("comment"))


# --- code ------------------------------------------------------------------------------------------------

_QUOTES = "len(regexp_extract_all(l, '\"\"\"|''''''')) % 2"


@query(
    f"""SELECT file_id, count(*) AS n FROM (SELECT file_id, l, sum({_QUOTES}) OVER (PARTITION BY file_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
    SELECT file_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS n FROM (SELECT file_id, string_split_regex(regexp_replace(code, '\\r?\\n\\z', ''), '\\r?\\n') AS ls FROM github_files WHERE ext = 'py' AND code IS NOT NULL))) WHERE coalesce(before, 0) % 2 = 1 OR {_QUOTES} = 1 GROUP BY file_id"""
)
def docstring_lines(spark, d):
    """Lines of Python files within strings of triple quotes, by a toggle; such lines and comments are no code."""
    odd = lambda x: F.regexp_count(x, F.lit("\"\"\"|'''")) % 2
    ls = tx.lines(F.col("code"))
    folded = F.aggregate(ls, F.struct(F.lit(0).alias("open"), F.lit(0).alias("n")), lambda acc, x: F.struct(((acc["open"] + odd(x)) % 2).alias("open"), (acc["n"] + F.when((acc["open"] == 1) | (odd(x) == 1), 1).otherwise(0)).alias("n")))
    rows = table(spark, d, "github_files").where("ext = 'py' and code is not null").select("file_id", folded["n"].cast("bigint").alias("n"))
    return rows.where("n > 0")


@query()
def scan_findings(spark, d):
    """Hits of all rules as findings, with bytes, columns, snippets, weaknesses and risks."""
    return scan(_files(spark, d), packs.rules_of("all"), "file_id", "code", "language")


@query()
def clean_diffs(spark, d):
    """What cleaning would change, as unified diffs and line ranges."""
    cleaned = cl.cleaned(_files(spark, d), package="safe").where("fixed_code <> code")
    return df_.diffs(cleaned, "file_id", "code", "fixed_code")


@query()
def taint_rule_findings(spark, d):
    """Flows from sources into the sinks of the taint rules, in Python files."""
    return taint_findings(cd.python_facts(table(spark, d, "github_files").where("ext = 'py'"), "file_id", "code"))


@query("SELECT file_id, nullif(regexp_extract(code, 'SPDX-License-Identifier:\\s*([A-Za-z0-9.+-]+)', 1), '') AS tag FROM github_files WHERE regexp_matches(code, 'SPDX-License-Identifier:\\s*[A-Za-z0-9.+-]+')")
def license_tags(spark, d):
    g = table(spark, d, "github_files").withColumn("tag", dp.detected_license(F.col("code")))
    return g.where(F.col("code").rlike(r"SPDX-License-Identifier:\s*[A-Za-z0-9.+-]+")).select("file_id", "tag")


@query("SELECT CAST(json_array_length(to_json(list(DISTINCT ecosystem || '/' || package || '@' || patched_version))) AS BIGINT) AS components, lower(ecosystem) AS path FROM advisory_records WHERE ecosystem IS NOT NULL AND package IS NOT NULL AND patched_version IS NOT NULL GROUP BY lower(ecosystem)")
def sbom_components(spark, d):
    """A bill of materials for each ecosystem of the advisories' packages, by its number of components."""
    p = table(spark, d, "advisory_records").where("package is not null and patched_version is not null and ecosystem is not null")
    p = p.select(F.lower("ecosystem").alias("path"), "ecosystem", F.col("package").alias("name"), F.col("patched_version").alias("version")).distinct()
    return dp.sbom_cyclonedx(p).select("path", F.size(F.from_json("sbom", "components array<struct<purl:string>>")["components"]).cast("bigint").alias("components"))


@query("SELECT max(file_id) AS file_id FROM github_files WHERE path IS NOT NULL GROUP BY repo, path, md5(code) HAVING count(*) = 1")
def unseen_states(spark, d):
    """Files whose state no other fetch has: the states that stand once, against those that stand again."""
    g = table(spark, d, "github_files").where("path is not null").select("file_id", F.concat_ws("/", "repo", "path").alias("path"), F.md5("code").alias("state"))
    again = g.groupBy("path", "state").agg(F.count("*").alias("n")).where("n > 1").select("path", "state")
    return fd.unchanged_skipped(g, again).select("file_id")
