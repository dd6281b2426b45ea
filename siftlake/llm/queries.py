"""The training-data problems over the project's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import credentials, handwritten, leakage, linkage, mixing, spans, survivors, syntax
from siftlake.llm.languages import file_languages
from siftlake.session import checkpoint, table


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Each advisory with the CVE it most likely describes, and the confidence of the match."""
    feeds = table(spark, d, "feeds").select("feed", "tz_name", "day_first")
    return linkage.link(table(spark, d, "advisory_records"), table(spark, d, "cve_records"), feeds, "опубликовано_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_links(spark, d).select("ghsa_id", "cve_id")


def _credentials(spark: SparkSession, d: str) -> DataFrame:
    files = credentials.scan(table(spark, d, "github_files"), "file_id", "code", F.col("path"), "github_files")
    found = credentials.scan(table(spark, d, "findings"), "finding_id", "snippet", F.col("file"), "findings", snippet=True)
    sent = credentials.scan(table(spark, d, "finding_payloads"), "payload_id", "snippet", F.col("file"), "finding_payloads", snippet=True)
    return files.unionByName(found).unionByName(sent)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _credentials(spark, d).select("tab", "row_id", F.explode("lines").alias("line_no")).distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that held credentials, with the contents masked and all else as it was."""
    return _credentials(spark, d).select("tab", "row_id", F.size("lines").alias("n_credentials"), "redacted").distinct()


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The best representative of every finding, single ones included, by trust learnt from the scanners' agreement."""
    groups = checkpoint(survivors.duplicate_groups(table(spark, d, "raw_findings")))
    return survivors.best_representative(groups, survivors.source_trust(groups))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_survivors(spark, d).where("n_records > 1").drop("n_records")


def p4_trust(spark: SparkSession, d: str) -> DataFrame:
    """How far each scanner can be trusted, by its agreement with the others."""
    return survivors.source_trust(survivors.duplicate_groups(table(spark, d, "raw_findings"))).select("scanner", F.round("trust", 6).alias("trust"))


def _not_handwritten(spark: SparkSession, d: str) -> DataFrame:
    kinds = handwritten.classify(table(spark, d, "github_files"))
    listed = file_languages(table(spark, d, "scan_results"))
    return kinds.join(listed, "file_id").where(~F.col("language").isin("json", "text"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _not_handwritten(spark, d).select("file_id").distinct()


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Why each file is not hand-written."""
    return _not_handwritten(spark, d).select("file_id", "language", "kind").distinct()


def _repairs(spark: SparkSession, d: str, most: int | None = None) -> DataFrame:
    return syntax.repairs(table(spark, d, "github_files"), file_languages(table(spark, d, "scan_results")), most=most)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _repairs(spark, d, most=3).where("cost > 0").select("file_id").distinct()


def p7_repairs(spark: SparkSession, d: str) -> DataFrame:
    """The files that do not parse, with the cost of their repair and what happened to them."""
    return _repairs(spark, d).where("cost > 0").distinct()


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(_repairs(spark, d, most=3), table(spark, d, "github_files"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Where the longest leaked passage of each document and item stands, and how long it is."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("source", mixing.source_key(F.col("source")))
    sized = checkpoint(mixing.count_tokens(docs, "doc_id", "text", ["source"]))
    plan = mixing.mixing_plan(sized, table(spark, d, "mix_targets"))
    return mixing.balanced_mix(sized, plan), plan


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(*_mix(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pairs, classes = spans.shared_spans(docs, min_chars=400)
    return spans.pairs_of_documents(pairs, classes, docs, "doc_id", "text", 400)


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages that pairs of different texts share, each text by the class id of its copies."""
    pairs, _ = spans.shared_spans(table(spark, d, "documents"), min_chars=400)
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.inline("spans"))


def p10_shared_part(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands verbatim elsewhere."""
    docs = table(spark, d, "documents")
    pairs, classes = spans.shared_spans(docs, min_chars=400)
    return spans.shared_part(checkpoint(pairs), classes, docs, "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_links": p1_links, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_survivors": p4_survivors, "p4_trust": p4_trust, "p6_found": p6_found, "p6_kinds": p6_kinds,
    "p7_found": p7_found, "p7_repairs": p7_repairs, "p7_rates": p7_rates, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_selection": p9_selection, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_passages": p10_passages, "p10_shared_part": p10_shared_part,
}
_GRAMS = (
    "SELECT DISTINCT {key}, array_to_string(ws[i:i+14], ' ') AS k FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 13)) AS i FROM "
    "(SELECT {key}, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS ws FROM {table}))"
)
ORACLE_SQL: dict[str, str] = {
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM ({_GRAMS.format(key='doc_id', table='documents')}) JOIN ({_GRAMS.format(key='item_id', table='eval_items')}) USING (k)",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, i, 400)) AS k FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents))
        SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id""",
}
