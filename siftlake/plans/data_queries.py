"""The general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators.snapshots import snapshot_changes, snapshot_order
from siftlake.operators.timestamps import with_utc_micros
from siftlake.session import table

#: Where the project's tables hold times as text: table, id column, fields.
TIME_FIELDS = [
    ("cve_records", "rec_id", ["published_date", "last_modified_date"]),
    ("advisory_records", "rec_id", ["опубликовано_at"]),
    ("baseline_reports", "delivery_id", ["generated_at"]),
]


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feeds").select("feed", "tz_name", "day_first")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    long = None
    for name, row, fields in TIME_FIELDS:
        part = table(spark, d, name).select(
            F.lit(name).alias("tab"), F.col(row).alias("row_id"), "feed",
            F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])).alias("x"),
        ).select("tab", "row_id", "feed", "x.field", "x.value").where("value is not null")
        long = part if long is None else long.unionByName(part)
    zoned = long.join(_feeds(spark, d), "feed", "left")
    return (
        with_utc_micros(zoned, "value", "tz_name", "day_first")
        .where("utc_us is not null")
        .select("tab", "row_id", "field", "utc_us")
        .distinct()
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    reports = with_utc_micros(
        table(spark, d, "baseline_reports").join(_feeds(spark, d), "feed", "left"), "generated_at", "tz_name", "day_first", out="at"
    )
    findings = table(spark, d, "baseline_findings").withColumn("fp", F.lower("fingerprint"))
    changes = snapshot_changes(
        snapshot_order(reports, "series_id", "report_id", "at"), findings, "report_id", "fp", ["rule_id", "file_path", "line", "severity"]
    )
    return changes.select(
        F.col("series").alias("series_id"), F.col("prev").alias("prev_report_id"), F.col("snapshot").alias("report_id"),
        F.col("key").alias("fingerprint"), "change_kind",
    )


QUERIES = {"p2_found": p2_found, "p5_found": p5_found}
