"""Replacements as intervals: conflicts, a greedy selection, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(fixes: DataFrame, file: str = "file_id", fix: str = "fix_id", bin_size: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of overlapping [start, end) intervals of one file. Touching ones don't overlap.

    Both sides are spread over bins, so that a file with many fixes is no single group; a pair
    is kept in the bin where its overlap begins. Null and empty intervals overlap nothing.
    """
    f = fixes.where("start is not null and `end` is not null and start < `end`")
    side = lambda p: f.select(F.col(file).alias("file"), F.col(fix).alias(p), F.col("start").alias(f"s{p}"), F.col("end").alias(f"e{p}"), F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))).alias("bin"))
    both = side("a").join(side("b"), ["file", "bin"]).where("a < b and sa < eb and sb < ea")
    return both.where(F.floor(F.greatest("sa", "sb") / bin_size) == F.col("bin")).select("file", "a", "b")


def chosen(fixes: DataFrame, file: str = "file_id") -> DataFrame:
    """(file, fixes): a greedy choice without overlaps, by start, then end, then id. Folded per file over its own fixes."""
    item = F.struct("start", "end", "fix_id", "replacement")
    ordered = F.array_sort(F.collect_list(item))
    kept = F.aggregate(
        ordered, F.slice(ordered, 1, 0),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).when(F.element_at(acc, -1)["end"] <= x["start"], F.concat(acc, F.array(x))).otherwise(acc),
    )
    return fixes.where("start is not null and `end` is not null and start <= `end`").groupBy(F.col(file).alias("file")).agg(kept.alias("fixes"))


def applied(files: DataFrame, choice: DataFrame, file_id: str = "file_id", code: str = "code") -> DataFrame:
    """With fixed_code: the chosen replacements put in from the last to the first; files without fixes keep their code."""
    back = F.aggregate(
        F.reverse("fixes"), F.col(code),
        lambda text, x: F.concat(F.substr(text, F.lit(1), x["start"].cast("int")), x["replacement"], F.substr(text, x["end"].cast("int") + 1)),
    )
    joined = files.join(choice.withColumnRenamed("file", file_id), file_id, "left")
    return joined.withColumn("fixed_code", F.when(F.col("fixes").isNull(), F.col(code)).otherwise(back)).drop("fixes")
