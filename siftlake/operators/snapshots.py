"""What changed between full snapshots of a table: repeats go first, then one aggregation shuffle classifies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.operators.joins import small_side


def snapshot_order(reports: DataFrame, series: str, snapshot: str, instant: str) -> DataFrame:
    """(series, snapshot, prev, next) of each snapshot, by instant and then id.

    A snapshot that is delivered several times counts once, at its earliest known instant;
    one without any instant, series or id cannot be placed and is left out. One row per
    snapshot is sorted per series, not its records.
    """
    once = (
        reports.where(F.col(series).isNotNull() & F.col(snapshot).isNotNull() & F.col(instant).isNotNull())
        .groupBy(F.col(series).alias("series"), F.col(snapshot).alias("snapshot"))
        .agg(F.min(instant).alias("at"))
    )
    w = Window.partitionBy("series").orderBy("at", "snapshot")
    return once.select("series", "snapshot", F.lag("snapshot").over(w).alias("prev"), F.lead("snapshot").over(w).alias("next"))


def snapshot_changes(ordered: DataFrame, records: DataFrame, snapshot: str, key: str, compared: Sequence[str]) -> DataFrame:
    """(series, prev, snapshot, key, change_kind) for each key that differs between neighbours.

    The distinct rows of each key in each snapshot come first, as hashes of the `compared`
    columns, by a pre-aggregated groupBy that spreads a hot key by those hashes. Every one is then
    tagged twice, as the new side of its own snapshot and as the old side of the next one, and
    one groupBy over (snapshots, key) compares the sides by an order-free digest of their rows: how
    many, the sum and the exclusive or of two independent hashes. Nulls are values like others. Snapshots
    without records count: the other side then is all removed or all added. Repeated rows change
    nothing; a key with several different rows has changed if the sets differ. Null keys and
    records of unknown snapshots are ignored. The first snapshot yields nothing.
    """
    values = [F.struct(F.col(c).isNull(), F.col(c)) for c in compared]
    rows = records.where(F.col(key).isNotNull()).select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), F.xxhash64(*values).alias("h"), F.xxhash64(F.lit("second"), *values).alias("g")
    )
    placed = rows.distinct().join(small_side(ordered), "snapshot")
    tagged = placed.select(
        "series", "key", "h", "g",
        F.explode(F.array(
            F.struct(F.col("prev").alias("old"), F.col("snapshot").alias("new"), F.lit(True).alias("is_new")),
            F.struct(F.col("snapshot").alias("old"), F.col("next").alias("new"), F.lit(False).alias("is_new")),
        )).alias("t"),
    ).where("t.old is not null and t.new is not null")

    def digest(side) -> list:
        h, g = F.when(side, F.col("h")), F.when(side, F.col("g"))
        return [F.count_if(side), F.sum(F.shiftright(h, 40)), F.bit_xor(h), F.bit_xor(g)]

    is_new, names = F.col("t.is_new"), ["n", "s", "x", "y"]
    sides = tagged.groupBy("series", "t.old", "t.new", "key").agg(
        *[c.alias(f"new_{n}") for n, c in zip(names, digest(is_new))], *[c.alias(f"old_{n}") for n, c in zip(names, digest(~is_new))]
    )
    differ = F.lit(False)
    for n in names:
        differ = differ | (F.col(f"new_{n}") != F.col(f"old_{n}"))
    kind = F.when(F.col("old_n") == 0, "added").when(F.col("new_n") == 0, "removed").when(differ, "changed")
    return sides.select("series", F.col("old").alias("prev"), F.col("new").alias("snapshot"), "key", kind.alias("change_kind")).where("change_kind is not null")
