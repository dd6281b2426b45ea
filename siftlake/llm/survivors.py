"""Duplicate groups of findings, and the best representative of each group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.severity import CANONICAL, rank
from siftlake.llm.components import connected_components
from siftlake.llm.joins import small_side
from siftlake.session import checkpoint


def canonical_rule(rule: Column) -> Column:
    """`sec_7`, ` SEC7 ` and `Sec-007` are SEC-007; what has no such form is trimmed and put in upper case."""
    text = F.upper(F.regexp_replace(F.trim(rule), r"\s+", ""))
    stem = F.regexp_extract(text, "^([A-Z]+(?:[-_][A-Z]+)*)[-_.:]?0*([0-9]+)$", 1)
    number = F.regexp_extract(text, "^([A-Z]+(?:[-_][A-Z]+)*)[-_.:]?0*([0-9]+)$", 2)
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.when(F.length(stem) > 0, F.concat_ws("-", stem, padded)).otherwise(text)


def relative_path(path: Column, repo: Column) -> Column:
    """Path relative to the repo: one kind of slash, no empty, `.` or `..` steps, no checkout folder.

    Whatever stands before `<repo>/` (owner and name) in an absolute path is the checkout folder.
    """
    text = F.regexp_replace(F.trim(path), r"\\", "/")
    absolute = text.rlike("^(?:/|[A-Za-z]:/|file:)")
    steps = F.filter(F.split(text, "/"), lambda s: ~s.isin("", "."))
    clean = F.array_join(
        F.aggregate(
            steps, F.array().cast("array<string>"),
            lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
        ), "/",
    )
    mark = F.concat(repo, F.lit("/"))

    def below(clean, mark, absolute):
        at = F.position(F.concat(F.lit("/"), mark), F.concat(F.lit("/"), clean))
        return F.when(absolute & (at > 0), F.substr(clean, at + F.length(mark))).otherwise(clean)

    # The steps are folded once: an expression that is used several times would be so often evaluated.
    one = F.transform(F.array(F.struct(clean.alias("c"), mark.alias("m"), absolute.alias("a"))), lambda x: below(x["c"], x["m"], x["a"]))
    return F.get(one, F.lit(0))


def duplicate_groups(records: DataFrame) -> DataFrame:
    """Add group_id, the smallest raw_id of the finding that each raw record belongs to.

    Within one repo, records are the same finding if they carry the same fingerprint (letter
    case aside) or the same rule, file and line, directly or through further records. A null
    fingerprint, rule, file or line links nothing; a null repo counts as one repo of its own. A
    record that nothing links is its own group; repeated rows fall into one group. Rows without
    raw_id are dropped. A column group_id of the input is replaced; other columns pass through.

    Each key is reduced to its smallest raw_id by a pre-aggregated groupBy; a hot key costs one
    row on the small side of the join back, never a collected group.
    """
    base = records.where("raw_id is not null").select(
        "raw_id",
        F.coalesce("repo", F.lit("\u0000")).alias("repo"),
        F.lower(F.trim("fingerprint")).alias("fp"),
        canonical_rule(F.col("rule_id")).alias("rule"),
        relative_path(F.col("file_path"), F.col("repo")).alias("file"),
        "line",
    )
    by_fp = F.when(F.length("fp") > 0, F.xxhash64(F.lit("f"), "repo", "fp"))
    by_place = F.when(
        F.col("rule").isNotNull() & F.col("file").isNotNull() & F.col("line").isNotNull(),
        F.xxhash64(F.lit("p"), "repo", "rule", "file", "line"),
    )
    keyed = checkpoint(base.select("raw_id", F.explode(F.array(by_fp, by_place)).alias("key")).where("key is not null"))
    least = keyed.groupBy("key").agg(F.min("raw_id").alias("first"))
    edges = keyed.join(least, "key").select(F.col("raw_id").alias("a"), F.col("first").alias("b"))
    parts = connected_components(edges)
    return (
        records.drop("group_id").where("raw_id is not null")
        .join(parts.withColumnRenamed("node", "raw_id").withColumnRenamed("component", "group_id"), "raw_id", "left")
        .withColumn("group_id", F.coalesce("group_id", "raw_id"))
    )


def source_trust(grouped: DataFrame, prior: float = 2.0) -> DataFrame:
    """(scanner, trust) learnt from agreement: the mean share of the other scanners of a group that have the same normalised
    rule and path as this one has, over all groups with at least two; `prior` votes of one half are added to each.

    Nulls vote for nothing; a null scanner is one of its own. A hot group counts once per scanner and
    value, by aggregation before any join. Empty input gives no rows.
    """
    voted = grouped.select(
        "group_id", F.coalesce("scanner", F.lit("")).alias("scanner"),
        F.explode(F.array(
            F.struct(F.lit("rule_id").alias("field"), canonical_rule(F.col("rule_id")).alias("value")),
            F.struct(F.lit("file_path").alias("field"), relative_path(F.col("file_path"), F.col("repo")).alias("value")),
        )).alias("x"),
    ).select("group_id", "scanner", "x.*").where("value is not null").distinct()
    values = voted.groupBy("group_id", "field", "value").agg(F.count("*").alias("same"))
    groups = values.groupBy("group_id", "field").agg(F.sum("same").alias("all")).where(F.col("all") > 1)
    shares = voted.join(values, ["group_id", "field", "value"]).join(groups, ["group_id", "field"])
    share = (F.col("same") - 1) / (F.col("all") - 1)
    known = shares.groupBy("scanner").agg(((F.round(F.sum(share), 6) + prior / 2) / (F.count("*") + prior)).alias("trust"))
    return voted.select("scanner").distinct().join(known, "scanner", "left").select("scanner", F.coalesce("trust", F.lit(0.5)).alias("trust"))


def best_representative(grouped: DataFrame, trust: DataFrame | dict[str, float] | None = None, half_life_days: float = 90.0) -> DataFrame:
    """One row per group: group_id, n_records, and rule_id, file_path, line, severity field by field.

    The fields are unpivoted to long rows, each with the weight of its vote; votes are summed
    per normalised value, the winner is taken with max_by, and the winners are pivoted back.
    rule_id and file_path: source trust (a table of scanner and trust, as source_trust() gives, or a
    mapping; 1.0 for scanners it does not name) times a decay that halves in `half_life_days` before the
    newest record of all; ties go to the smaller value. Line and severity take no votes, as the problem
    fixes them. line: the newest record that has one (ties: the larger raw_id). severity: each spelling counts
    as the level it stands for in any of the tables (crit, error, warn, note, moderate ...),
    and the highest level by the dedup ranks wins; other text and nulls vote for none, and a
    group with neither is `info`. A field that no record has is null. Empty input gives no rows.
    """
    newest = grouped.agg(F.max("recorded_at").alias("__newest"))
    fields = ["group_id", "raw_id", "repo", "scanner", "rule_id", "file_path", "line", "severity", "recorded_at"]
    base = grouped.select(*fields).crossJoin(F.broadcast(newest))  # one row: an aggregate without keys
    if isinstance(trust, DataFrame):
        # As many rows as there are scanners: counted, then broadcast.
        base = base.withColumn("__by", F.coalesce("scanner", F.lit(""))).join(small_side(trust.select(F.col("scanner").alias("__by"), F.col("trust").alias("__trust"))), "__by", "left")
        trust_of = F.coalesce("__trust", F.lit(1.0))
    else:
        trust_of = F.lit(1.0)
        for scanner, weight in (trust or {}).items():
            trust_of = F.when(F.col("scanner") == scanner, weight).otherwise(trust_of)
    age = (F.unix_micros(F.col("__newest").cast("timestamp")) - F.unix_micros(F.col("recorded_at").cast("timestamp"))) / 86_400e6
    weight = trust_of * F.pow(F.lit(0.5), F.coalesce(age, F.lit(36_500.0)) / F.lit(half_life_days))
    vote = F.round(weight * 1_000_000).cast("long")  # integers: sums don't depend on their order
    moment = F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(1 << 62)))
    none = F.lit(None).cast("long")
    sev_rank = rank("severity", "level")

    def field(name: str, value: Column, votes: Column, first: Column, second: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.cast("string").alias("value"), votes.cast("long").alias("vote"), first.cast("long").alias("k1"), second.cast("long").alias("k2"))

    long = base.select(
        "group_id",
        F.explode(
            F.array(
                field("rule_id", canonical_rule(F.col("rule_id")), vote, none, none),
                field("file_path", relative_path(F.col("file_path"), F.col("repo")), vote, none, none),
                field("line", F.col("line"), none, moment, F.col("raw_id")),
                field("severity", F.when(sev_rank > 0, sev_rank), none, sev_rank, none),
                field("n", F.lit("1"), F.lit(1), none, none),
            )
        ).alias("x"),
    ).select("group_id", "x.*").where("value is not null")
    votes = long.groupBy("group_id", "field", "value").agg(
        F.sum("vote").alias("vote"), F.max(F.struct("k1", "k2")).alias("k")
    )
    order = F.struct(F.coalesce("vote", F.lit(-1)), F.coalesce("k.k1", none, F.lit(-(1 << 62))), F.coalesce("k.k2", F.lit(-(1 << 62))))
    # max_by is not told how to break ties, so the value itself, inverted, closes the order.
    winners = votes.groupBy("group_id", "field").agg(
        F.max_by(F.struct("value", "vote"), F.struct(order, F.transform(F.split("value", ""), lambda c: -F.ascii(c)))).alias("w")
    )
    one = lambda name, what="value": F.max(F.when(F.col("field") == name, F.col(f"w.{what}")))
    out = winners.groupBy("group_id").agg(
        one("rule_id").alias("rule_id"), one("file_path").alias("file_path"), one("line").cast("bigint").alias("line"),
        F.coalesce(one("severity").cast("int"), F.lit(1)).alias("s"), one("n", "vote").alias("n_records"),
    )
    severity = F.element_at(F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair]), F.col("s"))
    return out.select("group_id", "rule_id", "file_path", "line", severity.alias("severity"), "n_records")
