import random

from siftlake.operators.snapshots import snapshot_changes, snapshot_order

REPORTS, RECORDS = "series long, report long, at long", "report long, fp string, a string, b long"


def changes(spark, reports, records):
    order = snapshot_order(spark.createDataFrame(reports, REPORTS), "series", "report", "at")
    out = snapshot_changes(order, spark.createDataFrame(records, RECORDS), "report", "fp", ["a", "b"])
    return sorted((r.series, r.prev, r.snapshot, r.key, r.change_kind) for r in out.collect())


def test_against_brute_force(spark):
    rng = random.Random(1)
    reports = [(s, 10 * s + k, rng.randrange(100)) for s in range(3) for k in range(5)] + [(0, 3, 1000), (None, 7, 1), (1, None, 2), (1, 15, None)]
    records = [(r, f"f{rng.randrange(6)}", rng.choice(["x", "y", None]), rng.choice([1, None])) for r in [*range(0, 35)] for _ in range(4)]
    seen, unique = set(), []
    for r in records:
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            unique += [r, r]  # whole rows repeated
    unique += [(1, None, "x", 1), (99, "f1", "x", 1)]
    at = {}
    for s, r, t in reports:
        if None not in (s, r, t):
            at[(s, r)] = min(t, at.get((s, r), 1 << 60))
    want = []
    for s in {k[0] for k in at}:
        order = sorted(((t, r) for (q, r), t in at.items() if q == s))
        for (_, p), (_, n) in zip(order, order[1:]):
            old, new = ({k: v for q, k, *v in unique if q == x and k is not None} for x in (p, n))
            want += [(s, p, n, k, "added") for k in new.keys() - old.keys()] + [(s, p, n, k, "removed") for k in old.keys() - new.keys()]
            want += [(s, p, n, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]]
    assert changes(spark, reports, unique) == sorted(want)


def test_empty_report_counts_and_empty_tables(spark):
    assert changes(spark, [(1, 1, 1), (1, 2, 2), (1, 3, 3)], [(1, "f", "x", 1), (3, "f", "x", 1)]) == [(1, 1, 2, "f", "removed"), (1, 2, 3, "f", "added")]
    assert changes(spark, [], []) == []


def test_a_middle_row_of_nine_goes(spark):
    nine = [(1, "f", str(k), k) for k in range(9)]
    for k in range(9):
        later = [(2, *r[1:]) for r in nine if r[3] != k]
        assert changes(spark, [(1, 1, 1), (1, 2, 2)], nine + later) == [(1, 1, 2, "f", "changed")]
    assert changes(spark, [(1, 1, 1), (1, 2, 2)], nine + [(2, *r[1:]) for r in nine[::-1]] + nine[:2]) == []


def test_a_third_of_all_rows_under_one_key(spark):
    rows = spark.range(3000).selectExpr("id % 2 + 1 as report", "if(id % 3 = 0, 'hot', cast(id div 2 as string)) as fp", "'x' as a", "if(id < 2994 or id % 2 = 0, id div 2, 0) as b")
    order = snapshot_order(spark.createDataFrame([(1, 1, 1), (1, 2, 2)], REPORTS), "series", "report", "at")
    out = {r.key: r.change_kind for r in snapshot_changes(order, rows, "report", "fp", ["a", "b"]).collect()}
    assert out["hot"] == "changed"


def test_small_sides_are_measured_in_bytes(spark):
    from siftlake.operators.joins import small_side

    hinted = lambda df: "Broadcast" in df._jdf.queryExecution().logical().toString() or "broadcast" in df._jdf.queryExecution().logical().toString()
    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) as t", "array(id) as l")
    assert hinted(small_side(wide, 20_000)) and not hinted(small_side(wide, 5_000))
    assert hinted(small_side(wide.limit(0), 0))
