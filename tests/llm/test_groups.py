import random

from siftlake.llm.components import connected_components
from siftlake.llm.survivors import best_representative, canonical_rule, duplicate_groups, relative_path, source_trust

SCHEMA = "raw_id long, repo string, scanner string, rule_id string, file_path string, line long, severity string, fingerprint string, recorded_at timestamp_ntz"


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {n: find(n) for n in list(parent)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_components_of_nothing_and_of_a_hub(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    hub = spark.range(1, 2000).selectExpr("0L as a", "id as b")
    assert {r.component for r in connected_components(hub).collect()} == {0}


def test_canonical_forms(spark):
    df = spark.createDataFrame([("sec_7", "/workspace/o/r/./a//b.py"), (" SEC7 ", ".\\a\\b.py"), ("Sec-007", "a/./b.py"), ("SEC-1234", "a/x/../b.py"), (None, None)], "r string, p string")
    rows = df.select(canonical_rule(df.r).alias("r"), relative_path(df.p, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("o/r")).alias("p")).collect()
    assert [r.r for r in rows] == ["SEC-007", "SEC-007", "SEC-007", "SEC-1234", None]
    assert [r.p for r in rows] == ["a/b.py"] * 4 + [None]


def test_groups_and_survivors(spark):
    from datetime import datetime as dt

    rows = [
        (1, "o/r", "a", "SEC-1", "x.py", 5, "low", None, dt(2025, 1, 1)), (2, "o/r", "b", "sec_001", "./x.py", 5, "crit", "AB", dt(2025, 1, 2)),
        (3, "o/r", "c", "SEC001", "x.py", None, "MODERATE", "ab", dt(2025, 1, 9)), (4, "o/r", "c", "SEC-001", "x.py", 7, "note", "ab", dt(2025, 1, 3)),
        (5, "o/q", "a", "SEC-001", "x.py", 5, "high", "ab", dt(2025, 1, 1)), (6, "o/q", "a", "SEC-002", "y.py", None, None, None, None), (6, "o/q", "a", "SEC-002", "y.py", None, None, None, None),
        (None, "o/q", "a", "SEC-002", "y.py", 1, None, None, None),
    ]
    out = {r.group_id: r for r in best_representative(duplicate_groups(spark.createDataFrame(rows, SCHEMA))).collect()}
    # 1-2 by place, 2-3-4 by fingerprint; the line is that of the newest record that has one
    assert (out[1].rule_id, out[1].file_path, out[1].line, out[1].severity, out[1].n_records) == ("SEC-001", "x.py", 7, "critical", 4)
    assert out[5].n_records == 1 and out[5].severity == "high"
    assert (out[6].line, out[6].severity, out[6].n_records) == (None, "info", 2)
    assert set(out) == {1, 5, 6}


def test_a_third_of_all_rows_in_one_group(spark):
    rows = spark.range(3000).selectExpr(
        "id as raw_id", "'o/r' as repo", "'a' as scanner", "'SEC-001' as rule_id", "'x.py' as file_path", "id + 10 as line", "'low' as severity",
        "if(id % 3 = 0, 'hot', cast(id as string)) as fingerprint", "timestamp_ntz '2025-01-01 00:00:00' as recorded_at", "7L as group_id",
    )
    out = {r.group_id: r.n_records for r in best_representative(duplicate_groups(rows)).collect()}
    assert out[0] == 1000 and len(out) == 2001


def test_empty(spark):
    assert best_representative(duplicate_groups(spark.createDataFrame([], SCHEMA))).count() == 0


def test_votes_prefer_trust_and_recency(spark):
    from datetime import datetime as dt

    rows = [(i, "r", s, "SEC-001", p, 1, "low", "f", t) for i, (s, p, t) in enumerate([("old", "a.py", dt(2024, 1, 1)), ("old", "a.py", dt(2024, 1, 1)), ("new", "b.py", dt(2025, 1, 1))])]
    assert best_representative(duplicate_groups(spark.createDataFrame(rows, SCHEMA))).first().file_path == "b.py"
    assert best_representative(duplicate_groups(spark.createDataFrame(rows, SCHEMA)), trust={"old": 100.0}).first().file_path == "a.py"


def test_trust_is_learnt_from_agreement(spark):
    from datetime import datetime as dt

    day = dt(2025, 1, 1)
    rows, k = [], 0
    for g in range(40):
        for scanner in ("a", "b", "odd"):
            path = f"f{g}.py" if scanner != "odd" or g % 4 == 0 else f"other{g}.py"
            rows.append((k, "r", scanner, "SEC-001", path, g, "low", f"fp{g}", day))
            k += 1
    # "odd" is the newest in one group of two: its vote weighs less than its recency gives it
    rows += [(k, "r", "odd", "SEC-001", "z-odd.py", 1, "low", "last", dt(2025, 1, 20)), (k + 1, "r", "a", "SEC-001", "z.py", 1, "low", "last", dt(2025, 1, 10)), (k + 2, "r", None, "SEC-001", None, 1, "low", "lone", None)]
    groups = duplicate_groups(spark.createDataFrame(rows, SCHEMA).withColumn("trust", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("clash")))
    trust = {r.scanner: r.trust for r in source_trust(groups).collect()}
    assert trust["odd"] < 0.7 < trust["a"] and trust[""] == 0.5
    of = lambda t: {r.group_id: r.file_path for r in best_representative(groups, t).collect()}[k]
    assert of(None) == "z-odd.py" and of(source_trust(groups)) == "z.py"
