from pyspark.sql import functions as F

from siftlake.operators import code as cd
from siftlake.operators import diffs
from siftlake.operators import packs
from siftlake.operators.taint_rules import taint_findings


def test_diffs_and_ranges(spark):
    rows = [(1, "a\nb\nc\n", "a\nX\nY\nc\n"), (2, "same", "same"), (3, None, "new"), (4, "gone\nkept", "kept"), (5, None, None), (6, "", "")]
    out = {r.file_id: r for r in diffs.diffs(spark.createDataFrame(rows, "id long, a string, b string"), "id", "a", "b").collect()}
    assert set(out) == {1, 3, 4}
    assert (out[1].added, out[1].removed, [tuple(x) for x in out[1].ranges]) == (2, 1, [(2, 3)]) and "\n-b\n+X\n+Y\n" in out[1].diff
    assert (out[4].added, out[4].removed, [tuple(x) for x in out[4].ranges]) == (0, 1, [(0, 0)])


def test_scalars(spark):
    df = spark.createDataFrame([("a b/ü*~.-_", "go", "aabb"), (None, None, ""), ("x\n  y", "html", "a")], "t string, l string, s string")
    rows = df.select(diffs.percent_encoded(F.col("t")).alias("p"), diffs.as_comment(F.col("t"), F.col("l")).alias("c"), diffs.entropy(F.col("s")).alias("e"), diffs.shortened(F.col("t"), 3).alias("s")).collect()
    assert [r.p for r in rows] == ["a%20b%2F%C3%BC%2A~.-_", None, "x%0A%20%20y"] and rows[0].c.startswith("// ") and rows[2].c == "<!-- x y -->" and rows[1].c is None
    assert [round(r.e, 3) for r in rows] == [1.0, 0.0, 0.0] and rows[0].s == "a b..."
    parts = spark.createDataFrame([("CVSS:3.1/AV:N/AC:L/PR:N",), ("junk",), (None,)], "v string").select(diffs.vector_parts(F.col("v")).alias("m")).collect()
    assert parts[0].m["AV"] == "N" and parts[0].m["PR"] == "N" and parts[1].m is None and parts[2].m is None


def test_taint_rules(spark):
    codes = [
        "sql = request.args\ncursor.execute('x' + sql)\n", "import shlex\npart = shlex.quote(request.args)\nos.system(part)\n", "def run(cmd):\n    subprocess.run(cmd)\nrun(request.form)\n",
        "data = request.body\nobj = pickle.loads(data)\nyaml.load(data)\n", "x = 1\neval(x)\n", "name = secure_filename(request.files)\nopen(name)\n", "def broken(:\n", "",
    ]
    facts = cd.python_facts(spark.createDataFrame(list(enumerate(codes)), "id long, code string"), "id", "code")
    found = {(r.file_id, r.rule_id, r.sink) for r in taint_findings(facts).collect()}
    assert found == {(0, "TAINT-SQL001", "cursor.execute"), (2, "TAINT-CMD001", "subprocess.run"), (3, "TAINT-DES001", "pickle.loads"), (3, "TAINT-YAML001", "yaml.load")}
    assert taint_findings(facts.limit(0)).count() == 0


def test_listing_and_risks(spark):
    rows = packs.listing(spark).collect()
    assert len(rows) == len(packs.RULES) and packs.risk_of("CWE-89") == "A03:2021" and packs.risk_of("CWE-9999") is None and packs.risk_of(None) is None
    assert {r.owasp_id for r in rows if r.cwe_id == "CWE-918"} == {"A10:2021"}
