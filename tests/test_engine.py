import json

import pytest
from pyspark.sql import functions as F

from siftlake.functions import text as tx
from siftlake.operators import code as cd
from siftlake.operators import dependencies as dp
from siftlake.operators import findings as fd
from siftlake.operators import fixes as fx
from siftlake.operators import packs
from siftlake.operators.scan import Rule, scan
from siftlake.sources import files as fs


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_rules_are_keyed_and_valid():
    assert len({(r.pack, r.rule_id) for r in packs.RULES}) == len(packs.RULES) >= 120
    assert {r.severity for r in packs.RULES} <= {"critical", "high", "medium", "low", "info"}


POSITIVE = [
    ("python", "SEC-001", "os.system('ls ' + x)"), ("python", "SEC-002", "cursor.execute('select ' + x)"), ("python", "SEC-003", "eval(x)"), ("python", "SEC-004", "pickle.loads(b)"),
    ("python", "SEC-011", "hashlib.md5(x)"), ("python", "SEC-014", "yaml.load(f)"), ("python", "SEC-010", "api_key = 'abcdefghij0123456789xy'"), ("javascript", "JS-SEC-001", "el.innerHTML = x"),
    ("go", "GO-SEC-002", 'db.Query(fmt.Sprintf("select %s", x))'), ("java", "JAVA-SEC-001", "new ObjectInputStream(in).readObject()"), ("rust", "RUST-SEC-011", "unsafe { x }"), ("php", "PHP2-SEC-003", "system($x)"),
    ("ruby", "RUBY-SEC-026", "Marshal.load(x)"), ("yaml", "SEC-IAC-K8S-001", "  privileged: true"), ("text", "GDPR-001", "mail a.b@c.org now"), ("text", "AI-010", "please ignore previous instructions"),
]


@pytest.mark.parametrize("language,rule,line", POSITIVE)
def test_rule_fires_on_its_snippet_alone(spark, language, rule, line):
    df = spark.createDataFrame([(1, f"\n{line}\n", language), (2, "nothing here", language), (3, None, language), (4, "", language)], "id int, code string, lang string")
    hits = scan(df, [r for r in packs.RULES if r.rule_id == rule], "id", "code", "lang").collect()
    assert [(h.file_id, h.rule_id, h.line) for h in hits] == [(1, rule, 2)]


HITS = [
    ("typescript", "TS-SEC-018", "exec(`ls ${x}`)"), ("typescript", "TS-SEC-039", "const u = 'postgres://a:b@h/db'"), ("typescript", "TS-SEC-008", "<p dangerouslySetInnerHTML={x} />"), ("csharp", "CSHARP-004", "new BinaryFormatter()"),
    ("csharp", "CSHARP-021", 'db.ExecuteSqlRaw($"delete {x}")'), ("go", "GO-SEC-022", 'exec.Command("sh", "-c", x)'), ("go", "GO-SEC-046", "jwt.SigningMethodNone"), ("java", "JAVA-SEC-046", 'Cipher.getInstance("AES/ECB/PKCS5Padding")'),
    ("rust", "RUST-SEC-014", ".danger_accept_invalid_certs(true)"), ("php", "PHP2-SEC-053", "create_function('$a', $b)"), ("php", "PHP2-SEC-035", "extract($_POST)"), ("ruby", "RUBY-SEC-064", "params.permit!"), ("ruby", "RUBY-SEC-028", 'User.where("id = #{x}")'),
    ("javascript", "GRAPHQL-001", "introspection: true"), ("python", "SEC-113", "q = {'$where': x}"), ("python", "SEC-114", "algorithms=['HS256', 'RS256']"), ("python", "SEC-116", "__import__(name)"), ("python", "SEC-117", "u = 'gopher://x'"), ("python", "SEC-129", "@csrf_exempt"),
    ("python", "SEC-132", "q = \"' or '1'='1\""), ("python", "QUAL-008", "except ValueError:\n    pass"), ("java", "QUAL-009", "} catch (Exception e) { }"), ("text", "IAC-001", "USER root"), ("text", "AI-103", "tool.description = x"), ("text", "SC-GO-001", "replace a/b => ../b"),
]


@pytest.mark.parametrize("language,rule,line", HITS)
def test_rule_fires(language, rule, line):
    import pyarrow as pa

    from siftlake.operators.scan import _scan_batch

    text = f"é\r\n{line}\r\n"
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([language])], ["file_id", "code", "lang"])
    hit = _scan_batch(batch, [r for r in packs.RULES if r.rule_id == rule]).to_pylist()[0]
    body = text.encode()
    assert (hit["file_id"], hit["rule_id"]) == (7, rule) and hit["line"] >= 2
    assert body[hit["start_byte"] : hit["end_byte"]].decode().replace("\r\n", "\n").startswith(hit["match"].split("\n")[0])
    assert hit["col_no"] == hit["start_byte"] - body.rfind(b"\n", 0, hit["start_byte"]) - 1


def test_scan_of_odd_input(spark):
    rows = [(1, "x" * 300_000 + "\neval(y)"), (1, "x" * 300_000 + "\neval(y)"), (2, ""), (3, None), (4, "\n\n\n"), (5, "a\reval(x)\r"), (6, "\x00eval(\u2028)")]
    df = spark.createDataFrame(rows, "id long, code string").withColumn("line", F.lit("clash")).withColumn("file_id", F.lit("clash"))
    hits = scan(df, [Rule("p", "E", "low", r"\beval\("), Rule("p", "L", "low", r"^.{200,}$"), Rule("p", "N", "low", "zzz", confidence=0.1)], "id", "code", least_confidence=0.5).collect()
    assert sorted((h.file_id, h.rule_id, h.line) for h in hits) == [(1, "E", 2), (1, "E", 2), (1, "L", 1), (1, "L", 1), (5, "E", 1), (6, "E", 1)]
    assert scan(df.limit(0), packs.RULES, "id", "code").count() == 0


def test_text_absence_and_guard_rules(spark):
    df = spark.createDataFrame([(1, "<html>\nx"), (2, "<html> Content-Security-Policy"), (3, "a\nfoo\nbar")], "id int, code string")
    absent = Rule("p", "A", "low", "Content-Security-Policy", mode="absent", guard="<html")
    whole = Rule("p", "T", "low", r"foo\nbar", mode="text")
    guarded = Rule("p", "G", "low", "^bar", guard="foo")
    assert sorted((h.rule_id, h.file_id, h.line) for h in scan(df, [absent, whole, guarded], "id", "code").collect()) == [("A", 1, 1), ("G", 3, 3), ("T", 3, 2)]


def test_scalar_functions(spark):
    assert one(spark, "a\r\nb\n\n", tx.lines) == ["a", "b", ""]
    assert [one(spark, v, tx.version_key) for v in ("v1.10.0", "1.2.3-rc1", "2", None)] == [[1, 10, 0], [1, 2, 3], [2, 0, 0], [0, 0, 0]]
    assert one(spark, "HTTPServerName", tx.snake_case) == "http_server_name" and one(spark, "my_name", tx.pascal_case) == "MyName"
    assert one(spark, "<a & 'b'>", tx.xml_escape) == "&lt;a &amp; &apos;b&apos;&gt;"
    assert one(spark, "x1 = foo(bar, if_) + 2y", tx.identifiers) == ["x1", "foo", "bar", "if_"]
    assert one(spark, " mit license ", tx.normalize_license) == "MIT"
    assert one(spark, 7.0, tx.cvss_severity, "double") == "high"


def test_finding_operators(spark):
    rows = [(1, "SEC-001", "a.py", 3, "medium", True, "s"), (2, "SEC-001", "a.py", 3, "CRITICAL", False, "s"), (3, "SEC-001", "a.py", 3, "critical", False, "s"), (4, "LNG-2", None, None, None, None, None)]
    f = spark.createDataFrame(rows, "finding_id long, rule_id string, file string, line long, severity string, auto_fix boolean, snippet string")
    assert sorted(r.finding_id for r in fd.strongest(f).collect()) == [2, 4]
    assert {r.finding_id for r in fd.severity_in(f, ["INFO"]).collect()} == {4} and fd.severity_in(f, []).count() == 4
    assert {r.finding_id for r in fd.not_ignored(f, [("SEC-001", "*.py", 3)]).collect()} == {4}
    assert fd.not_in_baseline(fd.with_fingerprint(f), fd.with_fingerprint(f).where("finding_id = 1")).select("finding_id").collect()[0][0] == 4
    merged = fd.merged_across_layers(f).where("category = 'security'").first()
    assert merged.detected_by == ["SEC-001"] and merged.avoided == 0
    assert fd.strongest(f.limit(0)).count() == 0
    keys = {"SEC-001": "security", "RUST-SEC-001": "security", "AI-SEC-1": "ai", "TAINT-SQL001": "taint", "RUST-QUAL-001": "RUST-QUAL", "my-xss-rule": "security", "LNG-2": "LNG-2"}
    assert all(one(spark, k, tx.category_key) == v for k, v in keys.items())


def test_marker_numbers_run_on_through_a_hot_category(spark):
    f = spark.range(12_000).selectExpr("id as finding_id", "if(id % 3 = 0, 'unused-x', 'SEC-001') as rule_id", "'clash' as marker_id")
    ids = {r.finding_id: r.marker_id for r in fd.marker_ids(f, "finding_id", prefix="P").collect()}
    assert ids[0] == "P-DC-0001" and ids[1] == "P-SEC-0001" and ids[11_999] == "P-SEC-8000" and len(set(ids.values())) == 12_000
    many = fd.marker_ids(spark.range(10_005).selectExpr("id as finding_id", "cast(null as string) as rule_id"), "finding_id").where("finding_id = 10004").first()
    assert many.marker_id == "10005" and fd.marker_ids(f.limit(0), "finding_id").count() == 0


def test_rate_rounds_ties_to_even(spark):
    from siftlake.operators import reports as rp

    diff = spark.range(400).selectExpr("if(id < 9, 'remediated', 'unchanged') as status")  # 2.25
    assert rp.remediation_rate(diff).first().rate == 2.2


def test_measures_and_anomalies(spark):
    code = "import os\n\ndef f(x):\n    # TODO: y\n    print('a', \"b\")\n" + "  if (a) {\n" * 9 + "}" * 20 + "\n"
    df = spark.createDataFrame([(1, code, "python"), (2, "", "go"), (3, None, "go")], "id long, code string, lang string")
    m = {r.file_id: r for r in cd.metrics(df, "id", "code", "lang").collect()}
    assert set(m) == {1, 2} and (m[2].n_lines, m[2].avg_function_len, m[2].indentation_score) == (0, 0.0, 1.0)
    assert (m[1].n_lines, m[1].function_count, m[1].max_nesting_depth, m[1].string_count, m[1].import_count, m[1].todo_count, m[1].debug_stmts, m[1].blank_lines) == (15, 1, 9, 2, 1, 1, 1, 1)
    found = {r.metric: (r.severity, r.confidence) for r in cd.anomalies(cd.metrics(df, "id", "code", "lang")).collect()}
    assert found == {"max_nesting_depth": ("high", 0.8)}
    marks = cd.machine_marks(spark.createDataFrame([(1, "# x\n# auto-generated\ndef helper():\n    ...\n"), (2, None), (3, "")], "id long, code string"), "id", "code")
    assert [(r.line, r.name) for r in marks.orderBy("line").collect()] == [(2, "Generated Code Header"), (3, "Generic Function Names"), (4, "Ellipsis Pattern")]


def test_first_enclosing_function(spark):
    code = "g()\ndef a():\n    def b():\n        h()\n    k()\n\ndef c(): m()\n"
    facts = cd.python_facts(spark.createDataFrame([(1, code)], "id long, code string"), "id", "code")
    assert {(r.callee, r.function) for r in cd.enclosing_function(facts).collect()} == {("g", None), ("h", "a"), ("k", "a"), ("m", "c")}


def test_lock_files(spark):
    npm3 = json.dumps({"packages": {"": {}, "node_modules/a": {"version": "1.0.0", "integrity": "sha512-x"}, "node_modules/@s/b": {"resolved": "git+ssh://x"}}})
    npm2 = json.dumps({"dependencies": {"c": {"version": "2.0.0", "resolved": "http://x/c.tgz"}}})
    df = spark.createDataFrame([("3", npm3), ("2", npm2), ("bad", "{")], "path string, code string")
    got = {(r.path, r.name, r.version, r.status) for r in fs.integrity(fs.npm_packages(df)).collect()}
    assert got == {("3", "a", "1.0.0", "Valid"), ("3", "@s/b", "*", "GitSource"), ("2", "c", "2.0.0", "HttpSource")}
    cargo = spark.createDataFrame([("Cargo.lock", 'x = 1\n[[package]]\nname = "serde"\nversion = "1.0"\n\n[[package]]\nname = "b"\nversion = "2"\n')], "path string, code string")
    assert [(r.name, r.version) for r in fs.cargo_packages(cargo).collect()] == [("serde", "1.0"), ("b", "2")]
    go = spark.createDataFrame([("go.sum", "m/a v1.0.0 h1:abcdefghij=\nm/b v1.0.0/go.mod bad\nm/c v1 h1:x\n")], "path string, code string")
    assert [r.status for r in fs.go_sums(go).collect()] == ["Valid", "InvalidHash", "Warning"]
    assert [r.status for r in fs.go_sums(go, compat=True).collect()] == ["InvalidHash"] * 3
    req = spark.createDataFrame([("r.txt", "# c\nflask==1.0 --hash=sha256:x\nrequests>=2\n-r x\n")], "path string, code string")
    assert [(r.name, r.operator, r.version, r.hashed) for r in fs.requirements(req).collect()] == [("flask", "==", "1.0", True), ("requests", ">=", "2", False)]
    assert fs.hash_mode(fs.requirements(req)).first().hash_mode == "partial"
    assert [r.path for r in fs.lock_files(spark.createDataFrame([("a/go.sum",), ("a/b/c/d/e/f/g/Cargo.lock",), ("x.py",)], "path string")).collect()] == ["a/go.sum"]


def test_directory(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"\xef\xbb\xbfx = 1\n")
    (tmp_path / "src/b.js").write_bytes("é".encode("latin-1"))
    (tmp_path / "node_modules/c.js").write_text("x")
    rows = {r.ext: r for r in fs.directory(spark, str(tmp_path)).collect()}
    assert rows["py"].code == "x = 1\n" and rows["py"].language == "python" and rows["js"].code == "é" and len(rows) == 2


def test_vulnerable_ranges_and_licences(spark):
    p = spark.createDataFrame([("npm", "A", v) for v in ("1.9.9", "1.10.0", "2.0.0", None)], "ecosystem string, name string, version string")
    v = spark.createDataFrame([("V", "npm", "a", "1.10.0", "2.0.0", "high")], "vuln_id string, ecosystem string, package string, introduced string, fixed string, severity string")
    assert [r.version for r in dp.vulnerable(p, v).collect()] == ["1.10.0"]
    lic = spark.createDataFrame([("a", "gplv3"), ("b", "MIT License")], "package string, license string")
    pk = spark.createDataFrame([("p", "npm", "a", "1"), ("p", "npm", "b", "1"), ("p", "npm", "c", "1")], "path string, ecosystem string, name string, version string")
    assert {r.name: r.status for r in dp.license_status(pk, lic).collect()} == {"a": "copyleft", "b": "approved", "c": "undeclared"}
    doc = json.loads(dp.sbom_cyclonedx(pk).first().sbom)
    assert doc["bomFormat"] == "CycloneDX" and [c["purl"] for c in doc["components"]] == ["pkg:npm/a@1", "pkg:npm/b@1", "pkg:npm/c@1"]
    assert json.loads(dp.sbom_spdx(pk).first().sbom)["spdxVersion"] == "SPDX-2.3"


def test_fix_intervals(spark):
    rows = [(1, 1, 0, 5, "A"), (1, 2, 5, 9, "B"), (1, 3, 4, 6, "C"), (1, 4, 20, 20, "D"), (2, 5, 0, 1000, "E"), (2, 6, 600, 700, "F"), (2, 7, None, 3, "G")]
    f = spark.createDataFrame(rows, "file_id long, fix_id long, start long, end long, replacement string")
    assert sorted((r.a, r.b) for r in fx.conflicts(f).collect()) == [(1, 3), (2, 3), (5, 6)]
    assert [x.fix_id for x in fx.chosen(f).where("file = 1").first().fixes] == [1, 2, 4]
    files = spark.createDataFrame([(1, "0123456789abcdefghijk"), (3, "same")], "file_id long, code string")
    out = {r.file_id: r.fixed_code for r in fx.applied(files, fx.chosen(f)).collect()}
    assert out == {1: "AB9abcdefghijDk", 3: "same"}


def test_python_facts_and_taint(spark):
    code = "import os, sys\nfrom re import match\n\ndef used(a):\n    return a\n\ndef lonely(b):\n    raw = input()\n    cmd = 'x' + raw\n    safe = escape(raw)\n    os.system(cmd)\n    db.execute(safe)\n    return used(raw)\n"
    df = spark.createDataFrame([(1, code), (2, "def broken(:"), (3, None), (4, "")], "id long, code string")
    facts = cd.python_facts(df, "id", "code").cache()
    assert {r.name for r in cd.unused_imports(facts).collect()} == {"sys", "match"}
    assert {r.name for r in cd.unused_functions(facts).collect()} == {"lonely"}
    assert {(r.callee, r.function) for r in cd.enclosing_function(facts).collect()} >= {("os.system", "lonely"), ("used", "lonely")}
    assert {r.sink for r in cd.tainted_sinks(facts).collect()} == {"os.system"}


def test_taint_enters_functions(spark):
    code = "def run(cmd):\n    os.system(cmd)\n\nraw = input()\nrun(raw)\n"
    facts = cd.python_facts(spark.createDataFrame([(1, code)], "id long, code string"), "id", "code")
    assert {r.sink for r in cd.tainted_sinks(facts).collect()} == {"os.system"}


def test_facts_of_whole_expressions(spark):
    long = "'" + "x" * 220 + "'"
    chain = "q" + ".filter_by_a_long_name(1)" * 10
    codes = [
        f"raw = input()\ncmd = {long} + raw\nos.system(cmd)\n", f"raw = input()\nos.popen({long} + raw)\n", f"raw = input()\n{chain}.execute(raw)\n",
        f"raw = input()\nsafe = {long} + raw + escape(raw)\nos.system(safe)\n", "raw: str = input()\ncmd = 'a'\ncmd += raw\nos.system(cmd)\n",
        "raw = input()\ndb.execute(query=raw)\n", "def run(a, *, cmd):\n    os.system(cmd)\n\nraw = input()\nrun(1, cmd=raw)\n", "if (raw := input()):\n    eval(raw)\n",
        "\n".join(f"f({long} + 'a{i}')" for i in range(3)) + "\n" + "\n".join(f"g(1, k={i})" for i in range(3)) + "\n" + "h(1, k=2)\n" * 3,
    ]
    facts = cd.python_facts(spark.createDataFrame(list(enumerate(codes)), "id long, code string"), "id", "code").cache()
    sinks = {(r.file_id, r.sink) for r in cd.tainted_sinks(facts).collect()}
    assert sinks == {(0, "os.system"), (1, "os.popen"), (2, chain + ".execute"), (4, "os.system"), (5, "db.execute"), (6, "os.system"), (7, "eval")}
    assert [(r.file_id, r.call, r.n, r.line) for r in cd.repeated_calls(facts).collect()] == [(8, "h(1, k=2)", 3, 7)]


def test_every_finding_enters_the_comparison_of_scans(spark, small):
    from siftlake.plans import reference_queries as rq

    found = rq._findings(spark, small).select("scan_id", "repo", "rule_id", "file").distinct()
    diff = rq.rescan_diff(spark, small).cache()
    assert diff.where("status <> 'remediated'").count() == found.count() == found.intersect(diff.drop("status")).count()
    assert {r.status for r in diff.select("status").distinct().collect()} >= {"new", "remediated"}


def test_cleaners(spark):
    from siftlake.operators import clean as cl

    rows = [("python", "if a == None:  \n    x = yaml.load(f)\nprint('DEBUG 1')\n"), ("javascript", "var a = 1;\nconsole.log(a);\n"), ("go", "x == None \n"), (None, None), ("python", "")]
    df = spark.createDataFrame(rows, "language string, code string")
    out = cl.cleaned(df, package="destructive").collect()
    assert [r.fixed_code for r in out] == ["if a is None:\n    x = yaml.safe_load(f)\n", "let a = 1;\n", "x == None\n", None, ""]
    assert out[0].applied == ["is-none", "trailing-blanks", "yaml-safe-load", "print-debug"]
    again = cl.cleaned(spark.createDataFrame([(r.language, r.fixed_code) for r in out], "language string, code string"), package="destructive").collect()
    assert [r.fixed_code for r in again] == [r.fixed_code for r in out]
    worse = [cl.Rewrite("bad", "python", "run", "eval")]
    r = cl.cleaned(spark.createDataFrame([("python", "run(x)")], "language string, code string"), rewrites=worse).first()
    assert r.refused and r.fixed_code == "run(x)"


def test_line_facts(spark):
    from siftlake.operators import facts as lf

    rows = [(1, "go", "func (t T) Run(a int) {\n\tfmt.Println(a) // TODO x\n}"), (2, "rust", "use a::b;\npub fn f<T>() {}\nstruct S;"), (3, "text", "func x("), (4, "java", None)]
    got = {(r.file_id, r.kind, r.name) for r in lf.line_facts(spark.createDataFrame(rows, "id int, lang string, code string"), "id", "code", "lang").collect()}
    assert {(1, "function", "Run"), (1, "call", "fmt.Println"), (1, "todo", "TODO"), (2, "import", "a::b"), (2, "function", "f"), (2, "class", "S")} <= got and not any(g[0] in (3, 4) for g in got)


def test_settings(tmp_path):
    from siftlake.sources import config

    (tmp_path / "pyproject.toml").write_text('[tool.siftlake]\nprofile = "cli"\nlimits = {lock_depth = 3}\n')
    (tmp_path / ".siftlake.json").write_text('{"severity": "low"}')
    got = config.load(str(tmp_path), environment={"SIFTLAKE_LIMITS__TAINT_ROUNDS": "9", "OTHER": "x", "SIFTLAKE_FAIL_ON": "medium"})
    assert got["profile"] == "cli" and got["severity"] == "low" and got["limits"] == {"taint_rounds": 9, "lock_depth": 3} and got["fail_on"] == "medium"


def test_reachability_with_a_cycle(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "x"), (1, "x", "y"), (2, "a", "z")], "file_id long, src string, dst string")
    seeds = spark.createDataFrame([(1, "a")], "file_id long, node string")
    blocked = spark.createDataFrame([(1, "x")], "file_id long, node string")
    assert sorted(r.node for r in cd.reachable(seeds, edges).collect()) == ["a", "b", "c", "x", "y"]
    assert sorted(r.node for r in cd.reachable(seeds, edges, blocked).collect()) == ["a", "b", "c"]


def test_metrics_nesting(spark):
    df = spark.createDataFrame([(1, "}}(([{\n# TODO: x\n"), (2, "")], "id long, code string")
    rows = {r.file_id: r for r in cd.metrics(df, "id", "code").collect()}
    # by line, braces and parentheses alone: three open and two close on the first
    assert rows[1].max_nesting_depth == 1 and rows[1].todo_count == 1 and rows[1].comment_density == 0.5 and rows[2].max_nesting_depth == 0
