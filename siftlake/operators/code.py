"""Facts, metrics and structure of code: Python syntax facts, file metrics, anomalies, duplication, taint."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as tx
from siftlake.session import checkpoint

_FACT = pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("detail", pa.string()), ("args", pa.list_(pa.string())), ("uses", pa.list_(pa.string())), ("clean", pa.bool_()), ("passed", pa.list_(pa.struct([("param", pa.string()), ("uses", pa.list_(pa.string()))]))), ("digest", pa.string())])
FACT_SCHEMA = "file_id long, kind string, name string, line int, end_line int, detail string, args array<string>, uses array<string>, clean boolean, passed array<struct<param:string,uses:array<string>>>, digest string"

SOURCES = ["input", "request", "sys.argv", "os.environ", "recv", "read_line"]
SINKS = ["execute", "system", "popen", "eval", "exec", "open", "loads", "render"]
SANITIZERS = ["escape", "quote", "sanitize", "validate", "int", "secure_filename", "basename", "realpath", "normpath", "mogrify", "literal_eval", "safe_load", "allowlist", "is_safe_url"]
_CLEAN = re.compile(r"\b(?:" + "|".join(SANITIZERS) + r")\w*\s*\(", re.A)
_NAME = re.compile(tx.NAME)


def python_facts(files: DataFrame, file_id: str, code: str) -> DataFrame:
    """One row per syntax fact of each Python text: function, class, import, assignment, call, string, except, name, duplicate body.

    `detail` and `args` are shortened to show; `uses` (the identifiers), `clean` (whether a sanitizer is called), `passed` (the
    identifiers of each argument, under its keyword or position; of a function, its keyword-only parameters in `uses`) and
    `digest` (of a whole call) come from whole expressions. Texts that do not parse, nulls and empty texts have no facts. One Arrow pass; rows are independent.
    """

    def run(batches):
        schema = pa.schema([("file_id", pa.int64()), *[(f.name, f.type) for f in _FACT]])
        for batch in batches:
            out = []
            for i, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [{"file_id": i, **f} for f in facts_of(source)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return files.select(F.col(file_id).cast("long").alias("file_id"), F.col(code).alias("code")).mapInArrow(run, FACT_SCHEMA)


def facts_of(source: str | None) -> list[dict]:
    if not source:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[dict] = []

    def add(kind, name, node, detail="", args=(), **more):
        out.append({"kind": kind, "name": name, "line": node.lineno, "end_line": getattr(node, "end_lineno", node.lineno), "detail": detail, "args": list(args), **more})

    def names(text):
        return [w for w in dict.fromkeys(_NAME.findall(text)) if w not in tx.KEYWORDS]

    def assigned(kind, targets, node):
        value = ast.unparse(node.value)
        for t in targets:
            add(kind, ast.unparse(t), node, value[:200], uses=names(value), clean=bool(_CLEAN.search(value)))

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add("function", node.name, node, "async" if isinstance(node, ast.AsyncFunctionDef) else "", [a.arg for a in [*node.args.posonlyargs, *node.args.args]], uses=[a.arg for a in node.args.kwonlyargs])
            body = "".join(ast.dump(s) for s in node.body)
            if len(body) >= 50:
                add("body", node.name, node, hashlib.md5(body.encode()).hexdigest())
        elif isinstance(node, ast.ClassDef):
            add("class", node.name, node)
        elif isinstance(node, ast.Import):
            for a in node.names:
                add("import", (a.asname or a.name).split(".")[0], node, a.name)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                add("import", a.asname or a.name, node, f"{node.module or ''}.{a.name}")
        elif isinstance(node, ast.Assign):
            assigned("assignment", node.targets, node)
        elif isinstance(node, ast.NamedExpr) or isinstance(node, ast.AnnAssign) and node.value:
            assigned("assignment", [node.target], node)
        elif isinstance(node, ast.AugAssign):
            assigned("augmented", [node.target], node)
        elif isinstance(node, ast.Call):
            callee, args = ast.unparse(node.func), [(str(k), "", ast.unparse(a)) for k, a in enumerate(node.args)]
            args += [(k.arg or "**", f"{k.arg}=" if k.arg else "**", ast.unparse(k.value)) for k in node.keywords]
            shown = [sign + a for _, sign, a in args]
            add("call", callee, node, "", [a[:200] for a in shown], passed=[{"param": p, "uses": names(a)} for p, _, a in args], digest=hashlib.md5("\0".join([callee, *shown]).encode("utf-8", "surrogatepass")).hexdigest())
        elif isinstance(node, ast.Constant) and isinstance(node.value, str):
            add("string", node.value[:200], node)
        elif isinstance(node, ast.ExceptHandler):
            empty = all(isinstance(s, ast.Pass) for s in node.body)
            add("except", ast.unparse(node.type) if node.type else "", node, "empty" if empty else "")
        elif isinstance(node, ast.Name):
            add("name", node.id, node, "store" if isinstance(node.ctx, ast.Store) else "load")
    return out


def unused_imports(facts: DataFrame) -> DataFrame:
    """Imports whose name is loaded nowhere in the file (left anti join)."""
    used = facts.where("kind = 'name' and detail = 'load'").select("file_id", "name").distinct()
    return facts.where("kind = 'import' and name <> '*'").select("file_id", "name", "line").join(used, ["file_id", "name"], "left_anti")


def unused_functions(facts: DataFrame) -> DataFrame:
    """Functions that no call in the file names, as name or attribute; short names and usual entry points are kept."""
    called = facts.where("kind = 'call'").select("file_id", F.element_at(F.split("name", r"\."), -1).alias("name")).distinct()
    own = facts.where("kind = 'function'").where((F.length("name") >= 3) & ~F.col("name").isin("main", "setup", "teardown") & ~F.col("name").rlike("^(?:test_|__)"))
    return own.select("file_id", "name", "line").join(called, ["file_id", "name"], "left_anti")


def duplicate_functions(facts: DataFrame) -> DataFrame:
    """Functions whose body equals an earlier one in the file, with the first that has it."""
    bodies = facts.where("kind = 'body'")
    first = bodies.groupBy("file_id", "detail").agg(F.min(F.struct("line", "name")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return bodies.join(first, ["file_id", "detail"]).where(F.struct("line", "name") != F.col("first")).select("file_id", "name", "line", F.col("first.name").alias("original"), F.col("first.line").alias("original_line"))


def repeated_calls(facts: DataFrame, least: int = 3) -> DataFrame:
    """Calls that a file makes again and again, all arguments alike; long arguments are shortened only in what is shown."""
    calls = facts.where("kind = 'call'").withColumn("call", F.concat("name", F.lit("("), F.concat_ws(", ", "args"), F.lit(")")))
    counted = calls.groupBy("file_id", "digest").agg(F.min("call").alias("call"), F.count("*").alias("n"), F.min("line").alias("line"))
    return counted.where(F.col("n") >= least).select("file_id", "call", "n", "line")


def mixed_naming(facts: DataFrame) -> DataFrame:
    """Files that name things in both camelCase and snake_case."""
    names = facts.where("kind in ('function', 'assignment')")
    camel, snake = F.col("name").rlike("^[a-z]+[A-Z][A-Za-z0-9]*$"), F.col("name").rlike("^[a-z0-9]+_[a-z0-9_]+$")
    return names.groupBy("file_id").agg(F.count_if(camel).alias("camel"), F.count_if(snake).alias("snake")).where("camel > 0 and snake > 0")


def enclosing_function(facts: DataFrame) -> DataFrame:
    """(file_id, callee, line, function): each call with the first function, by line, whose lines hold it; null outside of functions.

    The lines that a function is the first to hold are one interval, and these don't overlap; a call is
    looked up among them as of its line, by one ordering of each file's functions and calls. No call is paired with all functions.
    """
    order = Window.partitionBy("file_id").orderBy("line", F.desc("end_line"), "name")
    reached = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    functions = facts.where("kind = 'function'").select("file_id", F.col("name"), F.greatest(F.col("line"), F.coalesce(reached + 1, F.col("line"))).alias("at"), F.col("end_line").alias("hi"))
    functions = functions.where("at <= hi").select("file_id", "at", F.lit(0).alias("is_call"), F.lit(None).cast("string").alias("callee"), F.struct("name", "hi").alias("f"))
    calls = facts.where("kind = 'call'").select("file_id", F.col("line").alias("at"), F.lit(1).alias("is_call"), F.col("name").alias("callee"), F.lit(None).cast(functions.schema["f"].dataType).alias("f")).distinct()
    last = F.last("f", ignorenulls=True).over(Window.partitionBy("file_id").orderBy("at", "is_call").rowsBetween(Window.unboundedPreceding, 0))
    found = functions.unionByName(calls).withColumn("f", last).where("is_call = 1")
    return found.select("file_id", "callee", F.col("at").alias("line"), F.when(F.col("f.hi") >= F.col("at"), F.col("f.name")).alias("function"))


# What begins a function and a class on a trimmed line, by language and for others.
FUNCTION_LINES = {
    "python": r"^def\s+\w+", "javascript": r"^(function\s+\w+|const\s+\w+\s*=\s*(?:async\s*)?\(|=>)", "typescript": r"^(function\s+\w+|const\s+\w+\s*=\s*(?:async\s*)?\(|=>)",
    "go": r"^func\s+(\(\w+\s+\*?\w+\)\s+)?\w+", "java": r"^\s*(public|private|protected)?\s*(static)?\s*\w+\s+\w+\s*\(", "rust": r"^\s*(pub\s+)?fn\s+\w+", "": r"^\s*\w+\s+\w+\s*\(",
}
CLASS_LINES = {
    "python": r"^class\s+\w+", "javascript": r"^class\s+\w+", "typescript": r"^class\s+\w+", "go": r"^type\s+\w+\s+struct", "java": r"^\s*class\s+\w+", "rust": r"^\s*(pub\s+)?struct\s+\w+", "": r"^\s*class\s+\w+",
}
# A string literal, and what makes a line an import, an open mark and a debug statement.
STRING = r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'"""
IMPORT = r"^\s*(?:import|from|require|include|#include)\s+"
TODO = r"(?i)(TODO|FIXME|HACK|XXX|BUG|NOTE):"
DEBUG = r"(?i)\b(print|console\.(log|debug)|fmt\.Print|echo|puts|debug)\s*\("
EMPTY_FUNCTION = r"(?m)^\s*(def|fn|function)\s+\w+\s*\([^)]*\)\s*:\s*\n\s*(?:pass|\.\.\.)\s*(?:\n|\z)"


def metrics(files: DataFrame, file_id: str, code: str, language: str | None = None) -> DataFrame:
    """Thirteen measures of each text, and a few more: lines, functions, classes, mean lines a function, deepest nesting of
    braces and parentheses, strings, imports, share of comments, mean and longest line in bytes, open marks, debug
    statements, score of indentation (1 for a multiple of four blanks, else a half), blank lines, empty functions.

    Nesting is a balance by line that never falls below 0. Null texts are left out, empty ones have no lines. Rows are
    independent; without a language the general patterns hold.
    """
    lang = F.coalesce(F.lower(F.col(language)), F.lit("")) if language else F.lit("")

    def by_language(patterns: dict[str, str], x):
        out = x.rlike(patterns[""])
        for name, p in patterns.items():
            if name:
                out = F.when(F.col("__lang") == name, x.rlike(p)).otherwise(out)
        return out

    base = files.where(F.col(code).isNotNull()).select(F.col(file_id).alias("file_id"), F.col(code).alias("__code"), lang.alias("__lang"))
    ls = F.when(F.col("__code") == "", F.array().cast("array<string>")).otherwise(tx.lines(F.col("__code")))
    split = F.transform(ls, lambda x: F.struct(x.alias("l"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("t"), F.octet_length(F.regexp_extract(x, r"^\s*", 0)).alias("lead"), F.octet_length(x).alias("bytes")))
    net = lambda x: F.length(F.regexp_replace(x, r"[^{(]", "")) - F.length(F.regexp_replace(x, r"[^})]", ""))
    one = lambda c: c.cast("int")

    def add(acc, x):
        line, text = x["l"], x["t"]
        now = acc["now"] + net(line)
        filled = text != ""
        return F.struct(
            (acc["functions"] + one(by_language(FUNCTION_LINES, text))).alias("functions"), (acc["classes"] + one(by_language(CLASS_LINES, text))).alias("classes"),
            (acc["strings"] + F.regexp_count(line, F.lit(STRING))).alias("strings"), (acc["imports"] + one(line.rlike(IMPORT))).alias("imports"),
            (acc["comments"] + one(text.rlike("^(#|//)"))).alias("comments"), (acc["todos"] + one(line.rlike(TODO))).alias("todos"), (acc["debugs"] + one(line.rlike(DEBUG))).alias("debugs"),
            (acc["bytes"] + x["bytes"]).alias("bytes"), F.greatest(acc["longest"], x["bytes"]).alias("longest"),
            (acc["even"] + one(filled & (x["lead"] % 4 == 0))).alias("even"), (acc["filled"] + one(filled)).alias("filled"),
            F.greatest(now, F.lit(0)).alias("now"), F.greatest(acc["nesting"], now).alias("nesting"),
        )

    names = ["functions", "classes", "strings", "imports", "comments", "todos", "debugs", "bytes", "longest", "even", "filled", "now", "nesting"]
    sums = F.aggregate("__split", F.struct(*[F.lit(0).alias(n) for n in names]), add)
    done = base.select("file_id", "__code", "__lang", split.alias("__split")).select("file_id", "__code", F.size("__split").alias("n_lines"), sums.alias("s"))
    per_line = lambda c: F.coalesce(F.try_divide(c, F.col("n_lines")), F.lit(0.0))
    return done.select(
        "file_id", "n_lines", F.col("s.functions").alias("function_count"), F.col("s.classes").alias("class_count"),
        F.when(F.col("s.functions") > 0, F.col("n_lines") / F.col("s.functions")).otherwise(F.col("n_lines")).cast("double").alias("avg_function_len"),
        F.col("s.nesting").alias("max_nesting_depth"), F.col("s.strings").alias("string_count"), F.col("s.imports").alias("import_count"),
        per_line(F.col("s.comments")).alias("comment_density"), per_line(F.col("s.bytes")).alias("avg_line_len"), F.col("s.longest").alias("max_line_len"),
        F.col("s.todos").alias("todo_count"), F.col("s.debugs").alias("debug_stmts"),
        F.coalesce(F.try_divide((F.col("s.even") + F.col("s.filled")) * 0.5, F.col("s.filled")), F.lit(1.0)).alias("indentation_score"),
        (F.col("n_lines") - F.col("s.filled")).alias("blank_lines"), F.regexp_count("__code", F.lit(EMPTY_FUNCTION)).alias("empty_functions"),
    )


def anomalies(m: DataFrame) -> DataFrame:
    """(file_id, metric, severity, confidence): one row per bound that a file's measures pass, with a confidence that grows with the excess."""
    n, todo, debug = F.col("n_lines"), F.try_divide("todo_count", "n_lines"), F.try_divide("debug_stmts", "n_lines")
    over = lambda c, bound, most: F.least((F.col(c) - bound) / bound, F.lit(most))
    empty = F.try_divide("empty_functions", "function_count")

    def one(name, hit, severity, confidence):
        return F.when(hit, F.struct(F.lit(name).alias("metric"), F.lit(severity).alias("severity"), F.round(confidence, 6).alias("confidence")))

    # Bounds, severities, and the most that each confidence can be.
    hits = F.array(
        one("line_count", n > 500, "medium", over("n_lines", 500, 0.9)), one("avg_function_len", F.col("avg_function_len") > 50, "medium", over("avg_function_len", 50, 0.85)),
        one("max_nesting_depth", F.col("max_nesting_depth") > 5, "high", over("max_nesting_depth", 5, 0.95)), one("max_line_len", F.col("max_line_len") > 200, "low", over("max_line_len", 200, 0.7)),
        one("indentation_score", (F.col("indentation_score") < 0.5) & (n > 20), "low", 1 - F.col("indentation_score")),
        one("todo_density", (todo > 0.05) & (F.col("todo_count") > 3), "info", F.least(todo * 5, F.lit(0.8))),
        one("debug_density", (debug > 0.03) & (F.col("debug_stmts") > 5), "low", F.least(debug * 10, F.lit(0.85))),
        one("function_density", (n > 50) & (F.col("function_count") / n > 0.15), "low", F.lit(0.65)),
        one("empty_function_ratio", (F.col("function_count") > 5) & (empty > 0.3), "low", empty),
    )
    return m.select("file_id", F.inline(F.array_compact(hits)))


# Marks of machine-written code, in order; name, severity, confidence and pattern.
MACHINE_MARKS = [
    ("Generated Code Header", "medium", 0.8, r"(?i)# generated by|# auto-generated|# code generated"), ("Generic Function Names", "low", 0.6, r"(?i)def\s+(helper|util|tool|utility)\d*\s*\("),
    ("Generic Class Names", "low", 0.6, r"(?i)class\s+\w*(Helper|Utility|Tool|Manager)\w*\s*[:(]"), ("AI TODO Pattern", "low", 0.7, r"\bTODO:?\s*implement\s+"),
    ("Generic Import", "low", 0.65, r"(?i)import\s+(utils|helpers|tools|ai|config)\b"), ("Deeply Nested Blocks", "medium", 0.75, r"(?i)(?:deeply\s+)?nested\s+(if|try)\s+blocks"),
    ("AI Try-Except Pattern", "medium", 0.7, r"(?i)def\s+handle_\w+\s*\(.*?\)\s*:\s*\n\s*try:"), ("AI Todo Bracket Style", "low", 0.6, r"\[\s*(?:TODO|FIXME|HACK)\s*\]"),
    ("ASCII Table Pattern", "low", 0.5, r"\|\s*\w+\s*\|\s*\w+\s*\|"), ("Placeholder Pass", "low", 0.6, r"(?i)pass\s*#\s*(?:not\s+used|yet|placeholder)"),
    ("AI Section Headers", "low", 0.55, r"(?i)# === .*? ==="), ("AI Warning Comment", "low", 0.5, r"(?i)(?:extreme|excessive|unnecessary)\s+(?:use|complexity)"),
    ("Ellipsis Pattern", "low", 0.5, r"\.{3,}\s*(?:#|\z)"), ("Standard Boilerplate", "info", 0.3, r"(?i)if\s+__name__\s*==\s*['\"]__main__['\"]"),
]


def machine_marks(files: DataFrame, file_id: str, code: str) -> DataFrame:
    """(file_id, line, metric, name, severity, confidence): marks of machine-written code, the first mark in the list on each line.

    Every match in the text counts, at the line it begins on, found from the text between the matches. Null and empty texts have none.
    """
    base = files.where(F.col(code).isNotNull()).select(F.col(file_id).alias("file_id"), F.col(code).alias("__code"))
    found = []
    for k, (name, severity, confidence, p) in enumerate(MACHINE_MARKS):
        at = F.when(F.col("__code").rlike(p), tx.match_lines(F.col("__code"), p))
        found.append(F.transform(at, lambda x: F.struct(x.alias("line"), F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"))))  # noqa: B023
    none = F.array().cast("array<struct<line:int,k:int,name:string,severity:string,confidence:double>>")
    every = F.array_sort(F.flatten(F.array(*[F.coalesce(x, none) for x in found])))
    first = F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["line"] != x["line"]))
    return base.select("file_id", F.inline(first)).select("file_id", "line", F.lit("pattern_match").alias("metric"), "name", "severity", "confidence")


def anomaly_score(found: DataFrame) -> DataFrame:
    """Mean of weight times confidence over all anomalies and marks of a file, at most 1; files without any have no row."""
    weight = F.when(F.col("severity") == "high", 1.0).when(F.col("severity") == "medium", 0.7).when(F.col("severity") == "low", 0.4).otherwise(0.2)
    return found.groupBy("file_id").agg(F.least(F.lit(1.0), F.round(F.avg(weight * F.col("confidence")), 6)).alias("score"))


def taint_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the data flow per file: names flow into assignments and calls, and arguments into the parameters
    of the function of that name in the file. What a sanitizer's call returns is clean."""
    flows = facts.where("kind in ('assignment', 'augmented') and not clean").select("file_id", F.explode("uses").alias("w"), F.concat(F.lit("v:"), "name").alias("dst"), "line")
    passed = facts.where("kind = 'call'").select("file_id", "name", F.inline("passed"), "line")
    flows = flows.unionByName(passed.select("file_id", F.explode("uses").alias("w"), F.concat(F.lit("c:"), "name").alias("dst"), "line"))
    given = passed.withColumn("f", F.element_at(F.split("name", r"\."), -1)).drop("name")
    params = F.concat(
        F.transform("args", lambda p, k: F.struct(k.cast("string").alias("param"), p.alias("p"))),
        F.transform(F.concat("args", "uses"), lambda p: F.struct(p.alias("param"), p.alias("p"))),
    )
    taken = facts.where("kind = 'function'").select("file_id", F.col("name").alias("f"), F.inline(params))
    inward = given.join(taken, ["file_id", "f", "param"]).select("file_id", F.explode("uses").alias("w"), F.concat(F.lit("v:"), "p").alias("dst"), "line")
    edges = checkpoint(flows.unionByName(inward).select("file_id", F.concat(F.lit("v:"), "w").alias("src"), "dst", "line").distinct())
    nodes = edges.select("file_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes, edges


def reachable(seeds: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, most: int = 50) -> DataFrame:
    """(file_id, node) reachable from the seeds along the edges, without entering blocked nodes.

    Semi-naive iteration: only new nodes go on; each round is written to the shared folder. Cycles end by themselves.
    """
    open_edges = edges.select("file_id", "src", "dst").distinct()
    if blocked is not None:
        open_edges = open_edges.join(blocked.select("file_id", F.col("node").alias("dst")), ["file_id", "dst"], "left_anti").select("file_id", "src", "dst")
    open_edges = checkpoint(open_edges)
    seen = front = checkpoint(seeds.select("file_id", "node").distinct())
    for _ in range(most):
        step = front.withColumnRenamed("node", "src").join(open_edges, ["file_id", "src"]).select("file_id", F.col("dst").alias("node")).distinct()
        front = checkpoint(step.join(seen, ["file_id", "node"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpoint(seen.union(front))
    raise RuntimeError(f"reachability not settled after {most} rounds")


def tainted_sinks(facts: DataFrame) -> DataFrame:
    """(file_id, sink): calls that data from a source reaches without passing a sanitizer."""
    nodes, edges = taint_graph(facts)
    named = lambda words: F.regexp_extract("node", r"^[vc]:(.*)$", 1).rlike("(?i)\\b(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")\b")
    seen = reachable(nodes.where(named(SOURCES)), edges, nodes.where(named(SANITIZERS)))
    return seen.where(F.col("node").startswith("c:") & named(SINKS)).select("file_id", F.substring("node", 3, 1 << 20).alias("sink"))
