"""Taint rules: what data from outside must not reach, and what makes it clean, over the data flow of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.operators.code import reachable, taint_graph

# Sources of data from outside; rule ids, severities, names, sinks by the end of a callee's name, and sanitizers.
SOURCES = ["input", "request", "req", "sys.argv", "os.environ", "environ", "getenv", "recv", "read_line", "stdin", "params", "query_string", "form", "cookies", "headers", "body", "payload", "user_input"]
RULES = [
    ("TAINT-SQL001", "critical", "SQL Injection", ["execute", "executemany", "executescript", "raw", "query", "from_statement", "prepare"], ["escape_string", "quote_identifier", "mogrify"]),
    ("TAINT-XSS001", "high", "Cross-Site Scripting", ["innerHTML", "outerHTML", "insertAdjacentHTML", "document.write", "mark_safe", "Markup", "HttpResponse"], ["escape", "bleach.clean", "escapeHtml", "encode_html"]),
    ("TAINT-CMD001", "critical", "OS Command Injection", ["os.system", "popen", "subprocess.run", "subprocess.call", "Popen", "check_output", "execSync", "spawn"], ["shlex.quote", "quote", "escapeshellarg"]),
    ("TAINT-PATH001", "high", "Path Traversal", ["open", "send_file", "readFile", "FileResponse", "extractall", "unlink", "rmtree"], ["secure_filename", "basename", "realpath", "normpath"]),
    ("TAINT-NOSQL001", "critical", "NoSQL Injection", ["find", "find_one", "aggregate", "update_one", "delete_one", "where"], ["sanitize", "validate"]),
    ("TAINT-SSRF001", "high", "Server-Side Request Forgery", ["requests.get", "requests.post", "requests.put", "requests.request", "urlopen", "httpx.get", "fetch"], ["validate_url", "is_internal", "allowlist"]),
    ("TAINT-XXE001", "critical", "XML External Entity", ["etree.parse", "etree.fromstring", "minidom.parse", "parseString", "sax.parse"], ["defusedxml"]),
    ("TAINT-SSTI001", "critical", "Template Injection", ["render_template_string", "Template", "from_string", "TextTemplate"], ["auto_escape"]),
    ("TAINT-DES001", "critical", "Unsafe Deserialization", ["pickle.load", "pickle.loads", "marshal.loads", "dill.loads", "unserialize", "readObject"], ["safe_load", "JSONDecoder"]),
    ("TAINT-RE001", "medium", "Regular Expression Denial of Service", ["re.compile", "re.match", "re.search", "re.findall", "RegExp"], ["re.escape", "timeout"]),
    ("TAINT-LDAP001", "high", "LDAP Injection", ["search_s", "search_ext", "ldap.initialize"], ["escape_filter_chars"]),
    ("TAINT-FORMAT001", "high", "Format String Injection", ["printf", "sprintf", "format_map"], []),
    ("TAINT-MASS001", "high", "Mass Assignment", ["objects.create", "update_attributes", "bulk_create", "from_dict"], ["permit", "only"]),
    ("TAINT-REFLECT001", "medium", "Unsafe Reflection", ["getattr", "setattr", "delattr", "import_module", "__import__", "constantize"], []),
    ("TAINT-TYPE001", "medium", "Loose Comparison", ["in_array", "strcmp"], []),
    ("TAINT-LOG001", "medium", "Log Injection", ["logging.info", "logging.error", "logging.warning", "logging.debug", "logger.info", "logger.error", "log.info"], ["strip", "sanitize"]),
    ("TAINT-YAML001", "critical", "YAML Load", ["yaml.load", "yaml.unsafe_load", "yaml.load_all"], ["SafeLoader", "safe_load"]),
    ("TAINT-PP001", "high", "Prototype Pollution", ["Object.assign", "merge", "defaultsDeep"], []),
    ("TAINT-JWT001", "high", "JWT Misuse", ["jwt.decode", "jwt.encode", "jwt.verify"], []),
    ("TAINT-OPENREDIRECT001", "medium", "Open Redirect", ["redirect", "HttpResponseRedirect", "RedirectResponse"], ["url_has_allowed_host_and_scheme", "is_safe_url"]),
    ("TAINT-COOKIE001", "medium", "Insecure Cookie", ["set_cookie", "setcookie", "res.cookie"], []),
    ("TAINT-AUTHZ001", "high", "Insecure Direct Object Reference", ["objects.get", "query.get", "findById", "get_object_or_404"], ["check_permission", "authorize"]),
    ("TAINT-CODE001", "critical", "Code Injection", ["eval", "exec", "compile", "Function"], ["literal_eval"]),
    ("TAINT-XPATH001", "high", "XPath Injection", ["xpath", "iterparse", "evaluate"], []),
    ("TAINT-HEADER001", "medium", "Header Injection", ["setHeader", "add_header", "Header.Set"], []),
    ("TAINT-REDIRECT001", "medium", "Address Joined without Validation", ["urljoin"], []),
]


def _ends(words) -> str:
    """A pattern of callees whose dotted name ends in one of the words."""
    return r"(?:^|\.)(?:" + "|".join(w.replace(".", r"\.") for w in words) + r")$"


def taint_findings(facts: DataFrame, rules=RULES, sources=SOURCES) -> DataFrame:
    """(file_id, rule_id, severity, problem, sink): each rule with each of its sinks that data from a source reaches.

    Sanitizers of all rules stop the flow, as rules are pooled. Flows pass through assignments and into functions of the
    same file. Facts without a source give no rows.
    """
    nodes, edges = taint_graph(facts)
    name = F.regexp_extract("node", r"^[vc]:(.*)$", 1)
    cleaners = sorted({w for *_, words in rules for w in words})
    seeds = nodes.where(name.rlike(r"(?:^|\.)(?:" + "|".join(w.replace(".", r"\.") for w in sources) + r")(?:\.|$)"))
    seen = reachable(seeds, edges, nodes.where(F.col("node").startswith("c:") & name.rlike(_ends(cleaners))))
    hits = F.array_compact(F.array(*[F.when(F.col("sink").rlike(_ends(sinks)), F.struct(F.lit(i).alias("rule_id"), F.lit(s).alias("severity"), F.lit(n).alias("problem"))) for i, s, n, sinks, _ in rules]))
    sinks = seen.where(F.col("node").startswith("c:")).select("file_id", F.substring("node", 3, 1 << 20).alias("sink"))
    return sinks.select("file_id", "sink", F.inline(hits)).select("file_id", "rule_id", "severity", "problem", "sink")
