"""Rule packs as data. Patterns avoid look-around, so that Java and RE2 read them alike.

Fixed values: rule ids, names, severities, CWEs and what each pattern looks for. Rules are
keyed by pack and id, since ids recur between packs.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from siftlake.operators.packs_general import BUSINESS, CONTAINERS, MODELS, TOOLS, WHOLE_TEXT
from siftlake.operators.packs_languages import SEVERITIES, TABLES
from siftlake.operators.scan import Rule

PY, ANY = ("python",), ()

_SECURITY = [
    ("SEC-001", "critical", r"\bos\.(?:system|popen)\s*\(|\bsubprocess\.(?:call|run|Popen|check_output)\s*\([^)]*shell\s*=\s*True", "Command Injection", "CWE-78", PY),
    ("SEC-002", "critical", r"\.(?:execute|executemany)\s*\(\s*(?:f[\"']|[^)]*[\"']\s*(?:\+|%)|[^)]*\.format\s*\()", "SQL Injection", "CWE-89", PY),
    ("SEC-003", "critical", r"\b(?:eval|exec)\s*\(", "Eval/Exec Usage", "CWE-95", PY),
    ("SEC-004", "critical", r"\b(?:pickle|cPickle|marshal|shelve)\.loads?\s*\(", "Deserialization RCE", "CWE-502", PY),
    ("SEC-005", "critical", r"\bopen\s*\([^)]*(?:request\.|input\s*\(|\+)", "Path Traversal", "CWE-22", PY),
    ("SEC-010", "high", r"(?i)\b(?:api_?key|secret|token|passw(?:or)?d)\s*[=:]\s*[\"'][A-Za-z0-9_\-]{20,}[\"']", "Hardcoded Secrets", "CWE-798", ANY),
    ("SEC-011", "high", r"\bhashlib\.(?:md5|sha1)\s*\(|\b(?:DES|ARC4|Blowfish)\.new\s*\(", "Weak Cryptography", "CWE-327", PY),
    ("SEC-012", "high", r"PROTOCOL_(?:SSLv2|SSLv3|TLSv1)\b|_create_unverified_context", "Insecure SSL/TLS", "CWE-295", PY),
    ("SEC-013", "high", r"\b(?:etree|minidom|sax)\.(?:parse|parseString|fromstring)\s*\(", "XML External Entity", "CWE-611", PY),
    ("SEC-014", "high", r"\byaml\.(?:load|unsafe_load)\s*\([^)]*\)", "YAML Unsafe Load", "CWE-502", PY),
    ("SEC-015", "high", r"^\s*assert\s+.*(?:admin|permission|authori[sz]ed|authenticated)", "Assert in Production", "CWE-573", PY),
    ("SEC-016", "high", r"\bDEBUG\s*=\s*True\b|\bdebug\s*=\s*True\b", "Debug Mode Enabled", "CWE-11", ANY),
    ("SEC-017", "high", r"Access-Control-Allow-Origin[\"']?\s*[:,]\s*[\"']\*", "CORS Wildcard", "CWE-942", ANY),
    ("SEC-018", "high", r"(?i)\balg(?:orithms?)?[\"']?\s*[=:]\s*\[?\s*[\"']none[\"']", "JWT None Algorithm", "CWE-347", ANY),
    ("SEC-019", "high", r"\brandom\.(?:random|randint|choice|sample)\s*\(", "Weak Random", "CWE-338", PY),
    ("SEC-020", "medium", r"\.search(?:_s)?\s*\([^)]*\+", "LDAP Injection", "CWE-90", PY),
    ("SEC-021", "medium", r"\b(?:mark_safe|Markup)\s*\(|\|\s*safe\b", "Cross-Site Scripting", "CWE-79", ANY),
    ("SEC-022", "medium", r"\brequests\.(?:get|post|put|delete|request)\s*\([^)]*(?:request\.|input\s*\()", "SSRF", "CWE-918", PY),
    ("SEC-023", "medium", r"\bredirect\s*\([^)]*request\.", "Open Redirect", "CWE-601", PY),
    ("SEC-026", "medium", r"\btempfile\.mktemp\s*\(|[\"']/tmp/", "Insecure Temporary File", "CWE-377", ANY),
    ("SEC-027", "medium", r"\bjwt\.decode\s*\([^)]*verify\s*=\s*False", "JWT Verification Disabled", "CWE-347", PY),
    ("SEC-028", "medium", r"(?i)httponly\s*[=:]\s*false", "Cookie Missing HttpOnly", "CWE-1004", ANY),
    ("SEC-029", "medium", r"(?i)\bset_cookie\s*\([^)]*secure\s*=\s*false", "Cookie Missing Secure Flag", "CWE-614", ANY),
    ("SEC-040", "low", r"(?i)(?:#|//).*\b(?:password|passwd|pwd|secret|token|key|pass)\s*[=:]\s*\S", "Sensitive Information in Comments", "CWE-312", ANY),
    ("SEC-041", "low", r"\btraceback\.(?:print_exc|format_exc)\s*\(|\.printStackTrace\s*\(", "Information Disclosure in Errors", "CWE-209", ANY),
    ("SEC-042", "low", r"(?i)\blog(?:ger|ging)?\.(?:debug|info|warn(?:ing)?|error)\s*\([^)]*(?:password|secret|token)", "Sensitive Data in Logs", "CWE-532", ANY),
    ("SEC-046", "medium", r"\bverify\s*=\s*False\b|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true", "Security Feature Disabled", "CWE-295", ANY),
    ("SEC-048", "low", r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b", "Card-like Number", "CWE-359", ANY),
    ("SEC-049", "low", r"\blen\s*\([^)]*\)\s*[<>]=?\s*[34]\b", "Weak Password Policy", "CWE-521", PY),
    ("SEC-050", "info", r"\bssl\.wrap_socket\s*\(|\bcrypt\.crypt\s*\(", "Deprecated Security Function", "CWE-327", PY),
    ("SEC-055", "info", r"\bcheck_hostname\s*=\s*False\b|\bCERT_NONE\b", "Improper Certificate Validation", "CWE-295", ANY),
    ("SEC-056", "info", r"(?i)\b(?:password|secret|token|key)\s*=\s*[\"'][^\"']+[\"']", "Missing Encryption for Sensitive Data", "CWE-311", ANY),
    ("SEC-058", "medium", r"169\.254\.169\.254|metadata\.google\.internal", "SSRF to Cloud Metadata", "CWE-918", ANY),
    ("SEC-059", "info", r"(?i)\b(?:price|amount|total|cost)\s*=\s*float\s*\(", "Float for Money", "CWE-841", PY),
]

_ENTERPRISE = [
    ("GDPR-001", "critical", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "Hardcoded E-mail Address", ""),
    ("GDPR-001-SSN", "critical", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "Hardcoded Social Security Number", ""),
    ("PCI-002", "critical", r"\b4[0-9]{12}(?:[0-9]{3})?\b", "Hardcoded Card Number", ""),
    ("PCI-003", "critical", r"(?i)\b(?:cvv|cvc2?|cid|card_verification)\s*=", "Prohibited Payment Data", ""),
    ("AUDIT-002", "medium", r"(?i)\blog\.(?:info|warn|error|debug)\s*\(", "Audit Log without Timestamp or User", ""),
    ("DLP-001", "critical", r"(?i)\b(?:fetch|axios|requests?|http)\.?(?:get|post)?\s*\([^)]*(?:password|secret|token|ssn)", "Sensitive Data Sent Out", ""),
    ("DLP-003", "critical", r"(?i)aws_(?:access_key_id|secret_access_key)\s*[=:]", "Cloud Credentials", ""),
    ("DLP-005", "critical", r"-----BEGIN\s+(?:[A-Z]+\s+)?PRIVATE\s+KEY", "Private Key in Repository", ""),
    ("SSO-001", "medium", r"(?i)\b(?:client_id|client_secret|issuer_url)\s*[=:]\s*[\"'][^\"']+[\"']", "SSO Settings in Code", ""),
    ("SSO-005", "high", r"(?i)\bjwt\.(?:sign|encode)\s*\([^)]*\)", "Token without Expiration", ""),
    ("RATE-001", "high", r"(?i)\bapp\.(?:get|post|put|patch|delete)\s*\(", "Endpoint without Rate Limit", ""),
    ("SAAS-001", "critical", r"(?i)\bSELECT\b[^;]*\bFROM\b", "Query without Tenant Filter", ""),
    ("SAAS-003", "high", r"(?i)\bcache\.(?:get|set|delete)\s*\(", "Cache Key without Tenant", ""),
    ("GITLEAKS-001", "critical", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bxox[abprs]-[A-Za-z0-9-]{10,}", "Issued Token", ""),
    ("GHACTION-001", "high", r"(?i)\b(?:echo|print)\b.*\$\{\{\s*secrets\.", "Secret in Workflow Log", ""),
    ("IPV4-001", "low", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "Hardcoded Address", ""),
]

_INFRASTRUCTURE = [
    ("SEC-IAC-TF-001", "critical", r"^\s*acl\s*=\s*\"public"), ("SEC-IAC-TF-003", "medium", r"^\s*versioning\s*=\s*false"),
    ("SEC-IAC-TF-007", "critical", r"^\s*secret_key\s*=\s*\"[^\"]{20,}"), ("SEC-IAC-TF-012", "medium", r"^\s*attach_customer_managed_policy\s*=\s*false"),
    ("SEC-IAC-TF-020", "medium", r"^\s*associate_public_ip_address\s*=\s*true"), ("SEC-IAC-TF-021", "medium", r"^\s*source_dest_check\s*=\s*false"),
    ("SEC-IAC-TF-030", "critical", r"^\s*publicly_accessible\s*=\s*true"), ("SEC-IAC-TF-031", "high", r"^\s*storage_encrypted\s*=\s*false"),
    ("SEC-IAC-TF-032", "low", r"^\s*enabled_cloudwatch_logs_exports\s*=\s*\[\s*\]"), ("SEC-IAC-TF-033", "low", r"^\s*multi_az\s*=\s*false"),
    ("SEC-IAC-TF-041", "medium", r"^\s*runtime\s*=\s*\"python2"), ("SEC-IAC-TF-050", "high", r"^\s*cidr_blocks\s*=\s*\[\"0\.0\.0\.0/0\"\]"),
    ("SEC-IAC-TF-052", "high", r"^\s*from_port\s*=\s*3389"), ("SEC-IAC-TF-060", "medium", r"^\s*node_to_node_encryption\s*=\s*false"),
    ("SEC-IAC-TF-061", "high", r"^\s*encrypt_at_rest\s*=\s*false"), ("SEC-IAC-TF-070", "medium", r"^\s*enable_logging\s*=\s*false"),
    ("SEC-IAC-TF-071", "low", r"^\s*is_multi_region_trail\s*=\s*false"), ("SEC-IAC-TF-072", "low", r"^\s*include_global_service_events\s*=\s*false"),
    ("SEC-IAC-K8S-001", "critical", r"^\s*privileged\s*:\s*true"), ("SEC-IAC-K8S-002", "high", r"^\s*allowPrivilegeEscalation\s*:\s*true"),
    ("SEC-IAC-K8S-003", "high", r"^\s*runAsUser\s*:\s*0\b"), ("SEC-IAC-K8S-004", "high", r"^\s*host(?:Network|PID|IPC)\s*:\s*true"),
    ("SEC-IAC-K8S-005", "medium", r"^\s*hostPath\s*:"), ("SEC-IAC-K8S-006", "medium", r"^\s*image\s*:\s*\S+:latest\b"),
    ("SEC-IAC-K8S-007", "medium", r"^\s*readOnlyRootFilesystem\s*:\s*false"), ("SEC-IAC-DOCKER-001", "medium", r"^\s*USER\s+(?:root|0)\b"),
    ("SEC-IAC-DOCKER-002", "medium", r"^\s*FROM\s+\S+:latest\b"), ("SEC-IAC-DOCKER-003", "high", r"(?i)^\s*ENV\s+\S*(?:PASSWORD|SECRET|TOKEN|KEY)\S*[ =]"),
    ("SEC-IAC-DOCKER-004", "low", r"^\s*ADD\s+https?://"), ("SEC-IAC-DOCKER-005", "medium", r"\bcurl\b.*\|\s*(?:ba)?sh\b"),
]

_EXTENDED = [
    ("SEC-073", "high", r"\.(?:get|get_object_or_404|find_by_id)\s*\([^)]*request\.(?:args|GET|params)", "Insecure Direct Object Reference", "CWE-639"),
    ("SEC-074", "high", r"(?i)\buser_id\s*=\s*request\.", "Horizontal Privilege Escalation", "CWE-285"),
    ("SEC-075", "critical", r"(?i)\b(?:is_admin|role)\s*=\s*request\.", "Vertical Privilege Escalation", "CWE-269"),
    ("SEC-076", "critical", r"(?i)\b(?:md5|sha1)\s*\([^)]*passw", "Weak Hash for Passwords", "CWE-327"),
    ("SEC-077", "high", r"\bMODE_ECB\b|/ECB/|-ecb\b", "ECB Mode", "CWE-327"),
    ("SEC-078", "critical", r"(?i)\b(?:aes|encryption|crypto|cipher)_?key\s*=\s*b?[\"'][^\"']{8,}[\"']", "Hardcoded Cryptographic Key", "CWE-321"),
    ("SEC-079", "critical", r"(?i)ldap\w*\.search\w*\s*\(.*(?:%|\+|format)", "LDAP Injection", "CWE-90"),
    ("SEC-080", "high", r"\.xpath\s*\([^)]*(?:\+|%|format)", "XPath Injection", "CWE-643"),
    ("SEC-081", "critical", r"\brender_template_string\s*\(|\bTemplate\s*\([^)]*(?:request|\+)", "Template Injection", "CWE-1336"),
    ("SEC-082", "critical", r"\b(?:commands\.getoutput|os\.exec[lv]\w*|os\.spawn\w*|pty\.spawn)\s*\(", "Extended Command Injection", "CWE-78"),
    ("SEC-083", "high", r"(?i)\bapp\.run\s*\([^)]*debug\s*=\s*true|\bFLASK_DEBUG\s*=\s*1", "Debug in Production", "CWE-489"),
    ("SEC-084", "medium", r"(?i)\bCORS\s*\([^)]*\*|allow_origins\s*=\s*\[\s*[\"']\*", "Dangerous CORS", "CWE-942"),
    ("SEC-085", "medium", r"(?i)\bmin_?length\s*[=:]\s*[1-7]\b", "Weak Password Policy", "CWE-521"),
    ("SEC-087", "critical", r"\b(?:pickle|dill|joblib|jsonpickle)\.(?:load|loads|decode|Unpickler)\s*\(", "Insecure Deserialization", "CWE-502"),
    ("SEC-088", "high", r"[\"']http://[^\"'\s]*(?:login|auth|token|password|api)", "HTTP for Sensitive Data", "CWE-319"),
    ("SEC-089", "medium", r"(?i)\b(?:log\w*|print)\b.*\b(?:password|api_key|credit_card|ssn)\b", "Sensitive Information in Logs", "CWE-532"),
    ("SEC-090", "critical", r"\b(?:urlopen|requests\.\w+|httpx\.\w+)\s*\(\s*(?:url|user_url|target|request\.)", "Server-Side Request Forgery", "CWE-918"),
    ("SEC-091", "critical", r"resolve_entities\s*=\s*True|\bXMLParser\s*\(\s*\)|<!ENTITY", "XML External Entity", "CWE-611"),
    ("SEC-092", "critical", r"\b(?:send_file|sendFile|open|readFile)\s*\([^)]*(?:request\.|req\.|params\[)", "Extended Path Traversal", "CWE-22"),
    ("SEC-093", "medium", r"\*\*request\.|\.create\s*\(\s*req\.body\s*\)|fields\s*=\s*[\"']__all__", "Mass Assignment", "CWE-915"),
    ("SEC-094", "medium", r"(?i)\bsession_id\s*=\s*request\.", "Session Fixation", "CWE-384"),
    ("SEC-096", "high", r"\.extractall\s*\(", "Zip Slip", "CWE-22"),
    ("SEC-097", "high", r"\([^()]*[+*]\)[+*]", "Regex Denial of Service", "CWE-1333"),
    ("SEC-098", "high", r"\brandom\.(?:getrandbits|choices|shuffle|uniform)\s*\(", "Insecure Random", "CWE-338"),
    ("SEC-099", "critical", r"\b(?:eval|exec)\s*\([^)]*(?:request|input\s*\(|argv)", "Eval with User Input", "CWE-95"),
    ("SEC-100", "medium", r"\bos\.path\.(?:exists|isfile)\s*\([^)]*\)\s*(?::|and)", "Time of Check, Time of Use", "CWE-367"),
    ("SEC-102", "high", r"\buuid\.uuid1\s*\(|\bstr\s*\(\s*time\.time\s*\(", "Predictable Tokens", "CWE-341"),
    ("SEC-103", "critical", r"(?i)ssl_?verify\w*\s*[=:]\s*(?:false|0)|NODE_TLS_REJECT_UNAUTHORIZED", "Improper Certificate Validation", "CWE-295"),
    ("SEC-104", "high", r"\.save\s*\([^)]*\.filename", "Unrestricted Upload", "CWE-434"),
    ("SEC-106", "critical", r"\b(?:location\.(?:hash|search)|document\.URL)\b.*(?:innerHTML|write)", "DOM-based XSS", "CWE-79"),
    ("SEC-109", "medium", r"\bchmod\s*\([^)]*0?o?777|\bos\.umask\s*\(\s*0\s*\)", "Insecure Permissions", "CWE-276"),
    ("SEC-110", "critical", r"(?i)\bjwt\.decode\s*\([^)]*(?:verify_signature[\"']?\s*:\s*False|algorithms\s*=\s*None)", "Insecure JWT Verification", "CWE-347"),
    ("SEC-113", "critical", r"[\"']\$(?:where|ne|gt|regex)[\"']", "NoSQL Injection", "CWE-943"),
    ("SEC-114", "critical", r"(?i)algorithms\s*[=:]\s*\[[^\]]*HS256[^\]]*RS256|algorithms\s*[=:]\s*\[[^\]]*RS256[^\]]*HS256", "JWT Algorithm Confusion", "CWE-347"),
    ("SEC-116", "critical", r"\b(?:__import__|importlib\.import_module)\s*\(\s*(?:request|input|name|module)", "Dynamic Import", "CWE-94"),
    ("SEC-117", "high", r"[\"'](?:file|gopher|dict|ldap)://", "Dangerous URL Protocols", "CWE-918"),
    ("SEC-118", "high", r"(?i)\b(?:sqlmap|metasploit|msfvenom|mimikatz)\b", "Attack Tool", "CWE-506"),
    ("SEC-119", "high", r"\b/dev/tcp/|\bnc\s+-e\b|bash\s+-i\b", "Reverse Shell", "CWE-506"),
    ("QUAL-001", "low", r"(?i)\b(?:TODO|FIXME|HACK|XXX)\b", "Open Mark", ""),
    ("QUAL-002", "low", r"^\s*except\s*:\s*$", "Bare Except", ""),
    ("QUAL-003", "low", r"^.{200,}$", "Long Line", ""),
    ("QUAL-004", "low", r"^\s*except\b.*:\s*pass\s*$", "Swallowed Exception", ""),
    ("DEPCONF-001", "high", r"--extra-index-url\b|\bregistry\s*=\s*http://", "Dependency Confusion", "CWE-427"),
]

_RULES: list[Rule] = (
    [Rule("security", i, s, p, n, languages=langs, cwe=c) for i, s, p, n, c, langs in _SECURITY]
    + [Rule(lang, i, SEVERITIES[s], p, n, languages=(lang,), cwe=f"CWE-{c}" if c else "") for lang, rows in TABLES.items() for i, s, c, p, n in rows]
    + [Rule("extended", i, s, p, n, cwe=c) for i, s, p, n, c in _EXTENDED]
    + [Rule("enterprise", i, s, p, n, cwe=c) for i, s, p, n, c in _ENTERPRISE]
    + [Rule("infrastructure", i, s, p) for i, s, p in _INFRASTRUCTURE]
    + [Rule("whole", i, SEVERITIES[s], p, n, mode, guard=g, cwe=f"CWE-{c}" if c else "") for i, s, c, mode, p, g, n in WHOLE_TEXT]
    + [Rule("tools", i, SEVERITIES[s], p, n, cwe=f"CWE-{c}") for i, s, c, p, n in TOOLS]
    + [Rule("enterprise", i, SEVERITIES[s], p, n, mode, guard=g) for i, s, mode, p, g, n in BUSINESS]
    + [Rule("containers", i, SEVERITIES[s], p, n, cwe=f"CWE-{c}") for i, s, c, p, n in CONTAINERS]
    + [Rule("ai", i, SEVERITIES[s], p, n, mode, guard=g, confidence=c) for i, s, c, mode, p, g, n in MODELS]
)

#: Which packs an entry point evaluates.
PROFILES = {
    "cli": {"security", "extended", "whole", "tools", "javascript", "typescript", "go", "java", "rust", "php", "ruby", "csharp", "enterprise"},
    "lib": {"security", "extended", "whole", "tools"}, "lsp": {"security", "extended", "whole", "tools"}, "all": {r.pack for r in _RULES},
}


def rules_of(profile: str = "all", ids: set[str] | None = None, at_least: str | None = None) -> list[Rule]:
    """The rules of a profile, pruned by id and by their fixed severity before any text is read."""
    from siftlake.functions.severity import RANKS

    ranks = RANKS["threshold"][0]
    return [r for r in RULES if r.pack in PROFILES[profile] and (not ids or r.rule_id in ids) and (not at_least or ranks[r.severity] >= ranks[at_least])]


# The category of the ten most critical risks that each weakness falls under.
RISKS = {
    "A01:2021": [22, 59, 200, 276, 284, 285, 352, 377, 425, 601, 639, 668, 706, 732, 862, 863, 922], "A02:2021": [259, 295, 311, 319, 321, 326, 327, 328, 329, 330, 331, 338, 340, 347, 780, 916],
    "A03:2021": [20, 74, 77, 78, 79, 80, 88, 89, 90, 91, 93, 94, 95, 97, 98, 113, 116, 134, 643, 917, 943, 1336], "A04:2021": [209, 256, 257, 266, 269, 307, 434, 501, 522, 579, 598, 602, 641, 770, 841],
    "A05:2021": [2, 11, 16, 260, 315, 489, 526, 537, 541, 547, 611, 614, 693, 756, 776, 942, 1004, 1032, 1021], "A06:2021": [937, 1035, 1104], "A07:2021": [255, 287, 290, 294, 297, 300, 302, 304, 306, 346, 384, 521, 613, 620, 640, 798, 940],
    "A08:2021": [345, 353, 426, 427, 494, 502, 565, 784, 829, 830, 915], "A09:2021": [117, 223, 532, 778], "A10:2021": [918],
}


def risk_of(cwe: str | None) -> str | None:
    """Risk category of a weakness such as CWE-89; None for others."""
    number = int(cwe[4:]) if cwe and cwe.startswith("CWE-") and cwe[4:].isdigit() else None
    return next((risk for risk, members in RISKS.items() if number in members), None)


def listing(spark: SparkSession, profile: str = "all") -> DataFrame:
    """The rules of a profile as a table: pack, rule_id, severity, name, mode, languages, cwe_id, owasp_id, confidence, pattern."""
    rows = [(r.pack, r.rule_id, r.severity, r.name, r.mode, ",".join(r.languages), r.cwe or None, risk_of(r.cwe), r.confidence, r.pattern) for r in rules_of(profile)]
    return spark.createDataFrame(rows, "pack string, rule_id string, severity string, name string, mode string, languages string, cwe_id string, owasp_id string, confidence double, pattern string")


RULES = [replace(r, owasp=r.owasp or risk_of(r.cwe) or "") for r in _RULES]
