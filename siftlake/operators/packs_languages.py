"""Rule packs of single languages as data, one table each. Patterns avoid look-around, so that every engine reads them alike.

Fixed values: rule ids, severities (c, h, m, l, i for critical to info), CWE numbers, names, and what each pattern looks for.
"""

from __future__ import annotations

_SECRET = r"""(?i)\b\w*(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key)\w*["']?\s*(?::|:?=|=>)\s*["'][^"'\s]{6,}["']"""
_METADATA = r"169\.254\.169\.254|metadata\.google\.internal|100\.100\.100\.200"
_REDOS = r"\([^()]*[+*][^()]*\)[+*{]"
_MARK = r"(?i)\bgenerated by (?:chatgpt|claude|copilot|gemini|an? (?:ai|llm))\b"
_USER_JS = r"(?:\breq(?:uest)?\.(?:query|body|params|headers|url|cookies)|\blocation\.|\bwindow\.name|\bprocess\.argv|\bevent\.data)"
_USER_JAVA = r"(?:\brequest\.get|\breq\.get|getParameter\s*\(|\bparam\b|userInput|@PathVariable|@RequestParam)"
_USER_PHP = r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)"
_USER_RUBY = r"(?:params\[|params\.|request\.|cookies\[)"
_USER_CS = r"(?:Request\.|Query\[|Form\[|\binput\b|\buser\w*)"
_USER_GO = r"(?:\br\.(?:URL|Form|PostForm|Body|Header)|FormValue\s*\(|\bc\.(?:Query|Param|PostForm)|os\.Args)"
_SQL = r"(?i)\b(?:SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\b"

JAVASCRIPT = [
    ("JS-SEC-001", "c", 79, rf"\.(?:innerHTML|outerHTML)\s*\+?=|document\.write(?:ln)?\s*\(|insertAdjacentHTML\s*\(", "DOM Cross-Site Scripting"),
    ("JS-SEC-002", "h", 1321, r"\b__proto__\b|constructor\.prototype\b|\[\s*[\"']__proto__[\"']\s*\]", "Prototype Pollution"),
    ("JS-SEC-003", "c", 95, r"\beval\s*\(|\bnew\s+Function\s*\(", "Eval Injection"),
    ("JS-SEC-004", "h", 22, rf"\b(?:readFile|readFileSync|createReadStream|sendFile|path\.join)\s*\([^)\n]*{_USER_JS}", "Path Traversal"),
    ("JS-SEC-005", "c", 798, _SECRET, "Hardcoded Secrets"),
    ("JS-SEC-006", "h", 338, r"\bMath\.random\s*\(|createHash\s*\(\s*[\"'](?:md5|sha1)[\"']|createCipher\s*\(", "Weak Cryptography"),
    ("JS-SEC-007", "m", 601, rf"\b(?:res\.redirect|location\.(?:href|assign|replace))\s*(?:\(|=)[^\n]*{_USER_JS}", "Open Redirect"),
    ("JS-SEC-008", "h", 918, rf"\b(?:fetch|axios(?:\.\w+)?|got|request|http\.get|https\.get)\s*\([^)\n]*{_USER_JS}", "Server-Side Request Forgery"),
    ("JS-SEC-009", "c", 89, _SQL + r"[^\n]*(?:[\"'`]\s*\+|\$\{)", "SQL Injection by Concatenation"),
    ("JS-SEC-010", "c", 347, r"(?i)\balg(?:orithms?)?[\"']?\s*:\s*\[?\s*[\"']none[\"']", "JWT without Signature"),
    ("JS-SEC-012", "h", 552, r"\bres\.(?:send|json|status\([^)]*\)\.(?:send|json))\s*\([^)\n]*\berr(?:or)?\.(?:stack|message)", "Error Details Exposed"),
    ("JS-SEC-013", "m", 614, r"\.cookie\s*\([^)\n]*(?:httpOnly|secure)\s*:\s*false", "Insecure Cookie"),
    ("JS-SEC-014", "m", 1333, r"/[^/\n]*" + _REDOS, "Regular Expression Denial of Service"),
    ("JS-SEC-015", "m", 942, r"\borigin\s*[=:]\s*[\"']\*[\"']", "Insecure CORS Policy"),
    ("JS-SEC-016", "c", 95, r"\bset(?:Timeout|Interval)\s*\(\s*[\"'`]|\bvm\.runIn(?:This|New)?Context\s*\(", "Code Injection by String"),
    ("JS-SEC-018", "h", 319, r"\bnew\s+WebSocket\s*\(\s*[\"'`]ws://", "Insecure WebSocket"),
    ("JS-SEC-019", "h", 942, r"Access-Control-Allow-Credentials[\"']?\s*[,:]\s*[\"']?true", "CORS with Credentials"),
    ("JS-SEC-020", "h", 79, r"[?&]callback=", "JSONP Callback"),
    ("JS-SEC-021", "m", 1188, r"[\"'`](?:https?://)?(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?[\"'`/]", "Hardcoded Address"),
    ("JS-SEC-022", "h", 346, r"addEventListener\s*\(\s*[\"']message[\"']|\.postMessage\s*\([^)\n]*,\s*[\"']\*[\"']", "Message without Origin Check"),
    ("JS-SEC-023", "m", 922, r"(?i)\b(?:local|session)Storage\.setItem\s*\([^)\n]*(?:token|password|secret|jwt|session)", "Sensitive Data in Browser Storage"),
    ("JS-SEC-037", "h", 918, r"[\"'`]https?://(?:" + _METADATA + r"|127\.0\.0\.1|localhost|0\.0\.0\.0)", "Request to an Internal Address"),
    ("JS-SEC-038", "c", 347, r"\bjwt\.verify\s*\([^)\n]*(?:ignoreExpiration\s*:\s*true|,\s*(?:null|undefined|[\"'][\"'])\s*[,)])", "Insecure JWT Verification"),
    ("JS-SEC-039", "c", 502, rf"\bunserialize\s*\([^)\n]*{_USER_JS}|node-serialize", "Insecure Deserialization"),
    ("JS-SEC-040", "c", 943, r"\.(?:find|findOne|findById|updateOne|updateMany|deleteOne|deleteMany)\s*\(\s*req\.(?:body|query|params)|\$where", "NoSQL Injection"),
    ("JS-SEC-041", "c", 1336, rf"\b(?:pug|ejs|nunjucks|handlebars|Handlebars)\.(?:render|compile|renderString)\s*\([^)\n]*{_USER_JS}", "Template Injection"),
    ("JS-SEC-043", "c", 89, rf"\.(?:query|execute|raw)\s*\([^)\n]*(?:\+\s*\w|\$\{{)", "SQL Injection in a Driver Call"),
    ("JS-SEC-044", "h", 1321, r"\b(?:Object\.assign|_\.merge|_\.defaultsDeep|\$\.extend|deepmerge)\s*\([^)\n]*req\.(?:body|query|params)", "Prototype Pollution by Merge"),
    ("JS-CRYPT-001", "h", 295, r"NODE_TLS_REJECT_UNAUTHORIZED|rejectUnauthorized\s*:\s*false", "Certificate Check Disabled"),
    ("GRAPHQL-001", "m", 200, r"\bintrospection\s*:\s*(?:true|1)\b", "Introspection Enabled"),
    ("GRAPHQL-002", "h", 400, r"\bnew\s+ApolloServer\s*\(", "Query Depth not Limited"),
    ("GRAPHQL-003", "m", 770, r"\bbatch(?:ing)?\s*:\s*(?:true|1)\b", "Batched Queries"),
    ("JS-QUAL-001", "l", 0, r"\bconsole\.(?:log|debug|info)\s*\(", "Console Statement"),
    ("JS-QUAL-002", "l", 0, r"^\s*debugger\s*;?\s*$", "Debugger Statement"),
    ("JS-QUAL-003", "l", 0, r"^\s*var\s+", "Var Declaration"),
    ("JS-AI-001", "i", 0, _MARK, "Mark of a Code Generator"),
]

TYPESCRIPT = [
    ("TS-SEC-001", "l", 0, r":\s*any\b|<any>|\bas\s+any\b", "Type any"), ("TS-SEC-002", "l", 0, r"[\w)\]]!(?:\.|\[|;|\))", "Non-null Assertion"),
    ("TS-SEC-003", "l", 0, r"\bdeclare\s+global\b", "Global Declaration"), ("TS-SEC-004", "l", 704, r"\bas\s+unknown\s+as\b|\bas\s+(?:any|never)\b", "Unsafe Cast"),
    ("TS-SEC-005", "m", 94, r"`[^`\n]*\$\{[^}\n]*(?:req\.|request\.|input|user)", "Template Literal with Input"), ("TS-SEC-006", "c", 95, r"\beval\s*\(|\bnew\s+Function\s*\(", "Eval"),
    ("TS-SEC-007", "c", 798, _SECRET, "Hardcoded Secrets"), ("TS-SEC-008", "h", 79, r"\bdangerouslySetInnerHTML\b", "Raw HTML in React"),
    ("TS-SEC-009", "m", 918, r"\b(?:fetch|axios(?:\.\w+)?)\s*\(\s*(?:`|\w+[,)])", "Request to a Variable Address"), ("TS-SEC-010", "c", 89, r"`\s*" + _SQL.replace("(?i)", "(?i:") + r")[^`\n]*\$\{", "SQL in a Template Literal"),
    ("TS-SEC-016", "h", 22, rf"\b(?:path\.(?:join|resolve)|fs\.\w+)\s*\([^)\n]*{_USER_JS}", "Path Traversal"), ("TS-SEC-017", "c", 89, r"\.(?:raw|query|whereRaw|literal)\s*\([^)\n]*(?:\+|\$\{)", "SQL Injection"),
    ("TS-SEC-018", "c", 78, r"\b(?:exec|execSync|spawn|spawnSync|execFile)\s*\([^)\n]*(?:\+|\$\{|req\.)", "Command Injection"), ("TS-SEC-019", "h", 295, r"rejectUnauthorized\s*:\s*false|[\"'`]http://[^\"'`]*(?:login|auth|api)", "Insecure Transport"),
    ("TS-SEC-021", "m", 1333, r"/[^/\n]*" + _REDOS, "Regular Expression Denial of Service"), ("TS-SEC-022", "h", 79, r"\.(?:innerHTML|outerHTML)\s*=|v-html=|bypassSecurityTrust\w+\s*\(", "Cross-Site Scripting"),
    ("TS-SEC-023", "h", 918, rf"\b(?:fetch|axios(?:\.\w+)?|got|http\.get)\s*\([^)\n]*{_USER_JS}", "Server-Side Request Forgery"), ("TS-SEC-024", "m", 614, r"(?:httpOnly|secure)\s*:\s*false|sameSite\s*:\s*[\"']none[\"']", "Insecure Cookie"),
    ("TS-SEC-025", "m", 235, r"\breq\.query\.\w+\s*\[", "Parameter Pollution"), ("TS-SEC-026", "c", 347, r"(?i)\balgorithms?\s*:\s*\[?\s*[\"']none[\"']", "JWT without Signature"),
    ("TS-SEC-027", "h", 347, r"algorithms\s*:\s*\[[^\]\n]*HS256[^\]\n]*RS256|algorithms\s*:\s*\[[^\]\n]*RS256[^\]\n]*HS256", "JWT Algorithm Confusion"), ("TS-SEC-028", "m", 613, r"\bjwt\.sign\s*\([^,)\n]*,[^,)\n]*\)", "JWT without Expiration"),
    ("TS-SEC-029", "c", 347, r"\bjwt\.decode\s*\(|ignoreExpiration\s*:\s*true", "JWT not Verified"), ("TS-SEC-030", "h", 347, r"header\.kid\b|\bkid\s*[:=]\s*req\.", "JWT Key by Input"),
    ("TS-SEC-031", "c", 943, r"\.(?:find|findOne|updateOne|deleteOne)\s*\(\s*req\.|[\"']?\$(?:ne|gt|lt|in|nin)[\"']?\s*:\s*req\.", "NoSQL Injection"), ("TS-SEC-032", "c", 943, r"\$where\b", "Code in a Query"),
    ("TS-SEC-033", "m", 1333, r"\$regex[\"']?\s*:\s*(?:req\.|\w+\.(?:query|body))", "Pattern by Input"), ("TS-SEC-036", "m", 942, r"\bcors\s*\(\s*\)|origin\s*:\s*(?:[\"']\*[\"']|true)", "CORS Misconfiguration"),
    ("TS-SEC-037", "l", 348, r"\btrust proxy[\"']\s*,\s*(?:false|0)", "Proxy not Trusted"), ("TS-SEC-038", "m", 650, r"\bmethodOverride\s*\(", "Method Override"),
    ("TS-SEC-039", "h", 798, r"\bpostgres(?:ql)?://[^:\s\"'`]+:[^@\s\"'`$]+@", "Database Login in an Address"), ("TS-SEC-040", "c", 89, r"\b(?:pool|client|db)\.query\s*\([^)\n]*(?:\+|\$\{)", "Query without Parameters"),
    ("TS-SEC-041", "m", 319, r"\bssl\s*:\s*false|sslmode=disable", "Database without TLS"), ("TS-SEC-043", "l", 770, r"\bnew\s+Pool\s*\(\s*\)", "Pool without Limits"),
    ("TS-SEC-044", "h", 89, r"(?i)search_path\s*(?:=|to)\s*[^\n]*\$\{", "Schema by Input"), ("TS-SEC-045", "l", 667, r"\bpg_advisory_lock\s*\(", "Advisory Lock"),
    ("TS-SEC-046", "h", 250, r"[\"']?Action[\"']?\s*:\s*\[?\s*[\"']\*[\"']", "Role with all Actions"), ("TS-SEC-047", "h", 526, r"(?i)process\.env\.\w*(?:secret|password|token)\w*\s*=\s*[\"']", "Secret in the Environment"),
    ("TS-SEC-048", "h", 918, _METADATA, "Metadata Address"), ("TS-SEC-049", "h", 732, r"public-read(?:-write)?|publicReadAccess\s*:\s*true", "Public Storage"),
    ("TS-SEC-050", "m", 287, r"\bALLOW_USER_PASSWORD_AUTH\b|generateSecret\s*:\s*false", "User Pool Misconfiguration"), ("TS-SEC-051", "m", 532, r"console\.\w+\s*\(\s*(?:event|JSON\.stringify\(event)", "Event in Logs"),
    ("TS-SEC-052", "h", 732, r"[\"']?(?:Resource|resources)[\"']?\s*:\s*\[?\s*[\"']\*[\"']", "Wildcard Resource"), ("TS-SEC-054", "h", 327, r"create(?:Hash|Hmac)\s*\(\s*[\"'](?:md5|sha1|md4)[\"']|createCipher(?:iv)?\s*\(\s*[\"'](?:des|rc4)", "Weak Cryptography"),
    ("TS-SEC-055", "l", 401, r"\bsetMaxListeners\s*\(\s*0\s*\)", "Listeners without Limit"), ("TS-SEC-056", "h", 1321, r"\b__proto__\b|Object\.assign\s*\([^)\n]*req\.", "Prototype Pollution"),
    ("TS-SEC-057", "m", 400, r"\bglob(?:\.sync)?\s*\([^)\n]*(?:\+|\$\{|req\.)", "Glob by Input"), ("TS-SEC-058", "c", 265, r"\bvm\.(?:runIn\w*|Script)\b|\bvm2\b", "Sandbox Escape"),
    ("TS-SEC-059", "m", 208, r"(?i)\b(?:token|password|secret|hash|signature)\w*\s*===?\s*\w*(?:req|user|input)", "Comparison by Time"), ("TS-SEC-060", "m", 59, r"\bfs\.(?:symlink|readlink)(?:Sync)?\s*\(", "Symbolic Links"),
    ("TS-SEC-063", "h", 78, r"\bshell\s*:\s*true\b", "Child Process by Shell"), ("TS-SEC-064", "m", 789, r"\bnew\s+Buffer\s*\(|Buffer\.allocUnsafe\s*\(", "Unsafe Buffer"),
    ("TS-SEC-065", "h", 295, r"NODE_TLS_REJECT_UNAUTHORIZED|checkServerIdentity\s*:", "Certificate Validation"), ("TS-SEC-067", "m", 1333, rf"\bnew\s+RegExp\s*\([^)\n]*{_USER_JS}", "Pattern Injection"),
    ("TS-SEC-068", "m", 601, rf"\bredirect\s*\([^)\n]*{_USER_JS}", "Redirect without Validation"), ("TS-SEC-070", "l", 1188, r"[\"'`](?:\d{1,3}\.){3}\d{1,3}[\"'`]", "Hardcoded Address"),
    ("TS-QUAL-001", "l", 0, r":\s*any\b", "Explicit Any"), ("TS-QUAL-002", "l", 0, r"@ts-(?:ignore|nocheck)", "Type Check Disabled"),
]

GO = [
    ("GO-SEC-001", "c", 78, r"exec\.Command\s*\(\s*\"[^\"\n]*(?:sh|bash|cmd)[^\"\n]*\"\s*,\s*\"[-/]c\"", "Command Injection"), ("GO-SEC-002", "c", 89, r"\.(?:Query|Exec|QueryRow)(?:Context)?\s*\([^)\n]*(?:fmt\.Sprintf|\"\s*\+)", "SQL Injection"),
    ("GO-SEC-003", "h", 22, r"(?:ioutil|os)\.(?:ReadFile|Open)\s*\(\s*(?:fmt\.Sprintf|[^)\n]*\+)", "Path Traversal"), ("GO-SEC-004", "h", 798, r"(?i)\b\w*(?:password|secret|api_?key|token)\w*\s*(?::?=|:)\s*\"[^\"\n]{4,}\"", "Hardcoded Secrets"),
    ("GO-SEC-005", "h", 502, r"\byaml\.Unmarshal\s*\(", "YAML Load"), ("GO-SEC-006", "h", 295, r"InsecureSkipVerify\s*:\s*true", "Insecure TLS"), ("GO-SEC-007", "c", 95, r"\bgoja\.New\s*\(|\botto\.New\s*\(|\bRunString\s*\(", "Code Evaluation"),
    ("GO-SEC-008", "m", 489, r"(?i)\bdebug\s*(?::?=|:)\s*true\b", "Debug Mode"), ("GO-SEC-009", "h", 918, r"http\.(?:Get|Post)\s*\(\s*[\"'][^\"'\n]*(?:localhost|127\.0\.0\.1)", "Server-Side Request Forgery"), ("GO-SEC-010", "h", 79, r"template\.(?:HTML|JS|URL)\s*\(", "Cross-Site Scripting"),
    ("GO-SEC-011", "m", 470, r"reflect\.ValueOf\s*\(\s*(?:user|input|req)", "Unsafe Reflection"), ("GO-SEC-012", "h", 327, r"\b(?:md5|sha1)\.(?:New|Sum)\b|\b(?:des|rc4)\.New", "Weak Cryptography"), ("GO-SEC-013", "m", 338, r"\"math/rand\"|\brand\.(?:Intn|Int|Seed|New)\s*\(", "Insecure Random"),
    ("GO-SEC-014", "h", 611, r"\bxml\.(?:Unmarshal|NewDecoder)\s*\(", "XML Parsing"), ("GO-SEC-015", "h", 676, r"#cgo\s+\w*FLAGS\s*:|^import\s+\"C\"", "Foreign Code"), ("GO-SEC-016", "c", 89, r"\.(?:Raw|Where|Order)\s*\(\s*fmt\.Sprintf", "SQL Injection in an ORM"),
    ("GO-SEC-019", "m", 1333, r"regexp\.(?:MustCompile|Compile)\s*\([^)\n]*" + _REDOS, "Regular Expression Denial of Service"), ("GO-SEC-021", "m", 918, _METADATA, "Metadata Address"), ("GO-SEC-022", "c", 78, r"exec\.Command\s*\(\s*\"(?:sh|bash)\"\s*,\s*\"-c\"\s*,\s*\w", "Shell Operators"),
    ("GO-SEC-023", "h", 918, rf"http\.(?:Get|Post|NewRequest)\s*\([^)\n]*{_USER_GO}", "Request by Input"), ("GO-SEC-024", "c", 347, r"jwt\.Parse\s*\([^,\n]*,\s*nil|ParseUnverified\s*\(", "Weak JWT Verification"), ("GO-SEC-034", "c", 502, r"gob\.NewDecoder\s*\(", "Insecure Deserialization"),
    ("GO-SEC-036", "h", 639, rf"\bdb\.(?:First|Find|Take)\s*\([^)\n]*{_USER_GO}", "Insecure Direct Object Reference"), ("GO-SEC-037", "c", 78, rf"exec\.LookPath\s*\([^)\n]*{_USER_GO}", "Command by Input"), ("GO-SEC-038", "m", 910, r"DisableKeepAlives\s*:\s*true", "Connections not Reused"),
    ("GO-SEC-039", "m", 910, r"http\.Client\s*\{\s*\}", "Request without Timeout"), ("GO-SEC-040", "c", 1336, rf"template\.New\s*\([^)\n]*\)\s*\.Parse\s*\([^)\n]*{_USER_GO}", "Template Injection"), ("GO-SEC-041", "h", 400, r"(?:io|ioutil)\.ReadAll\s*\(\s*\w+\.Body\s*\)", "Unbounded Read"),
    ("GO-SEC-044", "h", 444, r"Transfer-Encoding[^;\n]*chunked", "Request Smuggling"), ("GO-SEC-045", "m", 942, r"Access-Control-Allow-Origin[\"']?\s*[:,]\s*[\"']\*", "CORS Misconfiguration"), ("GO-SEC-046", "c", 347, r"\bSigningMethodNone\b", "JWT without Signature"),
    ("GO-SEC-047", "h", 598, r"http\.\w+\s*\(\s*\"[^\"\n]*//[^\"/\n]*:[^\"/\n]*@", "Login in an Address"), ("GO-SEC-048", "h", 327, r"\bTLS_RSA_WITH_(?:RC4|3DES)|MinVersion\s*:\s*tls\.VersionTLS1[01]?\b", "Weak Cipher Suites"), ("GO-SEC-051", "c", 89, r"\.Exec\s*\([^)\n]*\"\s*\+", "SQL by Concatenation"),
    ("GO-SEC-052", "m", 732, r"os\.(?:Chmod|Mkdir|MkdirAll|OpenFile|WriteFile)\s*\([^)\n]*0?o?[67][67][67]\b", "Insecure File Permission"), ("GO-GOSEC-G106", "h", 78, r"exec\.Command\s*\(\s*[a-z]\w*\s*[,)]", "Command without Context"), ("GO-GOSEC-G304", "h", 22, rf"(?:filepath|path)\.Join\s*\([^)\n]*{_USER_GO}", "Path by Input"),
    ("GO-GOSEC-G305", "h", 22, r"filepath\.Join\s*\([^)\n]*\.\./", "Path Leaves its Folder"), ("GO-GOSEC-G307", "m", 754, r"^\s*defer\s+[^;\n]+\.Close\s*\(\s*\)", "Deferred Close"), ("GO-GOSEC-G501", "m", 327, r"\"crypto/md5\"", "Import of md5"), ("GO-GOSEC-G502", "m", 327, r"\"crypto/des\"", "Import of des"), ("GO-GOSEC-G503", "m", 327, r"\"crypto/rc4\"", "Import of rc4"),
    ("GO-AI-002", "m", 209, r"log\.Fatalf?\s*\([^)\n]*%v", "Verbose Error"), ("GO-AI-004", "i", 0, _MARK, "Mark of a Code Generator"), ("GO-AI-005", "c", 1595, r"^\s*\"(?:fnt|oss|htpp|jsno)\"", "Misspelt Import"), ("GO-AI-007", "m", 193, r"\bfor\s+\w+\s*:=\s*0\s*;\s*\w+\s*<=\s*len\(", "Loop Beyond the End"),
    ("GO-QUAL-001", "l", 0, r"\bfmt\.Print(?:ln|f)?\s*\(", "Print Statement"), ("GO-QUAL-002", "l", 0, r"\bpanic\s*\(", "Panic"), ("GO-QUAL-003", "l", 0, r"\b(?:any|interface\{\})\s*\{?$", "Untyped Result"),
]

JAVA = [
    ("JAVA-SEC-001", "c", 502, r"\bObjectInputStream\b", "Insecure Deserialization"), ("JAVA-SEC-002", "c", 89, r"\.(?:executeQuery|executeUpdate|execute|prepareStatement)\s*\([^)\n]*\"\s*\+", "SQL Injection"), ("JAVA-SEC-003", "h", 611, r"\bDocumentBuilderFactory\.newInstance\s*\(", "XML External Entity"),
    ("JAVA-SEC-004", "c", 470, r"\.lookup\s*\(\s*(?:[a-z]\w*|[^)\n]*\+)", "JNDI Injection"), ("JAVA-SEC-005", "m", 918, rf"\bnew\s+URL\s*\([^)\n]*{_USER_JAVA}", "Server-Side Request Forgery"), ("JAVA-SEC-006", "c", 94, r"\bparseExpression\s*\(", "Expression Injection"), ("JAVA-SEC-007", "h", 798, r"(?i)\bString\s+\w*(?:password|passwd|pwd|secret|token|key|pass)\w*\s*=\s*\"[^\"\n]+\"", "Hardcoded Secrets"),
    ("JAVA-SEC-008", "h", 327, r"MessageDigest\.getInstance\s*\(\s*\"(?:MD5|MD2|SHA-?1)\"|Cipher\.getInstance\s*\(\s*\"(?:DES|RC4)", "Weak Cryptography"), ("JAVA-SEC-009", "c", 78, r"\bgetRuntime\(\)\.exec\s*\(|\bnew\s+ProcessBuilder\s*\(", "Command Injection"), ("JAVA-SEC-010", "h", 22, rf"\bnew\s+(?:File|FileInputStream|FileReader)\s*\([^)\n]*{_USER_JAVA}", "Path Traversal"),
    ("JAVA-SEC-011", "h", 284, r"\bpermitAll\s*\(\)|csrf\(\)\.disable\s*\(", "Security Misconfiguration"), ("JAVA-SEC-012", "l", 117, r"(?i)\blog(?:ger)?\.[a-z]+\s*\([^)\n]*(?:password|token|secret)", "Secrets in Logs"), ("JAVA-SEC-013", "m", 90, r"\.search\s*\([^)\n]*\"\s*\+", "LDAP Injection"), ("JAVA-SEC-014", "c", 470, r"\bClass\.forName\s*\(\s*[a-z]", "Class by Name"),
    ("JAVA-SEC-015", "m", 915, r"\benableDefaultTyping\s*\(|@JsonTypeInfo\s*\(\s*use\s*=\s*Id\.CLASS", "Unsafe JSON Types"), ("JAVA-SEC-016", "c", 1336, r"\bnew\s+Template\s*\([^)\n]*\+|Velocity\.evaluate\s*\(", "Template Injection"), ("JAVA-SEC-017", "c", 502, r"\bnew\s+XMLDecoder\s*\(", "XMLDecoder"), ("JAVA-SEC-019", "m", 614, r"\.set(?:Secure|HttpOnly)\s*\(\s*false\s*\)", "Insecure Cookie"),
    ("JAVA-SEC-020", "h", 502, r"\bnew\s+Yaml\s*\(\s*\)", "YAML Load"), ("JAVA-SEC-021", "c", 79, rf"getWriter\(\)\.(?:write|print(?:ln)?)\s*\([^)\n]*{_USER_JAVA}", "Cross-Site Scripting"), ("JAVA-SEC-026", "c", 89, r"\bcreate(?:Native)?Query\s*\([^)\n]*\"\s*\+", "SQL in JPA"), ("JAVA-SEC-029", "c", 94, r"\$\{jndi:|\bjndi:(?:ldap|rmi)", "JNDI in a Message"),
    ("JAVA-SEC-030", "h", 327, r"\bDESede\b|\"RC4\"|\"Blowfish\"", "Weak Ciphers"), ("JAVA-SEC-031", "h", 798, r"(?i)\b(?:DB_PASSWORD|db\.password|spring\.datasource\.password)\s*[=:]\s*\S+", "Hardcoded Credentials"), ("JAVA-SEC-033", "h", 400, r"\bSAXParserFactory\.newInstance\s*\(", "XML Bomb"), ("JAVA-SEC-034", "m", 918, _METADATA, "Metadata Address"),
    ("JAVA-SEC-035", "m", 338, r"\bnew\s+Random\s*\(\s*\)", "Insecure Random"), ("JAVA-SEC-037", "c", 345, r"setSigningKey\s*\(\s*(?:\"[^\"\n]{1,20}\"|null)|parseClaimsJwt\s*\(", "Weak JWT Verification"), ("JAVA-SEC-042", "h", 93, rf"\.(?:set|add)Header\s*\([^)\n]*{_USER_JAVA}", "Response Splitting"), ("JAVA-SEC-043", "h", 22, r"\bgetRequestDispatcher\s*\([^)\n]*(?:\+|getParameter)", "Dispatcher by Input"),
    ("JAVA-SEC-046", "h", 327, r"Cipher\.getInstance\s*\(\s*\"[^\"\n]*/ECB/", "ECB Mode"), ("JAVA-SEC-047", "m", 329, r"\bIvParameterSpec\s*\(\s*(?:new\s+byte|\"[^\"\n]*\"\.getBytes)", "Static Initialisation Vector"), ("JAVA-SEC-048", "h", 780, r"Cipher\.getInstance\s*\(\s*\"RSA(?:/[^\"\n]*/(?:NoPadding|PKCS1Padding))?\"", "RSA without OAEP"), ("JAVA-SEC-049", "m", 327, r"\bnew\s+NullCipher\s*\(", "Null Cipher"),
    ("JAVA-SEC-051", "m", 400, r"\bnew\s+Socket\s*\([^)\n]*\)\s*;", "Socket without Timeout"), ("JAVA-SEC-052", "h", 330, r"\bnew\s+Random\s*\(\s*\)\.next", "Predictable Random"), ("JAVA-SEC-056", "m", 601, rf"\bsendRedirect\s*\([^)\n]*{_USER_JAVA}", "Unvalidated Redirect"), ("JAVA-SEC-058", "c", 94, r"\bOgnl\.(?:getValue|setValue)\s*\(", "OGNL Injection"),
    ("JAVA-SEC-060", "h", 94, r"\bnew\s+Jexl(?:Engine|Builder)\s*\(", "JEXL Injection"), ("JAVA-SEC-061", "h", 611, r"\bXMLInputFactory\.newInstance\s*\(", "XML Stream Reader"), ("JAVA-SEC-062", "h", 611, r"\bTransformerFactory\.newInstance\s*\(", "XML Transformer"), ("JAVA-SEC-065", "m", 91, r"@HandlerChain\b", "Handler Chain"), ("JAVA-SEC-066", "h", 338, r"\bMath\.random\s*\(", "Predictable Random"),
    ("JAVA-SEC-067", "h", 918, r"\.openConnection\s*\(\s*\)", "URL Connection"), ("JAVA-SEC-068", "m", 489, r"(?i)struts\.devMode\s*=\s*true", "Development Mode"), ("JAVA-CRYPT-001", "c", 327, r"SSLContext\.getInstance\s*\(\s*\"(?:SSL|TLSv1(?:\.[01])?)\"|X509TrustManager", "Insecure TLS"), ("JAVA-AI-002", "m", 209, r"\.printStackTrace\s*\(", "Verbose Error"), ("JAVA-AI-004", "i", 0, _MARK, "Mark of a Code Generator"), ("JAVA-AI-009", "c", 1595, r"\bimport\s+java\.(?:utile|ioo|nett)\b", "Misspelt Import"),
    ("JAVA-QUAL-001", "l", 0, r"System\.(?:out|err)\.print", "Print Statement"), ("JAVA-QUAL-002", "l", 0, r"\bpublic\s+Object\s+\w+\s*\(", "Object Result"),
]

RUST = [
    ("RUST-SEC-001", "c", 78, r"\bCommand::new\s*\(\s*(?:\"(?:sh|bash|cmd)\"|&?[a-z])|\.arg\s*\(\s*format!", "Command Injection"), ("RUST-SEC-002", "c", 798, r"(?i)\b\w*(?:password|secret|api_?key|token)\w*\s*(?::\s*&(?:'static\s+)?str\s*)?=\s*\"[^\"\n]{6,}\"", "Hardcoded Secrets"), ("RUST-SEC-003", "h", 22, r"\b(?:File::open|read_to_string|fs::read)\s*\(\s*format!", "Path Traversal"),
    ("RUST-SEC-004", "h", 532, r"(?i)\b(?:info|debug|warn|error|trace|println)!\s*\([^)\n]*(?:password|token|secret)", "Secrets in Logs"), ("RUST-SEC-005", "m", 190, r"overflow-checks\s*=\s*false", "Overflow Checks Disabled"), ("RUST-SEC-006", "m", 338, r"\brand::(?:thread_rng|random)\b|\bSmallRng\b", "Insecure Random"), ("RUST-SEC-008", "h", 327, r"\b(?:md5|Md5|sha1|Sha1|Rc4|Des)::", "Weak Cryptography"),
    ("RUST-SEC-009", "h", 416, r"\bunsafe\s*\{[^}\n]*\*|\bfrom_raw\s*\(|\bget_unchecked", "Pointer in Unsafe Code"), ("RUST-SEC-010", "m", 1333, r"Regex::new\s*\([^)\n]*" + _REDOS, "Regular Expression Denial of Service"), ("RUST-SEC-011", "m", 682, r"\bunsafe\s*\{|\bunsafe\s+fn\b", "Unsafe Code"), ("RUST-SEC-012", "h", 362, r"\bRc\s*<\s*RefCell\b|\bstatic\s+mut\b|unsafe\s+impl\s+(?:Send|Sync)", "Data Race"),
    ("RUST-SEC-013", "h", 190, r"\bwrapping_(?:add|sub|mul)\s*\(|\bunchecked_(?:add|sub|mul)", "Wraparound"), ("RUST-SEC-014", "h", 295, r"danger_accept_invalid_(?:certs|hostnames)\s*\(\s*true", "Insecure TLS"), ("RUST-SEC-015", "m", 248, r"\.(?:unwrap|expect)\s*\(|\bpanic!\s*\(", "Panic"), ("RUST-SEC-016", "l", 134, r"\bdbg!\s*\(", "Debug Macro"), ("RUST-SEC-018", "h", 416, r"\bdrop\s*\(\s*Box::from_raw|\bmem::forget\s*\(", "Memory after Free"),
    ("RUST-SEC-022", "m", 704, r"\btransmute\b|\bas\s+\*(?:const|mut)\b", "Type Cast"), ("RUST-CRYPT-001", "c", 327, r"RsaPrivateKey::new\s*\([^)\n]*\b(?:512|768|1024)\b|\bEcb\b", "Weak Keys"), ("RUST-SEC-023", "h", 79, r"\|\s*safe\b|PreEscaped\s*\(", "Unescaped Template"), ("RUST-SEC-024", "h", 918, r"\breqwest::(?:get|Client)[^\n]*format!", "Server-Side Request Forgery"), ("RUST-SEC-025", "c", 502, r"\bbincode::deserialize\s*\(|serde_pickle", "Insecure Deserialization"),
    ("RUST-SEC-028", "c", 295, r"\bSslVerifyMode::NONE\b|dangerous\(\)", "Certificates not Verified"), ("RUST-SEC-030", "h", 400, r"Vec::with_capacity\s*\(\s*[a-z]\w*(?:\s+as\s+usize)?\s*\)", "Unbounded Allocation"), ("RUST-SEC-031", "m", 682, r"\bFxHashMap\b|\bDefaultHasher\b", "Hash Flooding"), ("RUST-SEC-033", "c", 502, r"\bserde_yaml::from_str\s*\(", "YAML Load"), ("RUST-SEC-034", "m", 78, r"\benv::set_var\s*\(", "Environment Set"),
    ("RUST-SEC-035", "h", 319, r"\"http://[^\"\n]*(?:login|auth|token|api)", "Cleartext Transmission"), ("RUST-SEC-036", "h", 347, r"from_secret\s*\(\s*b?\"[^\"\n]{1,31}\"|insecure_disable_signature_validation", "Weak JWT Secret"), ("RUST-SEC-038", "m", 614, r"\.(?:secure|http_only)\s*\(\s*false\s*\)", "Insecure Cookie"), ("RUST-SEC-039", "h", 346, r"\ballow_any_origin\s*\(|Cors::permissive\s*\(", "CORS Wildcard"),
    ("RUST-QUAL-001", "l", 0, r"\.unwrap\s*\(", "Unwrap"), ("RUST-QUAL-002", "l", 0, r"\b(?:println|eprintln)!\s*\(", "Print Statement"), ("RUST-AI-001", "i", 0, _MARK, "Mark of a Code Generator"),
]

PHP = [
    ("PHP2-SEC-001", "c", 89, rf"\b(?:mysqli?_query|->query|->exec)\s*\([^)\n]*(?:{_USER_PHP}|\.\s*\$)", "SQL Injection"), ("PHP2-SEC-002", "m", 79, rf"\b(?:echo|print)\b[^;\n]*{_USER_PHP}", "Cross-Site Scripting"), ("PHP2-SEC-003", "c", 78, r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\([^)\n]*\$", "Command Injection"), ("PHP2-SEC-004", "h", 22, r"\b(?:include|require)(?:_once)?\s*\(?[^;\n]*\$_?", "File Inclusion"),
    ("PHP2-SEC-005", "m", 328, r"\b(?:md5|sha1)\s*\(\s*\$\w*pass", "Weak Password Hash"), ("PHP2-SEC-006", "h", 798, r"(?i)\$?\w*(?:password|secret|api_?key|token)\w*[\"']?\s*(?:=>?|:)\s*[\"'][^\"'\n]{4,}[\"']", "Hardcoded Secrets"), ("PHP2-SEC-007", "h", 95, r"\beval\s*\(", "Eval"), ("PHP2-SEC-008", "m", 384, rf"\bsession_id\s*\([^)\n]*{_USER_PHP}", "Session Fixation"), ("PHP2-SEC-009", "m", 601, rf"\bheader\s*\(\s*[\"']Location:[^)\n]*{_USER_PHP}", "Unvalidated Redirect"),
    ("PHP2-SEC-010", "c", 502, r"\bunserialize\s*\(", "Object Injection"), ("PHP2-SEC-011", "m", 942, r"Access-Control-Allow-Origin:\s*\*", "CORS Wildcard"), ("PHP2-SEC-012", "m", 200, r"\berror_reporting\s*\(\s*E_ALL|\bphpinfo\s*\(", "Information Disclosure"), ("PHP2-SEC-013", "m", 338, r"\b(?:mt_rand|rand|uniqid)\s*\(", "Weak Random"), ("PHP2-SEC-015", "c", 434, r"\bmove_uploaded_file\s*\(", "File Upload"), ("PHP2-SEC-016", "h", 20, rf"{_USER_PHP}\[[^\]\n]*\]\s*==\s*[\"'\d]", "Loose Comparison"),
    ("PHP2-SEC-018", "h", 611, r"\bsimplexml_load_(?:string|file)\s*\(|LIBXML_NOENT", "XML External Entity"), ("PHP2-SEC-019", "h", 90, r"\bldap_search\s*\([^)\n]*\$", "LDAP Injection"), ("PHP2-SEC-020", "m", 915, r"::create\s*\(\s*(?:\$_POST|\$request->all\(\))", "Mass Assignment"), ("PHP2-SEC-027", "c", 502, r"\bphar://", "PHAR Deserialization"), ("PHP2-SEC-029", "m", 1104, r"symfony/symfony[\"']?\s*:\s*[\"']?\^?[2-3]\.", "Outdated Dependency"), ("PHP2-SEC-031", "h", 918, rf"\b(?:curl_init|file_get_contents|fopen)\s*\([^)\n]*(?:{_USER_PHP}|{_METADATA})", "Server-Side Request Forgery"),
    ("PHP2-SEC-032", "c", 345, r"\bJWT::decode\s*\([^,\n]*,\s*null", "Weak JWT Verification"), ("PHP2-SEC-033", "c", 89, r"\bDB::(?:raw|select|statement|insert|update)\s*\([^)\n]*(?:\.\s*\$|\{\$)", "SQL in a Query Builder"), ("PHP2-SEC-035", "h", 915, rf"\bextract\s*\(\s*{_USER_PHP}", "Variables Overwritten"), ("PHP2-SEC-038", "c", 98, r"(?i)\binclude(?:_once)?\s*\(?\s*[\"']https?://", "Remote File Inclusion"), ("PHP2-SEC-041", "c", 22, r"\bextractTo\s*\(", "Zip Slip"), ("PHP2-SEC-042", "c", 643, r"->xpath\s*\([^)\n]*\$|DOMXPath", "XPath Injection"),
    ("PHP2-SEC-043", "c", 94, r"\bpreg_replace\s*\(\s*[\"'][^\n]*/\w*e\w*[\"']", "Replacement Evaluated"), ("PHP2-SEC-044", "h", 147, rf"\bmail\s*\([^)\n]*{_USER_PHP}", "Mail Header Injection"), ("PHP2-SEC-046", "m", 598, r"session\.use_trans_sid\s*=\s*1", "Session in the Address"), ("PHP2-SEC-047", "m", 489, r"display_errors[\"']?\s*[,=]\s*[\"']?(?:1|On|true)", "Debug Mode"), ("PHP2-SEC-048", "c", 78, r"\bpcntl_exec\s*\(", "Process Execution"), ("PHP2-SEC-049", "m", 614, r"session\.cookie_(?:secure|httponly)\s*=\s*0", "Insecure Cookie"),
    ("PHP2-SEC-051", "m", 915, r"\bparse_str\s*\(\s*\$[^,)\n]*\)", "Variables from Text"), ("PHP2-SEC-052", "h", 95, r"\bassert\s*\(\s*[\"'$]", "Assert Evaluated"), ("PHP2-SEC-053", "c", 94, r"\bcreate_function\s*\(", "Function from Text"), ("PHP2-SEC-054", "h", 915, r"register_globals\s*=\s*(?:1|On)", "Global Registration"), ("PHP2-SEC-055", "m", 732, r"\bchmod\s*\([^,\n]+,\s*0?777", "File Permissions"), ("PHP2-AI-002", "m", 209, r"\becho\s+[^;\n]*->getMessage\s*\(", "Verbose Error"), ("PHP2-AI-004", "i", 0, _MARK, "Mark of a Code Generator"),
]

RUBY = [
    ("RUBY-SEC-001", "c", 89, r"\.(?:find_by_sql|execute|exec_query)\s*\(?\s*[\"'].*#\{", "SQL Injection"), ("RUBY-SEC-002", "c", 78, r"\b(?:system|exec|spawn)\s*\(?\s*[\"'][^\n]*#\{|`[^`\n]*#\{", "Command Injection"), ("RUBY-SEC-003", "h", 502, r"\bYAML\.(?:load|unsafe_load)\s*\(", "YAML Load"), ("RUBY-SEC-004", "h", 798, r"(?i)\b\w*(?:password|secret|api_?key|token)\w*[\"']?\s*(?:=>?|:)\s*[\"'][^\"'\n]{4,}[\"']", "Hardcoded Secrets"), ("RUBY-SEC-005", "c", 95, r"\b(?:eval|instance_eval|class_eval)\s*[\( ]", "Eval"),
    ("RUBY-SEC-006", "h", 327, r"(?i)\bDigest::(?:MD5|SHA1)\b|\barc4|\brc4\b", "Weak Cryptography"), ("RUBY-SEC-007", "m", 915, r"\.(?:new|create|update)\s*\(\s*params\s*(?:\[[^\]\n]*\])?\s*\)", "Mass Assignment"), ("RUBY-SEC-008", "h", 90, r"(?i)ldap\.search\s*\([^)\n]*params", "LDAP Injection"), ("RUBY-SEC-010", "m", 601, r"\bredirect_to\s*\(?\s*params\[", "Open Redirect"), ("RUBY-SEC-011", "l", 200, r"\bputs\s+ENV\b", "Information Disclosure"), ("RUBY-SEC-013", "m", 22, r"\bFile\.(?:read|open|new)\s*\(?[^)\n]*params", "Path Traversal"),
    ("RUBY-SEC-020", "h", 918, rf"\b(?:Net::HTTP\.\w+|URI\.open|HTTParty\.\w+|RestClient\.\w+)\s*\(?[^)\n]*(?:{_USER_RUBY}|{_METADATA})", "Server-Side Request Forgery"), ("RUBY-SEC-021", "c", 345, r"\bJWT\.decode\s*\(?[^,\n]+,\s*nil", "Weak JWT Verification"), ("RUBY-SEC-022", "c", 89, r"\bDB\[[\"'][^\n]*#\{", "SQL in Sequel"), ("RUBY-SEC-026", "c", 502, r"\bMarshal\.load\b", "Insecure Deserialization"), ("RUBY-SEC-028", "c", 89, r"\.(?:where|order|group|having|joins)\s*\(?\s*[\"'][^\n]*#\{", "SQL in ActiveRecord"), ("RUBY-SEC-031", "m", 614, r"\bcookies\[[^\]\n]*\]\s*=\s*[^{\n]*$|secure:\s*false", "Insecure Cookie"),
    ("RUBY-SEC-032", "h", 502, r"\bJSON\.load\s*\(", "JSON Load"), ("RUBY-SEC-033", "m", 78, r"\bIO\.(?:read|write|binread|binwrite|foreach|readlines)\s*\(", "IO Methods"), ("RUBY-SEC-036", "h", 79, r"\brender\s*\(?\s*:?inline\b", "Inline Template"), ("RUBY-SEC-040", "h", 89, r"(?i)\bLIKE\s+['\"][^'\"\n]*%?#\{", "SQL in LIKE"), ("RUBY-SEC-041", "h", 22, r"\bsend_file\s*\(?\s*params\[", "File by Input"), ("RUBY-SEC-042", "h", 611, r"\b(?:REXML::Document\.new|Nokogiri::XML)\s*\(", "XML External Entity"), ("RUBY-SEC-043", "l", 209, r"consider_all_requests_local\s*=\s*true", "Detailed Errors"),
    ("RUBY-SEC-044", "h", 79, r"\bcontent_tag\s*\([^)\n]*raw\b", "Raw Content"), ("RUBY-SEC-046", "h", 22, r"\brender\s+[\"'][^\"'\n]*#\{", "Template by Input"), ("RUBY-SEC-049", "m", 20, r"\bsession\[[^\]\n]*\]\s*=\s*params\[", "Session by Input"), ("RUBY-SEC-050", "m", 470, r"\.constantize\b", "Unsafe Reflection"), ("RUBY-SEC-052", "m", 698, r"\bmatch\s+[\"']:controller", "Default Routes"), ("RUBY-SEC-054", "m", 1004, r"\bhttp_?only\s*(?::|=>)\s*false", "Cookie without HttpOnly"), ("RUBY-SEC-055", "m", 185, r"\bvalidates_format_of\b[^\n]*\^[^\n]*\$/", "Line Anchors in Validation"),
    ("RUBY-SEC-056", "h", 73, r"\brender\s*\(?\s*params\[", "Dynamic Render"), ("RUBY-SEC-057", "h", 1333, r"\bRegexp\.new\s*\(\s*params\[", "Pattern by Input"), ("RUBY-SEC-058", "h", 400, r"\bparams\[[^\]\n]+\]\s*\.to_sym\b", "Symbol by Input"), ("RUBY-SEC-059", "h", 78, r"\.(?:public_)?send\s*\(?\s*params\[", "Method by Input"), ("RUBY-SEC-060", "h", 88, r"\bmail\s*\(?[^)\n]*params\[", "Mail Header Injection"), ("RUBY-SEC-062", "c", 78, r"\bOpen3\.\w+\s*\(?[^)\n]*#\{", "Open3"), ("RUBY-SEC-063", "c", 79, r"\.html_safe\b|<%==|\braw\s*\(", "Raw Output"), ("RUBY-SEC-064", "h", 915, r"\bparams\.permit!", "All Parameters Permitted"), ("RUBY-SEC-065", "c", 78, r"\bopen\s*\(\s*[\"']\|", "Pipe Opened"), ("RUBY-AI-001", "i", 0, _MARK, "Mark of a Code Generator"),
]

CSHARP = [
    ("CSHARP-001", "i", 0, r"\bConsole\.Write(?:Line)?\s*\(", "Console Write"), ("CSHARP-002", "i", 0, r"\b(?:TODO|FIXME|HACK|XXX)\b", "Open Mark"), ("CSHARP-003", "c", 89, _SQL + r"[^\n]*(?:\"\s*\+|\{\w)", "SQL Injection"), ("CSHARP-004", "c", 502, r"\b(?:BinaryFormatter|SoapFormatter|LosFormatter|NetDataContractSerializer|ObjectStateFormatter)\b", "Insecure Deserialization"), ("CSHARP-005", "c", 798, r"(?i)\b\w*(?:password|pwd|secret|apikey|token)\w*\s*=\s*\"[^\"\n]{4,}\"", "Hardcoded Secret"),
    ("CSHARP-006", "c", 78, r"\bProcess\.Start\s*\([^)\n]*(?:\+|\$\"|\w+\s*\))|new\s+ProcessStartInfo\s*\([^)\n]*\+", "Command Injection"), ("CSHARP-007", "h", 327, r"\b(?:MD5|SHA1|DES|TripleDES|RC2)(?:CryptoServiceProvider|Managed)?\.?(?:Create\b|\()|CipherMode\.ECB", "Weak Cryptography"), ("CSHARP-008", "h", 22, r"\bFile\.(?:ReadAllText|ReadAllBytes|Open|Delete|WriteAllText)\s*\([^)\n]*(?:\+|Request)", "Path Traversal"), ("CSHARP-009", "m", 338, r"\bnew\s+Random\s*\(", "Insecure Random"), ("CSHARP-010", "h", 79, r"\bHtml\.Raw\s*\(|Response\.Write\s*\(", "Cross-Site Scripting"),
    ("CSHARP-011", "h", 862, r"\[AllowAnonymous\]", "Access without Login"), ("CSHARP-012", "h", 611, r"\bDtdProcessing\.Parse\b|\bXmlResolver\s*=\s*new\b", "XML External Entity"), ("CSHARP-013", "m", 601, rf"\bRedirect\s*\([^)\n]*{_USER_CS}", "Open Redirect"), ("CSHARP-014", "m", 90, r"\bnew\s+Directory(?:Entry|Searcher)\s*\([^)\n]*\+", "LDAP Injection"), ("CSHARP-015", "m", 915, r"\bTryUpdateModel\w*\s*\(|JsonConvert\.DeserializeObject\s*<\s*dynamic", "Mass Assignment"), ("CSHARP-017", "m", 614, r"\b(?:HttpOnly|Secure)\s*=\s*false", "Insecure Cookie"),
    ("CSHARP-018", "c", 502, r"TypeNameHandling\s*=\s*TypeNameHandling\.(?:All|Auto|Objects)", "Types from JSON"), ("CSHARP-019", "m", 1333, r"new\s+Regex\s*\([^)\n]*" + _REDOS, "Regular Expression Denial of Service"), ("CSHARP-020", "h", 611, r"\bnew\s+Xml(?:Document|TextReader)\s*\(", "XML Document"), ("CSHARP-021", "c", 89, r"\b(?:ExecuteSqlRaw|FromSqlRaw|ExecuteSqlCommand)\w*\s*\([^)\n]*(?:\$\"|\+)", "Raw SQL"), ("CSHARP-024", "h", 798, r"(?i)\b(?:Password|Pwd)=[^;\"\n]+;", "Connection String"), ("CSHARP-028", "m", 918, rf"\bHttpClient\b[^\n]*\(\s*{_USER_CS}|\.Get(?:String|Async)\w*\s*\([^)\n]*{_USER_CS}", "Server-Side Request Forgery"),
    ("CSHARP-029", "h", 918, r"[\"']https?://[^\"'\n]*(?:" + _METADATA + ")", "Metadata Address"), ("CSHARP-030", "c", 347, r"\bValidate(?:IssuerSigningKey|Lifetime|Audience|Issuer)\s*=\s*false|RequireSignedTokens\s*=\s*false", "Weak JWT Verification"), ("CSHARP-031", "h", 295, r"ServerCertificate(?:Custom)?ValidationCallback\s*\+?=", "Certificates not Verified"), ("CSHARP-AI-002", "m", 209, r"\breturn\s+StatusCode\s*\(\s*\d+\s*,\s*\w+\.Message", "Verbose Error"), ("CSHARP-AI-004", "i", 0, _MARK, "Mark of a Code Generator"), ("CSHARP-QUAL-002", "i", 0, r"\bDebug\.Write(?:Line)?\s*\(", "Debug Write"), ("CSHARP-QUAL-004", "l", 0, r"#nullable\s+disable|#pragma\s+warning\s+disable", "Warnings Suppressed"),
]

TABLES = {"javascript": JAVASCRIPT, "typescript": TYPESCRIPT, "go": GO, "java": JAVA, "rust": RUST, "php": PHP, "ruby": RUBY, "csharp": CSHARP}
SEVERITIES = {"c": "critical", "h": "high", "m": "medium", "l": "low", "i": "info"}
