"""Live credentials in code, configuration and snippets: found lexically, redacted in place.

A text is cut into comments, string literals and the rest. A literal is a credential if it
has the form of an issued token, a private key or a login inside an address, header or
connection setting, or if a credential-named identifier is assigned or passed it and it is no
placeholder, mask, reference or name. Only the content of literals is ever replaced.
"""

from __future__ import annotations

import base64
import binascii
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of tokens that common issuers give out.
_ISSUED = (
    r"gh[pousr]_[A-Za-z0-9]{10,}|github_pat_\w{20,}|glpat-[\w-]{15,}"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|(?<![\w-])sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{16,}"
    r"|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}|ya29\.[\w-]{20,}"
    r"|(?<![\w-])eyJ[\w-]{8,}={0,2}\.[\w-]{8,}={0,2}\.[\w-]{8,}"
    r"|(?<!\w)npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|(?<!\w)hf_[A-Za-z0-9]{20,}|dop_v1_[0-9a-f]{40,}|whsec_[\w+/]{16,}"
)
#: What each of these begins with, a class or letter a step.
_PREFIXES = (
    r"gh[pousr]_", "github_pat_", "glpat-", "AKIA", "ASIA", r"[sr]k_live_", r"[sr]k_test_", r"sk-", r"xox[abeprs]-", "AIza", r"ya29\.",
    "eyJ", "npm_", "pypi-", r"SG\.", "hf_", "dop_v1_", "whsec_",
)
_SET = "password|passwd|pwd|pass|accountkey|sharedaccesskey|sharedsecret|secretkey"
_ASKED = "access_token|auth_token|token|api_?key|key|sig|signature|secret|password"
_KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^\s:/@\"'`<>]*):(?P<login>[^\s/\"'`@]+(?:@[^\s/\"'`@.]+)*)@[A-Za-z0-9\[{$%<]"
_SETTING = rf"(?i:(?<![A-Za-z])(?:{_SET}))\s*=\s*(?P<setting>[^;\"'`\n]+)"
_HEADER = r"(?i:authorization[\"']?\s*[:=]\s*[\"'`]?\s*)?(?P<scheme>(?i:bearer|basic)|(?<=: )token|(?<=[\"'`])token)\s+(?P<header>[A-Za-z0-9+/_.~=-]{8,})"
_QUERY = rf"[?&](?i:{_ASKED})=(?P<query>[^&\s\"'`#]{{8,}})"
_KEY_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_FORMS = re.compile(f"(?P<issued>{_ISSUED})|(?P<block>{_KEY_BLOCK})|{_ADDRESS}|{_HEADER}|{_QUERY}")
_SETTINGS = re.compile(_SETTING)

_PLACEHOLDER = re.compile(
    r"(?i)^$|[<>]|\$\{|\$\(|\{\{|%\(|\{[a-z_]\w*\}|^\$\w+$|^%\w+%$|^%[sdv]$|\*{3,}|x{4,}|•{2,}|\.{3,}|…|#{4,}|_{4,}"
    r"|change[-_ ]?(?:me|it|this)|replace[-_ ]?(?:me|this|with)|placeholder|redacted|set[-_ ]?me|fill[-_ ]?(?:me|in)|insert[-_ ]|your[-_ ]?\w*|example$|^example|dummy|^todo|^tbd|^none$|^null$|^nil$|^undefined$|^true$|^false$|not[-_ ]?a[-_ ]?real|sample[-_ ]?(?:key|token|password|secret)|^(.)\1*$"
)
_REFERENCE = re.compile(r"(?i)^(?:vault|env|ssm|kms|secrets?|secretsmanager|op|gcp|aws|azure|keyvault|file|ref|arn|sops|doppler|awssecret|projects)[:/]|^@microsoft\.|^/|^\.{1,2}/|^sha(?:1|256|384|512)[-:]|^https?://[^@]*$|^process\.env|^os\.|^System\.")
_PUBLIC = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|CERTIFICATE REQUEST|X509 CRL)")

# Words of credential names, words that make "key" one, and closing words of names that only speak of one.
_WORDS = {"password", "passwd", "passphrase", "passcode", "pwd", "pass", "pw", "secret", "secrets", "token", "credential", "credentials", "cred", "creds", "apikey", "auth", "authorization", "accesskey", "secretkey", "privatekey", "authtoken", "apitoken"}
_KEY_KINDS = {"api", "access", "secret", "signing", "sign", "enc", "encryption", "private", "auth", "service", "client", "master", "account", "storage", "ssh", "tls", "ssl", "deploy", "crypto", "hmac", "shared", "subscription", "app", "server", "license", "jwt", "session", "cookie", "webhook", "cipher", "aes", "rsa", "admin", "root", "my", "the"}
_SPEAKING = {"name", "label", "field", "url", "uri", "path", "id", "ids", "file", "hint", "type", "length", "len", "size", "count", "ttl", "expiry", "expires", "header", "prefix", "suffix", "format", "policy", "pattern", "regex", "min", "max", "index", "env", "var", "variable", "location", "store", "provider", "class", "digest", "hash", "checksum", "fingerprint", "public", "kind", "title", "placeholder", "message", "error", "prompt", "column", "arn", "version", "endpoint", "scope", "issuer", "audience", "algorithm", "alg"}
_JOINED = re.compile(r"passw(?:or)?d|passphrase|secret|token|credential|(?:api|access|enc|secret|signing|private|auth|encryption|master|client|service|shared|hmac|tls|ssh|deploy|webhook)key$")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _trigger() -> str:
    """A pattern for Java and Python that every text passes in which find() reports anything; built from what find() goes by."""
    word = lambda w: rf"(?<![A-Za-z])(?i:{w})(?![a-z])|{w.capitalize()}(?![a-z])|(?<![A-Z]){w.upper()}(?![a-z])"
    short = {w for w in _WORDS if len(w) <= 4 and w not in ("auth", "cred")}  # within longer words all the time
    long = (_WORDS | {"key"}) - short
    plain = sorted(w for w in long if not any(v != w and v in w for v in long))
    # The last two words of a name count joined too, whatever parts them.
    parted = ["(?-i:[^A-Za-z0-9.\"'`\n])*".join(w) for w in ("passwd", "password", "passphrase", "secret", "token", "credential")]
    # A token may be cut anywhere into literals that are joined.
    cut = "(?:[\"'`]*+[^A-Za-z_\"'`]*+(?:r#*)?[\"'`]+)*"
    issued = [("(?<![A-Za-z0-9_-])" if p == "sk-" else "") + cut.join(re.findall(r"\[[^\]]+\]|\\?.", p)) for p in _PREFIXES]
    return "|".join([
        "(?iu)" + "|".join(plain), "login|bearer|basic[^A-Za-z0-9]", rf"(?<![A-Za-z])(?:{_SET})(?![A-Za-z])", f"[?&](?:{_ASKED})=", r"://[^/\s]*:[^/\s]*@",
        *parted, *(f"(?-i:{x})" for x in [*map(word, sorted(short)), *issued]),
    ])


#: A text without any of these holds no credential: the test that runs in the JVM.
TRIGGER = _trigger()


_CODE = {"py", "js", "jsx", "mjs", "cjs", "ts", "tsx", "go", "java", "rs", "rb", "php", "cs", "kt", "scala", "c", "cc", "cpp", "h", "swift", "json"}
_HASH_COMMENTS = {"py", "rb", "sh", "yml", "yaml", "env", "ini", "cfg", "conf", "toml", "tfvars", "tf", "properties", "local"}
_STRING = r'"""(?:[^\\]|\\[\s\S])*?"""|' + r"'''(?:[^\\]|\\[\s\S])*?'''|" + r'"(?:[^"\\\n]|\\.|\\\n)*(?:"|(?=\n)|\Z)|' + r"'(?:[^'\\\n]|\\.|\\\n)*(?:'|(?=\n)|\Z)|" + r"`(?:[^`\\]|\\[\s\S])*(?:`|\Z)"
_SLASH = re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>" + r'r#+"[\s\S]*?"#+|r"[^"]*(?:"|\Z)|' + _STRING + ")")
_HASH = re.compile(r"(?P<comment>#[^\n]*)|(?P<string>" + _STRING + ")")
_RUST = re.compile(r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>" + r'r#+"[\s\S]*?"#+|r"[^"]*(?:"|\Z)|"(?:[^"\\]|\\[\s\S])*(?:"|\Z))' + r"|'(?:[^'\\\n]|\\[^\n]{1,8})'|'\w+")
_JOIN = re.compile(r"\s*(?:[+.\\]\s*|\|\|\s*|)\Z")
#: What stands before a literal that something is assigned or passed: a name, perhaps a type, an operator, perhaps a wrapper.
_TARGET = re.compile(
    r"""(?:(?P<name>[A-Za-z_$][\w$.-]*)|["'`](?P<quoted>[^"'`\n]+)["'`])\s*\]?\s*(?::\s*(?![\"'`])(?:[&\w<>.|' ]|\[(?:[^\[\]\n=]|\[(?:[^\[\]\n=]|\[[^\[\]\n=]*\])*\])*\])+?)?\s*(?::=|=>|=|:)\s*(?:[\(\[]\s*)?(?:[rbfuRBFU]{1,2}|(?:String::from|String|Some|str|new\s+\w+|bytes|Buffer\.from|SecretStr|concat!)\s*\(\s*|(?:""|'')\.join\(\s*[\[(]\s*|String\.join\(\s*"",\s*)?\Z"""
)
#: What opens a list of pieces that make one value although commas part them.
_PIECES = re.compile(r"""(?:concat!\s*\(|(?:""|'')\.join\(\s*[\[(]|String\.join\(\s*"",)\s*\Z""")
_COMMA = re.compile(r"\s*,\s*\Z")
_CALL = re.compile(r"(?P<call>[A-Za-z_$][\w$]*)\s*\(\s*\Z")
_LINE = re.compile(r"""^(?P<lead>\s*(?:-\s+)?(?:export\s+|set\s+|declare\s+)?)["']?(?P<key>[A-Za-z_][\w.-]*)["']?\s*[:=][ \t]*(?P<value>[^\r\n]*?)[ \t]*\r?$""", re.M)
_SAID = re.compile(r"(?i)\b(?:tokens?|keys?|pass(?:word|phrase|code)?|pwd|secrets?|credentials?|login|auth)\b[^:=/\n]{0,40}[:=/]\s+(?P<said>\S[^\n]*?)\s*(?:\*/|-->)?\s*$")
_DECORATION = re.compile(r"^(?:\s*\d+ \| ?|> ?|[+-] )", re.M)


def credential_name(name: str) -> bool:
    """Whether an identifier, key or parameter names a credential itself."""
    name = name.rsplit(".", 1)[-1]
    words = [w.lower() for w in _SPLIT.findall(name)]
    while words and (words[-1].isdigit() or (len(words) > 1 and len(words[-1]) <= 2 and words[-1] not in ("pw", "id"))):
        words.pop()
    if not words or words[-1] in _SPEAKING:
        return False
    if any(w in _WORDS for w in words) or _JOINED.search(words[-1]):
        return True
    return words[-1] in ("key", "keys") and (len(words) == 1 or words[-2] in _KEY_KINDS) or _JOINED.search("".join(words[-2:])) is not None


def placeholder(value: str) -> bool:
    value = value.strip()
    return bool(_PLACEHOLDER.search(value) or _REFERENCE.match(value) or _PUBLIC.search(value))


def secret_like(value: str) -> bool:
    """Whether a value under a credential name can be the credential: neither placeholder, reference, name nor prose."""
    value = value.strip()
    if len(value) < 6 or placeholder(value):
        return False
    digit, lower, upper = (re.search(c, value) is not None for c in ("[0-9]", "[a-z]", "[A-Z]"))
    if re.search(r"\s", value):
        return re.fullmatch(r"[A-Za-z0-9!@#$%^&*?]+(?: [A-Za-z0-9!@#$%^&*?]+){1,7}", value) is not None and re.search(r"[A-Za-z][0-9!@#$%^&*?]+$", value) is not None
    if digit:
        return not re.fullmatch(r"[0-9.,:_-]{1,7}|v?[0-9]+(?:\.[0-9]+){1,3}|[A-Za-z_]+[(\[].*", value)
    if re.fullmatch(r"[A-Za-z]+(?:[_. /:-][A-Za-z]+)*", value):
        turns = len(re.findall(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]", value))
        return lower and upper and len(value) >= 12 and turns >= 5 and not re.search(r"[_. /:-]", value)
    return lower and upper and re.search(r"[^A-Za-z_./:() \[\]{}-]", value) is not None and not re.search(r"[()\[\]{}]", value)


def _basic(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return ":" in plain and not placeholder(plain.split(":", 1)[1])


def _forms(text: str, lo: int, hi: int):
    """Spans of issued tokens, key blocks and logins within text[lo:hi]."""
    for m in _FORMS.finditer(text, lo, hi):
        kind = m.lastgroup if m.lastgroup != "user" else "login"
        for kind in ("issued", "block", "login", "header", "query"):
            if m.group(kind) is not None:
                break
        value = m.group(kind)
        if kind == "block":
            end = _KEY_END.search(text, m.end(), hi)
            body = text[m.end() : end.start() if end else hi]
            if "*" in body and not re.search("[A-Za-z0-9+/]{8}", body):
                continue  # masked
            yield m.start(), end.end() if end else hi, "private key"
        elif kind == "issued":
            if not re.search(r"(?i)example$|x{6,}|\*{3,}", value) and re.search("[0-9]|[a-z][A-Z]", value) and not text.startswith(("...", "***"), m.end()):
                yield *m.span(kind), "token"
        elif kind == "login":
            if not placeholder(value) and not re.fullmatch(r"(?i)pass(?:word|wd)?|pwd|secret|token|user(?:name)?|x+", value):
                yield *m.span(kind), "address"
        elif kind == "header":
            ok = _basic(value) if m.group("scheme").lower() == "basic" else re.search("[0-9]", value) and not placeholder(value)
            if ok:
                yield *m.span(kind), "header"
        elif not placeholder(value) and re.search("[0-9]", value):
            yield *m.span(kind), "query"


def _settings(text: str, lo: int, hi: int):
    """Spans of passwords in a connection setting: key=value pairs of which there are several."""
    content = text[lo:hi]
    if content.count("=") > 1:
        for m in _SETTINGS.finditer(content):
            value = m.group("setting").strip()
            if ";" not in content:  # pairs parted by blanks
                value = value.split()[0] if value.split() else ""
            if value and not placeholder(value) and len(value) >= 4:
                start = lo + m.start("setting")
                yield start, start + len(value), "setting"


def _body(literal: str) -> tuple[int, int]:
    """Where the content of a literal begins and ends within it."""
    m = re.match(r"""(?:r?#*)("{3}|'{3}|["'`])""", literal)
    quote = m.group(1)
    end = len(literal)
    while end > m.end() and literal[end - 1] == "#":
        end -= 1
    return m.end(), end - len(quote) if end - m.end() >= len(quote) and literal.endswith(quote, 0, end) else end


def find(text: str, ext: str = "") -> list[tuple[int, int, str]]:
    """(start, end, kind) of each credential in the text, in order, without overlaps.

    `ext` is the file extension; without one, the lines may be code or configuration. Empty text has none.
    """
    ext = ext.lower()
    config = ext not in _CODE
    lexer = _RUST if ext == "rs" else _HASH if ext in _HASH_COMMENTS or (config and ext != "") else _SLASH
    if ext == "" and re.search(r"(?m)^\s*#", text):
        lexer = _HASH
    found: list[tuple[int, int, str]] = []
    whole = re.match(r"\s*" + _KEY_BLOCK, text)
    if config:
        found += _forms(text, 0, len(text))
        if whole:
            return _settled(found)
        for m in _LINE.finditer(text):
            if m.group("key") and credential_name(m.group("key")) and not m.group("value").startswith(("|", ">", "&", "*")):
                lo, hi = m.span("value")
                value = text[lo:hi]
                if value[:1] in ("'", '"'):
                    close = value.find(value[0], 1)
                    lo, hi = lo + 1, lo + (close if close > 0 else len(value))
                else:
                    cut = re.search(r"\s+[#;]", value)
                    hi = lo + cut.start() if cut else hi
                if secret_like(text[lo:hi]) and not (ext == "" and re.search(r"[()\[\];{}]", text[lo:hi])):
                    found.append((lo, hi, "named"))
    pieces: list[tuple[int, int]] = []  # adjacent literals that make one value
    last_end, listed = -1, False
    opened = before_that = 0  # where the literal before the pieces begins, and where the last literal does
    comments: list[tuple[int, int]] = []

    def settle():
        if pieces:
            value = "".join(text[a:b] for a, b in pieces)
            first = pieces[0][0]
            quote = first
            while quote > 0 and text[quote - 1] in "\"'`#rbfuRBFU" and first - quote < 6:
                quote -= 1
            if secret_like(value):
                # All that stands between, from the literal before, without comments.
                before, at = "", opened
                for lo, hi in comments:
                    if at <= lo < quote:
                        before, at = before + text[at:lo] + " ", hi
                before += text[at:quote] + re.sub(r"[\"'`#]", "", text[quote:first])
                target = _TARGET.search(before) or _CALL.search(before)
                if target:
                    name = next(g for g in target.groups() if g)
                    if credential_name(name):
                        found.extend((a, b, "rest" if k else "named") for k, (a, b) in enumerate(pieces))
                        return
            for a, b in pieces:
                found.extend(_settings(text, a, b))
            if len(pieces) > 1 and re.fullmatch(f"(?:{_ISSUED})", value):
                found.extend((a, b, "rest" if k else "token") for k, (a, b) in enumerate(pieces))

    for m in lexer.finditer(text):
        if m.lastgroup == "string":
            lo, hi = _body(m.group())
            lo, hi = m.start() + lo, m.start() + hi
            if not config:
                found += _forms(text, lo, hi)
            gap, at = "", last_end
            for a, b in comments:
                if pieces and a >= at:
                    gap, at = gap + text[at:a] + " ", b
            gap += text[at : m.start()]
            fresh = not pieces
            if pieces and (gap == "" or not (_JOIN.fullmatch(gap) or listed and _COMMA.fullmatch(gap))):
                settle()
                pieces, fresh = [], True
            if fresh:
                listed = bool(_PIECES.search(text, before_that, m.start()))
                opened = before_that
                comments = [c for c in comments if c[0] >= opened]
            pieces.append((lo, hi))
            before_that, last_end = m.start(), m.end()
        elif m.lastgroup == "comment":
            comments.append(m.span())
            if not config:
                found += _forms(text, m.start(), m.end())
            for line in re.finditer(r"[^\n]+", m.group()):
                said = _SAID.search(line.group())
                if said and secret_like(said.group("said")):
                    lo = m.start() + line.start() + said.start("said")
                    found.append((lo, lo + len(said.group("said")), "said"))
    settle()
    return _settled(found)


def _settled(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for lo, hi, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or lo >= out[-1][1]:
            out.append((lo, hi, kind))
    return out


def undecorated(snippet: str) -> str:
    """The snippet with line numbers, quote marks or diff signs, which every line of it bears, blanked out; same length."""
    lines = snippet.split("\n")
    if all(_DECORATION.match(x) for x in lines if x.strip()) and any(x.strip() for x in lines) and not re.match(r"\s*- [\w'\"]+\s*:", snippet):
        return _DECORATION.sub(lambda m: " " * len(m.group()), snippet)
    return snippet


def begins(text: str, found: list[tuple[int, int, str]]) -> list[int]:
    """Line numbers, from 1, on which credentials begin; later pieces of a split literal don't count."""
    return [text.count("\n", 0, lo) + 1 for lo, _, kind in found if kind != "rest"]


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """Each found content as asterisks; escapes, line ends, delimiters and key block markers stay, as does the length."""
    out, at = [], 0
    for lo, hi, kind in found:
        out.append(text[at:lo])
        content = text[lo:hi]
        keep = r"(-----(?:BEGIN|END)[^\n\\-]*-----|\\[^\n]|\s+)" if kind == "private key" else r"(\\[^\n]|[\r\n]+)"
        out.append("".join(p if k % 2 else "*" * len(p) for k, p in enumerate(re.split(keep, content))))
        at = hi
    return "".join(out) + text[at:]


def scan(texts: DataFrame, id_col: str, text_col: str, path: Column | None = None, tab: str = "", snippet: bool = False) -> DataFrame:
    """(tab, row_id, lines, kinds, redacted) for each row whose text holds a credential.

    `path` tells the kind of file by its extension. Null and empty texts have none; repeated rows
    come out repeatedly. Texts without a trigger word are dropped in the JVM.
    """
    ext = F.lit("") if path is None else F.coalesce(F.regexp_extract(F.regexp_extract(path, r"[^/\\]*$", 0), r"\.([A-Za-z0-9]+)$", 1), F.lit(""))
    rows = texts.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), ext.alias("ext")).where(F.col("text").rlike(TRIGGER))
    schema = pa.schema([("row_id", pa.int64()), ("lines", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())), ("redacted", pa.string())])

    def run(batches):
        seen: dict = {}
        for batch in batches:
            out = []
            for row_id, text, e in zip(*(c.to_pylist() for c in batch.columns)):
                hit = seen.get((text, e))
                if hit is None:
                    if len(seen) > 2000:
                        seen.clear()
                    plain = undecorated(text) if snippet else text
                    spans = find(plain, e)
                    hit = seen[(text, e)] = (begins(plain, spans), [k for *_, k in spans], redact(text, spans)) if spans else ()
                if hit:
                    out.append({"row_id": row_id, "lines": hit[0], "kinds": hit[1], "redacted": hit[2]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, "row_id long, lines array<long>, kinds array<string>, redacted string").select(F.lit(tab).alias("tab"), "*")
