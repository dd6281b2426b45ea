"""Scalar functions on code, paths, versions and names, all as JVM expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language of a file extension.
EXTENSIONS = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "rs": "rust", "cs": "csharp", "php": "php", "rb": "ruby", "cjs": "javascript", "pyi": "python",
}
# Common licence spellings and their SPDX ids.
LICENSES = {
    "MIT LICENSE": "MIT", "MIT": "MIT", "APACHE 2.0": "Apache-2.0", "APACHE-2.0": "Apache-2.0", "APACHE LICENSE 2.0": "Apache-2.0", "APACHE2": "Apache-2.0",
    "BSD": "BSD-3-Clause", "BSD-3-CLAUSE": "BSD-3-Clause", "BSD-2-CLAUSE": "BSD-2-Clause", "GPL-3.0": "GPL-3.0-only", "GPLV3": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only",
    "GPLV2": "GPL-2.0-only", "LGPL-3.0": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "UNLICENSE": "Unlicense", "PROPRIETARY": "NOASSERTION", "NO LICENSE": "NOASSERTION",
}


def lookup(key: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)
    return found if otherwise is None else F.coalesce(found, otherwise)


def lines(code: Column) -> Column:
    """Lines as Rust's str::lines gives them: no empty line after a final line end, no carriage returns."""
    return F.split(F.regexp_replace(code, r"\r?\n\z", ""), r"\r?\n")


def match_lines(text: Column, pattern: str) -> Column:
    """Line, from 1, on which each match of the pattern begins, in order: what stands between the matches is split off and its line ends counted."""
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    between, matched = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(matched, lambda m, i: F.struct(ends(F.get(between, i)).alias("gap"), ends(m).alias("own")))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(steps, start, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["own"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out")))["out"]


def language_of(path: Column) -> Column:
    """Language by the file's extension; null for others."""
    return lookup(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)), EXTENSIONS)


def fingerprint(rule: Column, file: Column, line: Column) -> Column:
    """SHA-256 of rule:file:line. Nulls count as empty."""
    return F.sha2(F.concat_ws(":", F.coalesce(rule, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(line.cast("string"), F.lit(""))), 256)


def state_hash(path: Column, modified: Column, size: Column) -> Column:
    """State of a file for incremental scans: MD5 of path:modified:size."""
    return F.md5(F.concat_ws(":", path, modified.cast("string"), size.cast("string")))


def version_key(version: Column) -> Column:
    """The first three numbers of a version as an array, which compares in order; missing ones are 0."""
    plain = F.regexp_replace(F.trim(version), "^[vV=]", "")
    parts = F.split(plain, r"[-._+]")
    number = lambda k: F.coalesce(F.regexp_replace(F.get(parts, F.lit(k)), r"\D+", "").try_cast("int"), F.lit(0))
    return F.array(number(0), number(1), number(2))


def cvss_severity(score: Column) -> Column:
    """Severity of a CVSS score: 9, 7, 4 and 0.1 are the bounds."""
    return F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 0.1, "low").otherwise("info")


def normalize_license(name: Column) -> Column:
    return lookup(F.upper(F.trim(name)), LICENSES, F.trim(name))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), F.lower(ecosystem), F.lit("/"), name, F.lit("@"), version)


def xml_escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "[_\\-\\s]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), "")


def snake_case(name: Column) -> Column:
    step = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(step, "([a-z0-9])([A-Z])", "$1_$2"), r"[-\s]+", "_"))


NAME = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{1,62})(?![A-Za-z0-9_])"
# Words that are no identifiers.
KEYWORDS = ["if", "else", "for", "while", "return", "def", "class", "import", "from", "in", "is", "not", "and", "or", "None", "True", "False"]


def identifiers(text: Column) -> Column:
    """Distinct names in a text: letters, digits and underscores, 2 to 63 long, begun by a letter or underscore, no keywords."""
    words = F.regexp_extract_all(text, F.lit(NAME), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(KEYWORDS)))


def category_key(rule: Column) -> Column:
    """Family of a rule id for merging across layers, in this order: ai, taint, security (by prefix, or by a weakness in
    the name), the first two steps of rust- and py- ids, else the id itself. Null stays null."""
    low = F.lower(rule)
    security = low.rlike("^(?:sec-|rust-sec-|py-sec-)|injection|xss|sqli|ssrf|cmd|path")  # fixed values
    return (
        F.when(low.startswith("ai-"), "ai").when(low.startswith("taint-"), "taint").when(security, "security")
        .when(low.rlike("^(?:rust|py)-"), F.substring_index(rule, "-", 2)).otherwise(rule)
    )


# The code of each category of markers, and what a rule id of that category holds, in order.
MARKER_CODES = {"security": "SEC", "ai": "AI", "deadcode": "DC", "import": "IMP", "naming": "NAM", "refactor": "REF", "quality": "QAL", "default": ""}
MARKER_WORDS = [("security", "security|^sec"), ("ai", "ai"), ("deadcode", "dead|unused"), ("import", "import"), ("naming", "naming"), ("refactor", "quality|refactor")]


def marker_category(rule: Column) -> Column:
    """Category of a rule id for numbering markers; ids that hold no such word, and null, are `default`."""
    out = F.lit("default")
    for name, words in reversed(MARKER_WORDS):
        out = F.when(F.lower(rule).rlike(words), F.lit(name)).otherwise(out)
    return out


def glob_regex(pattern: str) -> str:
    """Java regular expression of an fnmatch pattern."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i + 1 : j].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]"
            i = j
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return "(?s)^" + out + "$"


def snippet(all_lines: Column, line: Column, before: int = 1, most: int = 3) -> Column:
    """The line and the ones before it, `most` at most."""
    first = F.greatest(line - before, F.lit(1))
    return F.array_join(F.slice(all_lines, first, F.least(F.lit(most), line - first + 1)), "\n")


def line_of_offset(code: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset, from 0."""
    return F.regexp_count(F.substr(code, F.lit(1), offset), F.lit("\n")) + 1
