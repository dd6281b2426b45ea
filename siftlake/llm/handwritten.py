"""Files that are not hand-written source: generated, minified, vendored, or data saved as code.

Generation and distribution notices in the comments that open or close a file are matched with
an Aho-Corasick automaton; path rules know vendored folders, lock files and the suffixes of
generators and minifiers; the shape of the code settles what bears neither.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notices in lower case with single blanks. Positive ones name a kind, "own" ones speak against any notice on the line.
NOTICES = {
    "generated": ["code generated by", "@generated", "<auto-generated", "autogenerated", "auto-generated", "auto generated", "automatically generated", "machine generated", "machine-generated", "this file was generated", "this file is generated", "file generated by", "this file was produced by", "changes will be lost", "will be overwritten", "end of output of", "generated by the protocol buffer", "generated from specs", "do not edit", "do not modify", "instead of editing"],
    "vendored": ["contributors - released under", "authors. mit licensed", "is part of the", "upstream:", "authors. licensed under", "authors. all rights", "licensed under the", "released under"],
    "own": ["by hand", "hand-written", "handwritten", "not generated", "generated from this file", "are generated from", "is generated from this"],
}

_FOLDERS = {"node_modules", "bower_components", "third_party", "third-party", "thirdparty", "godeps", "_vendor", "jspm_packages", "site-packages", "pods", "carthage", "_workspace", "externals"}
#: Ordinary words too: they count at the top of the repository, or before a folder named like a release.
_MAYBE_FOLDERS = {"vendor", "external", "contrib", "deps", "extern", "ext", "3rdparty", "vendors"}
_RELEASE = re.compile(r"^[a-z][a-z0-9._-]*?[-@_]v?\d+\.\d+(?:\.\d+)*", re.I)
_PACKAGE = re.compile(r"[-_@.\d]")
_LOCKS = {"package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "poetry.lock", "pipfile.lock", "gemfile.lock", "composer.lock"}
_GENERATED_NAME = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|rs)|_pb\.(?:js|ts|rb)|_grpc_pb\.js|grpc\.java|outerclass\.java|_gen\.(?:go|rs|py|ts|js|java)|\.gen\.\w+|\.generated\.\w+|\.g\.(?:dart|cs)|\.designer\.cs|_generated\.\w+|\.pb2\.py|_string\.go)$", re.I)
_GRPC = re.compile(r"[a-z0-9](?:Grpc|OuterClass)\.java$")
_MINIFIED_NAME = re.compile(r"[-._](?:min|bundle|packed|prod\.min|chunk)\.(?:m?js|cjs|css)$", re.I)

_OPENING = re.compile(r"\A(?:﻿|#![^\n]*\n|\s+|<\?php|(?:#|//|--|;)[^\n]*(?:\n|\Z)|/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"(?=\s*\Z))*", re.S)
_LEXEME = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![\w&])#(?!\[|!\[)[^\n]*)"
    r"|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|`[^`]*(?:`|\Z)|\"(?:[^\"\\\n]|\\.)*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))"
    r"|(?P<number>\b\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<space>\s+)|(?P<other>.)", re.S,
)


@lru_cache
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, phrases in NOTICES.items():
        for phrase in phrases:
            machine.add_word(phrase, (kind, phrase))
    machine.make_automaton()
    return machine


def notices(code: str, repo: str = "") -> str | None:
    """The kind of notice in the comments that open or close the file, if any."""
    head = _OPENING.match(code).group()
    tail = []
    for line in reversed(code.rstrip().split("\n")):
        if not re.match(r"\s*(?:#|//|/?\*|--)", line):
            break
        tail.append(line)
    machine, found = _automaton(), Counter()
    own_name = repo.rsplit("/", 1)[-1].lower().replace("_", "-")
    for line in [*head.split("\n"), *tail]:
        text = " ".join(line.lower().split())
        hits = {value for _, value in machine.iter(text)}
        kinds = {kind for kind, _ in hits}
        if "own" in kinds:
            return None
        if len(own_name) > 2 and re.search(rf"(?<![a-z0-9-]){re.escape(own_name)}(?![a-z0-9-])", text.replace("_", "-")):
            kinds.discard("vendored")
        found.update(kinds)
    if found["generated"]:
        return "generated"
    if found["vendored"] and (re.search(r"(?i)\bv?\d+\.\d+(?:\.\d+)?\b", head) or re.search(r"(?i)copyright|\(c\)|spdx", head)):
        return "vendored"
    return None


def path_kind(path: str) -> str | None:
    """What the path alone says: vendored, generated or minified."""
    steps = [s for s in re.split(r"[/\\]", path) if s not in ("", ".")]
    if not steps:
        return None
    name, folders = steps[-1], steps[:-1]
    for k, step in enumerate(folders):
        low = step.lower()
        following = folders[k + 1] if k + 1 < len(folders) else ""
        if low in _FOLDERS or _RELEASE.match(step) and re.search(r"\d+\.\d+\.\d+", step):
            return "vendored"
        if low in _MAYBE_FOLDERS and following and (_RELEASE.match(following) or k == 0 and (_PACKAGE.search(following) or len(folders) > k + 1)):
            return "vendored"
    if name.lower() in _LOCKS:
        return "generated"
    if _GRPC.search(name) or _GENERATED_NAME.search(name) and not name.lower().endswith(("grpc.java", "outerclass.java")):
        return "generated"
    return "minified" if _MINIFIED_NAME.search(name) else None


def shape_kind(code: str) -> str | None:
    """What the shape of the code says: minified, data, or generated by template."""
    if len(code) < 200:
        return None
    chars, one, words, plain, strings = Counter(), 0, 0, [], []
    for m in _LEXEME.finditer(code):
        kind, text = m.lastgroup, m.group()
        chars[kind] += len(text)
        if kind == "word":
            words += 1
            one += len(text) == 1
        if kind == "string":
            strings.append(text)
            plain.append('""')
        elif kind != "comment":
            plain.append(text)
    body = "".join(plain)
    dense = sum(chars[k] for k in ("string", "number", "word", "other"))
    if not dense:
        return None
    lines = [x for x in body.split("\n") if x.strip()]
    longest = max(map(len, lines), default=0)
    blank = chars["space"] / (dense + chars["space"])
    if longest >= 150 and blank < 0.12 and words and one / words > 0.35:
        return "minified"
    if longest >= 500 and blank < 0.10 and chars["word"] > 0.25 * dense:
        return "minified"
    # Data: hardly a word of code outside literals, and the literals are no prose.
    data = chars["string"] + chars["number"]
    if chars["word"] < 0.16 * dense and data > 0.45 * dense and len(code) > 400:
        texts = " ".join(strings)
        prose = len(re.findall(r"(?<![\w])[a-z]{2,}(?: [a-z]{2,}){4,}", texts))
        if prose * 200 < len(texts) + 1:
            return "data"
    # Template: few shapes of line over and over, told apart by running numbers.
    shapes = Counter(re.sub(r"[A-Za-z_$][A-Za-z_$]*", "w", re.sub(r"\d+", "9", x.strip())) for x in lines)
    if len(lines) >= 10:
        top = sum(n for _, n in shapes.most_common(4)) / len(lines)
        numbered = sum(bool(re.search(r"[A-Za-z_]\d+\b|\[\d+\]", x)) for x in lines) / len(lines)
        if top > 0.8 and numbered > 0.7:
            return "generated"
    return None


def kind_of(path: str | None, code: str | None, repo: str | None = None) -> str | None:
    """vendored, generated, minified or data; None for hand-written source. Null and empty code goes by its path."""
    code = code or ""
    return path_kind(path or "") or notices(code, repo or "") or shape_kind(code)


def classify(files: DataFrame, file_id: str = "file_id", path: str = "path", code: str = "code", repo: str = "repo") -> DataFrame:
    """(file_id, kind) of each row that is not hand-written. Rows are told apart by themselves: no shuffle.

    Any null is allowed; repeated rows come out repeatedly; other columns are ignored.
    """
    rows = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(path).alias("path"), F.col(code).alias("code"), F.col(repo).alias("repo"))

    def run(batches):
        for batch in batches:
            ids, paths, codes, repos = (c.to_pylist() for c in batch.columns)
            kinds = [kind_of(p, c, r) for p, c, r in zip(paths, codes, repos)]
            keep = [k for k, kind in enumerate(kinds) if kind]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([kinds[k] for k in keep])], ["file_id", "kind"])

    return rows.mapInArrow(run, "file_id long, kind string")
