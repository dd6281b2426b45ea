"""Source files that do not parse in their language, by minimum-cost syntax repair.

A file is cut into token classes, its brackets and indented blocks are paired (an unpaired
bracket is an edit), and the nested inputs are parsed by the error-correcting chart parser.
A cost of 0 means that the file parses. Where the edits lie tells what happened to it.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.grammars import CONTEXTUAL, LEXERS, WORDS, _SUFFIXES, grammar
from siftlake.llm.joins import small_side
from siftlake.llm.languages import canonical

LANGUAGES = tuple(LEXERS)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_KIND = {"(": "P", "[": "S", "{": "C", "B": "B"}
_PRIMITIVE = {"int", "long", "double", "float", "boolean", "byte", "char", "short"}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JSON_NUMBER = re.compile(r"(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
#: JavaScript: what can end a statement before a line break, and what goes on from the line before.
_JS_OPEN_ENDED = set("else do try case default => const let var new typeof function if for while extends throw import export in of instanceof delete void class async".split())
_JS_CONTINUES = {".", "?.", ",", ";", "=", "=>", "?", ":", "+", "-", "*", "/", "%", "**", "&", "|", "^", "<<", ">>", ">>>", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "&&", "||", "??", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "in", "instanceof", "~of", "~as", "~from", "~satisfies", "else", "catch", "finally", ")", "]", "}", "~implements", "extends"}
_GO_ENDS = {"ID", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--"}


@lru_cache
def _grammar(language: str):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))
    return grammar(language)


def _symbols(code: str, language: str):
    """(symbol, offset, on a new line) of each token."""
    lexer, words, soft, suffix = LEXERS[language], WORDS[language], CONTEXTUAL[language], re.compile(_SUFFIXES[language])
    js = language in ("javascript", "typescript")
    out, at, n, fresh = [], 0, len(code), True
    previous, parens, condition = None, [], False
    while at < n:
        m = lexer.match(code, at)
        kind, end = m.lastgroup, m.end()
        if kind in ("suffix", "dollar", "hash"):
            kind = "num" if kind == "suffix" else "word" if kind == "dollar" else "string"
        if kind == "nl":
            fresh = True
            if language == "python":
                out.append(("NL", at, True))
        elif kind == "space":
            pass
        elif kind == "comment":
            if language != "python" and "\n" in m.group():
                fresh = True
        else:
            text = m.group()
            if kind == "word":
                symbol = text if text in words else "~" + text if text in soft else "ID"
                if language == "java" and symbol in _PRIMITIVE:
                    symbol = "PRIM"
                elif language == "json" and symbol == "ID":
                    symbol = "BAD"
            elif kind == "num":
                tail = m.group("suffix")
                if language == "python" and tail in ("if", "else", "and", "or", "in", "is", "for", "not"):  # a word right after the digits
                    tail, end = None, m.start("suffix")
                    text = code[at:end]
                symbol = "NUM" if tail is None or suffix.fullmatch(tail) else "BAD"
                if language == "python" and not _PYTHON_NUMBER.fullmatch(text):
                    symbol = "BAD"
                if language == "json" and not _JSON_NUMBER.fullmatch(text):
                    symbol = "BAD"
            elif kind == "string":
                symbol = "TPL" if js and text[0] == "`" else "STR"
                if language == "python" and ("{" in text or "}" in text) and "f" in text[: text.index(text[-1])].lower() and not _fields(text):
                    symbol = "BAD"
            elif kind == "life":
                symbol = "LIFE"
            elif kind == "conflict":
                symbol = "CONFLICT"
            elif kind == "bad":
                symbol = "BAD"
            else:
                symbol = text
                if js and text[0] == "/" and (previous is None or previous == ")" and condition or not (previous in ("ID", "NUM", "STR", "TPL", "REGEX", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--") or previous[0] == "~")):
                    r = _REGEX.match(code, at)
                    if r:
                        symbol, end = "REGEX", r.end()
            if js and symbol == "(":
                parens.append(previous in ("if", "while", "for", "with"))
            elif js and symbol == ")":
                condition = bool(parens) and parens.pop()  # what follows begins a statement, not a division
            out.append((symbol, at, fresh))
            previous, fresh = symbol, False
        at = end
    return out


_PYTHON_NUMBER = re.compile(r"(?i:0x(?:_?[0-9a-f])+|0o(?:_?[0-7])+|0b(?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)j?|(?:[0-9](?:_?[0-9])*)(?=[.ej])(?:\.(?:[0-9](?:_?[0-9])*)?)?(?:e[+-]?[0-9](?:_?[0-9])*)?j?|\.[0-9](?:_?[0-9])*(?:e[+-]?[0-9](?:_?[0-9])*)?j?)")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", re.S)


def _fields(literal: str) -> bool:
    """Whether the replacement fields of a Python literal hold expressions: each is parsed by the grammar, formats within formats too."""
    body = literal.lstrip("rRbBfFuUtT")
    quote = 3 if body[:3] in ('\"\"\"', "'''") else 1
    return _fields_of(body[quote:-quote], True)


def _fields_of(text: str, top: bool) -> bool:
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c == "}":
            if not top or text[i : i + 2] != "}}":
                return False
            i += 2
        elif c != "{":
            i += 2 if c == "\\" and text[i : i + 2] != "\\{" else 1
        elif top and text[i : i + 2] == "{{":
            i += 2
        else:
            depth, j, colon, end = 0, i + 1, None, None
            while j < n:
                m = _QUOTED.match(text, j) if text[j] in "'\"" and colon is None else None
                if m:
                    j = m.end()
                    continue
                d = text[j]
                if d in "([{":
                    depth += 1
                elif d in ")]}":
                    if depth == 0:
                        end = j
                        break
                    depth -= 1
                elif d == ":" and depth == 0 and colon is None and text[j + 1 : j + 2] != "=":
                    colon = j
                j += 1
            if end is None or text[end] != "}":
                return False
            inner = text[i + 1 : end if colon is None else colon]
            m = re.fullmatch(r"(?s)(.*?)\s*(?<![=!<>])(?:=\s*)?(?:![rsa])?\s*", inner)
            expression = m.group(1) if m else inner
            if not expression.strip() or not _expression(expression) and not _expression(inner):
                return False
            if colon is not None and not _fields_of(text[colon + 1 : end], False):
                return False
            i = end + 1
    return True


def _expression(text: str) -> bool:
    g, _ = _grammar("python")
    parsed = parse(f"({text}\n)", "python")
    return not parsed.edits and len(parsed.content) == 2 and type(parsed.content[0]) is tuple and g.fits("group", g.by_id[parsed.content[0][1]])


class Parsed:
    """A file as nested inputs: content, edits of brackets as (offset, kind), and the start of each token at the top."""

    def __init__(self):
        self.edits: list[tuple[int, str]] = []
        self.content: tuple = ()
        self.starts: list[int] = []
        self.conflicts = 0


def parse(code: str, language: str) -> Parsed:
    """Pair the brackets and indented blocks of a file."""
    g, _ = _grammar(language)
    tokens = _symbols(code, language)
    out = Parsed()
    stack: list[list] = [["", [], 0]]  # opener, items, offset
    js, go, python, rust = language in ("javascript", "typescript"), language == "go", language == "python", language == "rust"
    indents = [0]
    line_open = False  # Python: within a logical line
    colon = False
    before = None
    top: list[int] = []

    def close():
        opener, items, _ = stack.pop()
        group = (_KIND[opener], g.intern(tuple(items)))
        push(group, _)

    def push(item, offset):
        items = stack[-1][1]
        if rust and type(item) is tuple and item[0] != "B" and len(items) >= 2:
            if items[-1] == "!" and _is_name(items[-2]):
                items.pop()
                _drop_path(items)
                item = "MACRO"
            elif len(items) >= 3 and items[-2] == "!" and items[-1] == "ID" and items[-3] == "ID":  # macro_rules! name { }
                del items[-3:]
                item = "MACRO"
        items.append(item)
        if len(stack) == 1:
            top.append(offset)
            del top[: max(0, len(top) - len(items))]

    for symbol, offset, fresh in tokens:
        if symbol == "CONFLICT":
            out.conflicts += 1
        if python:
            inside = stack[-1][0] not in ("", "B")
            if symbol == "NL":
                if line_open and not inside:
                    push("NL", offset)
                    line_open = False
                continue
            if not line_open and not inside:
                begin = code.rfind("\n", 0, offset) + 1
                width = len(code[begin:offset].expandtabs(8))
                if width > indents[-1]:
                    if colon:
                        indents.append(width)
                        stack.append(["B", [], offset])
                    else:
                        push("BAD", offset)
                else:
                    while width < indents[-1]:
                        indents.pop()
                        close()
                    if width != indents[-1]:
                        push("BAD", offset)
                line_open = True
            colon = symbol == ":"
        elif fresh and before is not None and js and stack[-1][0] in ("", "{"):
            items = stack[-1][1]
            last = items[-1] if items else None
            if last is not None and symbol not in _JS_CONTINUES and symbol not in ("(", "[", "TPL") and not _js_goes_on(items):
                push("ASI", offset)
            elif last is not None and symbol in ("(", "[") and type(last) is tuple and last[0] == "C":
                pass
        elif fresh and go and before is not None:
            last = stack[-1][1][-1] if stack[-1][1] else None
            if last is not None and (type(last) is tuple or last in _GO_ENDS):
                push(";", offset)
        if symbol in _OPEN:
            stack.append([symbol, [], offset])
        elif symbol in _CLOSE:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == _CLOSE[symbol] or stack[d][0] == "B"), 0)
            if depth and stack[depth][0] != "B":
                while len(stack) - 1 > depth:
                    out.edits.append((stack[-1][2], "unclosed"))
                    close()
                close()
            else:
                out.edits.append((offset, "unopened"))
        else:
            push(symbol, offset)
        before = symbol
    if python and line_open and stack[-1][0] in ("", "B"):
        push("NL", len(code))
    while len(stack) > 1:
        if stack[-1][0] != "B":
            out.edits.append((stack[-1][2], "unclosed at the end"))
        elif python and line_open and stack[-1][1] and stack[-1][1][-1] != "NL":
            push("NL", len(code))
        close()
    items = stack[0][1]
    if python and items and items[-1] != "NL" and not (type(items[-1]) is tuple and items[-1][0] == "B"):
        items.append("NL")
    if go and items and items[-1] != ";":
        items.append(";")
    out.content = tuple(items)
    return out


def _is_name(item) -> bool:
    return type(item) is str and (item == "ID" or item[0] == "~")


def _drop_path(items: list) -> None:
    items.pop()
    while len(items) >= 2 and items[-1] == "::" and (_is_name(items[-2]) or items[-2] in ("crate", "self", "super")):
        del items[-2:]


def _js_goes_on(items: list) -> bool:
    """Whether the tokens before a line break cannot end a statement there."""
    last = items[-1]
    if type(last) is tuple:
        return last[0] == "P" and len(items) > 1 and (items[-2] in ("if", "for", "while", "with") or items[-2] == "await" and len(items) > 2 and items[-3] == "for")
    return last in _JS_OPEN_ENDED or last in (";", "ASI") or last in _JS_CONTINUES and last not in (")", "]", "}") and last[0] != "~" or last in ("(", "[", "{", "!", "~", "...", "@")


def repair(code: str, language: str, most: int | None = None) -> tuple[int, str | None, int]:
    """(cost, what happened, line of the first edit) of a file; cost 0 means that it parses.

    What happened is conflict (a merge marker outside strings and comments), truncation (all
    edits at the end), mismatch (edits all over: another language, or no code) or local.
    Each piece of the file costs its least number of edits, however many; with `most`, that of the pieces in all is
    looked for up to `most` and counts one more beyond. Whether the cost is 0 doesn't depend on it. Empty files parse.
    """
    if not code.strip():
        return (0 if language != "json" or code == "" else 1), None, 1
    g, start = _grammar(language)
    if len(g.good) > 400_000:
        g.forget()
    parsed = parse(code, language)
    missing = _missing(parsed.content, language)
    if not parsed.edits and not missing and g.fits(start, parsed.content):
        return 0, None, 0
    inner = g.cost(start, parsed.content, most)
    cost = len(parsed.edits) + inner + missing
    pieces = g.cut(parsed.content) if g.cut and start in g.lists else [parsed.content]
    rule = g.lists.get(start, start)
    wrong = [k for k, piece in enumerate(pieces) if not g.fits(rule, piece)]
    at_end = [o for o, kind in parsed.edits if kind == "unclosed at the end"]
    if parsed.conflicts:
        what = "conflict"
    elif len(at_end) == len(parsed.edits) and at_end and wrong in ([], [len(pieces) - 1]) or not parsed.edits and wrong == [len(pieces) - 1] and not code.rstrip(" \t").endswith("\n"):
        what = "truncation"
    elif len(pieces) >= 3 and len(wrong) > 0.4 * len(pieces):
        what = "mismatch"
    else:
        what = "local"
    first = min([o for o, _ in parsed.edits], default=0)
    return cost, what, code.count("\n", 0, first) + 1


def _missing(content: tuple, language: str) -> int:
    """Edits that the grammar of statements leaves open: a Go file's package clause, and names of JavaScript's declared functions and classes."""
    if language == "go":
        return int(next((t for t in content if t != ";"), None) != "package")
    if language not in ("javascript", "typescript"):
        return 0
    kind = lambda k: content[k][0] if k < len(content) and type(content[k]) is tuple else content[k] if k < len(content) else None
    n = 0
    for k, token in enumerate(content):
        if token in ("class", "function") and (k == 0 or content[k - 1] in (";", "ASI")):
            n += kind(k + 1) == ("C" if token == "class" else "P")
    return n


def repairs(files: DataFrame, listed: DataFrame, file_id: str = "file_id", code: str = "code", most: int | None = None) -> DataFrame:
    """(file_id, language, cost, what, line) of each file in a language there is a grammar for.

    `listed` has file_id and language. Null code and files without a language are left out,
    text and unknown have no grammar. Who asks only whether files parse, or what happened to them, sets `most` and is spared
    the search for greater costs. Repeated rows come out repeatedly.
    """
    rows = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(code).alias("code")).where(F.col("code").isNotNull())
    named = listed.select("file_id", canonical(F.col("language")).alias("language")).where(F.col("language").isin(*LANGUAGES))
    # Few bytes a file: as long as they may be broadcast, the code itself is not shuffled.
    rows = rows.join(small_side(named), "file_id")
    schema = pa.schema([("file_id", pa.int64()), ("language", pa.string()), ("cost", pa.int64()), ("what", pa.string()), ("line", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, codes, languages = (batch.column(c).to_pylist() for c in ("file_id", "code", "language"))
            out = [(i, lang, *repair(c, lang, most)) for i, c, lang in zip(ids, codes, languages)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return rows.select("file_id", "code", "language").mapInArrow(run, "file_id long, language string, cost long, what string, line long")


def rates(repaired: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, language, files, broken, rate, truncated, conflicts, mismatched): per repository and language. `repos` has file_id and repo."""
    count = lambda what: F.count_if(F.col("what") == what)
    return repaired.join(repos.select("file_id", "repo"), "file_id").groupBy("repo", "language").agg(
        F.count("*").alias("files"), F.count_if(F.col("cost") > 0).alias("broken"), F.round(F.avg((F.col("cost") > 0).cast("int")), 6).alias("rate"),
        count("truncation").alias("truncated"), count("conflict").alias("conflicts"), count("mismatch").alias("mismatched"),
    )
