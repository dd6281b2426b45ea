"""Rules over lines and whole texts: declarative packs, fused into one pass over the text.

The patterns run in Arrow's linear-time matcher on whole column batches: first over the texts, of which nearly
all match few rules, then over the lines of those texts alone. No text becomes a Python string unless it has hits.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule: mode `line` fires on lines that match, `text` on texts that match (at the first match), `absent` on texts
    that match `guard` and not `pattern`. `guard` is a pattern the whole text must match."""

    pack: str
    rule_id: str
    severity: str
    pattern: str
    name: str = ""
    mode: str = "line"
    languages: tuple[str, ...] = ()
    guard: str = ""
    cwe: str = ""
    owasp: str = ""
    confidence: float = 1.0


_OUT = [
    ("file_id", pa.int64()), ("pack", pa.string()), ("rule_id", pa.string()), ("severity", pa.string()), ("line", pa.int64()), ("match", pa.string()), ("col_no", pa.int64()),
    ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("snippet", pa.string()), ("problem", pa.string()), ("cwe_id", pa.string()), ("owasp_id", pa.string()), ("confidence", pa.float64()),
]
FINDING_SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'double' if t == pa.float64() else 'long'}" for n, t in _OUT)


def scan(files: DataFrame, rules: Sequence[Rule], file_id: str, code: str, language: str | None = None, least_confidence: float = 0.0) -> DataFrame:
    """(file_id, pack, rule_id, severity, line, match, col_no, start_byte, end_byte, snippet, problem, cwe_id, owasp_id, confidence) of every hit.

    A line rule gives each line its first match; line and column count from 1 and 0, columns and bytes as UTF-8
    bytes of the text. `problem` is the rule's name, `snippet` the line and the one before it. Rules below
    `least_confidence` and, row by row, rules of other languages are left out. Null and empty texts have no hits
    except by absence rules, which need their guard to match; those point to line 1. Rows are independent and
    repeated rows hit repeatedly; other columns are ignored. No shuffle, but that input of fewer
    partitions than cores is spread over them first.
    """
    chosen = [r for r in rules if r.confidence >= least_confidence]
    if not rules:
        raise ValueError("no rules given")
    lang = F.col(language) if language else F.lit(None)
    rows = files.select(F.col(file_id).cast("long").alias("file_id"), F.col(code).alias("code"), lang.cast("string").alias("lang")).where(F.col("code").isNotNull())

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                found = _scan_batch(batch.slice(k, 2000), chosen)
                if found is not None:
                    yield found

    return spread(rows).mapInArrow(run, FINDING_SCHEMA)


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out to the cores if they come in fewer partitions, as a small file of one row group does.

    Input at scale has more partitions than cores and is left as it is. So is anything behind a shuffle, which AQE parts.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    if any(word in plan for word in ("Exchange", "Join", "Aggregate", "Window", "Sort", "Python", "Arrow", "Pandas")):
        return rows
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _scan_batch(batch: pa.RecordBatch, rules: Sequence[Rule]) -> pa.RecordBatch | None:
    ids, lang = batch.column(0), batch.column(2)
    raw = batch.column(1)
    returns = pc.match_substring(raw, "\r").to_numpy(zero_copy_only=False)
    text = pc.replace_substring(raw, "\r\n", "\n") if returns.any() else raw
    everyone = np.arange(len(raw))
    groups: dict[tuple, tuple] = {(): (everyone, text)}
    tested: dict[tuple, np.ndarray] = {}

    def members(languages: tuple) -> tuple:
        if languages not in groups:
            at = np.flatnonzero(pc.fill_null(pc.is_in(lang, pa.array(languages)), False).to_numpy(zero_copy_only=False))
            groups[languages] = (at, text.take(pa.array(at)))
        return groups[languages]

    def matching(pattern: str, languages: tuple) -> np.ndarray:
        """Rows, among those of the languages, whose text matches somewhere."""
        key = (pattern, languages)
        if key not in tested:
            at, texts = members(languages)
            tested[key] = at[pc.match_substring_regex(texts, "(?m)" + pattern).to_numpy(zero_copy_only=False)] if len(at) else at
        return tested[key]

    hits: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []  # rule, rows, lines from 0, bytes in the line, matches
    waiting: list[tuple[int, np.ndarray]] = []
    for k, r in enumerate(rules):
        if r.mode == "absent":
            at = np.setdiff1d(matching(r.guard, r.languages) if r.guard else members(r.languages)[0], matching(r.pattern, r.languages))
            if len(at):
                hits.append((k, at, np.zeros(len(at), int), np.zeros(len(at), int), pa.array([""] * len(at))))
            continue
        at = matching(r.pattern, r.languages)
        if len(at) and r.guard:
            at = np.intersect1d(at, matching(r.guard, r.languages))
        if not len(at):
            continue
        if r.mode == "text":
            texts = text.take(pa.array(at))
            found = pc.find_substring_regex(texts, "(?m)" + r.pattern).to_numpy(zero_copy_only=False)
            match = pc.struct_field(pc.extract_regex(texts, f"(?m)(?P<m>{r.pattern})"), "m")
            heads = [t.as_py().encode()[:f] for t, f in zip(texts, found)]
            hits.append((k, at, np.array([h.count(b"\n") for h in heads]), np.array([len(h) - h.rfind(b"\n") - 1 for h in heads]), match))
        else:
            waiting.append((k, at))
    if waiting:
        wanted = np.unique(np.concatenate([at for _, at in waiting]))
        split = pc.split_pattern(text.take(pa.array(wanted)), "\n")
        lines, starts = split.values, split.offsets.to_numpy()
        ends = starts[1:].copy()
        ends -= (ends > starts[:-1]) & (pc.binary_length(lines.take(pa.array(np.maximum(ends - 1, 0)))).to_numpy(zero_copy_only=False) == 0)  # no line after the last line end
        for k, at in waiting:
            slots = np.searchsorted(wanted, at)
            sizes = ends[slots] - starts[slots]
            owner = np.repeat(at, sizes)
            number = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            some = lines.take(pa.array(np.repeat(starts[slots], sizes) + number))
            which = np.flatnonzero(pc.match_substring_regex(some, rules[k].pattern).to_numpy(zero_copy_only=False))
            if len(which):
                some = some.take(pa.array(which))
                found = pc.find_substring_regex(some, rules[k].pattern).to_numpy(zero_copy_only=False)
                hits.append((k, owner[which], number[which], found, pc.struct_field(pc.extract_regex(some, f"(?P<m>{rules[k].pattern})"), "m")))
    if not hits:
        return None
    rule = np.concatenate([np.full(len(h[1]), h[0]) for h in hits])
    row, line, inside = (np.concatenate([h[c] for h in hits]).astype(np.int64) for c in (1, 2, 3))
    match = pa.concat_arrays([h[4].cast(pa.string()) for h in hits])
    first = np.zeros(len(row), np.int64)
    snippet: list = [None] * len(row)
    order = np.argsort(row, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
        body = raw[int(row[part[0]])].as_py().encode("utf-8", "surrogatepass")
        begin = np.concatenate([[0], np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1])
        for h in part:
            n = int(line[h])
            first[h] = begin[n]
            stop = begin[n + 1] if n + 1 < len(begin) else len(body)
            snippet[h] = body[begin[max(n - 1, 0)] : stop].decode("utf-8", "replace").replace("\r\n", "\n").rstrip("\n")
    start = first + inside
    of = lambda field: pa.array([getattr(r, field) for r in rules], pa.string()).take(pa.array(rule))
    length = pc.fill_null(pc.binary_length(match), 0).to_numpy(zero_copy_only=False)
    columns = [
        ids.take(pa.array(row)), of("pack"), of("rule_id"), of("severity"), pa.array(line + 1), match, pa.array(inside), pa.array(start), pa.array(start + length),
        pa.array(snippet, pa.string()), of("name"), of("cwe"), of("owasp"), pa.array([r.confidence for r in rules], pa.float64()).take(pa.array(rule)),
    ]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, (_, t) in zip(columns, _OUT)], names=[n for n, _ in _OUT])
