"""Differences of two texts, comments in the manner of a language, and measures of short texts."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What opens and closes a comment, by language; # for others.
COMMENTS = {"javascript": ("// ", ""), "typescript": ("// ", ""), "go": ("// ", ""), "java": ("// ", ""), "rust": ("// ", ""), "csharp": ("// ", ""), "php": ("// ", ""), "html": ("<!-- ", " -->"), "css": ("/* ", " */")}


def diffs(files: DataFrame, file_id: str, before: str, after: str, context: int = 3) -> DataFrame:
    """(file_id, diff, added, removed, ranges) of each row whose texts differ: a unified diff, the numbers of lines added and removed,
    and the (first, last) lines of the new text that changed; a removal has the line before it. Null counts as empty."""
    schema = pa.schema([("file_id", pa.int64()), ("diff", pa.string()), ("added", pa.int32()), ("removed", pa.int32()), ("ranges", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])

    def run(batches):
        for batch in batches:
            out = []
            for i, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (a or "").splitlines(), (b or "").splitlines()
                ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
                if ops:
                    text = "\n".join(difflib.unified_diff(a, b, "before", "after", lineterm="", n=context))
                    ranges = [{"first": max(j1 + 1 if j2 > j1 else j1, 0), "last": j2} for _, _, _, j1, j2 in ops]
                    out.append({"file_id": i, "diff": text, "added": sum(o[4] - o[3] for o in ops), "removed": sum(o[2] - o[1] for o in ops), "ranges": ranges})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = files.where(~F.col(before).eqNullSafe(F.col(after))).select(F.col(file_id).cast("long").alias("file_id"), before, after)
    return rows.mapInArrow(run, "file_id long, diff string, added int, removed int, ranges array<struct<first:int,last:int>>")


def as_comment(text: Column, language: Column) -> Column:
    """The text as a comment of the language; line ends become blanks."""
    flat, out = F.regexp_replace(text, r"\s*\n\s*", " "), F.concat(F.lit("# "), F.regexp_replace(text, r"\s*\n\s*", " "))
    for name, (opening, closing) in COMMENTS.items():
        out = F.when(language == name, F.concat(F.lit(opening), flat, F.lit(closing))).otherwise(out)
    return out


def percent_encoded(text: Column) -> Column:
    """The text with all but letters, digits and -._~ as percent signs and hexadecimal bytes."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 of an empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def shortened(text: Column, most: int = 80) -> Column:
    """The first characters, with three points if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def vector_parts(vector: Column) -> Column:
    """The metrics of a CVSS vector as a map, such as AV to N; null if it has none."""
    pairs = F.regexp_extract_all(F.upper(vector), F.lit("([A-Z]{1,3}:[A-Z])(?:/|$)"), F.lit(1))
    return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)), F.split_part(p, F.lit(":"), F.lit(2))))))
