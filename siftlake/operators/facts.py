"""Facts of languages without a parser in the core, by patterns on lines: functions, classes, imports, calls, comments, TODO marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as tx

# By language, the patterns whose first group is the name of a function, a class and an import.
PATTERNS = {
    "javascript": (r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*\(", r"\bclass\s+([A-Za-z_$][\w$]*)", r"^\s*import\b.*?[\"']([^\"']+)[\"']"),
    "typescript": (r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*[<(]", r"\b(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)", r"^\s*import\b.*?[\"']([^\"']+)[\"']"),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]", r"^\s*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)\b", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$"),
    "java": (r"\b(?:public|private|protected|static|final|synchronized)\s+[\w<>\[\], ]+?\s+([a-z_]\w*)\s*\([^;]*\{", r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "rust": (r"\bfn\s+([A-Za-z_]\w*)\s*[<(]", r"\b(?:struct|enum|trait|union)\s+([A-Z]\w*)", r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    "php": (r"\bfunction\s+&?([A-Za-z_]\w*)\s*\(", r"\b(?:class|interface|trait)\s+([A-Z]\w*)", r"^\s*use\s+([\w\\]+)"),
    "ruby": (r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", r"^\s*(?:class|module)\s+([A-Z]\w*)", r"^\s*require(?:_relative)?\s+[\"']([^\"']+)"),
    "csharp": (r"\b(?:public|private|protected|internal|static)\s+[\w<>\[\], ]+?\s+([A-Z]\w*)\s*\([^;]*$", r"\b(?:class|interface|struct|record)\s+([A-Z]\w*)", r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
}
_NO_CALLS = ["if", "for", "while", "switch", "return", "function", "func", "fn", "catch", "match", "def", "class", "new", "not", "and", "or", "in", "print"]


def line_facts(files: DataFrame, file_id: str, code: str, language: str) -> DataFrame:
    """(file_id, kind, name, line): one row per fact. Rows of other languages, nulls and empty texts have none. JVM expressions only."""
    base = files.select(F.col(file_id).alias("file_id"), F.col(language).alias("__lang"), F.posexplode(tx.lines(F.col(code))).alias("n", "__l")).where(F.col("__lang").isin(list(PATTERNS)))
    found = []
    for k, kind in enumerate(("function", "class", "import")):
        name = F.lit("")
        for lang, patterns in PATTERNS.items():
            name = F.when(F.col("__lang") == lang, F.regexp_extract("__l", patterns[k], 1)).otherwise(name)
        found.append(F.when(name != "", F.array(F.struct(F.lit(kind).alias("kind"), name.alias("name")))))
    todo = F.regexp_extract("__l", r"\b(TODO|FIXME|HACK|XXX)\b", 1)
    found.append(F.when(todo != "", F.array(F.struct(F.lit("todo").alias("kind"), todo.alias("name")))))
    comment = F.regexp_extract("__l", r"^\s*(?://+|#|/\*|\*)\s*(.*)$", 1)
    found.append(F.when(comment != "", F.array(F.struct(F.lit("comment").alias("kind"), comment.alias("name")))))
    called = F.filter(F.regexp_extract_all("__l", F.lit(r"([A-Za-z_$][\w$.:]*)\s*\("), F.lit(1)), lambda c: ~c.isin(_NO_CALLS))
    calls = F.transform(F.when(comment == "", called), lambda c: F.struct(F.lit("call").alias("kind"), c.alias("name")))
    none = F.slice(F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("name"))), 1, 0)
    every = F.flatten(F.array(*[F.coalesce(x, none) for x in [*found, calls]]))
    return base.select("file_id", (F.col("n") + 1).cast("bigint").alias("line"), F.inline(every)).select("file_id", "kind", "name", "line")
