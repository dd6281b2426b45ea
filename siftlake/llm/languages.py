"""The project's names for languages, and the language a file was last scanned as."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Other names of the languages; what is none of them counts as text.
ALIASES = {
    "py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ecmascript": "javascript", "mjs": "javascript",
    "ts": "typescript", "golang": "go", "rs": "rust", "c#": "csharp", "cs": "csharp", "rb": "ruby",
    "unknown": "text", "plain": "text", "plaintext": "text", "txt": "text",
}


def canonical(language):
    """One name for each language, in lower case."""
    name = F.lower(F.trim(language))
    out = name
    for alias, to in ALIASES.items():
        out = F.when(name == alias, to).otherwise(out)
    return out


def file_languages(scans: DataFrame) -> DataFrame:
    """(file_id, language): of the newest scan that names one (ties: the greatest name). Files without any are left out."""
    named = scans.where("file_id is not null and trim(language) <> ''").select("file_id", canonical(F.col("language")).alias("language"), "scanned_at")
    return named.groupBy("file_id").agg(F.max_by("language", F.struct("scanned_at", "language")).alias("language"))
