"""The severity rank tables. They disagree on purpose; each operator uses its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank of each spelling, and the rank of any other text, by operator.
RANKS = {
    "threshold": ({"critical": 5, "crit": 5, "high": 4, "error": 4, "medium": 3, "warn": 3, "warning": 3, "low": 2, "info": 1, "note": 1, "hint": 1}, 0),
    "dedup": ({"critical": 5, "high": 4, "medium": 3, "moderate": 3, "low": 2, "info": 1, "informational": 1}, 0),
    "cross_layer": ({"critical": 5, "high": 4, "medium": 3, "low": 2}, 1),
    "ai_sort": ({"critical": 5, "high": 4, "medium": 3, "low": 2}, 1),
    "marker_order": ({"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}, 5),
    "score_weight": ({"critical": 20, "high": 10, "medium": 5, "low": 1, "info": 0}, 0),
}
# The level that any of the tables' spellings stands for, ranked as dedup ranks the five levels.
RANKS["level"] = ({**RANKS["threshold"][0], **RANKS["dedup"][0]}, 0)
SARIF_LEVEL = ({"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}, "warning")
SARIF_CVSS = ({"critical": 9.8, "high": 7.8, "medium": 5.0, "low": 2.0, "info": 0.0}, 5.0)
CODECLIMATE = ({"critical": ("critical", 50000), "high": ("critical", 50000), "medium": ("major", 10000)}, ("minor", 10000))
SONAR = ({"critical": ("CRITICAL", 120), "high": ("MAJOR", 60), "medium": ("MAJOR", 30), "low": ("MINOR", 10), "info": ("INFO", 5)}, ("MAJOR", 30))
CANONICAL = {5: "critical", 4: "high", 3: "medium", 2: "low", 1: "info"}


def lookup(col: Column | str, mapping: dict, default) -> Column:
    """mapping[lower(trim(col))], or default; null counts as any other text."""
    key = F.lower(F.trim(F.col(col) if isinstance(col, str) else col))
    out = F.lit(default)
    branches = None
    for value in dict.fromkeys(mapping.values()):
        names = [k for k, v in mapping.items() if v == value]
        branches = (F if branches is None else branches).when(key.isin(*names), F.lit(value))
    return out if branches is None else branches.otherwise(out)


def rank(col: Column | str, table: str) -> Column:
    """Rank of a severity by one of the tables in RANKS."""
    mapping, default = RANKS[table]
    return lookup(col, mapping, default)
