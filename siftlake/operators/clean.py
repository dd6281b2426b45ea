"""Rewrites of code as an ordered fold of rules, with guards; inputs are never changed, the result is a column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rewrite:
    """A pattern and what it becomes, in one language or all. `package` is safe, conservative or destructive."""

    name: str
    language: str
    pattern: str
    replacement: str
    package: str = "safe"


# What each rewrite looks for. Each is its own inverse's fixed point: a second run changes nothing.
REWRITES = [
    Rewrite("is-none", "python", r"\s==\s*None\b", " is None"),
    Rewrite("is-not-none", "python", r"\s!=\s*None\b", " is not None"),
    Rewrite("trailing-blanks", "", r"(?m)[ \t]+$", ""),
    Rewrite("true-comparison", "python", r"\s==\s*True\b", "", "conservative"),
    Rewrite("len-zero", "python", r"\bif len\(([A-Za-z_][\w.]*)\) == 0:", "if not $1:", "conservative"),
    Rewrite("yaml-safe-load", "python", r"\byaml\.load\(([^(),]+)\)", "yaml.safe_load($1)", "conservative"),
    Rewrite("print-debug", "python", r"(?m)^[ \t]*print\([\"']DEBUG[^)\n]*\)[ \t]*\n", "", "destructive"),
    Rewrite("console-log", "javascript", r"(?m)^[ \t]*console\.(?:log|debug)\([^()\n]*\);?[ \t]*\n", "", "destructive"),
    Rewrite("debugger", "javascript", r"(?m)^[ \t]*debugger;?[ \t]*\n", "", "destructive"),
    Rewrite("var-to-let", "javascript", r"(?m)^([ \t]*)var ", "$1let ", "destructive"),
]
_PACKAGES = ["safe", "conservative", "destructive"]


def cleaned(files: DataFrame, language: str = "language", code: str = "code", package: str = "safe", rewrites: Sequence[Rewrite] = REWRITES) -> DataFrame:
    """With fixed_code and applied, the names of the rewrites that changed the code, in order.

    Rewrites up to `package` apply one after another. The whole result is refused (refused is
    true, fixed_code the input) if a `__future__` import got lost or an eval, exec or compile
    is new. Null code stays null.
    """
    chosen = [r for p in _PACKAGES[: _PACKAGES.index(package) + 1] for r in rewrites if r.package == p]
    now, names = F.col(code), []
    for r in chosen:
        fits = F.lit(True) if not r.language else F.coalesce(F.col(language) == r.language, F.lit(False))
        names.append(F.when(fits & now.rlike(r.pattern), F.lit(r.name)))
        now = F.when(fits, F.regexp_replace(now, r.pattern, r.replacement)).otherwise(now)
        files = files.withColumn(f"__c{len(names)}", F.array(F.struct(now.alias("code"), names[-1].alias("name"))))
        # A generator keeps each step from being folded into all later ones.
        files = files.select("*", F.inline(f"__c{len(names)}").alias(f"__code{len(names)}", f"__name{len(names)}")).drop(f"__c{len(names)}")
        now, names[-1] = F.col(f"__code{len(names)}"), F.col(f"__name{len(names)}")
    risky = r"\b(?:eval|exec|compile)\s*\("
    lost = F.col(code).contains("from __future__") & ~now.contains("from __future__")
    refused = F.coalesce(lost | (F.regexp_count(now, F.lit(risky)) > F.regexp_count(code, F.lit(risky))), F.lit(False))
    out = files.withColumn("refused", refused).withColumn("fixed_code", F.when(refused, F.col(code)).otherwise(now)).withColumn("applied", F.array_compact(F.array(*names)))
    return out.drop(*[c for c in out.columns if c.startswith(("__code", "__name"))])
