"""Dependencies against knowledge bases: version ranges, names, licences, bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as tx

# Licences that a policy forbids or that ask for source.
PROHIBITED = ["AGPL-3.0-only", "SSPL-1.0"]
COPYLEFT = ["GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0"]


def vulnerable(packages: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Packages with each vulnerability whose range holds their version: introduced <= version < fixed, by the first three numbers.

    An equi join on ecosystem and name, in lower case, with the range as its condition. A null bound is open; a null version matches nothing.
    """
    p = packages.select("ecosystem", "name", "version", F.lower("ecosystem").alias("e"), F.lower("name").alias("k"))
    v = vulnerabilities.select("vuln_id", "introduced", "fixed", "severity", F.lower("ecosystem").alias("e"), F.lower("package").alias("k"))
    at, lo, hi = tx.version_key(F.col("version")), tx.version_key(F.col("introduced")), tx.version_key(F.col("fixed"))
    inside = F.col("version").isNotNull() & (F.col("introduced").isNull() | (lo <= at)) & (F.col("fixed").isNull() | (at < hi))
    return p.join(v, ["e", "k"]).where(inside).select("ecosystem", "name", "version", "vuln_id", "severity", "fixed")


def names_contained(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 4) -> DataFrame:
    """Distinct (a, b) of which either contains the other, as substring.

    Each name is spread into its substrings that are as long as some name of the other side
    can be, and joined by equality: no pair is compared that doesn't match. Names shorter than `least` match by equality only.
    """
    x, y = left.select(F.col(a).alias("a")).where("a is not null").distinct(), right.select(F.col(b).alias("b")).where("b is not null").distinct()

    def inside(long: DataFrame, c: str, short: DataFrame, s: str) -> DataFrame:
        # The lengths that occur on the short side, all of them: at most as many as the longest name has characters.
        sizes = sorted(r[0] for r in short.select(F.length(s)).where(F.length(s) >= least).distinct().collect())

        def of_length(n: int):
            pieces = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, F.lit(n)))
            return F.when(F.length(c) >= n, pieces).otherwise(none)

        none = F.array().cast("array<string>")
        parts = F.array_distinct(F.flatten(F.array(*[of_length(n) for n in sizes]))) if sizes else none
        spread = long.select(c, F.explode(parts).alias("__part"))
        return spread.join(short, spread["__part"] == short[s]).select(c, s)

    one = inside(x, "a", y, "b").select("a", "b")
    two = inside(y, "b", x, "a").select("a", "b")
    equal = x.join(y, x.a == y.b).select("a", "b")
    return one.union(two).union(equal).distinct()


def license_status(packages: DataFrame, licenses: DataFrame, approved: list[str] | None = None) -> DataFrame:
    """Each package with its licence and whether it is prohibited, copyleft, undeclared, approved or to review, in this precedence."""
    known = licenses.select(F.lower("package").alias("k"), tx.normalize_license(F.col("license")).alias("spdx_id"))
    joined = packages.withColumn("k", F.lower("name")).join(known, "k", "left").drop("k")
    s = F.col("spdx_id")
    status = (
        F.when(s.isin(PROHIBITED), "prohibited").when(s.isin(COPYLEFT), "copyleft").when(s.isNull() | (s == "NOASSERTION"), "undeclared")
        .when(F.lit(True) if approved is None else s.isin(approved), "approved").otherwise("review")
    )
    return joined.withColumn("status", status)


def detected_license(code) -> object:
    """Licence of a text: an SPDX tag, else a `License:` line, else the first line if it names a known licence."""
    tag = F.nullif(F.regexp_extract(code, r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)", 1), F.lit(""))
    line = F.nullif(F.regexp_extract(code, r"(?mi)^\W*license:\s*([^\r\n]+)", 1), F.lit(""))
    first = F.upper(F.trim(F.get(F.split(code, "\n"), F.lit(0))))
    return F.coalesce(tag, tx.normalize_license(line), tx.lookup(first, tx.LICENSES))


def sbom_cyclonedx(packages: DataFrame, serial: str = "urn:uuid:00000000-0000-0000-0000-000000000000") -> DataFrame:
    """One JSON document (CycloneDX 1.4) of the packages of each path."""
    component = F.struct(F.lit("library").alias("type"), F.col("name"), F.col("version"), tx.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"))
    return packages.groupBy("path").agg(F.array_sort(F.collect_list(component)).alias("components")).select(
        "path", F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.4").alias("specVersion"), F.lit(serial).alias("serialNumber"), F.lit(1).alias("version"), "components")).alias("sbom")
    )


def sbom_spdx(packages: DataFrame) -> DataFrame:
    """One JSON document (SPDX 2.3) of the packages of each path."""
    package = F.struct(
        F.concat(F.lit("SPDXRef-"), F.regexp_replace(F.concat_ws("-", "name", "version"), "[^A-Za-z0-9.-]", "-")).alias("SPDXID"), F.col("name"),
        F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), tx.purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("referenceLocator"))).alias("externalRefs"),
    )
    return packages.groupBy("path").agg(F.array_sort(F.collect_list(package)).alias("packages")).select(
        "path", F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.col("path").alias("name"), "packages")).alias("sbom")
    )
