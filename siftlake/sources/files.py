"""Files as tables: directory walks, encodings, lock files and dependency manifests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as tx

# Folders that a walk skips, and the ecosystem of each lock file.
SKIPPED = ["__pycache__", ".venv", "venv", ".git", "node_modules", "target", "dist", "build"]
LOCK_FILES = {
    "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "Cargo.lock": "cargo", "go.sum": "go", "requirements.txt": "pypi",
    "Pipfile.lock": "pypi", "poetry.lock": "pypi", "Gemfile.lock": "rubygems", "composer.lock": "composer",
}


def directory(spark: SparkSession, path: str, exclude: Iterable[str] = (), pattern: str | None = None) -> DataFrame:
    """(path, ext, language, code, modified, size) of the files below a folder.

    Bytes are decoded as UTF-8 without its mark, or else as Latin-1; files in skipped folders and those whose path contains an excluded part are left out before they are read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    for part in exclude:
        files = files.where(~F.col("path").contains(part))
    for folder in SKIPPED:
        files = files.where(~F.col("path").contains(f"/{folder}/"))
    code = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return files.select(
        "path", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"), tx.language_of(F.col("path")).alias("language"),
        F.regexp_replace(code, "^﻿", "").alias("code"), F.unix_micros("modificationTime").alias("modified"), F.col("length").alias("size"),
    )


def lock_files(files: DataFrame, depth: int = 5) -> DataFrame:
    """The lock files among them with their ecosystem, to a depth of folders, by ecosystem."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.withColumn("ecosystem", tx.lookup(name, LOCK_FILES))
    return found.where(F.col("ecosystem").isNotNull() & (F.size(F.split("path", "/")) - 1 <= depth)).orderBy("ecosystem", "path")


def _package(name: Column, version: Column, hashed: Column, url: Column) -> Column:
    none = F.lit(None).cast("string")
    url = none if url is None else url
    return F.struct(
        name.alias("name"), version.alias("version"), hashed.alias("integrity"), url.alias("resolved"),
        F.coalesce(url.startswith("git+"), F.lit(False)).alias("from_git"), F.coalesce(url.startswith("http:"), F.lit(False)).alias("from_http"),
    )


def npm_packages(locks: DataFrame) -> DataFrame:
    """(path, name, version, integrity, resolved, from_git, from_http) of package-lock.json files of either layout.

    Entries come from `packages` below node_modules/, or else from `dependencies`. A missing version is *. Broken JSON gives none.
    """
    entry = "struct<version:string,integrity:string,resolved:string>"
    doc = F.from_json("code", f"packages map<string,{entry}>, dependencies map<string,{entry}>")
    parsed = locks.select("path", doc.alias("d"))
    modern = F.map_filter(F.coalesce("d.packages", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{entry}>"))), lambda k, v: k.contains("node_modules/"))
    both = F.when(F.size(modern) > 0, modern).otherwise(F.col("d.dependencies"))
    rows = parsed.select("path", F.explode(both).alias("k", "v"))
    name = F.element_at(F.split("k", "node_modules/"), -1)
    return rows.select("path", F.inline(F.array(_package(name, F.coalesce("v.version", F.lit("*")), F.col("v.integrity"), F.col("v.resolved")))))


def integrity(packages: DataFrame) -> DataFrame:
    status = F.when(F.col("from_git"), "GitSource").when(F.col("from_http"), "HttpSource").when(F.col("integrity").isNull(), "MissingHash").otherwise("Valid")
    return packages.withColumn("status", status)


def cargo_packages(locks: DataFrame) -> DataFrame:
    block = locks.select("path", F.explode(F.slice(F.split("code", r"\[\[package\]\]"), 2, 1 << 30)).alias("b"))
    one = lambda field: F.nullif(F.regexp_extract("b", rf'(?m)^\s*{field}\s*=\s*"([^"]*)"', 1), F.lit(""))
    return block.select("path", F.inline(F.array(_package(one("name"), one("version"), one("checksum"), one("source"))))).where("name is not null")


def go_sums(locks: DataFrame, compat: bool = False) -> DataFrame:
    """(path, name, version, hash, status): the hash is the last column of a line (with `compat` the second), must begin with h1: and not be short."""
    line = locks.select("path", F.explode(tx.lines(F.col("code"))).alias("l")).where("trim(l) <> ''")
    parts = F.split(F.trim("l"), r"\s+")
    hashed = F.get(parts, F.lit(1)) if compat else F.element_at(parts, -1)
    status = F.when(F.size(parts) < 3, "InvalidHash").when(~hashed.startswith("h1:"), "InvalidHash").when(F.length(hashed) < 10, "Warning").otherwise("Valid")
    return line.select("path", F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("version"), hashed.alias("hash"), status.alias("status"))


def requirements(locks: DataFrame) -> DataFrame:
    """(path, name, operator, version, hashed) of the lines of requirements files; comments and options are no packages."""
    line = locks.select("path", F.explode(tx.lines(F.regexp_replace("code", r"\\\r?\n", " "))).alias("l"))
    pattern = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s;#,]+))?"
    part = lambda k: F.nullif(F.regexp_extract("l", pattern, k), F.lit(""))
    return line.where(~F.col("l").rlike(r"^\s*(?:#|-|$)")).select("path", part(1).alias("name"), part(2).alias("operator"), part(3).alias("version"), F.col("l").contains("--hash=").alias("hashed")).where("name is not null")


def hash_mode(reqs: DataFrame) -> DataFrame:
    """Per requirements file: full, partial or no hash mode, and whether all versions are pinned."""
    n, h = F.count("*"), F.count_if("hashed")
    return reqs.groupBy("path").agg(
        F.when(h == 0, "none").when(h < n, "partial").otherwise("full").alias("hash_mode"), (F.count_if(F.col("operator") == "==") == n).alias("pinned")
    )


def package_json(files: DataFrame) -> DataFrame:
    doc = F.from_json("code", "dependencies map<string,string>, devDependencies map<string,string>")
    parsed = files.select("path", doc.alias("d"))
    side = lambda field, dev: parsed.select("path", F.explode(f"d.{field}").alias("name", "version")).withColumn("dev", F.lit(dev))
    return side("dependencies", False).unionByName(side("devDependencies", True))


def pyproject(files: DataFrame) -> DataFrame:
    """(path, name, version) of the dependency list of [project] in pyproject.toml."""
    body = F.regexp_extract("code", r"(?s)\ndependencies\s*=\s*\[(.*?)\]", 1)
    item = files.select("path", F.explode(F.regexp_extract_all(body, F.lit('["\']([^"\']+)["\']'), F.lit(1))).alias("l"))
    return item.select("path", F.regexp_extract("l", r"^([A-Za-z0-9._-]+)", 1).alias("name"), F.nullif(F.regexp_extract("l", r"(?:==|>=|<=|~=|>|<)\s*([^,;\s]+)", 1), F.lit("")).alias("version"))


def advisory_cache(spark: SparkSession, path: str, hours: int, now_us: int) -> DataFrame:
    """A cache of advisory records as JSON lines with fetched_at in microseconds; entries older than the time to live are left out."""
    return spark.read.json(path).where(F.col("fetched_at") >= now_us - hours * 3_600_000_000)
