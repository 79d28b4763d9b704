"""Dependencies that package manifests declare, and warnings about loose ones.

All take files (repo_id, path, content) and give repo_id, path, name, version, source, dev. Files of other names and null
contents give no rows; malformed JSON gives none either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.extract import numbered_lines


def _named(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(pattern))


def _section(rows: DataFrame) -> DataFrame:
    """Lines with the latest [section] above them."""
    w = W.partitionBy("repo_id", "path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(F.col("text").rlike(r"^\s*\["), F.regexp_extract("text", r"^\s*\[+([^\]]+)", 1)), True).over(w))


def node_dependencies(files: DataFrame) -> DataFrame:
    j = _named(files, r"(^|/)package\.json$").withColumn("j", F.from_json("content", "dependencies map<string, string>, devDependencies map<string, string>"))
    part = lambda c, dev: j.select("repo_id", "path", F.explode(f"j.{c}").alias("name", "version")).select("repo_id", "path", "name", "version", F.lit("package.json").alias("source"), F.lit(dev).alias("dev"))
    return part("dependencies", False).unionByName(part("devDependencies", True)).distinct()


def pip_dependencies(files: DataFrame) -> DataFrame:
    rows = numbered_lines(_named(files, r"(^|/)requirements[^/]*\.txt$")).withColumn("text", F.trim("text")).where("text <> '' and not text rlike '^[#-]'")
    p = r"^([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*(==|>=|<=|~=|!=|>|<)?\s*([^;#\s]*)"
    return rows.where(F.col("text").rlike(p)).select("repo_id", "path", F.regexp_extract("text", p, 1).alias("name"), F.concat(F.regexp_extract("text", p, 2), F.regexp_extract("text", p, 3)).alias("version"), F.lit("requirements").alias("source"), F.lit(False).alias("dev")).distinct()


def pyproject_dependencies(files: DataFrame) -> DataFrame:
    rows = numbered_lines(_named(files, r"(^|/)pyproject\.toml$"))
    w = W.partitionBy("repo_id", "path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col("text").rlike(r"^\s*dependencies\s*=\s*\["), 1).when(F.col("text").rlike(r"^\s*(\]|\[|\w+\s*=)"), 0)
    p = r"[\"']([A-Za-z0-9_.\-]+)(?:\[[^\]]*\])?\s*((?:[<>=~!]=?[^\"';]*)?)"
    inside = rows.withColumn("on", F.last(mark, True).over(w)).where("on = 1").select("repo_id", "path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("v"))).alias("d"))
    return inside.select("repo_id", "path", F.col("d.n").alias("name"), F.trim("d.v").alias("version"), F.lit("pyproject").alias("source"), F.lit(False).alias("dev")).distinct()


def go_dependencies(files: DataFrame) -> DataFrame:
    p = r"^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/\S+)\s+(v\S+)"
    return numbered_lines(_named(files, r"(^|/)go\.mod$")).where(F.col("text").rlike(p)).select("repo_id", "path", F.regexp_extract("text", p, 1).alias("name"), F.regexp_extract("text", p, 2).alias("version"), F.lit("go.mod").alias("source"), F.lit(False).alias("dev")).distinct()


def cargo_dependencies(files: DataFrame) -> DataFrame:
    rows = _section(numbered_lines(_named(files, r"(^|/)Cargo\.toml$"))).where("section in ('dependencies', 'dev-dependencies')")
    p = r"^\s*([\w\-]+)\s*=\s*(?:\"([^\"]*)\"|\{.*?version\s*=\s*\"([^\"]*)\".*)"
    return rows.where(F.col("text").rlike(p)).select("repo_id", "path", F.regexp_extract("text", p, 1).alias("name"), F.concat(F.regexp_extract("text", p, 2), F.regexp_extract("text", p, 3)).alias("version"), F.lit("Cargo.toml").alias("source"), (F.col("section") == "dev-dependencies").alias("dev")).distinct()


def all_dependencies(files: DataFrame) -> DataFrame:
    out = node_dependencies(files)
    for part in (pip_dependencies, pyproject_dependencies, go_dependencies, cargo_dependencies):
        out = out.unionByName(part(files))
    return out


def dependency_warnings(dependencies: DataFrame) -> DataFrame:
    """Dependencies without a fixed version or from a plain address: repo_id, path, name, severity, message."""
    v = F.coalesce("version", F.lit(""))
    loose = v.isin("*", "latest", "")
    plain = v.rlike(r"^(http:|git:|git\+)")
    return dependencies.where(loose | plain).select("repo_id", "path", "name", F.when(plain, "high").otherwise("medium").alias("severity"), F.when(plain, "comes from an address").otherwise("no fixed version").alias("message"))


def project_warnings(files: DataFrame) -> DataFrame:
    """What a repository's top files leave open: repo_id, package, severity, message.

    A ``.env`` that no ``.gitignore`` names is high, a ``package.json`` without a lock file medium.
    """
    is_ = lambda p: F.col("path") == p
    has = lambda p: F.coalesce(F.max(is_(p)), F.lit(False))
    top = files.where("path in ('.env', '.gitignore', 'package.json', 'package-lock.json', 'yarn.lock')").groupBy("repo_id").agg(
        has(".env").alias("env"), has("package.json").alias("package"), (has("package-lock.json") | has("yarn.lock")).alias("locked"), has(".gitignore").alias("ignores"), F.coalesce(F.max(is_(".gitignore") & F.col("content").contains(".env")), F.lit(False)).alias("hidden")
    )
    env = F.when(F.col("env") & ~F.col("hidden"), F.struct(F.lit(".env").alias("package"), F.lit("high").alias("severity"), F.when(F.col("ignores"), ".env is not in .gitignore").otherwise(".env without a .gitignore").alias("message")))
    lock = F.when(F.col("package") & ~F.col("locked"), F.struct(F.lit("lockfile").alias("package"), F.lit("medium").alias("severity"), F.lit("no lock file").alias("message")))
    return top.select("repo_id", F.explode(F.array_compact(F.array(env, lock))).alias("w")).select("repo_id", "w.*")
