"""Resolution of imports to files and of imported names to their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import clean_path


def module_keys(files: DataFrame) -> DataFrame:
    """Keys by which a file can be imported: repo_id, key, path: its path, without ending, dotted, and of packages the folder."""
    f = files.where("path <> ''").select("repo_id", clean_path(F.col("path")).alias("path")).distinct()
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    keys = F.array_distinct(F.array_compact(F.array(F.col("path"), stem, F.replace(stem, F.lit("/"), F.lit(".")), F.when(stem.rlike("/(__init__|index)$"), F.regexp_replace(stem, "/(__init__|index)$", "")))))
    return f.select("repo_id", "path", F.explode(keys).alias("key"))


def import_candidates(imports: DataFrame) -> DataFrame:
    """Keys that an import may mean: repo_id, path, module, key; leading dots climb, ``@/`` is ``src/``, dots are slashes too."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    up = F.length(F.regexp_extract("module", r"^(\.+)(?!/)", 1))
    relative = F.regexp_replace(F.concat(folder, F.regexp_replace("module", r"^\./", "")), r"[^/]+/\.\./", "")
    climbed = F.concat(F.array_join(F.expr("slice(split(path, '/'), 1, greatest(size(split(path, '/')) - greatest(length(regexp_extract(module, '^([.]+)', 1)), 1), 0))"), "/"), F.lit("/"), F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/")))
    plain = F.regexp_replace("module", "^@/", "src/")
    keys = F.when(F.col("module").startswith("./") | F.col("module").startswith("../"), F.array(relative)).when(up > 0, F.array(F.regexp_replace(climbed, "^/|/$", ""))).otherwise(F.array_distinct(F.array(plain, F.replace(plain, F.lit("."), F.lit("/")))))
    return imports.select("repo_id", clean_path(F.col("path")).alias("path"), "module", "imported").withColumn("key", F.explode(keys)).distinct()


def file_dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (repo_id, src_path, dst_path) that imports resolve to, without files importing themselves."""
    hit = import_candidates(imports).join(module_keys(files).withColumnRenamed("path", "dst_path"), ["repo_id", "key"])
    return hit.where("path <> dst_path").select("repo_id", F.col("path").alias("src_path"), "dst_path").distinct()


def type_map(imports: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imported names with the file, type and line that define them: repo_id, imported_in, name, defined_in, type, line.

    ``*`` brings every symbol of the target outside classes; of several targets the last path wins.
    """
    hit = import_candidates(imports).join(module_keys(files).withColumnRenamed("path", "dst_path"), ["repo_id", "key"]).where("path <> dst_path")
    names = hit.select("repo_id", "path", "dst_path", F.explode(F.split("imported", " ")).alias("name")).distinct()
    own = symbols.where("name <> '' and (class_name is null or class_name = '')").select("repo_id", clean_path(F.col("path")).alias("dst_path"), "name", "type", "line").distinct()
    exact = names.where("name <> '*'").join(own, ["repo_id", "dst_path", "name"])
    every = names.where("name = '*'").drop("name").join(own, ["repo_id", "dst_path"])
    best = exact.unionByName(every).groupBy("repo_id", F.col("path").alias("imported_in"), "name").agg(F.max(F.struct("dst_path", "line", "type")).alias("d"))
    return best.select("repo_id", "imported_in", "name", F.col("d.dst_path").alias("defined_in"), "d.type", "d.line")


def external_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Modules that no file of the repository resolves: repo_id, module, importing files."""
    known = import_candidates(imports).join(module_keys(files).select("repo_id", "key"), ["repo_id", "key"], "left_semi").select("repo_id", "path", "module").distinct()
    own = imports.select("repo_id", clean_path(F.col("path")).alias("path"), "module").distinct()
    return own.join(known, ["repo_id", "path", "module"], "left_anti").groupBy("repo_id", "module").agg(F.count("*").alias("files"))
