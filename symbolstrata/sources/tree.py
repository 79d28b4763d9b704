"""Reading source trees and index tables of others; writing and reading snapshots and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import MAX_BYTES, ignored_by_default
from ..tables import extension

BUNDLE_VERSION = "1.0"


def scan_tree(spark: SparkSession, folder: str, repo_id: str, max_bytes: int = MAX_BYTES, extensions: list[str] | None = None) -> DataFrame:
    """The files of a source tree: repo_id, path (below the folder), ext, size_bytes, sha256, content.

    Size and path are tested on the listing, before contents are used; texts that are no UTF-8 are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= max_bytes)
    top = folder.rstrip("/")
    path = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{top.lstrip('/')}/", "")
    out = raw.withColumn("path", path).where(~ignored_by_default(F.col("path")))
    if extensions is not None:
        out = out.where(F.lower(extension(F.col("path"))).isin(extensions))
    return out.where(F.is_valid_utf8(F.col("content").cast("string"))).select(F.lit(repo_id).alias("repo_id"), "path", extension(F.col("path")).alias("ext"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def write_snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as Parquet, partitioned by repository, so a query on some repositories reads only theirs."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("repo_id").parquet(f"{folder}/{name}")


def read_snapshot(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as gzipped JSON lines beside a manifest with version and row counts."""
    spark = next(iter(tables.values())).sparkSession
    counts = [(n, BUNDLE_VERSION, df.count()) for n, df in tables.items()]
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(f"{folder}/{name}")
    spark.createDataFrame(counts, "name string, version string, rows long").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def import_bundle(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Tables of a bundle with given schemas; a bundle of another version raises ValueError."""
    manifest = spark.read.schema("name string, version string, rows long").json(f"{folder}/manifest")
    if manifest.where(F.col("version") != BUNDLE_VERSION).count():
        raise ValueError("the bundle has another version")
    return {n: spark.read.schema(s).json(f"{folder}/{n}") for n, s in schemas.items()}


#: An index kept as one JSON document per repository: files with their symbols and imports, the call graph.
FOREIGN = (
    "project_root string, files map<string, struct<symbols: array<struct<name: string, type: string, line: int, params: array<string>, calls: array<string>, class: string, doc: string, framework: string>>,"
    " imports: array<struct<module: string, imported: array<string>>>>>, call_graph map<string, array<string>>, file_dependencies map<string, array<string>>"
)


def read_foreign_index(spark: SparkSession, path: str, repo_id: str) -> dict[str, DataFrame]:
    """symbols, calls and file_deps of a JSON index, read with a fixed schema and exploded; absent parts give no rows."""
    doc = spark.read.schema(FOREIGN).option("multiLine", True).json(path).withColumn("repo_id", F.lit(repo_id))
    files = doc.select("repo_id", F.explode("files").alias("path", "f"))
    symbols = files.select("repo_id", "path", F.posexplode("f.symbols").alias("ordinal", "s")).select("repo_id", "path", "ordinal", "s.name", "s.type", "s.line", "s.params", "s.calls", F.col("s.class").alias("class_name"), "s.doc", "s.framework")
    calls = doc.select("repo_id", F.explode("call_graph").alias("src", "d")).select("repo_id", "src", F.explode("d").alias("dst"))
    deps = doc.select("repo_id", F.explode("file_dependencies").alias("src_path", "d")).select("repo_id", "src_path", F.explode("d").alias("dst_path"))
    return {"symbols": symbols, "calls": calls, "file_deps": deps}
