"""Queries for orphan references (p4) and hot keys (p5), with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hotkeys, references
from ..tables import load


def _index(spark: SparkSession, root: str) -> list[DataFrame]:
    return [load(spark, root, t) for t in ("symbols", "calls", "file_deps", "files", "builtin_names")]


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_references(*_index(spark, root))


def p4_by_month(spark: SparkSession, root: str) -> DataFrame:
    return references.orphans_by_month(*_index(spark, root))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return hotkeys.frequent_keys({"calls": (load(spark, root, "calls"), "dst"), "symbols": (load(spark, root, "symbols"), "name")})


def p5_callees(spark: SparkSession, root: str) -> DataFrame:
    """Per callee name: rows, distinct callers, files and repositories."""
    calls = load(spark, root, "calls")
    out = hotkeys.key_profile(calls, "dst", {"callers": ["repo_id", "src"], "files": ["repo_id", "path"], "repositories": ["repo_id"]})
    return out.select(F.col("name").alias("dst"), F.col("rows").alias("n_rows"), F.col("callers").alias("n_callers"), F.col("files").alias("n_files"), F.col("repositories").alias("n_repositories"))


def p5_names(spark: SparkSession, root: str) -> DataFrame:
    """Per symbol name: rows, files and repositories."""
    out = hotkeys.key_profile(load(spark, root, "symbols"), "name", {"files": ["repo_id", "path"], "repositories": ["repo_id"]})
    return out.select("name", F.col("rows").alias("n_rows"), F.col("files").alias("n_files"), F.col("repositories").alias("n_repositories"))


_STATES = r"""
WITH s AS (SELECT sym_id, min(repo_id) AS repo_id, min(path) AS path, min(name) AS name, any_value(calls) AS calls, min(indexed_at) AS indexed_at, min(loaded_at) AS t, max(removed_at) AS gone FROM symbols GROUP BY sym_id),
c AS (SELECT call_id, min(repo_id) AS repo_id, min(path) AS path, min(dst) AS dst, min(indexed_at) AS indexed_at, min(loaded_at) AS t FROM calls GROUP BY call_id),
d AS (SELECT dep_id, min(repo_id) AS repo_id, min(src_path) AS path, min(dst_path) AS dst, min(indexed_at) AS indexed_at, min(loaded_at) AS t FROM file_deps GROUP BY dep_id),
f AS (SELECT repo_id, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, min(loaded_at) AS t, max(removed_at) AS gone FROM files GROUP BY ALL),
refs AS (
  SELECT DISTINCT 'symbols' AS table_name, sym_id AS row_id, repo_id, path, u.ref AS ref, indexed_at, t FROM s, UNNEST(calls) AS u(ref)
  UNION ALL SELECT 'calls', call_id, repo_id, path, dst, indexed_at, t FROM c),
named AS (SELECT *, split_part(ref, '.', -1) AS k, regexp_extract(path, '(\.[^./\\]+)$', 1) AS ext FROM refs WHERE ref <> ''),
keys AS (SELECT DISTINCT repo_id, k, t, ext FROM named),
paths AS (SELECT 'file_deps' AS table_name, dep_id AS row_id, repo_id, dst AS ref, indexed_at, t, regexp_replace(replace(dst, '\', '/'), '^\./', '') AS k FROM d WHERE dst <> ''),
sk AS (SELECT keys.repo_id, keys.k, keys.t, keys.ext,
    coalesce(bool_or(s.t <= keys.t AND (s.gone IS NULL OR s.gone > keys.t)), false) OR coalesce(bool_or(b.name IS NOT NULL), false) AS alive,
    coalesce(bool_or(s.t <= keys.t), false) AS before, coalesce(bool_or(s.t IS NOT NULL), false) AS ever
  FROM keys LEFT JOIN s ON s.repo_id = keys.repo_id AND s.name = keys.k AND (s.gone IS NULL OR s.gone > s.t)
  LEFT JOIN (SELECT DISTINCT ext, name FROM builtin_names) b ON b.ext = keys.ext AND b.name = keys.k GROUP BY ALL),
fk AS (SELECT p.repo_id, p.k, p.t,
    coalesce(bool_or(f.t <= p.t AND (f.gone IS NULL OR f.gone > p.t)), false) AS alive,
    coalesce(bool_or(f.t <= p.t), false) AS before, coalesce(bool_or(f.t IS NOT NULL), false) AS ever
  FROM (SELECT DISTINCT repo_id, k, t FROM paths) p LEFT JOIN f ON f.repo_id = p.repo_id AND f.path = p.k AND (f.gone IS NULL OR f.gone > f.t) GROUP BY ALL),
states AS (
  SELECT n.table_name, n.row_id, n.ref, n.indexed_at, sk.alive, sk.before, sk.ever FROM named n JOIN sk ON sk.repo_id = n.repo_id AND sk.k = n.k AND sk.t = n.t AND sk.ext = n.ext
  UNION ALL SELECT p.table_name, p.row_id, p.ref, p.indexed_at, fk.alive, fk.before, fk.ever FROM paths p JOIN fk ON fk.repo_id = p.repo_id AND fk.k = p.k AND fk.t = p.t)
"""

QUERIES = (p4_found, p4_by_month, p5_found, p5_callees, p5_names)
SQL = {
    "p4_found": _STATES + "SELECT table_name, row_id, ref FROM states WHERE NOT alive",
    "p4_by_month": _STATES + "SELECT table_name, strftime(indexed_at, '%Y-%m') AS month, CASE WHEN before THEN 'deleted' WHEN ever THEN 'late' ELSE 'missing' END AS state, count(*) AS orphans FROM states WHERE NOT alive GROUP BY ALL",
    "p5_found": """SELECT 'calls' AS table_name, dst AS key_value FROM calls WHERE dst <> '' GROUP BY dst HAVING count(*) >= 0.02 * (SELECT count(*) FROM calls)
UNION ALL SELECT 'symbols', name FROM symbols WHERE name <> '' GROUP BY name HAVING count(*) >= 0.02 * (SELECT count(*) FROM symbols)""",
    "p5_callees": "SELECT dst, count(*) AS n_rows, count(DISTINCT (repo_id, src)) AS n_callers, count(DISTINCT (repo_id, path)) AS n_files, count(DISTINCT repo_id) AS n_repositories FROM calls WHERE dst <> '' GROUP BY dst",
    "p5_names": "SELECT name, count(*) AS n_rows, count(DISTINCT (repo_id, path)) AS n_files, count(DISTINCT repo_id) AS n_repositories FROM symbols WHERE name <> '' GROUP BY name",
}
