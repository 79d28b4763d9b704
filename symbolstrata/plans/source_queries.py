"""Queries on what is indexed, resolved, changed and streamed, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, extract, filters, graph, resolve
from ..streaming import watch
from ..tables import clean_path, load
from . import quality_queries


def ignore_reasons(spark: SparkSession, root: str) -> DataFrame:
    return filters.ignore_reasons(load(spark, root, "files"), load(spark, root, "exclude_patterns"))


def dry_run(spark: SparkSession, root: str) -> DataFrame:
    return filters.dry_run(load(spark, root, "files"), load(spark, root, "exclude_patterns"))


def _imports(spark: SparkSession, root: str) -> DataFrame:
    return extract.imports(load(spark, root, "files"))


def module_keys(spark: SparkSession, root: str) -> DataFrame:
    return resolve.module_keys(load(spark, root, "files"))


def resolved_dependencies(spark: SparkSession, root: str) -> DataFrame:
    return resolve.file_dependencies(_imports(spark, root), load(spark, root, "files"))


def type_map(spark: SparkSession, root: str) -> DataFrame:
    return resolve.type_map(_imports(spark, root), load(spark, root, "files"), load(spark, root, "symbols"))


def external_modules(spark: SparkSession, root: str) -> DataFrame:
    return resolve.external_modules(_imports(spark, root), load(spark, root, "files"))


def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """Each repository's files at its first run against those that are there at the end."""
    f = load(spark, root, "files")
    first = f.groupBy("repo_id").agg(F.min("indexed_at").alias("began"))
    old = f.join(F.broadcast(first) if first.count() <= 100_000 else first, "repo_id").where("indexed_at <= began + interval 1 day")
    return diff.file_changes(old, f.where("removed_at is null"))


def _hunks(spark: SparkSession, root: str) -> DataFrame:
    """Ranges of lines of files: those that snippets show."""
    s = load(spark, root, "snippets")
    return s.select("repo_id", F.col("file_path").alias("path"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))


def changed_symbols(spark: SparkSession, root: str) -> DataFrame:
    return diff.changed_symbols(load(spark, root, "symbols"), _hunks(spark, root))


def affected_callers(spark: SparkSession, root: str) -> DataFrame:
    return diff.affected_callers(diff.changed_symbols(load(spark, root, "symbols"), _hunks(spark, root)), graph.call_edges(load(spark, root, "calls")))


def unindexed_snippet_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of dependencies and snippets that the index lacks, as a merge would add them."""
    have = load(spark, root, "files").where("path is not null").select("repo_id", clean_path(F.col("path")).alias("path")).distinct()
    seen = load(spark, root, "snippets").select("repo_id", F.col("file_path").alias("path")).unionByName(load(spark, root, "file_deps").select("repo_id", F.col("dst_path").alias("path"))).where("path <> ''")
    seen = seen.select("repo_id", clean_path(F.col("path")).alias("path")).distinct()
    return diff.insert_if_absent(have.withColumn("known", F.lit(True)), seen.withColumn("known", F.lit(False)), ["repo_id", "path"]).where("not known").select("repo_id", "path")


def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Call rows read as a stream, one per edge."""
    schema = load(spark, root, "calls").schema
    return watch.ingest(spark, f"{root}/calls.parquet*", schema, ["repo_id", "src", "dst"], ["repo_id", "src", "dst"])


def snippet_windows(spark: SparkSession, root: str) -> DataFrame:
    """The five snippets of each file that come first: classes before others, then by number of calls."""
    s = load(spark, root, "symbols").where("path is not null and line is not null").select("sym_id", "repo_id", "path", "ordinal", "name", "type", "line", F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).alias("n")).distinct()
    s = s.withColumn("late", (F.coalesce("type", F.lit("")) != "class").cast("int")).withColumn("less", -F.col("n"))
    best = filters.first_of(s, ["repo_id", "path"], ["late", "less", "ordinal", "sym_id"], 5)
    return best.select("repo_id", "path", "name", F.greatest(F.col("line") - 3, F.lit(1)).alias("first_line"), (F.col("line") + 29).alias("last_line"))


QUERIES = (ignore_reasons, dry_run, module_keys, resolved_dependencies, type_map, external_modules, file_changes, changed_symbols, affected_callers, unindexed_snippet_files, stream_ingest, snippet_windows)

_P = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"
_DEFAULT = f"list_has_any(string_split({_P.format('path')}, '/'), {filters.IGNORED_FOLDERS}) OR " + " OR ".join(f"ends_with({_P.format('path')}, '{e}')" for e in filters.IGNORED_ENDINGS)
_GLOB = r"'^' || regexp_replace(regexp_replace(regexp_replace(replace(pattern, '\', '/'), '([.+^$(){}|\[\]])', '\\\1', 'g'), '\?', '.', 'g'), '\*', '.*', 'g') || '$'"
_R = rf"""g AS (SELECT DISTINCT repo_id, replace(pattern, '\', '/') AS pattern, {_GLOB} AS glob FROM exclude_patterns WHERE pattern <> ''),
  p AS (SELECT repo_id, path, max(size_bytes) AS size_bytes FROM files WHERE path IS NOT NULL GROUP BY 1, 2),
  r AS (SELECT repo_id, path, CASE WHEN {_DEFAULT} THEN 'default' WHEN EXISTS (FROM g WHERE g.repo_id = p.repo_id AND (contains({_P.format('p.path')}, g.pattern) OR regexp_matches({_P.format('p.path')}, g.glob))) THEN 'excluded'
    WHEN regexp_matches({_P.format('path')}, '{filters.TEST_PATTERN}') THEN 'test' WHEN size_bytes > {filters.MAX_BYTES} THEN 'too_large' END AS reason FROM p)"""
_HUNKS = rf"""c AS (SELECT DISTINCT s.sym_id, s.repo_id, {_P.format('s.path')} AS path, s.name FROM symbols s JOIN snippets h ON h.repo_id = s.repo_id AND {_P.format('h.file_path')} = {_P.format('s.path')} AND s.line BETWEEN h.start_line AND h.end_line)"""
_K = rf"""f AS (SELECT DISTINCT repo_id, {_P.format('path')} AS path FROM files WHERE path <> ''), st AS (SELECT repo_id, path, regexp_replace(path, '\.[^./]+$', '') AS stem FROM f),
  k AS (SELECT DISTINCT repo_id, path, key FROM (SELECT repo_id, path, path AS key FROM st UNION ALL SELECT repo_id, path, stem FROM st UNION ALL SELECT repo_id, path, replace(stem, '/', '.') FROM st UNION ALL SELECT repo_id, path, regexp_replace(stem, '/(__init__|index)$', '') FROM st WHERE regexp_matches(stem, '/(__init__|index)$')))"""
_C = rf"""{quality_queries._I}, {_K}, im AS (SELECT DISTINCT repo_id, {_P.format('path')} AS path, module, imported FROM i WHERE module IS NOT NULL),
  ca AS (SELECT DISTINCT repo_id, path, module, imported, unnest(CASE WHEN starts_with(module, './') OR starts_with(module, '../') THEN [regexp_replace(regexp_replace(path, '[^/]*$', '') || regexp_replace(module, '^\./', ''), '[^/]+/\.\./', '', 'g')]
      WHEN starts_with(module, '.') THEN [regexp_replace(array_to_string(string_split(path, '/')[1:greatest(len(string_split(path, '/')) - greatest(length(regexp_extract(module, '^(\.+)', 1)), 1), 0)], '/') || '/' || replace(regexp_replace(module, '^\.+', ''), '.', '/'), '^/|/$', '', 'g')]
      ELSE [regexp_replace(module, '^@/', 'src/'), replace(regexp_replace(module, '^@/', 'src/'), '.', '/')] END) AS key FROM im)"""
SQL = {
    "resolved_dependencies": f"WITH {_C} SELECT DISTINCT ca.repo_id, ca.path AS src_path, k.path AS dst_path FROM ca JOIN k ON k.repo_id = ca.repo_id AND k.key = ca.key WHERE ca.path <> k.path",
    "external_modules": f"WITH {_C} SELECT repo_id, module, count(*) AS files FROM (SELECT DISTINCT repo_id, path, module FROM im WHERE NOT EXISTS (FROM ca JOIN k ON k.repo_id = ca.repo_id AND k.key = ca.key WHERE ca.repo_id = im.repo_id AND ca.path = im.path AND ca.module = im.module)) GROUP BY 1, 2",
    "type_map": rf"""WITH {_C}, h AS (SELECT DISTINCT ca.repo_id, ca.path, k.path AS dst, unnest(string_split(imported, ' ')) AS name FROM ca JOIN k ON k.repo_id = ca.repo_id AND k.key = ca.key WHERE ca.path <> k.path),
      o AS (SELECT DISTINCT repo_id, {_P.format('path')} AS dst, name, type, line FROM symbols WHERE name <> '' AND coalesce(class_name, '') = ''), x AS (SELECT h.repo_id, h.path, o.name, o.dst, o.line, o.type FROM h JOIN o ON o.repo_id = h.repo_id AND o.dst = h.dst AND (o.name = h.name OR h.name = '*')),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, name ORDER BY dst DESC, line DESC NULLS LAST, type DESC NULLS LAST) AS n FROM x) SELECT repo_id, path AS imported_in, name, dst AS defined_in, type, line FROM r WHERE n = 1""",
    "ignore_reasons": f"WITH {_R} SELECT * FROM r",
    "dry_run": f"WITH {_R} SELECT coalesce(reason, 'indexed') AS reason, count(*) AS files FROM r GROUP BY 1",
    "module_keys": f"WITH {_K} SELECT * FROM k",
    "file_changes": """WITH b AS (SELECT repo_id, min(indexed_at) AS began FROM files GROUP BY 1), o AS (SELECT f.repo_id, path, max(sha256) AS h FROM files f JOIN b ON b.repo_id = f.repo_id WHERE path IS NOT NULL AND indexed_at <= began + INTERVAL 1 DAY GROUP BY 1, 2),
      n AS (SELECT repo_id, path, max(sha256) AS h FROM files WHERE path IS NOT NULL AND removed_at IS NULL GROUP BY 1, 2)
      SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'same' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.path = n.path""",
    "changed_symbols": f"WITH {_HUNKS} SELECT * FROM c",
    "affected_callers": f"""WITH {_HUNKS}, e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> ''), n AS (SELECT DISTINCT repo_id, name FROM c WHERE name <> '')
      SELECT e.repo_id, e.src AS name, count(DISTINCT e.dst) AS changed FROM e JOIN n ON n.repo_id = e.repo_id AND n.name = e.dst WHERE NOT EXISTS (FROM n m WHERE m.repo_id = e.repo_id AND m.name = e.src) GROUP BY 1, 2""",
    "unindexed_snippet_files": f"""SELECT repo_id, {_P.format('file_path')} AS path FROM snippets WHERE file_path <> '' UNION SELECT repo_id, {_P.format('dst_path')} FROM file_deps WHERE dst_path <> '' EXCEPT SELECT repo_id, {_P.format('path')} FROM files WHERE path IS NOT NULL""",
    "stream_ingest": "SELECT DISTINCT repo_id, src, dst FROM calls",
    "snippet_windows": """WITH s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, line, coalesce(len(calls), 0) AS n FROM symbols WHERE path IS NOT NULL AND line IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY CASE WHEN coalesce(type, '') <> 'class' THEN 1 ELSE 0 END, -n, ordinal, sym_id) AS i FROM s) SELECT repo_id, path, name, greatest(line - 3, 1) AS first_line, line + 29 AS last_line FROM r WHERE i <= 5""",
}
