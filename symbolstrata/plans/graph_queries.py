"""Queries on the call graph and the file graph, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..tables import clean_path, load

_E = "e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> '')"
_P = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"
_D = f"d AS (SELECT DISTINCT repo_id, {_P.format('src_path')} AS src, {_P.format('dst_path')} AS dst FROM file_deps WHERE src_path <> '' AND dst_path <> '' AND {_P.format('src_path')} <> {_P.format('dst_path')})"


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.call_edges(load(spark, root, "calls"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    return graph.file_edges(load(spark, root, "file_deps"))


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    """A stated query set: the names of every hundredth symbol, asked against the whole graph."""
    return load(spark, root, "symbols").where("sym_id % 100 = 0 and name <> ''").select("repo_id", "name").distinct()


def fan_in_top10(spark: SparkSession, root: str) -> DataFrame:
    return graph.top_by_degree(_edges(spark, root), "dst")


def fan_out_top10(spark: SparkSession, root: str) -> DataFrame:
    return graph.top_by_degree(_edges(spark, root), "src")


def node_degrees(spark: SparkSession, root: str) -> DataFrame:
    return graph.degrees(_edges(spark, root))


def reverse_edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.reversed_edges(_edges(spark, root))


def call_roots(spark: SparkSession, root: str) -> DataFrame:
    return graph.roots(_edges(spark, root))


def call_sinks(spark: SparkSession, root: str) -> DataFrame:
    return graph.sinks(_edges(spark, root))


def self_loops(spark: SparkSession, root: str) -> DataFrame:
    return graph.self_loops(_edges(spark, root))


def edge_counts(spark: SparkSession, root: str) -> DataFrame:
    e = _edges(spark, root)
    return e.groupBy("repo_id").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("callers"), F.count_distinct("dst").alias("callees"))


def change_impact(spark: SparkSession, root: str) -> DataFrame:
    return graph.change_impact(_edges(spark, root), load(spark, root, "symbols").where("name <> '' and path is not null"))


def file_degrees(spark: SparkSession, root: str) -> DataFrame:
    """Per file: files that it imports and files that import it."""
    return graph.degrees(_files(spark, root)).select("repo_id", F.col("name").alias("path"), F.col("fan_out").alias("imports"), F.col("fan_in").alias("imported_by"))


def importers(spark: SparkSession, root: str) -> DataFrame:
    """Per imported file: the files that import it, sorted, at most 20 shown, and how many there are."""
    out = graph.shown_ends(_files(spark, root), "dst", "src")
    return out.select("repo_id", F.col("dst").alias("path"), "n", F.array_join("shown", " ").alias("importers"))


def trace_paths(spark: SparkSession, root: str) -> DataFrame:
    out = graph.trace_paths(_edges(spark, root), _seeds(spark, root))
    return out.select("repo_id", "start", F.array_join("path", " > ").alias("path"))


def neighbourhood(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, root), _seeds(spark, root))


def file_cycles(spark: SparkSession, root: str) -> DataFrame:
    out = graph.cycles(_files(spark, root))
    severity = F.when(F.col("length") <= 2, "high").otherwise("medium")
    return out.select("repo_id", F.array_join("path", " > ").alias("path"), "length", severity.alias("severity"))


def file_cycle_components(spark: SparkSession, root: str) -> DataFrame:
    """Per file on an import cycle of any length: its strongly connected component, named by its smallest file, and that one's size."""
    return graph.cycle_components(_files(spark, root)).select("repo_id", F.col("name").alias("path"), "component", "size")


def layer_graph(spark: SparkSession, root: str) -> DataFrame:
    roles = load(spark, root, "files").where("path is not null").groupBy("repo_id", clean_path(F.col("path")).alias("path")).agg(F.max("role").alias("role"))
    return graph.quotient(_files(spark, root), roles, "path", "role", "core")


def display_graph(spark: SparkSession, root: str) -> DataFrame:
    return graph.display_graph(_edges(spark, root))


def path_tree(spark: SparkSession, root: str) -> DataFrame:
    return graph.path_tree(load(spark, root, "files"))


QUERIES = (fan_in_top10, fan_out_top10, node_degrees, reverse_edges, call_roots, call_sinks, self_loops, edge_counts, change_impact, file_degrees, importers, trace_paths, neighbourhood, file_cycles, file_cycle_components, layer_graph, display_graph, path_tree)
_SEEDS = "seeds AS (SELECT DISTINCT repo_id, name FROM symbols WHERE sym_id % 100 = 0 AND name <> '')"
SQL = {
    "fan_in_top10": f"WITH {_E} SELECT dst AS name, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "fan_out_top10": f"WITH {_E} SELECT src AS name, count(*) AS degree FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "node_degrees": f"WITH {_E} SELECT repo_id, name, sum(o) AS fan_out, sum(i) AS fan_in FROM (SELECT repo_id, src AS name, 1 AS o, 0 AS i FROM e UNION ALL SELECT repo_id, dst, 0, 1 FROM e) GROUP BY 1, 2",
    "reverse_edges": f"WITH {_E} SELECT repo_id, dst AS src, src AS dst FROM e",
    "call_roots": f"WITH {_E} SELECT repo_id, src AS name FROM e EXCEPT SELECT repo_id, dst FROM e",
    "call_sinks": f"WITH {_E} SELECT repo_id, dst AS name FROM e EXCEPT SELECT repo_id, src FROM e",
    "self_loops": f"WITH {_E} SELECT repo_id, src AS name FROM e WHERE src = dst",
    "edge_counts": f"WITH {_E} SELECT repo_id, count(*) AS edges, count(DISTINCT src) AS callers, count(DISTINCT dst) AS callees FROM e GROUP BY 1",
    "change_impact": f"""WITH {_E}, x AS (SELECT * FROM e WHERE src <> dst), direct AS (SELECT repo_id, dst AS name, src AS by FROM x),
      second AS (SELECT DISTINCT d.repo_id, d.name, x.src AS by FROM direct d JOIN x ON x.repo_id = d.repo_id AND x.dst = d.by WHERE x.src <> d.name EXCEPT SELECT * FROM direct),
      n AS (SELECT repo_id, name, count(*) FILTER (h = 1) AS direct, count(*) FILTER (h = 2) AS indirect FROM (SELECT *, 1 AS h FROM direct UNION ALL SELECT *, 2 FROM second) GROUP BY 1, 2),
      r AS (SELECT * FROM direct UNION SELECT * FROM second UNION SELECT repo_id, name, name FROM n),
      t AS (SELECT DISTINCT r.repo_id, r.name, s.path FROM r JOIN symbols s ON s.repo_id = r.repo_id AND s.name = r.by WHERE s.path IS NOT NULL),
      f AS (SELECT repo_id, name, count(*) AS affected_files, count(*) FILTER (lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%') AS test_files FROM t GROUP BY 1, 2)
      SELECT n.repo_id, n.name, direct, indirect, coalesce(affected_files, 0) AS affected_files, coalesce(test_files, 0) AS test_files,
        CASE WHEN direct + indirect + 1 > 10 THEN 'high' WHEN direct + indirect + 1 > 3 THEN 'medium' ELSE 'low' END AS risk FROM n LEFT JOIN f ON f.repo_id = n.repo_id AND f.name = n.name""",
    "file_degrees": f"WITH {_D} SELECT repo_id, path, sum(o) AS imports, sum(i) AS imported_by FROM (SELECT repo_id, src AS path, 1 AS o, 0 AS i FROM d UNION ALL SELECT repo_id, dst, 0, 1 FROM d) GROUP BY 1, 2",
    "importers": f"WITH {_D} SELECT repo_id, dst AS path, count(*) AS n, array_to_string(list_sort(list(src))[1:20], ' ') AS importers FROM d GROUP BY 1, 2",
    "trace_paths": f"""WITH RECURSIVE {_E}, {_SEEDS}, callers AS (SELECT DISTINCT repo_id, src FROM e),
      p(repo_id, start, path, at_, depth, ends) AS (
        SELECT s.repo_id, s.name, [s.name], s.name, 0, false FROM seeds s JOIN callers c ON c.repo_id = s.repo_id AND c.src = s.name
        UNION ALL SELECT p.repo_id, p.start, list_append(p.path, e.dst), e.dst, p.depth + 1, c.src IS NULL FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = p.at_
          LEFT JOIN callers c ON c.repo_id = e.repo_id AND c.src = e.dst WHERE NOT p.ends AND p.depth < 5 AND NOT list_contains(p.path, e.dst))
      SELECT repo_id, start, array_to_string(path, ' > ') AS path FROM p WHERE ends""",
    "neighbourhood": f"""WITH {_E}, {_SEEDS}, r AS (SELECT repo_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src ORDER BY dst) AS n FROM e) WHERE n <= 10),
      one AS (SELECT r.repo_id, r.src AS seed, r.src, r.dst FROM seeds s JOIN r ON r.repo_id = s.repo_id AND r.src = s.name)
      SELECT repo_id, seed, 1 AS depth, src, dst FROM one UNION ALL SELECT one.repo_id, one.seed, 2, r.src, r.dst FROM one JOIN r ON r.repo_id = one.repo_id AND r.src = one.dst""",
    "file_cycles": f"""WITH RECURSIVE {_D}, p(repo_id, start, path, at_) AS (
        SELECT repo_id, src, [src], src FROM (SELECT DISTINCT repo_id, src FROM d)
        UNION ALL SELECT p.repo_id, p.start, list_append(p.path, d.dst), d.dst FROM p JOIN d ON d.repo_id = p.repo_id AND d.src = p.at_ WHERE d.dst > p.start AND NOT list_contains(p.path, d.dst) AND len(p.path) < 5)
      SELECT p.repo_id, array_to_string(path, ' > ') AS path, len(path) AS length, CASE WHEN len(path) <= 2 THEN 'high' ELSE 'medium' END AS severity FROM p JOIN d ON d.repo_id = p.repo_id AND d.src = p.at_ AND d.dst = p.start""",
    "file_cycle_components": f"""WITH RECURSIVE {_D}, r(repo_id, a, b) AS (
        SELECT repo_id, src, dst FROM d UNION SELECT r.repo_id, r.a, d.dst FROM r JOIN d ON d.repo_id = r.repo_id AND d.src = r.b)
      SELECT x.repo_id, x.a AS path, min(x.b) AS component, count(*) AS size FROM r x JOIN r y ON y.repo_id = x.repo_id AND y.a = x.b AND y.b = x.a GROUP BY 1, 2""",
    "layer_graph": f"""WITH {_D}, g AS (SELECT repo_id, {_P.format('path')} AS path, max(role) AS role FROM files WHERE path IS NOT NULL GROUP BY 1, 2)
      SELECT d.repo_id, coalesce(a.role, 'core') AS src_group, coalesce(b.role, 'core') AS dst_group, count(*) AS edges FROM d LEFT JOIN g a ON a.repo_id = d.repo_id AND a.path = d.src LEFT JOIN g b ON b.repo_id = d.repo_id AND b.path = d.dst
      WHERE coalesce(a.role, 'core') <> coalesce(b.role, 'core') GROUP BY 1, 2, 3""",
    "display_graph": f"""WITH {_E}, x AS (SELECT * FROM e WHERE src <> dst), g AS (SELECT repo_id, name, count(*) AS n FROM (SELECT repo_id, src AS name FROM x UNION ALL SELECT repo_id, dst FROM x) GROUP BY 1, 2),
      k AS (SELECT repo_id, name FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, name) AS i FROM g) WHERE i <= 120)
      SELECT x.repo_id, src, dst FROM x JOIN k a ON a.repo_id = x.repo_id AND a.name = src JOIN k b ON b.repo_id = x.repo_id AND b.name = dst""",
    "path_tree": f"""WITH p AS (SELECT DISTINCT repo_id, {_P.format('path')} AS path FROM files WHERE path <> ''), s AS (SELECT repo_id, string_split(path, '/') AS parts FROM p),
      x AS (SELECT repo_id, parts, unnest(range(1, len(parts))) AS depth FROM s)
      SELECT repo_id, array_to_string(parts[1:depth], '/') AS folder, depth, count(*) AS files FROM x GROUP BY ALL""",
}
