"""Queries that look around an index: callers, cycles, outlines, exports, summaries, names across repositories; with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import extract, graph, profile, quality, search
from ..streaming import watch
from ..tables import load

QUESTION = "where do the session and cache handler filter a token"
TERM = "ledger"
BUDGET = 40


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.call_edges(load(spark, root, "calls"))


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    """A stated query set: the names of every hundredth symbol, asked against the whole graph."""
    return load(spark, root, "symbols").where("sym_id % 100 = 0 and name <> ''").select("repo_id", "name").distinct()


def call_cycles(spark: SparkSession, root: str) -> DataFrame:
    out = graph.cycles(_edges(spark, root))
    return out.select("repo_id", F.array_join("path", " > ").alias("path"), "length", F.when(F.col("length") <= 2, "medium").otherwise("low").alias("severity"))


def symbol_callers(spark: SparkSession, root: str) -> DataFrame:
    """Per called name how many names call it and the first 20 of them."""
    out = graph.shown_ends(_edges(spark, root), "dst", "src")
    return out.select("repo_id", F.col("dst").alias("name"), "n", F.array_join("shown", " ").alias("callers"))


def nearest_callees(spark: SparkSession, root: str) -> DataFrame:
    return graph.nearest(_edges(spark, root), _seeds(spark, root))


def file_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return graph.both_ways(graph.file_edges(load(spark, root, "file_deps")))


def file_summaries(spark: SparkSession, root: str) -> DataFrame:
    return profile.file_summaries(*(load(spark, root, t) for t in ("files", "symbols", "calls", "file_deps")))


def class_callees(spark: SparkSession, root: str) -> DataFrame:
    return profile.class_callees(load(spark, root, "symbols"))


def shared_names(spark: SparkSession, root: str) -> DataFrame:
    return profile.shared_names(load(spark, root, "symbols"))


def budgeted_docs(spark: SparkSession, root: str) -> DataFrame:
    """The symbols of each file, in order, until their names and docs fill a budget of tokens."""
    s = load(spark, root, "symbols").select("sym_id", "repo_id", "path", "ordinal", "name", "doc").distinct()
    s = s.select("sym_id", "repo_id", "path", "ordinal", (token_estimate(F.col("name")) + token_estimate(F.col("doc"))).alias("tokens"))
    return profile.within_budget(s, "tokens", ["repo_id", "path"], ["ordinal", "sym_id", "tokens"], BUDGET)


def exports(spark: SparkSession, root: str) -> DataFrame:
    return extract.exports(load(spark, root, "files"))


def visible_names(spark: SparkSession, root: str) -> DataFrame:
    return extract.visible_names(load(spark, root, "symbols"), exports(spark, root))


def brace_depth(spark: SparkSession, root: str) -> DataFrame:
    return quality.brace_depth(load(spark, root, "files"))


def outline(spark: SparkSession, root: str) -> DataFrame:
    return search.outline(load(spark, root, "symbols"))


def search_anywhere(spark: SparkSession, root: str) -> DataFrame:
    return search.anywhere(load(spark, root, "files"), load(spark, root, "symbols"), TERM)


def concepts_of_query(spark: SparkSession, root: str) -> DataFrame:
    return search.concepts_of_query(load(spark, root, "symbols"), QUESTION)


def debounced_changes(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries of files gathered by hour, the last kind of each path: what a watcher would hand on."""
    kind = F.when(F.col("removed_at").isNotNull(), "deleted").otherwise("changed")
    events = load(spark, root, "files").where("path is not null and indexed_at is not null").select("repo_id", "path", kind.alias("kind"), F.col("indexed_at").alias("at"))
    return watch.coalesced(events, "1 hour")


QUERIES = (
    call_cycles, symbol_callers, nearest_callees, file_neighbours, file_summaries, class_callees, shared_names, budgeted_docs,
    exports, visible_names, brace_depth, outline, search_anywhere, concepts_of_query, debounced_changes,
)

_E = "e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> '')"
_P = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"
_D = f"d AS (SELECT DISTINCT repo_id, {_P.format('src_path')} AS src, {_P.format('dst_path')} AS dst FROM file_deps WHERE src_path <> '' AND dst_path <> '' AND {_P.format('src_path')} <> {_P.format('dst_path')})"
_SEEDS = "seeds AS (SELECT DISTINCT repo_id, name FROM symbols WHERE sym_id % 100 = 0 AND name <> '')"
_TOKENS = "CASE WHEN {0} IS NULL THEN 0 ELSE greatest(1, length({0}) // 4) END"
_COUNTS = ["symbols", "functions", "methods", "classes", "edges", "imports", "imported_by"]


def _counted(table: str, path: str, **on: str) -> str:
    return f"SELECT repo_id, {_P.format(path)} AS path, " + ", ".join(f"{on.get(n, '0')} AS {n}" for n in _COUNTS) + f" FROM {table} WHERE {path} <> ''"


_EXPORT = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in extract.EXPORTS)
_EXPORTED = " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_extract(t, '{p}', 1)" for k, p in extract.EXPORTS)
_X = rf"""l AS (SELECT DISTINCT repo_id, path, unnest(string_split(replace(content, chr(13), ''), chr(10))) AS t FROM files WHERE content <> '' AND regexp_matches(lower(path), '\.(js|jsx|ts|tsx)$')),
      x AS (SELECT DISTINCT * FROM (SELECT repo_id, path, CASE {_EXPORTED} END AS name, CASE {_EXPORT} END AS kind FROM l
        UNION ALL SELECT repo_id, path, trim(regexp_replace(unnest(string_split(regexp_extract(t, '^\s*export\s*\{{([^}}]*)\}}', 1), ',')), '^.*\s+as\s+', '')), 'named' FROM l
        UNION ALL SELECT repo_id, path, unnest(regexp_extract_all(regexp_extract(content, '(?m)^__all__\s*=\s*[\[(]([^\])]*)[\])]', 1), '[\"''](\w+)[\"'']', 1)), 'named' FROM files WHERE lower(path) LIKE '%.py') WHERE name <> '')"""
_KIND = "CASE type " + " ".join(f"WHEN '{n}' THEN {c}" for n, c in search.KIND_CODES.items()) + f" ELSE {search.VARIABLE} END"
_CONCEPT = " UNION ALL ".join(
    f"SELECT sym_id, repo_id, name, '{c}' AS concept, " + " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(doc, '')), '{w}') THEN 1 ELSE 0 END" for w in words) + " AS score FROM s"
    for c, words in search.CONCEPTS.items()
)
_HITS = " + ".join(f"contains(lower(name), '{w}')::int" for w in sorted(set(QUESTION.split())) if len(w) > 2)
_POINTS = "CASE concept " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in search.concept_points(QUESTION).items()) + " END"
SQL = {
    "call_cycles": f"""WITH RECURSIVE {_E}, p(repo_id, start, path, at_) AS (
        SELECT repo_id, src, [src], src FROM (SELECT DISTINCT repo_id, src FROM e)
        UNION ALL SELECT p.repo_id, p.start, list_append(p.path, e.dst), e.dst FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = p.at_ WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst) AND len(p.path) < 5)
      SELECT p.repo_id, array_to_string(path, ' > ') AS path, len(path) AS length, CASE WHEN len(path) <= 2 THEN 'medium' ELSE 'low' END AS severity FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = p.at_ AND e.dst = p.start""",
    "symbol_callers": f"WITH {_E} SELECT repo_id, dst AS name, count(*) AS n, array_to_string(list_sort(list(src))[1:20], ' ') AS callers FROM e GROUP BY 1, 2",
    "nearest_callees": f"""WITH RECURSIVE {_E}, {_SEEDS}, r AS (SELECT repo_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src ORDER BY dst) AS i FROM e) WHERE i <= 5),
      p(repo_id, seed, name, distance) AS (SELECT repo_id, name, name, 0 FROM seeds UNION SELECT p.repo_id, p.seed, r.dst, p.distance + 1 FROM p JOIN r ON r.repo_id = p.repo_id AND r.src = p.name WHERE p.distance < 3),
      m AS (SELECT repo_id, seed, name, min(distance) AS distance FROM p GROUP BY 1, 2, 3)
      SELECT repo_id, seed, name, distance FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, seed ORDER BY distance, name) AS i FROM m) WHERE i <= 30""",
    "file_neighbours": f"WITH {_D} SELECT repo_id, src AS name, dst AS other, 'to' AS direction FROM d UNION ALL SELECT repo_id, dst, src, 'from' FROM d",
    "file_summaries": f"""WITH {_D}, s AS (SELECT DISTINCT sym_id, repo_id, path, type FROM symbols), c AS (SELECT DISTINCT repo_id, path, src, dst FROM calls WHERE src <> '' AND dst <> ''),
      u AS ({_counted('files', 'path')} UNION ALL {_counted('s', 'path', symbols='1', functions="coalesce(type = 'function', false)::int", methods="coalesce(type = 'method', false)::int", classes="coalesce(type = 'class', false)::int")}
        UNION ALL {_counted('c', 'path', edges='1')} UNION ALL {_counted('d', 'src', imports='1')} UNION ALL {_counted('d', 'dst', imported_by='1')})
      SELECT repo_id, path, {', '.join(f'sum({n}) AS {n}' for n in _COUNTS)} FROM u GROUP BY 1, 2""",
    "class_callees": "SELECT DISTINCT repo_id, path, class_name, callee FROM (SELECT repo_id, path, class_name, unnest(calls) AS callee FROM symbols WHERE class_name <> '') WHERE callee <> ''",
    "shared_names": "SELECT name, count(DISTINCT repo_id) AS repositories, count(DISTINCT (repo_id, sym_id)) FILTER (repo_id IS NOT NULL) AS symbols FROM symbols WHERE name <> '' GROUP BY 1 HAVING count(DISTINCT repo_id) >= 2",
    "budgeted_docs": f"""WITH s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, doc FROM symbols), t AS (SELECT sym_id, repo_id, path, ordinal, {_TOKENS.format('name')} + {_TOKENS.format('doc')} AS tokens FROM s),
      r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY repo_id, path ORDER BY ordinal, sym_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM t)
      SELECT sym_id, repo_id, path, ordinal, tokens FROM r WHERE before_ < {BUDGET}""",
    "exports": f"WITH {_X} SELECT repo_id, path, name, kind FROM x",
    "visible_names": f"""WITH {_X}, s AS (SELECT repo_id, path, name, 0 AS o, type FROM symbols WHERE name <> '' AND path IS NOT NULL AND coalesce(class_name, '') = '' UNION ALL SELECT repo_id, path, name, 1, kind FROM x),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, name ORDER BY o, type NULLS FIRST) AS i FROM s) SELECT repo_id, path, name, type FROM r WHERE i = 1""",
    "brace_depth": """WITH f AS (SELECT DISTINCT repo_id, path, content FROM files WHERE content <> '' AND path IS NOT NULL), l AS (SELECT *, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM f),
      d AS (SELECT *, length(replace(t, '}', '')) - length(replace(t, '{', '')) AS x FROM l), r AS (SELECT *, sum(x) OVER (PARTITION BY repo_id, path, content ORDER BY i) AS depth FROM d)
      SELECT repo_id, path, count(*) AS lines, greatest(0, max(depth)) AS deepest, sum(x) AS left_open FROM r GROUP BY repo_id, path, content""",
    "outline": f"SELECT DISTINCT sym_id, repo_id, path, ordinal AS position, coalesce(name, '?') AS name, {_KIND} AS kind, greatest(0, coalesce(line - 1, 0)) AS line FROM symbols",
    "search_anywhere": rf"""SELECT DISTINCT * FROM (SELECT 'file' AS what, repo_id, path, regexp_extract(path, '[^/\\]*$') AS name FROM files WHERE contains(lower(path), '{TERM}')
      UNION ALL SELECT 'symbol', repo_id, path, name FROM symbols WHERE contains(lower(name), '{TERM}') OR contains(lower(path), '{TERM}'))""",
    "concepts_of_query": f"""WITH s AS (SELECT DISTINCT sym_id, repo_id, name, doc FROM symbols WHERE name IS NOT NULL), h AS ({_CONCEPT}),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, concept ORDER BY score DESC, sym_id) AS rank FROM h WHERE score > 0), q AS (SELECT repo_id, concept, sum({_HITS}) + max({_POINTS}) AS score FROM r WHERE rank <= 10 GROUP BY 1, 2)
      SELECT * FROM q WHERE score > 0""",
    "debounced_changes": """WITH v AS (SELECT repo_id, path, CASE WHEN removed_at IS NOT NULL THEN 'deleted' ELSE 'changed' END AS kind, indexed_at AS at_ FROM files WHERE path IS NOT NULL AND indexed_at IS NOT NULL)
      SELECT date_trunc('hour', at_) AS since, repo_id, path, arg_max(kind, (at_, kind)) AS kind, count(*) AS events FROM v GROUP BY 1, 2, 3""",
}
