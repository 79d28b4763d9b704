"""Queries for questions about code, profiles by content and reports, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import settings
from ..operators import diff, extract, filters, frameworks, graph, lookup, profile, search
from ..sources import manifests
from ..tables import extension, load
from . import browse_queries, quality_queries, search_queries, source_queries
from .source_queries import snippet_windows

_QUESTION = "how does the search index work"


def _t(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [load(spark, root, n) for n in names]


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return graph.call_edges(load(spark, root, "calls"))


def _seeds(spark: SparkSession, root: str) -> DataFrame:
    """The symbols that searches take as queries: those whose id is divisible by 100."""
    return load(spark, root, "symbols").where("sym_id % 100 = 0 and name <> ''").select("repo_id", "name").distinct()


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, " "))
    return df


def concept_files(spark: SparkSession, root: str) -> DataFrame:
    return search.concept_files(*_t(spark, root, "symbols", "files"))


def concept_flows(spark: SparkSession, root: str) -> DataFrame:
    return _joined(search.concept_flows(load(spark, root, "symbols"), _edges(spark, root)), "shown")


def answer_symbols(spark: SparkSession, root: str) -> DataFrame:
    return search.answer_symbols(load(spark, root, "symbols"), "how does the gateway merge a bucket")


def explanation_context(spark: SparkSession, root: str) -> DataFrame:
    return _joined(search.explanation_context(load(spark, root, "symbols"), _edges(spark, root), _QUESTION), "callers", "callees")


def scoped_search(spark: SparkSession, root: str) -> DataFrame:
    return search.scoped_search(load(spark, root, "symbols"), "pkg/:merge").select("sym_id", "repo_id", "path", "name", "type")


def search_with_imports(spark: SparkSession, root: str) -> DataFrame:
    """Symbols and imported modules with a word in their name."""
    found = search.symbol_search(load(spark, root, "symbols"), "beacon").select("repo_id", "path", "name", "type").distinct()
    return search.with_imports(found, extract.imports(load(spark, root, "files")), "beacon")


def flow_by_file(spark: SparkSession, root: str) -> DataFrame:
    return _joined(search.flow_by_file(_edges(spark, root), load(spark, root, "symbols"), "merge filter"), "shown")


def symbol_code(spark: SparkSession, root: str) -> DataFrame:
    """Symbols with the size of the body that stands for them."""
    return lookup.symbol_code(*_t(spark, root, "symbols", "symbol_bodies")).select("sym_id", "repo_id", "path", "name", "type", F.length("body").alias("characters"))


def symbol_cards(spark: SparkSession, root: str) -> DataFrame:
    return _joined(lookup.symbol_cards(load(spark, root, "symbols"), _edges(spark, root), "merge"), "called_by")


def first_matching_file(spark: SparkSession, root: str) -> DataFrame:
    return lookup.first_matching_file(load(spark, root, "symbols"), "test")


def matching_starts(spark: SparkSession, root: str) -> DataFrame:
    return lookup.matching_starts(_edges(spark, root), "load")


def across_repositories(spark: SparkSession, root: str) -> DataFrame:
    return lookup.across_repositories(load(spark, root, "symbols"), "buffer")


def search_payload(spark: SparkSession, root: str) -> DataFrame:
    return lookup.search_payload(load(spark, root, "symbols"))


def faceted_symbols(spark: SparkSession, root: str) -> DataFrame:
    return lookup.faceted(load(spark, root, "symbols"), "grid", "function")


def api_docs(spark: SparkSession, root: str) -> DataFrame:
    return lookup.api_docs(load(spark, root, "symbols"), extract.signatures(load(spark, root, "files")))


def largest_modules(spark: SparkSession, root: str) -> DataFrame:
    return lookup.largest_modules(load(spark, root, "symbols"))


def snippet_lines(spark: SparkSession, root: str) -> DataFrame:
    """The text of each file's first snippets, by its hash and length."""
    s = lookup.snippet_lines(snippet_windows(spark, root).distinct(), load(spark, root, "files"))
    return s.select("repo_id", "path", "name", "first_line", F.length("snippet").alias("characters"), F.md5("snippet").alias("fingerprint")).distinct()


def rebuilt_bodies(spark: SparkSession, root: str) -> DataFrame:
    """The stretch of its file that stands for each symbol, by its length and hash."""
    b = lookup.bodies_to_next(*_t(spark, root, "symbols", "files"))
    return b.select("sym_id", "repo_id", "path", F.length("body").alias("characters"), F.md5("body").alias("fingerprint")).distinct()


def body_end_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Per extension: symbols with an end in the index whose body's end was found by layout, and how many agree."""
    found = lookup.bodies_by_layout(*_t(spark, root, "symbols", "files"))
    told = load(spark, root, "symbols").where("end_line is not null").select("sym_id", "end_line").distinct()
    j = found.join(told, "sym_id")
    return j.groupBy(extension(F.col("path")).alias("ext")).agg(F.count("*").alias("symbols"), F.count_if(F.col("last_line") == F.col("end_line")).alias("agree"))


def top_caller_savings(spark: SparkSession, root: str) -> DataFrame:
    return lookup.top_caller_savings(_edges(spark, root), *_t(spark, root, "symbols", "files"))


def _held(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return extract.routes(load(spark, root, "files")), frameworks.entities(load(spark, root, "symbol_bodies"))


def content_roles(spark: SparkSession, root: str) -> DataFrame:
    return profile.content_roles(*_t(spark, root, "files", "symbols"), *_held(spark, root))


def layer_totals(spark: SparkSession, root: str) -> DataFrame:
    routes, entities = _held(spark, root)
    return profile.layer_totals(content_roles(spark, root), load(spark, root, "symbols"), routes, entities)


def reasoned_entry_points(spark: SparkSession, root: str) -> DataFrame:
    return profile.reasoned_entry_points(load(spark, root, "symbols"), _edges(spark, root), extract.routes(load(spark, root, "files")))


def output_recommendations(spark: SparkSession, root: str) -> DataFrame:
    routes, entities = _held(spark, root)
    return profile.output_recommendations(*_t(spark, root, "files", "symbols"), routes, entities.where("kind <> 'unknown'"))


def symbol_files(spark: SparkSession, root: str) -> DataFrame:
    """For each name the first and the last file that defines it."""
    s = load(spark, root, "symbols")
    return graph.symbol_files(s, "first").withColumnRenamed("path", "first_path").join(graph.symbol_files(s).withColumnRenamed("path", "last_path"), ["repo_id", "name"])


def importing_files(spark: SparkSession, root: str) -> DataFrame:
    return graph.importing_files(_edges(spark, root), load(spark, root, "symbols"), graph.file_edges(load(spark, root, "file_deps")))


def participants(spark: SparkSession, root: str) -> DataFrame:
    return graph.participants(_edges(spark, root), _seeds(spark, root))


def entity_relations(spark: SparkSession, root: str) -> DataFrame:
    """Relations between classes, all taken as entities, as their methods' names tell."""
    return graph.entity_relations(load(spark, root, "symbols"), ("",))


def most_called(spark: SparkSession, root: str) -> DataFrame:
    return graph.most_called(_edges(spark, root))


def top_level_flows(spark: SparkSession, root: str) -> DataFrame:
    return _joined(graph.top_level_flows(_edges(spark, root)), "shown")


def shortest_cycles(spark: SparkSession, root: str) -> DataFrame:
    """The 50 shortest call cycles; ties by repository and path."""
    c = graph.cycles(_edges(spark, root)).withColumn("nodes", F.array_join("path", " "))
    return c.orderBy("length", "repo_id", "nodes").limit(50).select("repo_id", "length", "nodes")


def trace_report(spark: SparkSession, root: str) -> DataFrame:
    """The first paths from the first three calling names of each repository with ``load`` in them."""
    edges = _edges(spark, root)
    out = graph.trace_report(edges, lookup.matching_starts(edges, "load"))
    return out.select("repo_id", "start", "place", F.array_join("path", " > ").alias("path"))


def changed_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths that snippets, dependencies or removed files name, as one list of changes."""
    files, snippets, deps = _t(spark, root, "files", "snippets", "file_deps")
    return diff.changed_paths(files.where("removed_at is not null").select("repo_id", "path"), snippets.select("repo_id", F.col("file_path").alias("path")), deps.select("repo_id", F.col("src_path").alias("path")))


def dry_run_sample(spark: SparkSession, root: str) -> DataFrame:
    return filters.dry_run_sample(*_t(spark, root, "files", "exclude_patterns"))


def gitignored(spark: SparkSession, root: str) -> DataFrame:
    """Paths that the repositories' exclude patterns, read as ignore rules in order of the pattern, leave out."""
    files, patterns = _t(spark, root, "files", "exclude_patterns")
    rules = patterns.where("pattern <> ''").select("repo_id", F.col("pattern").alias("ordinal"), "pattern").distinct()
    return filters.gitignored(files.where("path is not null").select("repo_id", "path").distinct(), rules)


def merged_workspace(spark: SparkSession, root: str) -> DataFrame:
    """The call edges of all repositories as one graph, names with their repository before them."""
    calls = _edges(spark, root)
    aliases = calls.select("repo_id").distinct().withColumn("alias", F.split("repo_id", "-")[0])
    return lookup.merged_workspace({"calls": calls}, aliases)["calls"].select("repo_alias", "src", "dst").distinct()


def manifest_dependencies(spark: SparkSession, root: str) -> DataFrame:
    return manifests.all_dependencies(load(spark, root, "files"))


def dependency_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Loose dependencies and what the repository's top files leave open."""
    files = load(spark, root, "files")
    return manifests.dependency_warnings(manifests.all_dependencies(files)).select("repo_id", F.col("name").alias("package"), "severity", "message").unionByName(manifests.project_warnings(files))


def monorepo_patterns(spark: SparkSession, root: str) -> DataFrame:
    return _joined(settings.monorepo_patterns(load(spark, root, "files")), "patterns")


QUERIES = (
    concept_files, concept_flows, answer_symbols, explanation_context, scoped_search, search_with_imports, flow_by_file, symbol_code, symbol_cards, first_matching_file, matching_starts, across_repositories, search_payload, faceted_symbols, api_docs,
    largest_modules, snippet_lines, rebuilt_bodies, body_end_agreement, top_caller_savings, content_roles, layer_totals, reasoned_entry_points, output_recommendations, symbol_files, importing_files, participants, entity_relations, most_called, top_level_flows, shortest_cycles, trace_report, changed_paths,
    dry_run_sample, gitignored, merged_workspace, manifest_dependencies, dependency_warnings, monorepo_patterns,
)
_E = "e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> '')"
_FE = r"fe AS (SELECT * FROM (SELECT DISTINCT repo_id, regexp_replace(replace(src_path, '\', '/'), '^\./', '') AS src, regexp_replace(replace(dst_path, '\', '/'), '^\./', '') AS dst FROM file_deps WHERE src_path <> '' AND dst_path <> '') WHERE src <> dst)"
_CLEAN = r"regexp_replace(replace({0}, '\', '/'), '^\./', '')"
_LOW_DOC = "lower(coalesce(doc, ''))"


def _points(words: list[str], parts: list[tuple[str, int]]) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{w}') THEN {n} ELSE 0 END" for w in words for text, n in parts)


_CONCEPT_FILES = "cf AS (" + " UNION ALL ".join(
    f"SELECT repo_id, '{c}' AS concept, path, max(own) AS own, max(best) AS best FROM (SELECT repo_id, path, {_points(words, [('lower(path)', 2)])} AS own, 0 AS best FROM ap UNION ALL SELECT repo_id, path, 0, {_points(words, [('lower(coalesce(name, {0}))'.format(chr(39) * 2), 3), (_LOW_DOC, 1)])} FROM asy) GROUP BY 1, 3 HAVING max(own) > 0 OR max(best) > 0"
    for c, words in search.CONCEPTS.items()
) + ")"
_INDEX = "ci AS (" + search_queries.SQL["concept_index"] + ")"
_WORDS = [w for w in search.query_words("how does the gateway merge a bucket") if w not in search.STOP_WORDS and len(w) > 2]
_POINTS = "CASE concept " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in search.concept_points(_QUESTION).items()) + " END"
_HITS = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 1 ELSE 0 END" for w in search.query_words(_QUESTION) if len(w) > 2)
_ENTRY = ", ".join(f"'{x}'" for x in profile.ENTRY_FILES)
_ROLE_PATH = "CASE WHEN regexp_matches(p, '/(cli|manage)\\.py$') THEN 0 " + " ".join(f"WHEN {' OR '.join(f'''contains(p, '{n}')''' for n in needles)} THEN {i}" for i, (_, needles) in enumerate(profile.ROLES)) + " ELSE 6 END"
_FRONT = "CASE WHEN framework IS NULL OR framework = '' THEN NULL " + " ".join(f"WHEN contains(lower(framework), '{n}') THEN '{n}'" for n in profile.FRAMEWORKS) + " ELSE lower(framework) END"
_ROLES = rf"""{quality_queries._ROUTES}, {quality_queries._ENTITIES}, fr AS (SELECT DISTINCT repo_id, path FROM symbols WHERE list_contains({[str(x) for x in profile.FRONTEND]}, {_FRONT})),
  cr AS (SELECT f.repo_id, f.path, ['cli', 'api', 'data', 'ui', 'services', 'infra', 'core'][1 + least({_ROLE_PATH}, CASE WHEN EXISTS (FROM ro WHERE ro.repo_id = f.repo_id AND ro.path = f.path) THEN 1 ELSE 6 END,
    CASE WHEN EXISTS (FROM en WHERE en.repo_id = f.repo_id AND en.path = f.path AND kind <> 'unknown') THEN 2 ELSE 6 END, CASE WHEN EXISTS (FROM fr WHERE fr.repo_id = f.repo_id AND fr.path = f.path) THEN 3 ELSE 6 END)] AS role
    FROM (SELECT DISTINCT repo_id, path, '/' || lower({_CLEAN.format('path')}) AS p FROM files WHERE path IS NOT NULL) f)"""
_FIRST = "row_number() OVER (PARTITION BY repo_id, {0} ORDER BY {1})"
SQL: dict[str, str] = {
    "concept_files": f"""WITH ap AS (SELECT repo_id, path FROM files WHERE path IS NOT NULL UNION SELECT repo_id, path FROM symbols WHERE path IS NOT NULL), asy AS (SELECT DISTINCT repo_id, path, name, doc FROM symbols WHERE path IS NOT NULL), {_CONCEPT_FILES},
      r AS (SELECT repo_id, concept, path, CASE WHEN own > 0 THEN own ELSE best END AS score FROM cf), k AS (SELECT *, row_number() OVER (PARTITION BY repo_id, concept ORDER BY score DESC, path) AS rank FROM r) SELECT * FROM k WHERE rank <= 10""",
    "concept_flows": f"""WITH {_INDEX}, {_E}, d AS (SELECT *, {_FIRST.format('src', 'dst')} AS i FROM e), g AS (SELECT repo_id, src, string_agg(dst, ' ' ORDER BY dst) AS shown FROM d WHERE i <= 5 GROUP BY 1, 2)
      SELECT ci.repo_id, concept, rank, name, shown FROM ci JOIN g ON g.repo_id = ci.repo_id AND g.src = ci.name WHERE rank <= 5""",
    "answer_symbols": f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY coalesce(path, ''), ordinal NULLS FIRST, sym_id) AS i FROM symbols WHERE {' OR '.join(f"contains(lower(name), '{w}')" for w in _WORDS)}),
      k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS rank FROM m WHERE i = 1) SELECT repo_id, rank, name, type, coalesce(path, '') AS path, left(coalesce(doc, ''), 100) AS doc FROM k WHERE rank <= 10""",
    "explanation_context": f"""WITH {_INDEX}, {_E}, q AS (SELECT repo_id, concept, sum({_HITS}) + any_value({_POINTS}) AS score FROM ci WHERE rank <= 10 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, concept) AS place FROM q WHERE score > 0),
      a AS (SELECT repo_id, dst AS name, string_agg(src, ' ' ORDER BY src) AS callers FROM (SELECT *, {_FIRST.format('dst', 'src')} AS i FROM e) WHERE i <= 4 GROUP BY 1, 2), b AS (SELECT repo_id, src AS name, string_agg(dst, ' ' ORDER BY dst) AS callees FROM (SELECT *, {_FIRST.format('src', 'dst')} AS i FROM e) WHERE i <= 4 GROUP BY 1, 2),
      s AS (SELECT sym_id, min(coalesce(path, '')) AS path FROM symbols GROUP BY 1)
      SELECT ci.repo_id, ci.concept, place, rank, ci.sym_id, ci.name, s.path, coalesce(callers, '') AS callers, coalesce(callees, '') AS callees FROM ci JOIN p ON p.repo_id = ci.repo_id AND p.concept = ci.concept AND place <= 3 JOIN s ON s.sym_id = ci.sym_id
      LEFT JOIN a ON a.repo_id = ci.repo_id AND a.name = ci.name LEFT JOIN b ON b.repo_id = ci.repo_id AND b.name = ci.name WHERE rank <= 8""",
    "scoped_search": "SELECT DISTINCT sym_id, repo_id, path, name, type FROM symbols WHERE contains(lower(path), 'pkg/') AND contains(lower(name), 'merge')",
    "search_with_imports": f"WITH {quality_queries._I} SELECT DISTINCT repo_id, path, name, type FROM symbols WHERE contains(lower(name), 'beacon') UNION SELECT repo_id, path, module, 'import' FROM i WHERE contains(lower(module), 'beacon')",
    "flow_by_file": f"""WITH {_E}, w AS (SELECT * FROM e WHERE contains(lower(src), 'merge') OR contains(lower(src), 'filter')), n AS (SELECT repo_id, src AS name, count(*) AS calls FROM w GROUP BY 1, 2),
      g AS (SELECT repo_id, src AS name, string_agg(dst, ' ' ORDER BY dst) AS shown FROM (SELECT *, {_FIRST.format('src', 'dst')} AS i FROM w) WHERE i <= 3 GROUP BY 1, 2),
      f AS (SELECT repo_id, name, min(path) AS path FROM symbols WHERE name <> '' AND path IS NOT NULL GROUP BY 1, 2), o AS (SELECT n.repo_id, coalesce(f.path, 'unknown') AS path, n.name, calls, shown FROM n JOIN g USING (repo_id, name) LEFT JOIN f USING (repo_id, name))
      SELECT repo_id, path, name, calls, shown FROM (SELECT *, {_FIRST.format('path', 'name')} AS i FROM o) WHERE i <= 5""",
    "symbol_code": """WITH s AS (SELECT DISTINCT sym_id, repo_id, path, name, type FROM symbols WHERE name <> ''), b AS (SELECT * FROM symbol_bodies WHERE body <> ''), o AS (SELECT sym_id, min(body) AS body FROM b GROUP BY 1),
      t AS (SELECT repo_id, path, name, type, min((sym_id, body)) AS b FROM b GROUP BY 1, 2, 3, 4), a AS (SELECT repo_id, path, name, min((sym_id, body)) AS b FROM b GROUP BY 1, 2, 3)
      SELECT * FROM (SELECT s.*, length(coalesce(o.body, t.b[2], a.b[2])) AS characters FROM s LEFT JOIN o ON o.sym_id = s.sym_id LEFT JOIN t ON t.repo_id = s.repo_id AND t.path = s.path AND t.name = s.name AND t.type = s.type LEFT JOIN a ON a.repo_id = s.repo_id AND a.path = s.path AND a.name = s.name) WHERE characters IS NOT NULL""",
    "symbol_cards": f"""WITH {_E}, s AS (SELECT DISTINCT sym_id, repo_id, path, name, type, line, coalesce(len(params), 0) AS params FROM symbols WHERE contains(lower(name), 'merge')), c AS (SELECT repo_id, dst AS name, count(*) AS callers FROM e GROUP BY 1, 2),
      g AS (SELECT repo_id, dst AS name, string_agg(src, ' ' ORDER BY src) AS called_by FROM (SELECT *, {_FIRST.format('dst', 'src')} AS i FROM e) WHERE i <= 5 GROUP BY 1, 2),
      m AS (SELECT repo_id, path, class_name AS name, string_agg(DISTINCT name, ' ' ORDER BY name) AS members FROM symbols WHERE type = 'method' AND class_name <> '' AND name <> '' GROUP BY 1, 2, 3)
      SELECT s.*, coalesce(callers, 0) AS callers, coalesce(called_by, '') AS called_by, coalesce(members, '') AS members FROM s LEFT JOIN c USING (repo_id, name) LEFT JOIN g USING (repo_id, name) LEFT JOIN m ON m.repo_id = s.repo_id AND m.path = s.path AND m.name = s.name AND s.type = 'class'""",
    "first_matching_file": "WITH s AS (SELECT DISTINCT repo_id, path, sym_id, name, type, line FROM symbols WHERE contains(path, 'test')), f AS (SELECT repo_id, min(path) AS path FROM s GROUP BY 1) SELECT s.* FROM s JOIN f ON f.repo_id = s.repo_id AND f.path = s.path",
    "matching_starts": "WITH n AS (SELECT DISTINCT repo_id, src AS name FROM calls WHERE dst <> '' AND contains(lower(src), 'load')), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS i FROM n) SELECT repo_id, name FROM r WHERE i <= 3",
    "across_repositories": "SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type FROM symbols WHERE contains(lower(name), 'buffer') ORDER BY repo_id, path, ordinal, sym_id LIMIT 20",
    "search_payload": """WITH s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, left(coalesce(doc, ''), 60) AS doc, coalesce(array_to_string(params[1:3], ' '), '') AS params FROM symbols WHERE name IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path NULLS FIRST, ordinal NULLS FIRST, sym_id) AS rank FROM s) SELECT repo_id, rank, sym_id, path, name, type, doc, params FROM r WHERE rank <= 600""",
    "faceted_symbols": "SELECT DISTINCT repo_id, path, sym_id, name, type FROM symbols WHERE type = 'function' AND (contains(lower(name), 'grid') OR contains(lower(path), 'grid'))",
    "largest_modules": f"""WITH s AS (SELECT DISTINCT sym_id, repo_id, {_CLEAN.format('path')} AS path FROM symbols WHERE path <> ''), n AS (SELECT repo_id, split_part(path, '/', 1) AS module, count(*) AS symbols, count(DISTINCT path) AS files FROM s GROUP BY 1, 2 HAVING count(*) >= 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY symbols DESC, module) AS rank FROM n) SELECT repo_id, rank, module, symbols, files FROM r WHERE rank <= 15""",
    "snippet_lines": r"""WITH s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, line, coalesce(len(calls), 0) AS n FROM symbols WHERE path IS NOT NULL AND line IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY CASE WHEN coalesce(type, '') <> 'class' THEN 1 ELSE 0 END, -n, ordinal, sym_id) AS i FROM s), w AS (SELECT DISTINCT repo_id, path, name, greatest(line - 3, 1) AS first_line, line + 29 AS last_line FROM r WHERE i <= 5),
      f AS (SELECT repo_id, path, string_split(replace(replace(min(content), E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS a FROM files WHERE content <> '' AND path IS NOT NULL GROUP BY 1, 2), t AS (SELECT w.*, array_to_string(a[first_line:last_line], E'\n') AS snippet FROM w JOIN f USING (repo_id, path) WHERE first_line <= len(a))
      SELECT DISTINCT repo_id, path, name, first_line, length(snippet) AS characters, md5(snippet) AS fingerprint FROM t""",
    "rebuilt_bodies": r"""WITH s AS (SELECT DISTINCT sym_id, repo_id, path, line FROM symbols WHERE line >= 1 AND path IS NOT NULL), n AS (SELECT *, min(line) OVER (PARTITION BY repo_id, path ORDER BY line RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM s),
      f AS (SELECT repo_id, path, string_split(replace(replace(min(content), E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS a FROM files WHERE content <> '' AND path IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT sym_id, n.repo_id, n.path, array_to_string(a[greatest(line - 2, 1):coalesce(next - 1, len(a))], E'\n') AS body FROM n JOIN f ON f.repo_id = n.repo_id AND f.path = n.path WHERE greatest(line - 2, 1) <= len(a))
      SELECT DISTINCT sym_id, repo_id, path, length(body) AS characters, md5(body) AS fingerprint FROM b""",
    "top_caller_savings": f"""WITH {_E}, w AS (SELECT repo_id, sum(n // 4) AS raw FROM (SELECT repo_id, path, max(coalesce(length(content), 0)) AS n FROM files WHERE path IS NOT NULL GROUP BY 1, 2) GROUP BY 1), c AS (SELECT repo_id, src AS name, count(*) AS callees, sum(length(dst)) AS chars FROM e GROUP BY 1, 2),
      t AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY callees DESC, name) AS rank FROM c), o AS (SELECT repo_id, name, sum(d + length(name)) AS own FROM (SELECT DISTINCT sym_id, repo_id, name, length(coalesce(doc, '')) AS d FROM symbols WHERE name <> '') GROUP BY 1, 2),
      x AS (SELECT t.*, raw, greatest(1, (chars + coalesce(own, 0)) // 4) AS context_tokens FROM t LEFT JOIN o USING (repo_id, name) JOIN w ON w.repo_id = t.repo_id WHERE rank <= 3 AND raw > 0) SELECT repo_id, rank, name, callees, context_tokens, round((raw - context_tokens) * 100.0 / raw, 1) AS saved_percent FROM x""",
    "content_roles": f"WITH {_ROLES} SELECT * FROM cr",
    "layer_totals": f"""WITH {_ROLES}, a AS (SELECT repo_id, path, count(DISTINCT sym_id) AS n FROM symbols GROUP BY 1, 2), b AS (SELECT repo_id, path, count(DISTINCT (method, route)) AS n FROM ro GROUP BY 1, 2), c AS (SELECT repo_id, path, count(DISTINCT sym_id) AS n FROM en GROUP BY 1, 2)
      SELECT cr.repo_id, role, count(*) AS files, sum(coalesce(a.n, 0)) AS symbols, sum(coalesce(b.n, 0)) AS routes, sum(coalesce(c.n, 0)) AS entities FROM cr LEFT JOIN a ON a.repo_id = cr.repo_id AND a.path = cr.path LEFT JOIN b ON b.repo_id = cr.repo_id AND b.path = cr.path LEFT JOIN c ON c.repo_id = cr.repo_id AND c.path = cr.path GROUP BY 1, 2""",
    "reasoned_entry_points": rf"""WITH {quality_queries._ROUTES}, {_E}, s AS (SELECT DISTINCT repo_id, path, ordinal, sym_id, name, type FROM symbols WHERE name <> '' AND path IS NOT NULL AND coalesce(class_name, '') = ''), o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY ordinal, sym_id) AS n FROM s WHERE type IN ('function', 'class') AND lower(split_part({_CLEAN.format('path')}, '/', -1)) IN ({_ENTRY})),
      u AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY line, name) AS n FROM (SELECT DISTINCT repo_id, path, line, method || ' ' || route AS name FROM ro)), v AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY ordinal, sym_id) AS n FROM s WHERE type = 'function' AND NOT EXISTS (FROM e WHERE e.repo_id = s.repo_id AND e.dst = s.name)),
      r AS (SELECT repo_id, path, name, min((turn, n, reason)) AS r FROM (SELECT repo_id, path, name, 0 AS turn, n, 'entry_file' AS reason FROM o WHERE n <= 3 UNION ALL SELECT repo_id, path, name, 1, n, 'api_route' FROM u WHERE n <= 5 UNION ALL SELECT repo_id, path, name, 2, n, 'top_level' FROM v WHERE n <= 8) GROUP BY 1, 2, 3),
      p AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY r[1], r[2], name) AS i FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, r[1], r[2], name) AS place FROM p WHERE i <= 8) SELECT repo_id, place, name, path, r[3] AS reason FROM z WHERE place <= 12""",
    "output_recommendations": f"""WITH {_ROLES}, n AS (SELECT repo_id, count(DISTINCT sym_id) AS n FROM symbols GROUP BY 1), h AS (SELECT repo_id FROM ro UNION SELECT repo_id FROM en WHERE kind <> 'unknown')
      SELECT f.repo_id, 'docs diagrams report' || CASE WHEN h.repo_id IS NOT NULL THEN ' dashboard' ELSE '' END || CASE WHEN n BETWEEN 1 AND 500 THEN ' viz' ELSE '' END AS outputs FROM (SELECT DISTINCT repo_id FROM files WHERE repo_id IS NOT NULL) f LEFT JOIN n ON n.repo_id = f.repo_id LEFT JOIN h ON h.repo_id = f.repo_id""",
    "symbol_files": "SELECT repo_id, name, min(path) AS first_path, max(path) AS last_path FROM symbols WHERE name <> '' AND path IS NOT NULL GROUP BY 1, 2",
    "importing_files": f"""WITH {_E}, {_FE}, x AS (SELECT * FROM e WHERE src <> dst), d AS (SELECT repo_id, dst AS name, src AS "by" FROM x), r AS (SELECT * FROM d UNION SELECT d.repo_id, d.name, x.src FROM d JOIN x ON x.repo_id = d.repo_id AND x.dst = d."by" UNION SELECT repo_id, name, name FROM d),
      l AS (SELECT repo_id, name AS "by", {_CLEAN.format('max(path)')} AS path FROM symbols WHERE name <> '' AND path IS NOT NULL GROUP BY 1, 2), a AS (SELECT DISTINCT r.repo_id, r.name, l.path FROM r JOIN l USING (repo_id, "by")),
      i AS (SELECT DISTINCT a.repo_id, a.name, fe.src AS path FROM a JOIN fe ON fe.repo_id = a.repo_id AND fe.dst = a.path WHERE NOT contains(lower(a.path), 'test') AND NOT contains(lower(a.path), 'spec'))
      SELECT repo_id, name, count(*) AS importing_files FROM (SELECT * FROM i EXCEPT SELECT * FROM a) GROUP BY 1, 2""",
    "participants": f"""WITH RECURSIVE {_E}, d AS (SELECT *, {_FIRST.format('src', 'dst')} AS i FROM e WHERE src <> dst), t AS (SELECT DISTINCT repo_id, name AS seed FROM symbols WHERE sym_id % 100 = 0 AND name <> ''),
      w AS (SELECT repo_id, seed, seed AS name, 0 AS distance FROM t UNION SELECT w.repo_id, w.seed, d.dst, w.distance + 1 FROM w JOIN d ON d.repo_id = w.repo_id AND d.src = w.name AND d.i <= CASE WHEN w.distance = 0 THEN 10 ELSE 3 END WHERE w.distance < 4),
      n AS (SELECT repo_id, seed, name, min(distance) AS distance FROM w GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, seed ORDER BY distance, name) AS place FROM n) SELECT * FROM r WHERE place <= 15""",
    "entity_relations": """WITH s AS (SELECT DISTINCT repo_id, name, type, class_name, path FROM symbols WHERE name <> ''), c AS (SELECT DISTINCT repo_id, name AS class_name, path FROM s WHERE type = 'class'), m AS (SELECT s.repo_id, s.class_name, s.name AS method FROM s JOIN c ON c.repo_id = s.repo_id AND c.path = s.path AND c.class_name = s.class_name WHERE s.type = 'method')
      SELECT DISTINCT m.repo_id, m.class_name, o.class_name AS other, CASE WHEN contains(lower(method), 'many') OR contains(lower(method), 'list') OR contains(method, '[]') THEN 'many' ELSE 'one' END AS relation FROM m JOIN c o ON o.repo_id = m.repo_id AND o.class_name <> m.class_name AND contains(lower(method), lower(o.class_name))""",
    "most_called": f"WITH {_E}, n AS (SELECT repo_id, dst AS name, count(*) AS callers FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY callers DESC, name) AS rank FROM n) SELECT repo_id, rank, name, callers FROM r WHERE rank <= 10",
    "top_level_flows": f"""WITH {_E}, t AS (SELECT DISTINCT repo_id, src AS name FROM e WHERE NOT EXISTS (FROM e x WHERE x.repo_id = e.repo_id AND x.dst = e.src)), k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS rank FROM t),
      g AS (SELECT repo_id, src AS name, string_agg(dst, ' ' ORDER BY dst) AS shown FROM (SELECT *, {_FIRST.format('src', 'dst')} AS i FROM e) WHERE i <= 5 GROUP BY 1, 2) SELECT k.repo_id, rank, k.name, shown FROM k JOIN g USING (repo_id, name) WHERE rank <= 10""",
    "shortest_cycles": f"WITH c AS ({browse_queries.SQL['call_cycles']}) SELECT repo_id, length, replace(path, ' > ', ' ') AS nodes FROM c ORDER BY length, repo_id, nodes LIMIT 50",
    "trace_report": f"""WITH RECURSIVE {_E}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name) AS i FROM (SELECT DISTINCT repo_id, src AS name FROM e WHERE contains(lower(src), 'load'))) WHERE i <= 3), callers AS (SELECT DISTINCT repo_id, src FROM e),
      p(repo_id, start, path, at_, depth, ends) AS (SELECT repo_id, name, [name], name, 0, false FROM t UNION ALL SELECT p.repo_id, p.start, list_append(p.path, e.dst), e.dst, p.depth + 1, c.src IS NULL FROM p JOIN e ON e.repo_id = p.repo_id AND e.src = p.at_
        LEFT JOIN callers c ON c.repo_id = e.repo_id AND c.src = e.dst WHERE NOT p.ends AND p.depth < 5 AND NOT list_contains(p.path, e.dst)),
      d AS (SELECT repo_id, start, array_to_string(path, ' > ') AS path, row_number() OVER (PARTITION BY repo_id, start ORDER BY len(path), array_to_string(path, ' > ')) AS i FROM p WHERE ends),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY start, i) AS place FROM d WHERE i <= 5) SELECT repo_id, start, place, path FROM r WHERE place <= 50""",
    "changed_paths": f"SELECT repo_id, {_CLEAN.format('path')} AS path FROM files WHERE removed_at IS NOT NULL AND path <> '' UNION SELECT repo_id, {_CLEAN.format('file_path')} FROM snippets WHERE file_path <> '' UNION SELECT repo_id, {_CLEAN.format('src_path')} FROM file_deps WHERE src_path <> ''",
    "dry_run_sample": f"WITH {source_queries._R}, k AS (SELECT repo_id, path, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS rank FROM r WHERE reason IS NULL) SELECT repo_id, rank, path FROM k WHERE rank <= 20",
    "merged_workspace": f"WITH {_E} SELECT DISTINCT split_part(repo_id, '-', 1) AS repo_alias, split_part(repo_id, '-', 1) || ':' || src AS src, split_part(repo_id, '-', 1) || ':' || dst AS dst FROM e",
}
