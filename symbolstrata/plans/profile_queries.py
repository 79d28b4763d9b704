"""Profile queries, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from ..operators import graph, profile
from ..tables import extension, load


def _t(spark: SparkSession, root: str, *names: str) -> list[DataFrame]:
    return [load(spark, root, n) for n in names]


def _ids(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return load(spark, root, "symbols").select("sym_id", "repo_id", *columns).distinct()


def project_stats(spark: SparkSession, root: str) -> DataFrame:
    files, symbols, calls = _t(spark, root, "files", "symbols", "calls")
    return profile.project_stats(files, symbols, graph.call_edges(calls))


def symbol_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return _ids(spark, root, "type").groupBy("repo_id", "type").agg(F.count("*").alias("symbols"))


def language_counts(spark: SparkSession, root: str) -> DataFrame:
    f = profile.unique_files(load(spark, root, "files"))
    return f.groupBy("repo_id", profile.language(F.col("ext")).alias("language")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def directory_groups(spark: SparkSession, root: str) -> DataFrame:
    f = profile.unique_files(load(spark, root, "files"))
    return f.groupBy("repo_id", F.element_at(F.split("path", "/"), 1).alias("folder")).agg(F.count("*").alias("files"))


def layer_stats(spark: SparkSession, root: str) -> DataFrame:
    roles = profile.unique_files(load(spark, root, "files")).select("repo_id", "path", F.coalesce("role", F.lit("core")).alias("role"))
    n = _ids(spark, root, "path").groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    return roles.join(n, ["repo_id", "path"], "left").groupBy("repo_id", "role").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("symbols"))


def file_roles(spark: SparkSession, root: str) -> DataFrame:
    """The role that each file's path suggests."""
    return load(spark, root, "files").where("path is not null").select("repo_id", "path", profile.role_of(F.col("path")).alias("role")).distinct()


def top_files(spark: SparkSession, root: str) -> DataFrame:
    return profile.top_files(load(spark, root, "symbols"))


def framework_counts(spark: SparkSession, root: str) -> DataFrame:
    s = _ids(spark, root, "framework").withColumn("framework", profile.normal_framework(F.col("framework"))).where("framework is not null")
    return s.groupBy("repo_id", "framework").agg(F.count("*").alias("symbols"))


def entry_points(spark: SparkSession, root: str) -> DataFrame:
    symbols, calls = _t(spark, root, "symbols", "calls")
    return profile.entry_points(symbols, graph.call_edges(calls))


def recommendations(spark: SparkSession, root: str) -> DataFrame:
    return profile.recommendations(*_t(spark, root, "files", "symbols"))


def symbols_per_file_bars(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of each file as whole percent of the repository's largest."""
    n = _ids(spark, root, "path").where("path is not null").groupBy("repo_id", "path").agg(F.count("*").alias("symbols"))
    return profile.share_of_max(n, "symbols", "repo_id")


def next_symbol_line(spark: SparkSession, root: str) -> DataFrame:
    """The line of the next symbol that starts strictly later in the file: where a body ends."""
    s = _ids(spark, root, "path", "line").where("line is not null")
    w = W.partitionBy("repo_id", "path").orderBy("line").rangeBetween(1, W.unboundedFollowing)
    return s.withColumn("next_line", F.min("line").over(w))


def consecutive_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of symbols that follow each other in a file."""
    s = _ids(spark, root, "path", "ordinal", "name")
    w = W.partitionBy("repo_id", "path").orderBy("ordinal", "sym_id")
    return s.withColumn("next_name", F.lead("name").over(w)).where("next_name is not null").select("repo_id", "path", "name", "next_name")


def class_methods(spark: SparkSession, root: str) -> DataFrame:
    """Methods of each class in its file, in order."""
    s = _ids(spark, root, "path", "ordinal", "name", "type", "class_name")
    c = s.where("type = 'class'").select("repo_id", "path", F.col("name").alias("class_name")).distinct()
    m = s.where("type = 'method'").select("repo_id", "path", "class_name", "ordinal", "name")
    return c.join(m, ["repo_id", "path", "class_name"]).select("repo_id", "path", "class_name", "ordinal", F.col("name").alias("method"))


def class_doc_references(spark: SparkSession, root: str) -> DataFrame:
    """Classes whose doc names another class of the repository."""
    c = load(spark, root, "symbols").where("type = 'class' and name <> ''").select("repo_id", "name", "doc").distinct()
    words = c.where("doc is not null").select("repo_id", "name", F.explode(F.array_distinct(F.regexp_extract_all("doc", F.lit(r"(\w+)"), F.lit(1)))).alias("other"))
    names = c.select("repo_id", F.col("name").alias("other")).distinct()
    return words.where("other <> name").join(names, ["repo_id", "other"], "left_semi").select("repo_id", "name", "other").distinct()


def index_sizes(spark: SparkSession, root: str) -> DataFrame:
    f = profile.unique_files(load(spark, root, "files"))
    return f.groupBy(F.lower(extension(F.col("path"))).alias("ext")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("size_bytes").alias("largest"))


def token_savings(spark: SparkSession, root: str) -> DataFrame:
    """Estimated tokens of a repository's files beside those of its symbols' names and docs."""
    raw = load(spark, root, "files").where("path is not null").select("repo_id", "path", token_estimate(F.col("content")).alias("n")).groupBy("repo_id", "path").agg(F.max("n").alias("n")).groupBy("repo_id").agg(F.sum("n").alias("raw_tokens"))
    own = _ids(spark, root, "name", "doc").select("repo_id", (token_estimate(F.col("name")) + token_estimate(F.col("doc"))).alias("n")).groupBy("repo_id").agg(F.sum("n").alias("context_tokens"))
    return raw.join(own, "repo_id").withColumn("saved_percent", F.round((F.col("raw_tokens") - F.col("context_tokens")) * 100.0 / F.col("raw_tokens"), 1))


QUERIES = (project_stats, symbol_type_counts, language_counts, directory_groups, layer_stats, file_roles, top_files, framework_counts, entry_points, recommendations, symbols_per_file_bars, next_symbol_line, consecutive_symbols, class_methods, class_doc_references, index_sizes, token_savings)

_F = "f AS (SELECT repo_id, path, max(ext) AS ext, max(size_bytes) AS size_bytes, max(role) AS role FROM files WHERE path IS NOT NULL GROUP BY 1, 2)"
_E = "e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> '')"
_ROLE = "CASE WHEN regexp_matches(p, '/(cli|manage)\\.py$') THEN 'cli' " + " ".join(f"WHEN {' OR '.join(f'''contains(p, '{n}')''' for n in needles)} THEN '{role}'" for role, needles in profile.ROLES) + " ELSE 'core' END"
_PATHS = r"SELECT DISTINCT repo_id, path, '/' || lower(regexp_replace(replace(path, '\', '/'), '^\./', '')) AS p FROM files WHERE path IS NOT NULL"
_LANGUAGE = "CASE lower(ext) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in profile.LANGUAGES.items()) + " END"
_FRAMEWORK = "CASE WHEN framework IS NULL OR framework = '' THEN NULL " + " ".join(f"WHEN contains(lower(framework), '{n}') THEN '{n}'" for n in profile.FRAMEWORKS) + " ELSE lower(framework) END"
SQL = {
    "project_stats": f"""WITH {_E}, f AS (SELECT repo_id, count(DISTINCT path) AS files FROM files GROUP BY 1),
      s AS (SELECT repo_id, count(*) AS symbols, count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'method') AS methods, count(*) FILTER (type = 'class') AS classes FROM (SELECT DISTINCT repo_id, sym_id, type FROM symbols) GROUP BY 1),
      c AS (SELECT repo_id, count(*) AS edges, count(DISTINCT src) AS callers FROM e GROUP BY 1)
      SELECT repo_id, coalesce(files, 0) AS files, coalesce(symbols, 0) AS symbols, coalesce(functions, 0) AS functions, coalesce(methods, 0) AS methods, coalesce(classes, 0) AS classes, coalesce(edges, 0) AS edges, coalesce(callers, 0) AS callers FROM f FULL JOIN s USING (repo_id) FULL JOIN c USING (repo_id)""",
    "symbol_type_counts": "SELECT repo_id, type, count(*) AS symbols FROM (SELECT DISTINCT sym_id, repo_id, type FROM symbols) GROUP BY 1, 2",
    "language_counts": f"WITH {_F} SELECT repo_id, {_LANGUAGE} AS language, count(*) AS files, sum(size_bytes) AS bytes FROM f GROUP BY 1, 2",
    "directory_groups": f"WITH {_F} SELECT repo_id, split_part(path, '/', 1) AS folder, count(*) AS files FROM f GROUP BY 1, 2",
    "layer_stats": f"""WITH {_F}, n AS (SELECT repo_id, path, count(*) AS n FROM (SELECT DISTINCT sym_id, repo_id, path FROM symbols) GROUP BY 1, 2)
      SELECT f.repo_id, coalesce(role, 'core') AS role, count(*) AS files, sum(coalesce(n, 0)) AS symbols FROM f LEFT JOIN n ON n.repo_id = f.repo_id AND n.path = f.path GROUP BY 1, 2""",
    "file_roles": f"SELECT repo_id, path, {_ROLE} AS role FROM ({_PATHS})",
    "top_files": """WITH n AS (SELECT repo_id, path, count(DISTINCT sym_id) AS symbols FROM symbols WHERE path IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY symbols DESC, path) AS rank FROM n) SELECT * FROM r WHERE rank <= 10""",
    "framework_counts": f"SELECT repo_id, fw AS framework, count(*) AS symbols FROM (SELECT DISTINCT sym_id, repo_id, {_FRAMEWORK} AS fw FROM symbols) WHERE fw IS NOT NULL GROUP BY 1, 2",
    "entry_points": f"""WITH {_E}, t AS (SELECT DISTINCT repo_id, path, ordinal, name, sym_id FROM symbols WHERE type = 'function' AND (class_name IS NULL OR class_name = '') AND name <> ''),
      r AS (SELECT t.*, row_number() OVER (PARTITION BY repo_id, path ORDER BY ordinal, sym_id) AS rank FROM t WHERE NOT EXISTS (FROM e WHERE e.repo_id = t.repo_id AND e.dst = t.name)) SELECT repo_id, path, name, rank FROM r WHERE rank <= 8""",
    "recommendations": f"""WITH r AS (SELECT repo_id, bool_or(role = 'ui') AS ui, bool_or(role = 'cli') AS cli, bool_or(role = 'api') AS api, bool_or(role = 'data') AS data FROM (SELECT repo_id, {_ROLE} AS role FROM ({_PATHS})) GROUP BY 1),
      w AS (SELECT repo_id, bool_or(coalesce(list_contains({[str(x) for x in profile.FRONTEND]}, {_FRAMEWORK}), false)) AS front, coalesce(bool_or(framework <> ''), false) AS any_ FROM symbols GROUP BY 1)
      SELECT r.repo_id, 'overview tech hotspots' || CASE WHEN api THEN ' routes' ELSE '' END || CASE WHEN data THEN ' entities' ELSE '' END || CASE WHEN ui OR coalesce(front, false) THEN ' frontend' ELSE '' END || CASE WHEN cli THEN ' cli' ELSE '' END || CASE WHEN coalesce(any_, false) THEN ' imports' ELSE '' END AS reports FROM r LEFT JOIN w ON w.repo_id = r.repo_id""",
    "symbols_per_file_bars": "WITH n AS (SELECT repo_id, path, count(DISTINCT sym_id) AS symbols FROM symbols WHERE path IS NOT NULL GROUP BY 1, 2) SELECT *, symbols * 100 // max(symbols) OVER (PARTITION BY repo_id) AS percent FROM n",
    "next_symbol_line": "SELECT *, min(line) OVER (PARTITION BY repo_id, path ORDER BY line RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line FROM (SELECT DISTINCT sym_id, repo_id, path, line FROM symbols WHERE line IS NOT NULL)",
    "consecutive_symbols": "SELECT repo_id, path, name, next_name FROM (SELECT *, lead(name) OVER (PARTITION BY repo_id, path ORDER BY ordinal, sym_id) AS next_name FROM (SELECT DISTINCT sym_id, repo_id, path, ordinal, name FROM symbols)) WHERE next_name IS NOT NULL",
    "class_methods": """WITH s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, class_name FROM symbols), c AS (SELECT DISTINCT repo_id, path, name FROM s WHERE type = 'class')
      SELECT m.repo_id, m.path, m.class_name, m.ordinal, m.name AS method FROM c JOIN s m ON m.repo_id = c.repo_id AND m.path = c.path AND m.class_name = c.name WHERE m.type = 'method'""",
    "class_doc_references": r"""WITH c AS (SELECT DISTINCT repo_id, name, doc FROM symbols WHERE type = 'class' AND name <> ''), w AS (SELECT DISTINCT repo_id, name, unnest(regexp_extract_all(doc, '\w+')) AS other FROM c WHERE doc IS NOT NULL)
      SELECT DISTINCT w.repo_id, w.name, w.other FROM w JOIN c ON c.repo_id = w.repo_id AND c.name = w.other WHERE w.other <> w.name""",
    "index_sizes": rf"WITH {_F} SELECT lower(regexp_extract(path, '(\.[^./\\]+)$', 1)) AS ext, count(*) AS files, sum(size_bytes) AS bytes, max(size_bytes) AS largest FROM f GROUP BY 1",
    "token_savings": """WITH r AS (SELECT repo_id, sum(n) AS raw_tokens FROM (SELECT repo_id, path, max(coalesce(greatest(1, length(content) // 4), 0)) AS n FROM files WHERE path IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
      c AS (SELECT repo_id, sum(CASE WHEN name IS NULL THEN 0 ELSE greatest(1, length(name) // 4) END + CASE WHEN doc IS NULL THEN 0 ELSE greatest(1, length(doc) // 4) END) AS context_tokens FROM (SELECT DISTINCT sym_id, repo_id, name, doc FROM symbols) GROUP BY 1)
      SELECT repo_id, raw_tokens, context_tokens, round((raw_tokens - context_tokens) * 100.0 / raw_tokens, 1) AS saved_percent FROM r JOIN c USING (repo_id)""",
}
