"""Search queries, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, search
from ..tables import load


def _symbols(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "symbols")


def symbol_search(spark: SparkSession, root: str) -> DataFrame:
    return search.symbol_search(_symbols(spark, root), "Manifest", "function")


def file_scoped_search(spark: SparkSession, root: str) -> DataFrame:
    return search.symbol_search(_symbols(spark, root), "a", None, "tests/").select("sym_id", "repo_id", "path", "name")


def regex_search(spark: SparkSession, root: str) -> DataFrame:
    return search.regex_search(_symbols(spark, root), "^(get|set)_?[a-z]+.*Late$").select("sym_id", "name", "path")


def subsequence_search(spark: SparkSession, root: str) -> DataFrame:
    return search.subsequence_search(_symbols(spark, root), "gtpalc").select("sym_id", "name", "path")


def context_search(spark: SparkSession, root: str) -> DataFrame:
    return search.context_search(_symbols(spark, root), graph.call_edges(load(spark, root, "calls")), "handle")


def fuzzy_search(spark: SparkSession, root: str) -> DataFrame:
    return search.fuzzy_search(_symbols(spark, root), "normalizeMeter")


def fuzzy_best(spark: SparkSession, root: str) -> DataFrame:
    return search.fuzzy_best(_symbols(spark, root), "normalizeMeter")


def idf_table(spark: SparkSession, root: str) -> DataFrame:
    idf = search.inverse_frequencies(search.symbol_tokens(_symbols(spark, root)))
    return idf.select("token", "documents", F.round("idf", 6).alias("idf"))


def tfidf_search(spark: SparkSession, root: str) -> DataFrame:
    return search.tfidf_search(_symbols(spark, root), ["validate", "schema"])


def concept_index(spark: SparkSession, root: str) -> DataFrame:
    return search.concept_index(_symbols(spark, root))


QUERIES = (symbol_search, file_scoped_search, regex_search, subsequence_search, context_search, fuzzy_search, fuzzy_best, idf_table, tfidf_search, concept_index)
_S = "s AS (SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, line, params, calls, class_name, doc, framework FROM symbols)"


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(translate(regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_-/\\.', '     '), '[a-zA-Z]{{2,}}'), lambda x: lower(x))"


_T = f"""t AS (SELECT sym_id, token, count(*) AS n FROM (SELECT sym_id, unnest({_tokens("concat_ws(' ', name, array_to_string(params, ' '), array_to_string(calls, ' '), doc, class_name, framework, type, path)")}) AS token FROM s) GROUP BY 1, 2),
  i AS (SELECT token, count(*) AS documents, ln((SELECT count(DISTINCT sym_id) FROM t) / (1 + count(*))) AS idf FROM t GROUP BY 1)"""
_QUERY = ["validate", "schema"]
_WIDE = list(dict.fromkeys([*_QUERY, *(w for t in _QUERY for w in search.SYNONYMS.get(t, []))]))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CONCEPT = " UNION ALL ".join(
    f"SELECT sym_id, repo_id, name, '{c}' AS concept, " + " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(doc, '')), '{w}') THEN 1 ELSE 0 END" for w in words) + " AS score FROM x"
    for c, words in search.CONCEPTS.items()
)
SQL = {
    "symbol_search": "SELECT DISTINCT sym_id, repo_id, path, ordinal, name, type, line FROM symbols WHERE contains(lower(name), 'manifest') AND type = 'function'",
    "file_scoped_search": "SELECT DISTINCT sym_id, repo_id, path, name FROM symbols WHERE contains(lower(name), 'a') AND contains(lower(path), 'tests/')",
    "regex_search": "SELECT DISTINCT sym_id, name, path FROM symbols WHERE regexp_matches(name, '^(get|set)_?[a-z]+.*Late$', 'i')",
    "subsequence_search": "SELECT DISTINCT sym_id, name, path FROM symbols WHERE regexp_matches(lower(name), 'g.*t.*p.*a.*l.*c')",
    "context_search": f"""WITH {_S}, e AS (SELECT DISTINCT repo_id, src, dst FROM calls WHERE src <> '' AND dst <> ''), c AS (SELECT repo_id, dst, count(*) AS callers FROM e GROUP BY 1, 2),
      f AS (SELECT s.*, coalesce(c.callers, 0) AS callers FROM s LEFT JOIN c ON c.repo_id = s.repo_id AND c.dst = s.name
        WHERE contains(lower(name), 'handle') OR coalesce(len(list_filter(calls, lambda x: contains(lower(x), 'handle'))) > 0, false) OR coalesce(contains(lower(class_name), 'handle'), false) OR coalesce(len(list_filter(params, lambda x: contains(lower(x), 'handle'))) > 0, false)),
      g AS (SELECT *, CASE WHEN lower(name) = 'handle' THEN 100 WHEN starts_with(lower(name), 'handle') THEN 50 WHEN contains(lower(name), 'handle') THEN 10 ELSE 0 END + 5 * least(callers, 5) + 2 * least(coalesce(len(calls), 0), 5)
        + CASE WHEN type = 'class' THEN 15 WHEN type IN ('function', 'method') THEN 10 WHEN type = 'interface' THEN 5 ELSE 0 END AS score FROM f),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path, ordinal, sym_id) AS rank FROM g)
      SELECT repo_id, rank, sym_id, name, type, path, line, callers, score FROM r WHERE rank <= 5""",
    "idf_table": f"WITH {_S}, {_T} SELECT token, documents, round(idf, 6) AS idf FROM i",
    "tfidf_search": f"""WITH {_S}, {_T}, z AS (SELECT sym_id, sum(n) AS size FROM t GROUP BY 1), w AS (SELECT t.sym_id, t.token, n / size * idf AS w FROM t JOIN z USING (sym_id) JOIN i USING (token)),
      q AS (SELECT token, idf / {len(_WIDE)} AS q FROM i WHERE list_contains({_list(_WIDE)}, token)), qn AS (SELECT sqrt(sum(q * q)) AS qn FROM q),
      d AS (SELECT sym_id, sum(w * q) AS dot, sqrt(sum(w * w)) AS dn FROM w LEFT JOIN q USING (token) GROUP BY 1 HAVING sum(w * q) IS NOT NULL),
      r AS (SELECT d.sym_id, repo_id, name, type, path, round(dot / dn / qn + CASE WHEN list_has_any({_tokens('name')}, {_list(_QUERY)}) THEN 0.5 WHEN list_has_any({_tokens('name')}, {_list(_WIDE)}) THEN 0.2 ELSE 0 END, 3) AS score
        FROM d, qn, (SELECT DISTINCT sym_id, repo_id, name, type, path FROM symbols) n WHERE n.sym_id = d.sym_id AND dn > 0)
      SELECT * FROM r WHERE score > 0.01 ORDER BY score DESC, sym_id LIMIT 10""",
    "concept_index": f"""WITH x AS (SELECT DISTINCT sym_id, repo_id, name, doc FROM symbols WHERE name IS NOT NULL), h AS ({_CONCEPT}),
      r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, concept ORDER BY score DESC, sym_id) AS rank FROM h WHERE score > 0) SELECT * FROM r WHERE rank <= 15""",
}
