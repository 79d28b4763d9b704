"""Queries on source text and code quality, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import extract, filters, frameworks, quality
from ..tables import load


def _files(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "files")


def dead_code(spark: SparkSession, root: str) -> DataFrame:
    used = extract.imported_names(extract.imports(_files(spark, root)))
    return quality.dead_code(load(spark, root, "symbols"), load(spark, root, "calls"), used)


def complexity(spark: SparkSession, root: str) -> DataFrame:
    return quality.source_metrics(load(spark, root, "symbols"), _files(spark, root))


def complexity_ratings(spark: SparkSession, root: str) -> DataFrame:
    m = quality.source_metrics(load(spark, root, "symbols"), _files(spark, root))
    return m.groupBy("repo_id", "rating").agg(F.count("*").alias("symbols"), F.max("score").alias("highest"))


def exact_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return quality.exact_duplicates(load(spark, root, "symbol_bodies"))


def near_duplicates(spark: SparkSession, root: str) -> DataFrame:
    return quality.near_duplicates(load(spark, root, "symbol_bodies"))


def duplicate_links(spark: SparkSession, root: str) -> DataFrame:
    """Links between classes of near duplicates, the most alike first."""
    return quality.duplicate_links(load(spark, root, "symbol_bodies")).orderBy(F.desc("similarity"), "class_a", "class_b")


def doc_coverage(spark: SparkSession, root: str) -> DataFrame:
    return quality.doc_coverage(load(spark, root, "symbols"))


def declarations(spark: SparkSession, root: str) -> DataFrame:
    return extract.declarations(_files(spark, root))


def imports(spark: SparkSession, root: str) -> DataFrame:
    return extract.imports(_files(spark, root))


def called_names(spark: SparkSession, root: str) -> DataFrame:
    return extract.called_names(load(spark, root, "symbol_bodies"))


def routes(spark: SparkSession, root: str) -> DataFrame:
    return extract.routes(_files(spark, root))


def findings(spark: SparkSession, root: str) -> DataFrame:
    return extract.findings(_files(spark, root))


def findings_summary(spark: SparkSession, root: str) -> DataFrame:
    return extract.findings(_files(spark, root)).groupBy("category", "severity").agg(F.count("*").alias("n"), F.min(extract.severity_rank(F.col("severity"))).alias("rank"))


def smells(spark: SparkSession, root: str) -> DataFrame:
    """Doubtful code in Python and script files outside folders of installed or built files."""
    scripts = F.lower("path").rlike(r"\.(?:py|js|ts|jsx|tsx)$")
    return extract.smells(_files(spark, root).where(scripts & filters.scanned(F.col("path"))))


def package_symbols(spark: SparkSession, root: str) -> DataFrame:
    return extract.package_symbols(_files(spark, root))


def line_counts(spark: SparkSession, root: str) -> DataFrame:
    return extract.line_counts(_files(spark, root))


def endpoints(spark: SparkSession, root: str) -> DataFrame:
    return extract.endpoints(_files(spark, root))


def entities(spark: SparkSession, root: str) -> DataFrame:
    return frameworks.entities(load(spark, root, "symbol_bodies"))


def entity_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Entity classes per repository and kind."""
    return frameworks.entities(load(spark, root, "symbol_bodies")).select("sym_id", "repo_id", "kind").distinct().groupBy("repo_id", "kind").agg(F.count("*").alias("classes"))


def detected_frameworks(spark: SparkSession, root: str) -> DataFrame:
    return frameworks.detected_frameworks(load(spark, root, "symbol_bodies"))


def unlabelled_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Per repository and framework label of the index (none: null): symbols, and how many of them a rule labels."""
    s = load(spark, root, "symbols").select("sym_id", "repo_id", "framework").distinct()
    found = frameworks.detected_frameworks(load(spark, root, "symbol_bodies")).select("sym_id", F.lit(1).alias("rule")).distinct()
    return s.join(found, "sym_id", "left").groupBy("repo_id", "framework").agg(F.count("*").alias("symbols"), F.count("rule").alias("by_rule"))


def external_modules_of_code(spark: SparkSession, root: str) -> DataFrame:
    """Imported modules of each repository, split into its own (relative ones) and others: repo_id, module, internal, files."""
    i = extract.imports(_files(spark, root)).select("repo_id", "path", "module").distinct()
    return i.groupBy("repo_id", "module", F.col("module").startswith(".").alias("internal")).agg(F.count("*").alias("files"))


def signatures(spark: SparkSession, root: str) -> DataFrame:
    """Declarations with parameters, return type, modifiers, decorators and doc; lists joined by a blank."""
    s = extract.signatures(_files(spark, root))
    return s.select("repo_id", "path", "line", "type", "name", *[F.array_join(c, " ").alias(c) for c in ("params", "modifiers", "decorators")], "return_type", "doc")


def signature_agreement(spark: SparkSession, root: str) -> DataFrame:
    return extract.signature_agreement(extract.signatures(_files(spark, root)), load(spark, root, "symbols"))


def endpoint_summary(spark: SparkSession, root: str) -> DataFrame:
    return extract.endpoint_summary(_files(spark, root))


def most_complex(spark: SparkSession, root: str) -> DataFrame:
    """The 20 functions with the highest score of at least 20; ties by symbol."""
    m = quality.source_metrics(load(spark, root, "symbols"), _files(spark, root)).where("score >= 20")
    return m.orderBy(F.desc("score"), "sym_id").limit(20).select("sym_id", "repo_id", "name", "score", "rating")


def dead_code_report(spark: SparkSession, root: str) -> DataFrame:
    """Dead symbols of each repository: their number and the first 50 by path, line and symbol."""
    d = dead_code(spark, root)
    ranked = d.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("path", "line", "sym_id"))).where("rank <= 50")
    return ranked.join(d.groupBy("repo_id").agg(F.count("*").alias("all_dead")), "repo_id").select("repo_id", "rank", "sym_id", "name", "path", "all_dead")


QUERIES = (duplicate_links, package_symbols, external_modules_of_code, signatures, signature_agreement, endpoints, endpoint_summary, entities, entity_kinds, most_complex, dead_code_report, detected_frameworks, unlabelled_symbols, dead_code, complexity, complexity_ratings, exact_duplicates, near_duplicates, doc_coverage, declarations, imports, called_names, routes, findings, findings_summary, smells, line_counts)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_L = r"""l AS (SELECT DISTINCT repo_id, path, i AS line, parts[i] AS text FROM (SELECT repo_id, path, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT repo_id, path, string_split(replace(replace(content, E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS parts FROM files WHERE content <> '' AND path IS NOT NULL)))"""


def _kind(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {_q(e)}) AND regexp_matches(text, {_q(p)}) THEN {v}" for (_, e, _, p), v in zip(extract.DECLARATIONS, values, strict=True)) + " END"


_NAME_OF = _kind([f"regexp_extract(text, {_q(p)}, 1)" for _, _, _, p in extract.DECLARATIONS])
_FROM, _IMPORT, _SCRIPT = extract.FROM, extract.IMPORT, extract.SCRIPT


def _names(text: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split(replace(replace({text}, '(', ''), ')', ''), ','), lambda p: trim(regexp_replace(p, '\\s+as\\s+\\w+', '', 'g'))), lambda p: p <> ''), ' ')"


_I = rf"""{_L}, il AS (SELECT repo_id, path, line, regexp_replace(text, '\s+#.*$', '') AS text, ends_with(lower(path), '.py') AS py FROM l WHERE regexp_matches(text, '^\s*(?:import|from)\b')),
  i AS (SELECT DISTINCT repo_id, path, line, CASE WHEN py AND regexp_matches(text, {_q(_FROM)}) THEN regexp_extract(text, {_q(_FROM)}, 1) WHEN py AND regexp_matches(text, {_q(_IMPORT)}) THEN regexp_extract(text, {_q(_IMPORT)}, 1)
      WHEN NOT py AND regexp_matches(text, {_q(_SCRIPT)}) THEN regexp_extract(text, {_q(_SCRIPT)}, 4) END AS module,
    CASE WHEN py AND regexp_matches(text, {_q(_FROM)}) THEN {_names(f"regexp_extract(text, {_q(_FROM)}, 2)")} WHEN py THEN split_part(regexp_extract(text, {_q(_IMPORT)}, 1), '.', -1)
      ELSE {_names(f"regexp_extract(text, {_q(_SCRIPT)}, 1) || ',' || regexp_extract(text, {_q(_SCRIPT)}, 2) || ',' || regexp_extract(text, {_q(_SCRIPT)}, 3)")} END AS imported FROM il)"""
_ENTRY = f"""coalesce(framework, '') <> '' OR list_contains({quality.ENTRY_NAMES}, lower(name)) OR coalesce(type, '') = 'class' OR contains(lower(coalesce(path, '')), 'test') OR contains(lower(coalesce(path, '')), 'spec')
  OR list_contains({quality.LIFECYCLE}, name) OR (starts_with(name, '__') AND ends_with(name, '__')) OR starts_with(name, 'get_') OR starts_with(name, 'post_') OR starts_with(name, 'handle_')"""


def _steps(column: str, limits: list[tuple[int, int]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} > {a} THEN {b}" for a, b in limits) + " ELSE 0 END"


_SCORE = " + ".join(_steps(*x) for x in (("lines", [(100, 30), (50, 20), (25, 10), (10, 5)]), ("cyclomatic", [(20, 30), (10, 20), (5, 10), (3, 5)]), ("nesting", [(5, 20), (3, 10), (2, 5)]), ("params", [(7, 10), (4, 5)]), ("calls", [(15, 10), (8, 5)])))
_INDENT = r"length(regexp_extract({}, '^([ \t]*)', 1))"
_M = rf"""s AS (SELECT DISTINCT sym_id, repo_id, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, name, line, end_line, coalesce(len(params), 0) AS params, coalesce(len(list_distinct(calls)), 0) AS calls FROM symbols WHERE type IN ('function', 'method') AND line >= 1 AND end_line >= line),
  f AS (SELECT repo_id, regexp_replace(replace(path, '\', '/'), '^\./', '') AS path, min(content) AS content FROM files WHERE content <> '' AND path IS NOT NULL GROUP BY 1, 2),
  j AS (SELECT s.*, string_split(replace(replace(content, E'\r\n', E'\n'), E'\r', E'\n'), E'\n') AS a FROM s JOIN f ON f.repo_id = s.repo_id AND f.path = s.path),
  k AS (SELECT sym_id, repo_id, name, params, calls, a[line] AS head, list_filter(a[line + 1:end_line], lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(#|//|\*)')) AS code FROM j WHERE line <= len(a)),
  m AS (SELECT sym_id, repo_id, name, params, calls, len(code) AS lines, 1 + len(regexp_extract_all(array_to_string(code, E'\n'), '\b(if|elif|else if|for|while|catch|except|case|&&|\|\||and |or |when)\b')) AS cyclomatic,
    greatest(coalesce(list_max(list_transform(code, lambda x: CAST(floor(({_INDENT.format('x')} - {_INDENT.format('head')}) / 4) AS INTEGER))), 0), 0) AS nesting FROM k),
  c AS (SELECT *, least({_SCORE}, 100) AS score FROM m), r AS (SELECT *, CASE WHEN score < 20 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'critical' END AS rating FROM c)"""
_CODE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(body, E'\r\n', E'\n'), E'\r', E'\n'), '(?m)^\s*(#|//|/?\*).*$', '', 'g'), '"[^"\n]*"|''[^''\n]*''', 'STR', 'g'), '(#|//).*', '', 'g'), '\d+', 'NUM', 'g'), '\s+', ' ', 'g'))"""
_FIND = " UNION ALL ".join(f"SELECT repo_id, path, line, {i} AS rule, {_q(c)} AS category, {_q(s)} AS severity, {_q(d)} AS description FROM x WHERE regexp_matches(text, {_q(p)}, 'i')" for i, (c, s, d, p) in enumerate(extract.FINDINGS))
_FINDINGS = rf"""{_L}, x AS (SELECT * FROM l WHERE NOT regexp_matches(trim(text), '^(#|//|\*)')), h AS ({_FIND}), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, category ORDER BY rule) AS n FROM h WHERE NOT (category = 'unsafe_code' AND regexp_matches(lower(path), 'test|spec'))),
  g AS (SELECT repo_id, path, line, category, severity, description FROM n WHERE n = 1)"""
def _fits(rule: tuple) -> str:
    tests = [] if rule[1] is None else [f"NOT regexp_matches(name, {_q(rule[1][1:])})" if rule[1].startswith("!") else f"regexp_matches(name, {_q(rule[1])})"]
    return " AND ".join(tests + [f"regexp_matches(body, {_q(p)})" for p in frameworks.body_patterns(rule)])


_FW = "CASE WHEN body IS NULL THEN NULL " + " ".join(
    f"WHEN regexp_matches(lower(path), {_q(ext)})" + (f" AND type IN ({', '.join(map(_q, kinds))})" if kinds else "") + " THEN CASE " + " ".join(f"WHEN {_fits(r)} THEN {_q(r[0])}" for r in rules) + " END"
    for ext, kinds, rules in frameworks.RULES
) + " END"
_D = f"fw AS (SELECT DISTINCT sym_id, {_FW} AS framework FROM symbol_bodies), g AS (SELECT * FROM fw WHERE framework IS NOT NULL)"
_NEXT = r"((contains(replace(path, '\', '/'), '/api/') OR contains('/' || replace(path, '\', '/'), '/app/')) AND contains(path, 'route.'))"


def _endpoint(framework: str, ext: str, pattern: str, method: str | int, route: int) -> str:
    routes_ = f"regexp_extract_all(text, {_q(pattern)}, {route})"
    methods = f"list_transform({routes_}, lambda x: {_q(method)})" if isinstance(method, str) else f"list_transform(regexp_extract_all(text, {_q(pattern)}, {method}), lambda x: upper(x))"
    return f"SELECT repo_id, path, line, unnest({methods}) AS method, unnest({routes_}) AS route, '{framework}' AS framework FROM x WHERE regexp_matches(lower(path), {_q(ext)}) AND NOT {_NEXT}"


_NAMED = f"list_distinct(regexp_extract_all(upper(regexp_extract(text, {_q(extract._FLASK_METHODS)}, 1)), '(GET|POST|PUT|DELETE|PATCH)', 1))"
_PAGE = "regexp_extract(replace(path, '\\', '/'), 'pages(/.*?)\\.(?:ts|js|tsx|jsx)', 1)"
_APP = "regexp_extract(replace(path, '\\', '/'), '(?:src/)?app(/.*)/route\\.(?:ts|js|tsx|jsx)', 1)"
_ROUTES = f"""{_L}, x AS (SELECT * FROM l WHERE NOT regexp_matches(trim(text), '^(?:#|//)')), ro AS (SELECT DISTINCT repo_id, path, line, CASE method WHEN 'REQUEST' THEN 'GET' ELSE method END AS method, route, framework FROM (
  {" UNION ALL ".join(_endpoint(*e) for e in extract.ENDPOINTS)}
  UNION ALL SELECT repo_id, path, line, unnest(CASE WHEN len({_NAMED}) > 0 THEN {_NAMED} ELSE ['GET'] END), regexp_extract(text, {_q(extract._FLASK_ROUTE)}, 1), 'flask' FROM x WHERE ends_with(lower(path), '.py') AND regexp_matches(text, {_q(extract._FLASK_ROUTE)}) AND NOT {_NEXT}
  UNION ALL SELECT repo_id, path, line, unnest(regexp_extract_all(text, {_q(extract._NEXT_EXPORT)}, 1)), CASE WHEN {_APP} <> '' THEN {_APP} WHEN {_PAGE} = '/index' THEN '/' WHEN {_PAGE} <> '' THEN regexp_replace({_PAGE}, '/index$', '') ELSE replace(path, '\\', '/') END, 'nextjs' FROM x WHERE {_NEXT}))"""
_ENDPOINTS = f"{_ROUTES}, ep AS (SELECT repo_id, path, method, route, min(line) AS line, arg_min(framework, (line, framework)) AS framework FROM ro GROUP BY 1, 2, 3, 4)"
_ENTITY = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {_q(e)}) AND " + (f"regexp_matches(body, {_q(t)})" if t else f"regexp_matches(name, {_q(n)})") + f" THEN '{k}'" for k, e, t, n in frameworks.ENTITY_RULES) + " ELSE 'unknown' END"
_ENTITIES = f"en AS (SELECT DISTINCT sym_id, repo_id, path, name, {_ENTITY} AS kind FROM symbol_bodies WHERE type = 'class' AND body <> '' AND regexp_matches(lower(path), '\\.(?:js|jsx|ts|tsx|py|java)$'))"
_NEAR = rf"""w AS (SELECT DISTINCT sym_id, regexp_extract_all({_CODE}, '\w+') AS w FROM symbol_bodies WHERE type IN ('function', 'method')), s AS (SELECT sym_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5),
      m AS (SELECT DISTINCT sym_id, md5(array_to_string(s, '|')) AS c, s FROM s), k AS (SELECT c, any_value(s) AS s, any_value(len(s)) AS n, count(*) AS copies, min(sym_id) AS class_id FROM m GROUP BY 1), u AS (SELECT c, n, unnest(s) AS x FROM k),
      p AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM u a JOIN u b ON a.x = b.x AND a.c <> b.c AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 GROUP BY 1, 2, 3, 4)"""
SQL = {
    "routes": f"WITH {_ROUTES} SELECT * FROM ro",
    "endpoints": f"WITH {_ENDPOINTS} SELECT * FROM ep",
    "endpoint_summary": f"WITH {_ENDPOINTS} SELECT repo_id, count(*) AS endpoints, string_agg(DISTINCT framework, ' ' ORDER BY framework) AS frameworks FROM ep GROUP BY 1",
    "entity_kinds": f"WITH {_ENTITIES} SELECT repo_id, kind, count(*) AS classes FROM (SELECT DISTINCT sym_id, repo_id, kind FROM en) GROUP BY 1, 2",
    "external_modules_of_code": f"WITH {_I} SELECT repo_id, module, starts_with(module, '.') AS internal, count(DISTINCT path) AS files FROM i WHERE module IS NOT NULL GROUP BY 1, 2",
    "most_complex": f"WITH {_M} SELECT sym_id, repo_id, name, score, rating FROM r WHERE score >= 20 ORDER BY score DESC, sym_id LIMIT 20",
    "detected_frameworks": f"WITH {_D} SELECT * FROM g",
    "unlabelled_symbols": f"WITH {_D}, s AS (SELECT DISTINCT sym_id, repo_id, framework FROM symbols) SELECT s.repo_id, s.framework, count(*) AS symbols, count(d.sym_id) AS by_rule FROM s LEFT JOIN (SELECT DISTINCT sym_id FROM g) d ON d.sym_id = s.sym_id GROUP BY 1, 2",
    "dead_code": rf"""WITH {_I}, u AS (SELECT repo_id, split_part(dst, '.', -1) AS name FROM calls WHERE dst <> '' UNION SELECT repo_id, unnest(string_split(imported, ' ')) FROM i WHERE module IS NOT NULL)
      SELECT DISTINCT sym_id, repo_id, path, name, type, line FROM symbols s WHERE name <> '' AND NOT ({_ENTRY}) AND NOT EXISTS (FROM u WHERE u.repo_id = s.repo_id AND u.name = s.name)""",
    "complexity": f"WITH {_M} SELECT sym_id, repo_id, name, params, calls, lines, cyclomatic, nesting, score, rating FROM r",
    "complexity_ratings": f"WITH {_M} SELECT repo_id, rating, count(*) AS symbols, max(score) AS highest FROM r GROUP BY 1, 2",
    "exact_duplicates": rf"""WITH b AS (SELECT DISTINCT sym_id, repo_id, path, md5(code) AS fingerprint FROM (SELECT sym_id, repo_id, path, {_CODE} AS code FROM symbol_bodies WHERE type IN ('function', 'method')) WHERE length(code) >= 80)
      SELECT fingerprint, count(DISTINCT sym_id) AS members, count(DISTINCT (repo_id, path)) AS files, count(DISTINCT repo_id) AS repositories FROM b GROUP BY 1 HAVING count(DISTINCT sym_id) > 1""",
    "near_duplicates": f"""WITH {_NEAR}, l AS (SELECT a AS c, count(*) AS links FROM p WHERE shared >= 0.8 * (na + nb - shared) - 1e-9 GROUP BY 1)
      SELECT m.sym_id, k.class_id, k.copies, coalesce(l.links, 0) AS links FROM m JOIN k ON k.c = m.c LEFT JOIN l ON l.c = m.c""",
    "duplicate_links": f"""WITH {_NEAR} SELECT least(x.class_id, y.class_id) AS class_a, greatest(x.class_id, y.class_id) AS class_b, round(shared / (na + nb - shared), 6) AS similarity FROM p JOIN k x ON x.c = p.a JOIN k y ON y.c = p.b WHERE p.a < p.b AND shared >= 0.8 * (na + nb - shared) - 1e-9""",
    "doc_coverage": r"""WITH s AS (SELECT DISTINCT sym_id, repo_id, regexp_extract(path, '(\.[^./\\]+)$', 1) AS ext, coalesce(trim(doc), '') <> '' AS has FROM symbols) SELECT repo_id, ext, count(*) AS symbols, count(*) FILTER (has) AS documented, round(count(*) FILTER (has) * 100.0 / count(*), 1) AS percent FROM s GROUP BY 1, 2""",
    "declarations": f"WITH {_L}, d AS (SELECT DISTINCT repo_id, path, line, {_kind([_q(t) for _, _, t, _ in extract.DECLARATIONS])} AS type, {_NAME_OF} AS name FROM l) SELECT * FROM d WHERE type IS NOT NULL AND NOT list_contains({extract.NOT_NAMES}, name)",
    "imports": f"WITH {_I} SELECT repo_id, path, line, module, imported FROM i WHERE module IS NOT NULL",
    "called_names": r"SELECT DISTINCT sym_id, callee FROM (SELECT sym_id, name, unnest(regexp_extract_all(body, '(\w+)\s*\(', 1)) AS callee FROM symbol_bodies WHERE body <> '') WHERE callee <> coalesce(name, '')",
    "findings": f"WITH {_FINDINGS} SELECT * FROM g",
    "findings_summary": f"WITH {_FINDINGS} SELECT category, severity, count(*) AS n, min(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) AS rank FROM g GROUP BY 1, 2",
    "smells": r"WITH t AS (SELECT DISTINCT repo_id, path, replace(replace(content, E'\r\n', E'\n'), E'\r', E'\n') AS text FROM files WHERE content <> '' AND regexp_matches(lower(path), '\.(?:py|js|ts|jsx|tsx)$') AND NOT list_has_any(string_split(regexp_replace(replace(path, '\', '/'), '^\./', ''), '/'), " + str(filters.SCAN_FOLDERS) + ")) " + " UNION ALL ".join(f"SELECT DISTINCT repo_id, path, {_q(n)} AS smell, {_q(s)} AS severity, len(regexp_extract_all(text, {_q('(?im)' + p)})) AS hits FROM t WHERE regexp_matches(text, {_q('(?im)' + p)})" for n, s, p in extract.SMELLS),
    "line_counts": r"""SELECT DISTINCT repo_id, path, len(string_split(t, E'\n')) AS lines, len(list_filter(string_split(t, E'\n'), lambda x: trim(x) = '')) AS blank FROM (SELECT repo_id, path, replace(replace(content, E'\r\n', E'\n'), E'\r', E'\n') AS t FROM files WHERE content <> '' AND path IS NOT NULL)""",
}
SQL["dead_code_report"] = f"WITH d AS ({SQL['dead_code']}), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path NULLS FIRST, line NULLS FIRST, sym_id) AS rank, count(*) OVER (PARTITION BY repo_id) AS all_dead FROM d) SELECT repo_id, rank, sym_id, name, path, all_dead FROM r WHERE rank <= 50"
SQL["package_symbols"] = f"WITH {_L}, k AS (SELECT DISTINCT repo_id, path, line, CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN '{k}'" for k, p in extract.PACKAGED) + " END AS type, CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p)}) THEN regexp_extract(text, {_q(p)}, 1)" for _, p in extract.PACKAGED) + " END AS name FROM l) SELECT * FROM k WHERE type IS NOT NULL"
