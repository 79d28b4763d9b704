"""Extraction from source text with built-in expressions: declarations, imports, calls, routes, findings.

All read the text once, line by line or as a whole, and make their rows distinct, so a file delivered twice counts once.
Files with null or empty content give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines
from ..tables import clean_path, extension

# ---- fixed values: declarations by language; the name is the first group ----
DECLARATIONS = [
    ("python", r"\.py$", "class", r"^\s*class\s+(\w+)"),
    ("python", r"\.py$", "function", r"^(?:async\s+)?def\s+(\w+)\s*\("),
    ("python", r"\.py$", "method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\("),
    ("script", r"\.(?:js|jsx|ts|tsx)$", "class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("script", r"\.(?:js|jsx|ts|tsx)$", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\("),
    ("script", r"\.(?:js|jsx|ts|tsx)$", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)[^=]*|\w+)\s*=>"),
    ("script", r"\.tsx?$", "interface", r"^\s*(?:export\s+)?(?:declare\s+)?interface\s+(\w+)"),
    ("script", r"\.tsx?$", "type", r"^\s*(?:export\s+)?(?:declare\s+)?type\s+(\w+)(?:<[^>]*>)?\s*="),
    ("script", r"\.tsx?$", "enum", r"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("script", r"\.(?:js|jsx|ts|tsx)$", "method", r"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?#?(\w+)\s*\([^;{]*\)\s*(?::\s*[^={;]+)?\{\s*$"),
    ("java", r"\.(?:java|cs|kt)$", "class", r"^\s*(?:public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|sealed\s+|data\s+)*(?:class|enum|record|object)\s+(\w+)"),
    ("java", r"\.(?:java|cs|kt)$", "interface", r"^\s*(?:public\s+|private\s+|protected\s+|internal\s+)*interface\s+(\w+)"),
    ("java", r"\.(?:java|cs)$", "method", r"^\s+(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|synchronized)\s+)+[\w<>\[\], .?]+\s+(\w+)\s*\([^;]*$"),
    ("go", r"\.go$", "function", r"^func\s+(\w+)\s*\("),
    ("go", r"\.go$", "method", r"^func\s+\([^)]*\)\s*(\w+)\s*\("),
    ("go", r"\.go$", "type", r"^type\s+(\w+)\s+(?:struct|interface)\b"),
    ("rust", r"\.rs$", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    ("rust", r"\.rs$", "class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)"),
    ("kotlin", r"\.kts?$", "function", r"^\s*(?:(?:public|private|internal|protected|override|suspend|inline|open|abstract|operator|tailrec)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("),
    ("swift", r"\.swift$", "interface", r"^\s*(?:public\s+|private\s+)*protocol\s+(\w+)"),
    ("swift", r"\.swift$", "enum", r"^\s*(?:public\s+|private\s+|indirect\s+)*enum\s+(\w+)"),
    ("swift", r"\.swift$", "class", r"^\s*(?:public\s+|private\s+|final\s+|open\s+)*(?:class|struct|actor|extension)\s+(\w+)"),
    ("swift", r"\.swift$", "function", r"^\s*(?:public\s+|private\s+|static\s+|class\s+|override\s+|mutating\s+)*func\s+(\w+)"),
    ("dart", r"\.dart$", "class", r"^\s*(?:abstract\s+)?(?:class|enum|mixin|extension)\s+(\w+)"),
    ("dart", r"\.dart$", "function", r"^\s*(?:static\s+|external\s+)*(?:[\w<>?,]+\s+)(\w+)\s*\([^;]*\)\s*(?:async\*?\s*|sync\*\s*)?(?:\{|=>)"),
]
# ---- fixed values: words that a rule for methods meets and that declare nothing ----
NOT_NAMES = ["if", "for", "while", "switch", "catch", "function", "return", "else", "do", "try", "with", "new", "await", "print", "super"]
# ---- fixed values: findings in single lines (category, severity, description, pattern), in order; the first of a category counts ----
FINDINGS = [
    ("secret", "high", "API key", r"(?:api[_-]?key|apikey)\s*[:=]\s*[\"']?[a-zA-Z0-9_\-]{16,}"),
    ("secret", "critical", "Hardcoded password/secret", r"(?:secret|password|passwd|pwd)\s*[:=]\s*[\"'][^\"']{4,}[\"']"),
    ("secret", "high", "Hardcoded token", r"(?:token|auth[_-]?token|access[_-]?token)\s*[:=]\s*[\"']?[a-zA-Z0-9_\-\.]{16,}"),
    ("secret", "critical", "AWS credential", r"(?:aws[_-]?access|aws[_-]?secret)\s*[:=]\s*[\"']?[A-Za-z0-9/+=]{16,}"),
    ("secret", "critical", "Private key reference", r"(?:private[_-]?key|ssh[_-]?key)\s*[:=]\s*[\"'].*[\"']"),
    ("secret", "high", "Database connection string", r"(?:jdbc|mongodb|mysql|postgres|redis)://[^\s\"']+"),
    ("secret", "critical", "OpenAI API key", r"sk-[a-zA-Z0-9]{20,}"),
    ("secret", "critical", "GitHub personal access token", r"ghp_[a-zA-Z0-9]{36}"),
    ("secret", "critical", "Slack bot token", r"xoxb-[a-zA-Z0-9-]+"),
    ("secret", "critical", "AWS Access Key ID", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("sql_injection", "high", "SQL injection risk — use parameterized queries", r"(?:execute|query|raw)\s*\(\s*(?:f[\"']|[\"'].*%|.*\.format\(|.*\+\s*(?:req|request|params|input))"),
    ("sql_injection", "high", "SQL injection risk — f-string in query", r"(?:cursor\.execute|db\.query)\s*\(\s*[\"'].*\{"),
    ("xss", "medium", "Potential XSS — innerHTML assignment", r"innerHTML\s*=(?:$|[^\"']|[\"']\s*\S)"),  # not an empty opening quote
    ("xss", "medium", "Potential XSS — dangerouslySetInnerHTML", r"dangerouslySetInnerHTML"),
    ("xss", "medium", "Potential XSS — document.write", r"document\.write\s*\("),
    ("unsafe_code", "high", "Unsafe eval() usage", r"\beval\s*\("),
    ("unsafe_code", "high", "Unsafe exec() usage", r"\bexec\s*\("),
    ("unsafe_code", "high", "Shell injection risk", r"subprocess\.(?:call|run|Popen)\s*\(.*shell\s*=\s*True"),
    ("unsafe_code", "high", "Shell injection risk — os.system", r"os\.system\s*\("),
    ("unsafe_code", "medium", "Unsafe deserialization — pickle", r"pickle\.loads?\s*\("),
    ("unsafe_code", "medium", "Unsafe YAML load (use safe_load)", r"yaml\.load\s*\([^)]*\)\s*$"),
    ("unsafe_code", "low", "Insecure randomness — use crypto.getRandomValues", r"Math\.random\(\)"),
]
# ---- fixed values: patterns of doubtful code (description, severity, pattern), counted over the whole text whatever the case ----
SMELLS = [
    ("Use of eval() — potential code injection", "high", r"eval\s*\("),
    ("Use of exec() — potential code injection", "high", r"exec\s*\("),
    ("Use of pickle — potential deserialization vulnerability", "high", r"pickle\.loads"),
    ("Unsafe YAML loading — use yaml.safe_load()", "high", r"yaml\.load\s*\("),
    ("Shell injection via subprocess — sanitize input", "high", r"subprocess\.call\s*\(\s*input"),
    ("Use of os.system() — shell injection risk", "high", r"os\.system\s*\("),
    ("String formatting with % — consider f-strings", "medium", r"\.format\s*\([^)]*%"),
    ("Hardcoded password detected", "high", r"password\s*=\s*['\"][^'\"]+['\"]"),
    ("Hardcoded API key detected", "high", r"api[_-]?key\s*=\s*['\"][^'\"]+['\"]"),
    ("Hardcoded secret detected", "high", r"secret\s*=\s*['\"][^'\"]+['\"]"),
    ("Hardcoded token detected", "high", r"token\s*=\s*['\"][^'\"]+['\"]"),
    ("SQL string concatenation — use parameterized queries", "high", r"SELECT\s+.*\+.*FROM"),
    ("SQL f-string injection — use parameterized queries", "high", r"cursor\.execute\s*\(\s*f[\"']"),
    ("URL injection via f-string — sanitize URLs", "high", r"requests\.get\s*\(\s*f[\"']"),
    ("Path traversal — use os.path.join()", "high", r"open\s*\(\s*[^,)]*\+"),
    ("Path concatenation — use os.path.join()", "medium", r"Path\s*\(\s*[^,)]*\+"),
    ("Bare except clause — catch specific exceptions", "medium", r"except\s*:"),
    ("Empty code block with pass — implement or add TODO", "medium", r"pass\s*$"),
    ("TODO comment found", "low", r"TODO\s*:"),
    ("FIXME comment found", "medium", r"FIXME\s*:"),
    ("Debug print statement — remove in production", "low", r"print\s*\("),
    ("Wildcard import — import specific names", "medium", r"import\s+\*\s*$"),
    ("Many imports on one line — consider line breaks", "low", r"from\s+\w+\s+import\s+\w+,\s*\w+,\s*\w+,\s*\w+,\s*\w+,\s*\w+"),
    ("Nested loops — consider optimization", "medium", r"for\s+.*\s+in\s+.*:\s*\n\s*for\s+"),
    ("Appending list in loop — use list comprehension", "medium", r"\.append\s*\(\s*\["),
    ("Infinite loop — ensure exit condition", "medium", r"while\s+True\s*:"),
    ("time.sleep(0) — unnecessary yield", "low", r"time\.sleep\s*\(\s*0\s*\)"),
    ("Missing main guard", "low", r"if\s+__name__\s*==\s*['\"]__main__['\"]:"),
    ("Consider dataclass for simple data containers", "medium", r"class\s+\w+.*:\s*\n\s*def\s+__init__"),
    ("Simple property — consider using attribute directly", "low", r"@property\s*\n\s*def\s+\w+\s*\(\s*\)\s*:\s*\n\s*return\s+self\."),
]


def line_counts(files: DataFrame) -> DataFrame:
    """Per distinct count of a file: repo_id, path, lines, blank; counted where the row stands, so no line is shuffled."""
    each = lines(F.col("content"))
    rows = files.where("content <> '' and path is not null").select("repo_id", "path", F.size(each).alias("lines"), F.size(F.filter(each, lambda x: F.trim(x) == "")).alias("blank"))
    return rows.distinct()


def unique_contents(files: DataFrame) -> DataFrame:
    """repo_id, path, content, each distinct text of a file once: told apart by its hash, so no text is compared or sorted."""
    return files.where("content <> '' and path is not null").groupBy("repo_id", "path", F.xxhash64("content").alias("_c")).agg(F.first("content").alias("content")).drop("_c")


def numbered_lines(files: DataFrame) -> DataFrame:
    """repo_id, path, line (1-based), text of every line."""
    return files.where("content <> '' and path is not null").select("repo_id", "path", F.posexplode(lines(F.col("content"))).alias("at", "text")).select("repo_id", "path", (F.col("at") + 1).alias("line"), "text")


def declarations(files: DataFrame) -> DataFrame:
    """repo_id, path, line, type, name of what a line declares; the first rule that fits decides."""
    text = F.col("text")
    kind, name = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for _, ext, what, pattern in DECLARATIONS:
        fits = F.lower("path").rlike(ext) & text.rlike(pattern)
        kind, name = kind.when(fits, what), name.when(fits, F.regexp_extract("text", pattern, 1))
    # most lines declare nothing: one cheap test before the rules
    likely = numbered_lines(unique_contents(files)).where(text.rlike(r"\b(?:class|def|function|interface|func|fn|struct|enum|trait|type|record|object|public|private|protected|mixin|extension|protocol|fun)\b|=>|\)[^;]*\{\s*$"))
    return likely.select("repo_id", "path", "line", kind.alias("type"), name.alias("name")).where("type is not null").where(~F.col("name").isin(NOT_NAMES)).distinct()


#: Import lines: Python ``from`` and ``import``; scripts and Dart (default, namespace, named, module).
FROM, IMPORT = r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", r"^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$"
SCRIPT = r"^\s*import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)\s*)?(?:\{([^}]*)\})?\s*(?:from\s+)?[\"']([^\"']+)[\"']"


def imports(files: DataFrame) -> DataFrame:
    """repo_id, path, line, module, imported (names joined by a blank) of Python, script and Dart import lines.

    An import for its side effects alone brings no names; a namespace brings its own.
    """
    text = F.regexp_replace("text", r"\s+#.*$", "")
    rows = numbered_lines(unique_contents(files)).where(F.col("text").rlike(r"^\s*(?:import|from)\b")).withColumn("text", text)
    names = lambda c: F.array_join(F.filter(F.transform(F.split(F.translate(c, "()", ""), ","), lambda p: F.trim(F.regexp_replace(p, r"\s+as\s+\w+", ""))), lambda p: p != ""), " ")
    python = F.lower("path").endswith(".py")
    part = lambda pattern, group: F.regexp_extract("text", pattern, group)
    module = F.when(python & F.col("text").rlike(FROM), part(FROM, 1)).when(python & F.col("text").rlike(IMPORT), part(IMPORT, 1)).when(~python & F.col("text").rlike(SCRIPT), part(SCRIPT, 4))
    found = F.when(python & F.col("text").rlike(FROM), names(part(FROM, 2))).when(python, F.element_at(F.split(part(IMPORT, 1), r"\."), -1)).otherwise(names(F.concat_ws(",", part(SCRIPT, 1), part(SCRIPT, 2), part(SCRIPT, 3))))
    return rows.select("repo_id", "path", "line", module.alias("module"), found.alias("imported")).where("module is not null").distinct()


# ---- fixed values: starts of lines by which a package's sources declare a public name ----
PACKAGED = [("function", r"^(?:def|function)\s+([A-Za-z]\w*)"), ("class", r"^class\s+([A-Za-z]\w*)"), ("variable", r"^const\s+([A-Za-z]\w*)\s*=")]


def package_symbols(files: DataFrame) -> DataFrame:
    """Public names that lines of an installed package's sources declare without indentation: repo_id, path, line, type, name; private ones (``_``) are left out."""
    kind, name = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for what, pattern in PACKAGED:
        kind, name = kind.when(F.col("text").rlike(pattern), what), name.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))
    rows = numbered_lines(unique_contents(files)).where(F.col("text").rlike(r"^(?:def|function|class|const)\s"))
    return rows.select("repo_id", "path", "line", kind.alias("type"), name.alias("name")).where("type is not null").distinct()


# ---- fixed values: what a script line exports, in order; the first rule that fits decides ----
EXPORTS = [
    ("function", r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("class", r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("type", r"^\s*export\s+(?:declare\s+)?(?:interface|type|enum)\s+(\w+)"),
    ("variable", r"^\s*export\s+(?:const|let|var)\s+(\w+)"),
]


def exports(files: DataFrame) -> DataFrame:
    """repo_id, path, name, kind of what scripts export and of what Python's ``__all__`` lists; null contents give nothing."""
    script = numbered_lines(files).where(F.lower("path").rlike(r"\.(?:js|jsx|ts|tsx)$") & F.col("text").rlike(r"^\s*export\b"))
    found = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("kind")))
    for kind, pattern in EXPORTS:
        found = found.when(F.col("text").rlike(pattern), F.struct(F.regexp_extract("text", pattern, 1).alias("name"), F.lit(kind).alias("kind")))
    single = script.select("repo_id", "path", found.alias("e")).where("e is not null").select("repo_id", "path", "e.name", "e.kind")
    outside = lambda part: F.trim(F.regexp_replace(part, r"^.*\s+as\s+", ""))
    clause = F.regexp_extract("text", r"^\s*export\s*\{([^}]*)\}", 1)
    listed = script.select("repo_id", "path", F.explode(F.transform(F.split(clause, ","), outside)).alias("name"), F.lit("named").alias("kind"))
    every = F.regexp_extract("content", r"(?m)^__all__\s*=\s*[\[(]([^\])]*)[\])]", 1)
    python = files.where(F.lower("path").endswith(".py") & F.col("content").contains("__all__"))
    python = python.select("repo_id", "path", F.explode(F.regexp_extract_all(every, F.lit(r"[\"'](\w+)[\"']"), F.lit(1))).alias("name"), F.lit("named").alias("kind"))
    return single.unionByName(listed).unionByName(python).where("name <> ''").distinct()


def visible_names(symbols: DataFrame, exports_: DataFrame) -> DataFrame:
    """What other files can name of a file: repo_id, path, name, type; symbols outside classes, then exports that are no such symbol."""
    own = symbols.where("name <> '' and path is not null and coalesce(class_name, '') = ''").select("repo_id", "path", "name", F.lit(0).alias("o"), "type")
    rows = own.unionByName(exports_.select("repo_id", "path", "name", F.lit(1).alias("o"), F.col("kind").alias("type")))
    return rows.groupBy("repo_id", "path", "name").agg(F.min(F.struct("o", "type")).alias("r")).select("repo_id", "path", "name", "r.type")


def imported_names(imports_: DataFrame) -> DataFrame:
    return imports_.select("repo_id", F.explode(F.split("imported", " ")).alias("name")).where("name <> ''").distinct()


def called_names(bodies: DataFrame) -> DataFrame:
    """sym_id, callee: names followed by a bracket in the body of a symbol, its own name left out."""
    found = bodies.where("body <> ''").select("sym_id", "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("callee"))
    return found.where("callee <> coalesce(name, '')").select("sym_id", "callee").distinct()


# ---- fixed values: web endpoints that a line declares (framework, paths, pattern, group of the method or the method, group of the route) ----
ENDPOINTS = [
    ("express", r"\.(?:js|jsx|ts|tsx)$", r"(?:^|[^@\w.])(?:app|router)\.(get|post|put|delete|patch|all|use)\s*\(\s*[\"']([^\"']+)", 1, 2),
    ("nestjs", r"\.(?:js|jsx|ts|tsx)$", r"@(Get|Post|Put|Delete|Patch)\(\s*[\"']([^\"']+)", 1, 2),
    ("flask", r"\.py$", r"@(?:app|blueprint|bp)\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)", 1, 2),
    ("fastapi", r"\.py$", r"@router\.(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)", 1, 2),
    ("django", r"\.py$", r"(?:^|[^\w.@])path\s*\(\s*[\"']([^\"']+)[\"']", "GET", 1),
    ("spring", r"\.(?:java|kt)$", r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[\"']([^\"']+)", 1, 2),
    ("go-http", r"\.go$", r"(?:Handle|HandleFunc)\s*\(\s*[\"']([^\"']+)", "ANY", 1),
    ("rails", r"\.rb$", r"^\s*(get|post|put|patch|delete)\s+[\"']([^\"']+)", 1, 2),
]
_FLASK_ROUTE = r"@(?:app|router|blueprint|bp)\.route\(\s*[\"']([^\"']+)[\"']"
_FLASK_METHODS = r"@(?:app|router|blueprint|bp)\.route\(.*methods\s*=\s*[\[(]([^\])]*)[\])]"
_NEXT_EXPORT = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s*\("


def is_next_route(path: Column) -> Column:
    """Whether a path is that of a route file of an app folder."""
    p = clean_path(path)
    return (p.contains("/api/") | F.concat(F.lit("/"), p).contains("/app/")) & p.contains("route.")


def next_route(path: Column) -> Column:
    """The route that a file of an ``app`` or ``pages`` folder serves; other paths stand for themselves."""
    p = clean_path(path)
    app, pages = r"(?:src/)?app(/.*)/route\.(?:ts|js|tsx|jsx)", r"pages(/.*?)\.(?:ts|js|tsx|jsx)"
    page = F.regexp_extract(p, pages, 1)
    short = F.when(page == "/index", "/").otherwise(F.regexp_replace(page, "/index$", ""))
    return F.when(p.rlike(app), F.regexp_extract(p, app, 1)).when(p.rlike(pages), short).otherwise(p)


def routes(files: DataFrame) -> DataFrame:
    """repo_id, path, line, method, route, framework of every web endpoint that a line declares; several in a line count each.

    ``route(..., methods=[...])`` gives a row for each method named, GET without any; a mapping without a method is a GET, a
    handler for all methods ANY. Route files of app folders give their exported functions. Comment lines are passed over.
    """
    rows = numbered_lines(files).where(F.col("text").rlike(r"\(\s*(?:value\s*=\s*)?[\"']|^\s*(?:get|post|put|patch|delete)\s+[\"']|^\s*export\b") & ~F.trim("text").rlike(r"^(?:#|//)"))
    low, next_file = F.lower("path"), is_next_route(F.col("path"))
    nothing = F.lit(None).cast("array<struct<method: string, route: string, framework: string>>")

    def told(framework: str, pattern: str, method: str | int, route: int) -> Column:
        """The endpoints that one pattern finds in a line."""
        routes_ = F.regexp_extract_all("text", F.lit(pattern), F.lit(route))
        methods = F.transform(routes_, lambda r: F.lit(method)) if isinstance(method, str) else F.regexp_extract_all("text", F.lit(pattern), F.lit(method))
        return F.zip_with(methods, routes_, lambda m, r: F.struct(F.upper(m).alias("method"), r.alias("route"), F.lit(framework).alias("framework")))

    found = [F.when(low.rlike(ext) & ~next_file, told(framework, pattern, method, route)).otherwise(nothing) for framework, ext, pattern, method, route in ENDPOINTS]
    named = F.regexp_extract_all(F.upper(F.regexp_extract("text", _FLASK_METHODS, 1)), F.lit("(GET|POST|PUT|DELETE|PATCH)"), F.lit(1))
    flask = F.regexp_extract("text", _FLASK_ROUTE, 1)
    fanned = F.transform(F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.array(F.lit("GET"))), lambda m: F.struct(m.alias("method"), flask.alias("route"), F.lit("flask").alias("framework")))
    found.append(F.when(low.endswith(".py") & (flask != "") & ~next_file, fanned))
    exported = F.regexp_extract_all("text", F.lit(_NEXT_EXPORT), F.lit(1))
    found.append(F.when(next_file, F.transform(exported, lambda m: F.struct(m.alias("method"), next_route(F.col("path")).alias("route"), F.lit("nextjs").alias("framework")))))
    each = rows.select("repo_id", "path", "line", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("e"))
    method = F.when(F.col("e.method") == "REQUEST", "GET").otherwise(F.col("e.method"))
    return each.select("repo_id", "path", "line", method.alias("method"), "e.route", "e.framework").distinct()


def endpoints(files: DataFrame) -> DataFrame:
    """Each (method, route) of a file once, with its first line: repo_id, path, method, route, line, framework, in order of route and method."""
    r = routes(files).groupBy("repo_id", "path", "method", "route").agg(F.min(F.struct("line", "framework")).alias("r"))
    return r.select("repo_id", "path", "method", "route", "r.line", "r.framework").orderBy("route", "method", "repo_id", "path")


def endpoint_summary(files: DataFrame) -> DataFrame:
    """Per repository: endpoints and their distinct frameworks, joined by a blank."""
    return endpoints(files).groupBy("repo_id").agg(F.count("*").alias("endpoints"), F.array_join(F.array_sort(F.collect_set("framework")), " ").alias("frameworks"))


def findings(files: DataFrame) -> DataFrame:
    """repo_id, path, line, category, severity, description: the first finding of each category in a line.

    Comment lines are passed over, and unsafe code in test paths.
    """
    rows = numbered_lines(unique_contents(files)).where(~F.trim("text").rlike(r"^(#|//|\*)"))
    some = "(?i)" + "|".join(f"(?:{p})" for _, _, _, p in FINDINGS)
    hits = F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(i).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.lit(d).alias("description"))) for i, (c, s, d, p) in enumerate(FINDINGS)])
    found = rows.where(F.col("text").rlike(some)).select("repo_id", "path", "line", F.explode(F.array_compact(hits)).alias("h")).select("repo_id", "path", "line", "h.*")
    found = found.where(~((F.col("category") == "unsafe_code") & F.lower("path").rlike("test|spec")))
    first = F.row_number().over(W.partitionBy("repo_id", "path", "line", "category").orderBy("rule"))
    return found.distinct().withColumn("n", first).where("n = 1").select("repo_id", "path", "line", "category", "severity", "description")


def smells(files: DataFrame) -> DataFrame:
    """Per file and kind of doubtful code: repo_id, path, smell, severity, hits; patterns may span lines, case aside."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    counts = F.array(*[F.struct(F.lit(n).alias("smell"), F.lit(s).alias("severity"), F.regexp_count("text", F.lit(f"(?imd){p}")).alias("hits")) for n, s, p in SMELLS])
    out = unique_contents(files).select("repo_id", "path", text.alias("text")).select("repo_id", "path", F.explode(F.filter(counts, lambda x: x["hits"] > 0)).alias("c"))
    return out.select("repo_id", "path", "c.*").distinct()


# ---- fixed values: words before a declaration that are its modifiers ----
MODIFIERS = ["async", "static", "public", "private", "protected", "abstract", "override"]
#: Lines above a declaration and below it that are looked at for decorators, comments and docstrings; longest doc.
ABOVE, BELOW, DOC = 15, 20, 200
_HEADER = 8


def signatures(files: DataFrame) -> DataFrame:
    """What the header of each declaration says: repo_id, path, line, type, name, params, return_type, modifiers, decorators, doc.

    params are the names between the first brackets of the header (up to eight lines), without ``self``, ``cls``, types and
    defaults; return_type is what follows them (after ``->`` or ``:``), or stands before the name; decorators are the lines above
    that start with ``@``; doc is the docstring that opens the body or else the comment that ends right above, cut
    after 200 characters with ``...``. What is absent is an empty array or null. Lines are looked at where the file's row
    stands, so nothing is shuffled but the declarations.
    """
    kind, name = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for _, ext, what, pattern in DECLARATIONS:
        fits = F.lower("path").rlike(ext) & F.col("text").rlike(pattern)
        kind, name = kind.when(fits, what), name.when(fits, F.regexp_extract("text", pattern, 1))
    rows = unique_contents(files).withColumn("all", lines(F.col("content"))).drop("content")
    likely = r"\\b(?:class|def|function|interface|func|fn|struct|enum|trait|type|record|object|public|private|protected|mixin|extension|protocol|fun)\\b|=>|[)][^;]*[{{]\\s*$"
    around = f"""transform(filter(sequence(1, size(all)), i -> all[i - 1] rlike '{likely}'), i -> struct(i as line, all[i - 1] as text,
        reverse(slice(all, greatest(i - {ABOVE}, 1), i - greatest(i - {ABOVE}, 1))) as above, slice(all, i, {_HEADER}) as head, slice(all, i + 1, {BELOW}) as below))"""
    rows = rows.select("repo_id", "path", F.explode(F.expr(around)).alias("d")).select("repo_id", "path", "d.*")
    rows = rows.withColumn("type", kind).withColumn("name", name).where("type is not null and name <> ''").where(~F.col("name").isin(NOT_NAMES))
    head = F.array_join("head", "\n")
    # the header up to the bracket that closes the parameters; one level of brackets inside
    header = F.regexp_extract(head, r"(?s)^([^(]*(?:\([^()]*\)\s*\w+)?[^(]*\((?:[^()]|\([^()]*\))*\)[^\n]*)", 1)
    callable_ = F.col("type").isin("function", "method")
    inside = F.regexp_extract(header, r"(?s)\b\w+\s*(?:<[^(>]*>)?\s*(?:=\s*(?:async\s*)?)?\(((?:[^()]|\([^()]*\))*)\)(?!\s*\w+\s*\()", 1)
    flat = F.regexp_replace(F.regexp_replace(inside, r"\([^()]*\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}", ""), r"(?s)=[^,]*", "")
    part = F.transform(F.split(flat, ","), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    java = F.lower("path").rlike(r"\.(?:java|cs)$")
    bare = F.transform(part, lambda p: F.when(java, F.regexp_extract(p, r"(\w+)$", 1)).otherwise(F.regexp_extract(F.regexp_replace(p, r"^(?:\.\.\.|\*+|&(?:mut )?|mut )", ""), r"^(?:(?:public|private|protected|readonly) )*(\w+)", 1)))
    params = F.when(callable_, F.filter(bare, lambda p: (p != "") & ~p.isin("self", "cls", "this"))).otherwise(F.array().cast("array<string>"))
    after = F.trim(F.regexp_replace(F.regexp_extract(header, r"(?s)\)\s*(?:->|:)?\s*([^\n(){]*?)\s*(?:throws\b[^{]*)?(?:=>|\{|:)?\s*(?:#.*|//.*)?$", 1), r"^(?:->|:)\s*", ""))
    before = F.regexp_extract("text", r"^\s*(?:(?:@\w+(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|override|virtual|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?([\w<>\[\], .?]+?)\s+\w+\s*\(", 1)
    returned = F.when(callable_, F.when(java, before).otherwise(after))
    words = F.split(F.regexp_replace(F.trim(F.regexp_extract("text", r"^([\s\w]*)", 1)), r"\s+", " "), " ")
    modifiers = F.filter(words, lambda w: w.isin(MODIFIERS))
    trimmed = F.transform("above", lambda x: F.trim(x))
    fold = F.aggregate(
        trimmed,
        F.struct(F.lit(0).alias("stage"), F.array().cast("array<string>").alias("decorators"), F.array().cast("array<string>").alias("comment")),
        lambda a, x: F.when((a["stage"] == 0) & (x.startswith("@") | x.rlike(r"^#\[|^\[[A-Z]")), F.struct(F.lit(0).alias("stage"), F.concat(F.array(x), a["decorators"]).alias("decorators"), a["comment"].alias("comment")))
        .when((a["stage"] == 0) & x.rlike(r"^(?:#(?!!?\[)|//)"), F.struct(F.lit(1).alias("stage"), a["decorators"].alias("decorators"), F.array(x).alias("comment")))
        .when((a["stage"] == 1) & x.rlike(r"^(?:#(?!!?\[)|//)"), F.struct(F.lit(1).alias("stage"), a["decorators"].alias("decorators"), F.concat(F.array(x), a["comment"]).alias("comment")))
        .when((a["stage"] == 0) & x.endswith("*/"), F.struct(F.when(x.startswith("/*"), 3).otherwise(2).alias("stage"), a["decorators"].alias("decorators"), F.array(x).alias("comment")))
        .when(a["stage"] == 2, F.struct(F.when(x.startswith("/*"), 3).otherwise(2).alias("stage"), a["decorators"].alias("decorators"), F.concat(F.array(x), a["comment"]).alias("comment")))
        .otherwise(F.struct(F.lit(3).alias("stage"), a["decorators"].alias("decorators"), a["comment"].alias("comment"))),
    )
    rows = rows.withColumn("_a", fold).withColumn("params", params).withColumn("return_type", F.nullif(returned, F.lit(""))).withColumn("modifiers", modifiers)
    stripped = F.filter(F.transform("_a.comment", lambda x: F.trim(F.regexp_replace(x, r"^(?:/\*+!?|//[/!]?|#+|\*+(?!/))|\*+/$", ""))), lambda x: x != "")
    inner = F.regexp_extract(F.array_join("below", "\n"), r"(?s)^\s*[rRuU]?(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", 0)
    docstring = F.trim(F.regexp_replace(F.regexp_replace(inner, r"^\s*[rRuU]?(?:\"\"\"|''')|(?:\"\"\"|''')$", ""), r"\s*\n\s*", " "))
    doc = F.when(F.lower("path").endswith(".py") & (docstring != ""), docstring).otherwise(F.array_join(stripped, " "))
    doc = F.when(F.length(doc) > DOC, F.concat(F.left(doc, F.lit(DOC)), F.lit("..."))).otherwise(F.nullif(doc, F.lit("")))
    return rows.select("repo_id", "path", "line", "type", "name", "params", "return_type", "modifiers", F.col("_a.decorators").alias("decorators"), doc.alias("doc")).dropDuplicates(["repo_id", "path", "line", "type", "name"])


def signature_agreement(signatures_: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per extension, the symbols whose declaration was read and how many agree with the index in each detail."""
    s = symbols.where("type in ('function', 'method', 'class')").select("sym_id", "repo_id", "path", "line", "name", "params", "return_type", "decorators", "modifiers").dropDuplicates(["sym_id"])
    j = s.join(signatures_.select("repo_id", "path", "line", "name", *[F.col(c).alias(f"_{c}") for c in ("params", "return_type", "modifiers", "decorators")]), ["repo_id", "path", "line", "name"], "left")
    read, empty = F.col("_params").isNotNull(), F.array().cast("array<string>")
    alike = lambda c: read & (F.array_sort(F.coalesce(c, empty)) == F.array_sort(F.coalesce(f"_{c}", empty)))
    return j.groupBy(extension(F.col("path")).alias("ext")).agg(
        F.count("*").alias("symbols"), F.count_if(read).alias("read"), F.count_if(alike("params")).alias("params"), F.count_if(alike("modifiers")).alias("modifiers"), F.count_if(alike("decorators")).alias("decorators"),
        F.count_if(read & F.col("return_type").eqNullSafe(F.col("_return_type"))).alias("return_type"),
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)
