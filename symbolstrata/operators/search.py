"""Search over symbols: by substring, pattern, subsequence, likeness, context and TF-IDF.

Symbols are taken as delivered and made one per sym_id. Null names match nothing. Results that are asked as the best k
have a fixed order with ties by repository, path and ordinal; the others are whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import name_tokens, sequence_ratio, subsequence_pattern

# ---- fixed values: synonyms by which a query is widened ----
SYNONYMS = {
    "auth": ["authentication", "authorize", "login", "signin", "credentials", "session", "token", "jwt"],
    "authentication": ["auth", "login", "signin", "credentials"],
    "login": ["auth", "signin", "authentication", "credentials"],
    "handler": ["handle", "controller", "action", "endpoint", "route", "api"],
    "controller": ["handler", "endpoint", "route"],
    "database": ["db", "model", "entity", "schema", "orm", "query", "repository", "store"],
    "model": ["entity", "schema", "database", "db"],
    "user": ["account", "profile", "member", "customer"],
    "create": ["add", "new", "insert", "post", "register", "save"],
    "delete": ["remove", "destroy", "drop"],
    "update": ["edit", "modify", "patch", "put", "save"],
    "get": ["fetch", "read", "find", "query", "retrieve", "list", "load"],
    "list": ["get", "fetch", "all", "index", "browse"],
    "component": ["widget", "ui", "view", "page", "screen"],
    "page": ["screen", "view", "route", "component"],
    "api": ["endpoint", "route", "handler", "rest"],
    "route": ["endpoint", "api", "path", "handler"],
    "test": ["spec", "assert", "expect", "mock"],
    "error": ["exception", "catch", "throw", "fail"],
    "config": ["configuration", "settings", "options", "env"],
    "nav": ["navigation", "menu", "sidebar", "header"],
    "button": ["btn", "click", "action"],
    "submit": ["send", "post", "save", "confirm"],
    "validate": ["check", "verify", "assert", "sanitize"],
    "search": ["find", "query", "filter", "lookup"],
    "file": ["upload", "download", "document", "attachment"],
    "notification": ["alert", "message", "toast", "notify"],
    "schedule": ["calendar", "booking", "appointment", "time"],
    "interview": ["meeting", "call", "session", "conversation"],
    "candidate": ["applicant", "user", "profile"],
    "job": ["position", "role", "posting", "vacancy"],
}
# ---- fixed values: concepts and the keywords that point to them in names, docs and paths ----
CONCEPTS = {
    "authentication": ["auth", "login", "logout", "signin", "signout", "sign_in", "sign_out", "authenticate", "credential", "token", "jwt", "oauth", "session", "password", "passwd", "verify_token", "refresh_token"],
    "authorization": ["permission", "role", "rbac", "acl", "authorize", "guard", "policy", "can_access", "is_admin", "has_permission", "access_control"],
    "database": ["model", "schema", "migration", "query", "repository", "orm", "entity", "table", "column", "database", "db", "mongo", "postgres", "mysql", "sqlite", "prisma", "sequelize", "typeorm", "sqlalchemy", "django_model"],
    "api": ["route", "endpoint", "controller", "handler", "middleware", "request", "response", "rest", "graphql", "grpc", "api"],
    "payment": ["payment", "billing", "invoice", "subscription", "charge", "stripe", "paypal", "checkout", "cart", "order", "price", "refund"],
    "user_management": ["user", "profile", "account", "register", "registration", "signup", "sign_up", "onboarding", "settings", "preferences"],
    "email": ["email", "mail", "smtp", "notification", "send_email", "mailer", "template_email", "newsletter"],
    "file_handling": ["upload", "download", "file", "storage", "s3", "blob", "attachment", "media", "image", "asset"],
    "testing": ["test", "spec", "mock", "fixture", "assert", "expect", "jest", "pytest", "unittest", "cypress", "playwright"],
    "configuration": ["config", "setting", "env", "environment", "dotenv", "option", "constant", "default"],
    "error_handling": ["error", "exception", "catch", "throw", "raise", "fault", "retry", "fallback", "handler_error", "error_handler"],
    "logging": ["log", "logger", "logging", "debug", "trace", "audit", "monitor"],
    "caching": ["cache", "redis", "memcache", "memoize", "invalidate", "ttl"],
    "scheduling": ["cron", "schedule", "job", "queue", "worker", "task", "celery", "background", "async_task"],
    "search": ["search", "index", "elasticsearch", "algolia", "fulltext", "query_search", "filter", "facet"],
}
# ---- fixed values: what questions call these concepts ----
ALIASES = {
    "authentication": ["how does login work", "how does authentication work", "sign in", "user login", "how do users authenticate", "session management"],
    "authorization": ["who can access what", "permissions", "roles", "access control"],
    "database": ["where is data stored", "database", "data model", "how is data structured"],
    "api": ["api endpoints", "routes", "how does the api work", "rest api"],
    "payment": ["how do payments work", "billing", "checkout flow", "payment processing"],
    "user_management": ["user management", "user accounts", "registration", "how do users sign up"],
    "email": ["email sending", "notifications", "how are emails sent"],
    "file_handling": ["file uploads", "file storage", "how are files handled"],
    "testing": ["testing", "how are tests organized", "test suite"],
    "configuration": ["configuration", "settings", "environment variables", "how is the app configured"],
    "error_handling": ["error handling", "how are errors handled", "exception handling"],
    "logging": ["logging", "how is logging done", "monitoring"],
    "caching": ["caching", "how does caching work", "cache invalidation"],
    "scheduling": ["background jobs", "scheduling", "task queue", "how are tasks scheduled"],
    "search": ["search functionality", "how does search work"],
}
# ---- fixed values: words of a question that point to nothing ----
STOP_WORDS = ["how", "does", "work", "the", "in", "what", "is", "a", "an"]

_COLUMNS = ["sym_id", "repo_id", "path", "ordinal", "name", "type", "line", "params", "calls", "class_name", "doc", "framework"]


def one_per_symbol(symbols: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Symbols once per distinct record of the wanted columns."""
    return symbols.select(*(columns or _COLUMNS)).distinct()


def _order(*first: Column) -> list[Column]:
    return [*first, F.col("repo_id"), F.col("path"), F.col("ordinal"), F.col("sym_id")]


def symbol_search(symbols: DataFrame, query: str, kind: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols whose name has ``query`` in it, whatever the case; optionally of one type and with ``path`` in their path."""
    s = one_per_symbol(symbols, ["sym_id", "repo_id", "path", "ordinal", "name", "type", "line"]).where(F.lower("name").contains(query.lower()))
    if kind is not None:
        s = s.where(F.col("type") == kind)
    return s if path is None else s.where(F.lower("path").contains(path.lower()))


def regex_search(symbols: DataFrame, pattern: str) -> DataFrame:
    """Symbols whose name has a match of ``pattern``, whatever the case. A bad pattern raises an error from Spark."""
    return one_per_symbol(symbols, ["sym_id", "repo_id", "path", "name", "type", "line"]).where(F.col("name").rlike(f"(?i){pattern}"))


def subsequence_search(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols whose name has the query's characters in order; queries under three characters match nothing."""
    s = one_per_symbol(symbols, ["sym_id", "repo_id", "path", "name", "type", "line"])
    return s.where(F.lower("name").rlike(subsequence_pattern(query.lower())) if len(query) >= 3 else F.lit(False))


def context_search(symbols: DataFrame, edges: DataFrame, query: str, k: int = 5) -> DataFrame:
    """The best ``k`` symbols of each repository for a query, with score and number of callers.

    A symbol matches by its name, a call, its class or a parameter. Score: exact name 100, prefix 50, part 10; 5 for each
    caller and 2 for each call, up to five; class 15, function or method 10, interface 5.
    """
    q = query.lower()
    has = lambda c: F.lower(c).contains(q)
    match = has("name") | F.coalesce(F.exists("calls", has), F.lit(False)) | F.coalesce(has("class_name"), F.lit(False)) | F.coalesce(F.exists("params", has), F.lit(False))
    callers = edges.groupBy("repo_id", F.col("dst").alias("name")).agg(F.count("*").alias("callers"))
    found = one_per_symbol(symbols).where(match).join(callers, ["repo_id", "name"], "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    score = (
        F.when(F.lower("name") == q, 100).when(F.lower("name").startswith(q), 50).when(has("name"), 10).otherwise(0)
        + 5 * F.least("callers", F.lit(5))
        + 2 * F.least(F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)), F.lit(5))
        + F.when(F.col("type") == "class", 15).when(F.col("type").isin("function", "method"), 10).when(F.col("type") == "interface", 5).otherwise(0)
    )
    ranked = found.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(*_order(F.desc("score"))[:1], "path", "ordinal", "sym_id")))
    return ranked.where(F.col("rank") <= k).select("repo_id", "rank", "sym_id", "name", "type", "path", "line", "callers", "score")


def fuzzy_best(symbols: DataFrame, query: str, k: int = 20, threshold: float = 0.5) -> DataFrame:
    """The ``k`` names most like the query, see fuzzy_search; ties by name."""
    return fuzzy_search(symbols, query, threshold).orderBy(F.desc("score"), "name").limit(k)


def fuzzy_search(symbols: DataFrame, query: str, threshold: float = 0.5) -> DataFrame:
    """Distinct symbol names like the query: name, score, symbols. Equal 1.0, part 0.9, all words 0.8, initials 0.75, else the ratio."""
    q = query.lower()
    names = symbols.where("name <> ''").groupBy("name").agg(F.count_distinct("sym_id").alias("symbols"))
    low = F.lower("name")
    initials = F.lower(F.when(F.col("name").rlike("[A-Z]"), F.array_join(F.regexp_extract_all("name", F.lit("([A-Z])"), F.lit(1)), "")).otherwise(F.array_join(F.transform(F.split("name", "_"), lambda p: F.substring(p, 1, 1)), "")))
    words = [w for w in q.replace("_", " ").split() if w]
    every = F.lit(bool(words))
    for w in words:
        every = every & low.contains(w)
    rule = F.when(low == q, 1.0).when(low.contains(q), 0.9).when(every, 0.8).when(initials.contains(q), 0.75)
    near = names.withColumn("rule", rule)
    # names alike in length alone can reach the threshold: 2 min / (a + b) bounds the ratio
    bound = 2 * F.least(F.length("name"), F.lit(len(q))) / (F.length("name") + len(q))
    ratio = F.when(bound >= threshold, sequence_ratio(F.lit(q), low))
    score = F.greatest(F.coalesce("rule", F.lit(0.0)), F.when(F.coalesce("rule", F.lit(0.0)) < 0.9, F.coalesce(ratio, F.lit(0.0))).otherwise(0.0))
    return near.withColumn("score", F.round(score, 3)).where(F.col("score") >= threshold).select("name", "score", "symbols")


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """Tokens of each symbol's document with their number: sym_id, token, n. The document is name, parameters, calls, doc, class, type and path."""
    s = one_per_symbol(symbols)
    text = F.concat_ws(" ", "name", F.array_join("params", " "), F.array_join("calls", " "), "doc", "class_name", "framework", "type", "path")
    return s.select("sym_id", F.explode(name_tokens(text)).alias("token")).groupBy("sym_id", "token").agg(F.count("*").alias("n"))


def inverse_frequencies(tokens: DataFrame) -> DataFrame:
    """token, documents, idf = ln(all / (1 + documents))."""
    total = tokens.select("sym_id").distinct().count()
    return tokens.groupBy("token").agg(F.count("*").alias("documents")).withColumn("idf", F.log(F.lit(float(total)) / (1 + F.col("documents"))))


def tfidf_search(symbols: DataFrame, query: list[str], k: int = 10) -> DataFrame:
    """The best ``k`` symbols by cosine of TF-IDF with the query widened by synonyms; +0.5 if the name has a query token."""
    wide = list(dict.fromkeys([*query, *(s for t in query for s in SYNONYMS.get(t, []))]))
    tokens = symbol_tokens(symbols)
    idf = inverse_frequencies(tokens)
    size = F.sum("n").over(W.partitionBy("sym_id"))
    weights = tokens.withColumn("tf", F.col("n") / size).join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    # as many rows as the widened query has tokens
    asked = {r["token"]: r["idf"] / len(wide) for r in idf.where(F.col("token").isin(wide)).collect()}
    length = sum(v * v for v in asked.values()) ** 0.5
    q = F.when(F.lit(False), F.lit(0.0))
    for token, weight in sorted(asked.items()):
        q = q.when(F.col("token") == token, F.lit(weight))
    dots = weights.withColumn("q", q).groupBy("sym_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn")).where("dot is not null and dn > 0")
    names = one_per_symbol(symbols, ["sym_id", "repo_id", "name", "type", "path"])
    scored = dots.join(names, "sym_id")
    hit = F.when(F.arrays_overlap(name_tokens(F.col("name")), F.array(*map(F.lit, query))), 0.5).when(F.arrays_overlap(name_tokens(F.col("name")), F.array(*map(F.lit, wide))), 0.2).otherwise(0.0)
    scored = scored.withColumn("score", F.round(F.col("dot") / F.col("dn") / F.lit(length or 1.0) + hit, 3)).where("score > 0.01")
    return scored.orderBy(F.desc("score"), "sym_id").limit(k).select("sym_id", "repo_id", "name", "type", "path", "score")


def concept_index(symbols: DataFrame, k: int = 15) -> DataFrame:
    """The best ``k`` symbols of each repository and concept: 3 for each keyword in the name, 1 in the doc."""
    low, doc = F.lower("name"), F.lower(F.coalesce("doc", F.lit("")))
    scores = F.array(*[
        F.struct(F.lit(c).alias("concept"), sum((F.when(low.contains(w), 3).otherwise(0) + F.when(doc.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("score"))
        for c, words in CONCEPTS.items()
    ])
    s = one_per_symbol(symbols, ["sym_id", "repo_id", "name", "doc"]).where("name is not null")
    hits = s.select("sym_id", "repo_id", "name", F.explode(F.filter(scores, lambda x: x["score"] > 0)).alias("c")).select("sym_id", "repo_id", "name", "c.concept", "c.score")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "concept").orderBy(F.desc("score"), "sym_id")))
    return ranked.where(F.col("rank") <= k)


# ---- fixed values: codes of symbol kinds in editors; anything else is a variable ----
KIND_CODES = {"class": 5, "method": 6, "enum": 10, "interface": 11, "function": 12, "type": 26}
VARIABLE = 13


def outline(symbols: DataFrame) -> DataFrame:
    """The symbols of each file for an editor: sym_id, repo_id, path, position, name, kind, line (0-based, 0 where unknown)."""
    s = one_per_symbol(symbols, ["sym_id", "repo_id", "path", "ordinal", "name", "type", "line"])
    kind = F.lit(VARIABLE)
    for name, code in KIND_CODES.items():
        kind = F.when(F.col("type") == name, code).otherwise(kind)
    return s.select("sym_id", "repo_id", "path", F.col("ordinal").alias("position"), F.coalesce("name", F.lit("?")).alias("name"), kind.alias("kind"), F.greatest(F.lit(0), F.coalesce(F.col("line") - 1, F.lit(0))).alias("line"))


def anywhere(files: DataFrame, symbols: DataFrame, query: str) -> DataFrame:
    """Files and symbols with ``query`` in their path or name, whatever the case: what, repo_id, path, name; null paths match nothing."""
    q = query.lower()
    f = files.where(F.lower("path").contains(q)).select(F.lit("file").alias("what"), "repo_id", "path", F.element_at(F.split("path", r"[/\\\\]"), -1).alias("name"))
    s = symbols.where(F.lower("name").contains(q) | F.lower("path").contains(q)).select(F.lit("symbol").alias("what"), "repo_id", "path", "name")
    return f.unionByName(s).distinct()


def query_words(query: str) -> list[str]:
    """The distinct words of a question, lower-case, in order."""
    return sorted({w for w in re.split(r"\W+", query.lower()) if w})


def concept_points(query: str) -> dict[str, int]:
    """What a question's words give each concept: 10 for its name, 8 if an alias holds the question or stands in it, 3 for each word of its name."""
    q = query.lower().strip()
    out = {}
    for concept in CONCEPTS:
        named = 10 * (concept.replace("_", " ") in q)
        called = 8 * any(alias in q or q in alias for alias in ALIASES[concept])
        out[concept] = named + called + 3 * len({concept} & set(query_words(q)))
    return out


def concepts_of_query(symbols: DataFrame, query: str) -> DataFrame:
    """Concepts that a question is about in each repository: repo_id, concept, score.

    To ``concept_points`` each of a repository's ten best symbols of the concept adds 1 for every word of the question,
    longer than two letters, in its name. Concepts without symbols in a repository or without points are left out.
    """
    best = concept_index(symbols, 10)
    low = F.lower("name")
    hits = sum((low.contains(w).cast("int") for w in query_words(query) if len(w) > 2), F.lit(0))
    points = F.lit(0)
    for concept, n in concept_points(query).items():
        points = F.when(F.col("concept") == concept, n).otherwise(points)
    return best.groupBy("repo_id", "concept").agg(F.sum(hits).alias("hits")).select("repo_id", "concept", (F.col("hits") + points).alias("score")).where("score > 0")


def concept_files(symbols: DataFrame, files: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` files of each repository and concept: repo_id, concept, path, score, rank.

    A file scores 2 for each keyword in its path; where none is, the highest score of its symbols (3 for each keyword in the
    name, 1 in the doc). Null paths are left out; ties go by path.
    """
    low, name, doc = F.lower("path"), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("doc", F.lit("")))
    hit = lambda text, w, points: F.when(text.contains(w), points).otherwise(0)
    scored = lambda points: F.array(*[F.struct(F.lit(c).alias("concept"), sum((points(w) for w in words), F.lit(0)).alias("score")) for c, words in CONCEPTS.items()])
    named = files.where("path is not null").select("repo_id", "path").unionByName(symbols.where("path is not null").select("repo_id", "path")).distinct()
    by_path = named.select("repo_id", "path", F.explode(scored(lambda w: hit(low, w, 2))).alias("c")).select("repo_id", "path", "c.concept", F.col("c.score").alias("own"), F.lit(0).alias("best"))
    s = symbols.where("path is not null").select("repo_id", "path", "name", "doc").distinct()
    hits = F.filter(scored(lambda w: hit(name, w, 3) + hit(doc, w, 1)), lambda x: x["score"] > 0)
    by_symbol = s.select("repo_id", "path", F.explode(hits).alias("c")).select("repo_id", "path", "c.concept", F.lit(0).alias("own"), F.col("c.score").alias("best"))
    both = by_path.where("own > 0").unionByName(by_symbol).groupBy("repo_id", "concept", "path").agg(F.max("own").alias("own"), F.max("best").alias("best"))
    score = F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("best"))
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "concept").orderBy(F.desc("score"), "path")))
    return ranked.where(F.col("rank") <= k).select("repo_id", "concept", "path", "score", "rank")


def concept_flows(symbols: DataFrame, edges: DataFrame, k: int = 5, callees: int = 5) -> DataFrame:
    """For each of the best ``k`` symbols of a repository's concept the first ``callees`` names it calls: repo_id, concept, rank, name, shown (array)."""
    best = concept_index(symbols, k)
    ranked = edges.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "src").orderBy("dst"))).where(F.col("_i") <= callees)
    shown = ranked.groupBy("repo_id", F.col("src").alias("name")).agg(F.array_sort(F.collect_list("dst")).alias("shown"))
    return best.join(shown, ["repo_id", "name"]).select("repo_id", "concept", "rank", "name", "shown")


def answer_symbols(symbols: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Names for a question that fits no concept: the first ``k`` (by name) of each repository with one of its words in them.

    Stop words and those of two letters or fewer are left out. Columns repo_id, rank, name, type, path, doc (100 characters);
    of a name's symbols the first by path and ordinal stands for it.
    """
    words = [w for w in query_words(query) if w not in STOP_WORDS and len(w) > 2]
    any_ = F.lit(False)
    for w in words:
        any_ = any_ | F.lower("name").contains(w)
    found = symbols.where(any_).groupBy("repo_id", "name").agg(F.min(F.struct(F.coalesce("path", F.lit("")).alias("path"), "ordinal", "sym_id", "type", F.left(F.coalesce("doc", F.lit("")), F.lit(100)).alias("doc"))).alias("s"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("name")))
    return ranked.where(F.col("rank") <= k).select("repo_id", "rank", "name", "s.type", "s.path", "s.doc")


def explanation_context(symbols: DataFrame, edges: DataFrame, query: str, concepts: int = 3, names: int = 8, shown: int = 4) -> DataFrame:
    """What a question is answered from: repo_id, concept, place, name, path, callers, callees (arrays).

    The ``concepts`` best concepts of each repository for the question, their ``names`` best symbols (place), each with the
    first ``shown`` names that call it and that it calls.
    """
    fit = concepts_of_query(symbols, query)
    fit = fit.withColumn("place", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("score"), "concept"))).where(F.col("place") <= concepts).select("repo_id", "concept", "place")
    best = concept_index(symbols, names).join(fit, ["repo_id", "concept"])
    places = symbols.select("sym_id", F.coalesce("path", F.lit("")).alias("path")).groupBy("sym_id").agg(F.min("path").alias("path"))

    def first(near: str, far: str, column: str) -> DataFrame:
        ranked = edges.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", near).orderBy(far))).where(F.col("_i") <= shown)
        return ranked.groupBy("repo_id", F.col(near).alias("name")).agg(F.array_sort(F.collect_list(far)).alias(column))

    out = best.join(places, "sym_id").join(first("dst", "src", "callers"), ["repo_id", "name"], "left").join(first("src", "dst", "callees"), ["repo_id", "name"], "left")
    none = F.array().cast("array<string>")
    return out.select("repo_id", "concept", "place", "rank", "sym_id", "name", "path", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def scoped_query(text: str) -> tuple[str | None, str]:
    """The file and the symbol of a query ``file:symbol``, parted at its first colon; without one the file is None."""
    path, colon, symbol = text.partition(":")
    return (path, symbol) if colon else (None, text)


def scoped_search(symbols: DataFrame, text: str) -> DataFrame:
    """Symbols for ``file:symbol``: of files with the first part in their path, those with the second in their name, all where it is empty."""
    path, name = scoped_query(text)
    s = one_per_symbol(symbols, ["sym_id", "repo_id", "path", "ordinal", "name", "type", "line"])
    if path is not None:
        s = s.where(F.lower("path").contains(path.lower()))
    return s if name == "" else s.where(F.lower("name").contains(name.lower()))


def with_imports(found: DataFrame, imports: DataFrame, query: str) -> DataFrame:
    """``found`` (repo_id, path, name, type) and a row of type ``import`` for every imported module with ``query`` in it."""
    rows = imports.where(F.lower("module").contains(query.lower())).select("repo_id", "path", F.col("module").alias("name"), F.lit("import").alias("type")).distinct()
    return found.select("repo_id", "path", "name", "type").unionByName(rows)


def flow_by_file(edges: DataFrame, symbols: DataFrame, query: str, k: int = 5, callees: int = 3) -> DataFrame:
    """Calling names with a word of ``query`` in them, the first ``k`` of each file: repo_id, path, name, calls (number), shown (array).

    The file is that of the name's first symbol by path and ordinal, ``unknown`` without one.
    """
    words = [w for w in query.lower().split() if w]
    any_ = F.lit(False)
    for w in words:
        any_ = any_ | F.lower("src").contains(w)
    wanted = edges.where(any_)
    counts = wanted.groupBy("repo_id", F.col("src").alias("name")).agg(F.count("*").alias("calls"))
    ranked = wanted.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "src").orderBy("dst"))).where(F.col("_i") <= callees)
    shown = ranked.groupBy("repo_id", F.col("src").alias("name")).agg(F.array_sort(F.collect_list("dst")).alias("shown"))
    first = symbols.where("name <> '' and path is not null").groupBy("repo_id", "name").agg(F.min(F.struct("path", "ordinal")).alias("f")).select("repo_id", "name", "f.path")
    out = counts.join(shown, ["repo_id", "name"]).join(first, ["repo_id", "name"], "left").withColumn("path", F.coalesce("path", F.lit("unknown")))
    return out.withColumn("_n", F.row_number().over(W.partitionBy("repo_id", "path").orderBy("name"))).where(F.col("_n") <= k).select("repo_id", "path", "name", "calls", "shown")
