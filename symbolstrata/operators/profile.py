"""Profiles of repositories: counts by type, language, role, framework, folder; entry points; what reports make sense.

Records are counted once however often they were delivered. Null values form groups of their own where a group is asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import clean_path

# ---- fixed values: languages by extension; frameworks by needle, first match wins ----
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".java": "java", ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".dart": "dart"}
FRAMEWORKS = ["react-native", "nextjs", "nestjs", "fastapi", "django", "flask", "spring", "aspnet", "angular", "react", "expo", "flutter", "swiftui", "uikit", "express", "remix"]
FRONTEND = ["react-native", "nextjs", "angular", "react", "expo", "flutter", "swiftui", "uikit", "remix"]
# ---- fixed values: roles of files by folder, in order ----
ROLES = [
    ("cli", ["/cli/", "/commands/"]),
    ("api", ["/api/", "/routes/", "/route/", "/controllers/", "/handlers/", "/endpoints/"]),
    ("data", ["/models/", "/model/", "/schemas/", "/schema/", "/entities/", "/entity/", "/db/", "/database/", "/migrations/", "/repositories/"]),
    ("ui", ["/components/", "/pages/", "/screens/", "/views/", "/ui/", "/widgets/"]),
    ("services", ["/services/", "/service/", "/usecases/", "/use-cases/", "/stores/", "/state/", "/domain/"]),
    ("infra", ["/config/", "/middleware/", "/middlewares/", "/auth/", "/infra/", "/platform/", "/plugins/"]),
]


def language(ext: Column) -> Column:
    """The language of an extension, whatever the spelling of the language column; null if unknown."""
    out = F.when(F.lit(False), "")
    for e, name in LANGUAGES.items():
        out = out.when(F.lower(ext) == e, name)
    return out


def normal_framework(framework: Column) -> Column:
    low = F.lower(framework)
    out = F.when(framework.isNull() | (framework == ""), F.lit(None).cast("string"))
    for needle in FRAMEWORKS:
        out = out.when(low.contains(needle), needle)
    return out.otherwise(low)


def role_of(path: Column) -> Column:
    """The role that a path suggests; folders count also at the top."""
    p = F.concat(F.lit("/"), F.lower(clean_path(path)))
    out = F.when(p.rlike("/(cli|manage)\\.py$"), "cli")
    for role, needles in ROLES:
        test = F.lit(False)
        for n in needles:
            test = test | p.contains(n)
        out = out.when(test, role)
    return out.otherwise("core")


def unique_files(files: DataFrame) -> DataFrame:
    """Files without their content, one per (repo_id, path); of differing deliveries the largest value of each column."""
    return files.where("path is not null").groupBy("repo_id", "path").agg(*[F.max(c).alias(c) for c in ("ext", "language", "size_bytes", "sha256", "role")])


def project_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    f = files.groupBy("repo_id").agg(F.count_distinct("path").alias("files"))
    s = symbols.select("repo_id", "sym_id", "type").distinct().groupBy("repo_id").agg(F.count("*").alias("symbols"), F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "method").alias("methods"), F.count_if(F.col("type") == "class").alias("classes"))
    e = edges.groupBy("repo_id").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("callers"))
    return f.join(s, "repo_id", "full").join(e, "repo_id", "full").fillna(0)


def top_files(symbols: DataFrame, k: int = 10) -> DataFrame:
    n = symbols.where("path is not null").select("repo_id", "path", "sym_id").distinct().groupBy("repo_id", "path").agg(F.count("*").alias("symbols"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("symbols"), "path"))).where(F.col("rank") <= k)


def entry_points(symbols: DataFrame, edges: DataFrame, per_file: int = 8) -> DataFrame:
    """Functions outside classes that nothing in their repository calls, the first ``per_file`` of each file."""
    called = edges.select("repo_id", F.col("dst").alias("name")).distinct()
    top = symbols.where("type = 'function' and (class_name is null or class_name = '') and name <> ''").select("repo_id", "path", "ordinal", "name", "sym_id").distinct()
    free = top.join(called, ["repo_id", "name"], "left_anti")
    return free.withColumn("rank", F.row_number().over(W.partitionBy("repo_id", "path").orderBy("ordinal", "sym_id"))).where(F.col("rank") <= per_file).select("repo_id", "path", "name", "rank")


def recommendations(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Which reports a repository's content calls for: repo_id, reports (array)."""
    roles = files.where("path is not null").groupBy("repo_id").agg(*[F.max((role_of(F.col("path")) == r).cast("int")).alias(r) for r in ("ui", "cli", "api", "data")])
    fw = symbols.groupBy("repo_id").agg(F.max(F.coalesce(normal_framework(F.col("framework")).isin(FRONTEND), F.lit(False)).cast("int")).alias("front"), F.max((F.col("framework") != "").cast("int")).alias("any"))
    all_ = roles.join(fw, "repo_id", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    names = F.array(F.lit("overview"), F.lit("tech"), F.lit("hotspots"), F.when(on("api"), "routes"), F.when(on("data"), "entities"), F.when(on("ui") | on("front"), "frontend"), F.when(on("cli"), "cli"), F.when(on("any"), "imports"))
    return all_.select("repo_id", F.array_join(F.array_compact(names), " ").alias("reports"))


def share_of_max(counts: DataFrame, column: str, by: str) -> DataFrame:
    """Whole percent of the largest value within each ``by``; the largest are joined, so no task gathers a hot ``by``."""
    most = counts.groupBy(F.col(by).alias("_by")).agg(F.max(column).alias("_most"))
    return counts.join(most, F.col(by).eqNullSafe(F.col("_by"))).withColumn("percent", F.floor(F.col(column) * 100 / F.col("_most")).cast("int")).drop("_by", "_most")


def file_summaries(files: DataFrame, symbols: DataFrame, calls: DataFrame, file_deps: DataFrame) -> DataFrame:
    """Per file of any of the tables: symbols, functions, methods, classes, edges, imports, imported_by; paths cleaned, null paths left out."""
    names = ["symbols", "functions", "methods", "classes", "edges", "imports", "imported_by"]

    def counted(df: DataFrame, path: str, **on: Column) -> DataFrame:
        return df.where(F.col(path) != "").select("repo_id", clean_path(F.col(path)).alias("path"), *[on.get(n, F.lit(False)).cast("int").alias(n) for n in names])

    one = F.lit(True)
    kind = lambda k: F.coalesce(F.col("type") == k, F.lit(False))
    s = symbols.select("sym_id", "repo_id", "path", "type").distinct()
    e = calls.where("src <> '' and dst <> ''").select("repo_id", "path", "src", "dst").distinct()
    d = file_deps.where("src_path <> '' and dst_path <> ''").select("repo_id", clean_path(F.col("src_path")).alias("src"), clean_path(F.col("dst_path")).alias("dst")).distinct().where("src <> dst")
    parts = [
        counted(files.select("repo_id", "path"), "path"),
        counted(s, "path", symbols=one, functions=kind("function"), methods=kind("method"), classes=kind("class")),
        counted(e, "path", edges=one),
        counted(d, "src", imports=one),
        counted(d, "dst", imported_by=one),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("repo_id", "path").agg(*[F.sum(n).alias(n) for n in names])


def class_callees(symbols: DataFrame) -> DataFrame:
    """The names that any method of a class calls, once each: repo_id, path, class_name, callee."""
    s = symbols.where("class_name <> ''").select("repo_id", "path", "class_name", F.explode("calls").alias("callee"))
    return s.where("callee <> ''").distinct()


def shared_names(symbols: DataFrame, least: int = 2) -> DataFrame:
    """Names with symbols in at least ``least`` repositories: name, repositories, symbols; null and empty names are left out."""
    pairs = symbols.where("name <> ''").select("name", "repo_id", "sym_id").distinct()
    per = pairs.groupBy("name", "repo_id").agg(F.count("*").alias("n"))  # hot names shrink to a row for each repository
    return per.groupBy("name").agg(F.count("repo_id").alias("repositories"), F.sum("n").alias("symbols")).where(F.col("repositories") >= least)


def within_budget(rows: DataFrame, tokens: str, by: list[str], order: list[str], budget: int) -> DataFrame:
    """The rows of each ``by`` whose predecessors in ``order`` hold fewer than ``budget`` tokens; a budget of 0 keeps all."""
    if budget <= 0:
        return rows
    before = F.sum(tokens).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < budget).drop("_before")


# ---- fixed values: files by which a program is entered ----
ENTRY_FILES = ["main.py", "app.py", "server.py", "cli.py", "__main__.py", "manage.py", "main.ts", "main.js", "index.ts", "index.js"]


def content_roles(files: DataFrame, symbols: DataFrame, routes: DataFrame, entities: DataFrame) -> DataFrame:
    """The role of each file by its path and by what it holds: repo_id, path, role.

    In this order: cli by path; api by routes or path; data by entities (those of a known kind) or path; ui by frontend
    frameworks or path; services and infra by path; else core.
    """
    flag = lambda df, name: df.where("path is not null").select("repo_id", "path", F.lit(True).alias(name)).distinct()
    front = symbols.where(normal_framework(F.col("framework")).isin(FRONTEND))
    f = files.where("path is not null").select("repo_id", "path").distinct()
    f = f.join(flag(routes, "api"), ["repo_id", "path"], "left").join(flag(entities.where("kind <> 'unknown'"), "data"), ["repo_id", "path"], "left").join(flag(front, "ui"), ["repo_id", "path"], "left")
    by_path = role_of(F.col("path"))
    rank = {r: i for i, r in enumerate(["cli", "api", "data", "ui", "services", "infra", "core"])}
    place = F.least(*[F.when(F.col(c), rank[c]).otherwise(rank["core"]) for c in ("api", "data", "ui")], *[F.when(by_path == r, i).otherwise(rank["core"]) for r, i in rank.items()])
    role = F.element_at(F.array(*map(F.lit, rank)), place + 1)
    return f.select("repo_id", "path", role.alias("role"))


def layer_totals(roles: DataFrame, symbols: DataFrame, routes: DataFrame, entities: DataFrame) -> DataFrame:
    """Per repository and role: files, symbols, routes and entities."""
    count = lambda df, name, key: df.select("repo_id", "path", key).distinct().groupBy("repo_id", "path").agg(F.count("*").alias(name))
    r = roles
    for part in (count(symbols, "symbols", "sym_id"), count(routes.withColumn("_e", F.struct("method", "route")), "routes", "_e"), count(entities, "entities", "sym_id")):
        r = r.join(part, ["repo_id", "path"], "left")
    return r.groupBy("repo_id", "role").agg(F.count("*").alias("files"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("symbols", "routes", "entities")])


def reasoned_entry_points(symbols: DataFrame, edges: DataFrame, routes: DataFrame, per_file: int = 8, most: int = 12) -> DataFrame:
    """Where each repository is entered: repo_id, place, name, path, reason; at most ``most`` of each.

    Of a file first up to three functions or classes outside classes if its name is one of ENTRY_FILES (``entry_file``), then up to five
    routes (``api_route``), then functions that nothing calls (``top_level``), up to ``per_file`` in all. The same name in
    the same file counts once; files go by path.
    """
    s = symbols.where("name <> '' and path is not null and coalesce(class_name, '') = ''").select("repo_id", "path", "ordinal", "sym_id", "name", "type").distinct()
    entered = F.lower(F.element_at(F.split(clean_path(F.col("path")), "/"), -1)).isin(ENTRY_FILES)
    by_order = W.partitionBy("repo_id", "path").orderBy("ordinal", "sym_id")
    first = s.where(entered & F.col("type").isin("function", "class")).withColumn("n", F.row_number().over(by_order)).where("n <= 3").select("repo_id", "path", "name", F.lit(0).alias("turn"), "n", F.lit("entry_file").alias("reason"))
    each = routes.select("repo_id", "path", "line", F.concat_ws(" ", "method", "route").alias("name")).distinct()
    each = each.withColumn("n", F.row_number().over(W.partitionBy("repo_id", "path").orderBy("line", "name"))).where("n <= 5").select("repo_id", "path", "name", F.lit(1).alias("turn"), "n", F.lit("api_route").alias("reason"))
    called = edges.select("repo_id", F.col("dst").alias("name")).distinct()
    free = s.where("type = 'function'").join(called, ["repo_id", "name"], "left_anti").withColumn("n", F.row_number().over(by_order)).where(F.col("n") <= per_file).select("repo_id", "path", "name", F.lit(2).alias("turn"), "n", F.lit("top_level").alias("reason"))
    rows = first.unionByName(each).unionByName(free).groupBy("repo_id", "path", "name").agg(F.min(F.struct("turn", "n", "reason")).alias("r")).select("repo_id", "path", "name", "r.*")
    rows = rows.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "path").orderBy("turn", "n", "name"))).where(F.col("_i") <= per_file)
    ranked = rows.withColumn("place", F.row_number().over(W.partitionBy("repo_id").orderBy("path", "turn", "n", "name")))
    return ranked.where(F.col("place") <= most).select("repo_id", "place", "name", "path", "reason")


def output_recommendations(files: DataFrame, symbols: DataFrame, routes: DataFrame, entities: DataFrame) -> DataFrame:
    """Which outputs a repository calls for: repo_id, outputs (joined by a blank): docs, diagrams and report always, dashboard with routes or entities, viz up to 500 symbols."""
    f = files.select("repo_id").where("repo_id is not null").distinct()
    n = symbols.select("repo_id", "sym_id").distinct().groupBy("repo_id").agg(F.count("*").alias("n"))
    has = routes.select("repo_id").unionByName(entities.select("repo_id")).distinct().withColumn("has", F.lit(True))
    out = F.array(F.lit("docs"), F.lit("diagrams"), F.lit("report"), F.when(F.col("has"), "dashboard"), F.when(F.col("n").between(1, 500), "viz"))
    return f.join(n, "repo_id", "left").join(has, "repo_id", "left").select("repo_id", F.array_join(F.array_compact(out), " ").alias("outputs"))
