"""Dead code, complexity, duplicates and documentation coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines
from ..session import cut_lineage, split_join, spread
from ..tables import clean_path, extension

# ---- fixed values: names that nothing in the code calls although they are in use ----
ENTRY_NAMES = ["main", "app", "init", "__init__", "setup", "configure", "register", "run", "start", "bootstrap", "index", "default", "handler"]
LIFECYCLE = ["componentDidMount", "componentWillUnmount", "render", "build", "ngOnInit", "ngOnDestroy", "viewDidLoad", "viewWillAppear", "onCreate", "onStart", "onResume", "onPause", "onStop", "onDestroy", "initState", "dispose", "didChangeDependencies"]
BRANCH = r"\b(if|elif|else if|for|while|catch|except|case|&&|\|\||and |or |when)\b"


def likely_entry_point() -> Column:
    """Symbols that need no caller: with a framework, classes, in tests, lifecycle and dunder names and the like."""
    path = F.lower(F.coalesce("path", F.lit("")))
    return (
        (F.coalesce("framework", F.lit("")) != "")
        | F.lower("name").isin(ENTRY_NAMES)
        | (F.coalesce("type", F.lit("")) == "class")
        | path.contains("test")
        | path.contains("spec")
        | F.col("name").isin(LIFECYCLE)
        | (F.col("name").startswith("__") & F.col("name").endswith("__"))
        | F.col("name").startswith("get_")
        | F.col("name").startswith("post_")
        | F.col("name").startswith("handle_")
    )


def dead_code(symbols: DataFrame, calls: DataFrame, imported: DataFrame) -> DataFrame:
    """Symbols that no call of their repository names (by what follows the last dot) and no import; see likely_entry_point.

    ``imported`` has repo_id and name. Symbols without a name are left out.
    """
    called = calls.where("dst <> ''").select("repo_id", F.element_at(F.split("dst", r"\."), -1).alias("name"))
    used = called.unionByName(imported.select("repo_id", "name")).distinct()
    own = symbols.where("name <> ''").where(~likely_entry_point()).select("sym_id", "repo_id", "path", "name", "type", "line").distinct()
    return own.join(used, ["repo_id", "name"], "left_anti").select("sym_id", "repo_id", "path", "name", "type", "line")


def source_metrics(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Per function or method: sym_id, repo_id, name, lines, cyclomatic, nesting, params, calls, score, rating.

    The body is what stands from the line after the declaration to ``end_line``; blank and comment lines don't count.
    cyclomatic is 1 + branch words; nesting is the deepest indentation below the declaration's, by four. Symbols whose
    file has no content, or whose lines are null, are left out.
    """
    s = symbols.where("type in ('function', 'method') and line >= 1 and end_line >= line").select("sym_id", "repo_id", clean_path(F.col("path")).alias("path"), "name", "line", "end_line", F.greatest(F.coalesce(F.size("params"), F.lit(0)), F.lit(0)).alias("params"), F.greatest(F.coalesce(F.size(F.array_distinct("calls")), F.lit(0)), F.lit(0)).alias("calls")).distinct()
    f = files.where("content <> '' and path is not null").groupBy("repo_id", clean_path(F.col("path")).alias("path")).agg(F.min("content").alias("content"))
    # a file's text is split once; its symbols, a list as long as the file declares, take their lines from it
    by_file = s.groupBy("repo_id", "path").agg(F.collect_list(F.struct("sym_id", "name", "params", "calls", "line", "end_line")).alias("s"))
    j = f.join(by_file, ["repo_id", "path"]).withColumn("all", lines(F.col("content"))).drop("content")
    cut = F.expr("transform(filter(s, x -> x.line <= size(all)), x -> struct(x.sym_id, x.name, x.params, x.calls, all[x.line - 1] as head, slice(all, x.line + 1, x.end_line - x.line) as body))")
    j = j.select("repo_id", F.explode(cut).alias("x")).select("repo_id", "x.*")
    code = F.filter("body", lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(#|//|\*)"))
    j = j.select("sym_id", "repo_id", "name", "params", "calls", "head", code.alias("code"))
    indent = lambda x: F.length(F.regexp_extract(x, "^([ \t]*)", 1))
    depth = F.coalesce(F.array_max(F.transform("code", lambda x: F.floor((indent(x) - indent(F.col("head"))) / 4).cast("int"))), F.lit(0))
    j = j.select("sym_id", "repo_id", "name", "params", "calls", F.size("code").alias("lines"), (1 + F.regexp_count(F.array_join("code", "\n"), F.lit(BRANCH))).alias("cyclomatic"), F.greatest(depth, F.lit(0)).alias("nesting"))
    return rated(j)


def rated(metrics: DataFrame) -> DataFrame:
    """Score (0 to 100) and rating of lines, cyclomatic, nesting, params, calls."""

    def steps(column: str, limits: list[tuple[int, int]]) -> Column:
        out = F.when(F.lit(False), 0)
        for limit, points in limits:
            out = out.when(F.col(column) > limit, points)
        return out.otherwise(0)

    score = steps("lines", [(100, 30), (50, 20), (25, 10), (10, 5)]) + steps("cyclomatic", [(20, 30), (10, 20), (5, 10), (3, 5)]) + steps("nesting", [(5, 20), (3, 10), (2, 5)]) + steps("params", [(7, 10), (4, 5)]) + steps("calls", [(15, 10), (8, 5)])
    out = metrics.withColumn("score", F.least(score, F.lit(100)))
    return out.withColumn("rating", F.when(F.col("score") < 20, "low").when(F.col("score") < 50, "medium").when(F.col("score") < 80, "high").otherwise("critical"))


def normal_code(text: Column) -> Column:
    """A code text without comments and layout, its strings and numbers made equal."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, r"(?m)^\s*(#|//|/?\*).*$", "")
    x = F.regexp_replace(x, "\"[^\"\n]*\"|'[^'\n]*'", "STR")
    x = F.regexp_replace(x, r"(#|//).*", "")
    x = F.regexp_replace(x, r"\d+", "NUM")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def exact_duplicates(bodies: DataFrame, least_characters: int = 80) -> DataFrame:
    """Groups of functions that are equal but for comments, literals and layout: fingerprint, members, files, repositories.

    Only groups of two symbols or more; null bodies and those shorter than ``least_characters`` are left out.
    """
    b = spread(bodies.where("type in ('function', 'method')").select("sym_id", "repo_id", "path", "body"), "sym_id").select("sym_id", "repo_id", "path", normal_code(F.col("body")).alias("code")).where(F.length("code") >= least_characters)
    g = b.select("sym_id", "repo_id", "path", F.md5("code").alias("fingerprint")).distinct()
    return g.groupBy("fingerprint").agg(F.count_distinct("sym_id").alias("members"), F.count_distinct("repo_id", "path").alias("files"), F.count_distinct("repo_id").alias("repositories")).where("members > 1")


def _duplicate_classes(bodies: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Functions with their class (sym_id, class_id) and the classes that alike (a, b, similarity), each pair once.

    Exact: two sets that alike share one of their rarest shingles (prefix filter), sizes and places bound what they can share,
    and what is left is verified. Hot shingles are joined by parts.
    """
    b = spread(bodies.where("type in ('function', 'method')").select("sym_id", "body"), "sym_id").select("sym_id", F.regexp_extract_all(normal_code(F.col("body")), F.lit(r"(\w+)"), F.lit(1)).alias("w")).where(F.size("w") >= words)
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - words), lambda i: F.xxhash64(*[F.element_at("w", (i + k + 1).cast("int")) for k in range(words)])))
    b = b.select("sym_id", F.array_sort(shingles).alias("set")).withColumn("class_id", F.xxhash64("set"))
    members = cut_lineage(b.select("sym_id", "class_id").distinct())
    sets = cut_lineage(b.groupBy("class_id").agg(F.first("set").alias("set")))
    each = sets.select("class_id", F.size("set").alias("n"), F.explode("set").alias("s"))
    frequency = each.groupBy("s").agg(F.count("*").alias("df"))
    ranked = each.join(frequency, "s").withColumn("r", F.row_number().over(W.partitionBy("class_id").orderBy("df", "s")))
    # sets of n and m alike by t share ceil(t n) shingles at least, so one stands among the first n - ceil(t n) + 1
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1).where("df > 1")
    # sets that alike have sizes within a factor of t: they fall to one band or to neighbouring ones
    band = F.floor(F.log("n") / -F.log(F.lit(similarity)) + 1e-9).cast("int")
    prefix = cut_lineage(prefix.select("s", F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), band.alias("band")))
    other = prefix.select("s", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ra").alias("rb"), F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"))
    pairs = split_join(prefix, other, ["s", "band"], 2_000)
    least = F.ceil(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - 1e-9)  # shared shingles of sets that alike
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = pairs.where(smaller & (F.col("na") >= similarity * F.col("nb") - 1e-9))
    # shingles are ranked alike everywhere, so what is left after the first common one bounds the rest
    first = pairs.groupBy("a", "b").agg(F.min(F.struct("ra", "rb", "na", "nb")).alias("p")).select("a", "b", "p.*")
    pairs = first.where(1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= least).select("a", "b")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = shared / (F.size("sa") + F.size("sb") - shared)
    linked = both.where(alike >= similarity - 1e-9).select("a", "b", alike.alias("similarity"))
    return members, linked


def near_duplicates(bodies: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per function: sym_id, class_id, copies, links.

    A class holds the functions with the same set of ``words``-word shingles of normalised code and is named by its smallest
    sym_id; copies is the number of its functions, links the number of other classes with a Jaccard similarity of at
    least ``similarity``. Functions without shingles are left out; repeated rows and null bodies change nothing.
    """
    members, linked = _duplicate_classes(bodies, words, similarity)
    links = linked.select(F.col("a").alias("class_id")).unionByName(linked.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("links"))
    copies = members.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("sym_id").alias("first"))
    return members.join(copies, "class_id").join(links, "class_id", "left").select("sym_id", F.col("first").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def duplicate_links(bodies: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The links between classes of near duplicates: class_a < class_b (named as in near_duplicates), similarity (six places)."""
    members, linked = _duplicate_classes(bodies, words, similarity)
    named = cut_lineage(members.groupBy("class_id").agg(F.min("sym_id").alias("first")))
    out = linked.join(named.toDF("a", "fa"), "a").join(named.toDF("b", "fb"), "b")
    return out.select(F.least("fa", "fb").alias("class_a"), F.greatest("fa", "fb").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def doc_coverage(symbols: DataFrame) -> DataFrame:
    """Per repository and extension: symbols, those with a doc, percent rounded to one place."""
    s = symbols.select("sym_id", "repo_id", extension(F.col("path")).alias("ext"), (F.coalesce(F.trim("doc"), F.lit("")) != "").alias("has")).distinct()
    return s.groupBy("repo_id", "ext").agg(F.count("*").alias("symbols"), F.count_if("has").alias("documented")).withColumn("percent", F.round(F.col("documented") * 100.0 / F.col("symbols"), 1))


def brace_depth(files: DataFrame) -> DataFrame:
    """Per distinct content of a file: repo_id, path, lines, deepest (most braces open after a line), left_open.

    The running depth is folded over a file's lines where the row stands, without a shuffle but the one that makes
    deliveries one. Null and empty contents are left out.
    """
    opened = lambda t: F.length(F.regexp_replace(t, r"[^{]", "")) - F.length(F.regexp_replace(t, r"[^}]", ""))
    rows = files.where("content <> '' and path is not null").withColumn("t", F.transform(F.split("content", "\n"), opened))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))
    step = lambda a, x: F.struct((a["depth"] + x).alias("depth"), F.greatest(a["deepest"], a["depth"] + x).alias("deepest"))
    return rows.select("repo_id", "path", F.xxhash64("content").alias("_c"), F.size("t").alias("lines"), F.aggregate("t", start, step).alias("d")).select("repo_id", "path", "_c", "lines", "d.deepest", F.col("d.depth").alias("left_open")).distinct().drop("_c")
