"""Which files an index leaves out, and why.

Order: default folders and endings, the repository's exclude patterns, include patterns (if any, one must fit), tests,
size. The first reason that holds is given. Paths with null are left out of the result; null patterns fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import glob_pattern
from ..session import small_side
from ..tables import clean_path

# ---- fixed values: folders and endings that are never indexed; what marks a test ----
IGNORED_FOLDERS = [
    "__pycache__", ".venv", "venv", "env", ".env", "virtualenv", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "node_modules", ".npm", ".yarn", ".pnpm-store", "bower_components",
    "dist", "build", "out", "output", "target", "bin", "obj", ".build", "_build", "lib", ".next", ".nuxt", ".svelte-kit", ".angular", ".turbo", ".parcel-cache", ".webpack", ".rollup.cache", ".vite",
    ".expo", ".gradle", "Pods", "DerivedData", ".idea", ".vscode", ".vs", ".git", ".svn", ".hg", ".cache", ".tmp", "tmp", "temp", ".temp", "coverage", ".nyc_output", ".jest", "vendor", "third_party", "external", "deps",
    "__tests__", "__mocks__", "test_fixtures", ".serverless", ".terraform", ".pulumi",
]
IGNORED_ENDINGS = [".pyc", ".pyo", ".log", ".egg-info", ".DS_Store", "Thumbs.db", ".env.local"]
TEST_PATTERN = r"\.test\.|\.spec\.|__tests__|test_|_test\.|tests/|test/|spec/|__spec__|test\.(js|ts)|spec\.(js|ts)"
#: Largest file in bytes.
MAX_BYTES = 1_048_576


def ignored_by_default(path: Column) -> Column:
    p = clean_path(path)
    ends = F.lit(False)
    for e in IGNORED_ENDINGS:
        ends = ends | p.endswith(e)
    return F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, IGNORED_FOLDERS))) | ends


#: Repositories whose patterns are broadcast at most; ignore rules likewise.
BROADCAST_ROWS, RULE_ROWS = 100_000, 500_000


def pattern_hits(files: DataFrame, patterns: DataFrame, parts: bool = True) -> DataFrame:
    """Distinct (repo_id, path) that a pattern of its repository fits: as a part of the path, or as a glob.

    Without ``parts`` (for what is included) as a glob only, of the whole path or of what stands after any folder.

    A repository's patterns become one row, globs one expression, so a file meets them all at once and a large repository
    isn't one task: up to BROADCAST_ROWS repositories their rows go to the files.
    """
    f = files.where("path is not null").select("repo_id", "path").distinct().withColumn("p", clean_path(F.col("path")))
    g = patterns.where("pattern <> ''").select("repo_id", F.translate("pattern", "\\", "/").alias("pattern")).distinct().withColumn("glob", glob_pattern(F.col("pattern")))
    g = g.groupBy("repo_id").agg(F.array_sort(F.collect_list("pattern")).alias("parts"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("(?:"), "glob", F.lit(")")))), "|").alias("globs"))
    whole = F.expr("p rlike globs")
    # a glob starts at ^; what stands after a folder is met by letting any folders come first
    fits = F.exists("parts", lambda x: F.col("p").contains(x)) | whole if parts else whole | F.expr("p rlike replace(globs, '(?:^', '(?:^.*/')")
    return f.join(small_side(g, BROADCAST_ROWS), "repo_id").where(fits).select("repo_id", "path")


def ignore_reasons(files: DataFrame, excludes: DataFrame, includes: DataFrame | None = None, include_tests: bool = False, max_bytes: int = MAX_BYTES) -> DataFrame:
    """repo_id, path, reason (default, excluded, not_included, test, too_large, or null for files to index)."""
    f = files.where("path is not null").groupBy("repo_id", "path").agg(F.max("size_bytes").alias("size_bytes"))
    out = f.join(pattern_hits(files, excludes).withColumn("ex", F.lit(True)), ["repo_id", "path"], "left")
    out = out.join(pattern_hits(files, includes, parts=False).withColumn("inc", F.lit(True)), ["repo_id", "path"], "left") if includes is not None else out.withColumn("inc", F.lit(True))
    test = F.lit(not include_tests) & clean_path(F.col("path")).rlike(TEST_PATTERN)
    reason = F.when(ignored_by_default(F.col("path")), "default").when(F.col("ex"), "excluded").when(F.col("inc").isNull(), "not_included").when(test, "test").when(F.col("size_bytes") > max_bytes, "too_large")
    return out.select("repo_id", "path", reason.alias("reason"))


def gitignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Paths (repo_id, path) that ignore rules (repo_id, ordinal, pattern) leave out: the last rule that fits decides.

    A pattern without an inner slash fits any segment, one with it fits from the top; ``!`` takes back, a trailing slash
    asks for a folder, ``*`` and ``?`` stay within a segment and ``**`` crosses them.
    """
    r = rules.where("trim(pattern) <> '' and not startswith(trim(pattern), '#')").withColumn("raw", F.trim("pattern")).withColumn("keep", F.col("raw").startswith("!"))
    body = F.regexp_replace("raw", "^!", "")
    top = F.regexp_replace(body, "/$", "").contains("/")
    core = F.regexp_replace(F.regexp_replace(body, "^/", ""), "/$", "")
    rx = F.regexp_replace(core, r"([.+^$(){}|\[\]])", r"\\$1")
    rx = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(rx, r"\*\*/", "\u0001"), r"\*\*", "\u0002"), r"\*", "[^/]*"), r"\?", "[^/]"), "\u0001", "(?:.*/)?")
    rx = F.regexp_replace(rx, "\u0002", ".*")
    rx = F.concat(F.when(top, "^").otherwise("(?:^|/)"), rx, F.when(body.endswith("/"), "/").otherwise("(?:/|$)"))
    # up to RULE_ROWS rules go to the paths, so a large repository isn't one task
    ruled = paths.join(small_side(r.select("repo_id", "ordinal", "keep", rx.alias("rx")), RULE_ROWS), "repo_id").where(F.expr("path rlike rx"))
    last = ruled.groupBy("repo_id", "path").agg(F.max_by("keep", "ordinal").alias("keep"))
    return last.where(~F.col("keep")).select("repo_id", "path")


def dry_run(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Number of files per reason, those to index as ``indexed``."""
    return ignore_reasons(files, excludes).groupBy(F.coalesce("reason", F.lit("indexed")).alias("reason")).agg(F.count("*").alias("files"))


def first_of(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def dry_run_sample(files: DataFrame, excludes: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` paths of each repository that would be indexed, in order: repo_id, rank, path."""
    kept = ignore_reasons(files, excludes).where("reason is null").select("repo_id", "path")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("path"))).where(F.col("rank") <= k).select("repo_id", "rank", "path")


# ---- fixed values: folders that a scan of code for doubtful patterns passes over ----
SCAN_FOLDERS = ["node_modules", "venv", ".venv", "__pycache__", ".git", "dist", "build"]


def scanned(path: Column) -> Column:
    """Whether a scan for doubtful code reads a path: not below a folder of installed or built files."""
    return ~F.arrays_overlap(F.split(clean_path(path), "/"), F.array(*map(F.lit, SCAN_FOLDERS)))
