"""Lookups over an index: what a symbol, a file or a module comes with when someone asks for it.

Tables are taken as delivered and records made one per key. Best-k results have a fixed order; the others are whole.
Null names and paths match nothing; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import body_ends, lines
from ..tables import clean_path


def symbol_code(symbols: DataFrame, bodies: DataFrame) -> DataFrame:
    """The body of each symbol: sym_id, repo_id, path, name, type, body.

    Its own if the table has it, else that of a symbol of the same name in the same file, of the same type before others.
    """
    s = symbols.where("name <> ''").select("sym_id", "repo_id", "path", "name", "type").distinct()
    b = bodies.where("body <> ''")
    own = b.groupBy("sym_id").agg(F.min("body").alias("own"))
    left = s.join(own, "sym_id", "left")
    near = b.groupBy("repo_id", "path", "name").agg(F.min(F.struct("sym_id", "body")).alias("any"))
    same = b.groupBy("repo_id", "path", "name", "type").agg(F.min(F.struct("sym_id", "body")).alias("same"))
    out = left.join(same, ["repo_id", "path", "name", "type"], "left").join(near, ["repo_id", "path", "name"], "left")
    return out.select("sym_id", "repo_id", "path", "name", "type", F.coalesce("own", "same.body", "any.body").alias("body")).where("body is not null")


def symbol_cards(symbols: DataFrame, edges: DataFrame, query: str, shown: int = 5) -> DataFrame:
    """Symbols with ``query`` in their name and what a reader wants with them.

    Columns sym_id, repo_id, path, name, type, line, params (number), callers (number), called_by (the first ``shown``, in
    order), members (methods of a class in its file, joined by a blank).
    """
    low = query.lower()
    s = symbols.where(F.lower("name").contains(low)).select("sym_id", "repo_id", "path", "name", "type", "line", F.greatest(F.coalesce(F.size("params"), F.lit(0)), F.lit(0)).alias("params")).distinct()
    asked = s.select("repo_id", F.col("name").alias("dst")).distinct()
    called = edges.join(asked, ["repo_id", "dst"], "left_semi")
    counts = called.groupBy("repo_id", F.col("dst").alias("name")).agg(F.count("*").alias("callers"))
    first = called.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "dst").orderBy("src"))).where(F.col("_i") <= shown)
    first = first.groupBy("repo_id", F.col("dst").alias("name")).agg(F.array_sort(F.collect_list("src")).alias("called_by"))
    methods = symbols.where("type = 'method' and class_name <> '' and name <> ''").select("repo_id", "path", F.col("class_name").alias("name"), F.col("name").alias("m")).distinct()
    methods = methods.groupBy("repo_id", "path", "name").agg(F.array_join(F.array_sort(F.collect_list("m")), " ").alias("members")).withColumn("type", F.lit("class"))
    out = s.join(counts, ["repo_id", "name"], "left").join(first, ["repo_id", "name"], "left").join(methods, ["repo_id", "path", "name", "type"], "left")
    none = F.array().cast("array<string>")
    return out.select("sym_id", "repo_id", "path", "name", "type", "line", "params", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("called_by", none).alias("called_by"), F.coalesce("members", F.lit("")).alias("members"))


def first_matching_file(symbols: DataFrame, part: str) -> DataFrame:
    """The symbols of each repository's first file (by path) with ``part`` in its path: repo_id, path, sym_id, name, type, line."""
    s = symbols.where(F.col("path").contains(part)).select("repo_id", "path", "sym_id", "name", "type", "line").distinct()
    first = s.groupBy("repo_id").agg(F.min("path").alias("path"))
    return s.join(first, ["repo_id", "path"], "left_semi").select("repo_id", "path", "sym_id", "name", "type", "line")


def matching_starts(edges: DataFrame, part: str, k: int = 3) -> DataFrame:
    """The first ``k`` calling names (in order) of each repository with ``part`` in them: repo_id, name; where a trace starts."""
    names = edges.where(F.lower("src").contains(part.lower())).select("repo_id", F.col("src").alias("name")).distinct()
    return names.withColumn("_i", F.row_number().over(W.partitionBy("repo_id").orderBy("name"))).where(F.col("_i") <= k).drop("_i")


def across_repositories(symbols: DataFrame, query: str, k: int = 20) -> DataFrame:
    """The first ``k`` symbols over all repositories with ``query`` in their name, by repository, path and ordinal."""
    s = symbols.where(F.lower("name").contains(query.lower())).select("sym_id", "repo_id", "path", "ordinal", "name", "type").distinct()
    return s.orderBy("repo_id", "path", "ordinal", "sym_id").limit(k)


def search_payload(symbols: DataFrame, k: int = 600, doc: int = 60, params: int = 3) -> DataFrame:
    """What a page of each repository searches in: its first ``k`` symbols with the start of their doc and their first parameters."""
    s = symbols.where("name is not null").select("sym_id", "repo_id", "path", "ordinal", "name", "type", F.left(F.coalesce("doc", F.lit("")), F.lit(doc)).alias("doc"), F.array_join(F.slice(F.coalesce("params", F.array().cast("array<string>")), 1, params), " ").alias("params")).distinct()
    ranked = s.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("path", "ordinal", "sym_id")))
    return ranked.where(F.col("rank") <= k).select("repo_id", "rank", "sym_id", "path", "name", "type", "doc", "params")


def faceted(symbols: DataFrame, text: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols of a type, with ``text`` in their name or path: repo_id, path, sym_id, name, type; both tests are optional."""
    s = symbols.select("repo_id", "path", "sym_id", "name", "type").distinct()
    if kind is not None:
        s = s.where(F.col("type") == kind)
    return s if text is None else s.where(F.lower("name").contains(text.lower()) | F.lower("path").contains(text.lower()))


def api_docs(symbols: DataFrame, signatures: DataFrame) -> DataFrame:
    """The modules of an API reference: repo_id, path, classes, functions (numbers), documented, percent (one place).

    Functions are functions and methods. A symbol is documented by its own doc or else by what stands at its declaration.
    """
    s = symbols.where("type in ('class', 'function', 'method') and path is not null").select("sym_id", "repo_id", "path", "name", "type", "line", (F.coalesce(F.trim("doc"), F.lit("")) != "").alias("own")).distinct()
    told = signatures.where("doc is not null").select("repo_id", "path", "name", "line", F.lit(True).alias("told")).distinct()
    s = s.join(told, ["repo_id", "path", "name", "line"], "left").withColumn("known", F.col("own") | F.coalesce("told", F.lit(False)))
    n = s.groupBy("repo_id", "path").agg(F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type") != "class").alias("functions"), F.count_if("known").alias("documented"), F.count("*").alias("_n"))
    return n.withColumn("percent", F.round(F.col("documented") * 100.0 / F.col("_n"), 1)).drop("_n")


def largest_modules(symbols: DataFrame, k: int = 15, least: int = 2) -> DataFrame:
    """The ``k`` folders (top path segment) of each repository with most symbols: repo_id, rank, module, symbols, files; those under ``least`` symbols are passed over."""
    s = symbols.where("path <> ''").select("sym_id", "repo_id", clean_path(F.col("path")).alias("path")).distinct()
    n = s.groupBy("repo_id", F.element_at(F.split("path", "/"), 1).alias("module")).agg(F.count("*").alias("symbols"), F.count_distinct("path").alias("files")).where(F.col("symbols") >= least)
    return n.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("symbols"), "module"))).where(F.col("rank") <= k).select("repo_id", "rank", "module", "symbols", "files")


def snippet_lines(windows: DataFrame, files: DataFrame) -> DataFrame:
    """The text of line ranges (repo_id, path, name, first_line, last_line, 1-based, both included): with ``snippet``.

    A range past the end of the file is cut there. A file's text is split once for all its ranges.
    """
    f = files.where("content <> '' and path is not null").groupBy("repo_id", "path").agg(F.min("content").alias("content"))
    by_file = windows.groupBy("repo_id", "path").agg(F.collect_list(F.struct("name", "first_line", "last_line")).alias("w"))
    j = f.join(by_file, ["repo_id", "path"]).withColumn("all", lines(F.col("content"))).drop("content")
    cut = F.expr("transform(filter(w, x -> x.first_line <= size(all)), x -> struct(x.name, x.first_line, x.last_line, array_join(slice(all, x.first_line, least(x.last_line, size(all)) - x.first_line + 1), '\n') as snippet))")
    return j.select("repo_id", "path", F.explode(cut).alias("x")).select("repo_id", "path", "x.*")


def bodies_to_next(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """The stretch of its file that stands for each symbol: sym_id, repo_id, path, body.

    From two lines above the symbol's line to the line before the next symbol of the file (lines of the same symbol's deliveries
    are one), to the end of the file for the last. Symbols without a line, and files without a text, give none.
    """
    s = symbols.where("line >= 1 and path is not null").select("sym_id", "repo_id", "path", "line").distinct()
    following = F.min("line").over(W.partitionBy("repo_id", "path").orderBy("line").rangeBetween(1, W.unboundedFollowing))
    windows = s.withColumn("next", following).select("repo_id", "path", F.col("sym_id").alias("name"), F.greatest(F.col("line") - 2, F.lit(1)).alias("first_line"), F.coalesce(F.col("next") - 1, F.lit((1 << 31) - 1)).alias("last_line"))
    return snippet_lines(windows, files).select(F.col("name").alias("sym_id"), "repo_id", "path", F.col("snippet").alias("body"))


def bodies_by_layout(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Where the body of each symbol ends by the layout of its file: sym_id, repo_id, path, line, last_line.

    By indentation in Python, by brackets elsewhere; strings and comments don't count. A file is read once for all its symbols;
    symbols without a line, or past the end of the file, and files without a text, give none.
    """
    s = symbols.where("line >= 1 and path is not null").select("sym_id", "repo_id", "path", "line").distinct()
    f = files.where("content <> '' and path is not null").groupBy("repo_id", "path").agg(F.min("content").alias("content"))
    by_file = s.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(F.struct("line", "sym_id"))).alias("s"))
    j = f.join(by_file, ["repo_id", "path"]).withColumn("ends", body_ends("content", "path", F.col("s.line"))).drop("content")
    each = j.select("repo_id", "path", F.explode(F.arrays_zip("s", "ends")).alias("x"))
    return each.select("x.s.sym_id", "repo_id", "path", "x.s.line", F.col("x.ends").alias("last_line")).where("last_line is not null")


def top_caller_savings(edges: DataFrame, symbols: DataFrame, files: DataFrame, k: int = 3) -> DataFrame:
    """What a look at each repository's ``k`` busiest callers costs beside all its files: repo_id, rank, name, callees, context_tokens, saved_percent.

    The context of a name is the names and docs of its symbols and the names it calls, a quarter of a token to a character.
    """
    raw = files.where("path is not null").groupBy("repo_id", "path").agg(F.max(F.coalesce(F.length("content"), F.lit(0))).alias("n")).groupBy("repo_id").agg(F.sum(F.floor(F.col("n") / 4)).alias("raw"))
    calls = edges.groupBy("repo_id", F.col("src").alias("name")).agg(F.count("*").alias("callees"), F.sum(F.length("dst")).alias("chars"))
    top = calls.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("callees"), "name"))).where(F.col("rank") <= k)
    own = symbols.where("name <> ''").select("sym_id", "repo_id", "name", F.length(F.coalesce("doc", F.lit(""))).alias("d")).distinct().groupBy("repo_id", "name").agg(F.sum(F.col("d") + F.length("name")).alias("own"))
    out = top.join(own, ["repo_id", "name"], "left").join(raw, "repo_id")
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") + F.coalesce("own", F.lit(0))) / 4))
    return out.withColumn("context_tokens", tokens).where("raw > 0").select("repo_id", "rank", "name", "callees", "context_tokens", F.round((F.col("raw") - F.col("context_tokens")) * 100.0 / F.col("raw"), 1).alias("saved_percent"))


def usage_totals(records: DataFrame) -> DataFrame:
    """Totals of usage records (provider, model, prompt_tokens, completion_tokens, total_tokens, cached, cost_estimate): one row."""
    return records.agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.count_if("cached").alias("cached_pages"), F.count_if(~F.coalesce("cached", F.lit(False))).alias("generated_pages"), F.count("*").alias("total_pages"), F.round(F.sum("cost_estimate"), 6).alias("cost_estimate"),
        F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.collect_set("model")).alias("models"),
    )


def merged_workspace(tables: dict[str, DataFrame], aliases: DataFrame) -> dict[str, DataFrame]:
    """The tables of several repositories as one index: paths get ``alias/`` before them, names ``alias:``.

    ``aliases`` has repo_id and alias (a row for each repository of the workspace); repositories without one are left out.
    Of ``symbols``, ``files``, ``calls`` and ``file_deps`` those given are returned.
    """
    paths = {"symbols": ["path"], "files": ["path"], "calls": ["path"], "file_deps": ["src_path", "dst_path"]}
    names = {"calls": ["src", "dst"]}
    out = {}
    for table, df in tables.items():
        df = df.join(aliases.select("repo_id", F.col("alias").alias("_alias")).distinct(), "repo_id")
        for column in paths.get(table, []):
            if column in df.columns:
                df = df.withColumn(column, F.concat("_alias", F.lit("/"), clean_path(F.col(column))))
        for column in names.get(table, []):
            df = df.withColumn(column, F.concat("_alias", F.lit(":"), column))
        out[table] = df.withColumnRenamed("_alias", "repo_alias")
    return out
