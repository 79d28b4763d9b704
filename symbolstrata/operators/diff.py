"""Differences between snapshots and between revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import clean_path


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """repo_id, path, change (added, removed, modified, same) between two snapshots with sha256.

    One row per path of either; a null hash differs from any other and equals itself. Repeated rows count once.
    """
    side = lambda df, name: df.where("path is not null").groupBy("repo_id", "path").agg(F.max("sha256").alias(name), F.lit(True).alias(f"in_{name}"))
    both = side(old, "old").join(side(new, "new"), ["repo_id", "path"], "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("modified")
    return both.select("repo_id", "path", change.alias("change"))


def to_index(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that an incremental run reads again: added and modified ones."""
    return file_changes(old, new).where("change in ('added', 'modified')").select("repo_id", "path")


def merge_snapshots(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of an old table for unchanged paths, with the fresh rows for changed ones; removed paths go."""
    kept = old.join(changes.where("change = 'same'").select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    return kept.unionByName(fresh, allowMissingColumns=True)


def insert_if_absent(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``extra`` whose keys it doesn't have."""
    return base.unionByName(extra.join(base.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """Ranges of changed lines from unified diffs (repo_id, diff): repo_id, path, start, end (one past the last); distinct.

    Each diff is folded where its row stands, so diffs of one repository don't mix. Deleted files (``/dev/null``) give none.
    """
    head = r"^@@ -\\d+(?:,\\d+)? \\+(\\d+)(?:,(\\d+))? @@"
    folded = F.expr(f"""
        aggregate(filter(split(diff, '\\r?\\n'), x -> x rlike '^([+][+][+] |@@ )'),
          named_struct('path', cast(null as string), 'out', cast(array() as array<struct<path: string, start: int, count: int>>)),
          (a, x) -> if(startswith(x, '+++ '),
            named_struct('path', regexp_extract(x, '^[+][+][+] (?:b/)?([^\\t]+)', 1), 'out', a.out),
            named_struct('path', a.path, 'out', if(x rlike '{head}' and not (a.path <=> '/dev/null'),
              concat(a.out, array(named_struct('path', a.path, 'start', cast(regexp_extract(x, '{head}', 1) as int), 'count', if(regexp_extract(x, '{head}', 2) = '', 1, cast(nullif(regexp_extract(x, '{head}', 2), '') as int))))), a.out))),
          a -> a.out)""")
    return diffs.where("diff <> ''").select("repo_id", F.explode(folded).alias("h")).select("repo_id", "h.path", "h.start", (F.col("h.start") + F.col("h.count")).alias("end")).distinct()


def changed_paths(*lists: DataFrame) -> DataFrame:
    """Distinct (repo_id, path) of several lists of changed files (against a revision, staged, untracked); slashes made equal."""
    out = None
    for part in lists:
        rows = part.where("path <> ''").select("repo_id", clean_path(F.col("path")).alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def changed_symbols(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """Symbols whose line lies in a changed range of their file, both ends included: sym_id, repo_id, path, name."""
    s = symbols.where("line is not null").select("sym_id", "repo_id", clean_path(F.col("path")).alias("path"), "name", "line").distinct()
    h = hunks.where("start is not null").select("repo_id", clean_path(F.col("path")).alias("path"), "start", "end").distinct()
    return s.join(h, ["repo_id", "path"]).where("line between start and end").select("sym_id", "repo_id", "path", "name").distinct()


def affected_callers(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Names that call a changed symbol of their repository and are not changed themselves: repo_id, name, changed (number)."""
    names = changed.where("name <> ''").select("repo_id", "name").distinct()
    callers = edges.join(names.withColumnRenamed("name", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", F.col("src").alias("name"), "dst")
    return callers.join(names, ["repo_id", "name"], "left_anti").groupBy("repo_id", "name").agg(F.count_distinct("dst").alias("changed"))
