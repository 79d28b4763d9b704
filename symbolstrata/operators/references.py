"""References to records that do not exist (problem 4).

Method: references and the validity intervals of their targets are co-partitioned by key and sorted by time; one linear
pass over the merged streams (a window with running sums) counts the targets alive at each reference. Keys with more
references than one task should get are split by a salt, with their distinct intervals copied to each part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage, small_side
from ..tables import clean_path, extension, one_per_key

#: A key with more references than this is split into parts of about this size.
HOT_ROWS = 250_000


def _named(column: str):
    return F.element_at(F.split(F.col(column), r"\."), -1)


def references(symbols: DataFrame, calls: DataFrame, file_deps: DataFrame) -> DataFrame:
    """All references: table_name, row_id, repo_id, space (n: name, p: path), key, ref, ext, t (first arrival), indexed_at.

    Repeated deliveries count once, at their first arrival. Null and empty references are left out.
    """
    s = one_per_key(symbols.where("size(calls) > 0"), ["sym_id"], ["repo_id", "path", "calls", "indexed_at"])
    s = s.select(F.lit("symbols").alias("table_name"), F.col("sym_id").alias("row_id"), "repo_id", F.lit("n").alias("space"), "path", "indexed_at", "loaded_at", F.explode(F.array_distinct("calls")).alias("ref"))
    c = one_per_key(calls.where("dst <> ''"), ["call_id"], ["repo_id", "path", "dst", "indexed_at"])
    c = c.select(F.lit("calls").alias("table_name"), F.col("call_id").alias("row_id"), "repo_id", F.lit("n").alias("space"), "path", "indexed_at", "loaded_at", F.col("dst").alias("ref"))
    d = one_per_key(file_deps.where("dst_path <> ''"), ["dep_id"], ["repo_id", "src_path", "dst_path", "indexed_at"])
    d = d.select(F.lit("file_deps").alias("table_name"), F.col("dep_id").alias("row_id"), "repo_id", F.lit("p").alias("space"), F.col("src_path").alias("path"), "indexed_at", "loaded_at", F.col("dst_path").alias("ref"))
    return s.unionByName(c).unionByName(d).where("ref <> ''").select(
        "table_name", "row_id", "repo_id", "space",
        F.when(F.col("space") == "n", _named("ref")).otherwise(clean_path(F.col("ref"))).alias("key"),
        "ref", extension(F.col("path")).alias("ext"), F.col("loaded_at").alias("t"), "indexed_at",
    )


def target_intervals(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct validity intervals [born, gone) of every target key: repo_id, space, key, born, gone."""
    life = [F.min("loaded_at").alias("born"), F.max("removed_at").alias("gone")]
    s = symbols.where("name is not null").groupBy("sym_id", "repo_id", "name").agg(*life).select("repo_id", F.lit("n").alias("space"), F.col("name").alias("key"), "born", "gone")
    f = files.where("path is not null").groupBy("repo_id", "path").agg(*life).select("repo_id", F.lit("p").alias("space"), clean_path(F.col("path")).alias("key"), "born", "gone")
    return s.unionByName(f).where("born is not null and (gone is null or gone > born)").distinct()


def _hot_keys(symbols: DataFrame, calls: DataFrame, file_deps: DataFrame, hot_rows: int) -> DataFrame:
    """Keys with more than ``hot_rows`` references as delivered and their number of parts: at most all rows / hot_rows rows."""
    names = calls.select("repo_id", F.lit("n").alias("space"), _named("dst").alias("key")).unionByName(
        symbols.select("repo_id", F.lit("n").alias("space"), F.explode("calls").alias("dst")).select("repo_id", "space", _named("dst").alias("key"))
    )
    paths = file_deps.select("repo_id", F.lit("p").alias("space"), clean_path(F.col("dst_path")).alias("key"))
    return names.unionByName(paths).groupBy("repo_id", "space", "key").count().where(F.col("count") > hot_rows).select(
        "repo_id", "space", "key", F.ceil(F.col("count") / hot_rows).cast("int").alias("parts"))


def classify_references(symbols: DataFrame, calls: DataFrame, file_deps: DataFrame, files: DataFrame, builtin_names: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each reference with its state at the moment its row first arrived.

    Columns: table_name, row_id, ref, indexed_at, state. state is ``present``, ``deleted`` (a target existed before and
    none does now), ``late`` (the first target arrives later) or ``missing`` (never a target). Names that a language
    always has (``builtin_names`` by extension) are present. Rows with a null repository match nothing: missing.
    Nulls in other columns do no harm; empty inputs give an empty result or only missing references.
    """
    refs = references(symbols, calls, file_deps)
    builtin = builtin_names.where("ext is not null and name is not null").select(F.lit("n").alias("space"), "ext", F.col("name").alias("key")).distinct().withColumn("builtin", F.lit(True))
    refs = refs.join(small_side(builtin, BROADCAST_ROWS), ["space", "ext", "key"], "left")  # a fixed table of 43 rows
    hot = small_side(cut_lineage(_hot_keys(symbols, calls, file_deps, hot_rows)), BROADCAST_ROWS)
    keys = ["repo_id", "space", "key"]
    refs = refs.join(hot, keys, "left").select(*keys, F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("parts")), F.lit(0)).cast("int").alias("part"), "t", F.lit(1).alias("turn"), F.lit(0).alias("change"), F.lit(0).alias("start"), "table_name", "row_id", "ref", "indexed_at", "builtin")
    targets = target_intervals(symbols, files).join(hot, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    nothing = [F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in ("table_name", "row_id", "ref", "indexed_at", "builtin")]
    births = targets.select(*keys, "part", F.col("born").alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("change"), F.lit(1).alias("start"), *nothing)
    deaths = targets.where("gone is not null").select(*keys, "part", F.col("gone").alias("t"), F.lit(0).alias("turn"), F.lit(-1).alias("change"), F.lit(0).alias("start"), *nothing)
    group = W.partitionBy(*keys, "part")
    so_far = group.orderBy("t", "turn").rowsBetween(W.unboundedPreceding, 0)
    merged = refs.unionByName(births).unionByName(deaths)
    merged = merged.withColumn("alive", F.sum("change").over(so_far)).withColumn("born_before", F.sum("start").over(so_far))
    merged = merged.withColumn("born_ever", F.sum("start").over(group))
    state = (
        F.when(F.col("builtin") | ((F.col("alive") > 0) & F.col("repo_id").isNotNull()), "present")
        .when((F.col("born_before") > 0) & F.col("repo_id").isNotNull(), "deleted")
        .when((F.col("born_ever") > 0) & F.col("repo_id").isNotNull(), "late")
        .otherwise("missing")
    )
    return merged.where("turn = 1").select("table_name", "row_id", "ref", "indexed_at", state.alias("state"), "builtin", "alive", "repo_id")


def orphan_references(symbols: DataFrame, calls: DataFrame, file_deps: DataFrame, files: DataFrame, builtin_names: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """References without a target when their row first arrived: table_name, row_id, ref; distinct rows."""
    out = classify_references(symbols, calls, file_deps, files, builtin_names, hot_rows)
    # the same test as state <> 'present', without the look ahead that only tells late from missing
    out = out.where("builtin is null and (alive <= 0 or repo_id is null)")
    return out.select("table_name", "row_id", "ref")


def orphans_by_month(symbols: DataFrame, calls: DataFrame, file_deps: DataFrame, files: DataFrame, builtin_names: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Orphans per table, calendar month of ``indexed_at`` (yyyy-MM, null if unknown) and state, with their number."""
    out = classify_references(symbols, calls, file_deps, files, builtin_names, hot_rows).where("state <> 'present'")
    return out.groupBy("table_name", F.date_format("indexed_at", "yyyy-MM").alias("month"), "state").agg(F.count("*").alias("orphans"))
