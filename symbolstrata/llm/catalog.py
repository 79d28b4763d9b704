"""Queries of this subpackage, with the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import load
from . import docpairs, handwritten, mixing, packing, spans, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return handwritten.not_handwritten(load(spark, root, "files"))


def p1_kinds(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes of text per finding; hand-written ones as such."""
    files = load(spark, root, "files")
    return handwritten.judge_files(files).groupBy(F.coalesce("kind", F.lit("handwritten")).alias("kind")).agg(F.count("*").alias("files"), F.count_distinct("repo_id").alias("repositories"))


_RECORDS = ("symbol_bodies", "snippets")


def _records(spark: SparkSession, root: str) -> DataFrame:
    bodies, snippets = load(spark, root, "symbol_bodies"), load(spark, root, "snippets")
    return bodies.select(F.lit(0).alias("kind"), F.col("sym_id").alias("id"), F.xxhash64("repo_id", "path").alias("file"), F.col("body").alias("text")).unionByName(
        snippets.select(F.lit(1).alias("kind"), F.col("snippet_id").alias("id"), F.xxhash64("repo_id", "file_path").alias("file"), F.col("content").alias("text"))
    )


def _table_name():
    return F.when(F.col("kind") == 0, _RECORDS[0]).otherwise(_RECORDS[1]).alias("record_table")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.linked_pairs(spans.shared_spans(_records(spark, root))).select(_table_name(), "id_a", "id_b")


def p2_shared_chars(spark: SparkSession, root: str) -> DataFrame:
    """For each record with any: how many of its characters other files have too, in spans of 200 or more."""
    return spans.shared_characters(spans.shared_spans(_records(spark, root))).select(_table_name(), "id", "shared_chars", "shared_stretches")


def p2_remaining(spark: SparkSession, root: str) -> DataFrame:
    """What is left of the records that share spans once these are taken out."""
    records = _records(spark, root)
    left = spans.without_shared(records, spans.shared_spans(records))
    return left.select(_table_name(), "id", F.length("text").alias("remaining_chars"), F.col("removed").alias("removed_chars"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.described_symbols(load(spark, root, "symbols"), load(spark, root, "symbol_bodies"), load(spark, root, "files"))


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.code_description_pairs(load(spark, root, "symbols"), load(spark, root, "symbol_bodies"), load(spark, root, "files"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.containers(load(spark, root, "documents"), load(spark, root, "token_budgets"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(packing.containers(load(spark, root, "documents"), load(spark, root, "token_budgets")))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(load(spark, root, "documents"), load(spark, root, "mix_targets"))[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(load(spark, root, "documents"), load(spark, root, "mix_targets"))[1]


def p7_shares_all(spark: SparkSession, root: str) -> DataFrame:
    """The shares of a mix as large as all documents of listed sources: short ones are used up to their cap."""
    return mixing.mix(load(spark, root, "documents"), load(spark, root, "mix_targets"), "all")[1]


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.cut_documents(load(spark, root, "documents")).select("doc_id")


def p8_sources(spark: SparkSession, root: str) -> DataFrame:
    return truncation.cut_share_by_source(load(spark, root, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_shared_chars, p2_remaining, p3_found, p3_pairs, p6_containers, p6_fill, p7_mix, p7_shares, p7_shares_all, p8_found, p8_sources)}


_GRAMS = """r AS (SELECT DISTINCT 'symbol_bodies' AS t, sym_id AS id, repo_id, path, body AS x FROM symbol_bodies WHERE length(body) >= 200 UNION ALL SELECT DISTINCT 'snippets', snippet_id, repo_id, file_path, content FROM snippets WHERE length(content) >= 200),
  g AS (SELECT t, id, repo_id, path, i, substr(x, i, 200) AS s FROM (SELECT *, unnest(range(1, length(x) - 198)) AS i FROM r)), many AS (SELECT t, s FROM g GROUP BY 1, 2 HAVING count(DISTINCT (repo_id, path)) > 1),
  m AS (SELECT DISTINCT g.* FROM g JOIN many ON many.t = g.t AND many.s = g.s)"""


def oracle_sql() -> dict[str, str]:
    """Shared spans by all their 200-grams; fingerprints, parsing, packing, rounding and cut texts are tested by brute force in tests/llm."""
    return {
        "p2_found": f"WITH {_GRAMS} SELECT DISTINCT a.t AS record_table, a.id AS id_a, b.id AS id_b FROM m a JOIN m b ON a.t = b.t AND a.s = b.s AND a.id < b.id AND (a.repo_id, a.path) IS DISTINCT FROM (b.repo_id, b.path)",
        "p2_shared_chars": f"""WITH {_GRAMS}, p AS (SELECT DISTINCT t, id, i FROM m), o AS (SELECT *, i - lag(i) OVER (PARTITION BY t, id ORDER BY i) AS gap FROM p)
          SELECT t AS record_table, id, sum(coalesce(least(200, gap), 200)) AS shared_chars, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) AS shared_stretches FROM o GROUP BY 1, 2""",
        "p2_remaining": f"""WITH {_GRAMS}, p AS (SELECT DISTINCT t, id, i FROM m), o AS (SELECT *, i - lag(i) OVER (PARTITION BY t, id ORDER BY i) AS gap FROM p), c AS (SELECT t, id, sum(coalesce(least(200, gap), 200)) AS n FROM o GROUP BY 1, 2)
          SELECT DISTINCT c.t AS record_table, c.id, length(r.x) - n AS remaining_chars, n AS removed_chars FROM c JOIN r ON r.t = c.t AND r.id = c.id""",
    }
