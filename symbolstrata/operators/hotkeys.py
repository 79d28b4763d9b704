"""Per-key results when a few keys hold most records (problem 5).

Method: every input split encodes its keys with a dictionary of its own and counts them with ``numpy.bincount``, so a task's
work depends only on the size of its split. The distinct keys get global dense codes (block, place); the splits' counts
are scattered into dense arrays per block, and the arrays of a block are summed in a distributed reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Keys per block, so bytes of a dense array / 8; counts scattered into one array, about; arrays summed in one group of a level.
BLOCK_KEYS, SCATTER_ROWS, FAN = 65_536, 262_144, 16


def _split_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes: dict[str, int] = {}
    totals = np.zeros(1024, dtype=np.int64)
    for batch in batches:
        local, names = pd.factorize(batch["key"].to_numpy(), use_na_sentinel=True)
        found = np.bincount(local[local >= 0], minlength=len(names))
        places = np.fromiter((codes.setdefault(n, len(codes)) for n in names), dtype=np.int64, count=len(names))
        while len(codes) > len(totals):
            totals = np.concatenate([totals, np.zeros_like(totals)])
        totals[places] += found  # names are distinct within a batch
    if codes:
        yield pd.DataFrame({"key": list(codes), "n": totals[: len(codes)]})


def _scatter(block: pd.DataFrame) -> pd.DataFrame:
    dense = np.bincount(block["place"], weights=block["n"], minlength=0).astype(np.int64)
    return pd.DataFrame({"block": [int(block["block"].iloc[0])], "fan": [int(block["fan"].iloc[0])], "totals": [dense]})


def _add(blocks: pd.DataFrame) -> pd.DataFrame:
    dense = np.zeros(max(map(len, blocks["totals"])), dtype=np.int64)
    for part in blocks["totals"]:
        dense[: len(part)] += part
    return pd.DataFrame({"block": [int(blocks["block"].iloc[0])], "fan": [int(blocks["fan"].iloc[0])], "totals": [dense]})


def dense_counts(keys: DataFrame, column: str, block_keys: int = BLOCK_KEYS, scatter_rows: int = SCATTER_ROWS, fan: int = FAN) -> DataFrame:
    """Rows per value of a string ``column``: key, n. Nulls and empty strings are not counted; empty input, empty result.

    The counts are exact. A key that fills a third of all rows costs each split one more entry, nothing else. The more
    splits there are, the more arrays a block starts with, so a group scatters about ``scatter_rows`` counts at every
    size; each level of the tree sums groups of ``fan`` arrays until one is left.
    """
    part = keys.select(F.col(column).cast("string").alias("key")).where("key <> ''").mapInPandas(_split_counts, "key string, n long")
    part = cut_lineage(part.withColumn("split", F.spark_partition_id()))
    # codes: the block by hash, the place by order within it; about block_keys keys fall to a block
    distinct, rows = part.agg(F.approx_count_distinct("key"), F.count("*")).first()
    blocks = max(1, -(-int(distinct) // block_keys))
    arrays = max(1, -(-int(rows) // (blocks * scatter_rows)))
    coded = part.groupBy("key").agg(F.lit(1).alias("one")).select("key", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    coded = coded.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("key")) - 1)
    shape = "block int, fan int, totals array<long>"
    placed = part.withColumn("fan", F.pmod("split", F.lit(arrays))).join(coded, "key").select("block", "fan", "place", "n")
    dense = placed.groupBy("block", "fan").applyInPandas(_scatter, shape)
    while arrays > 1:
        arrays = -(-arrays // fan)
        dense = dense.withColumn("fan", F.pmod("fan", F.lit(arrays))).groupBy("block", "fan").applyInPandas(_add, shape)
    counts = dense.select("block", F.posexplode("totals").alias("place", "n"))
    return coded.join(counts, ["block", "place"]).select("key", "n")


def frequent_keys(tables: dict[str, tuple[DataFrame, str]], share: float = 0.02) -> DataFrame:
    """Keys holding at least ``share`` of all rows as delivered of their table: table_name, key_value."""
    out = None
    for name, (df, column) in tables.items():
        total = df.count()
        found = dense_counts(df, column).where(F.col("n") >= share * total).select(F.lit(name).alias("table_name"), F.col("key").alias("key_value"))
        out = found if out is None else out.unionByName(found)
    return out


def key_profile(df: DataFrame, column: str, distinct: dict[str, list[str]]) -> DataFrame:
    """Per key: its rows and, for each entry of ``distinct``, the number of distinct values of those columns with it.

    Pairs are made distinct first (a shuffle by the pair, so no key's pairs meet in one task), then counted as the rows
    are. Nulls inside the counted columns make a value of their own. Every key of the input is in the result.
    """
    out = dense_counts(df, column).withColumnRenamed("n", "rows")
    for name, columns in distinct.items():
        pairs = df.where(F.col(column) != "").select(column, *columns).distinct()
        out = out.join(dense_counts(pairs, column).withColumnRenamed("n", name), "key")
    return out.withColumnRenamed("key", "name")
