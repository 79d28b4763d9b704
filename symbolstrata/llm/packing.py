"""Filling fixed-capacity containers with items (problem 6).

Method: cost-balanced packing. A document's cost is linear plus quadratic in its length (attention); documents, longest
first, go to the sequence of least cost that still has room. Blocks of documents are packed independently, each with as
few sequences as its tokens need, more only when a document fits nowhere; the sequences left emptiest are then dissolved
into the others where their documents fit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .sizes import VOCABULARY, with_tokens

#: Sequences that couldn't be emptied after which no more are tried; it costs fill, never an item.
MISSES = 20
#: Documents per block (a task packs one block at a time) and the cost's two weights.
BLOCK_DOCUMENTS, LINEAR, QUADRATIC = 4_000, 1.0, 1.0 / 2048

ASSIGNED = "budget_name string, capacity_tokens int, container_id string, doc_id long, piece int, token_start long, piece_tokens long"


def pack(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence number for each size (all between 1 and ``capacity``); deterministic, ties by position."""
    order = np.argsort(-sizes, kind="stable")
    where = np.full(len(sizes), -1, dtype=np.int64)
    count = max(1, -(-int(sizes.sum()) // capacity))
    room = np.full(max(2 * count, 8), capacity, dtype=np.int64)
    cost = np.zeros(len(room))
    room[count:] = -1
    for i in order:
        size = int(sizes[i])
        fits = np.flatnonzero(room[:count] >= size)
        if len(fits):
            j = int(fits[np.argmin(cost[fits])])
        else:
            if count == len(room):
                room = np.concatenate([room, np.full(len(room), -1, dtype=np.int64)])
                cost = np.concatenate([cost, np.zeros(len(cost))])
            j, count = count, count + 1
            room[j] = capacity
        room[j] -= size
        cost[j] += linear * size + quadratic * size * size
        where[i] = j
    _dissolve(sizes, where, room[:count], capacity)
    return np.unique(where, return_inverse=True)[1]


def _dissolve(sizes: np.ndarray, where: np.ndarray, room: np.ndarray, capacity: int) -> None:
    """Empty the sequences with most room whose items all fit tightly elsewhere."""
    held: dict[int, list[int]] = {}
    for i, j in enumerate(where.tolist()):
        held.setdefault(j, []).append(i)
    misses = 0
    for j in sorted(held, key=lambda j: (-room[j], j)):
        if misses >= MISSES or capacity - room[j] > int(room.sum() - room[j]):
            break
        trial, moves = room.copy(), []
        trial[j] = -1
        for i in sorted(held[j], key=lambda i: (-sizes[i], i)):
            fits = np.flatnonzero(trial >= sizes[i])
            if not len(fits):
                moves = None
                break
            k = int(fits[np.argmin(trial[fits])])
            trial[k] -= sizes[i]
            moves.append((i, k))
        if moves is None:
            misses += 1
            continue
        room[:] = trial
        for i, k in moves:
            where[i] = k
            held[k].append(i)
        held[j] = []


def _pack_block(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    capacity = int(group["capacity_tokens"].iloc[0])
    sequence = pack(group["tokens"].to_numpy(dtype=np.int64), capacity)
    name, block = group["budget_name"].iloc[0], int(group["block"].iloc[0])
    return pd.DataFrame({"budget_name": name, "capacity_tokens": capacity, "container_id": [f"{name}-{block}-{s}" for s in sequence], "doc_id": group["doc_id"], "piece": group["piece"], "token_start": group["token_start"], "piece_tokens": group["tokens"]})


def containers(documents: DataFrame, budgets: DataFrame, vocabulary: str = VOCABULARY, block_documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """Every text assigned to containers of every budget: the columns of ``ASSIGNED``.

    A text longer than the container is cut into pieces (piece 0, 1, ...; token_start, piece_tokens), all full but the
    last, and only then. No container exceeds its capacity; every token of every text with tokens is in one container of
    each budget. Null and blank texts have no tokens and are in none; repeated ids are separate texts with one id; budgets
    without a positive capacity are left out, repeated ones count once; empty tables give an empty result.
    """
    sized = cut_lineage(with_tokens(documents, ["doc_id"], vocabulary).where("tokens > 0"))
    blocks = max(1, -(-sized.count() // block_documents))
    # ids are unique; should one be repeated, its rows are told apart
    sized = sized.withColumn("copy", F.row_number().over(W.partitionBy("doc_id").orderBy("tokens")) - 1)
    sized = sized.withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(blocks)).cast("int"))
    # the container sizes are a fixed table of a few rows; each text goes to each of them
    fixed = sorted({(r[0], r[1]) for r in budgets.where("budget_name is not null and capacity_tokens > 0").select("budget_name", "capacity_tokens").distinct().collect()})
    if not fixed:
        return documents.sparkSession.createDataFrame([], ASSIGNED)
    each = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(c).cast("int").alias("capacity_tokens")) for n, c in fixed])
    both = sized.withColumn("b", F.explode(each)).select("*", "b.*").drop("b")
    pieces = both.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity_tokens as int)"))))
    pieces = pieces.withColumn("token_start", F.col("piece").cast("long") * F.col("capacity_tokens"))
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity_tokens").cast("long"), F.col("tokens") - F.col("token_start")))
    # full pieces are containers by themselves; they need no packing
    full = pieces.where("tokens = capacity_tokens").select("budget_name", "capacity_tokens", F.concat_ws("-", "budget_name", F.lit("full"), "doc_id", "copy", "piece").alias("container_id"), "doc_id", "piece", "token_start", F.col("tokens").alias("piece_tokens"))
    rest = pieces.where("tokens < capacity_tokens").groupBy("budget_name", "capacity_tokens", "block").applyInPandas(_pack_block, ASSIGNED)
    return full.unionByName(rest)


def fill_report(assigned: DataFrame) -> DataFrame:
    """Per budget: containers, the fewest that any packing could need, tokens, share of the capacity used, and the spread of the containers' costs (max / mean)."""
    each = assigned.groupBy("budget_name", "capacity_tokens", "container_id").agg(F.sum("piece_tokens").alias("used"), F.sum(LINEAR * F.col("piece_tokens") + QUADRATIC * F.col("piece_tokens") * F.col("piece_tokens")).alias("cost"))
    least = F.ceil(F.sum("used") / F.first("capacity_tokens"))  # no packing needs fewer
    return each.groupBy("budget_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), least.alias("least_containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.first("capacity_tokens")), 6).alias("fill"), F.round(F.max("cost") / F.avg("cost"), 4).alias("cost_spread")
    )
