"""Mixing sources to target weights (problem 7).

Method: pivotal dependent rounding. Each document of a source is to be used x times on average; its whole part is sure,
the fraction is rounded by pairing documents and moving token mass at random from one to the other until one of the two
is whole, which keeps the source's sum of tokens and each document's expectation. Blocks of documents are reduced in
parallel, each leaving at most one fraction; those meet in the next level of a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage, small_side
from .sizes import VOCABULARY, with_tokens
from .truncation import source_name

#: Documents that meet in one group of a level of the tree.
FAN = 10_000


def pivotal(shares: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Shares in [0, 1] rounded to 0 and 1 but for at most one; the sum of shares times sizes stays as it is."""
    out = shares.astype(float).copy()
    open_one = -1
    for i in range(len(out)):
        if not 1e-9 < out[i] < 1 - 1e-9:
            out[i] = round(out[i])
            continue
        if open_one < 0:
            open_one = i
            continue
        a, b = open_one, i
        # mass that can go from b to a, and from a to b
        gain = min((1 - out[a]) * sizes[a], out[b] * sizes[b])
        loss = min(out[a] * sizes[a], (1 - out[b]) * sizes[b])
        move = gain if rng.random() * (gain + loss) < loss else -loss
        out[a] += move / sizes[a]
        out[b] -= move / sizes[b]
        left = [k for k in (a, b) if 1e-9 < out[k] < 1 - 1e-9]
        for k in (a, b):
            if k not in left:
                out[k] = round(out[k])
        open_one = left[0] if left else -1
    return out


def _level(seed: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "tokens"], kind="stable")
        key = int(pd.util.hash_array(np.array([str(group["source"].iloc[0])], dtype=object))[0])
        rng = np.random.default_rng([seed, key % (1 << 32), int(group["node"].iloc[0]), int(group["doc_id"].iloc[0]) & 0xFFFFFFFF])
        share = pivotal(group["share"].to_numpy(), group["tokens"].to_numpy(dtype=float), rng)
        if last:
            share = np.where(rng.random(len(share)) < share, 1.0, 0.0) if len(share) else share
        return group.assign(share=share)

    return run


def targets_and_supply(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target_share, max_repeats, its documents and tokens (0 if it has none)."""
    t = targets.where("target_share > 0 and max_repeats > 0").groupBy(source_name().alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("source is not null")
    # only listed sources are counted: a row at most for each row of the targets
    supply = sized.join(small_side(t.select("source"), BROADCAST_ROWS), "source", "left_semi").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    return t.join(supply, "source", "left").fillna(0, ["documents", "tokens", "longest"])


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, vocabulary: str = VOCABULARY, seed: int = 7, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each document is used, and the shares reached beside the targets.

    copies has doc_id, source, tokens, copies (1 .. max_repeats). report has a row for each listed source: source,
    target_share, max_repeats, documents, tokens, goal_tokens (the share of ``total_tokens``), mixed_documents,
    mixed_tokens, actual_share (of all mixed tokens), most_copies, met (whether actual_share is the target, but for the
    length of one document). A source that is short or missing makes the shares of the others larger, so those aren't met either. ``total_tokens`` is the size of the mix; by default the largest
    with which every listed source that has documents reaches its share, ``"all"`` is the tokens of all documents of
    listed sources. A larger one uses short sources up to their cap and reports the shares that this leaves. Texts without a listed source and blank ones are not used. Sources
    are told apart without case and blanks. Empty tables give an empty mix.
    """
    own = documents.select("doc_id", source_name().alias("source"), "text")
    sized = cut_lineage(with_tokens(own, ["doc_id", "source"], vocabulary).where("tokens > 0 and source is not null"))
    plan = cut_lineage(targets_and_supply(sized, targets))
    if total_tokens is None:
        total_tokens = plan.where("tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).first()[0] or 0
    elif total_tokens == "all":
        total_tokens = plan.agg(F.sum("tokens")).first()[0] or 0
    goal = F.least(F.col("target_share") * F.lit(float(total_tokens)), (F.col("max_repeats") * F.col("tokens")).cast("double"))
    plan = plan.withColumn("goal", goal)
    rates = plan.where("tokens > 0").select("source", (F.col("goal") / F.col("tokens")).alias("rate"))
    each = sized.join(small_side(rates, BROADCAST_ROWS), "source")  # a row for each listed source
    each = each.withColumn("sure", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("share", F.greatest(F.col("rate") - F.col("sure"), F.lit(0.0)))
    count = max(1, sized.count())
    level = each.where("share > 1e-9").select("doc_id", "source", "tokens", "share")
    whole = None
    shape = "doc_id long, source string, tokens long, share double, node long"
    nodes = -(-count // fan)
    while True:  # a level for each power of fan: two for 10^8 documents
        level = level.withColumn("node", F.pmod(F.xxhash64("doc_id", "tokens", F.lit(nodes)), F.lit(nodes)))
        done = cut_lineage(level.groupBy("source", "node").applyInPandas(_level(seed, nodes == 1), shape))
        chosen = done.where("share > 0.999999").select("doc_id", "source", "tokens")
        whole = chosen if whole is None else whole.unionByName(chosen)
        if nodes == 1:
            break
        level = done.where("share > 1e-9 and share < 0.999999").select("doc_id", "source", "tokens", "share")
        nodes = -(-nodes // fan)
    sure = each.where("sure > 0").select("doc_id", "source", "tokens", F.col("sure").alias("copies"))
    copies = sure.unionByName(whole.withColumn("copies", F.lit(1))).groupBy("doc_id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    used = copies.groupBy("source").agg(F.count("*").alias("mixed_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    report = plan.join(used, "source", "left").fillna(0, ["mixed_documents", "mixed_tokens", "most_copies"])
    report = report.withColumn("all", F.sum("mixed_tokens").over(W.partitionBy()))  # a row for each listed source
    share = F.col("mixed_tokens") / F.col("all")
    met = (F.col("mixed_tokens") > 0) & (F.abs(share - F.col("target_share")) <= F.col("longest") / F.col("all"))
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.round(F.col("target_share") * F.lit(float(total_tokens))).cast("long").alias("goal_tokens"), "mixed_documents", "mixed_tokens", F.round(share, 6).alias("actual_share"), "most_copies", F.coalesce(met, F.lit(False)).alias("met")
    )
    return copies, report
