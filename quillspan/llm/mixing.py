"""Mixing sources to target weights.

Method: a multivariate-hypergeometric splitting tree. The texts of each source lie in hash blocks; a source's quota is a
number of block draws (whole passes over its blocks, then a random part of one more pass). From the quotas of all sources
the tree splits recursively: how many draws of each source go left and how many right is a multivariate hypergeometric
draw, so that every output shard gets an exact quota of blocks, distributed as if all draws had been shuffled and dealt.
Each source's permuted draws then fill the shards' quotas in order, disjointly, and texts are shuffled within their shard.

Total. With ``total`` = WHOLE the mix is the smallest in which every text of a source with a share is used: the source with
most text for its share is passed over once, the others as often as their shares ask. With ``total`` = None it is as large
as it can be with every source exactly at its share, so the scarcest source leaves out texts of all others. With WHOLE or a
given ``total`` a source that cannot give its share gives all it may, and the report says so.

Scale. The driver holds a table of at most ``blocks`` x sources sizes and the draws made of it; texts meet their draws in
a join on (source, block), so a source with a third of all rows is spread over its blocks and no group of texts is formed
anywhere. The draws are broadcast up to ``BROADCAST_DRAWS`` rows and shuffled beyond. The number of shards follows the size
of the mix (``shard_tokens`` each, and not so many that a shard has fewer than 32 draws); the mix is written by ranges of
(shard, position), so that a shard larger than a task's share is written by several tasks.

Defined results
---------------
* Sources are compared without case and outer blanks. Texts of null or unlisted sources, and texts without tokens, are
  not used; targets without texts are reported with a share of 0, and the others keep their proportions.
* A text that a source holds under several ids is one text, of its smallest id: ``max_repeats`` counts uses of the text.
* Null or negative shares and repeats below one count as 0. A source is short of its share by less than one block.
* Equal input, parameters and seed give equal output. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.tokens import VOCABULARY, counted
from quillspan.session import cut, spread

#: A value of ``total``: no text of a source with a share is left out.
WHOLE = "whole"
#: Rows of the table of draws (four small columns) that a broadcast may have.
BROADCAST_DRAWS = 500_000


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources): draws of each source in each shard; shards differ by one draw in all at most."""
    if shards == 1:
        return quotas[None, :].copy()
    left = shards // 2
    take = int(round(quotas.sum() * left / shards))
    got = rng.multivariate_hypergeometric(quotas, take, method="marginals") if quotas.sum() else np.zeros_like(quotas)
    return np.concatenate([split_tree(got, left, rng), split_tree(quotas - got, shards - left, rng)])


def plan(
    sizes: pd.DataFrame, targets: pd.DataFrame, total: float | str | None, shards: int | None, seed: int, shard_tokens: int = 1 << 22
) -> pd.DataFrame:
    """The draws: (source, block, use, shard). ``sizes``: source, block, tokens; ``targets``: source, share, repeats."""
    rng = np.random.default_rng(seed)
    held = sizes.groupby("source")["tokens"].sum()
    t = targets[(targets["share"] > 0) & (targets["repeats"] >= 1) & targets["source"].isin(held.index)]
    t = t.sort_values("source").reset_index(drop=True)
    empty = pd.DataFrame({"source": [], "block": [], "use": [], "shard": []}).astype(
        {"source": str, "block": "int32", "use": "int32", "shard": "int32"}
    )
    if not len(t):
        return empty
    share = (t["share"] / t["share"].sum()).to_numpy()
    own = held[t["source"]].to_numpy(dtype=float)
    most = t["repeats"].to_numpy(dtype=float) * own
    if total == WHOLE:
        want = np.clip(share * np.max(own / share), own, most)  # rounding must not cost a source its last block
    else:
        size = float(np.min(most / share)) if total is None else float(total)
        want = np.minimum(share * size, most)
    draws = []
    for name, need in zip(t["source"], want, strict=True):
        own = sizes[sizes["source"] == name].sort_values("block")
        block, tokens = own["block"].to_numpy(), own["tokens"].to_numpy(dtype=float)
        passes = int(need // tokens.sum() + 1e-9)
        rest = need - passes * tokens.sum()
        order = rng.permutation(len(block))
        # the last pass takes blocks in random order while they fit
        part, room = [], rest
        for i in order:
            if tokens[i] <= room + 1e-9:
                part.append(i)
                room -= tokens[i]
        rows = [(b, u) for u in range(passes) for b in block] + [(block[i], passes) for i in part]
        draws.append([rows[i] for i in rng.permutation(len(rows))])
    quotas = np.array([len(d) for d in draws], dtype=np.int64)
    if shards is None:
        shards = max(1, min(int(want.sum() // shard_tokens) + 1, int(quotas.sum()) // 32))
    dealt = split_tree(quotas, shards, rng)
    out = []
    for s, name in enumerate(t["source"]):
        shard = np.repeat(np.arange(shards), dealt[:, s])
        out += [(name, int(b), int(u), int(k)) for (b, u), k in zip(draws[s], shard, strict=True)]
    return pd.DataFrame(out, columns=["source", "block", "use", "shard"]) if out else empty


def _named(col: str):
    name = F.lower(F.trim(F.col(col)))
    return F.when(name != "", name)


def texts(documents: DataFrame, targets: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """(source, doc_id, n_tokens): each source's different texts."""
    listed = targets.select(_named("source").alias("source")).where("source is not null").distinct()
    own = spread(documents.select("doc_id", "text", "source")).select("doc_id", "text", _named("source").alias("source")).join(
        F.broadcast(listed), "source", "left_semi"  # the targets table is fixed in size
    )
    # equal texts of a source are of one size; combined before the shuffle, which moves hashes instead of texts
    return (
        counted(own.where("text is not null and text != ''"), tokenizer)
        .where("n_tokens > 0")
        .groupBy("source", F.sha2("text", 256).alias("_h"))
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"))
        .drop("_h")
    )


def _prepared(documents, targets, tokenizer, blocks):
    held = cut(
        texts(documents, targets, tokenizer).withColumn(
            "block", F.pmod(F.xxhash64("doc_id", "source"), F.lit(blocks)).cast("int")
        )
    )
    sizes = held.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # <= blocks x sources
    aims = (
        targets.groupBy(_named("source").alias("source"))
        .agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
        .where("source is not null")
        .fillna(0)
        .toPandas()
    )
    return held, sizes, aims


def mixed(
    documents: DataFrame,
    targets: DataFrame,
    total: float | str | None = None,
    shards: int | None = None,
    blocks: int = 2048,
    seed: int = 17,
    tokenizer: str = VOCABULARY,
    shard_tokens: int = 1 << 22,
) -> DataFrame:
    """(shard, position_key, source, doc_id, use, n_tokens): the mix, its files ordered by shard and position."""
    held, sizes, aims = _prepared(documents, targets, tokenizer, blocks)
    drawn = plan(sizes, aims, total, shards, seed, shard_tokens)
    draws = documents.sparkSession.createDataFrame(drawn, "source string, block int, use int, shard int")
    return (
        held.join(F.broadcast(draws) if len(drawn) <= BROADCAST_DRAWS else draws, ["source", "block"])
        .withColumn("position_key", F.xxhash64(F.lit(seed), "source", "doc_id", "use"))
        .select("shard", "position_key", "source", "doc_id", "use", "n_tokens")
        .repartitionByRange("shard", "position_key")
        .sortWithinPartitions("shard", "position_key")
    )


def report(documents: DataFrame, targets: DataFrame, mix: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """Per target: tokens held and used, the share reached beside the target, and the most uses of a text."""
    used = mix.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("uses"), F.sum("n_tokens").alias("t"))
    per = used.groupBy("source").agg(
        F.sum("t").alias("tokens_used"), F.count(F.lit(1)).alias("texts_used"), F.max("uses").alias("most_uses")
    )
    aims = targets.groupBy(_named("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")
    )
    return (
        aims.join(per, "source", "left")
        .withColumn("_all", F.sum("tokens_used").over(Window.partitionBy(F.lit(0))))  # as many rows as targets
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("texts_used", F.lit(0)).alias("texts_used"),
            F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
            F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)).alias("share_reached"),
            F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        )
    )
