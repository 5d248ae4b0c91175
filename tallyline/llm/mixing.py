"""Sources mixed to target shares of the total size, exactly split among output shards.

The size of a document is its tokens by a public tokenizer. The total is the largest that every source can serve: a
source whose share would need more than ``max_repeat`` uses of each document limits it. A source's quota is used up by
whole passes over the source, then by a part of one more pass in a permuted order.

The order within a source is the order of its blocks and of the documents in a block, both by seeded hashes. Blocks
(``BLOCKS`` a source) are the unit that is summed, so the cut of the last pass needs the block totals only: blocks before
the boundary are taken whole, the boundary block is cut document by document inside itself. No source, even one with a
third of all rows, is sorted or gathered as a whole.

Shards: a binary tree over the output shards splits every source's number of blocks (each use of a block by itself) by
multivariate hypergeometric draws, node by node, so that the counts are exact at every level and each shard is a uniform
sample of the mixture without replacement. The tree runs on counts, sources times shards, whose size the parameters fix.
A shard then takes its number of blocks from each source's permuted block order, disjointly, and its documents are
brought together and shuffled locally, by a seeded hash of each use.

Defined results: NULL and empty texts have no tokens and are used as often as the passes say; a document of an unknown
source, or of a source with a NULL or zero share, isn't used; a target source without documents gets nothing and the
others keep their proportions, the report showing the missing share; a NULL ``max_repeat`` means once; repeated
documents are documents of their own if their ids differ; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.session import cut_lineage

BLOCKS = 256
MAX_SOURCES = 1_000
#: A plan of more rows is joined like any table instead of being sent to every task.
BROADCAST_ROWS = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how the public byte-level tokenizers cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` without ``text`` but with its ``tokens``."""

    # executors that lack the file get it from the driver
    if os.path.exists(tokenizer):
        docs.sparkSession.sparkContext.addFile(tokenizer)

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(tokenizer if os.path.exists(tokenizer) else SparkFiles.get(os.path.basename(tokenizer)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn("tokens", F.pandas_udf(counted, "bigint")(F.col(text))).drop(text)


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """``counts`` a source dealt to ``shards``: rows shards, columns sources, exact column sums, shard sizes equal to within one."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    size = (total * left + shards // 2) // shards
    here = rng.multivariate_hypergeometric(counts, size, method="marginals") if total else counts * 0
    return np.vstack([split_tree(here, left, rng), split_tree(counts - here, shards - left, rng)])


def plan_quotas(sizes: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int]]:
    """``source: (whole passes, tokens of the last pass)`` for the largest total that every source can serve."""
    usable = {s: (share, most) for s, (share, most) in targets.items() if share and share > 0 and sizes.get(s, 0) > 0}
    if not usable:
        return {}
    total = min(sizes[s] * most / share for s, (share, most) in usable.items())
    out = {}
    for s, (share, most) in usable.items():
        quota = min(round(total * share), sizes[s] * most)
        out[s] = divmod(quota, sizes[s])
    return out


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shards: int = 16, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(key, source, tokens, copy, shard, place)``: each use of each document, in the mixture's order within a shard."""
    rows = targets.select("source", "target_share", "max_repeat").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {r[0]: (float(r[1] or 0), max(1, int(r[2] or 1))) for r in rows if r[0] is not None}
    spark = docs.sparkSession
    own = docs.where(F.col(source).isin(list(wanted))).select(F.col(key).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"))
    block = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(BLOCKS)).cast("int").alias("block")
    sized = cut_lineage(token_counts(own, "text", tokenizer).select("id", "source", "tokens", block, F.xxhash64("id", F.lit(seed + 1)).alias("h")))

    # sources times BLOCKS rows, whatever the number of documents
    totals = sized.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")).collect()
    per_source: dict[str, dict[int, int]] = {}
    for r in totals:
        per_source.setdefault(r["source"], {})[r["block"]] = r["tokens"]
    quotas = plan_quotas({s: sum(b.values()) for s, b in per_source.items()}, wanted)
    rng = np.random.default_rng(seed)
    names = sorted(quotas)
    orders = {s: [int(b) for b in rng.permutation(sorted(per_source[s]))] for s in names}
    uses: dict[str, list[tuple[str, int, int, int | None]]] = {}  # source, copy, block, tokens wanted (None: all)
    for s in names:
        passes, rest = quotas[s]
        uses[s] = [(s, c, b, None) for c in range(passes) for b in orders[s]]
        for b in orders[s]:
            if rest <= 0:
                break
            uses[s].append((s, passes, b, None if per_source[s][b] <= rest else rest))
            rest -= per_source[s][b]
    counts = np.array([len(uses[s]) for s in names], dtype=np.int64)
    dealt = split_tree(counts, shards, rng) if names else np.zeros((shards, 0), int)
    plan = []
    for k, s in enumerate(names):
        shard_of = np.repeat(np.arange(shards), dealt[:, k])
        plan += [(*uses[s][i], int(shard)) for i, shard in zip(rng.permutation(len(uses[s])), shard_of, strict=True)]
    plan_df = spark.createDataFrame(plan, "source string, copy int, block int, wanted bigint, shard int")
    used = sized.join(F.broadcast(plan_df) if len(plan) <= BROADCAST_ROWS else plan_df, ["source", "block"])
    before = F.sum("tokens").over(Window.partitionBy("source", "block", "copy").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1))
    # only boundary blocks are cut, so only they are ordered
    whole = used.where(F.col("wanted").isNull())
    cut = used.where(F.col("wanted").isNotNull()).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") + F.col("tokens") / 2 <= F.col("wanted")).drop("before")
    mixed = whole.unionByName(cut).select(F.col("id").alias(key), "source", "tokens", "copy", "shard", F.xxhash64("id", "copy", F.lit(seed + 2)).alias("place"))
    return mixed.repartition(shards, "shard").sortWithinPartitions("shard", "place")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target and actual share, tokens, uses of documents and the most uses of one document."""
    own = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_uses"), (F.max("copy") + 1).alias("most_uses"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = targets.select("source", "target_share", "max_repeat").join(own, "source", "left")
    filled = joined.select("source", "target_share", "max_repeat", *(zero(c) for c in ("tokens", "n_uses", "most_uses")))
    # a window over the targets, of which there are at most MAX_SOURCES
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return filled.withColumn("actual_share", F.when(everything > 0, F.col("tokens") / everything).otherwise(0.0))
