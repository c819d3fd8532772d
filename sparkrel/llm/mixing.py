"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

Documents fall into blocks of their source by a hash.  A source's target, in words, becomes a quota of block
draws: whole epochs, and of one more epoch the blocks that come nearest to what is left.  A binary tree over
the output shards splits all quotas: at each node the left side's draws of every source come from one
multivariate hypergeometric draw, so each shard gets its exact share and has, in expectation, the mixture of
the whole.  A source's blocks are permuted afresh in each epoch and dealt out in that order, disjointly, and
a shard's documents are shuffled within the shard.

Only sums by source and block are gathered; a source of any share of the rows is spread over its blocks.
Everything follows from hashes and a seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored, table

#: Times a document is taken at most.
MOST = 3
#: A plan of up to so many rows (16 bytes a draw) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Sources whose sums the driver holds (some 100 bytes each); more are an error, not a wrong mix.
MOST_SOURCES = 1_000_000
#: Shards are so many at least, and more where a shard would take over so many words (about 1 GB).
SHARDS, SHARD_WORDS = 64, 160_000_000


def words(text: Column) -> Column:
    """The number of words; white space is the space and the characters 9 to 13."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all sizes by weight; a share stops at *most* times its size, and the excess is shared again."""
    left, capped = float(sum(sizes)), [False] * len(sizes)
    while True:
        free = [i for i, c in enumerate(capped) if not c]
        level = left / sum(weights[i] for i in free) if free else 0.0
        over = [i for i in free if level * weights[i] > most * sizes[i]]
        if not over:
            return [float(most * s) if c else level * w for s, w, c in zip(sizes, weights, capped, strict=True)]
        for i in over:
            capped[i] = True
            left -= most * sizes[i]


def draws(sizes: list[int], target: float) -> list[tuple[int, int]]:
    """(index, epoch) of the blocks to draw, given in permuted order, so that their words come near *target*."""
    total = sum(sizes)
    if total == 0:
        return []
    epochs = min(MOST, int(target // total + 1e-12))
    found = [(i, e) for e in range(epochs) for i in range(len(sizes))]
    gap, rest = target - epochs * total, []
    if epochs == MOST or gap <= 0:
        return found
    for i, s in enumerate(sizes):
        if 0 < s <= gap and not rest:
            found.append((i, epochs))
            gap -= s
        elif s:
            rest.append((s, i))
    for s, i in sorted(rest, reverse=True):
        # What is left is filled by the largest blocks that fit.
        if s <= gap:
            found.append((i, epochs))
            gap -= s
            rest.remove((s, i))
    if rest and min(rest)[0] < 2 * gap:
        gap -= min(rest)[0]
        found.append((min(rest)[1], epochs))
        rest.remove(min(rest))
    # Then drawn blocks are exchanged for others while that comes nearer.
    size, used = np.array(sizes, np.int64), [i for i, e in found if e == epochs]
    free = [i for _, i in rest]
    while abs(gap) >= 1 and used and free:
        change = np.abs(gap - (size[free][None, :] - size[used][:, None]))
        a, b = divmod(int(change.argmin()), len(free))
        if change[a, b] >= abs(gap):
            break
        gap -= int(size[free[b]] - size[used[a]])
        found[found.index((used[a], epochs))] = (free[b], epochs)
        used[a], free[b] = free[b], used[a]
    return found


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many of each source's draws every shard gets."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(1, 0, shards, np.asarray(quotas, np.int64))]
    while todo:
        node, low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        many = int(own.sum()) * (middle - low) // (high - low)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(own, many, method="marginals") if many else np.zeros_like(own)
        todo += [(2 * node, low, middle, left), (2 * node + 1, middle, high, own - left)]
    return out


def plan(docs: DataFrame, shards: int | None = None, blocks: int = 512, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """*docs* with size, source_size, target (of its source) and draws, an array of (epoch, shard).

    Names that *docs* already has get underscores.  Sources are ordered by code point, null last, and weigh
    *weights*, repeating.  A document's block follows from its doc_id and text, so documents without an id, or with
    one id, fall into blocks of their own; rows that are equal in both are drawn together.  A null text has size 0;
    texts of any length count whole.  Documents without words are drawn in whole epochs only.  An empty table gives
    no rows.  Without *shards* their number follows from the words that the mixture takes.
    """
    return _planned(docs, shards, blocks, seed, weights)[0]


def _planned(docs: DataFrame, shards: int | None, blocks: int = 512, seed: int = 0, weights: tuple[float, ...] = (1, 2, 3)) -> tuple[DataFrame, int]:
    """plan(), and the number of shards."""
    names = [fresh(docs, x) for x in ("size", "source_size", "target", "draws")]
    own_block, own_source, other_block = (fresh(docs, x) for x in ("block", "of_source", "of_block"))
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(blocks)).cast("int")
    sized = docs.withColumn(names[0], words(F.col("text"))).withColumn(own_block, block)
    sums = stored(sized.groupBy(F.col("source").alias("s"), F.col(own_block).alias("b")).agg(F.sum(names[0]).alias("words")), "mix-blocks")
    found = sums.groupBy("s").agg(F.sum("words").alias("words")).orderBy(F.col("s").asc_nulls_last()).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    spark = docs.sparkSession
    wanted = targets([r.words for r in found], [weights[i % len(weights)] for i in range(len(found))])
    kind = docs.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame([(r.s, i, r.words, t) for i, (r, t) in enumerate(zip(found, wanted, strict=True))], f"s {kind}, k int, source_words long, goal double")

    # One group is a source's blocks: `blocks` rows at most.
    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        got = draws(rows["words"].tolist(), float(rows["goal"].iloc[0]))
        return pd.DataFrame({"k": rows["k"].iloc[0], "b": [rows["b"].iloc[i] for i, _ in got], "epoch": [e for _, e in got], "place": range(len(got))}).astype({"k": "int32", "b": "int32", "epoch": "int32", "place": "int64"})

    def by_source(rows: pd.DataFrame) -> pd.DataFrame:
        return choose(rows.sort_values(["turn", "b"]))

    keyed = sums.join(sources, sums["s"].eqNullSafe(sources["s"])).select("k", "b", "words", "goal", F.xxhash64(F.lit(seed), "k", "b").alias("turn"))
    chosen = stored(keyed.groupBy("k").applyInPandas(by_source, "k int, b int, epoch int, place long"), "mix-draws")
    quotas = np.zeros(len(found), np.int64)
    for k, n in chosen.groupBy("k").count().collect():
        quotas[k] = n
    shards = shards or max(SHARDS, -(-int(sum(wanted)) // SHARD_WORDS))
    ends = np.cumsum(split(quotas, shards, seed), axis=0)
    deals = spark.createDataFrame([(k, ends[:, k].tolist()) for k in range(len(found))], "k int, ends array<long>")
    # Blocks are permuted afresh in each epoch, then dealt to the shards in that order.
    from pyspark.sql import Window as W

    order = W.partitionBy("k").orderBy("epoch", F.xxhash64(F.lit(seed), "k", "epoch", "b"), "b")
    dealt = chosen.withColumn("turn", F.row_number().over(order) - 1).join(deals, "k")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("turn"))).alias("shard")
    plans = dealt.select("k", "b", F.struct("epoch", shard).alias("draw")).groupBy("k", "b").agg(F.sort_array(F.collect_list("draw")).alias(names[3]))
    # A row for each source and block, drawn or not, so that every document keeps its source's figures.
    all_blocks = sums.join(sources, sums["s"].eqNullSafe(sources["s"])).select(sources["s"].alias(own_source), F.col("k"), F.col("b"), F.col("source_words").alias(names[1]), F.col("goal").alias(names[2]))
    whole = all_blocks.join(plans, ["k", "b"], "left").select(own_source, F.col("b").alias(other_block), names[1], names[2], F.coalesce(names[3], F.array().cast("array<struct<epoch:int,shard:int>>")).alias(names[3]))
    whole = stored(whole, "mix-plan")
    if len(found) * blocks <= BROADCAST_ROWS:
        whole = F.broadcast(whole)
    joined = sized.join(whole, sized["source"].eqNullSafe(whole[own_source]) & (sized[own_block] == whole[other_block]))
    return joined.drop(own_block, own_source, other_block), shards


def mix(docs: DataFrame, shards: int | None = None, seed: int = 0, **more) -> DataFrame:
    """The mixture itself: the columns of *docs*, a row for each draw, dealt by shard and shuffled in it.

    Shard i is partition i.  No column of *docs* is touched, whatever its name; see plan() for odd rows.
    """
    planned, many = _planned(docs, shards, seed=seed, **more)
    draw = fresh(planned, "draw")
    drawn = planned.withColumn(draw, F.explode(planned.columns[-1]))
    shard, epoch = F.col(f"{draw}.shard"), F.col(f"{draw}.epoch")
    dealt = drawn.repartitionById(many, shard)
    order = F.xxhash64(F.lit(seed), shard, epoch, "doc_id", "text")
    return dealt.sortWithinPartitions(shard, order, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, the words that the mixture takes of it, and the shards
    that take it, one for each time."""
    planned = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))
