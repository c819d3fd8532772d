"""Exact top-k search by distributed histogram selection.

For a block of queries every vector is scored; each task counts scores in bins, and the bins' global sums show
the bin that holds a query's k-th best score.  That bin is divided again until it is one score wide: then the
k-th value is known.  A last pass keeps the scores above it, and of those equal to it the smallest ids.

Queries come in blocks of bounded size, which are broadcast; the vectors are never shuffled.  Of its bins a
task reports only those from the top down to its own k-th score, since no k-th score of all lies below that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, map_batches, shared_dir, table

#: Queries in a block, bins of a histogram: a task's counts take 4 bytes each.
BLOCK, BINS = 2048, 2048
#: Vectors scored at once.
ROWS = 512


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows without nulls and non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))


class _Block:
    """A block of queries, grouped by their number of components."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], exact: bool) -> None:
        self.ids, self.by_size = ids, {}
        sizes = np.array([len(v) for v in vectors])
        for d in set(sizes.tolist()):
            at = np.flatnonzero(sizes == d)
            self.by_size[d] = (at, np.stack([vectors[i] for i in at]).astype(np.float64 if exact else np.int64).reshape(len(at), d))

    def scores(self, batch: pa.RecordBatch):
        """(query places, vector ids, scores: vectors x queries, own: where a query meets its own id)."""
        lists, ids = column(batch, "embedding"), column(batch, "vec_id").to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        flat, starts = np.floor(lists.values.to_numpy(zero_copy_only=False) * 256.0), lists.offsets.to_numpy()
        for d, (at, queries) in self.by_size.items():
            rows = np.flatnonzero(sizes == d)
            for lo in range(0, len(rows), ROWS):
                r = rows[lo : lo + ROWS]
                own = flat[starts[r][:, None] + np.arange(d)].reshape(len(r), d).astype(queries.dtype)
                yield at, ids[r], (own @ queries.T).astype(np.int64), ids[r][:, None] == self.ids[at][None, :]


def _histograms(vectors: DataFrame, block, low, span, width, k: int) -> DataFrame:
    """q, bin, n: for each query place, how many scores fall in each bin of *width*, from *low* on to *span* more."""

    def run(batches):
        b, lo, over, w = block.value, low, low + span, width
        counts = np.zeros((len(b.ids), BINS), np.int32)
        for batch in batches:
            for at, _, s, own in b.scores(batch):
                bins = (s - lo[at]) // w[at]
                good = (s >= lo[at]) & (s < over[at]) & ~own
                flat = (np.arange(len(at)) * BINS)[None, :] + bins
                counts[at] += np.bincount(flat[good], minlength=len(at) * BINS).reshape(len(at), BINS).astype(np.int32)
        down = np.cumsum(counts[:, ::-1], axis=1, dtype=np.int64)[:, ::-1]
        q, bin_ = np.nonzero((counts > 0) & (down - counts < k))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[q, bin_].astype(np.int64))], names=["q", "bin", "n"])

    return map_batches(vectors, "q int, bin int, n long", run)


def _kept(vectors: DataFrame, block, least, k: int) -> DataFrame:
    """query_id, vec_id, score of scores over a query's *least*, and of the smallest ids with that score."""

    def run(batches):
        b = block.value
        for batch in batches:
            for at, ids, s, own in b.scores(batch):
                i, j = np.nonzero((s >= least[at][None, :]) & ~own)
                if not len(i):
                    continue
                q, v, x = at[j], ids[i], s[i, j]
                order = np.lexsort((v, -x, q))
                q, v, x = q[order], v[order], x[order]
                first = np.concatenate([[True], q[1:] != q[:-1]])
                rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
                keep = rank < k
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[q[keep]]), pa.array(v[keep]), pa.array(x[keep])], names=["query_id", "vec_id", "score"])

    return map_batches(vectors, "query_id long, vec_id long, score long", run)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's *k* highest inner products of floor(256 x), ties to smaller ids.

    *vectors* and *queries* have vec_id and embedding.  A vector takes no part if it or its id is null, or a
    component is null or not finite; vectors of other lengths than the query's give no score.  A query's
    candidates are all rows with another id; fewer than *k* of them are all returned.  Of query rows with one
    id the least vector is searched; repeated candidates each count.  No queries or vectors: no rows.  Scores
    beyond 64 bits are an error.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (F.abs(x) * 256 + 1) * (F.abs(x) * 256 + 1)))
    longest = rows.agg(F.max(norm)).first()[0]
    out, last, any_ = shared_dir(spark, "topk"), None, False
    while longest is not None:
        part = asked if last is None else asked.where(F.col("vec_id") > last)
        got = part.orderBy("vec_id").limit(BLOCK).collect()
        if not got:
            break
        last = got[-1].vec_id
        own = [np.floor(np.array(r.embedding, np.float64) * 256.0) for r in got]
        bound = np.array([min(9e18, np.sqrt((v * v).sum()) * longest) for v in own]) + 2
        if (bound >= 9e18).any():
            raise OverflowError("scores beyond 64 bits")
        block = spark.sparkContext.broadcast(_Block(np.array([r.vec_id for r in got], np.int64), own, bool((bound < 2**52).all())))
        high = bound.astype(np.int64) + 1
        low, need, span = -high, np.full(len(got), k), 2 * high + 1
        while True:
            width = np.maximum(1, (span + BINS - 1) // BINS)
            sums = _histograms(rows, block, low, span, width, k).groupBy("q", "bin").agg(F.sum("n").alias("n"))
            above = F.coalesce(F.sum("n").over(W.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            goal = spark.createDataFrame(list(enumerate(need.tolist())), "of int, wanted long")
            # One row a query: the bin where the running count reaches what is needed.
            found = sums.withColumn("above", above).join(F.broadcast(goal), F.col("q") == F.col("of")).where("above < wanted and above + n >= wanted").select("q", "bin", "above").collect()
            hit = np.zeros(len(got), bool)
            for q, bin_, n in found:
                hit[q] = True
                low[q] += bin_ * width[q]
                need[q] -= n
            # With fewer candidates than k all are kept.
            low[~hit] = -high[~hit]
            if (width[hit] <= 1).all():
                break
            span = np.where(hit, width, 0)
        _kept(rows, block, low, k).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
        block.unpersist()
        any_ = True
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(out) if any_ else spark.createDataFrame([], schema)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
