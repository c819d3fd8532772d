"""Toxicity by class-conditional Kneser-Ney models.

Both classes, toxic and ordinary, have a model of expressions (words): a word's count in a class is the number of
different words to its left there, or of documents if those are fewer, so that neither copies nor one long document
make it common.  Each count gives up the Kneser-Ney discount n1 / (n1 + 2 n2) of its class.  What the discounts free
goes to the word's stem (its first letters), whose counts in the class are discounted likewise, and from there to
counts that both classes share: in how many of the classes a stem, and a word within its stem, occurs at all.  Either
model's probabilities sum to one over the words that are known, an unknown one in each stem, and an unknown stem.

A document is scored by length-normalised log-likelihoods, toxic against ordinary: over the whole of it, and over its
two most toxic words, as two insults among 3000 words leave no trace in the mean of all.  A logistic curve over both,
fitted on labelled documents kept apart from the counts, makes a probability of them.

Counts come from labelled rows only, at most ``per_class`` of either class (by hash order), which bounds the
model that is sent to the workers.  Scoring is a map over all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, add_columns, column, fresh, held_out, labelled, map_batches, table, texts

EDGE = ".,;:!?\"'()[]{}|*#$%&@-_/\\<>=+~`^«»“”„…¿¡"
STEM = 4
#: The number of words that count by themselves; false alarms that a missed document weighs as much as.
SINGLE, MISSED = 2, 3.0


def expression(raw: str) -> str:
    return raw.strip(EDGE)


def counts(sample: DataFrame) -> DataFrame:
    """label, word, n: the different words to the left of each word in each class, or its documents if they are fewer."""

    def run(batches):
        for batch in batches:
            found = set()
            for text, label, doc in zip(texts(batch), column(batch, "label").to_pylist(), column(batch, "doc").to_pylist(), strict=True):
                words = [w for w in map(expression, text.lower().split()) if w]
                found.update(zip([label] * len(words), [False] * len(words), words, ["", *words]))
                found.update((label, True, w, doc) for w in set(words))
            if found:
                kinds = [pa.int64(), pa.bool_(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["label", "whole", "word", "x"])

    src = sample.select("text", "label", F.xxhash64("doc_id").cast("string").alias("doc"))
    places = map_batches(src, "label long, whole boolean, word string, x string", run).distinct()
    return places.groupBy("label", "word").agg(F.least(F.count_if("whole"), F.count_if(~F.col("whole"))).alias("n"))


class Level:
    """Discounted counts of two classes (ordinary, toxic) and what each class leaves to the level below."""

    def __init__(self, found: dict[str, tuple[int, int]]) -> None:
        self.found, self.total, self.discount, self.left = found, [], [], []
        for k in (0, 1):
            own = [c[k] for c in found.values() if c[k]]
            sizes, total = Counter(own), max(1, sum(own))
            once, twice = sizes[1], sizes[2]
            discount = once / (once + 2 * twice) if once and twice else 0.5
            self.total.append(total)
            self.discount.append(discount)
            self.left.append(discount * len(own) / total if own else 1.0)

    def kept(self, k: int, key: str) -> float:
        n = self.found.get(key, (0, 0))[k]
        return (n - self.discount[k]) / self.total[k] if n else 0.0

    def shared(self, key: str) -> int:
        """The number of classes that have *key*; one that neither has counts as one."""
        return sum(n > 0 for n in self.found.get(key, ())) or 1


class Model:
    """The probabilities of words in both classes, and their log ratios."""

    def __init__(self, found: dict[str, tuple[int, int]]) -> None:
        """Counts of words are (ordinary, toxic)."""
        stems: dict[str, list[int]] = {}
        self.types: dict[str, int] = defaultdict(int)
        self.words = Level(found)
        for word, (a, b) in found.items():
            own = stems.setdefault(word[:STEM], [0, 0])
            own[0] += a
            own[1] += b
            self.types[word[:STEM]] += self.words.shared(word)
        self.stems = Level({k: tuple(v) for k, v in stems.items()})
        self.all = sum(map(self.stems.shared, stems)) + 1

    def stem_probability(self, k: int, stem: str) -> float:
        return self.stems.kept(k, stem) + self.stems.left[k] * self.stems.shared(stem) / self.all

    def probability(self, k: int, word: str) -> float:
        """P(word | class k); an unknown word stands for all unknown ones of its stem, an unknown stem for all such."""
        stem = word[:STEM]
        within = self.words.shared(word) / (self.types.get(stem, 0) + 1)
        return self.words.kept(k, word) + self.words.left[k] * self.stem_probability(k, stem) * within

    def ratio(self, raw: str) -> float:
        """log P(word | toxic) - log P(word | ordinary); nothing but marks tells nothing."""
        word = expression(raw)
        return math.log(self.probability(1, word) / self.probability(0, word)) if word else 0.0


def features(text: str, memo: Memo) -> list[float]:
    """Length-normalised log-likelihood ratios: of the whole text, of its most toxic words."""
    words = text.lower().split()
    if not words:
        return [0.0, 0.0]
    r = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    top = np.partition(r, -SINGLE)[-SINGLE:] if len(r) > SINGLE else r
    return [float(r.mean()), float(top.sum()) / SINGLE]


NAMES = ["mean", "top"]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """A weight for each column of *x* and the intercept, by Newton's method with a small ridge."""
    rows, w = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.zeros(x.shape[1] + 1)
    hold = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows.T * (p * (1 - p) * weight)) @ rows + hold, rows.T @ ((y - p) * weight) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, per_class: int = 3_000) -> DataFrame:
    """*docs* with ``toxicity`` (0 to 1; an underscore is added where the name is taken).

    *labels* has doc_id and toxic, 0 or 1; the rows to learn from, *per_class* of either class at most.  Only texts
    are inputs of a score: equal texts have equal scores.  Null and empty texts score as texts that tell nothing; texts
    of any length count whole.  Without labels of both classes every score is 0.5.  Other columns and repeated rows
    pass through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    both = [labelled(docs, labels, "toxic", per_class, F.col("label") == k) for k in (0, 1)]
    sample = both[0].unionByName(both[1]).withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    found = counts(sample.where("not apart")).groupBy("word").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)])
    # Bounded by the labelled documents of the sample.
    model = spark.sparkContext.broadcast(Model({word: (a, b) for word, a, b in found.toLocalIterator()}))

    def try_out():
        memo = Memo(model.value.ratio)
        return lambda batch: [list(c) for c in zip(*(features(t, memo) for t in texts(batch)), strict=True)]

    tried = add_columns(sample.where("apart").select("text", "label"), [T.StructField(x, T.DoubleType()) for x in NAMES], try_out).select("label", *NAMES).collect()
    out = fresh(docs, "toxicity")
    y = np.array([r.label for r in tried], np.float64)
    if len(set(y.tolist())) < 2:
        return docs.withColumn(out, F.lit(0.5))
    # As many of either class as all labels have, not as the sample; toxic ones weigh more.
    of_class = dict(labels.where("toxic is not null").groupBy("toxic").count().collect())
    share = {k: of_class.get(k, 1) / max(1, (y == k).sum()) for k in (0, 1)}
    weight = np.where(y == 1, share[1] * MISSED, share[0])
    curve = logistic(np.array([r[1:] for r in tried], np.float64), y, weight * len(y) / weight.sum())

    def each():
        memo = Memo(model.value.ratio)

        def run(batch):
            x = np.array([features(t, memo) for t in texts(batch)]) @ curve[:-1] + curve[-1]
            return [1 / (1 + np.exp(-np.clip(x, -700, 700)))]

        return run

    return add_columns(docs, [T.StructField(out, T.DoubleType())], each)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; rows whose id's CRC leaves 1 are held out of the training."""
    labels = table(spark, sf_dir, "labels")
    scored = score(table(spark, sf_dir, "documents").select("doc_id", "text"), labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
