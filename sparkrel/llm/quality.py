"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features serves all grades; ordered thresholds part them:
P(grade <= k) = sigmoid(threshold_k - f(text)).  From these come the expected grade and the tail probability
P(grade >= cut) by which documents are selected.  Features are averages over the words of a text, so scoring
looks each word up once; it is a map over all documents.  Training takes a bounded sample of labelled rows
(``most``), whose sparse features come to the driver.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, add_columns, column, fresh, labelled, map_batches, table, texts

#: Hashed features; the last few places are for features of the whole text.
SIZE = 1 << 17
REPEATED, VARIED, SHORT, EMPTY = SIZE, SIZE + 1, SIZE + 2, SIZE + 3
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")


def features(word: str) -> tuple[int, ...]:
    """Places of a word's features: the word in lower case, its shape, its symbols at the end, its last letters."""
    low = word.lower()
    shape = _DIGITS.sub("9", _LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "Aa" if m[0][0].isupper() else "a", word))[:12]
    end = word.rstrip("".join(c for c in set(word[-4:]) if not c.isalnum()))
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % SIZE for x in ("w" + low, "s" + shape, "e" + word[len(end) :][-4:], "t" + low[-3:]))


def whole(words: list[str]) -> list[tuple[int, float]]:
    """Features of the whole text."""
    n = len(words)
    if not n:
        return [(EMPTY, 1.0)]
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    return [(REPEATED, repeated), (VARIED, len(set(words)) / n), (SHORT, 1 / (1 + n / 20))]


def vector(text: str, memo: Memo) -> tuple[list[int], list[float]]:
    words = text.split()
    found: dict[int, float] = {}
    for w in words:
        for i in memo[w]:
            found[i] = found.get(i, 0) + 1
    items = [(i, v / len(words)) for i, v in found.items()] + whole(words)
    return [i for i, _ in items], [v for _, v in items]


class Model:
    """Weights, ordered thresholds and the grades they part."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]) -> None:
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def word(self, word: str) -> float:
        return float(sum(self.weights[i] for i in features(word)))

    def value(self, text: str, memo: Memo) -> float:
        words = text.split()
        total = sum(map(memo.__getitem__, words)) / len(words) if words else 0.0
        return total + sum(float(self.weights[i]) * v for i, v in whole(words))

    def at_most(self, value: np.ndarray) -> np.ndarray:
        """P(grade <= k) for every grade but the last: rows by thresholds."""
        return 1 / (1 + np.exp(np.clip(value[:, None] - self.thresholds[None, :], -40, 40)))

    def expected(self, value: np.ndarray) -> np.ndarray:
        steps = np.diff(np.array(self.grades, np.float64))
        return self.grades[0] + (1 - self.at_most(value)) @ steps

    def tail(self, value: np.ndarray, cut: int) -> np.ndarray:
        """P(grade >= cut)."""
        k = int(np.searchsorted(self.grades, cut))
        if k == 0:
            return np.ones(len(value))
        if k == len(self.grades):
            return np.zeros(len(value))
        return 1 - self.at_most(value)[:, k - 1]


def fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-4) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows at once."""
    levels = sorted(set(grades.tolist()))
    y = np.searchsorted(levels, grades)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    places, inside = np.unique(np.concatenate(rows), return_inverse=True)
    v = np.concatenate(values)
    k, w = len(levels) - 1, np.zeros(len(places))
    share = np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / len(y)
    free = np.log(share / (1 - share))
    raw = np.concatenate([free[:1], np.log(np.expm1(np.maximum(np.diff(free), 1e-3)))])
    both = np.concatenate([w, raw])
    m, s = np.zeros_like(both), np.zeros_like(both)
    for t in range(1, rounds + 1):
        w, raw = both[: len(w)], both[len(w) :]
        theta = np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))]))
        f = np.bincount(at, v * w[inside], len(rows))
        below = 1 / (1 + np.exp(np.clip(f[:, None] - theta, -40, 40)))
        edge = np.concatenate([np.zeros((len(f), 1)), below, np.ones((len(f), 1))], axis=1)
        hi, lo = edge[np.arange(len(f)), y + 1], edge[np.arange(len(f)), y]
        p = np.maximum(hi - lo, 1e-9)
        df = -(1 - hi - lo)  # of the log-likelihood by f
        dtheta = np.zeros(k)
        for j in range(k):
            d = below[:, j] * (1 - below[:, j])
            dtheta[j] = (d[y == j] / p[y == j]).sum() - (d[y == j + 1] / p[y == j + 1]).sum()
        draw = np.cumsum(dtheta[::-1])[::-1]
        draw[1:] = draw[1:] / (1 + np.exp(-raw[1:]))
        grad = -np.concatenate([np.bincount(inside, v * df[at], len(w)), draw]) / len(rows)
        grad[: len(w)] += ridge * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        both = both - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    w, raw = both[: len(w)], both[len(w) :]
    weights = np.zeros(SIZE + 4)
    weights[places] = w
    return Model(weights, np.cumsum(np.concatenate([raw[:1], np.log1p(np.exp(raw[1:]))])), levels)


def train(docs: DataFrame, labels: DataFrame, most: int = 6_000, label: str = "quality") -> Model | None:
    """A model from at most *most* labelled documents (by hash order); None without two grades."""
    sample = labelled(docs, labels, label, most).select("text", "label")

    def run(batches):
        memo = Memo(features, 50_000)
        for batch in batches:
            found = [vector(t, memo) for t in texts(batch)]
            if found:
                yield pa.RecordBatch.from_arrays([column(batch, "label"), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([b for _, b in found], pa.list_(pa.float32()))], names=["label", "at", "value"])

    # Bounded by *most* documents.
    got = map_batches(sample, "label long, at array<int>, value array<float>", run).toArrow()
    grades = got["label"].to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    # Features of fewer than 3 documents would only be learned by heart.
    flat = got["at"].combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    places, values = flat.values.to_numpy(), got["value"].combine_chunks().values.to_numpy().astype(np.float64)
    common = np.bincount(places, minlength=SIZE + 4)[places] >= 3
    ends = np.cumsum(lengths)[:-1]
    keep = np.split(common, ends)
    rows = [a[k] for a, k in zip(np.split(places, ends), keep, strict=True)]
    return fit(rows, [a[k] for a, k in zip(np.split(values, ends), keep, strict=True)], grades)


def score(docs: DataFrame, labels: DataFrame, cut: int = 1, most: int = 6_000, label: str = "quality") -> DataFrame:
    """*docs* with ``expected_grade`` and ``tail_probability``, P(grade >= *cut*).

    Underscores are added to names that are taken.  Null and empty texts are scored as texts without words.
    Without labels of two grades nothing can be told: the expected grade is null and the probability 1.
    Equal texts get equal scores; other columns and repeated rows pass through.
    """
    grade, tail = fresh(docs, "expected_grade"), fresh(docs, "tail_probability")
    model = train(docs, labels, most, label)
    if model is None:
        return docs.withColumn(grade, F.lit(None).cast("double")).withColumn(tail, F.lit(1.0))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value
        memo = Memo(own.word)

        def each(batch):
            f = np.array([own.value(t, memo) for t in texts(batch)])
            return [own.expected(f), own.tail(f, cut)]

        return each

    return add_columns(docs, [T.StructField(grade, T.DoubleType()), T.StructField(tail, T.DoubleType())], make)


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, cut: int = 1) -> DataFrame:
    """The documents whose grade is likely *cut* or more, with their own columns."""
    scored = score(docs, labels, cut)
    return scored.where(F.col(scored.columns[-1]) >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's expected grade, tail probability and selection."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).cast("int").alias("selected"))
