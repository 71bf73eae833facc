"""Quality scores learnt from preference pairs.

Bradley-Terry: a document preferred to another has the higher latent score, with probability
sigmoid(score difference). Scores are linear in a handful of whole-text features, so the
weights minimise the logistic loss on feature differences of pairs (one good, one bad
document). The cut is a quantile of the training scores, chosen by balanced accuracy, and the
scores are shifted so that the cut lies at ``cut_score``.

The classifier is fitted on a bounded sample of labelled rows (``per_label`` of each label,
first by hash order), from which each good document meets ``rivals`` bad ones. Labels, language,
source and id are never features. Null and empty texts have all-zero shares and are scored like
any other. With one label only, or none, every score is ``cut_score`` or above (keep all).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_LABEL, RIVALS, BUCKETS = 3000, 12, 32
CUT_SCORE = 0.3
FEATURES = (
    "repeats", "distinct", "symbols", "bangs", "bars", "upper_words", "digits", "word_length", "long_words", "line_words", "stops", "letters",
)
#: Words among which different ones are counted, so that long texts are not at a loss.
SPAN = 25
SYMBOLS = str.maketrans("", "", "*#$%&@^~<>{}[]\\/=+_")


def features(text: str | None) -> list[float]:
    """The numbers of ``FEATURES``, all bounded; zeros for null, empty and blank texts."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    upper = sum(map(str.isupper, words))
    distinct = sum(len(set(words[i : i + SPAN])) for i in range(0, n, SPAN))
    ends = sum(w[-1] in ".,;:?" for w in words)
    lines = text.count("\n") + 1
    glyphs = size - len(text.translate(SYMBOLS))
    body = size - n
    return [
        sum(a == b for a, b in pairwise(words)) / n,
        distinct / n,
        min(glyphs / n, 4.0),
        min(text.count("!") / n, 3.0),
        min(text.count("|") / n, 1.0),
        upper / n,
        sum(map(text.count, "0123456789")) / size,
        min(body / n, 20.0) / 20,
        sum(len(w) > 16 for w in words) / n,
        min(np.log1p(n / lines), 6.0) / 6,
        ends / n,
        sum(map(str.isalpha, words)) / n,
    ]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> list:
    """At most ``per_label`` rows (label, features) of each label; the first by hash of the key."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), (F.col(label) > 0).cast("int").alias("_label")).distinct()
    place = F.xxhash64("_key", F.lit("pairs"))
    first = Window.partitionBy("_label", F.pmod(place, F.lit(BUCKETS))).orderBy(place, "_key")
    picked = marks.withColumn("_nth", F.row_number().over(first)).filter(F.col("_nth") <= max(1, per_label // BUCKETS)).drop("_nth")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")  # at most 2 * per_label keys

    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts], dtype=object)

    return rows.select("_key", "_label", F.pandas_udf(measure, "array<double>")("_text").alias("x")).orderBy("_label", F.xxhash64("_key", F.lit("pairs")), "_key").collect()


class Ranker:
    """Weights, cut and slope; ``score`` maps features to (0, 1)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.spread, self.weights, self.cut = mean, spread, weights, cut

    def latent(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(self.latent(x) - self.cut + shift, -30, 30)))


def fit(rows: list, rivals: int = RIVALS, ridge: float = 1e-3, steps: int = 30) -> Ranker:
    """Newton steps on the pairwise logistic loss; see the module for degenerate samples."""
    good = np.array([r["x"] for r in rows if r["_label"] == 1]).reshape(-1, len(FEATURES))
    bad = np.array([r["x"] for r in rows if r["_label"] == 0]).reshape(-1, len(FEATURES))
    everything = np.concatenate([good, bad])
    if not len(good) or not len(bad):
        return Ranker(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0)
    mean, spread = everything.mean(0), everything.std(0)
    spread[spread < 1e-9] = 1.0
    a, b = (good - mean) / spread, (bad - mean) / spread
    rng = np.random.default_rng(7)
    side = max(len(a), len(b))
    left, right = np.tile(rng.permutation(len(a)), side // len(a) + 1)[:side], np.tile(rng.permutation(len(b)), side // len(b) + 1)[:side]
    diff = np.concatenate([a[left] - b[np.roll(right, k * side // rivals)] for k in range(rivals)])
    w = np.zeros(len(FEATURES))
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ p / len(diff) - ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    one, zero = a @ w, b @ w
    cuts = np.quantile(np.concatenate([one, zero]), np.linspace(0.01, 0.99, 197))
    balance = [(one >= c).mean() + (zero < c).mean() for c in cuts]
    top = np.flatnonzero(np.array(balance) >= max(balance) - 1e-9)
    return Ranker(mean, spread, w, float(cuts[top[len(top) // 2]]))


def score(docs: DataFrame, ranker: Ranker, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(ranker.score(x))

    return docs.withColumn(into, F.pandas_udf(judge, "double")(F.col(text)))
