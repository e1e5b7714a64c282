"""Toxicity by non-negative positive-unlabelled learning.

The training set is a bounded, documented sample: at most ``positives`` texts confirmed as toxic and ``unlabelled``
texts whose labels are not looked at, chosen by a hash of their ids. Their words become binary features; words that
separate confirmed from unlabelled texts better than chance are kept, ``models`` linear classifiers are trained in numpy, each
on its own half of the unlabelled texts, and their mean is the score. Training minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss; where the part in the maximum falls below zero, the step goes back along it. The class prior is
the share of confirmed texts among the labelled training rows, counted over all of them. Scoring reads every word of
every text; the model's size is bounded by ``features``.

Null and empty texts have no words and get the score of the bias alone. Rows without an id count as held out. A
document with several label rows is confirmed if one of them says so. Without any confirmed text every score is 0.
Repeated rows are scored each. Only the id, text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import light_batches, query, stored, table, word_runs

WORDS = re.compile(r"\w+")
FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 0 by five; rows without an id too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(True))


def distinct_words(text: str | None) -> set[str]:
    found: set[str] = set()
    for run in word_runs(WORDS, (text or "").lower()):
        found.update(run)
    return found


@dataclass
class Model:
    """Weights of the kept words; the score is the mean of the logistic outputs of the classifiers."""

    words: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.full(1, -np.inf))

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        known = self.words.keys()
        for i, text in enumerate(texts):
            k = [self.words[w] for w in sorted(known & distinct_words(text))]
            z = self.bias + self.weights[:, k].sum(axis=1)
            out[i] = np.mean(1 / (1 + np.exp(-np.clip(z, -60, 60))))
        return out


def _rows(sets: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([k for s in sets for k in s], dtype=np.int64)


def train(
    positive: list[set[str]], other: list[set[str]], prior: float, features: int, models: int, steps: int = 400, seed: int = 7
) -> Model:
    """Linear classifiers under the non-negative risk, full-batch Adam; the same input gives the same model."""
    if not positive or not other:
        return Model()
    in_p = Counter(w for s in positive for w in s)
    in_u = Counter(w for s in other for w in s)

    def gain(w: str) -> float:
        p, u = (in_p[w] + 0.5) / (len(positive) + 1), (in_u[w] + 0.5) / (len(other) + 1)
        return p * np.log(p / u) + (1 - p) * np.log((1 - p) / (1 - u))

    # Twice the log likelihood ratio must exceed what the best of so many chance words would reach.
    chance = 2 * np.log(max(2, len(in_p.keys() | in_u.keys())))
    gains = {w: gain(w) for w in in_p}
    kept = sorted((w for w in in_p if 2 * len(positive) * gains[w] > chance), key=lambda w: (-gains[w], w))[:features]
    words = {w: k for k, w in enumerate(sorted(kept))}
    rng = np.random.default_rng(seed)
    weights, bias = [], []
    p_row, p_col = _rows([[words[w] for w in s if w in words] for s in positive])
    for _ in range(models):
        half = [other[i] for i in np.sort(rng.permutation(len(other))[: max(1, len(other) // 2 if models > 1 else len(other))])]
        u_row, u_col = _rows([[words[w] for w in s if w in words] for s in half])
        w, b = np.zeros(len(words)), 0.0
        first, second = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        for step in range(1, steps + 1):
            z_p = np.bincount(p_row, w[p_col], len(positive)) + b
            z_u = np.bincount(u_row, w[u_col], len(half)) + b
            s_p, s_u = 1 / (1 + np.exp(-np.clip(z_p, -60, 60))), 1 / (1 + np.exp(-np.clip(z_u, -60, 60)))
            negative = s_u.mean() - prior * s_p.mean()
            d_p, d_u = s_p * (1 - s_p) / len(positive), s_u * (1 - s_u) / len(half)
            if negative >= 0:  # both parts fall: prior * (1 - s_p) + s_u - prior * s_p
                g_p, g_u = -2 * prior * d_p, d_u
            else:  # the corrected part went below zero: undo it
                g_p, g_u = prior * d_p, -d_u
            grad = np.append(np.bincount(p_col, g_p[p_row], len(words)) + np.bincount(u_col, g_u[u_row], len(words)), g_p.sum() + g_u.sum())
            grad[:-1] += 1e-5 * w
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        weights.append(w)
        bias.append(b)
    return Model(words, np.array(weights), np.array(bias))


def fit(
    docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, features: int = 2048, models: int = 3
) -> Model:
    """Model from the rows that are not held out; the sample sizes bound what the driver reads."""
    marked = labels.where(~held_out()).groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic"))
    n, confirmed = marked.agg(F.count("*"), F.sum("_toxic")).first()
    if not n or not confirmed:
        return Model()
    known = marked.where("_toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(1).alias("_p"))
    ids = docs.where(~held_out()).select("doc_id")
    any_text = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).select("doc_id", F.lit(0).alias("_p"))
    chosen = known.unionByName(any_text.distinct())  # at most positives + unlabelled rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(distinct_words(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "_p": pdf["_p"], "words": found})

    sets = stored(texts.mapInPandas(words, "doc_id long, _p int, words array<string>"))
    n_p, n_u = sets.agg(F.coalesce(F.sum("_p"), F.lit(0)), F.coalesce(F.sum(1 - F.col("_p")), F.lit(0))).first()
    counts = stored(sets.select("_p", F.explode("words").alias("w")).groupBy("w").agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("u")))
    p, u = (F.col("p") + 0.5) / (n_p + 1.0), (F.col("u") + 0.5) / (n_u + 1.0)
    gain = p * F.log(p / u) + (1 - p) * F.log((1 - p) / (1 - u))
    chance = 2 * np.log(max(2, counts.count()))
    best = counts.where((F.col("p") > 0) & (2 * n_p * gain > chance)).orderBy(gain.desc(), "w").limit(features)
    # Only the kept words of the sample come to the driver.
    kept = docs.sparkSession.sparkContext.broadcast(frozenset(r["w"] for r in best.select("w").collect()))

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(words=[sorted(kept.value.intersection(w)) for w in pdf["words"]])

    rows = sets.mapInPandas(known, sets.schema).toPandas().sort_values(["_p", "doc_id"])
    positive = [set(w) for w in rows.loc[rows["_p"] == 1, "words"]]
    other = [set(w) for w in rows.loc[rows["_p"] == 0, "words"]]
    return train(positive, other, confirmed / n, features, models)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``features`` words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = shared.value.score(pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s, "predicted": (s >= 0.5).astype("int32")})

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def select(docs: DataFrame, model: Model, keep: int = 0, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose prediction is ``keep``; only texts go to Python, a few at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            texts = [t or "" for t in series]
            some = [shared.value.score(texts[i:j]) for i, j in light_batches(texts)]
            yield pd.Series((np.concatenate([np.zeros(0), *some]) >= 0.5) == bool(keep))

    return docs.where(chosen(F.col(text)))


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score(docs, fit(docs, table(spark, folder, "labels")))
