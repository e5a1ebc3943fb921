"""Quality classifier from trusted positives and unlabelled texts.

Minimises the non-negative unbiased risk: with class prior c, positives P, unlabelled U,

    c * loss(P as positive) + max(0, loss(U as negative) - c * loss(P as negative)).

When the second part would fall below zero, the step goes against it instead. The prior
is estimated first, from a classifier of P against U: among texts that score above some
cut nearly all are positives, so that the share of U above it is c times the share of P.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, hashed_sample, map_batches, only, ticked, written
from .decision_list import RATIOS, with_ratios
from .text_stats import text_stats

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
# The classifier is fitted on at most so many positives and unlabelled texts, those of
# smallest hash; every text is scored.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 30_000
KNOTS, STEPS = 12, 600
FEATURES = [*RATIOS, "log_words"]


@dataclass(frozen=True)
class Model:
    knots: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, values: np.ndarray) -> np.ndarray:
        return _sigmoid(_spread(values, self.knots) @ self.weights + self.bias)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _spread(values: np.ndarray, knots: list[np.ndarray]) -> np.ndarray:
    """Each feature as its shares of the steps between its knots: a line with bends."""
    parts = []
    for i, k in enumerate(knots):
        width = np.maximum(np.diff(k), 1e-9)
        parts.append(np.clip((values[:, i : i + 1] - k[:-1]) / width, 0.0, 1.0))
    return np.concatenate(parts, axis=1)


def _knots(values: np.ndarray) -> list[np.ndarray]:
    found = []
    for column in values.T:
        k = np.unique(np.quantile(column, np.linspace(0, 1, KNOTS)))
        if k[-1] > k[0]:  # even steps too: rare values far out get bends of their own
            k = np.unique(np.concatenate([k, np.linspace(k[0], k[-1], KNOTS)]))
        found.append(k if len(k) > 1 else np.array([k[0] - 1, k[0]]))
    return found


def _minimise(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam with a falling rate."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled (rows of spread features, with a 1 at the end).

    Half of either set trains a classifier of one against the other; on the other half the
    ratio of shares above a cut is taken where its upper confidence bound is lowest. The
    halves then change places, and the two results are averaged.
    """
    found = []
    for half in (0, 1):
        p, q = positive[half::2], unlabelled[half::2]

        def gradient(w: np.ndarray, p=p, q=q) -> np.ndarray:
            up, down = _sigmoid(p @ w) - 1, _sigmoid(q @ w)
            return p.T @ up / len(p) + q.T @ down / len(q) + 1e-4 * w

        w = _minimise(gradient, p.shape[1], STEPS // 2)
        p_score = np.sort(positive[1 - half :: 2] @ w)
        q_score = np.sort(unlabelled[1 - half :: 2] @ w)
        cuts = p_score[:: max(1, len(p_score) // 200)]
        p_above = 1 - np.searchsorted(p_score, cuts) / len(p_score)
        q_above = 1 - np.searchsorted(q_score, cuts) / len(q_score)
        slack = 1.5 * (np.sqrt(1 / len(p_score)) + np.sqrt(1 / len(q_score)))
        wide = p_above > 0.05
        at = int(np.argmin((q_above[wide] + slack) / p_above[wide]))
        found.append(q_above[wide][at] / p_above[wide][at])
    return float(np.clip(np.mean(found), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Non-negative risk with logistic loss, so that the score is a probability."""
    knots = _knots(np.concatenate([positive, unlabelled]))
    one = lambda values: np.hstack([_spread(values, knots), np.ones((len(values), 1))])
    p, u = one(positive), one(unlabelled)
    if prior is None:
        prior = estimate_prior(p, u)
    keep = np.full(p.shape[1], 1e-4)
    keep[-1] = 0

    def gradient(w: np.ndarray) -> np.ndarray:
        on_p, on_u = _sigmoid(p @ w), _sigmoid(u @ w)
        as_negative = np.log1p(np.exp(np.minimum(u @ w, 30))).mean() - prior * np.log1p(
            np.exp(np.minimum(p @ w, 30))
        ).mean()
        negative = u.T @ on_u / len(u) - prior * (p.T @ on_p) / len(p)
        if as_negative < 0:
            return -negative + keep * w
        return prior * (p.T @ (on_p - 1)) / len(p) + negative + keep * w

    w = _minimise(gradient, p.shape[1], STEPS)
    return Model(knots, w[:-1], float(w[-1]), prior)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `held_out`, `score` and `predicted` of every row of `docs`.

    Only labels outside fold 2 are looked at, and of those only the trusted positives;
    the unlabelled texts are documents of the same folds. Labels, languages, sources and
    keys are no input of a score. A row without a key counts as held out. Empty and NULL
    texts are scored like any other, by their counts of zero. Without positives or
    unlabelled texts every score is 0.5. A repeated row gives a row each time.
    """
    stats = with_ratios(written(text_stats(docs, key, text))).withColumn(
        "log_words", F.log1p("n_words").cast("double")
    )
    learn = stats.where(fold("key", FOLDS) != HELD_OUT).select("key", *FEATURES)
    trusted = (
        only(labels, key=key, quality="quality")
        .where((fold("key", FOLDS) != HELD_OUT) & (F.col("quality") == 1))
        .select("key")
        .distinct()
    )

    def sample(rows: DataFrame, n: int) -> np.ndarray:
        # Copies have the same features and so stand together; the key's hash mixes them.
        picked = hashed_sample(rows, "key", n, *FEATURES).select(*FEATURES)
        return picked.toPandas().to_numpy(dtype=np.float64).reshape(-1, len(FEATURES))

    positive = sample(learn.join(trusted, "key"), MAX_POSITIVE)
    unlabelled = sample(learn, MAX_UNLABELLED)
    model = fit(positive, unlabelled) if len(positive) > 3 and len(unlabelled) > 3 else None

    def score(batch: pa.RecordBatch) -> pa.Table:
        values = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], axis=1)
        found = model.score(values) if model else np.full(batch.num_rows, 0.5)
        return pa.table(
            {
                key: batch.column("key"),
                "held_out": batch.column("held_out"),
                "score": pa.array(found),
                "predicted": pa.array((found >= CUT).astype(np.int32)),
            }
        )

    held_out = F.coalesce(fold("key", FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    kind = stats.schema["key"].dataType.simpleString()
    return map_batches(
        stats.select("key", held_out, *FEATURES),
        score,
        f"{ticked(key)} {kind}, held_out boolean, score double, predicted int",
    )
