"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k | text) = sigmoid(w . x - t_k): one weight vector over hashed text
features for all grades, and ordered thresholds t_1 < t_2 < ...  The model
gives the expected grade and the tail probability of the lowest acceptable
grade, which selects documents.

It is fitted with numpy on a bounded, deterministic sample of rated documents
(`max_rows`); scoring is one pass over all documents, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from basketmine.llm import text_features as tf

MAX_ROWS = 8_000        # rated documents the model is fitted on
MIN_ROWS_OF_FEATURE = 4
EPOCHS, MIN_STEPS, BATCH, RATE, L1 = 12, 200, 500, 0.03, 2e-4   # small samples get more epochs


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray      # increasing, one per grade above the lowest

    def tails(self, dots: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one column each."""
        return tf.sigmoid(dots[:, None] - self.thresholds[None, :])


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first, then log gaps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int, seed: int = 7) -> OrdinalModel:
    """Maximum likelihood with an L1 penalty on the weights.

    Without rows, or with one grade only, the weights are 0 and the thresholds
    follow the smoothed shares of the grades.
    """
    share = np.array([(np.sum(grades >= k) + 0.5) / (len(grades) + 1.0) for k in range(1, n_grades)])
    free = np.zeros(n_grades - 1)
    start = -np.log(share / (1 - share))
    free[0] = start[0]
    free[1:] = np.log(np.maximum(np.diff(start), 0.1))
    w = np.zeros(tf.DIM)
    if len(set(grades.tolist())) > 1:
        keep = np.zeros(tf.DIM, bool)
        for k in range(1, n_grades):
            low = [f for f, g in zip(features, grades) if g < k]
            high = [f for f, g in zip(features, grades) if g >= k]
            keep |= tf.telling_features(low, high, least=MIN_ROWS_OF_FEATURE)
        x = tf.Sparse.restricted(features, keep)
        rng, opt, opt_t = np.random.default_rng(seed), tf.Adam(tf.DIM, RATE), tf.Adam(n_grades - 1, RATE)
        batches = -(-len(grades) // BATCH)
        for _ in range(max(EPOCHS, -(-MIN_STEPS // batches))):
            order = rng.permutation(len(grades))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                part, y = x.take(rows), grades[rows]
                d = part.dot(w)
                t = _thresholds(free)
                # Category probabilities: differences of neighbouring tails.
                tail = np.column_stack([np.ones(len(y)), tf.sigmoid(d[:, None] - t), np.zeros(len(y))])
                slope = tail * (1 - tail)
                i = np.arange(len(y))
                p = np.maximum(tail[i, y] - tail[i, y + 1], 1e-12)
                up, down = slope[i, y] / p, slope[i, y + 1] / p     # d log p by each tail's logit
                g_dot = -(up - down) / len(y)
                g_t = np.zeros((len(y), n_grades + 1))
                g_t[i, y] += up
                g_t[i, y + 1] -= down
                g_t = g_t[:, 1:-1].sum(axis=0) / len(y)
                gaps = np.exp(free[1:])
                g_free = np.concatenate([[g_t.sum()], [g_t[j:].sum() * gaps[j - 1]
                                                       for j in range(1, n_grades - 1)]])
                opt.step(w, part.pull(g_dot), L1)
                opt_t.step(free, g_free)
    return OrdinalModel(w, _thresholds(free))


def train(docs: DataFrame, ratings: DataFrame, *, n_grades: int, doc_id: str = "doc_id",
          text: str = "text", grade: str = "grade", max_rows: int = MAX_ROWS) -> OrdinalModel:
    """Fit on at most `max_rows` rated documents (`ratings`: doc_id, grade in 0..n_grades-1).

    Rows with a null id or grade, or without a document, take no part.
    """
    rated = ratings.filter(ratings[grade].isNotNull())
    rows, x = tf.labelled_sample(docs, rated, max_rows, doc_id=doc_id, text=text, columns=[grade])
    return fit(x, np.array([r[0] for r in rows], dtype=np.int64), n_grades)


def grade_column(text: Column, model: OrdinalModel, accept: int = 1) -> Column:
    """Struct of expected_grade, tail = P(grade >= accept) and grade, the likeliest grade.

    A null text scores as an empty one.
    """
    def make(dots: np.ndarray) -> pd.DataFrame:
        tails = model.tails(dots)
        full = np.column_stack([np.ones(len(dots)), tails, np.zeros(len(dots))])
        return pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail": tails[:, accept - 1],
                             "grade": (full[:, :-1] - full[:, 1:]).argmax(axis=1).astype("int32")})

    return tf.score_column(text, model.weights, "expected_grade double, tail double, grade int", make)
