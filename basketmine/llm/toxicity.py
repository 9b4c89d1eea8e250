"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are needed.  With class
prior p, positives P and unlabelled U, the risk of a classifier f is

    p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])

with the logistic loss l.  The part in max() estimates the risk on negatives;
when it turns negative, f has begun to fit the positives hidden in U, and the
step goes the other way.  p must be the share of positives in U.

The classifier is linear over hashed text features, fitted with numpy on a
bounded, deterministic sample; scoring is one pass over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmine.llm import text_features as tf

MAX_POSITIVE, MAX_UNLABELLED = 3_000, 8_000     # documents the model is fitted on
MIN_ROWS_OF_FEATURE = 4
STEPS, RATE = 150, 0.03                        # full-batch steps


@dataclass
class LinearModel:
    weights: np.ndarray
    bias: float


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> LinearModel:
    """Non-negative PU training.  Without positives (or unlabelled) the score is the prior."""
    prior = float(min(max(prior, 1e-4), 1 - 1e-4))
    w, b = np.zeros(tf.DIM), np.array([np.log(prior / (1 - prior))])
    if not positive or not unlabelled:
        return LinearModel(w, float(b[0]))
    keep = tf.telling_features(positive, unlabelled, least=MIN_ROWS_OF_FEATURE)
    xp, xu = tf.Sparse.restricted(positive, keep), tf.Sparse.restricted(unlabelled, keep)
    opt, opt_b = tf.Adam(tf.DIM, RATE), tf.Adam(1, RATE)
    for _ in range(STEPS):
        fp, fu = xp.dot(w) + b, xu.dot(w) + b
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        # Gradients by the scores: of the positive part, and of the estimated negative part.
        pos_p = -prior * tf.sigmoid(-fp) / len(fp)
        neg_p, neg_u = -prior * tf.sigmoid(fp) / len(fp), tf.sigmoid(fu) / len(fu)
        gp, gu = (pos_p + neg_p, neg_u) if negative >= 0 else (-neg_p, -neg_u)
        opt.step(w, xp.pull(gp) + xu.pull(gu))
        opt_b.step(b, np.array([gp.sum() + gu.sum()]))
    return LinearModel(w, float(b[0]))


def train(docs: DataFrame, labels: DataFrame, *, unlabelled_ids: DataFrame, prior: float,
          doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> LinearModel:
    """Fit on bounded samples of the toxic documents and of `unlabelled_ids` (doc_id).

    `prior` is the share of toxic documents among `unlabelled_ids`.
    """
    toxic = labels.filter(F.col(label) == 1)
    _, p = tf.labelled_sample(docs, toxic, max_positive, doc_id=doc_id, text=text, columns=[])
    _, u = tf.labelled_sample(docs, unlabelled_ids, max_unlabelled, doc_id=doc_id, text=text, columns=[])
    return fit(p, u, prior)


def class_prior(labels: DataFrame, label: str = "toxic") -> float:
    """Share of toxic rows among the labelled ones, smoothed."""
    r = labels.agg(F.count_if(F.col(label) == 1).alias("p"), F.count(label).alias("n")).first()
    return (r["p"] + 0.5) / (r["n"] + 1.0)


def score_column(text: Column, model: LinearModel) -> Column:
    """Probability that a text is toxic, 0 to 1; a null text scores as an empty one."""
    def make(dots: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"score": tf.sigmoid(dots + model.bias)})

    return tf.score_column(text, model.weights, "score double", make)["score"]
