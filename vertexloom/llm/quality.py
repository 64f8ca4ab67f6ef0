"""Quality classifier by positive-unlabelled learning with a non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, pieces
from .linear import N_DENSE, averaged_descent, dense_features, feature_table, labelled, linear_scores, matrix, moments, scored, sigmoid, summed

#: At most so many labelled rows are read for fitting; their positives stand for the trusted class.
LABELLED_ROWS = 20_000
BINS = 400


def estimated_prior(unlabelled: np.ndarray, positive: np.ndarray, least: float = 0.1) -> float:
    """Class prior from score histograms: the smallest ratio of the tails of unlabelled and positive scores.

    For a threshold t, P_u(score < t) >= prior * P_p(score < t) and the same for
    the upper tail; both tails bound the prior from above. Only tails holding
    `least` of the positives count, so noise in thin tails does not decide.
    """
    if not unlabelled.sum() or not positive.sum():
        return 0.5
    u, p = unlabelled / unlabelled.sum(), positive / positive.sum()
    upper_u, upper_p = np.cumsum(u[::-1]), np.cumsum(p[::-1])
    lower_u, lower_p = np.cumsum(u), np.cumsum(p)
    ratios = np.concatenate([upper_u[upper_p >= least] / upper_p[upper_p >= least], lower_u[lower_p >= least] / lower_p[lower_p >= least]])
    return float(np.clip(ratios.min(), 0.02, 0.98))


def drawn(pos: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """The positives of a step: all, or `most` drawn from all."""
    return pos[rng.integers(0, len(pos), most)] if len(pos) > most else pos


class Fitted(NamedTuple):
    table: DataFrame  # doc_id, fold, x of every document
    weights: np.ndarray
    mean: np.ndarray
    dev: np.ndarray


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, rounds: int = 6) -> Fitted:
    """The classifier and the features it was fitted on.

    Trusted positives are training rows labelled 1 (at most `bound` labelled rows
    are read). All documents are the unlabelled sample. A first model separates
    the two, its score histograms give the class prior, then a linear model
    minimises the non-negative unbiased risk
    ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` under the logistic loss.
    Labels of 0 are not used.

    Without positives all weights are 0, so every score is 0.5.
    """
    stage = Stage(docs.sparkSession, "quality")
    table = stage.write(feature_table(docs, dense_features), "features")
    known = labelled(labels, "quality", bound).where("y = 1").select("doc_id")
    held = table.join(known, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("x").limit(bound).collect()
    mean, dev, n = moments(table, N_DENSE)
    w = np.zeros(N_DENSE + 1)
    if held and n:
        raw = np.array([r.x for r in held], np.float32)  # goes to every task; half the size of the scaled rows

        def scaled(x):
            return np.hstack([(x.astype(np.float64) - mean) / dev, np.ones((len(x), 1))]).clip(-8, 8)

        def naive(v, x, _, rng):
            part = scaled(drawn(raw, 512, rng))
            return -(part * (1 - sigmoid(part @ v))[:, None]).mean(0) / 2 + (x * sigmoid(x @ v)[:, None]).mean(0) / 2 + 1e-3 * v

        w = averaged_descent(table, w, naive, 2, 0.05, mean, dev)

        def histogram(batches):
            h = np.zeros(BINS)
            for b in batches:
                x = np.hstack([(matrix(b) - mean) / dev, np.ones((b.num_rows, 1))]).clip(-8, 8)
                h += np.bincount((sigmoid(x @ w) * (BINS - 1)).astype(int), minlength=BINS)
            return h

        prior = estimated_prior(summed(table, histogram, BINS), np.bincount((sigmoid(scaled(raw) @ w) * (BINS - 1)).astype(int), minlength=BINS))

        def risk(v, x, _, rng):
            part = scaled(drawn(raw, 1024, rng))
            up, uu = sigmoid(part @ v), sigmoid(x @ v)
            rest = np.log1p(np.exp(np.clip(x @ v, -40, 40))).mean() - prior * np.log1p(np.exp(np.clip(part @ v, -40, 40))).mean()
            plus = -prior * (part * (1 - up)[:, None]).mean(0)
            minus = (x * uu[:, None]).mean(0) - prior * (part * up[:, None]).mean(0)
            return plus + (minus if rest >= 0 else -minus) + 1e-3 * v

        w = averaged_descent(table, w, risk, rounds, 0.05, mean, dev)
    return Fitted(table, w, mean, dev)


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS, rounds: int = 6) -> DataFrame:
    """doc_id, held_out, score of every document, by `fit_quality`.

    Null and empty texts get a score from their (zero) features. Rows with repeated
    or null ids are scored each; a null id is not held out. Without positives every
    score is 0.5; an empty table gives no rows. Other columns are ignored.
    """
    return scored(*fit_quality(docs, labels, bound, rounds))


def without_low(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The documents that score `least` or more; all columns stay.

    Every row is judged by its own text as it passes, so null and repeated ids do
    not matter, columns may have any names, and no document is shuffled.
    """
    _, w, mean, dev = fit_quality(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in pieces(batch, "text"):
                yield part.filter(pa.array(linear_scores(dense_features(buf, off).astype(np.float32), w, mean, dev) >= least))

    return docs.mapInArrow(run, docs.schema)




def op10_quality(spark, sf_dir: str) -> DataFrame:
    out = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
