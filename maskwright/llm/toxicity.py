"""Toxicity by class-conditional Kneser-Ney character models.

One model of toxic and one of ordinary text share the counts of their lowest orders, to which rare expressions back off.
For each text the two log-likelihoods are compared per symbol, over the whole text and over each of its words; a logistic
function of the mean, of the strongest words and of the number of strong ones gives the score. It is fitted on labelled
training rows set apart from the counting by a hash, about CALIBRATION_ROWS at most; the models count all the others.

Cases: null texts and texts without letters get the score of no evidence; rows without a label are not learned from; rows
with several labels count as toxic if one says so; with labels of one class only every score is that class's share; null
ids have no label; repeated rows count each; labels, lang and source play no part in a score, other columns none at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import materialize, small_batches

ORDER = 5
SHARED = 2
CALIBRATION_ROWS = 20_000
STRONG = 6.0  # log-likelihood ratio of a word that counts as strong
FEATURES = 5


def _features(part: pa.RecordBatch, model: kn.Model) -> np.ndarray:
    sym, offsets = kn.symbols(part.column("text"))
    code, offsets = kn.codes(sym, offsets, model.order)
    index, values = model.log_p(code)
    ratio = (values[:, 1] - values[:, 0])[index] if len(code) else np.zeros(0)
    n = np.diff(offsets)
    out = np.zeros((len(n), FEATURES))
    out[:, 0] = 100 * kn.sums(ratio, offsets) / np.maximum(n, 1)
    if len(code):
        # A word ends with the space behind it, or with its text.
        end = (code & (kn.SYMBOLS - 1)) == kn.SPACE_ID
        end[offsets[1:][n > 0] - 1] = True
        ends = np.flatnonzero(end) + 1
        starts = np.concatenate([[0], ends[:-1]])
        word = np.add.reduceat(ratio, starts)
        bounds = np.searchsorted(ends, offsets, side="right")
        for i in np.flatnonzero(n):
            own = word[bounds[i] : bounds[i + 1]]
            if len(own):
                top = np.sort(np.partition(own, -3)[-3:] if len(own) > 3 else own)[::-1]
                out[i, 1] = top[0]
                out[i, 2] = np.maximum(top, 0).sum()
                out[i, 3] = np.log1p((own > STRONG).sum())
                out[i, 4] = np.log1p(len(own))
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last) of a ridge logistic regression by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.r_[np.full(z.shape[1] - 1, 0.1), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def score(docs: DataFrame, labels: DataFrame, training=None, order: int = ORDER) -> DataFrame:
    """(doc_id, score, predicted); training is a condition on doc_id for the labels that may be used."""
    spark = docs.sparkSession
    small_batches(spark)
    if training is not None:
        labels = labels.where(training)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("cls"))
    known = materialize(known)
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    schema = docs.select("doc_id").schema.add("score", "double").add("predicted", "integer")
    both = {r.cls: r["count"] for r in known.groupBy("cls").count().collect()}
    if len(both) < 2:
        share = float(max(both, default=0))
        return docs.select("doc_id", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    # One labelled row in four, or fewer in a large corpus, is for calibration; all others are counted.
    apart = kn.set_apart(labelled.count(), CALIBRATION_ROWS, 0.25, "doc_id", "text")
    counts = kn.ngram_counts(labelled.where(~apart).select("cls", "text"), order)
    scorer = kn.Scorer(kn.model_table(counts, order, SHARED), order, 2)

    def measure(part, model):
        return pa.RecordBatch.from_arrays([part.column("cls"), pa.array(list(_features(part, model)), pa.list_(pa.float64()))], ["cls", "x"])

    sample = labelled.where(apart).select("cls", "text")
    seen = scorer.run(sample, measure, "cls int, x array<double>").collect()
    if len({r.cls for r in seen}) == 2:
        mean, scale, w = _fit(np.array([r.x for r in seen]), np.array([r.cls for r in seen], float))
    else:  # too few rows to fit: the strongest word decides
        mean, scale, w = np.zeros(FEATURES), np.ones(FEATURES), np.r_[np.eye(FEATURES)[1], -2 * STRONG]

    def predict(part, model):
        z = np.c_[(_features(part, model) - mean) / scale, np.ones(part.num_rows)] @ w
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return scorer.run(docs.select("doc_id", "text"), predict, schema)
