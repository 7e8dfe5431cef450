"""Language ID with one Kneser-Ney character model per language.

A text goes to the language of the lowest cross-entropy per symbol. On training rows set apart from the counting, the
sharpness of the score is fitted and the score is found below which texts are marked as rejected (one in a hundred of the
rightly recognised ones). That calibration takes about CALIBRATION_ROWS rows at most, by a hash; the models count all others.

Cases: null texts and texts without letters are "und" with score 0; rows without a language are not learned from; without
any learned language all is "und"; null ids count as an empty id for the split; repeated rows count each; the columns
lang and source play no part in a prediction, other columns none at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .common import small_batches

ORDER = 4
CALIBRATION_ROWS = 20_000
REJECTED_SHARE = 0.01
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


def split_of(buckets: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(buckets))


def _entropies(part: pa.RecordBatch, model: kn.Model) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per language of each text, symbols of each text)."""
    code, offsets = kn.codes(*kn.symbols(part.column("text")), model.order)
    index, values = model.log_p(code)
    n = np.diff(offsets)
    return np.stack([-kn.sums(values[index, c], offsets) / np.maximum(n, 1) for c in range(model.classes)], axis=1), n


def _posterior(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    z = -sharpness * (entropy - entropy.min(axis=1, keepdims=True))
    z = np.exp(z)
    return z / z.sum(axis=1, keepdims=True)


def identify(docs: DataFrame, training=None, order: int = ORDER) -> DataFrame:
    """(doc_id, lang_pred, score, rejected); training is a condition on docs (all rows with a language if None)."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if training is not None:
        usable = usable.where(training)
    sizes = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(sizes)
    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    if not names:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    number = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(names)])
    # One training row in twenty, or fewer in a large corpus, is for calibration; all others are counted.
    apart = kn.set_apart(sum(sizes.values()), CALIBRATION_ROWS, 0.05, "doc_id", "text")
    counts = kn.ngram_counts(usable.where(~apart).select(number.alias("cls"), "text"), order)
    scorer = kn.Scorer(kn.model_table(counts, order), order, len(names))

    def measure(part, model):
        entropy, n = _entropies(part, model)
        return pa.RecordBatch.from_arrays([part.column("cls"), pa.array(n), pa.array(list(entropy), pa.list_(pa.float64()))], ["cls", "n", "entropy"])

    sample = usable.where(apart).select(number.alias("cls"), "text")
    seen = [r for r in scorer.run(sample, measure, "cls int, n long, entropy array<double>").collect() if r.n]
    sharpness, least = SHARPNESS[3], 0.0
    if seen:
        entropy, truth = np.array([r.entropy for r in seen]), np.array([r.cls for r in seen])
        loss = [-np.log(np.maximum(_posterior(entropy, s)[np.arange(len(truth)), truth], 1e-9)).mean() for s in SHARPNESS]
        sharpness = SHARPNESS[int(np.argmin(loss))]
        right = entropy.argmin(axis=1) == truth
        if right.any():
            least = float(np.quantile(_posterior(entropy, sharpness).max(axis=1)[right], REJECTED_SHARE))

    def predict(part, model):
        entropy, n = _entropies(part, model)
        score = np.where(n > 0, _posterior(entropy, sharpness).max(axis=1), 0.0)
        best = [names[k] if m else "und" for k, m in zip(entropy.argmin(axis=1).tolist(), n.tolist())]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(best, pa.string()), pa.array(score), pa.array((score < least) | (n == 0))], ["doc_id", "lang_pred", "score", "rejected"])

    return scorer.run(docs.select("doc_id", "text"), predict, schema)
