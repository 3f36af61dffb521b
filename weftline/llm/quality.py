"""Quality classifier: Naive Bayes support vectors over indicators of byte trigrams, size and repetition."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbsvm
from .common import held_out, table, text_or_empty

#: Indicators, those of them that aren't trigrams, and the score from which a document passes.
DIMS, OWN, THRESHOLD = 1 << 18, 64, 0.3
#: Bytes from which repetition is told.
LONG = 200


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, indicator) pairs in order: hashed byte trigrams, and of each text the size class (powers of
    two) and, from LONG bytes on, the class of its distinct trigrams per byte, which repetition lowers."""
    n = np.diff(offsets)
    texts = np.arange(len(n), dtype=np.int64)
    key = np.zeros(0, np.int64)
    if len(raw) >= 3:
        x = raw.astype(np.uint32)
        code = ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761) >> np.uint32(14)) % np.uint32(DIMS - OWN)
        inside = np.repeat(offsets[1:], n)[:-2] - np.arange(len(raw) - 2) >= 3
        key = np.unique((np.repeat(texts, n)[:-2] << 18 | code.astype(np.int64))[inside])
    size = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), 31)
    rich = np.minimum(16 * np.bincount(key >> 18, minlength=len(n)) // np.maximum(n, 1), 15) + 32
    key = np.sort(np.concatenate([key, texts << 18 | DIMS - OWN + size, (texts << 18 | DIMS - OWN + rich)[n >= LONG]]), kind="stable")
    return key >> 18, key & (DIMS - 1)


def quality_model(docs: DataFrame, labels: DataFrame, **options) -> nbsvm.Model:
    return nbsvm.train(docs, labels, "quality", trigrams, DIMS, scaled=True, **options)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Scores each whole text by a model that is fitted on at most nbsvm.PER_CLASS labelled documents of each class.

    docs: doc_id, text and others; labels: doc_id, quality. Returns doc_id, held_out, score, predicted, a row
    for each row. Texts of any length are read whole. Null text counts as empty; empty texts have only the indicator of their
    size class. Without labels of both classes every score is the smoothed share of class 1. Repeated rows get equal scores; other
    columns, whatever their names, are ignored. Empty tables give empty tables.
    """
    score = nbsvm.scorer(docs.sparkSession, quality_model(docs, labels, **options), trigrams)
    out = docs.select("doc_id", held_out().alias("held_out"), score(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents with a score of threshold or more, with all their columns."""
    score = nbsvm.scorer(docs.sparkSession, quality_model(docs, labels, **options), trigrams)
    return docs.withColumn("__wl_score", score(text_or_empty())).where(F.col("__wl_score") >= threshold).select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
