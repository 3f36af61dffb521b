"""Naive Bayes support vectors: indicators scaled by class log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices_of, small_batches, string_buffer, text_or_empty, written

#: Labelled documents of each class that a model is fitted on, at most, and the most indicators of all of them together.
PER_CLASS, CLASS_CODES = 3000, 1 << 24
#: Bytes of text that one step of a task works on.
STEP = 1 << 18


@dataclass
class Model:
    """weights: of each indicator, ratio and support vectors multiplied; a text's margin is their sum over its
    indicators, divided by the root of the number of indicators if scaled, plus bias; score = sigmoid(slope * margin + shift)."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    scaled: bool

    def scores(self, doc: np.ndarray, code: np.ndarray, docs: int) -> np.ndarray:
        """doc, code: distinct (document number, indicator) pairs."""
        margin = np.bincount(doc, self.weights[code], docs)
        if self.scaled:
            margin = margin / np.sqrt(np.maximum(np.bincount(doc, minlength=docs), 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin + self.bias) + self.shift, -500, 500)))


def ratios(rows: list[np.ndarray], y: np.ndarray, dims: int, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts of documents of class 1 and 0 that have each indicator."""
    p, q = (alpha + sum((np.bincount(r, minlength=dims) for r, k in zip(rows, y, strict=True) if k == c), np.zeros(dims)) for c in (1, 0))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, *, cost: float = 1.0, epochs: int = 60, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias feature: (weights, bias) of least |w|^2 / 2 + cost * sum of max(0, 1 - y w x).

    Each dual variable stays within 0 and cost; epochs end when the projected gradients of one differ by under 1e-2 or so.
    """
    w, bias = np.zeros(dims), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) + 1 for v in values])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        low, high = np.inf, -np.inf
        for i in order:
            r, v = rows[i], values[i]
            gradient = sign[i] * (float(w[r] @ v) + bias) - 1
            free = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
            low, high = min(low, free), max(high, free)
            if free:
                new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
                step = (new - alpha[i]) * sign[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
        if high - low < 1e-2:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least weighted log loss with smoothed targets, by Newton steps."""
    n1, n0 = max(1, int((y == 1).sum())), max(1, int((y == 0).sum()))
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - t)) + 1e-6 * beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        beta = beta - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray, totals: tuple[int, int], dims: int, *, scaled: bool, least_ratio: float = 0.0, least_docs: int = 1, cost: float = 1.0) -> Model:
    """rows: distinct indicators of each document; totals: labelled documents of class 0 and 1, of which rows may be a sample.

    Indicators with a ratio under least_ratio or in fewer documents than least_docs weigh nothing. With one class or
    none in the sample the model answers the smoothed share of class 1.
    """
    n0, n1 = totals
    if not len(rows) or len(set(y.tolist())) < 2:
        share = (n1 + 1) / (n0 + n1 + 2)
        return Model(np.zeros(dims), 0.0, 0.0, float(np.log(share / (1 - share))), scaled)
    r = ratios(rows, y, dims)
    in_docs = sum((np.bincount(x, minlength=dims) for x in rows), np.zeros(dims))
    r[(np.abs(r) < least_ratio) | (in_docs < least_docs)] = 0
    values = [r[x] / (np.sqrt(max(1, len(x))) if scaled else 1.0) for x in rows]
    w, bias = coordinate_descent(rows, values, y, dims, cost=cost)
    margin = np.array([float(w[x] @ v) + bias for x, v in zip(rows, values, strict=True)])
    weight = np.where(y == 1, n1 / max(1, (y == 1).sum()), n0 / max(1, (y == 0).sum()))
    slope, shift = platt(margin, y, weight / weight.mean())
    return Model(w * r, bias, slope, shift, scaled)


Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, dims: int, *, per_class: int = PER_CLASS, class_codes: int = CLASS_CODES, prepare=None, **options) -> Model:
    """Fits on at most per_class labelled documents of each class, those with the least hashed doc_id outside the held-out fold.

    Each of them has all its indicators; if those of a class are more than class_codes, fewer documents are taken, in the
    same order, and one at least.
    labels: doc_id and label; null labels count as none, and of repeated ones the largest holds. Of rows with one doc_id the one
    with the last text is taken, so repeated rows don't add to the sample. Other columns than doc_id and text are not read.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("__wl_id")).agg(F.max("y").cast("int").alias("y"))
    count = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    pick = lambda c: known.where(F.col("y") == c).orderBy(F.xxhash64("__wl_id"), "__wl_id").limit(per_class)
    sample = F.broadcast(pick(0).unionByName(pick(1)))  # 2 * per_class ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = string_buffer(batch.column(1) if prepare is None else prepare(batch.column(1)))
            for i, j in slices_of(at, STEP):
                doc, code = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                edge = np.searchsorted(doc, np.arange(j - i + 1))
                got = [code[a:b].astype("<u4").tobytes() for a, b in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array(got, pa.binary())], ["y", "id", "codes"])

    spark = docs.sparkSession
    small_batches(spark)
    kind = known.schema["__wl_id"].dataType.simpleString()
    slim = docs.select("doc_id", text_or_empty().alias("text"))
    made = slim.join(sample, slim["doc_id"] == sample["__wl_id"]).groupBy("y", F.col("__wl_id").alias("id")).agg(F.max("text").alias("text")).select("y", "text", "id")
    made = written(made.mapInArrow(run, f"y int, id {kind}, codes binary"), "nbsvm-sample")
    taken, used = [], {0: 0, 1: 0}
    for r in made.groupBy("y", "id").agg(F.sum(F.length("codes") / 4).cast("long").alias("n")).orderBy("y", F.xxhash64("id"), "id").collect():  # 2 * per_class ids
        used[r.y] += r.n
        if used[r.y] <= class_codes or used[r.y] == r.n:
            taken.append((r.y, r.id))
    chosen = F.broadcast(spark.createDataFrame(taken, f"y int, id {kind}"))
    rows = made.join(chosen, ["y", "id"]).select("y", "codes").collect()  # bounded by per_class and class_codes
    rows.sort(key=lambda r: (r.y, bytes(r.codes)))
    return fit([np.frombuffer(bytes(r.codes), "<u4").astype(np.int64) for r in rows], np.array([r.y for r in rows], np.int64), (count.get(0, 0), count.get(1, 0)), dims, **options)


def scorer(spark, model: Model, features: Features, prepare=None):
    """An Arrow function from texts (no nulls) to scores."""
    held = spark.sparkContext.broadcast(model)
    small_batches(spark)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        raw, at = string_buffer(text if prepare is None else prepare(text))
        out = np.zeros(len(text))
        for i, j in slices_of(at, STEP):
            doc, code = features(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            out[i:j] = held.value.scores(doc, code, j - i)
        return pa.array(out)

    return score
