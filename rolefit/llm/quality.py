"""Operator 2: quality classifier, naive Bayes features in a linear hinge-loss model (NBSVM)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm import _hashing as H
from rolefit.llm._work import id_and_text, mapped, text_chunks

#: Hashed features: runs of so many bytes, and words; each kind hashes to FEATURES buckets in all.
RUNS, FEATURES = (2, 4), 1 << 18


class Model(NamedTuple):
    weights: np.ndarray  # log-count ratio times hinge-loss weight
    ratios: np.ndarray
    bias: float
    slope: float
    shift: float


def text_features(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its distinct n-gram buckets (indicator features), over the whole text."""
    values, place = H.table(2), np.zeros(FEATURES, np.int64)
    for _, _, data, offsets in text_chunks(column):
        p, back = H.prefix_hash(data, values), H.unshift(len(data) + 1)
        runs = [(H.mix((p[n:] - p[:-n]) * back[: len(p) - n] + H.U(n)) % H.U(FEATURES)).astype(np.int64) for n in RUNS]
        starts, _, words = H.word_hashes(data, values)
        words, bounds = (words % H.U(FEATURES)).astype(np.int64), np.searchsorted(starts, offsets)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist(), strict=True)):
            own = np.concatenate([*(r[a : max(a, b - n + 1)] for n, r in zip(RUNS, runs, strict=True)), words[bounds[k] : bounds[k + 1]]])
            order = np.arange(len(own))
            place[own] = order
            yield own[place[own] == order]


def hinge_fit(rows: list[np.ndarray], targets: np.ndarray, ratios: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; rows are indicator buckets, scaled by `ratios` to unit length. Classes weigh alike."""
    w, bias, alpha = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    scaled = [ratios[r] / max(1e-9, np.linalg.norm(ratios[r])) for r in rows]
    share = {t: len(rows) / (2 * max(1, int((targets == t).sum()))) for t in (-1, 1)}
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            y, x, r = targets[i], scaled[i], rows[i]
            gradient = y * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (x @ x + 1), 0.0), cost * share[int(y)])
            step = (new - alpha[i]) * y
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def calibrate(margins: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton steps on smoothed labels."""
    high, low = (targets > 0).sum(), (targets < 0).sum()
    y = np.where(targets > 0, (high + 1) / (high + 2), 1 / (low + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        g, v = p - y, p * (1 - p) + 1e-9
        h = np.array([[v @ margins**2 + 1e-3, v @ margins], [v @ margins, v.sum() + 1e-3]])
        step = np.linalg.solve(h, [g @ margins, g.sum()])
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, docs = np.zeros((2, FEATURES), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for label, own in zip(batch.column("label").to_pylist(), text_features(batch.column("text")), strict=True):
            counts[label, own] += 1
            docs[label] += 1
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[0, used], docs[0])), pa.array(np.append(counts[1, used], docs[1]))], names=["feature", "low", "high"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([own.astype(np.int32).tobytes() for own in text_features(batch.column("text"))], pa.binary())], names=["label", "own"])


def fit(labelled: DataFrame, fit_rows: int = 2000) -> Model:
    """Fits on `labelled` (text, label 0 or 1, doc_id). Log-count ratios count over all its rows; the hinge-loss model takes at most
    `fit_rows` rows, half of each label, least hash of the id first. Without rows of both labels every score is 0.5 or the label's.
    """
    counted = mapped(labelled.select("label", "text"), _counter, "feature long, low long, high long").groupBy("feature").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).toPandas()
    counts, docs = np.ones((2, FEATURES)), np.zeros(2)
    known = counted.feature.to_numpy() >= 0
    for k, name in enumerate(("low", "high")):
        counts[k, counted.feature[known]] += counted[name][known]
        docs[k] = counted[name][~known].sum()
    if not docs.all():
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, float(8 * np.sign(docs[1] - docs[0])))
    ratios = np.log(counts[1] / (docs[1] + 2)) - np.log(counts[0] / (docs[0] + 2))
    hashed = labelled.withColumn("h", F.xxhash64("doc_id"))
    chosen = [r["h"] for k in (0, 1) for r in hashed.where(F.col("label") == k).select("h").distinct().orderBy("h").limit(fit_rows // 2).collect()]
    sample = mapped(hashed.where(F.col("h").isin(chosen)).dropDuplicates(["h", "label"]).select("label", "text"), _featured, "label int, own binary").toPandas().sort_values(["label", "own"])
    rows, targets = [np.frombuffer(x, np.int32) for x in sample.own], np.where(sample.label == 1, 1, -1)
    norms = [max(1e-9, np.linalg.norm(ratios[r])) for r in rows]
    aside = np.random.default_rng(3).random(len(rows)) < 0.25
    if min((targets[~aside] == t).sum() for t in (-1, 1)) and min((targets[aside] == t).sum() for t in (-1, 1)):
        w, bias = hinge_fit([rows[i] for i in np.flatnonzero(~aside)], targets[~aside], ratios)
        slope, shift = calibrate(np.array([w[rows[i]] @ ratios[rows[i]] / norms[i] + bias for i in np.flatnonzero(aside)]), targets[aside])
    else:
        slope, shift = 2.0, 0.0
    w, bias = hinge_fit(rows, targets, ratios)
    return Model(w * ratios, ratios, bias, slope, shift)


def _scores(m: Model, texts: pa.Array) -> np.ndarray:
    margins = [m.weights[own].sum(dtype=np.float64) / max(1e-9, float(np.sqrt((m.ratios[own].astype(np.float64) ** 2).sum()))) + m.bias for own in text_features(texts)]
    return 1 / (1 + np.exp(-np.clip(m.slope * np.array(margins, float) + m.shift, -30, 30)))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the chance that its quality is 1. A null text counts as empty, whose score is that of the bias."""
    model = model._replace(weights=model.weights.astype(np.float32), ratios=model.ratios.astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers twice, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(sent.value, batch.column("text")))], names=["doc_id", "score"])

    return mapped(id_and_text(docs, id_col, text_col), score, "doc_id long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """(doc_id, text, label) of the labelled documents that may teach: crc32 of the id as text, modulo 4, is not 2. Null and other labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and not " + HELD_OUT)
    return id_and_text(docs, "doc_id", "text").join(known.hint("merge"), "doc_id")


HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 2000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of `docs`; the model sees only texts and labels of rows that aren't held out.

    Null or empty texts are scored too; null ids aren't held out; repeated rows each get their row; an empty table gives no rows.
    """
    scored = score_texts(docs, fit(labelled_rows(docs, labels), fit_rows))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = 2000) -> DataFrame:
    """The rows of `docs` (doc_id, text and any other columns) whose score is `threshold` or more, in one pass without a join."""
    model = fit(labelled_rows(docs, labels), fit_rows)
    sent = docs.sparkSession.sparkContext.broadcast(model._replace(weights=model.weights.astype(np.float32), ratios=model.ratios.astype(np.float32)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(sent.value, batch.column("text")) >= threshold))

    return mapped(docs, keep, docs.schema)
