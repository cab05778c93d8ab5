"""Operator 10, quality classifier: naive Bayes support vectors.

A text is the set of byte n-grams (one to three bytes) it holds, plus marks for
a word that follows itself. Each indicator is scaled by the log-count ratio of
the classes, rows are brought to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent. A logistic curve, fitted on rows the model
did not see, turns margins into scores.

Bound of the fit: at most `SAMPLE` labelled rows, the first by a hash of their
doc_id, that are not held out. Everything else covers all rows. Labels,
language, source and doc_id are no inputs of a score.

Defined results: a null or empty text has the margin of the bias alone; without
labelled rows, or with one class, every score is the smoothed share of label 1;
repeated labels and repeated documents of one doc_id are one row of the fit (of
several texts, the one of the least features); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, table

SAMPLE, DIM_BITS, EPOCHS, COST = 8192, 18, 12, 1.0
#: Hashed n-grams, then four marks for words that follow themselves.
_HASHED = 1 << DIM_BITS
_DIM = _HASHED + 4
_GROUP = np.uint32(0x9E3779B1)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def indicators(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text, read in bounded pieces."""
    seen = np.zeros(_DIM, bool)
    text = text or b""
    for at in range(0, len(text), 1 << 18):
        b = np.frombuffer(text[at : at + (1 << 18) + 2], np.uint8).astype(np.uint32)
        seen[(b + np.uint32(1 << 24)) * _GROUP >> np.uint32(32 - DIM_BITS)] = True
        if len(b) > 1:
            two = b[:-1] << np.uint32(8) | b[1:]
            seen[(two + np.uint32(2 << 24)) * _GROUP >> np.uint32(32 - DIM_BITS)] = True
        if len(b) > 2:
            three = two[:-1] << np.uint32(8) | b[2:]
            seen[(three + np.uint32(3 << 24)) * _GROUP >> np.uint32(32 - DIM_BITS)] = True
    words = text.split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    for mark in range(min(4, int(same * 20 / max(1, len(words)) + (same > 0)))):
        seen[_HASHED + mark] = True
    return np.flatnonzero(seen)


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, offset) from (label, features) rows in a fixed order."""
    labels = np.array([y for y, _ in rows])
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return np.zeros(_DIM), 0.0, 0.0, float(np.log(share / (1 - share)))
    tuned = np.arange(len(rows)) % 4 == 3  # for the curve alone
    if len(set(labels[tuned].tolist())) < 2 or len(set(labels[~tuned].tolist())) < 2:
        tuned[:] = False
    counts = np.ones((2, _DIM))
    for (y, x), out in zip(rows, tuned, strict=True):
        if not out:
            counts[y, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = [(1.0 if y else -1.0, x) for (y, x), out in zip(rows, tuned, strict=True) if not out]
    weights = balanced_descent(train, ratio)
    bias, scaled = weights[-1], weights[:-1] * ratio

    def margin(x: np.ndarray) -> float:
        return float(scaled[x].sum() / max(1e-12, np.sqrt((ratio[x] ** 2).sum()))) + bias if len(x) else bias

    chosen = tuned if tuned.any() else np.ones(len(rows), bool)
    margins = np.array([margin(x) for (_, x), use in zip(rows, chosen, strict=True) if use])
    slope, offset = logistic(margins, labels[chosen])
    return np.stack([scaled, ratio**2]), float(bias), slope, offset


def balanced_descent(train: list[tuple[float, np.ndarray]], ratio: np.ndarray) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; both classes weigh the same. The last weight is the bias."""
    n_pos = sum(y > 0 for y, _ in train)
    cost = {1.0: COST * len(train) / (2 * n_pos), -1.0: COST * len(train) / (2 * (len(train) - n_pos))}
    weights, alpha = np.zeros(_DIM + 1), np.zeros(len(train))
    norms = [max(1e-12, float(np.sqrt((ratio[x] ** 2).sum()))) for _, x in train]
    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            y, x = train[i]
            values = ratio[x] / norms[i]
            gradient = y * (float(weights[x] @ values) + weights[-1]) - 1
            square = (1.0 if len(x) else 0.0) + 1.0
            new = min(max(alpha[i] - gradient / square, 0.0), cost[y])
            if new != alpha[i]:
                weights[x] += (new - alpha[i]) * y * values
                weights[-1] += (new - alpha[i]) * y
                alpha[i] = new
    return weights


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with smoothed targets."""
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def train_model(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> tuple[np.ndarray, float, float, float]:
    """The model of the bounded sample. Features are made where the texts are; one task fits them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    picked = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id")  # at most `sample` rows of two numbers

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [indicators(t).astype(np.int32).tobytes() for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(own, pa.binary())], names=["doc_id", "quality", "features"])

    def fit_all(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "quality"]).sample(frac=1.0, random_state=11)
        model = fit([(int(y), np.frombuffer(x, np.int32)) for y, x in zip(pdf["quality"], pdf["features"], strict=True)])
        return pd.DataFrame([{"weights": np.asarray(model[0], np.float32).tobytes(), "bias": model[1], "slope": model[2], "offset": model[3]}])

    found = (
        rows.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, features binary")
        .groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
        .groupBy(F.lit(0).alias("all")).applyInPandas(fit_all, "weights binary, bias double, slope double, offset double").collect()
    )
    if not found:
        return np.zeros((2, _DIM), np.float32), 0.0, 0.0, 0.0
    row = found[0]
    weights = np.frombuffer(bytes(row["weights"]), np.float32)
    return (weights.reshape(2, -1) if len(weights) == 2 * _DIM else np.zeros((2, _DIM), np.float32)), row["bias"], row["slope"], row["offset"]


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float, float, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, squares), bias, slope, offset = shared.value
        for batch in batches:
            scores = []
            for text in as_bytes(batch.column("text")):
                x = indicators(text)
                size = float(np.sqrt(squares[x].astype(np.float64).sum())) if len(x) else 0.0
                margin = bias + (float(weights[x].astype(np.float64).sum()) / size if size > 0 else 0.0)
                scores.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train_model(docs, table(spark, sf_dir, "labels")))
