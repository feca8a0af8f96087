"""Operator 4, quality classifier: naive Bayes support vectors.

A text's features are indicators of its byte 1- to 3-grams (hashed to 2**BITS numbers) and of runs of one word 2 to 8
times over. Class counts of every feature come from all labelled training rows, summed on the executors; each indicator
is scaled by its log-count ratio, and a linear hinge-loss model is fitted to the scaled indicators by dual coordinate
descent. The fit alone uses a bounded sample: `sample` labelled rows, chosen by a hash of doc_id. Margins of held-apart
halves of the sample give the sigmoid that turns a margin into a score.

Cases: a null or empty text has no features and gets the score of the bias; labels that are null or contradict each
other are not learned from; without rows of both classes the score is the smoothed share of label 1; a null doc_id is
held out; repeated rows count and are scored each time; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, lean, small, stored

BITS = 16
RUNS = 8
SAMPLE = 10_000
THRESHOLD = 0.3
ROWS = 500  # at a time in a worker
RUN_FEATURES = 16  # numbers of their own, before those of n-grams
LABEL_ROW_BYTES = 16
WORDS = re.compile(WORD)


def features(text: str) -> np.ndarray:
    """The numbers of the indicators that a text sets, ascending."""
    b = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.uint32)
    on = np.zeros((1 << BITS) + RUN_FEATURES, bool)
    h = b
    for n in (1, 2, 3):
        if n > 1:
            if len(b) < n:
                break
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] * np.uint32(2654435761)
        x = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(n * 77777)
        on[RUN_FEATURES + (x >> np.uint32(32 - BITS))] = True
    words = WORDS.findall(text)
    run = best = 1
    for a, c in zip(words, words[1:], strict=False):
        if a == c:
            run += 1
            if run > best:
                best = run
        else:
            run = 1
    on[2 : min(best, RUNS) + 1] = True
    return np.flatnonzero(on)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * (self.weights[found].sum() + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = 0.1, epochs: int = 10) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model over the scaled indicators, one dual variable at a time."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    norm = np.array([(ratio[x] ** 2).sum() + 1 for x in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, s = rows[i], signs[i]
            slack = s * ((w[x] * ratio[x]).sum() + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost)
            if new != alpha[i]:
                step = (new - alpha[i]) * s
                w[x] += step * ratio[x]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-5:
            break
    return w * ratio, bias


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by Newton steps on smoothed targets."""
    up, n = labels.sum(), len(labels)
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margins + b)))
        g = np.array([((p - target) * margins).sum() + 1e-6 * a, (p - target).sum()])
        v = p * (1 - p) + 1e-12
        hess = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from docs(doc_id, text) and labels(doc_id, label 0 or 1), without the rows of fold 0."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("y2")).where("y = y2").select("doc_id", "y").where(fold() != 0)
    n = known.count()
    rate = 1.0 if n <= sample else sample / n
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30))
    rows = docs.select("doc_id", "text").join(small(known, n, LABEL_ROW_BYTES), "doc_id").select("text", "y", pick.alias("pick"))
    size = (1 << BITS) + RUN_FEATURES

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            kept, of = [], []
            for text, y, pick in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "pick")), strict=True):
                found = features(text or "")
                sums[y][found] += 1
                if pick:
                    kept.append(found.astype("<u4").tobytes())
                    of.append(y)
            if kept:
                none = pa.nulls(len(kept), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(kept), pa.int32()), none, none, pa.array(kept, pa.binary()), pa.array(of, pa.int32())], ["feature", "neg", "pos", "found", "y"])
        on = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(sums[0][on]), pa.array(sums[1][on]), pa.nulls(len(on), pa.binary()), pa.nulls(len(on), pa.int32())], ["feature", "neg", "pos", "found", "y"])

    seen = stored(rows.mapInArrow(count, "feature int, neg long, pos long, found binary, y int"), "quality")
    counts = np.ones((2, size))
    for r in seen.where("feature >= 0").groupBy("feature").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toLocalIterator():  # at most 2**BITS + RUN_FEATURES rows
        counts[0][r.feature] += r.neg
        counts[1][r.feature] += r.pos
    picked = sorted((bytes(r.found), r.y) for r in seen.where("feature < 0").select("found", "y").collect())  # bounded by sample
    y = np.array([r[1] for r in picked], np.int64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    x = [np.frombuffer(r[0], "<u4") for r in picked]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    signs = 2.0 * y - 1
    order = np.random.default_rng(1).permutation(len(x))
    apart = np.zeros(len(x))
    for part in (order[::2], order[1::2]):
        rest = np.setdiff1d(order, part)
        w, b = dual_descent([x[i] for i in rest], signs[rest], ratio)
        apart[part] = [w[x[i]].sum() + b for i in part]
    w, b = dual_descent(x, signs, ratio)
    slope, offset = sigmoid_fit(apart, y)
    return Model(w, b, slope, offset)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs (or its columns `keep`) with score and predicted."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                s = np.array([m.score(features(t or "")) for t in batch.column(read).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(batch.column(f"_k{i}") for i in range(len(kept))), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    given = [F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)]
    read = f"_k{kept.index(text)}" if text in kept else "_text"  # a text that is kept is sent once
    return docs.select(*given, *([] if text in kept else [F.col(text).alias("_text")])).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # the table may have columns named score or predicted
    found = classify(docs.toDF(*names), fit(docs, labels), threshold, text=names[docs.columns.index("text")])
    return found.where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)
