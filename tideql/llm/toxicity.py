"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideql.functions.shipping import ship
from tideql.llm.common import LOWER, fields, remainder, table, training_rows, written

#: Labelled documents to learn from at most.
MAX_ROWS = 20_000
#: Lengths of the n-grams in characters, and the log2 of the buckets of each length.
SIZES, BITS = (4, 5, 6, 7, 8, 10), 18
BUCKETS = len(SIZES) << BITS
#: Buckets that the linear model keeps (of 2,048 to 32,768 the best in cross-validation on
#: training rows), and the documents that a kept one is in at least.
KEPT, LEAST_DOCS = 8192, 3
#: Smoothing of the counts, ridge penalty, steps.
ALPHA, PENALTY, STEPS = 1.0, 1e-4, 200
THRESHOLD = 0.7
#: Tasks that count over the bounded sample, documents of one array of counts, and characters
#: looked at at once.
TASKS, COUNTED, PIECE = 16, 65_535, 1 << 20


def grams(text: str | None):
    """Bucket numbers of all n-grams of a text's characters, a piece after another;
    lower-cased A-Z, white space as one space, one space at either end."""
    raw = b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()) + b" "
    chars = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, max(1, len(chars) - max(SIZES) + 1), PIECE):
        part = chars[at : at + PIECE + max(SIZES) - 1]
        h, size = part, 1
        for k, n in enumerate(SIZES):
            while size < n and len(h) > 1:
                h = h[:-1] * np.uint32(0x01000193) + part[size:]
                size += 1
            if size == n:
                yield ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)) + np.uint32(k << BITS)


_last = np.zeros(BUCKETS, np.int32)


def buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a text."""
    parts = []
    for part in grams(text):
        at = np.arange(len(part), dtype=np.int32)
        _last[part] = at  # the last of equal ones stays
        parts.append(part[_last[part] == at])
    return np.unique(np.concatenate(parts)) if len(parts) > len(SIZES) else np.concatenate([*parts, np.zeros(0, np.uint32)])


@dataclass
class Linear:
    """weights: by bucket, the log-count ratio times the learnt factor; 0 for those not kept."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of class 1; each kept bucket counts once a text."""
        found = [part[self.weights[part] != 0] for part in grams(text)]
        hit = np.unique(np.concatenate(found)) if found else np.zeros(0, int)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[hit].sum(dtype=np.float64), -500, 500))))


def ratios(docs_with: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of each bucket; docs_with: (2, buckets) documents of each class that hold it."""
    share = (docs_with + ALPHA) / (n[:, None] + 2 * ALPHA)
    return np.log(share[1] / share[0])


def chosen(docs_with: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The KEPT buckets whose shares in the classes differ most, by the chi-squared statistic; ties by bucket."""
    total = docs_with.sum(axis=0)
    expected = total * n[1] / max(1, n.sum())
    chi = np.where(total >= LEAST_DOCS, (docs_with[1] - expected) ** 2 / np.maximum(expected, 1e-9), 0)
    order = np.argsort(-chi, kind="stable")[:KEPT]
    return np.sort(order[chi[order] > 0])


def fitted(hits: list[np.ndarray], y: np.ndarray, scale: np.ndarray):
    """Factors and bias of a ridge logistic regression on the features, present or not,
    times scale; full-batch steps of adaptive size. hits: the features in each row.
    Rows of the rarer class weigh more, by the square root of the classes' ratio."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.concatenate(hits).astype(np.int64) if len(hits) else np.zeros(0, np.int64)
    value, d = scale[col], len(scale)
    odds = float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    weight = np.where(y == 1, np.exp(-odds / 2), 1.0)
    weight /= max(1e-9, weight.sum())
    w = np.concatenate([np.zeros(d), [odds]])
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[col], len(y)) + w[d], -500, 500)))
        miss = (p - y) * weight
        g = np.concatenate([np.bincount(col, value * miss[row], d), [miss.sum()]])
        g[:d] += PENALTY * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:d], float(w[d])


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Linear:
    """Learns from at most `max_rows` labelled documents, see training_rows. The driver
    gets pairs of count arrays, TASKS and one for each COUNTED rows, and the kept features of the sample's rows."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, label, max_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    sample = written(rows, "labelled").coalesce(TASKS)

    def count(batches):
        seen, n = np.zeros((2, BUCKETS), np.uint16), np.zeros(2, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["seen", "n"])

        for batch in batches:
            for text, y in zip(*fields(batch, "text", "y")):
                seen[y, buckets(text)] += 1
                n[y] += 1
                if n.sum() == COUNTED:  # no count of 16 bits can be greater
                    yield out()
                    seen[:], n[:] = 0, 0
        yield out()

    docs_with, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for r in sample.mapInArrow(count, "seen binary, n binary").toLocalIterator():
        docs_with += np.frombuffer(r["seen"], np.uint16).reshape(2, BUCKETS)
        n += np.frombuffer(r["n"], np.int64)
    kept = chosen(docs_with, n)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def present(batches):
        for batch in batches:
            ids, texts, y = fields(batch, "doc_id", "text", "y")
            found = [place[b][place[b] >= 0].tobytes() for b in map(buckets, texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(y, pa.int32()), pa.array(found, pa.binary())], ["doc_id", "y", "found"])

    got = sample.mapInArrow(present, "doc_id long, y int, found binary").collect()
    got.sort(key=lambda r: r["doc_id"])
    scale = ratios(docs_with, n)[kept]
    w, bias = fitted([np.frombuffer(r["found"], np.int32) for r in got], np.array([r["y"] for r in got], float), scale)
    weights = np.zeros(BUCKETS, np.float32)
    weights[kept] = w * scale
    return Linear(weights, bias)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Null texts count as empty; texts shorter than the n-grams get the bias alone.
    Rows with a null doc_id are scored and never learnt from. Repeated rows each give
    a row. Without labels every score is the smoothed prior. An empty table gives an
    empty result."""
    model = trained(docs, labels, "toxic", max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches):
        for batch in batches:
            ids, held, texts = fields(batch, "doc_id", "held_out", "text")
            score = [shared.value.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark, sf_dir):
    """Toxicity scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
