"""Quality classifier: regularised quadratic discriminant on transformed text statistics."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideql.functions.shipping import ship
from tideql.llm.common import fields, remainder, table, training_rows

#: Labelled documents to learn from at most.
MAX_ROWS = 20_000
#: Weight of the pooled covariance, and of the identity, in each class's covariance.
POOL, RIDGE = 0.1, 0.05
#: Bytes compressed at once.
BLOCK = 1 << 16
THRESHOLD = 0.5
#: Words of evidence at which a text's own statistics weigh as much as the mean of all texts.
EVIDENCE = 20

_DELETE_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGIT, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
_STOPS, _COMMAS = b".!?", b",;:"
_MARKUP = b"#*$%&|<>{}[]=_~^\\/@+"
_LONG = re.compile(rb"[^ \t\n\x0b\x0c\r]{16,}")


def _share(part: float, whole: float) -> float:
    """Log of a share, smoothed: spreads out what is rare."""
    return float(np.log((part + 0.5) / (whole + 1.0)))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text; those of the empty text are defined too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, n = raw.split(), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    m, of = len(words), lambda drop: n - len(raw.translate(None, drop))
    packed = sum(len(zlib.compress(raw[i : i + BLOCK], 1)) for i in range(0, n, BLOCK))
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 0
    return [
        float(np.log1p(m)),
        float(np.log((n - of(_SPACE) + 1) / (m + 1))),
        _share(of(_UPPER), n),
        _share(of(_DIGIT), n),
        _share(of(_MARKUP), n),
        _share(of(_STOPS), m),
        _share(of(_COMMAS), m),
        _share(raw.count(b"!!"), m),
        _share(len(lines) - len(set(lines)), len(lines)),
        _share(len(counts), m),
        _share(max(0, m - 1 - pairs), m),
        _share(max(counts.values(), default=0), m),
        float(np.log((packed + 1) / (n + 1))),
        _share(len(_LONG.findall(raw)), m),
        float(np.log((len(lines) + 1) / (m + 1))),
        _share(n - len(raw.translate(None, _DELETE_LETTERS)), n),
    ]


N_STATISTICS = len(statistics(""))


def _drawn(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scaled statistics z of texts with statistics x, drawn toward the mean of all texts: those
    of short texts say little. So in fitting as in scoring."""
    words = np.expm1(x[:, :1])
    return z * (words / (words + EVIDENCE))


@dataclass
class Discriminant:
    """Class means and Cholesky factors of the inverse class covariances; log_odds adds the prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_odds: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
        """Shrunk covariances: toward the pooled one by `pool`, then toward the identity
        by `ridge` (of scaled statistics). Without rows of a class, the other's log-odds
        decide: every score is the smoothed prior."""
        d = x.shape[1]
        centre = x.mean(axis=0) if len(x) else np.zeros(d)
        scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(d)
        z, n = _drawn((x - centre) / scale, x), np.array([(y == 0).sum(), (y == 1).sum()])
        odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        if n.min() == 0:
            return cls(centre, scale, np.zeros((2, d)), np.tile(np.eye(d), (2, 1, 1)), np.zeros(2), odds)
        means = np.stack([z[y == k].mean(axis=0) for k in (0, 1)])
        scatter = [(z[y == k] - means[k]).T @ (z[y == k] - means[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / len(z)
        factors, dets = [], []
        for k in (0, 1):
            own = (1 - pool) * (scatter[k] + pooled * d) / (n[k] + d) + pool * pooled
            low = np.linalg.cholesky((1 - ridge) * own + ridge * np.eye(d))
            factors.append(np.linalg.inv(low))
            dets.append(2 * np.log(np.diag(low)).sum())
        return cls(centre, scale, means, np.stack(factors), np.array(dets), odds)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the prior and half the difference of Mahalanobis distances
        and log-determinants."""
        z = _drawn((x - self.centre) / self.scale, x)
        far = [(((z - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) + self.log_dets[k] for k in (0, 1)]
        odds = np.clip(self.log_odds + (far[0] - far[1]) / 2, -500, 500)
        return 1 / (1 + np.exp(-odds))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Discriminant:
    """A discriminant learnt from at most `max_rows` labelled documents, see training_rows."""

    def measure(batches):
        for batch in batches:
            ids, texts, y = fields(batch, "doc_id", "text", "y")
            x = pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(y, pa.int32()), x], ["doc_id", "y", "x"])

    ship(docs.sparkSession)
    rows = training_rows(docs, labels, label, max_rows).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y")
    rows = rows.mapInArrow(measure, "doc_id long, y int, x array<double>").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), N_STATISTICS)
    return Discriminant.fit(x, np.array([r["y"] for r in rows], int))


def scored(docs: DataFrame, model: Discriminant) -> DataFrame:
    """All rows and columns of docs and the score, in column __llm_score."""
    names = docs.columns
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text")).to_pylist()
            x = np.array([statistics(t) for t in texts], float).reshape(len(texts), N_STATISTICS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*names, "__llm_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__llm_score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Null texts count as empty, very long ones are measured whole. Rows with a null doc_id
    are scored like any other and never learnt from. Repeated rows each give a row. Without labels of both classes
    every score is the smoothed prior. An empty table gives an empty result."""
    model = trained(docs, labels, "quality", max_rows)
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        F.col("__llm_score").alias("score"),
        (F.col("__llm_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier does not reject."""
    return scored(docs, trained(docs, labels)).where(F.col("__llm_score") >= THRESHOLD).select(*docs.columns)


def query(spark, sf_dir):
    """Quality scores of all documents."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
