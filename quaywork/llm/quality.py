"""Quality of documents, ranked by a Bradley-Terry model.

Each text has a fixed set of features of its form: shares of byte classes and of pairs of classes, of single marks,
and how far words and lines repeat. A pair of labelled documents, one of label 1 and one of label 0, is a preference;
the odds that one document is preferred to another are those of the difference of their values, and a value is a
weighted sum of features, so the weights are those of a logistic regression on feature differences. All documents are
valued; the value that parts the classes is a quantile of the values of all labelled documents to learn from, at the
share of label 0 among them. A score of 0.3 stands for that value, other scores have the odds of the difference to it.

A null, empty or wordless text has features like any other. Rows without an id are scored, but not learned from, and so
are labels other than 0 and 1; equal rows and rows with equal values get equal scores. An empty table gives no rows.
Labels of one class only, or none, make no preferences: every score is then the share of label 1, or a half without
labels. Other columns of the table are not read, those of ``docs`` are kept by ``score``.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import exact_quantiles
from .common import cut

THRESHOLD = 0.3
#: Classes of bytes; any other is in the last class.
CLASSES = (string.ascii_lowercase, string.ascii_uppercase, string.digits, " \t", "\n\r", ".,", ";:", "!?", "\"'`", "()[]{}", "-_", "/\\|", "@#$%&*+=<>^~", "".join(map(chr, range(128, 256))))
N_CLASSES = len(CLASSES) + 1
CLASS_OF = np.array([next((k for k, c in enumerate(CLASSES) if chr(b) in c), len(CLASSES)) for b in range(256)], np.int64)
MARKS = np.frombuffer(string.punctuation.encode(), np.uint8)


def features(text: str | None) -> np.ndarray:
    """What is known of a text: shares by class, pair of classes and mark, lengths of words and lines, repeats."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, len(raw))
    c = CLASS_OF[raw]
    pairs = np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=N_CLASSES**2)
    single = np.bincount(raw, minlength=256)
    classes = np.bincount(CLASS_OF, single, N_CLASSES)
    words, lines = (text or "").split(), (text or "").split("\n")
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    m = max(1, len(ids))
    times = np.bincount(ids, minlength=1)
    triples = ids[:-2] * 1_000_003 + ids[1:-1] * 1_009 + ids[2:] if len(ids) > 2 else ids[:0]
    repeats = [(ids[1:] == ids[:-1]).sum() / m, (ids[2:] == ids[:-2]).sum() / m, times.max() / m if len(ids) > 20 else 0.0, 1 - len(np.unique(triples)) / max(1, len(triples)), 1 - len(set(lines)) / len(lines), (times > 4).sum() / m]
    sizes = [np.log1p(len(raw)), np.log1p(len(ids)), len(raw) / m if len(ids) else 0.0, n / len(lines)]
    rates = np.concatenate([classes / n, pairs / n, single[MARKS] / n, repeats])
    return np.concatenate([np.log1p(200 * rates), np.log1p(sizes)]).astype(np.float32)


class Model:
    """Weights of features whose differences decide which of two documents is preferred; ``threshold`` is set later."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int, ridge: float = 3.0, seed: int = 1):
        """Newton steps on the logistic loss of ``pairs`` preferences, drawn from all pairs of the two classes."""
        self.mean, self.deviation = x.mean(0), np.maximum(x.std(0), 1e-3)
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        rng, (good, bad) = np.random.default_rng(seed), (np.flatnonzero(y == 1), np.flatnonzero(y == 0))
        # each document about equally often on its side
        deal = lambda side: np.concatenate([rng.permutation(side) for _ in range(-(-pairs // len(side)))])[:pairs]
        d = z[deal(good)] - z[deal(bad)]
        w = np.zeros(d.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # the chance that the preference is the other way round
            gradient = ridge * w - d.T @ p
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.threshold = w, 0.0

    def value(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -8, 8) @ self.weights


def _bucket_of_id(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _feature_rows(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["label", "x"])


def _given(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").where(_bucket_of_id("id") != 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, pairs: int = 40_000) -> Model | None:
    """A model without its threshold, from labelled rows whose crc32(id as text) mod 5 is not 0; None without both classes.

    ``sample`` rows of each class at most (those of the smallest hashes of their ids) and ``pairs`` of them bound what
    is learned from; only the sample's features come to the driver.
    """
    spark = docs.sparkSession
    given = _given(labels, id_col, label_col)
    picked = [r for c in (0, 1) for r in given.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]  # bounded by 2 * sample
    if len({r["label"] for r in picked}) < 2:
        return None
    small = spark.createDataFrame(picked, f"id {dict(labels.dtypes)[id_col]}, label int")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # copies of a text are one example
    rows = d.join(F.broadcast(small), "id").select("label", "text").distinct().mapInArrow(_feature_rows, "label int, x binary").collect()
    y = np.array([r["label"] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    order = np.lexsort((*x.T[::-1], y))  # whatever order the rows came in
    return Model(x[order], y[order], pairs)


def values(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, value) of every row: the model is broadcast, its size is that of the features."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack([features(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.value.value(x))], names=[id_col, "value"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(docs.dtypes)[id_col]}, value double")


def threshold(valued: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> float:
    """The value halfway between those that stand on either side of the share of label 0, among all labelled rows whose
    crc32(id as text) mod 5 is not 0."""
    given = _given(labels, id_col, label_col).withColumnRenamed("id", id_col)
    known = cut(valued.join(given, id_col).select("value", "label"))
    n, low = known.agg(F.count("*"), F.count_if(F.col("label") == 0)).first()
    share = min(1.0, max(0.0, (low - 0.5) / max(1, n - 1)))
    return exact_quantiles(known, [], "value", {"at": share}).first()["at"]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, pairs: int = 40_000) -> DataFrame:
    """(id, score) of every row of ``docs``, 0 to 1; below 0.3 lies what the model ranks with label 0."""
    model = train(docs, labels, id_col, text_col, label_col, sample, pairs)
    if model is None:
        share = _given(labels, id_col, label_col).agg(F.avg("label")).first()[0]
        return docs.select(id_col, F.lit(0.5 if share is None else float(share)).alias("score"))
    valued = cut(values(docs, model, id_col, text_col))
    at = threshold(valued, labels, id_col, label_col)
    odds = THRESHOLD / (1 - THRESHOLD)
    away = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(at) - F.col("value")))
    return valued.select(id_col, (1 / (1 + F.exp(away) / odds)).alias("score"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    s = score(docs.select("doc_id", "text"), labels)
    return s.select("doc_id", F.coalesce(_bucket_of_id("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
