"""Toxicity from class-conditional Kneser-Ney models.

The models are over characters (bytes of the lower-cased words between single spaces), so that they know the forms of
a word. A bounded sample of labelled rows gives counts of ``ORDER``-grams for two classes. Each class has interpolated
Kneser-Ney estimates of the orders ``ORDER`` down to ``SHARED`` + 1, lower orders by continuation counts; below them
both share one distribution, from counts over all documents. Where a gram's counts are too few to tell the classes
apart, both take the estimate that all documents' counts of it give, in proportion to their own next lower order: so
rare expressions are smoothed by counts that grow with the corpus, and say nothing of their own.

A document has two length-normalised log-likelihoods, one for each class. A logistic curve over their difference and
the length, fitted on further labelled rows, turns them into a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lean, n_buckets

ORDER, SHARED = 5, 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str | None) -> np.ndarray:
    """The ``ORDER`` (at most 6) bytes up to each byte of a normalised text, as numbers; the text begins after spaces."""
    words = text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(b" " * 6 + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    two = (raw[:-1] << np.uint64(8)) | raw[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return _low((four[:-2] << np.uint64(16)) | two[4:], ORDER)[1:]


def _low(g: np.ndarray, k: int) -> np.ndarray:
    return g & np.uint64((1 << (8 * k)) - 1)


def _counted(parts, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of many arrays and their counts; sums up whenever ``at_once`` numbers have come."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    held: list[np.ndarray] = []

    def sum_up():
        u, c = np.unique(np.concatenate(held), return_counts=True)
        every, inv = np.unique(np.concatenate([keys[0], u]), return_inverse=True)
        counts[0] = np.bincount(inv, np.concatenate([counts[0], c]), len(every)).astype(np.int64)
        keys[0] = every
        held.clear()

    size = 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= at_once:
            sum_up()
            size = 0
    if held:
        sum_up()
    return keys[0], counts[0]


def _gram_rows(batches):
    """From (label, text): (label, gram, count) as blobs, summed within the batch."""
    for batch in batches:
        rows = []
        labels = np.array(batch.column(0).to_pylist())
        texts = batch.column(1).to_pylist()
        for c in (0, 1):
            g, n = _counted(_grams(texts[k]) for k in np.flatnonzero(labels == c))
            if len(g):
                rows.append((c, g.tobytes(), n.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2)], names=["label", "gram", "n"])


def _tag(g: np.ndarray, k: int, context: bool = False) -> np.ndarray:
    """A gram of ``k`` bytes, or the context of one, as a number that no other shares."""
    return g | np.uint64((2 * k + context) << 57)


def _vocabulary(grams: np.ndarray) -> np.ndarray:
    """What is counted over all documents for these ``ORDER``-grams: themselves, their lower orders, and contexts."""
    out = []
    for k in range(ORDER, SHARED - 1, -1):
        grams = np.unique(_low(grams, k))
        out += [_tag(grams, k), _tag(np.unique(grams >> np.uint64(8)), k, True)]
    return np.unique(np.concatenate(out))


def _count_rows(buckets: int):
    """Counts of grams of all orders and of their contexts, summed within some texts and dealt to buckets."""

    def run(batches):
        for batch in batches:
            g, n = _counted(_grams(t.as_py()) for t in batch.column(0))
            h, c = [], []
            for k in range(ORDER, SHARED - 1, -1):
                if k < ORDER:
                    g, inv = np.unique(_low(g, k), return_inverse=True)
                    n = np.bincount(inv, n, len(g)).astype(np.int64)
                ctx, inv = np.unique(g >> np.uint64(8), return_inverse=True)
                h += [_tag(g, k), _tag(ctx, k, True)]
                c += [n, np.bincount(inv, n, len(ctx)).astype(np.int64)]
            h, c = np.concatenate(h), np.concatenate(c)
            bucket = (((h * _STEP) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            h, c, bucket = h[order], c[order], bucket[order]
            ends = np.flatnonzero(np.diff(bucket)) + 1
            spans = [(s, e) for s, e in zip(np.r_[0, ends], np.r_[ends, len(h)], strict=True) if e > s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[s]) for s, _ in spans], pa.int32()), pa.array([h[s:e].tobytes() for s, e in spans], pa.binary()), pa.array([c[s:e].tobytes() for s, e in spans], pa.binary())],
                names=["bucket", "hashes", "counts"],
            )

    return run


def _sum_rows(vocabulary):
    """Per bucket: the counts over all documents of those grams that the models hold."""

    def run(t):
        h, c = (np.frombuffer(b"".join(t.column(k).to_pylist()), d) for k, d in (("hashes", np.uint64), ("counts", np.int64)))
        u, inv = np.unique(h, return_inverse=True)
        n = np.bincount(inv, c, len(u)).astype(np.int64)
        v = vocabulary.value
        on = v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u if len(v) else np.zeros(len(u), bool)
        return pa.table({"hashes": pa.array([u[on].tobytes()], pa.binary()), "counts": pa.array([n[on].tobytes()], pa.binary())})

    return run


class _Table:
    """Places of keys, exact: keys are sorted by a bijective hash, whose first bits say where to begin looking."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = keys * _STEP
        order = np.argsort(h)
        self.h, self.values, self.start = h[order], values[order], None
        self.bits = max(8, int(np.log2(len(keys) + 1)) + 2)

    def __getstate__(self):
        return self.__dict__ | {"start": None}  # made where it is used

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among the values, which keys are there)."""
        if self.start is None:
            top = (self.h >> np.uint64(64 - self.bits)).astype(np.int64)
            self.start = np.searchsorted(top, np.arange(1 << self.bits)).astype(np.int32)
            self.h = np.append(self.h, np.uint64(2**64 - 1))
        h = keys * _STEP
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        found = self.h[at]
        todo = np.flatnonzero(found < h)
        while len(todo):
            at[todo] += 1
            found[todo] = self.h[at[todo]]
            todo = todo[found[todo] < h[todo]]
        ok = (found == h) & (at < len(self.values))
        return np.where(ok, at, 0), ok


class Model:
    """Log-probabilities of grams in both classes; ``curve`` turns a difference of likelihoods into log odds.

    A class estimate takes ``discount`` off each count. ``sure``: the classes are told apart by a gram where the log
    ratio of its estimates, beyond that of its next lower order, is at least so many times its own standard error.
    ``prior``: the weight, in counts, of the lower order in what all documents say of a gram.
    """

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray]], discount: float, sure: float = 3.0, prior: float = 8.0):
        self.sure, self.discount, self.prior, self.counts, self.curve = sure, discount, prior, counts, np.array([-3.0, 1.0, 0.0])
        self.vocabulary = _vocabulary(np.unique(np.concatenate([g for g, _ in counts.values()])))

    def fit(self, shared: np.ndarray) -> None:
        """``shared``: counts of ``self.vocabulary`` over all documents."""
        d = self.discount

        def count(g, k, context=False):
            return shared[np.searchsorted(self.vocabulary, _tag(g, k, context))]

        levels: dict[int, dict] = {c: {ORDER: (g, n.astype(float))} for c, (g, n) in self.counts.items()}
        for c in levels:
            for k in range(ORDER - 1, SHARED, -1):  # distinct bytes before
                u, before = np.unique(_low(levels[c][k + 1][0], k), return_counts=True)
                levels[c][k] = (u, before.astype(float))
        grams = np.unique(np.concatenate([_low(g, SHARED) for g, _ in self.counts.values()]))
        base = (count(grams, SHARED) + 1 / 256) / (count(grams >> np.uint64(8), SHARED, True) + 1)
        raw, both, tied = {c: base for c in levels}, base, {c: np.log(base) for c in levels}
        self.tables = {SHARED: _Table(grams, np.stack([tied[0], tied[1]], 1))}
        for k in range(SHARED + 1, ORDER + 1):
            down, grams = grams, np.unique(np.concatenate([levels[c][k][0] for c in levels]))
            low = np.searchsorted(down, _low(grams, k - 1))
            ctx, at = np.unique(grams >> np.uint64(8), return_inverse=True)
            probs, doubt = {}, 0.0
            for c in levels:
                g, n = levels[c][k]
                own = np.zeros(len(grams))
                own[np.searchsorted(grams, g)] = n
                seen, kept = np.bincount(at, own, len(ctx)), np.maximum(own - d, 0)
                left = np.where(seen > 0, 1 - np.bincount(at, kept, len(ctx)) / np.maximum(seen, 1), 1.0)
                lower = raw[c][low]
                probs[c] = kept / np.maximum(seen, 1)[at] + left[at] * lower
                doubt = doubt + 1 / (1 + np.maximum(own, seen[at] * lower))
            apart = np.abs(np.log(probs[1] / probs[0]) - np.log(raw[1][low] / raw[0][low])) > self.sure * np.sqrt(doubt)
            every = (count(grams, k) + self.prior * both[low]) / (count(grams >> np.uint64(8), k, True) + self.prior)
            # told apart: the class's own step from the lower order; else the step that all documents show
            tied = {c: tied[c][low] + np.where(apart, np.log(probs[c] / raw[c][low]), np.log(every / both[low])) for c in levels}
            self.tables[k] = _Table(grams, np.stack([tied[0], tied[1]], 1))
            raw, both = probs, every
        del self.counts, self.vocabulary

    def likelihoods(self, text: str | None) -> tuple[float, float, int]:
        """The mean log-likelihood of a text's characters in class 0 and class 1, and their number.

        A character's estimate is that of its longest known gram; one that no order knows is one of 256.
        """
        g = _grams(text)
        total = np.zeros(2)
        for s in range(0, len(g), 1 << 15):
            rest = g[s : s + (1 << 15)]
            for k in range(ORDER, SHARED - 1, -1):
                t = self.tables[k]
                at, ok = t.of(_low(rest, k))
                total += t.values[at[ok]].sum(0) if len(t.values) else 0
                rest = rest[~ok]
                if not len(rest):
                    break
            total -= len(rest) * np.log(256)
        return (*(total / max(1, len(g))).tolist(), len(g))

    def evidence(self, text: str | None) -> tuple[float, int]:
        """The difference of the two length-normalised log-likelihoods, and the length."""
        ordinary, toxic, n = self.likelihoods(text)
        return toxic - ordinary, n

    @staticmethod
    def features(mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        # the difference as it is, and by weight: a mean over more characters varies less
        return np.stack([np.ones(len(mean)), mean * 20, mean * np.sqrt(n)], 1)

    def score(self, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(mean, n) @ self.curve, -30, 30)))

    def calibrate(self, mean: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> None:
        """Newton steps for a logistic curve."""
        x, w = self.features(mean, n), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - y) + ridge * w
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        self.curve = w


def _bucket_of_id(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, calibration: int = 6000, discount: float = 2.0, sure: float = 3.0) -> Model:
    """A model from labelled rows whose crc32(id as text) mod 5 is not 0.

    At most ``sample`` rows of each class (mod 1 to 3, by a hash of the id) give the class counts, at most
    ``calibration`` rows (mod 4) the logistic curve; only their counts and evidence come to the driver. The shared
    counts are over all documents. Rows without an id or a label of 0 or 1 are not learned from.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").withColumn("part", _bucket_of_id("id")).where("part <> 0")
    order, kind = F.xxhash64("id"), dict(labels.dtypes)[id_col]
    w = Window.partitionBy("label", "lane").orderBy("h", "id")
    # the smallest hashes of each class, first within lanes, so that no task ranks all rows
    ranked = given.where("part < 4").withColumns({"h": order, "lane": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64))})
    ranked = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample)
    picked = None
    for c in (0, 1):
        own = ranked.where(F.col("label") == c).orderBy("h", "id").limit(sample).select("id", "label")
        picked = own if picked is None else picked.union(own)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = [(r[0], r[1]) for r in picked.collect()]  # bounded by 2 * sample
    small = spark.createDataFrame(ids, f"id {kind}, label int")
    # copies of a text would make its own expressions look common in its class
    rows = d.join(F.broadcast(small), "id").select("label", "text").distinct().mapInArrow(lean(_gram_rows), "label int, gram binary, n binary").collect()
    counts = {}
    for c in (0, 1):
        g, n = (np.frombuffer(b"".join(bytes(r[k]) for r in rows if r["label"] == c), t) for k, t in (("gram", np.uint64), ("n", np.int64)))
        u, inv = np.unique(g, return_inverse=True)
        counts[c] = (u, np.bincount(inv, n, len(u)).astype(np.int64))
    model = Model(counts, discount, sure)
    vocabulary = spark.sparkContext.broadcast(model.vocabulary)
    buckets = n_buckets(spark)
    found = d.select("text").mapInArrow(lean(_count_rows(buckets)), "bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(_sum_rows(vocabulary), "hashes binary, counts binary").collect()
    shared = np.zeros(len(model.vocabulary))
    for r in found:  # a row for each bucket; together no more than the models' own grams
        shared[np.searchsorted(model.vocabulary, np.frombuffer(bytes(r["hashes"]), np.uint64))] = np.frombuffer(bytes(r["counts"]), np.int64)
    model.fit(shared)
    ready = spark.sparkContext.broadcast(model)
    held = given.where("part = 4").withColumn("h", order).orderBy("h", "id").limit(calibration).select("id", "label")
    held_ids = [(r[0], r[1]) for r in held.collect()]  # bounded by calibration
    held = spark.createDataFrame(held_ids, f"id {kind}, label int")
    fit = d.join(F.broadcast(held), "id").select("label", "text").mapInArrow(lean(_evidence_rows(ready)), "label int, mean double, n long").toPandas()
    if fit["label"].nunique() == 2:
        model.calibrate(fit["mean"].to_numpy(), fit["n"].to_numpy(), fit["label"].to_numpy())
    return model


def _evidence_rows(model):
    def run(batches):
        for batch in batches:
            found = [model.value.evidence(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["label", "mean", "n"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic), in place: no shuffle.

    A null or wordless text gets the score of no evidence. The model is broadcast; it is bounded by the training
    sample, not by the corpus.
    """
    m = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        found = [m.value.evidence(t) for t in texts]
        return pd.Series(m.value.score(np.array([x for x, _ in found]), np.array([n for _, n in found])))

    return docs.withColumn("score", scored(F.col(text_col)))


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns."""
    s = score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (_bucket_of_id("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

