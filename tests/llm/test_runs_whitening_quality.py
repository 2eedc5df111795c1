"""Periodic runs, whitening and quality against plain models, and on odd input."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywork.llm import periodic_runs, quality, queries, whitening

SF = "/root/testdata/sf0.001"


# --- periodic runs ----------------------------------------------------------------------------------------------------


def brute_runs(w):
    """(start, length, period) by start and period: every stretch that no neighbour extends, by each period in turn."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        k = 0
        while k < n - q:
            b = k
            while k < n - q and w[k] == w[k + q]:
                k += 1
            if k > b and k - b + q >= max(24, 3 * q):
                found.setdefault((b, k + q), q)
            k += 1
    return sorted(((b, e - b, q) for (b, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def odd_texts(rng):
    parts = lambda k, m: " ".join(f"w{x}" for x in rng.integers(0, k, m))
    yield from (None, "", " \t\n", "one", "x " * 23, "x " * 24, "a b " * 40, ("a b c " * 9 + "d ") * 7, "a" * 5000, "é ß\x0b中\x0c" * 30, "a b c " * 30, parts(2, 400), parts(3, 200) + " " + "p q r " * 11)
    for _ in range(40):
        p = parts(4, int(rng.integers(1, 60)))
        yield " ".join([parts(6, int(rng.integers(0, 20))), *[p] * int(rng.integers(2, 9)), parts(6, int(rng.integers(0, 20)))])


def test_runs_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts(np.random.default_rng(5)))]
    rows += [(0, rows[7][1]), (None, rows[7][1]), (None, None)]
    d = spark.createDataFrame([(i, t, 1, "r", 2) for i, t in rows], "doc_id long, text string, n_words int, runs string, collapsed int").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs]), r.collapsed.encode()) for r in periodic_runs.find_runs(d).collect())
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_runs(w)
        want.append((str(i), len(w), str(runs), collapsed(w, runs)))
    assert got == sorted(want)
    assert sum(x[2] != "[]" for x in want) > 30
    assert periodic_runs.find_runs(d.limit(0)).count() == 0


def test_long_texts_of_runs(spark):
    rng = np.random.default_rng(6)
    block = [f"w{x}" for x in rng.integers(0, 400, 20_000)]
    texts = {1: ["same"] * 300_000, 2: block * 4 + block[:7], 3: [f"w{x}" for x in rng.integers(0, 5000, 300_000)]}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()] + [(4, "y" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(d).collect()}
    assert got[1] == ([(0, 300_000, 1)], "same")
    assert got[2][0] == [(0, 80_007, 20_000)] and got[2][1] == " ".join(block)
    assert got[3] == ([], " ".join(texts[3])) and got[4] == ([], "y" * 3_000_000)


def test_runs_query(spark):
    """The contract's rows from the documents themselves, short ones by brute force."""
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for i, t in rows:
        w = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(w)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs)).hexdigest()
        some += bool(runs)
    assert some > 5


def test_strongest_run_is_exact(spark):
    # 3 + 1 / (big + 1) comes first and is the less, though equal as a double
    big = 10**8
    runs = [(0, 3 * big + 4, big + 1), (5, 3 * big + 1, big), (9, 3 * big + 1, big)]
    d = spark.createDataFrame([(runs,), ([],)], f"runs {periodic_runs.RUNS}").select(periodic_runs.strongest(F.col("runs")).alias("b")).collect()
    assert tuple(d[0].b) == (5, 3 * big + 1, big) and d[1].b is None


# --- whitening --------------------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, component int").repartition(4)


def plain(rows, k=8):
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x], (y @ u[:, ::-1])[:, :k] / np.sqrt(e[::-1][:k]), e[::-1][:k] / e.sum()


@pytest.mark.parametrize("seed,n,d", [(1, 300, 24), (2, 40, 3), (3, 500, 9)])
def test_whitening_equals_plain(spark, seed, n, d):
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((d, d)) * np.exp(-np.arange(d) / 5)
    good = [(k, (rng.standard_normal(d) @ basis + 50 * (k % 2)).tolist()) for k in range(n)]
    good += [(0, good[0][1]), (None, good[1][1])]
    bad = [(9000, None), (9001, [None] + [1.0] * (d - 1)), (9002, [float("nan")] * d), (9003, [float("-inf")] * d), (9004, []), (9005, [1.0] * (d + 1))]
    got = whitening.whiten(vectors(spark, good + bad)).toPandas()
    m, deviations, w, explained = plain(good, min(8, d))
    assert len(got) == len(good) * min(8, d) and set(got.n) == {m} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for c, own in got.groupby("component"):
        assert own.explained.iloc[0] == pytest.approx(explained[c - 1], rel=1e-9)
        first = own[own.vec_id > 0].sort_values("vec_id")
        here = first.whitened.to_numpy()
        there = w[[i for i, (v, _) in enumerate(good) if v is not None and v > 0], c - 1]
        assert min(np.abs(here - there).max(), np.abs(here + there).max()) < 1e-8
        assert [int(x) for x in first.deviation] == [deviations[i] for i, (v, _) in enumerate(good) if v is not None and v > 0]


def test_whitening_of_few_and_equal(spark):
    assert whitening.whiten(vectors(spark, []).limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [1.0, 2.0]) for k in range(5)])).count() == 0
    line = whitening.whiten(vectors(spark, [(k, [float(k), 2.0 * k, 7.0]) for k in range(6)])).toPandas()  # one dimension
    assert set(line.component) == {1} and line.explained[0] == pytest.approx(1) and line.identity_error[0] < 1e-9
    floats = whitening.whiten(vectors(spark, [(k, [float(k), float(k * k)]) for k in range(6)], "float"), k=1)
    assert floats.count() == 6


def test_deviation_beyond_a_long(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [3e14, 0.5])]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == dict(zip([1, 2, 3], plain(rows)[1], strict=True))
    assert {r.vec_id for r in whitening.digest(vectors(spark, rows)).where("deviation is null and deviation_exact is not null").collect()} == {1, 2, 3}


def test_eigenvectors_of_clusters():
    rng = np.random.default_rng(4)
    for values in ([5.0] * 6 + [1.0] * 6, [3, 3 - 1e-13, 3 - 1e-9, 2, 1, 0, 0], [1e12, 1e6, 1, 1e-3], [4.0] * 3, [2, 2, 1, 1, 1e-9]):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        v = q @ np.diag(values) @ q.T
        e, u = whitening.leading((v + v.T) / 2, 8)
        want = sorted((x for x in values if x > 0), reverse=True)[:8]
        assert len(e) >= min(8, sum(x > 1e-13 * sum(values) for x in values)) and np.allclose(e, want[: len(e)], rtol=1e-9, atol=1e-12 * max(values))
        assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12 and np.abs(v @ u - u * e).max() < 1e-12 * max(values) * 10


# --- quality ----------------------------------------------------------------------------------------------------------


def form(seed, good):
    r = np.random.default_rng(seed)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, r.integers(2, 9))) for _ in range(int(r.integers(30, 90)))]
    if not good:
        words = [w.upper() + "!!" for w in words] if seed % 2 else [words[0]] * len(words)
    return " ".join(words) + "."


def test_quality_tells_forms_apart(spark):
    rows = [(k, form(k, k % 4 > 0)) for k in range(600)]
    odd = [(1000, None), (1001, ""), (None, "no id"), (None, None), (3, rows[3][1]), (1002, "word " * 50_000), (1003, "z" * 1_000_000)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows + odd], "doc_id long, text string, score double, value int").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(600)] + [(None, 1), (5, None), (6, 7), (77777, 1)], "doc_id long, quality int")
    got = quality.digest(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert len(held) > 90 and np.mean([r.predicted == (r.doc_id % 4 > 0) for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    # held-out labels change nothing
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.digest(docs, other).collect()}
    assert all(again[r.doc_id] == r.score for r in held)


def test_quality_without_preferences(spark):
    docs = spark.createDataFrame([(k, "some text") for k in range(4)] + [(None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(50)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, labels).collect()} == {1.0}
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.digest(docs.limit(0), labels).count() == 0
    both = labels.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    assert quality.score(docs, both).count() == 5  # one text with both labels
    assert quality.score(docs.limit(0), both).count() == 0
