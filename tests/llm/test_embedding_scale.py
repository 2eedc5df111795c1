"""Embedding near-duplicates against brute force: lengths, magnitudes, ties, crowds and vectors that share a direction."""

import numpy as np
import pytest

from quaywork.llm import embedding_dedup


def brute(rows, cosine=0.95):
    ids, unit = [], []
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.array(v, float)
        top = np.abs(x).max()
        if np.isfinite(top) and top > 0:
            x = x / top
            ids.append(i)
            unit.append(x / np.linalg.norm(x))
    links, parent = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i)) for i in links}


def run(spark, rows, parts=4):
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string").repartition(parts)
    return {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(d).collect() if r.vec_id is not None}


def test_lengths_magnitudes_and_ties(spark):
    r = np.random.default_rng(1)
    x, y = r.standard_normal((40, 16)), r.standard_normal((40, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, v.tolist()) for k, v in enumerate(y)]
    rows += [(200 + k, (v * s).tolist()) for k, (v, s) in enumerate(zip(x[:6], (1e200, 1e-200, 5e-324 * 2**60, -1.0, 3.0, 0.5), strict=True))]
    rows += [(300, [0.0] * 16), (301, None), (302, []), (303, [float("inf")] * 16), (304, [1.0, None]), (305, [1.0]), (306, [2.0]), (307, [-3.0]), (308, [float("nan"), 1.0])]
    rows += [(400, [1.0, 0.0]), (401, [0.96, 0.28]), (402, [0.94, float(np.sqrt(1 - 0.94**2))])]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[305] == (1, 305) and got[306] == (1, 305) and got[307] == (0, 307)
    assert run(spark, rows, 1) == got


@pytest.mark.parametrize("noise", [0.02, 0.08, 0.14])
def test_crowds(spark, noise):
    """Groups of near copies: tight (all link), loose (many pairs on either side of the threshold), and exact copies."""
    r = np.random.default_rng(2)
    base = r.standard_normal((3, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = [(k, (base[k % 3] + noise * r.standard_normal(32) / np.sqrt(32) * np.sqrt(32 / 8)).tolist()) for k in range(300)]
    rows += [(1000 + k, r.standard_normal(32).tolist()) for k in range(300)] + [(2000 + k, base[0].tolist()) for k in range(40)]
    got, want = run(spark, rows), brute(rows)
    found, all_links = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.97 * all_links and all_links > 3000


def test_vectors_that_share_a_direction(spark):
    """A common mean leaves most pairs close: recall holds, and cells do not fill up."""
    r = np.random.default_rng(3)
    shared = r.standard_normal(32)
    x = 0.5 * shared + 0.5 * r.standard_normal((600, 32))
    near = x[:60] + 0.05 * r.standard_normal((60, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(np.vstack([x, near]))]
    got, want = run(spark, rows), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values()) > 0
