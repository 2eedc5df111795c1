"""The class models against a plain version over dictionaries, and training on odd tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from quaywork.llm import toxicity

O, S = toxicity.ORDER, toxicity.SHARED


def norm(t):
    b = bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())
    return re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", b" ", b).strip()


def grams(t):
    w = norm(t)
    if not w:
        return []
    raw = b" " * O + w + b" "
    return [raw[k : k + O] for k in range(1, len(raw) - O + 1)]


def plain_model(by_class, every, d, sure, prior):
    """log-probabilities: {class: {gram: value}} for grams of all orders."""
    all_counts, contexts = Counter(), Counter()
    for t in every:
        for g in grams(t):
            for k in range(S, O + 1):
                all_counts[g[O - k :]] += 1
                contexts[k, g[O - k : O - 1]] += 1
    levels = {c: {O: Counter(g for t in texts for g in grams(t))} for c, texts in by_class.items()}
    for c in levels:
        for k in range(O - 1, S, -1):
            levels[c][k] = Counter(g[1:] for g in levels[c][k + 1])
    names = {g for c in levels for g in levels[c][O]}
    raw, both, tied = {0: {}, 1: {}}, {}, {0: {}, 1: {}}
    for g in {x[O - S :] for x in names}:
        p = (all_counts[g] + 1 / 256) / (contexts[S, g[:-1]] + 1)
        both[g] = raw[0][g] = raw[1][g] = p
        tied[0][g] = tied[1][g] = math.log(p)
    for k in range(S + 1, O + 1):
        rows = defaultdict(list)
        for g in {x for c in levels for x in levels[c][k]}:
            rows[g[:-1]].append(g)
        for ctx, own in rows.items():
            total = {c: sum(levels[c][k][g] for g in own) for c in levels}
            left = {c: 1 - sum(max(levels[c][k][g] - d, 0) for g in own) / total[c] if total[c] else 1.0 for c in levels}
            for g in own:
                low, doubt = g[1:], 0
                for c in levels:
                    raw[c][g] = max(levels[c][k][g] - d, 0) / max(total[c], 1) + left[c] * raw[c][low]
                    doubt += 1 / (1 + max(levels[c][k][g], total[c] * raw[c][low]))
                both[g] = (all_counts[g] + prior * both[low]) / (contexts[k, ctx] + prior)
                apart = abs(math.log(raw[1][g] / raw[0][g]) - math.log(raw[1][low] / raw[0][low])) > sure * math.sqrt(doubt)
                for c in levels:
                    tied[c][g] = tied[c][low] + (math.log(raw[c][g] / raw[c][low]) if apart else math.log(both[g] / both[low]))
    return tied


def test_likelihoods_equal_a_plain_model(spark):
    r = np.random.default_rng(5)
    words = ["stone", "river", "Path", "quiet", "ÉTÉ", "walk", "nitwit", "42nd", "over", "rivers"]
    texts = [" ".join(words[k] for k in r.integers(0, 10 if i % 2 else 6, int(r.integers(1, 30)))) + (" you utter nitwit!" if i % 2 else " -- fine.") for i in range(160)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "zz qq xx unseen Ω")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sure=1.5)
    import zlib

    part = {i: zlib.crc32(str(i).encode()) % 5 for i in range(160)}
    by_class = {c: sorted({texts[i] for i in range(160) if i % 2 == c and 1 <= part[i] <= 3}) for c in (0, 1)}
    want = plain_model(by_class, texts + ["", "zz qq xx unseen Ω"], 2.0, 1.5, 8.0)
    apart = 0
    for t in texts[:60] + ["", "zz qq xx unseen Ω", "stone " * 4000]:
        gs = grams(t)
        total = [0.0, 0.0]
        for g in gs:
            for c in (0, 1):
                total[c] += next((want[c][g[O - k :]] for k in range(O, S - 1, -1) if g[O - k :] in want[c]), -math.log(256))
        ordinary, toxic, n = model.likelihoods(t)
        assert n == len(gs)
        assert abs(ordinary - total[0] / max(1, n)) < 1e-9 and abs(toxic - total[1] / max(1, n)) < 1e-9
        apart += toxic != ordinary
    assert apart > 20


def test_table_is_exact():
    r = np.random.default_rng(6)
    keys = np.unique(r.integers(0, 2**40, 5000).astype(np.uint64))
    table = toxicity._Table(keys[::2], np.arange(len(keys[::2])) * 7)
    at, ok = table.of(keys)
    assert ok.tolist() == [k % 2 == 0 for k in range(len(keys))]
    assert (table.values[at[::2]] == np.arange(len(keys[::2])) * 7).all()
    assert not toxicity._Table(keys[:0], np.empty(0)).of(keys)[1].any()


def test_odd_tables(spark):
    docs = spark.createDataFrame([("a", "x y"), ("b", None), ("b", "x y"), (None, "z"), ("c", "w " * 200_000)], "doc_id string, text string")
    labels = spark.createDataFrame([("a", 1), ("zz", 0), (None, 1), ("b", None)], "doc_id string, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.digest(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    empty = docs.limit(0)
    assert toxicity.digest(empty, toxicity.train(empty, labels)).count() == 0
    assert toxicity.digest(docs, toxicity.train(docs, labels.limit(0))).count() == 5
