"""Stages of the pipeline on odd input, and two operators against brute force."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from quaywork.llm import queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, component_id long, n_hit long, n_removed long, spans string"


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"w{seed}x{x}" for x in r.integers(0, 10_000, n))


@pytest.fixture(scope="module")
def docs(spark):
    near = words(1, 100).split()
    near[50] = "other"
    rows = [(1, words(1, 100)), (2, " ".join(near)), (3, words(1, 100)), (4, words(2, 60) + " " + words(3, 60)), (5, words(4, 40) + " " + words(3, 60)), (6, None), (7, ""), (8, " \n"), (9, "short"), (9, "short"), (None, "nobody's"), (None, None), (10, "z" * 200_000), (11, " ".join(["same"] * 20_000))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 0.5, 7, 9, 8, "kept") for i, t in rows], SCHEMA).repartition(3)


def test_stages_are_as_dealt(pipeline):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "benchmark", "packing"]


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_take_odd_rows(spark, pipeline, docs, k):
    name, stage = pipeline.STAGES[k]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
    assert {(r.label, r.score, r.component_id, r.n_hit, r.n_removed, r.spans) for r in out.collect()} == {(1, 0.5, 7, 9, 8, "kept")}
    got = sorted((str(r.doc_id), r.text) if r.text is not None else (str(r.doc_id), "-") for r in out.collect())
    every = sorted((str(r.doc_id), r.text) if r.text is not None else (str(r.doc_id), "-") for r in docs.collect())
    if name == "near_copies":
        assert got == [x for x in every if x[0] not in ("2", "3")]
    elif name == "repeats":
        kept = dict(got)
        assert kept["1"] == dict(every)["1"] and "3" not in kept  # nothing of an exact copy is left
        assert len(kept["5"].encode()) < 500 and kept["5"].startswith(words(4, 40)[:50])
        assert {"6", "7", "8", "9", "None"} <= set(kept) and len([x for x in got if x[0] == "9"]) == 2
        assert len(kept["10"]) <= 200 and out.where("n_chars <> char_length(text)").count() == 0
    else:
        assert set(got) <= set(every) and len(got) >= len(every) - 2  # clean rows stay
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_packing_stage_takes_every_row(spark, pipeline, docs):
    out = pipeline.STAGES[4][1](spark, docs, SF)
    rows = docs.select("doc_id").collect()
    assert out.where("start = 0").count() == len(rows)
    assert pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0


def test_benchmark_stage_drops_what_holds_a_window(spark, pipeline):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) >= 12)
    d = spark.createDataFrame([(1, words(5, 30) + " " + item + " " + words(6, 30)), (2, words(7, 50)), (None, item)], "doc_id long, text string")
    assert [r.doc_id for r in pipeline.STAGES[3][1](spark, d, SF).collect()] == [2]


# --- brute force ------------------------------------------------------------------------------------------------------


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_contamination_equals_brute_force(spark):
    items = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = split(r.text)
        if w:
            n = min(10, len(w))
            items.setdefault(r.item_id, set()).update((n, tuple(w[k : k + n])) for k in range(len(w) - n + 1))
    of: dict = {}
    for i, windows in items.items():
        for n, x in windows:
            of.setdefault(x, set()).add(i)
    sizes = {len(x) for x in of}
    got = {r.doc_id: r for r in queries.op3_decontamination(spark, SF).collect()}
    hits = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, found, hit = split(r.text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = of.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit.update(range(k, k + n))
        g = got[r.doc_id]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        assert (g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated) == (len(w), len(hit), len(found), digest, bool(hit))
        hits += bool(hit)
    assert hits >= 3


def test_shards_equal_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op8_sharding(spark, SF).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    total: dict = {}
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        total.setdefault(r.shard, []).append((r.slot, r.size))
    assert sorted(total) == list(range(8))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in total.values())
    sizes = [sum(n for _, n in x) for x in total.values()]
    assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 1 for t in rows.values())


def test_archived_pages_equal_hashes(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last: dict = {}
    for i, raw in pages.items():
        last[raw] = max(i, last.get(raw, i))
    got = queries.op4_arc_to_warc(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        raw = pages[r.page_id]
        first = last[raw] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else last[raw])


def test_stages_take_small_batches(spark, pipeline, docs):
    """A batch of whole texts is held by an executor and its worker at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(key, given)
            for _, stage in pipeline.STAGES:
                stage(spark, docs.limit(0), SF)
                assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)


def test_worker_gives_memory_back():
    """What a task has freed does not stay with its worker."""
    import subprocess
    import sys

    code = """
import numpy as np
import pyarrow
from quaywork.llm.common import lean

def rows(batches):
    first = np.ones(3_800_000)  # 30 MB, whose release lets the allocator hold as much
    del first
    for b in batches:
        held = [np.ones(12_000) for _ in range(2_000)]
        end = np.ones(12_000)  # lies above them
        del held
        yield end

def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

kept = list(lean(rows)(iter([1])))
print(resident())
"""
    used = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    plain = float(subprocess.run([sys.executable, "-c", code.replace("lean(rows)", "rows")], capture_output=True, text=True, check=True).stdout)
    assert used < plain - 100
