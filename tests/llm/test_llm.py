"""The operators of the llm subpackage against plain versions, and on odd input: nulls, empty and long texts, ties,
repeated rows, empty tables, and extra columns with names that the operators use themselves."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from quaywork.llm import arc_to_warc, chat_format, decontamination, embedding_dedup, ngram_jaccard, packing, sharding, substring_dedup, suffix_dedup, toxicity
from quaywork.llm.common import connected_components

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k]}{r.integers(50)}" for k in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 120)
    edited = base.split()
    edited[60] = "changed"
    passage = text(2, 70)
    rows = [
        (1, base), (2, base), (3, " ".join(edited)), (4, text(3, 90) + " " + passage), (5, passage + " " + text(4, 90)), (6, None), (7, ""), (8, "one two"), (9, "one two"),
        (10, "a" * 5000), (11, text(5, 3000)), (11, text(5, 3000)), (None, "no id here at all"), (None, None), (12, "éß中 " * 60),
    ]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, bucket string, n long, batch int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def test_jaccard(spark, docs, empty):
    got = ngram_jaccard.jaccard_components(docs).collect()
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id not in (None,)} == {r.doc_id: len(shingle_set(r.text)) for r in docs.collect() if r.doc_id is not None}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert ngram_jaccard.jaccard_components(empty).count() == 0


def test_jaccard_large_group(spark):
    """Near copies of one text in a large group, some linked only through others."""
    r = np.random.default_rng(0)
    base = text(9, 60).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(60))] = f"edit{r.integers(5)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(text(2, 70).split()[:30])), (2, "One, TWO!"), (3, None), (4, "..."), (None, "no id here")], "item_id long, text string")
    whole = decontamination.contamination(docs, items)
    rows = whole.collect()
    assert whole.columns == [*docs.columns, "n_words", "n_hit", "items", "spans"]
    by = {r.doc_id: r for r in rows}
    assert (by[4].n_hit, by[5].n_hit, by[8].n_hit, by[1].n_hit, by[6].n_words) == (30, 30, 2, 0, 0)
    assert by[8]["items"] == ["2"] and by[4]["items"] == ["1"]
    s = by[5].spans[0]
    assert by[5].text.encode()[s.start : s.stop].decode() == " ".join(text(2, 70).split()[:30])
    parts = {r.doc_id: (r.n_hit, r["items"]) for r in decontamination.contamination(docs, items, max_patterns=4).collect()}
    assert parts == {r.doc_id: (r.n_hit, r["items"]) for r in rows}
    assert decontamination.contamination(empty, items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(docs, items.limit(0)).collect()} == {0}


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(((-(2**63) if i is None else i, (t or "").encode()) for i, t in rows)):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        out.append((i, len(t), int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs, carry=["bucket", "n", "batch"]).collect()
    assert sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], 100)
    assert {(r.bucket, r.n, r.batch) for r in got} == {("x", 1, 2)}
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_array():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        t = np.r_[r.integers(1, 4, n).astype(np.uint8), 0].astype(np.uint8)
        sa = suffix_dedup.suffix_array(t, 500)
        b = t.tobytes()
        assert sa.tolist() == sorted(range(len(b)), key=lambda k: b[k:])
        lcp = suffix_dedup.common_prefixes(t, sa, 500)
        for k in range(1, len(sa)):
            x, y = b[sa[k - 1] :], b[sa[k] :]
            n_same = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert lcp[k] == n_same


def test_substring_dedup(docs, empty):
    got = substring_dedup.fuzzy_passages(docs).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert {(2, 1), (3, 1), (5, 4)} <= pairs
    p = next(r for r in got if (r.doc_id, r.source_id) == (5, 4))
    assert (p.start, p.stop, p.source_start, p.source_stop) == (0, 70, 90, 160) and p.similarity == 1
    assert not any(r.doc_id in (1, 4, 6, 7, 8, None) for r in got)
    assert substring_dedup.fuzzy_passages(empty).count() == 0


def common_words(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for k, b in enumerate(y):
            new.append(row[k] + 1 if a == b else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_two_passages_of_one_pair(spark):
    one, two, exact = text(60, 300).split(), text(61, 70).split(), text(62, 80).split()
    edited = two[:35] + ["changed"] + two[36:]
    x = one + text(63, 100).split() + two + text(64, 100).split() + exact
    y = one + text(65, 90).split() + edited + text(66, 110).split() + exact
    rows = spark.createDataFrame([(1, " ".join(x)), (2, " ".join(y))], "doc_id long, text string")
    got = sorted((r.start, r.stop, r.source_start, r.source_stop, r.similarity) for r in substring_dedup.fuzzy_passages(rows).collect())
    assert [g[:4] for g in got] == [(0, 300, 0, 300), (390, 460, 400, 470), (570, 650, 570, 650)]
    for s, e, p, q, similarity in got:
        assert similarity == common_words(y[s:e], x[p:q]) / max(e - s, q - p)


def test_passage_with_scattered_seeds(spark):
    whole = text(70, 80).split()
    edited = whole[:20] + ["changed"] + whole[21:35] + ["other"] + whole[36:]
    opening = whole[:40]
    rows = [(1, opening + text(71, 60).split()), (2, text(72, 30).split() + whole), (3, opening + text(73, 60).split()), (4, text(74, 50).split() + edited)]
    # every ten words of one passage also stand, alone, in a document before and one between
    long = text(75, 70).split()
    pieces = [long[k : k + 10] for k in range(0, 70, 10)]
    rows += [(10 + k, text(80 + k, 60).split() + p) for k, p in enumerate(pieces)] + [(20, long + text(90, 50).split())]
    rows += [(30 + k, text(100 + k, 60).split() + p) for k, p in enumerate(pieces)] + [(40, text(91, 50).split() + long)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = {(r.doc_id, r.source_id): (r.start, r.stop, r.source_start, r.source_stop) for r in substring_dedup.fuzzy_passages(frame).collect()}
    assert got[4, 2] == (50, 130, 30, 110)
    assert got[40, 20] == (50, 120, 0, 70)
    assert set(got) == {(4, 2), (40, 20)}


def test_embeddings(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 32))
    near = x[:40] + 0.04 * r.standard_normal((40, 32))
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.vstack([x, near, x[:3], 2 * x[5:6]]))]
    odd = [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, [None] * 32, 1), (None, x[0].tolist(), 1)]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cell int")
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in embedding_dedup.near_duplicates(d).collect()}
    a = np.array([v for _, v, _ in rows])
    a /= np.linalg.norm(a, axis=1)[:, None]
    degree = ((a @ a.T) >= 0.95).sum(1) - 1
    found = np.array([got[k][0] for k, _, _ in rows])
    assert found.sum() >= 0.9 * degree.sum() and (found <= degree).all()
    assert all(got[k] == (0, k, True) for k in (900, 901, 902, 903))
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "user", "there <|end|>\n"), (1, 2, "assistant", "a&amp;b <|next|> &lt;|"), (1, 3, "assistant", None), (2, 0, "assistant", r"\### Assistant: </turn> ok"),
        (2, 0, "assistant", r"\### Assistant: </turn> ok"), (3, None, None, ""), (4, 1, "we|>ird<|", "<"), (None, 0, "user", "x"),
    ]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pieces int")
    f = chat_format.format_chats(d)
    got = {r.conv_id: r for r in chat_format.read_chats(f).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(t for r, t in want if r == "assistant")
    assert {r.conv_id: r.n_blocks for r in f.collect()}[1] == 2
    assert chat_format.format_chats(d.limit(0)).count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.digest(docs).collect()
    assert len(got) == docs.count()
    rows = spark.createDataFrame([(k if k % 3 else 7, (k * 37) % 100 + 1, "z") for k in range(3000)] + [(None, None, None)], "k long, s long, shard_name string")
    out = sharding.assign_shards(rows, "k", "s", 8, ranges=16).collect()
    sums, slots = {}, {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + (r.s or 0)
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sums.values()) - min(sums.values()) <= 200
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.digest(empty).count() == 0


def test_packing(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    base = Tokenizer.from_file(path)
    sample = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    d = sample.unionByName(docs.where("doc_id < 11").selectExpr("doc_id + 1000000 AS doc_id", "text"))
    got = packing.pack(d, path).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for row in d.collect():
        ids = np.array([*base.encode(row.text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[row.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert packing.pack(empty, path).count() == 0


def test_fast_tokens_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    base, fast = Tokenizer.from_file(path), packing.Tokens(path)
    for t in ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's  3.5%\t\tok", "été 中文", "x y z", "a\n\nb c", "we'll 've 's", "<|endof text|>", "<|endoftext|>", "a <|endoftext|>\n<|endoftext|>é", "ab " * 60_000]:
        ids = fast.encode(t)
        assert ids.tolist() == base.encode(t, add_special_tokens=False).ids, repr(t[:50])
        assert fast.sizes[ids].sum() == len(t.encode())
    ids = fast.encode("ask: why? <|endoftext|>answer: é because")
    on = fast.bears(ids, [(23, 40)])
    at = np.cumsum(fast.sizes[ids]) - fast.sizes[ids]
    assert on.tolist() == [23 <= a < 40 for a in at]


@pytest.mark.parametrize("limits", [(64, 512, 2048), (2048, 3, 2048), (2048, 512, 20), (64, 4, 20)])
def test_packing_limits_bind(spark, limits):
    """Each of the three limits by itself, and all at once; ids that bear loss are those of the given spans."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = packing.Tokens(path)
    rows = []
    for k in range(120):
        ask, reply = text(k, 3 + k % 20) + " ", text(k + 500, 2 + k % 31)
        rows.append((k if k % 10 else None, ask + reply, [(len(ask), len(ask + reply))] if k % 3 else None, 5))
    rows += [(7, "same id", None, 5), (8, None, [(0, 4)], 5), (9, "", [], 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<start:int,stop:int>>, length int").coalesce(1)
    got = packing.pack(d, path, loss_col="spans", max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], window=16).collect()
    want = {"tokens": 0, "loss": 0}
    for _, t, s, _ in rows:
        ids = tokens.encode(t or "")
        on = tokens.bears(ids, s) if s is not None else np.ones(len(ids), bool)
        want["tokens"] += len(ids) + 1
        want["loss"] += int(on.sum()) + (1 if s is None else int(len(on) > 0 and on[-1]))
    assert sum(r.length for r in got) == want["tokens"] and sum(r.loss_tokens for r in got) == want["loss"]
    assert sum(r.doc_id is None and r.start == 0 for r in got) == 12 and sum(r.doc_id == 7 and r.start == 0 for r in got) == 2
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    totals = [(sum(r.length for r in s), len(s), sum(r.loss_tokens for r in s)) for s in sequences.values()]
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *[r.length for r in s]])[:-1].tolist()
    assert all(a <= b for t in totals for a, b in zip(t, limits, strict=True))
    # all but the last sequences are full in one of the three
    assert sum(not any(a == b for a, b in zip(t, limits, strict=True)) for t in totals) <= 2 + len(totals) // 10


def test_arc_versions():
    for version in (1, 2):
        blob = arc_to_warc.arc_records(version, "x.arc", [("http://a/b c", "1.2.3.4", "20240102030405", "text/html", 200, b"HTTP/1.1 200 OK\r\n\r\nbody\nmore"), ("dns:a", "0.0.0.0", "20240102030405", "text/dns", 200, b"")])
        got = list(arc_to_warc.parse_arc(blob))
        assert [g["block"] for g in got] == [b"HTTP/1.1 200 OK\r\n\r\nbody\nmore", b""] and got[0]["URL"] == "http://a/b%20c" and got[1]["URL"] == "dns:a"
    with pytest.raises(ValueError):
        list(arc_to_warc.parse_arc(blob[:-9] + b"\nhttp://z 0 0 t 1 - - 0 - 99\nx"))


def test_arc_to_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a 4", ""), (5, "http://é", "WARC/1.1\r\n\r\nWARC-Type: x\r\n\r\n"), (None, "u", "lonely"), (6, "ftp://x", "z" * 300_000)]
    d = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, block string")
    got = {r.page_id: r for r in arc_to_warc.round_trip(d, f"file://{tmp_path}/w").collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {1: ("revisit", 2), 3: ("revisit", 4)}
    assert arc_to_warc.round_trip(d.limit(0), f"file://{tmp_path}/e").count() == 0


def test_toxicity(spark):
    plain = lambda k: re.sub(r"\d+", "", text(k, 80))
    rows = [(k, plain(k) + (" you utter nitwit and fool" if k % 4 == 0 else "") + " " + plain(-k + 9000), "en") for k in range(1500)] + [(1000000, None, None), (1000001, "", None), (None, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "s") for k in range(1500)] + [(None, 1, ""), (5, None, "")], "doc_id long, toxic int, text string")
    model = toxicity.train(d, labels)
    got = toxicity.digest(d, model).collect()
    assert len(got) == 1503 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9
    bare = toxicity.train(d, labels.limit(0))
    assert toxicity.digest(d, bare).count() == 1503


def test_packing_takes_long_runs_of_blanks(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a" * 1_000_000, 4: "x" + " " * 70_000 + "y"}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path).collect()
    for k, t in texts.items():
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.start for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])[:-1]]).tolist()
        assert {r.doc_tokens for r in own} == {len(ids)} and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_memory_of_a_bucket_of_strings():
    """The strings of one bucket take some 45 bytes for each of theirs, places in 32 bits."""
    import tracemalloc

    import pyarrow as pa

    sd, r, n = suffix_dedup, np.random.default_rng(1), 120_000
    base = r.integers(98, 120, 200_000, dtype=np.uint8)
    heads = np.zeros(5, sd._HEAD)
    heads["id"], heads["row"], heads["strings"] = range(5), range(5), n - 99
    flat = b"".join(np.r_[base[k * 9 : n // 2 + k * 9], r.integers(98, 120, n // 2, dtype=np.uint8)].tobytes() for k in range(5))
    t = pa.table({"heads": pa.array([heads.tobytes()], pa.binary()), "bytes": pa.array([flat], pa.binary()), "gone": pa.array([b""], pa.binary()), "batch": pa.array([0], pa.int32())})
    tracemalloc.start()
    found = sd._bucket_rows(100)(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gone = np.concatenate([np.frombuffer(g, sd._GONE) for g in found.column("gone").to_pylist()])
    assert sorted((g["row"], g["at"], g["stop"]) for g in gone) == [(k, 0, n // 2 - 9) for k in range(1, 5)]
    assert peak < 55 * len(flat)
