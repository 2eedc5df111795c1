"""Benchmark decontamination: one Aho-Corasick automaton over normalised windows of benchmark items.

Texts are normalised to lower-cased runs of letters, digits and non-ASCII bytes between single spaces; windows of
``window`` words, and whole items that are shorter, are its patterns. Documents are scanned once, in place: no
shuffle. Hits are mapped back to words and, for hit documents, to byte spans of the original text.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, lean

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,stop:long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, item): the normalised windows of the items, made on the executors."""

    def run(batches):
        for batch in batches:
            pats, ids = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = words_of(text)
                if w:
                    new = {b" ".join(w[k : k + window]).decode("latin-1") for k in range(max(1, len(w) - window + 1))}
                    pats += new
                    ids += [i] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(pats, pa.string()), pa.array(ids, pa.string())], names=["pattern", "item"])

    return items.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "pattern string, item string")


def _automaton(patterns: dict[str, list]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for p, items in patterns.items():
        auto.add_word(f" {p} ", (p.count(" ") + 1, items))
    auto.make_automaton()
    return auto


def _scan(shared, text_name: str, kept: list[str]):
    built: list = []

    def run(batches):
        if not built:
            built.append(_automaton(shared.value) if shared.value else None)
        auto = built[0]
        for batch in batches:
            out = defaultdict(list)
            for text in batch.column(text_name).to_pylist():
                words = words_of(text)
                hits, items = [], set()
                if auto and words:
                    for end, (n, found) in auto.iter(f" {b' '.join(words).decode('latin-1')} "):
                        hits.append((end, n))
                        items.update(found)
                spans = []
                n_hit = 0
                if hits:
                    ends = np.cumsum([len(w) + 1 for w in words])  # of each word, its following space
                    covered = np.zeros(len(words) + 1, np.int64)
                    for end, n in hits:
                        last = int(np.searchsorted(ends, end))
                        covered[last - n + 1] += 1
                        covered[last + 1] -= 1
                    on = np.cumsum(covered[:-1]) > 0
                    n_hit = int(on.sum())
                    at = [m.span() for m in re.finditer(rb"[^ ]+", text.encode("utf-8", "surrogatepass").translate(ALNUM).replace(b"\n", b" "))]
                    runs = np.flatnonzero(np.diff(np.r_[0, on.astype(np.int8), 0]))
                    spans = [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in zip(runs[::2], runs[1::2], strict=True)]
                for k, v in (("n_words", len(words)), ("n_hit", n_hit), ("items", sorted(x for x in items if x is not None)), ("spans", spans)):
                    out[k].append(v)
            done = pa.RecordBatch.from_pydict(dict(out), schema=_SCHEMA) if out else pa.RecordBatch.from_pylist([], schema=_SCHEMA)
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in kept} | dict(zip(_SCHEMA.names, done.columns, strict=True)))

    return run


_SCHEMA = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_patterns: int = 2_000_000, with_text: bool = True) -> DataFrame:
    """``docs`` (its text only ``with_text``) with n_words, n_hit, items and spans: each document's words, those inside any window of the items, the
    items met (as strings, sorted), and the hit byte spans of the text in UTF-8.

    The automaton is broadcast; its patterns are counted first, and beyond ``max_patterns`` they are dealt to as many
    automata as needed, which scan one after another and whose spans are then joined within each row, so that a large
    benchmark loses nothing. Null or wordless texts have no words; items without words match nothing; an item without
    an id marks words but is not listed. Repeated rows are scanned each for itself.
    """
    spark = docs.sparkSession
    pats = windows(items, item_id, item_text, window)
    parts = max(1, -(-pats.count() // max_patterns))
    names = [f"given_{k}" for k in range(len(docs.columns))]
    text_name = names[docs.columns.index(text)]
    found = docs.toDF(*names)
    for k in range(parts):
        mine = defaultdict(list)
        for p, i in pats.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).toLocalIterator():
            mine[p].append(i)
        kept = [c for c in found.columns if with_text or parts > 1 or c != text_name]
        types = dict(found.dtypes)
        found = found.mapInArrow(lean(_scan(spark.sparkContext.broadcast(dict(mine)), text_name, kept)), ", ".join([*[f"{c} {types[c]}" for c in kept], RESULT]))
        if parts > 1:
            found = found.withColumnsRenamed({c: f"{c}_{k}" for c in ("n_words", "n_hit", "items", "spans")})
    if parts > 1:
        items_all = F.array_sort(F.array_distinct(F.concat(*[f"items_{k}" for k in range(parts)])))
        spans = F.array_sort(F.concat(*[f"spans_{k}" for k in range(parts)]))
        found = found.select(*names, F.col("n_words_0").alias("n_words"), items_all.alias("items"), spans.alias("spans"))
        types = dict(found.dtypes)
        kept = [c for c in names if with_text or c != text_name]
        found = found.mapInPandas(_recount(kept, text_name), ", ".join([*[f"{c} {types[c]}" for c in kept], RESULT]))
    return found.withColumnsRenamed(dict(zip(names, docs.columns, strict=True)))


def _recount(names: list[str], text_name: str):
    """Joins the spans of several automata and counts the words in them."""

    def run(frames):
        for f in frames:
            spans, hits = [], []
            for text, own in zip(f[text_name], f["spans"], strict=True):
                joined: list[list[int]] = []
                for x in own:
                    a, b = x["start"], x["stop"]
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                raw = text.encode("utf-8", "surrogatepass").translate(ALNUM) if text else b""
                hits.append(sum(len(raw[a:b].split()) for a, b in joined))
                spans.append([{"start": a, "stop": b} for a, b in joined])
            yield f.assign(n_hit=hits, spans=spans)[[*names, "n_words", "n_hit", "items", "spans"]]

    return run


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from those of ``contamination``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
