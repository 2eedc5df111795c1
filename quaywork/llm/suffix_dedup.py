"""Exact substring dedup by suffix arrays, built with two-stage sorting.

Every ``length``-byte string is dealt by its anchor, the smallest hash among its ``gram``-byte substrings, so all its
occurrences meet in one bucket. Anchors that occur once over all documents are found first, and their strings left
out. For the others, each stretch of strings with one anchor is sent with its bytes; equal stretches of one batch are
sent once, and entered once in a bucket. A bucket's stretches are one text with a suffix array; suffixes smaller than their successors are sorted
directly, the rest induced by scans of the first-byte buckets; where adjacent common prefixes reach ``length``, all
occurrences but the earliest are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, n_buckets, release

# --- suffix arrays ---------------------------------------------------------------------------------------------


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number, zeros after the end."""
    pad = np.r_[text, np.zeros(16, np.uint8)].astype(np.uint64)
    w = (pad[:-1] << np.uint64(8)) | pad[1:]
    w = (w[:-2] << np.uint64(16)) | w[2:]
    return ((w[:-4] << np.uint64(32)) | w[4:])[: len(text) + 8]


def _places(n: int):
    """A type for places of a text of ``n`` bytes; most arrays hold places, so this decides how much memory a text takes."""
    return np.int32 if n < 2**31 - 4096 else np.int64


def _sort_directly(at: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the suffixes that start there, at least to ``depth`` bytes.

    Sorts by 8 bytes, then by 8 more within each group of ties, and so on. Groups whose members have one hash over
    all of ``depth`` are equal and need no further sorting.
    """
    last, kind = len(word) - 1, at.dtype
    at = at[np.argsort(word[at])]
    key = word[at]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]], dtype=kind) if len(at) else at
    where = np.arange(len(at), dtype=kind)
    del key
    digest = None
    for off in range(8, depth, 8):
        # keep groups of several that are not known to be equal
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(group)])
        keep = sizes > 1
        if digest is not None and len(starts):
            keep &= np.minimum.reduceat(digest, starts) != np.maximum.reduceat(digest, starts)
        keep = np.repeat(keep, sizes)
        where, group = where[keep], group[keep]
        if not len(where):
            break
        if digest is None:
            places, digest = at[where], np.zeros(len(where), np.uint64)
            for k in range(8, depth, 8):
                digest = (digest ^ word[np.minimum(places + k, last)]) * np.uint64(0x9E3779B97F4A7C15)
                digest ^= digest >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[starts, len(group)])
            keep = np.repeat(np.minimum.reduceat(digest, starts) != np.maximum.reduceat(digest, starts), sizes)
            where, group, digest = where[keep], group[keep], digest[keep]
            if not len(where):
                break
        else:
            digest = digest[keep]
        places = at[where]
        k = word[np.minimum(places + off, last)]
        order = np.lexsort((k, group))
        at[where] = places[order]
        k, group, digest = k[order], group[order], digest[order]
        group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (group[1:] != group[:-1])], dtype=kind)
    return at


def suffix_array(text: np.ndarray, depth: int, word: np.ndarray | None = None) -> np.ndarray:
    """Starts of the suffixes of ``text`` (uint8, ending in 0) in order of their first ``depth`` bytes at least."""
    kind = _places(len(text))
    word = _words(text) if word is None else word
    # small: smaller than the next suffix; equal first bytes take the answer of the next place with another byte
    nxt = np.r_[text[1:], 0]
    differ = text != nxt
    known = np.append(text[differ] < nxt[differ], True)
    small = known[np.cumsum(differ, dtype=kind) - differ]
    small[-1] = True
    del nxt, differ, known
    direct = _sort_directly(np.flatnonzero(small).astype(kind), word, depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    pushed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = [np.concatenate(pushed[c])] if pushed[c] else []
        wave = part[0] if part else np.empty(0, kind)
        while len(wave):  # large suffixes before suffixes of the same first byte
            wave = wave[wave > 0] - 1
            wave = wave[(text[wave] == c) & ~small[wave]]
            if len(wave):
                part.append(wave)
        part.append(direct[bounds[c] : bounds[c + 1]])
        full = np.concatenate(part)
        out.append(full)
        before = full[full > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            ends = np.flatnonzero(np.diff(first)) + 1
            for s, e in zip(np.r_[0, ends], np.r_[ends, len(first)], strict=True):
                pushed[first[s]].append(before[s:e])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, word: np.ndarray | None = None) -> np.ndarray:
    """Of each suffix with the one before it in ``sa``, up to ``most`` bytes (0 for the first)."""
    word = _words(text) if word is None else word
    lcp, last = np.zeros(len(sa), _places(most)), len(word) - 1
    step = 1 << 18  # at once, so that what is needed besides is bounded
    for s in range(1, len(sa), step):
        on = np.arange(s, min(s + step, len(sa)))
        for k in range(0, most, 8):
            differ = word[np.minimum(sa[on] + k, last)] ^ word[np.minimum(sa[on - 1] + k, last)]
            lcp[on] = k + 8
            off = differ != 0
            at, differ = on[off], differ[off]
            lead = np.zeros(len(at), np.int64)
            for b in range(1, 8):  # whole bytes that agree
                lead += differ < np.uint64(1 << (8 * (8 - b)))
            lcp[at] = k + lead
            on = on[~off]
            if not len(on):
                break
    return np.minimum(lcp, most, out=lcp)


# --- anchors ---------------------------------------------------------------------------------------------------


def _grams(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes (a power of two) at each place."""
    h, step, w = raw.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while w < gram:
        h = h[:-w] * np.uint64(step) + h[w:]
        step, w = (step * step + 2) % 2**64, 2 * w
    return mix(h)


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (w - have)], h[w - have :]) if w > have else h


class _Batch:
    """The texts of a batch end to end, rows sorted by id and text, and the stretches of strings with one anchor."""

    def __init__(self, t: pa.Table, length: int, gram: int):
        ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
        rows = sorted((-(2**63) if i is None else i, x.encode("utf-8", "surrogatepass") if x else b"", k) for k, (i, x) in enumerate(zip(ids, texts, strict=True)))
        self.ids, self.texts, self.order = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        sizes = np.array([len(x) for x in self.texts], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.row = self.start = self.stop = np.empty(0, np.int64)
        self.anchor, self.twice = np.empty(0, np.uint64), np.empty(0, bool)
        if len(self.bytes) < length:
            return
        step = 1 << 15  # pieces that stay in the processor's cache
        w = length - gram + 1
        least = np.empty(len(self.bytes) - length + 1, np.uint64)  # of the string at each place
        leads = np.empty(len(least), bool)  # whether its first gram is that
        for k in range(0, len(least), step):
            h = _grams(self.bytes[k : k + step + length - 1], gram)
            m = _window_min(h, w)
            least[k : k + len(m)], leads[k : k + len(m)] = m, h[: len(m)] == m
        ok = np.zeros(len(least) + 1, np.int8)
        for b, n in zip(self.begin, sizes, strict=True):
            if n >= length:
                ok[b : b + n - length + 1] = 1
        ok = ok[: len(least)]
        new = np.r_[True, (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])]
        doc_starts = self.begin[sizes >= length]
        new[doc_starts] = True
        starts = np.flatnonzero(new)
        stops = np.r_[starts[1:], len(least)]
        keep = ok[starts] == 1
        self.start, self.stop = starts[keep], stops[keep]
        self.anchor = least[self.start]
        # strings that repeat within one stretch: the anchor has left the string, and the next one has it again
        again = leads[:-1] & (least[1:] == least[:-1])
        del leads, least
        back = np.r_[np.int32(0), np.cumsum(again, dtype=np.int32)]
        self.twice = back[self.stop - 1] > back[self.start]
        self.row = np.searchsorted(self.begin, self.start, "right") - 1
        # rows without bytes begin where the next row does
        while len(self.row) and (empty := sizes[self.row] == 0).any():
            self.row[empty] -= 1


def _anchor_rows(length: int, gram: int, buckets: int):
    def run(key, t):
        b = _Batch(t, length, gram)
        h, inv, c = np.unique(b.anchor, return_inverse=True, return_counts=True)
        c[inv[b.twice]] += 1
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return _blob_table("bucket", bucket[order], {"batch": key[0].as_py()}, hashes=h[order], counts=np.minimum(c[order], 2).astype(np.uint8))

    return run


def _blob_table(name: str, keys: np.ndarray, fixed: dict, **columns: np.ndarray) -> pa.Table:
    """A row for each run of equal ``keys``: the key, ``fixed`` and the bytes of each column."""
    ends = np.flatnonzero(np.diff(keys)) + 1
    spans = [(s, e) for s, e in zip(np.r_[0, ends], np.r_[ends, len(keys)], strict=True) if e > s]
    out = {name: pa.array([int(keys[s]) for s, _ in spans], pa.int32())}
    out |= {k: pa.array([v] * len(spans), pa.int32()) for k, v in fixed.items()}
    return pa.table(out | {k: pa.array([v[s:e].tobytes() for s, e in spans], pa.binary()) for k, v in columns.items()})


def _cat(t: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), dtype)


def _repeated_rows(t):
    """Per bucket of anchors: to each batch those of its anchors that occur more than once."""
    h, c = _cat(t, "hashes", np.uint64), _cat(t, "counts", np.uint8)
    batch = np.repeat(np.array(t.column("batch").to_pylist(), np.int64), [len(x) // 8 for x in t.column("hashes").to_pylist()])
    u, inv = np.unique(h, return_inverse=True)
    many = np.bincount(inv, c, len(u))[inv] > 1 if len(u) else np.empty(0, bool)
    h, batch = h[many], batch[many]
    order = np.argsort(batch, kind="stable")
    return _blob_table("batch", batch[order], {}, hashes=h[order])


#: A stretch in a shuffle: its document's id and batch, its row there, its start, its number of strings; and, apart, its bytes.
_HEAD = np.dtype([("id", "<i8"), ("batch", "<i4"), ("row", "<i4"), ("at", "<i8"), ("strings", "<i8")])
#: Strings of a document that are not their first occurrence.
_GONE = np.dtype([("row", "<i4"), ("at", "<i8"), ("stop", "<i8")])


def _stretch_rows(length: int, gram: int, buckets: int):
    def run(docs, repeated):
        import xxhash

        release()  # of the groups before
        b, h = _Batch(docs, length, gram), _cat(repeated, "hashes", np.uint64)
        out = {"bucket": [], "batch": [], "heads": [], "bytes": [], "gone": []}
        if len(h) and len(b.anchor):
            h = np.sort(h)
            at = np.minimum(np.searchsorted(h, b.anchor), len(h) - 1)
            on = np.flatnonzero(h[at] == b.anchor)
            batch = docs.column("batch")[0].as_py()
            flat = b.bytes
            seen: set = set()
            gone, kept, pieces = [], [], []
            for k in on.tolist():  # in order of id and place, so the first of equal stretches is the earliest
                s, e = int(b.start[k]), int(b.stop[k])
                piece = flat[s : e + length - 1].tobytes()
                mark = xxhash.xxh3_128_digest(piece)
                row = int(b.row[k])
                place = s - int(b.begin[row])
                if mark in seen:
                    gone.append((row, place, place + e - s + length - 1))
                else:
                    seen.add(mark)
                    kept.append((b.ids[row], batch, row, place, e - s))
                    pieces.append(piece)
            heads = np.array(kept, _HEAD)
            bucket = (b.anchor[on] % np.uint64(buckets)).astype(np.int64)
            where: dict[int, list[int]] = {}
            sent = iter(range(len(kept)))
            gone_at = {(g[0], g[1]) for g in gone}
            for k, t in zip(on.tolist(), bucket.tolist(), strict=True):
                row = int(b.row[k])
                if (row, int(b.start[k]) - int(b.begin[row])) not in gone_at:
                    where.setdefault(t, []).append(next(sent))
            for t, ks in where.items():
                for c in ("bucket", "batch", "heads", "bytes", "gone"):
                    out[c].append({"bucket": t, "batch": batch, "heads": heads[ks].tobytes(), "bytes": b"".join(pieces[k] for k in ks), "gone": b""}[c])
            if gone:
                for c in ("bucket", "batch", "heads", "bytes", "gone"):
                    out[c].append({"bucket": batch % buckets, "batch": batch, "heads": b"", "bytes": b"", "gone": _merged(np.array(gone, _GONE)).tobytes()}[c])
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "batch": pa.array(out["batch"], pa.int32()), "heads": pa.array(out["heads"], pa.binary()), "bytes": pa.array(out["bytes"], pa.binary()), "gone": pa.array(out["gone"], pa.binary())})

    return run


def _merged(gone: np.ndarray) -> np.ndarray:
    """Spans of a row that overlap or touch, as one."""
    if not len(gone):
        return gone
    gone = gone[np.lexsort((gone["at"], gone["row"]))]
    shift = gone["row"].astype(np.int64) << 40
    s, e = gone["at"] + shift, np.maximum.accumulate(gone["stop"] + shift)
    first = np.r_[True, s[1:] > e[:-1]]
    out = gone[first].copy()
    out["stop"] = (e[np.r_[np.flatnonzero(first)[1:] - 1, len(e) - 1]] - (out["row"].astype(np.int64) << 40))
    return out


def _distinct(heads: np.ndarray, flat: bytes, length: int):
    """The earliest of equal stretches, their bytes, and the spans of the others by batch."""
    import xxhash

    sizes = heads["strings"] + length - 1
    ends = np.cumsum(sizes)
    marks: dict[bytes, int] = {}
    first, again = [], []
    for k in np.lexsort((heads["at"], heads["row"], heads["batch"], heads["id"])).tolist():
        mark = xxhash.xxh3_128_digest(flat[ends[k] - sizes[k] : ends[k]])
        (first if marks.setdefault(mark, k) == k else again).append(k)
    first.sort()
    raw = np.frombuffer(b"".join(flat[ends[k] - sizes[k] : ends[k]] for k in first), np.uint8)
    found, out = heads[again], []
    for batch in np.unique(found["batch"]):
        own = found[found["batch"] == batch]
        gone = np.empty(len(own), _GONE)
        gone["row"], gone["at"], gone["stop"] = own["row"], own["at"], own["at"] + own["strings"] + length - 1
        out.append((int(batch), _merged(gone).tobytes()))
    return heads[first], raw, out


def _bucket_rows(length: int):
    def run(t):
        release()  # of the buckets before
        heads = np.frombuffer(b"".join(t.column("heads").to_pylist()), _HEAD)
        passed = [(b, g) for b, g in zip(t.column("batch").to_pylist(), t.column("gone").to_pylist(), strict=True) if g]
        if len(heads):
            heads, raw, again = _distinct(heads, b"".join(t.column("bytes").to_pylist()), length)
            passed += again
            sizes = heads["strings"] + length - 1
            # a 0 after each stretch; bytes are one more (UTF-8 has none above 244)
            ends = np.cumsum(sizes + 1)
            text = np.zeros(int(ends[-1]), np.uint8)
            inside = np.ones(len(text), bool)
            inside[ends - 1] = False
            text[inside] = raw + np.uint8(1)
            del raw
            word = _words(text)
            sa = suffix_array(text, length, word)
            lcp = common_prefixes(text, sa, length, word)
            kind = _places(len(text))
            del word, text, inside
            whole = lcp >= length
            del lcp
            groups = np.cumsum(~whole, dtype=kind)
            tied = whole | np.r_[whole[1:], False]
            places, groups = sa[tied], groups[tied]
            del sa, whole, tied
            if len(places):
                k = np.searchsorted(ends, places, "right").astype(kind)
                rank = np.empty(len(heads), kind)
                order = np.lexsort((heads["at"], heads["row"], heads["batch"], heads["id"]))
                rank[order] = np.arange(len(order))
                at = (places - (ends - sizes - 1)[k]).astype(kind)
                del places
                inside = at < heads["strings"][k]  # others run past the end of their stretch
                k, at, groups = k[inside], at[inside], groups[inside]
                sort = np.lexsort((at, rank[k], groups))
                k, at, groups = k[sort], at[sort], groups[sort]
                later = np.r_[False, groups[1:] == groups[:-1]]
                k, at = k[later], at[later]
                found = np.empty(len(k), _GONE)
                found["row"], found["at"] = heads["row"][k], heads["at"][k] + at
                found["stop"] = found["at"] + length
                batch = heads["batch"][k]
                order = np.argsort(batch, kind="stable")
                batch, found = batch[order], found[order]
                cuts = np.flatnonzero(np.diff(batch)) + 1
                for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(batch)], strict=True):
                    if e > s:
                        passed.append((int(batch[s]), _merged(found[s:e]).tobytes()))
        return pa.table({"batch": pa.array([b for b, _ in passed], pa.int32()), "gone": pa.array([g for _, g in passed], pa.binary())})

    return run


_OUT = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("stops", pa.list_(pa.int64())), ("text", pa.string())])


def _apply_rows(length: int, gram: int, with_text: bool, carry: list[str]):
    def run(docs, spans):
        release()  # of the groups before
        b = _Batch(docs, 2**62, gram)
        gone = _merged(np.frombuffer(b"".join(spans.column("gone").to_pylist()), _GONE))
        first, last = np.searchsorted(gone["row"], np.arange(len(b.ids))), np.searchsorted(gone["row"], np.arange(len(b.ids)), "right")
        out = {k: [] for k in _OUT.names}
        for r, text in enumerate(b.texts):
            mine = gone[first[r] : last[r]]
            starts, stops = mine["at"].tolist(), mine["stop"].tolist()
            kept = b"".join(text[a:z] for a, z in zip([0, *stops], [*starts, len(text)], strict=True)) if starts else text
            shown = kept.decode("utf-8", "ignore") if with_text else None
            for k, v in zip(_OUT.names, (len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), starts, stops, shown), strict=True):
                out[k].append(v)
        given = docs.select(["doc_id", *carry]).take(pa.array(b.order, pa.int64()))
        done = pa.table(out, schema=_OUT)
        return pa.table({k: given.column(k) for k in given.column_names} | {k: done.column(k) for k in _OUT.names})

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 32, with_text: bool = True, carry: list[str] = ()) -> DataFrame:
    """(doc_id, ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256, starts, stops, text): a row for each document.

    Removed are the bytes inside any ``length``-byte string that also starts earlier: in a document with a smaller
    id, or further left in the same; spans, counts and the digest are of bytes. ``text`` is what is left (null without
    ``with_text``), without the odd bytes of characters that a span has cut. Null texts are empty; rows without an id
    come before all others; rows of one id are one after another by their text, so of repeated rows the first stays.
    A document is one row and so one task's work. Other columns are ignored.
    """
    spark = docs.sparkSession
    buckets = n_buckets(spark)
    batches = buckets
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    kept = [F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)]
    names = [f"carry_{k}" for k in range(len(carry))]
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept).withColumn("batch", F.pmod(key, F.lit(batches)).cast("int"))
    by_batch = d.groupBy("batch")
    anchors = by_batch.applyInArrow(_anchor_rows(length, gram, buckets), "bucket int, batch int, hashes binary, counts binary")
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated_rows, "batch int, hashes binary")
    stretches = by_batch.cogroup(repeated.groupBy("batch")).applyInArrow(_stretch_rows(length, gram, buckets), "bucket int, batch int, heads binary, bytes binary, gone binary")
    spans = stretches.groupBy("bucket").applyInArrow(_bucket_rows(length), "batch int, gone binary")
    types = dict(d.dtypes)
    schema = ", ".join(["doc_id long", *[f"{n} {types[n]}" for n in names], "n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>, text string"])
    out = by_batch.cogroup(spans.groupBy("batch")).applyInArrow(_apply_rows(length, gram, with_text, names), schema)
    return out.withColumnsRenamed(dict(zip(names, carry, strict=True)))
