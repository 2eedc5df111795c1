"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct word shingles; two documents link at a Jaccard similarity of at least
``percent``/100. Two linked sets miss at most ``n - ceil(percent n / 100)`` of either's tokens, so their prefixes
under one global order share a token, and extended prefixes share a combination of k tokens.

1. Under hash order, a prefix longer by k - 1 shares k tokens with that of any linked set. With k growing with the
   size of the set (``_need``), documents that share fewer prefix tokens with others are found; they link with nothing.
2. Among the distinct sets that are left, document frequencies are counted over all of them. Tokens of one document
   only are certain misses. The others are ordered by frequency; rare tokens are indexed singly, frequent ones in
   pairs within small parts of the token space, very frequent ones in triples, and the prefix is extended until its
   signatures outnumber the misses that are left (a part with m tokens under k-combinations counts m - k + 1).
3. A signature's group pairs all its members while small, else all with its first one; pairs are verified on whole
   sets. Where large groups still span several components, their members are compared across components in blocks
   of sets, so that no link between components is lost.

Nothing is capped: every pair that could link is verified or lies within one component already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, connected_components, cut, lean, n_buckets, shingles

#: Groups up to this size pair all members; tokens up to this frequency are indexed singly.
RARE = 24
#: Tokens above this frequency are indexed in triples.
COMMON = 4096
#: Stands for the documents of a token that its batch has counted already.
COUNTED = -(2**62)
_CACHE = WordHashes()


def _sets(batch, width: int):
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
        yield i, shingles(_CACHE.of(words), width)


def _misses(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100


def _need(n: int) -> int:
    """Prefix tokens that linked sets of ``n`` tokens share at least, where the prefix is longer by as many less one."""
    return 1 + n // 10


def _blobs(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket number, one bytes per column) for each bucket, in one sort."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    ends = np.flatnonzero(np.diff(b)) + 1
    columns = [c[order] for c in columns]
    for s, e in zip(np.r_[0, ends], np.r_[ends, len(b)], strict=True):
        if e > s:
            yield int(b[s]), *(c[s:e].tobytes() for c in columns)


def _short(h: np.ndarray) -> np.ndarray:
    """40 bits of each hash: within a bucket seldom the same for two tokens, and a chance meeting only costs a check."""
    return (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].copy()


def _long(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.view("<u8").ravel()


def _prefix_rows(width: int, percent: int, buckets: int):
    def run(batches):
        for batch in batches:
            ids, sizes, hashes, owner = [], [], [], []
            for i, s in _sets(batch, width):
                if i is None:
                    continue
                ids.append(i)
                sizes.append(len(s))
                if len(s):
                    p = s[: _misses(len(s), percent) + _need(len(s))]
                    hashes.append(p)
                    owner.append(np.full(len(p), i, np.int64))
            rows = []
            if ids:
                rows.append((ids[0] % buckets, b"", np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), b""))
            if hashes:
                h, o = np.concatenate(hashes), np.concatenate(owner)
                order = np.lexsort((o, h))
                h, o = h[order], o[order]
                first = np.r_[True, h[1:] != h[:-1]]
                starts = np.flatnonzero(first)
                shared = np.minimum.reduceat(o, starts) != np.maximum.reduceat(o, starts)
                met = o[np.repeat(shared, np.diff(np.r_[starts, len(h)]))]
                h, o = h[starts], np.where(shared, COUNTED, o[starts])
                rows += [(k, x, y, b"", b"") for k, x, y in _blobs((h % np.uint64(buckets)).astype(np.int64), _short(h), o)]
                if len(met):
                    rows.append((int(met[0]) % buckets, b"", b"", b"", met.tobytes()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["bucket", "hashes", "ids", "sizes", "met"])

    return run


def _cat(column, dtype):
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _meet(t):
    """Per bucket: sizes as they are, and for documents, how many prefix tokens they share with others."""
    plain = np.array([len(x) > 0 for x in t.column("hashes").to_pylist()], bool)
    h, o = _long(_cat(t.column("hashes"), np.uint8)), _cat(t.filter(pa.array(plain)).column("ids"), np.int64)
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    ends = np.diff(np.r_[starts, len(h)])
    # entries of one document only say nothing; those that a batch has counted already are marked
    one = (np.minimum.reduceat(o, starts) == np.maximum.reduceat(o, starts)) if len(h) else np.empty(0, bool)
    on = ~np.repeat(one, ends) & (o != COUNTED)
    met, c = np.unique(np.concatenate([o[on], _cat(t.column("met"), np.int64)]), return_counts=True)
    ids, sizes = _cat(t.filter(pa.array(~plain)).column("ids"), np.int64), _cat(t.column("sizes"), np.int64)
    return pa.table({"id": np.r_[ids, met], "n": pa.array(np.r_[sizes, np.zeros(len(met), np.int64)], mask=np.r_[np.zeros(len(ids), bool), np.ones(len(met), bool)]), "met": np.r_[np.zeros(len(ids), np.int64), c]})


def _set_rows(width: int):
    """(id, digest, n, tokens): the sets; of equal sets in a batch only the row of the smallest id has the tokens."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids, digests, sizes, blobs, first = [], [], [], [], {}
            for i, s in _sets(batch, width):
                d = xxhash.xxh3_128_digest(s.tobytes())
                if d not in first or (i is not None and i < ids[first[d]]):
                    if d in first:
                        blobs[first[d]] = None
                    first[d] = len(ids)
                    blobs.append(s.tobytes())
                else:
                    blobs.append(None)
                ids.append(i)
                digests.append(d)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "digest", "n", "tokens"])

    return run


def _head_rows(batches):
    """From rows sorted by (digest, id): (id, head, node, tokens), tokens only at the first row of a set."""
    now, head, node = None, None, None
    for batch in batches:
        out = [[], [], [], []]
        for i, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            new = d != now
            if new:
                now, head, node = d, i, int.from_bytes(d[:8], "little", signed=True)
            for c, v in zip(out, (i, head, node, t if new else None), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], names=["id", "head", "node", "tokens"])


def _count_rows(buckets: int):
    def run(key, t):
        h, c = np.unique(_cat(t.column("tokens"), np.uint64), return_counts=True)
        rows = list(zip(*_blobs((h % np.uint64(buckets)).astype(np.int64), h, c.astype(np.int32)), strict=True)) or [[]] * 3
        return pa.table({"bucket": pa.array(rows[0], pa.int32()), "batch": pa.array([key[0].as_py()] * len(rows[0]), pa.int32()), "hashes": pa.array(rows[1], pa.binary()), "counts": pa.array(rows[2], pa.binary())})

    return run


def _shared_rows(t):
    """Per bucket of tokens: to each batch its tokens of more than one document, and their frequencies."""
    h, c = _cat(t.column("hashes"), np.uint64), _cat(t.column("counts"), np.int32)
    batch = np.repeat(np.array(t.column("batch").to_pylist(), np.int64), [len(x) // 8 for x in t.column("hashes").to_pylist()])
    u, inv = np.unique(h, return_inverse=True)
    df = np.bincount(inv, c, len(u)).astype(np.int64)[inv] if len(u) else np.empty(0, np.int64)
    many = df > 1
    rows = list(zip(*_blobs(batch[many], h[many], df[many]), strict=True)) or [[]] * 3
    return pa.table({"batch": pa.array(rows[0], pa.int32()), "hashes": pa.array(rows[1], pa.binary()), "df": pa.array(rows[2], pa.binary())})


def _combinations(h: np.ndarray, part: np.ndarray, k: int):
    """Sums of all k-combinations within each part, as hashes."""
    order = np.lexsort((h, part))
    h, part = h[order], part[order]
    ends = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip(np.r_[0, ends], np.r_[ends, len(h)], strict=True):
        x = h[s:e]
        if len(x) < k:
            continue
        if k == 2:
            i, j = np.triu_indices(len(x), 1)
            yield x[i] * np.uint64(3) + x[j] * np.uint64(0x9E3779B97F4A7C17)
        else:
            i, j = np.triu_indices(len(x), 1)
            for m in range(len(x) - 2):
                on = i > m
                yield x[m : m + 1] * np.uint64(5) + x[i[on]] * np.uint64(3) + x[j[on]] * np.uint64(0x9E3779B97F4A7C17)


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, rare: int = RARE, common: int = COMMON) -> np.ndarray:
    """Signatures of one set; ``tokens`` are those of several documents, with their frequencies, ``n`` the set's size."""
    spare = _misses(n, percent) - (n - len(tokens))
    if spare < 0 or n < 4:
        return np.empty(0, np.uint64)  # too many tokens of its own; sets under 4 link only with equals
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    kind = np.where(df <= rare, 1, np.where(df <= common, 2, 3))
    level = int(np.log(n) / np.log(1.25))
    out = []
    for label in (level, level + 1):  # similar sets have levels at most one apart
        parts = np.uint64(max(1, int(0.05 * 1.25 ** (label - 1))))
        part = np.where(kind == 1, np.uint64(0), (tokens >> np.uint64(20)) % parts).astype(np.int64)
        place = kind * (1 << 40) + part
        _, inv = np.unique(place, return_inverse=True)
        o = np.argsort(inv, kind="stable")
        seen = np.empty(len(o), np.int64)
        starts = np.r_[0, np.flatnonzero(np.diff(inv[o])) + 1] if len(o) else np.empty(0, np.int64)
        seen[o] = np.arange(len(o)) - np.repeat(starts, np.diff(np.r_[starts, len(o)]))
        credit = np.cumsum(seen >= kind - 1)
        cut_at = int(np.searchsorted(credit, spare + 1)) + 1
        t, k, p = tokens[:cut_at], kind[:cut_at], part[:cut_at]
        salt = np.uint64(label * 0x100000001B3)
        found = [t[k == 1]]
        for c in (2, 3):
            found += list(_combinations(t[k == c], p[k == c], c))
        s = np.concatenate(found)
        out.append((s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + salt)
    return np.unique(np.concatenate(out))


def _signature_rows(percent: int):
    def run(sets, shared):
        h, df = _cat(shared.column("hashes"), np.uint64), _cat(shared.column("df"), np.int64)
        order = np.argsort(h)
        h, df = h[order], df[order]
        sig, ids, sizes = [], [], []
        for i, blob in zip(sets.column("id").to_pylist(), sets.column("tokens").to_pylist(), strict=True):
            t = np.frombuffer(blob, np.uint64)
            if not len(h) or not len(t):
                continue
            at = np.minimum(np.searchsorted(h, t), len(h) - 1)
            on = h[at] == t
            s = signatures(t[on], df[at[on]], len(t), percent)
            sig.append(s)
            ids.append(np.full(len(s), i, np.int64))
            sizes.append(np.full(len(s), len(t), np.int64))
        cat = lambda x, d: np.concatenate(x) if x else np.empty(0, d)
        return pa.table({"sig": cat(sig, np.uint64).view(np.int64), "id": cat(ids, np.int64), "n": cat(sizes, np.int64)})

    return run


def _pair_rows(percent: int, rare: int = RARE):
    """From rows sorted by (sig, label, id): pairs of small groups, stars of large ones; with labels, pairs across them."""

    def fits(a, b):
        return 100 * min(a, b) >= percent * max(a, b)

    def run(batches):
        out: list[tuple] = []
        group: list[tuple] = []
        now, large = None, False
        for batch in batches:
            for sig, i, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if sig != now:
                    now, group, large = sig, [], False
                if large:
                    a, m = group[0]
                    if a != i and fits(m, n):
                        out.append((a, i))
                else:
                    out += [(a, i) for a, m in group if a != i and fits(m, n)]
                    group.append((i, n))
                    large = len(group) > rare
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
            out = []

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(_verify(percent)), "a long, b long")


def _block_links(percent: int):
    """Links between labels among the sets of one or two blocks, no more than join them up."""

    def run(t):
        ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in t.column("tokens").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        own = t.column("block").to_numpy()
        order = np.argsort(own, kind="stable")
        half = int((own == own.min()).sum()) if own.min() != own.max() else 0
        left = order[:half] if half else order
        right = order[half:] if half else order
        found: list[tuple] = []
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        # tokens of both sides, in slices that keep the matrices small
        x = np.concatenate([sets[k] for k in left])
        y = np.concatenate([sets[k] for k in right])
        xr, yr = np.repeat(np.arange(len(left)), sizes[left]), np.repeat(np.arange(len(right)), sizes[right])
        vocabulary, counts = np.unique(np.concatenate([x, y] if half else [x]), return_counts=True)
        vocabulary = vocabulary[counts > 1]
        both = np.zeros((len(left), len(right)), np.float32)
        for s in range(0, len(vocabulary), 4096):
            v = vocabulary[s : s + 4096]
            m, n = np.zeros((len(left), len(v)), np.float32), np.zeros((len(right), len(v)), np.float32)
            for mat, tok, row in ((m, x, xr), (n, y, yr)):
                at = np.minimum(np.searchsorted(v, tok), len(v) - 1)
                on = v[at] == tok
                mat[row[on], at[on]] = 1
            both += m @ n.T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        for a, b in zip(*np.nonzero((100 * both >= percent * union) & (labels[left][:, None] != labels[right][None, :])), strict=True):
            p, q = root(int(labels[left[a]])), root(int(labels[right[b]]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((int(ids[left[a]]), int(ids[right[b]])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _across(left: DataFrame, heads: DataFrame, percent: int, block: int = 400) -> DataFrame:
    """Links across labels within the groups of ``left`` (sig, id, label).

    Groups that share members are taken together and cut into blocks of about ``block`` sets; each two blocks meet in
    one task, which counts common tokens by a product of matrices and gives a spanning set of the links it finds.
    """
    low = left.groupBy("sig").agg(F.min("id").alias("low"))
    groups = connected_components(left.join(low, "sig").select(F.col("id").alias("a"), F.col("low").alias("b")).where("a <> b"))
    members = left.select("id", "label").distinct().join(groups.withColumnRenamed("node", "id"), "id")
    many = members.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(many, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi"))))
    dealt = dealt.join(heads.select("id", "tokens"), "id").select("id", "label", "component", "block", "tokens", pair.alias("p"))
    return dealt.select("id", "label", "component", "block", "tokens", "p.lo", "p.hi").groupBy("component", "lo", "hi").applyInArrow(_block_links(percent), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, few: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each document.

    The ids that pass the first step are counted; up to ``few`` of them are broadcast to pick their texts where these
    lie, more are joined by a shuffle.

    Words are runs of non-white bytes with A-Z lower-cased. A null or blank text has no shingles and links with
    nothing; equal texts link if they have words. Rows of one id are one node (each row is returned with the size
    of its own set). Rows without an id are returned with no component. Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets = n_buckets(spark)
    seen = d.mapInArrow(lean(_prefix_rows(width, percent, buckets)), "bucket int, hashes binary, ids binary, sizes binary, met binary").groupBy("bucket").applyInArrow(_meet, "id long, n long, met long")
    seen = cut(seen.groupBy("id", "n").agg(F.sum("met").alias("met"), F.count("*").cast("int").alias("rows")))
    need = 1 + F.floor(F.floor((F.min("n") * percent + 99) / 100) / 10)
    met = seen.groupBy("id").agg(F.sum("met").alias("met"), need.alias("need")).where("met >= need").select("id")
    met = F.broadcast(met) if met.count() <= few else met
    sets = d.join(met, "id").mapInArrow(lean(_set_rows(width)), "id long, digest binary, n long, tokens binary").select("id", "digest", "tokens")
    # a set is a node, numbered by its digest; ``head`` is the smallest id that has it
    sets = cut(sets.repartition("digest").sortWithinPartitions("digest", "id").mapInArrow(_head_rows, "id long, head long, node long, tokens binary"))
    batches = max(1, buckets // 2)
    heads = sets.where("tokens is not null").select(F.col("node").alias("id"), "tokens").withColumn("batch", F.pmod("id", F.lit(batches)).cast("int"))
    by_batch = heads.groupBy("batch")
    shared = by_batch.applyInArrow(_count_rows(buckets), "bucket int, batch int, hashes binary, counts binary").groupBy("bucket").applyInArrow(_shared_rows, "batch int, hashes binary, df binary")
    sigs = cut(by_batch.cogroup(shared.groupBy("batch")).applyInArrow(_signature_rows(percent), "sig long, id long, n long"))
    pairs = sigs.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(lean(_pair_rows(percent)), "a long, b long").distinct()
    links = cut(_linked(pairs, heads, percent))
    labels = cut(connected_components(links))
    big = sigs.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") > RARE).select("sig")
    wide = sigs.join(big, "sig").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    split = wide.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig")
    left = cut(wide.join(split, "sig").select("sig", "id", "label"))
    found = links.union(_across(left, heads, percent))
    # back to ids: a set's node is its head, and the other rows of the set are linked to it
    to_id = sets.where("tokens is not null").select("node", "head")
    by_id = found.join(to_id.select(F.col("node").alias("a"), F.col("head").alias("u")), "a").join(to_id.select(F.col("node").alias("b"), F.col("head").alias("v")), "b").select("u", "v")
    component = connected_components(by_id.union(sets.select("id", "head")).where("u <> v"), "u", "v")
    sizes = seen.where("n is not null").select("id", "n", F.explode(F.sequence(F.lit(1), "rows")))
    done = sizes.join(component.withColumnRenamed("node", "id"), "id", "left")
    nameless = d.where("id is null").mapInArrow(lean(_set_rows(width)), "id long, digest binary, n long, tokens binary").select("id", "n", F.lit(None).cast("long").alias("component"))
    return done.select("id", "n", F.coalesce("component", "id").alias("component")).union(nameless).toDF(id_col, "n_shingles", "component_id")
