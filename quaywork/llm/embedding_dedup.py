"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Vectors are scaled to length 1; those of each length are compared among themselves.

1. Equal vectors are one node with a weight. Nodes that crowd together are contracted: a few members of each cell of
   sign bits stand as heads, the nodes near a head are averaged, and those within half the threshold angle of that
   mean are one ball. Any two of a ball link, whatever their number, so no pair of them is ever made.
2. Balls and single nodes are points. In each of many rounds the points are sorted along one random projection, within
   cells given by the signs of a few others; two points collide when they lie in one cell and within one window of
   each other, the window centred on either (wider by a ball's radius). Pairs that collide in at least ``count``
   rounds are verified. The number of rounds and the count come from the wanted recall: at the threshold angle a pair
   collides in a round with known probability, and rounds are independent.
3. Single nodes are verified by their cosine. Where a ball takes part, the angle between centres, more or less the radii,
   says that all members link or none; what lies between is verified member by member in blocks of a matrix product,
   which give each member its number of links and no pairs.

Projections are taken from the mean of all vectors, so that vectors that share a direction still spread over cells;
the signs' agreement is calibrated by their mean distance from it. A cell's line is cut into slices a window wide, and
each slice is a task's work of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut

#: A ball has at least so many nodes; fewer are cheaper as single nodes.
CROWD = 16
#: Heads that a cell offers its nodes.
HEADS = 3
#: Members of a ball that are compared in one block.
BLOCK = 1024


def plan(rows: int, cosine: float, recall: float = 0.995, count: int = 2, spread: float = 1.0) -> tuple[int, int, float]:
    """(sign bits, rounds, window): cells hold about a hundred points each; ``spread``: their distance from the mean."""
    bits = min(31, max(1, math.ceil(math.log2(max(2, rows / 100)))))
    far = math.sqrt(2 - 2 * cosine)
    window = far  # one standard deviation of the projected distance at the threshold
    angle = 2 * math.asin(min(1.0, far / 2 / max(spread, 1e-9)))
    hit = (1 - min(angle, math.pi / 2) / math.pi) ** bits * math.erf(1 / math.sqrt(2))
    rounds = count
    while sum(math.comb(rounds, k) * hit**k * (1 - hit) ** (rounds - k) for k in range(count)) > 1 - recall:
        rounds += 1
    return bits, rounds, window


def _unit(v) -> np.ndarray | None:
    """A usable vector at length 1, in double precision; its largest part is scaled first, so none over- or underflows."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    x = np.array(v, float)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / math.sqrt(float(x @ x)) + 0.0


def _clean_rows(batches):
    import xxhash

    for batch in batches:
        ids, marks, sizes, blobs = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = _unit(v) if i is not None else None
            if x is not None:
                blob = x.tobytes()
                ids.append(i)
                marks.append(xxhash.xxh3_128_digest(blob))
                sizes.append(len(x))
                blobs.append(blob)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "mark", "size", "vector"])


def _matrix(column) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), float).reshape(len(blobs), -1) if blobs else np.empty((0, 0))


def _by_size(batch, name: str = "size"):
    """Rows of a batch for each length of vector."""
    sizes = batch.column(name).to_numpy(zero_copy_only=False)
    for s in np.unique(sizes):
        yield int(s), batch.filter(pa.array(sizes == s))


def _sum_rows(batches):
    """(key, n, total) per key of a task: sums of vectors, before any shuffle. Input: key, size, vector."""
    held: dict = {}
    for batch in batches:
        for size, part in _by_size(batch):
            x = _matrix(part.column("vector"))
            keys, at = np.unique(part.column("key").to_numpy(zero_copy_only=False), return_inverse=True)
            total = np.zeros((len(keys), size))
            np.add.at(total, at, x)
            for k, n, t in zip(keys.tolist(), np.bincount(at).tolist(), total, strict=True):
                a, b = held.get((k, size), (0, 0.0))
                held[k, size] = a + n, b + t
        if len(held) > 4096:
            yield _sums(held)
            held = {}
    yield _sums(held)


def _sums(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())], names=["key", "n", "total"])


def _added(t: pa.Table) -> pa.Table:
    """The mean of a key from its sums, one for each task."""
    x = _matrix(t.column("total")).sum(0)
    return pa.table({"key": t.column("key")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "centre": pa.array([x.tobytes()], pa.binary())})


def _signs(x: np.ndarray, bits: int, seed: list[int]) -> np.ndarray:
    a = np.random.default_rng(seed).standard_normal((x.shape[1], bits))
    return ((x @ a) > 0) @ (1 << np.arange(bits, dtype=np.int64))


def _off(x: np.ndarray, size: int, means: dict[int, np.ndarray]) -> np.ndarray:
    return x - means[size] if size in means else x


def _deal_rows(bits: int, seed: int, means: dict):
    """Each node with its cell of sign bits."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch):
                x = _off(_matrix(part.column("vector")), size, means)
                key = _signs(x, bits, [seed, size]) | (size << 40)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *part.columns], names=["cell", *part.schema.names])

    return run


def _nearest_rows(cosine: float):
    """From (node, size, vector, heads): the node's nearest head of its cell, if within ``cosine``, as ``key``."""

    def run(batches):
        for batch in batches:
            for _, part in _by_size(batch):
                x, best, key = _matrix(part.column("vector")), np.full(part.num_rows, cosine), np.full(part.num_rows, 0)
                found = np.zeros(part.num_rows, bool)
                for k in range(HEADS):
                    c = np.einsum("ij,ij->i", x, _matrix(part.column(f"v{k}")))
                    on = c >= best
                    best[on], found[on] = c[on], True
                    key[on] = part.column(f"h{k}").to_numpy(zero_copy_only=False)[on]
                on = pa.array(found)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()).filter(on), *(part.column(c).filter(on) for c in ("node", "size", "vector"))], names=["key", "node", "size", "vector"])

    return run


def _ball_rows(half: float):
    """From (node, size, vector, key, centre): those within ``half`` (an angle) of the centre, and their angle."""

    def run(batches):
        for batch in batches:
            for _, part in _by_size(batch):
                x, c = _matrix(part.column("vector")), _matrix(part.column("centre"))
                c = c / np.sqrt((c * c).sum(1))[:, None]
                angle = _angle(x, c)
                on = pa.array(angle <= half)
                yield pa.RecordBatch.from_arrays([part.column("node").filter(on), part.column("key").filter(on), pa.array(angle, pa.float64()).filter(on)], names=["node", "ball", "angle"])

    return run


def _angle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles between unit rows, exact for small ones."""
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(((x - y) ** 2).sum(1)) / 2))


def _scaled_rows(batches):
    """Balls with their centres at length 1."""
    for batch in batches:
        for _, part in _by_size(batch):
            c = _matrix(part.column("vector"))
            c = c / np.sqrt((c * c).sum(1))[:, None]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("point", "radius", "weight", "id", "size")), pa.array([r.tobytes() for r in c], pa.binary())], names=["point", "radius", "weight", "id", "size", "vector"])


def _balls(nodes: DataFrame, bits: int, seed: int, means: dict, half: float) -> tuple[DataFrame, DataFrame]:
    """(node, ball, angle) of nodes within ``half`` of their ball's centre, in balls of ``CROWD`` or more; and the
    centres (ball, radius, vector)."""
    dealt = nodes.mapInArrow(_deal_rows(bits, seed, means), "cell long, node long, size int, vector binary")
    pick = [F.min_by(F.struct("node", "vector"), F.xxhash64("node", F.lit(seed + k))).alias(f"p{k}") for k in range(HEADS)]
    heads = dealt.groupBy("cell").agg(F.count("*").alias("n"), *pick).where(F.col("n") >= CROWD)
    heads = cut(heads.select("cell", *[F.col(f"p{k}.node").alias(f"h{k}") for k in range(HEADS)], *[F.col(f"p{k}.vector").alias(f"v{k}") for k in range(HEADS)]))
    near = cut(dealt.join(heads, "cell").mapInArrow(_nearest_rows(math.cos(1.6 * half)), "key long, node long, size int, vector binary"))
    sums = near.select("key", "size", "vector").mapInArrow(_sum_rows, "key long, n long, total binary")
    centres = cut(sums.groupBy("key").applyInArrow(_added, "key long, n long, centre binary").where(F.col("n") >= CROWD))
    inside = cut(near.join(centres.select("key", "centre"), "key").mapInArrow(_ball_rows(half), "node long, ball long, angle double"))
    many = cut(inside.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).where(F.col("n") >= CROWD).select("ball", "radius"))
    return inside.join(many, "ball").select("node", "ball"), many.join(centres.select(F.col("key").alias("ball"), F.col("centre").alias("vector")), "ball")


def _project_rows(bits: int, rounds: int, seed: int, means: dict, width: float, window: float):
    """Each point in each round: its cell, slice and place, and again, as a neighbour only, in the slice after."""

    def run(batches):
        for batch in batches:
            for size, part in _by_size(batch):
                x = _off(_matrix(part.column("vector")), size, means)
                ids, more = (part.column(c).to_numpy(zero_copy_only=False) for c in ("point", "radius"))
                for r in range(rounds):
                    a = np.random.default_rng([seed, r, size]).standard_normal((x.shape[1], bits + 1))
                    p = x @ a
                    cell = (p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) + ((size * 4096 + r) << 31)
                    at = p[:, bits]
                    part_of = np.floor(at / width).astype(np.int64)
                    reach = 2 * np.sin(more / 2)
                    for own in (True, False):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cell, pa.int64()), pa.array(part_of + (not own), pa.int64()), pa.array(at, pa.float64()), pa.array(reach, pa.float64()), pa.array(ids, pa.int64()), pa.array(np.full(len(at), own))],
                            names=["cell", "slice", "at", "reach", "id", "own"],
                        )

    return run


def _collide_rows(window: float, widest: float):
    """From rows sorted by (cell, slice, at): pairs within a window, in pieces; only a window's rows are held back."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            old = len(held[0]) if held else 0
            cell, part, at, reach, ids, own = (np.concatenate([h, n]) for h, n in zip(held, new, strict=True)) if held else new
            # one number per row, groups far apart, so that one search finds each row's window
            line = at - at.min() + np.cumsum(np.r_[0.0, ((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) * 1e4])
            low = np.searchsorted(line, line - window - widest)
            low = np.where(own, low, np.arange(len(line)))
            for s in range(old, len(line), 4096):
                e = min(s + 4096, len(line))
                n = np.arange(s, e) - low[s:e]
                right = np.repeat(np.arange(s, e), n)
                left = np.arange(len(right)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[s:e], n)
                on = line[right] - line[left] <= window + reach[left] + reach[right]
                a, b = ids[left[on]], ids[right[on]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            keep = line >= line[-1] - window - widest
            held = [c[keep] for c in (cell, part, at, reach, ids, own)]

    return run


def _verify_rows(cosine: float):
    """(a, b, sure): pairs of points that link, wholly (``sure``) or perhaps in some of their members."""

    def run(batches):
        limit = math.acos(cosine)
        for batch in batches:
            for _, part in _by_size(batch):
                x, y = _matrix(part.column("x")), _matrix(part.column("y"))
                r = part.column("rx").to_numpy(zero_copy_only=False) + part.column("ry").to_numpy(zero_copy_only=False)
                angle = _angle(x, y)
                single = r == 0
                sure = np.where(single, (x * y).sum(1) >= cosine, angle + r <= limit - 1e-9)
                some = sure | (~single & (angle - r <= limit + 1e-9))
                on = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(on), part.column("b").filter(on), pa.array(sure).filter(on)], names=["a", "b", "sure"])

    return run


def _block_counts(cosine: float):
    """From two blocks of members: each one's links in the other, by weight."""

    def run(x, y):
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        hit = _matrix(x.column("vector")) @ _matrix(y.column("vector")).T >= cosine
        wx, wy = (t.column("weight").to_numpy() for t in (x, y))
        rows, cols = hit @ wy, wx @ hit
        on, of = rows > 0, cols > 0
        node = np.concatenate([x.column("node").to_numpy()[on], y.column("node").to_numpy()[of]])
        a, b = x.column("a")[0].as_py(), x.column("b")[0].as_py()
        return pa.table({"a": np.full(len(node), a), "b": np.full(len(node), b), "node": node, "n": np.concatenate([rows[on], cols[of]]).astype(np.int64)})

    return run


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.995, count: int = 2, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for each vector.

    Vectors link at a cosine of at least ``cosine`` (above 0) in double precision; those of different lengths never
    do. Null, empty and zero vectors, those with null or non-finite parts, and rows without an id link with nothing (a
    row without an id has no component). Any finite magnitude is scaled. Cosines within rounding of the threshold may
    fall on either side. Rows of one id are one node, with the links of the row that has most. An empty table gives no
    rows; labels and other columns are ignored.
    """
    spark = rows.sparkSession
    d = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    clean = cut(d.mapInArrow(_clean_rows, "id long, mark binary, size int, vector binary"))
    nodes = clean.groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("vector").alias("vector"))
    nodes = cut(nodes.select(F.xxhash64("mark").alias("node"), "mark", "id", "weight", "size", "vector"))
    sizes = {r["size"]: r["n"] for r in nodes.groupBy("size").agg(F.count("*").alias("n")).collect()}  # a row for each length
    sums = nodes.select(F.col("size").cast("long").alias("key"), "size", "vector").mapInArrow(_sum_rows, "key long, n long, total binary")
    totals = sums.groupBy("key").applyInArrow(_added, "key long, n long, centre binary").collect()
    means = {int(r["key"]): np.frombuffer(bytes(r["centre"]), float) / r["n"] for r in totals if r["n"] > 100}  # few say little of where they lie
    n = sum(sizes.values())
    # unit vectors: their mean squared distance from the mean is 1 less its squared length
    spread = min((math.sqrt(max(1e-4, 1 - float(m @ m))) for m in means.values()), default=1.0)
    bits, rounds, window = plan(n, cosine, recall, count, spread)
    limit = math.acos(cosine)
    half = limit / 2 - 1e-9
    slim = nodes.select("node", "size", "vector")
    one, centres = _balls(slim, bits, seed + 101, means, half)
    one = cut(one)
    two, more = _balls(slim.join(one.select("node"), "node", "left_anti"), bits, seed + 211, means, half)
    again = F.xxhash64("ball", F.lit(2)).alias("ball")  # a ball of the second pass is another than its head's of the first
    balls = cut(one.unionByName(two.select("node", again)))
    centres = centres.unionByName(more.select(again, "radius", "vector"))
    placed = nodes.join(balls, "node", "left")
    placed = cut(placed.select("node", "mark", "id", "weight", "size", "vector", F.coalesce("ball", "node").alias("point"), F.col("ball").isNotNull().alias("crowd")))
    crowds = placed.where("crowd").groupBy("point").agg(F.sum("weight").alias("weight"), F.min("id").alias("id"), F.first("size").alias("size"))
    crowds = crowds.join(centres.withColumnRenamed("ball", "point"), "point").mapInArrow(_scaled_rows, "point long, radius double, weight long, id long, size int, vector binary")
    single = placed.where("not crowd").select("point", F.lit(0.0).alias("radius"), "weight", "id", "size", "vector")
    points = cut(crowds.unionByName(single))
    widest = 4 * math.sin(limit / 4)
    lined = points.select("point", "radius", "size", "vector").mapInArrow(_project_rows(bits, rounds, seed, means, window + widest, window), "cell long, slice long, at double, reach double, id long, own boolean")
    met = lined.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "at").mapInArrow(_collide_rows(window, widest), "a long, b long")
    often = met.groupBy("a", "b").agg(F.count("*").alias("c")).where(F.col("c") >= count).select("a", "b")
    x = points.select(F.col("point").alias("a"), "size", F.col("vector").alias("x"), F.col("radius").alias("rx"))
    y = points.select(F.col("point").alias("b"), F.col("size").alias("other"), F.col("vector").alias("y"), F.col("radius").alias("ry"))
    pairs = often.join(x, "a").join(y, "b").where("size = other and a <> b").select("a", "b", "size", "x", "y", "rx", "ry")
    found = cut(pairs.mapInArrow(_verify_rows(cosine), "a long, b long, sure boolean"))
    sure = found.where("sure").select("a", "b")
    # the rest member by member, a block of each point's at a time
    members = placed.select("point", "node", "weight", "vector")
    ask = found.where("not sure").select("a", "b")
    sized = members.groupBy("point").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    ask = ask.join(sized.select(F.col("point").alias("a"), F.col("blocks").alias("na")), "a").join(sized.select(F.col("point").alias("b"), F.col("blocks").alias("nb")), "b")
    ask = cut(ask.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j")))
    key = ["a", "b", "i", "j"]
    names = [*key, "node", "weight", "vector"]
    left = ask.join(members.withColumnRenamed("point", "a"), "a").where(F.pmod(F.xxhash64("node"), F.col("na")) == F.col("i")).select(*names).toDF(*names)
    right = ask.join(members.withColumnRenamed("point", "b"), "b").where(F.pmod(F.xxhash64("node"), F.col("nb")) == F.col("j")).select(*names).toDF(*names)
    blocks = cut(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_block_counts(cosine), "a long, b long, node long, n long"))
    # links of a node: in its own point, in the points that its point links with, and those counted singly
    weights = points.select(F.col("point").alias("b"), "weight")
    whole = sure.union(sure.select("b", "a")).toDF("a", "b").join(weights, "b").groupBy("a").agg(F.sum("weight").alias("others"))
    whole = points.select("point", "weight").join(whole.withColumnRenamed("a", "point"), "point", "left").select("point", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    part = blocks.groupBy("node").agg(F.sum("n").alias("m"))
    linked = placed.select("node", "mark", "point").join(whole, "point").join(part, "node", "left").select("mark", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"))
    ids = points.select("point", "id")
    edges = sure.union(blocks.select("a", "b").distinct())
    named = edges.join(ids.select(F.col("point").alias("a"), F.col("id").alias("u")), "a").join(ids.select(F.col("point").alias("b"), F.col("id").alias("v")), "b").select("u", "v")
    home = placed.select("mark", "point").join(ids.withColumnRenamed("id", "head"), "point")
    copies = clean.select("id", "mark").join(home, "mark").select(F.col("id").alias("u"), F.col("head").alias("v")).where("u <> v")
    component = connected_components(named.union(copies), "u", "v")
    per_id = clean.select("id", "mark").join(linked, "mark").groupBy("id").agg(F.max("n").alias("n"))
    out = d.select("id").join(per_id, "id", "left").join(component.withColumnRenamed("node", "id"), "id", "left")
    c = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), c.alias("component_id"), (F.col("id") == c).alias("kept"))
