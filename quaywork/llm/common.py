"""What the operators of this subpackage share: tables, shared scratch space, byte words, components."""

from __future__ import annotations

import tempfile

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte tables. A-Z to a-z; and, besides, every ASCII byte that is no letter or digit to a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Reads the shared folder from ``spark.checkpoint.dir``; sets one only in local mode, where it is unset."""
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared checkpoint folder, for tables and files that a later step reads."""
    ensure_checkpoints(spark)
    where = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{where}/{name}"


def release() -> None:
    """Gives memory that this process has freed, but holds for later, back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run):
    """``run`` for ``mapInArrow``; a worker lives on after a task, so what the task has freed is given back at its end."""

    def rows(batches):
        yield from run(batches)
        release()

    return rows


def n_buckets(spark: SparkSession) -> int:
    """Buckets for blobs of hashes: some for each shuffle partition, so that they spread evenly."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hashes of byte words; forgets all when it has grown to ``limit`` words."""

    limit = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output order says nothing of the input."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter sequence is one run, none has none."""
    if len(ids) == 0:
        return np.empty(0, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C17)
    w = min(width, len(ids))
    h = np.full(len(ids) - w + 1, w, np.uint64)
    for k in range(w):
        h = h * step + ids[k : len(ids) - w + 1 + k]
    return np.unique(mix(h))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``, component being its smallest node.

    Alternates large-star and small-star steps until the edges are stars, however many rounds that takes; nothing goes
    to the driver but a count and a checksum. Each round's least neighbours and edges are checkpointed, so that both
    sides of the join that meets them are plain shuffles, of which adaptive execution splits the parts that one node
    with very many neighbours fills. Rows with nulls or equal ends are left out.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = cut(e.mapInArrow(_local_stars, "u long, v long").distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before, after = None, mark(e)
    while after[0] and after != before:  # every round that is not the last lowers a node's least neighbour
        both = e.union(e.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        small = small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).where("u > v")
        e = cut(small.mapInArrow(_local_stars, "u long, v long").distinct())
        before, after = after, mark(e)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _local_stars(batches):
    """Edges of a batch, contracted: each node linked to the smallest it reaches within the batch."""
    import pyarrow as pa

    for batch in batches:
        u, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(u):
            continue
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y = ends[: len(u)], ends[len(u) :]
        root = np.arange(len(nodes))
        while True:
            lo = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], lo)
            np.minimum.at(new, root[y], lo)
            np.minimum.at(new, x, lo)
            np.minimum.at(new, y, lo)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])
