"""Contiguous shards of equal bytes from global prefix sums.

Rows are ordered by key. Approximate quantiles of the key cut the order into ranges; the bytes and rows of each
range are summed where the rows lie, and the running sums over these few totals give each range its offset. Within
a range a window adds up the rest. A row's shard is where the middle of its bytes falls among equal targets, so
shards differ by no more than one row's size.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _between(c: Column, bounds: list[int], base: int = 0) -> Column:
    """How many of the sorted ``bounds`` are at most ``c``, by halving."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(c < bounds[mid], _between(c, bounds[:mid], base)).otherwise(_between(c, bounds[mid + 1 :], base + mid + 1))


def assign_shards(rows: DataFrame, key: str, size: str, n_shards: int, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in each shard).

    ``key`` is a whole-number column (null sorts first), ``size`` a count of bytes (null: 0). Where a key takes up
    several quantiles, as one repeated in many rows does, its rows are dealt to as many ranges by a hash of the row,
    so that no range is much larger than another. Rows alike in all columns may change places. An empty table gives no rows.
    """
    spark = rows.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    cuts = rows.agg(F.percentile_approx(k, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    distinct = sorted(set(cuts))
    hot = {b: cuts.count(b) for b in distinct if cuts.count(b) > 1}
    tie = F.xxhash64(*rows.columns)
    # a range's number; a hot key's own ranges come before the other keys of the range that it begins
    part = _between(k, distinct).cast("long") * (ranges + 1)
    if hot:
        deal = F.create_map(*[F.lit(x) for b, n in hot.items() for x in (b, n)])
        n = F.try_element_at(deal, k)
        part = part + F.when(n.isNull(), F.lit(ranges)).otherwise(F.pmod(tie, n))
    d = rows.withColumns({"_part": part, "_tie": tie, "_size": F.coalesce(F.col(size).cast("long"), F.lit(0))})
    totals = sorted((r["_part"], r["b"], r["c"]) for r in d.groupBy("_part").agg(F.sum("_size").alias("b"), F.count("*").alias("c")).collect())  # a row for each range
    total = sum(b for _, b, _ in totals)
    rows_before = dict(zip([p for p, _, _ in totals], accumulate([0, *[c for _, _, c in totals][:-1]]), strict=True)) if totals else {}
    before = dict(zip([p for p, _, _ in totals], accumulate([0, *[b for _, b, _ in totals][:-1]]), strict=True)) if totals else {}
    offsets = spark.createDataFrame([(p, before[p], rows_before[p]) for p in before], "_part long, _before long, _rows long")
    w = Window.partitionBy("_part").orderBy(k, "_tie")
    d = d.withColumns({"_end": F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(w).cast("long") - 1})
    d = d.join(F.broadcast(offsets), "_part")
    middle = 2 * (F.col("_before") + F.col("_end")) - F.col("_size")
    shard = F.least(F.expr(f"{n_shards - 1}L"), F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(max(1, 2 * total)).cast("decimal(20,0)"))).cast("int")
    d = d.withColumns({"shard": shard, "_at": F.col("_rows") + F.col("_n")})
    first = d.groupBy("shard", "_part").agg(F.min("_at").alias("_first")).groupBy("shard").agg(F.min("_first").alias("_first"))  # a row for each shard
    firsts = {r["shard"]: r["_first"] for r in first.collect()}
    if not firsts:
        return d.withColumn("slot", F.lit(0).cast("long")).select(*rows.columns, "shard", "slot")
    starts = F.create_map(*[F.lit(x) for kv in firsts.items() for x in kv])
    return d.withColumn("slot", F.col("_at") - F.element_at(starts, F.col("shard"))).select(*rows.columns, "shard", "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes rows that have shards, a folder for each, in slot order within its files."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(path)


def digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The contract's columns. The texts stay where they lie: sizes and checksums are taken before the shuffle."""
    text = F.col("text").cast("binary")
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).cast("long").alias("text_crc32"))
    return assign_shards(narrow, "doc_id", "size", n_shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
