"""As-of joins and their relatives: union, one window, no range join.

Left and right rows are tagged and united; one window over the key carries the last right row forward. A key with a
large share of all rows is split into time slices first: each slice's last right row is carried into later slices by
a window over slices alone, so no task sees a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, how: str = "inner", tie: str | None = None, forward: bool = False, slice_us: int | None = None) -> DataFrame:
    """Each left row with the last right row of its key at or before its time (``forward``: the first one after it).

    Right columns come back as ``right_time`` and the right table's others; names must not clash. Right rows with one
    time are ordered by ``tie``, a column of any type that sorts. ``how`` is ``inner`` or ``left``. Rows with a null key or time match nothing. With
    ``slice_us`` keys are split into slices of that many microseconds.
    """
    cols = [c for c in right.columns if c not in on]
    sign = -1 if forward else 1
    lt = left.select(*on, (F.col(left_time) * sign).alias("_t"), F.lit(0 if forward else 1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    rt = right.select(*on, (F.col(right_time) * sign).alias("_t"), F.lit(1 if forward else 0).alias("_side"), (F.col(tie) if tie else F.lit(None).cast("long")).alias("_tie"), F.struct(*[F.col(c) for c in cols]).alias("_r"))
    rt = rt.where(F.col("_t").isNotNull())
    both = lt.unionByName(rt, allowMissingColumns=True)
    if slice_us:
        both = both.withColumn("_slice", F.floor(F.col("_t") / slice_us))
        last = rt.withColumn("_slice", F.floor(F.col("_t") / slice_us)).groupBy(*on, "_slice").agg(_latest("_r", forward).alias("_carry"))
        seen = both.select(*on, "_slice").distinct().join(last, [*on, "_slice"], "left")
        before = Window.partitionBy(*on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = seen.select(*on, "_slice", F.last("_carry", ignorenulls=True).over(before).alias("_carry"))
        both = both.join(carried, [*on, "_slice"], "left")
        keys = [*on, "_slice"]
    else:
        keys = list(on)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.desc("_tie") if forward else F.asc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_r", ignorenulls=True).over(w)
    out = both.withColumn("_m", F.coalesce(found, F.col("_carry")) if slice_us else found).where("_l is not null")
    out = out.withColumn("_m", F.when(F.col("_t").isNotNull(), F.col("_m")))
    if how == "inner":
        out = out.where("_m is not null")
    return out.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in cols])


def _latest(value: str, forward: bool) -> Column:
    """The value of the last row by time and then by tie (``forward``: the one with the least tie, whatever its type)."""
    if not forward:
        return F.max_by(value, F.struct("_t", "_tie"))
    return F.min_by(value, F.struct(-F.col("_t"), "_tie"))


def asof_join_global(left: DataFrame, right: DataFrame, left_time: str, right_time: str, bucket: int = 86_400_000_000, how: str = "left", tie: str | None = None) -> DataFrame:
    """An as-of join without a key: time buckets are the key, and each bucket gets the last right row before it.

    The carried rows are one per bucket that has rows; the window over them is as small as the number of buckets.
    """
    one = F.lit(0).alias("_one")
    out = asof_join(left.select("*", one), right.select("*", one), ["_one"], left_time, right_time, how, tie, slice_us=bucket)
    return out.drop("_one")


def asof_with_fallback(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, fallback: str = "none", tie: str | None = None) -> DataFrame:
    """Backward; with ``fallback='forward'``, rows without a match take the first right row after their time."""
    if fallback == "none":
        return asof_join(left, right, on, left_time, right_time, "inner", tie)
    cols = [c for c in right.columns if c not in on]
    back = asof_join(left, right, on, left_time, right_time, "left", tie)
    after = asof_join(back.where(F.col(right_time).isNull()).drop(*cols), right, on, left_time, right_time, "inner", tie, forward=True)
    return back.where(F.col(right_time).isNotNull()).unionByName(after)


def align_timeframes(short: DataFrame, long: DataFrame, on: list[str], time: str, value: str, point_in_time: bool = False) -> DataFrame:
    """``short`` with the value of the long bar whose open is at or before each bar's; 0 where there is none.

    ``point_in_time`` uses the bar before it, the last one that has closed by then.
    """
    w = Window.partitionBy(*on).orderBy(time)
    v = F.lag(value).over(w) if point_in_time else F.col(value)
    slow = long.select(*on, F.col(time).alias("_long_t"), v.alias(f"long_{value}"))
    out = asof_join(short, slow, on, time, "_long_t", "left")
    return out.drop("_long_t").withColumn(f"long_{value}", F.coalesce(f"long_{value}", F.lit(0.0)))


def snapshot_grid(rows: DataFrame, start: str, stop: str, step: int) -> DataFrame:
    """``rows`` with a ``t`` for each multiple of ``step`` from ``start`` to ``stop``, both included if they are one."""
    first = (F.ceil(F.col(start) / step) * step).cast("long")
    last = (F.floor(F.col(stop) / step) * step).cast("long")
    ok = rows.where(first <= last)
    return ok.withColumn("t", F.explode(F.sequence(first, last, F.lit(step).cast("long"))))


def interval_sum_join(intervals: DataFrame, ticks: DataFrame, on: list[str], start: str, stop: str, time: str, value: str, out: str = "total") -> DataFrame:
    """Each interval with the sum of the ticks of its key from ``start`` up to before ``stop``: the difference of two
    running sums, so an interval's length costs nothing. 0 where there are none."""
    w = Window.partitionBy(*on).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    sums = ticks.groupBy(*on, F.col(time).alias("_t")).agg(F.sum(value).alias("_v")).select(*on, "_t", F.sum("_v").over(w).alias("_s"))
    a = asof_join(intervals.withColumn("_at", F.col(start) - 1), sums.withColumnsRenamed({"_t": "_t0", "_s": "_s0"}), on, "_at", "_t0", "left")
    b = asof_join(a.withColumn("_at", F.col(stop) - 1), sums.withColumnsRenamed({"_t": "_t1", "_s": "_s1"}), on, "_at", "_t1", "left")
    zero = F.lit(0)
    return b.withColumn(out, F.when(F.col(start) < F.col(stop), F.coalesce("_s1", zero) - F.coalesce("_s0", zero)).otherwise(zero)).drop("_at", "_t0", "_s0", "_t1", "_s1")


def closing_lines(positions: DataFrame, trades: DataFrame, quotes: DataFrame | None, mid: Column | None = None, tie: str | None = None) -> DataFrame:
    """Each position with the last quote's mid at or before its close, else the last trade's price; ``line_source``
    says which; positions with neither are dropped. Quotes of one time are ordered by ``tie``."""
    t = trades.select("ticker", F.col("t").alias("trade_t"), F.col("yes_price").alias("trade_price"), F.col("trade_id"))
    out = asof_join(positions, t, ["ticker"], "closes", "trade_t", "left", "trade_id")
    if quotes is not None:
        q = quotes.select("ticker", F.col("t").alias("quote_t"), mid.alias("quote_mid"), *([F.col(tie).alias("_quote_tie")] if tie else []))
        out = asof_join(out, q, ["ticker"], "closes", "quote_t", "left", "_quote_tie" if tie else None).drop("_quote_tie")
    else:
        out = out.withColumn("quote_mid", F.lit(None).cast("double"))
    line = F.coalesce("quote_mid", "trade_price")
    return out.withColumns({"line": line, "line_source": F.when(F.col("quote_mid").isNotNull(), "quote").when(line.isNotNull(), "trade")}).where("line is not null")


def snapshot_closing_lines(positions: DataFrame, quotes: DataFrame, mid: Column, tie: str | None = None) -> DataFrame:
    """Each position with ``line``, the mid of the last quote at or before its close; one look-up: where that quote has no
    mid the position is dropped, whatever earlier ones say."""
    q = quotes.withColumn("_mid", mid).select("ticker", F.col("t").alias("quote_t"), F.col("_mid").alias("line"), *([tie] if tie else []))
    out = asof_join(positions, q, ["ticker"], "closes", "quote_t", "inner", tie)
    return out.where("line is not null").drop(*([tie] if tie else []))


def shifted_self_join(df: DataFrame, key: list[str], time: str, value: str, horizon: int) -> DataFrame:
    """``df`` with ``later``: the value of the same key exactly ``horizon`` later, null where there is no such row."""
    later = df.select(*key, (F.col(time) - horizon).alias(time), F.col(value).alias("later"))
    return df.join(later, [*key, time], "left")


def restrict_to(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on), on, "left_semi")


def exclude_known(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(known.select(*on), on, "left_anti")


def null_shuffle(df: DataFrame, order: list[str], by: Column, values: list[str]) -> DataFrame:
    """``df`` with ``values`` dealt anew: the row ranked r by ``order`` gets those of the row ranked r by ``by``.

    Ranks are global without a global sort in one task: rows are ranged by sampling, and each range's rank begins
    after the rows of the ranges before it.
    """
    a = global_rank(df.drop(*values), [F.col(c) for c in order])
    b = global_rank(df.select(*order, *values), [by, *[F.col(c) for c in order]]).select("rank", *values)
    return a.join(b, "rank").drop("rank")


def global_rank(df: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0) in the given order, of any types that sort; nulls first.

    Rows are dealt to ranges of the whole order by Spark's sampled range partitioning, so a value of the first column
    that very many rows have is split by the columns after it. Each range's rank begins after the rows of those before.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = {f"_k{n}": c for n, c in enumerate(order)}
    d = df.withColumns(keys).repartitionByRange(buckets, *keys).sortWithinPartitions(*keys)
    # numbers by partition: the place within one is in the low 33 bits
    d = d.withColumn("_n", F.monotonically_increasing_id()).withColumns({"_p": F.shiftright("_n", 33), "_r": F.col("_n").bitwiseAND((1 << 33) - 1)})
    d = kept(d)  # ranges sampled once hold for both uses
    sizes = d.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(offsets), "_p").withColumn("rank", F.col("_before") + F.col("_r")).drop("_p", "_n", "_r", "_before", *keys)
