"""Indicators over bar series: all symbols at once, windows by symbol in order of the bar's index ``i``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def _full(c: Column, n: int, w, agg) -> Column:
    """``agg`` over the last ``n`` values, null until there are as many."""
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) == n, agg(c).over(f))


#: Bars in a block of a scan, and blocks in a group of blocks.
BLOCK, GROUP = 64, 256


def _compose(f, g):
    """The map that applies ``f``, then ``g``. A map of a stretch has the mean after it: ``a * mean + b``, or ``seed`` where
    no value came before (null: nor in it)."""
    later = F.when(f["seed"].isNull(), g["seed"]).otherwise(g["a"] * f["seed"] + g["b"])
    return F.struct((f["a"] * g["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), later.alias("seed"))


def _after(mean: Column, m) -> Column:
    return F.when(mean.isNull(), m["seed"]).otherwise(m["a"] * mean + m["b"])


def _running(start: Column, stretches: Column, names: list[str]) -> Column:
    """(k, the means before it) of each of some stretches in order, from the means ``start``."""
    before = lambda means, x: F.struct(x["k"].alias("k"), means.alias("before"))
    step = lambda acc, x: F.struct(F.struct(*[_after(acc["means"][n], x[n]).alias(n) for n in names]).alias("means"), F.concat(acc["done"], F.array(before(acc["means"], x))).alias("done"))
    kind = f"array<struct<k: bigint, before: struct<{', '.join(f'{n}: double' for n in names)}>>>"
    return F.aggregate(stretches, F.struct(start.alias("means"), F.array().cast(kind).alias("done")), step, lambda acc: acc["done"])


def affine_means(rows: DataFrame, columns: dict[str, tuple[Column, Column]], by: list[str], order: str) -> DataFrame:
    """``rows`` with a column for each of ``columns`` (name: value, share of a new value): recursive means that begin at the
    first value; a null leaves the mean as it is. ``order`` numbers the rows of a key from 0 on, without gaps.

    A mean after a bar is an affine map of the mean before it, and so is that after a block of bars. Blocks of
    ``BLOCK`` bars are made into maps by running sums, each block a partition of its own; blocks are composed in groups
    of ``GROUP``, groups over the key, and what enters a group, then a block, comes back down. So one key's bars are
    spread over as many tasks as it has blocks, and a step holds at most the blocks of a group or the groups of a key.
    """
    keys, names = list(by), list(columns)
    block = F.floor(F.col(order) / BLOCK).cast("long")
    w = Window.partitionBy(*keys, "_k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_k", block).withColumns({f"_x_{n}": x.cast("double") for n, (x, _) in columns.items()} | {f"_s_{n}": share.cast("double") for n, (_, share) in columns.items()})
    d = d.withColumns({f"_p_{n}": F.count(f"_x_{n}").over(w) for n in names})
    made = {}
    for n in names:
        x, share, p = F.col(f"_x_{n}"), F.col(f"_s_{n}"), F.col(f"_p_{n}")
        keep = F.when(share < 1, 1 - share)  # nothing of the mean is kept by a share of 1
        b = F.pow(keep, p) * F.sum(share * F.pow(keep, -p) * x).over(w)
        first, last = F.first(f"_x_{n}", ignorenulls=True).over(w), F.last(f"_x_{n}", ignorenulls=True).over(w)
        seed = b + F.pow(keep, p - 1) * keep * first
        some = lambda y: F.when(p > 0, y)
        made[n] = F.struct(F.coalesce(some(F.coalesce(F.pow(keep, p), F.lit(0.0))), F.lit(1.0)).alias("a"), F.coalesce(some(F.coalesce(b, last)), F.lit(0.0)).alias("b"), some(F.coalesce(seed, last)).alias("seed"))
    d = d.withColumns({f"_m_{n}": m for n, m in made.items()}).drop(*[f"_{c}_{n}" for c in "xsp" for n in names])
    maps = d.groupBy(*keys, "_k").agg(F.max_by(F.struct(*[F.col(f"_m_{n}").alias(n) for n in names]), order).alias("_m"))
    maps = maps.withColumn("_g", F.floor(F.col("_k") / GROUP).cast("long"))
    groups = maps.groupBy(*keys, "_g").agg(F.array_sort(F.collect_list(F.struct(F.col("_k").alias("k"), *[F.col(f"_m.{n}").alias(n) for n in names]))).alias("_all"))
    unit = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("seed"))
    whole = F.aggregate("_all", F.struct(*[unit.alias(n) for n in names]), lambda acc, x: F.struct(*[_compose(acc[n], x[n]).alias(n) for n in names]))
    of_key = groups.withColumn("_m", whole).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_g").alias("k"), *[F.col(f"_m.{n}").alias(n) for n in names]))).alias("_all"))
    nothing = F.struct(*[F.lit(None).cast("double").alias(n) for n in names])
    entering = of_key.select(*keys, F.explode(_running(nothing, F.col("_all"), names)).alias("_e")).select(*keys, F.col("_e.k").alias("_g"), F.col("_e.before").alias("_start"))
    into = groups.join(entering, [*keys, "_g"]).select(*keys, F.explode(_running(F.col("_start"), F.col("_all"), names)).alias("_e"))
    into = into.select(*keys, F.col("_e.k").alias("_k"), F.col("_e.before").alias("_before"))
    out = d.join(into, [*keys, "_k"])
    return out.select(*rows.columns, *[_after(F.col("_before")[n], F.col(f"_m_{n}")).alias(n) for n in names])


def ema(bars: DataFrame, column: str, spans: list[int], by: list[str] = ("symbol",), order: str = "i") -> DataFrame:
    """``bars`` with ``ema_<span>`` columns: exponential means that begin at the first value, share 2 / (span + 1) each."""
    return affine_means(bars, {f"ema_{s}": (F.col(column), F.lit(2.0 / (s + 1))) for s in spans}, list(by), order)


def stochastic_k(bars: DataFrame, period: int = 14, by=("symbol",)) -> DataFrame:
    w = _w(list(by), "i")
    lo, hi = _full(F.col("low"), period, w, F.min), _full(F.col("high"), period, w, F.max)
    return bars.withColumn("stoch_k", (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100)


def rsi(bars: DataFrame, period: int = 14, by=("symbol",)) -> DataFrame:
    """Simple-mean RSI; null until ``period`` changes are there, and where none was a loss."""
    w = _w(list(by), "i")
    d = bars.withColumn("_d", F.col("close") - F.lag("close").over(w))
    up, down = _full(F.greatest("_d", F.lit(0.0)) + F.col("_d") * 0, period, w, F.avg), _full(F.greatest(-F.col("_d"), F.lit(0.0)) + F.col("_d") * 0, period, w, F.avg)
    return d.withColumns({"_u": up, "_l": down}).withColumn("rsi", 100 - 100 / (1 + F.col("_u") / F.nullif("_l", F.lit(0.0)))).drop("_d", "_u", "_l")


def force_index(bars: DataFrame, span: int = 2, by=("symbol",)) -> DataFrame:
    w = _w(list(by), "i")
    f = bars.withColumn("force", (F.col("close") - F.lag("close").over(w)) * F.col("volume"))
    return ema(f, "force", [span], by).withColumnRenamed(f"ema_{span}", "force_index").drop("force")


def macd_hist(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, by=("symbol",)) -> DataFrame:
    e = ema(bars, "close", [fast, slow], by).withColumn("macd", F.col(f"ema_{fast}") - F.col(f"ema_{slow}")).drop(f"ema_{fast}", f"ema_{slow}")
    return ema(e, "macd", [signal], by).withColumn("macd_hist", F.col("macd") - F.col(f"ema_{signal}")).drop(f"ema_{signal}")


def log_return(bars: DataFrame, by=("symbol",)) -> DataFrame:
    return bars.withColumn("log_ret", F.ln(F.col("close") / F.lag("close").over(_w(list(by), "i"))))


def forward_return(bars: DataFrame, horizon: int = 1, log: bool = False, by=("symbol",)) -> DataFrame:
    r = F.lead("close", horizon).over(_w(list(by), "i")) / F.col("close")
    return bars.withColumn("fwd_ret", F.ln(r) if log else r - 1)


def ewma_vol(bars: DataFrame, lam: float = 0.94, lookback: int = 48, per_year: float = 8760.0, by=("symbol",)) -> DataFrame:
    """Annual deviation from squared log returns over the last ``lookback`` bars, weights falling by ``lam``, renormalised;
    null before bar ``lookback`` and with fewer than half as many returns."""
    r = log_return(bars, by)
    w = _w(list(by), "i").rowsBetween(-(lookback - 1), 0)
    sq = F.reverse(F.collect_list(F.pow("log_ret", F.lit(2))).over(w))
    sums = F.aggregate(sq, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"), F.lit(1.0).alias("k")), lambda a, x: F.struct((a["s"] + a["k"] * x).alias("s"), (a["w"] + a["k"]).alias("w"), (a["k"] * lam).alias("k")))
    return r.withColumn("_q", sums).withColumn("_c", F.count("log_ret").over(w)).withColumn("sigma", F.when((F.col("i") >= lookback) & (F.col("_c") >= lookback // 2), F.sqrt(F.col("_q.s") / F.col("_q.w") * per_year))).drop("_q", "_c")


def resample_last(ticks: DataFrame, step: int, by: list[str], time: str, value: str, tie: str) -> DataFrame:
    """The last value in each ``step`` of each series, with null rows for empty steps between its first and last."""
    b = (F.floor(F.col(time) / step) * step).cast("long")
    got = ticks.groupBy(*by, b.alias("step_t")).agg(F.max_by(value, F.struct(time, tie)).alias("last"))
    span = got.groupBy(*by).agg(F.min("step_t").alias("a"), F.max("step_t").alias("z"))
    spine = span.select(*by, F.explode(F.sequence("a", "z", F.lit(step).cast("long"))).alias("step_t"))
    return spine.join(got, [*by, "step_t"], "left")


#: Rows of a numbered series that are scanned together.
SCAN = 4_096


def running(df: DataFrame, values: dict[str, tuple[str, str | Column]], by: list[str], order: list[str], block: Column) -> DataFrame:
    """``df`` with a column for each of ``values`` (name: ``sum``, ``min`` or ``max``, and a column) over a key's rows up to and
    with each, in ``order``.

    ``block`` never falls in that order. A block's total is what the rows after it see of it, so a key is a window over its
    blocks, and its rows are windows within blocks: no task holds more rows than a block has or than a key has blocks.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    both = {"sum": lambda x, y: F.coalesce(x + y, x, y), "min": F.least, "max": F.greatest}
    col = lambda c: F.col(c) if isinstance(c, str) else c
    d = df.withColumn("_blk", block)
    totals = d.groupBy(*by, "_blk").agg(*[agg[f](col(c)).alias(f"_all_{n}") for n, (f, c) in values.items()])
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_blk", *[agg[f](f"_all_{n}").over(before).alias(f"_pre_{n}") for n, (f, _) in values.items()])
    within = Window.partitionBy(*by, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_own_{n}": agg[f](col(c)).over(within) for n, (f, c) in values.items()})
    on = [d[k].eqNullSafe(totals[k]) for k in (*by, "_blk")]
    both_sides = d.join(totals, on)
    return both_sides.select(*[d[c] for c in df.columns], *[both[f](both_sides[f"_pre_{n}"], both_sides[f"_own_{n}"]).alias(n) for n, (f, _) in values.items()])


def drawdown_series(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """Bars with the highest close so far and the fall from it, scanned by blocks of bars."""
    d = running(bars, {"peak": ("max", "close")}, list(by), ["i"], F.floor(F.col("i") / SCAN))
    return d.withColumn("drawdown", (F.col("peak") - F.col("close")) / F.col("peak"))


def max_drawdown(bars: DataFrame, by=("symbol",)) -> DataFrame:
    """By key: the worst fall from the highest close so far.

    A block of bars is its highest close, its lowest and its own worst fall. Of a block the worst fall is that or the one
    from the highest close of the blocks before to its lowest, as a fall grows with the height that it begins from.
    """
    keys = list(by)
    blocks = drawdown_blocks(bars, keys)
    before = F.max("_high").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("_peak", before).groupBy(*keys).agg(F.max(F.greatest("_worst", (F.col("_peak") - F.col("_low")) / F.col("_peak"))).alias("max_dd"))


def drawdown_blocks(bars: DataFrame, keys: list[str]) -> DataFrame:
    within = Window.partitionBy(*keys, "_blk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumn("_blk", F.floor(F.col("i") / SCAN)).withColumn("_top", F.max("close").over(within))
    return d.groupBy(*keys, "_blk").agg(F.max("close").alias("_high"), F.min("close").alias("_low"), F.max((F.col("_top") - F.col("close")) / F.col("_top")).alias("_worst"))


def cum_min(df: DataFrame, column: str, by: list[str], order: str, block: Column | None = None) -> DataFrame:
    """The least value so far; ``block`` as in ``running``, by default of an order that numbers rows."""
    return running(df, {"cum_min": ("min", column)}, by, [order], F.floor(F.col(order) / SCAN) if block is None else block)


def equal_slices(df: DataFrame, k: int, by: list[str], order: str) -> DataFrame:
    """``df`` with ``slice``: k runs of n div k rows by rank, the last with the remainder."""
    w = Window.partitionBy(*by)
    n = F.floor(F.count("*").over(w) / k)
    r = F.row_number().over(w.orderBy(order)) - 1
    return df.withColumn("slice", F.when(n == 0, k - 1).otherwise(F.least(F.floor(r / F.nullif(n, F.lit(0))), F.lit(k - 1))).cast("int"))


def local_extrema(bars: DataFrame, half: int = 2, by=("symbol",)) -> DataFrame:
    """``is_low`` and ``is_high``: whether a bar is the least or greatest within ``half`` bars of it on either side."""
    f = _w(list(by), "i").rowsBetween(-half, half)
    inside = F.count("*").over(f) == 2 * half + 1
    return bars.withColumns({"is_low": inside & (F.col("low") == F.min("low").over(f)), "is_high": inside & (F.col("high") == F.max("high").over(f))})


def runs(bars: DataFrame, label: str, by=("symbol",)) -> DataFrame:
    """``bars`` with ``run``, the number of its stretch of one label, and the stretch's start, low and high so far."""
    w = _w(list(by), "i")
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)), 0).otherwise(1)
    r = bars.withColumn("_n", change).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_n")
    v = Window.partitionBy(*by, "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return r.withColumns({"run_start": F.min("i").over(v), "run_low": F.min("low").over(v), "run_high": F.max("high").over(v)})


def previous_event(df: DataFrame, flag: str, columns: list[str], by=("symbol",)) -> DataFrame:
    """``prev_<column>``: the values at the last earlier row where ``flag`` holds."""
    w = _w(list(by), "i").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({f"prev_{c}": F.last(F.when(F.col(flag), F.col(c)), ignorenulls=True).over(w) for c in columns})


def first_confirm(bars: DataFrame, k: int, test, column: str = "close", by=("symbol",)) -> DataFrame:
    """``confirm``: how many bars (1 to k) until ``test(later value of column)`` first holds, null if it does not."""
    w = _w(list(by), "i")
    hit = F.coalesce(*[F.when(test(F.lead(column, j).over(w)), F.lit(j)) for j in range(1, k + 1)])
    return bars.withColumn("confirm", hit)


def rolling_range(bars: DataFrame, n: int, by=("symbol",)) -> DataFrame:
    """Support and resistance of the ``n`` bars before each, and the mean volume of the last ``n``; null until full."""
    w = _w(list(by), "i")
    f = w.rowsBetween(-n, -1)
    full = F.count("*").over(f) == n
    return bars.withColumns({"support": F.when(full, F.min("low").over(f)), "resistance": F.when(full, F.max("high").over(f)), "mean_volume": _full(F.col("volume"), n, w, F.avg)})


def rolling_by(rows: DataFrame, length: str, values: dict[str, tuple[str, str]], by: list[str] = ("symbol",), order: str = "i", partial: bool = False) -> DataFrame:
    """``rows`` with a column for each of ``values`` (name: ``min``, ``max`` or ``sum``, and a column) over as many rows before a row
    as its column ``length`` says; null until there are as many, or with ``partial`` over those there are. ``order`` numbers
    the rows of a key from 0 on without gaps.

    A window's frame is the same for all rows, so a length that is a column takes two halves: rows are cut in blocks of
    their length, and the rows before a row are the rest of one block, from the row ``length`` back, and the beginning of
    the next. All lengths share these windows, and their partitions are single blocks, not whole keys.
    """
    keys = [*by, length]
    block, phase = F.floor(F.col(order) / F.col(length)), F.col(order) % F.col(length)
    w = Window.partitionBy(*keys, block)
    agg = {"min": F.min, "max": F.max, "sum": F.sum}
    out = rows.withColumns({f"_head_{n}": agg[f](c).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)) for n, (f, c) in values.items()})
    out = out.withColumns({f"_tail_{n}": agg[f](c).over(w.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)) for n, (f, c) in values.items()})
    back = Window.partitionBy(*keys, phase).orderBy(order)
    join = {"min": F.least, "max": F.greatest, "sum": lambda a, b: a + F.coalesce(b, F.lit(0))}
    out = out.withColumns({f"_far_{n}": F.lag(f"_tail_{n}").over(back) for n in values} | {"_ok": F.lag(order).over(back)})
    found = {n: F.when(F.col("_ok").isNotNull(), join[f](F.col(f"_far_{n}"), F.col(f"_head_{n}"))).otherwise(F.col(f"_head_{n}") if partial else None) for n, (f, _) in values.items()}
    return out.withColumns(found).drop("_ok", *[f"_{k}_{n}" for k in ("head", "tail", "far") for n in values])


def coin_profile(bars: DataFrame, min_bars: int = 30, per_year: float = 365.0) -> DataFrame:
    """By symbol: bars, annual deviation, mean absolute return, worst drawdown, and lag-one autocorrelation."""
    w = _w(["symbol"], "i")
    d = drawdown_series(bars).withColumn("r", F.col("close") / F.lag("close").over(w) - 1)
    d = d.withColumn("r1", F.lag("r").over(w))
    g = d.groupBy("symbol").agg(
        F.count("*").alias("bars"), (F.stddev_samp("r") * F.sqrt(F.lit(per_year))).alias("vol"), F.avg(F.abs("r")).alias("mean_abs"), F.max("drawdown").alias("max_dd"),
        (F.covar_pop("r", "r1") / F.nullif(F.stddev_pop(F.when(F.col("r1").isNotNull(), F.col("r"))) * F.stddev_pop(F.when(F.col("r").isNotNull(), F.col("r1"))), F.lit(0.0))).alias("autocorr"),
    )
    return g.where(F.col("bars") >= min_bars)


def cohort_summary(profiles: DataFrame, k: int = 5) -> DataFrame:
    """Cohorts of equal size by volatility: n, and their lowest, (upper) median and highest deviation."""
    c = equal_slices(profiles.withColumn("_one", F.lit(0)), k, ["_one"], "vol")  # a row for each symbol
    s = F.sort_array(F.collect_list("vol"))
    return c.groupBy(F.col("slice").alias("cohort")).agg(F.count("*").alias("n"), F.min("vol").alias("vol_lo"), F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")).alias("vol_med"), F.max("vol").alias("vol_hi"))
