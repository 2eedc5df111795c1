"""Signals over bars, trade labelling, scoring and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import bars as B

#: Children of a node of the tree of bars, and its levels: 64 bars, 64 * 64 bars, ...
FAN, LEVELS = 64, 4


def _signals(df: DataFrame, direction, entry, stop, target, when, at=None, min_rr: float = 2.0) -> DataFrame:
    out = df.where(when).select("symbol", (F.col("i") if at is None else at).alias("i"), direction.alias("direction"), entry.alias("entry"), stop.alias("stop"), target.alias("target"))
    return out.where(S.signal_ok("direction", "entry", "stop", "target", min_rr))


def false_breakout(bars: DataFrame, lookback: int = 30, min_width: float = 0.05, confirm: int = 3, min_rr: float = 2.0) -> DataFrame:
    """Closes outside the range of the bars before, back inside within ``confirm`` bars: entry at that close, stop at
    the low (high) since, target at the range's other side."""
    w = Window.partitionBy("symbol").orderBy("i")
    r = B.rolling_range(bars, lookback)
    last = F.max("i").over(Window.partitionBy("symbol"))
    wide = (F.col("resistance") - F.col("support")) / ((F.col("resistance") + F.col("support")) / 2) >= min_width
    r = r.withColumns({"_ok": wide & (F.col("i") <= last - confirm), "_down": F.col("close") < F.col("support"), "_up": F.col("close") > F.col("resistance")})
    back = lambda test: F.coalesce(*[F.when(test(F.lead("close", j).over(w)), F.lit(j)) for j in range(1, confirm + 1)])
    r = r.withColumn("_j", F.when(F.col("_down"), back(lambda c: c > F.col("support"))).when(F.col("_up"), back(lambda c: c < F.col("resistance"))))
    at = lambda c, j: F.lead(c, j).over(w)
    since = lambda agg, c: F.coalesce(*[F.when(F.col("_j") == j, agg(F.col(c), *[at(c, m) for m in range(1, j + 1)])) for j in range(1, confirm + 1)])
    r = r.withColumns({"_entry": F.coalesce(*[F.when(F.col("_j") == j, at("close", j)) for j in range(1, confirm + 1)]), "_low": since(F.least, "low"), "_high": since(F.greatest, "high")})
    long = F.col("_down")
    return _signals(r, F.when(long, "long").otherwise("short"), F.col("_entry"), F.when(long, F.col("_low")).otherwise(F.col("_high")), F.when(long, F.col("resistance")).otherwise(F.col("support")), F.col("_ok") & F.col("_j").isNotNull(), F.col("i") + F.col("_j"), min_rr)


def kangaroo_tail(bars: DataFrame, context: int = 10, multiple: float = 2.0, target: float = 1.0, lag: int = 1, min_rr: float = 2.0) -> DataFrame:
    """Bars much taller than those before and than their neighbours, with the body in one half: enter ``lag`` bars on,
    stop at the bar's middle, target a multiple of its height away."""
    w = Window.partitionBy("symbol").orderBy("i")
    h = F.col("high") - F.col("low")
    b = bars.withColumn("_h", h)
    last = F.max("i").over(Window.partitionBy("symbol"))
    mean = F.avg("_h").over(w.rowsBetween(-context, -1))
    b = b.withColumns({"_m": mean, "_p": F.lag("_h").over(w), "_n": F.lead("_h").over(w), "_e": F.lead("close", lag).over(w), "_mid": (F.col("high") + F.col("low")) / 2, "_last": last})
    tall = (F.col("_h") >= multiple * F.col("_m")) & (F.col("_p") < multiple * F.col("_m")) & (F.col("_n") < multiple * F.col("_m"))
    inside = (F.col("i") >= context + 1) & (F.col("i") <= F.col("_last") - lag - 1)
    up = F.least("open", "close") >= F.col("_mid")
    down = F.greatest("open", "close") <= F.col("_mid")
    return _signals(b, F.when(up, "long").otherwise("short"), F.col("_e"), F.col("_mid"), F.when(up, F.col("_e") + target * F.col("_h")).otherwise(F.col("_e") - target * F.col("_h")), tall & inside & (up | down), F.col("i") + lag, min_rr)


def impulse_system(bars: DataFrame, span: int = 13, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Leaving a red (green) run: long (short) at the close, stop at the run's low (high), target twice the risk.

    A bar is green if its mean and histogram both rise, red if both fall."""
    w = Window.partitionBy("symbol").orderBy("i")
    m = B.ema(B.macd_hist(bars, fast, slow, signal), "close", [span])
    de, dh = F.col(f"ema_{span}") - F.lag(f"ema_{span}").over(w), F.col("macd_hist") - F.lag("macd_hist").over(w)
    m = m.withColumn("colour", F.when((de > 0) & (dh > 0), "green").when((de < 0) & (dh < 0), "red").otherwise("blue")).where(F.col("i") >= slow + signal + span)
    r = B.runs(m, "colour")
    r = r.withColumns({"_c": F.lag("colour").over(w), "_lo": F.lag("run_low").over(w), "_hi": F.lag("run_high").over(w)})
    long, short = (F.col("_c") == "red") & (F.col("colour") != "red"), (F.col("_c") == "green") & (F.col("colour") != "green")
    e = F.col("close")
    return _signals(r, F.when(long, "long").otherwise("short"), e, F.when(long, F.col("_lo")).otherwise(F.col("_hi")), F.when(long, e + 2 * (e - F.col("_lo"))).otherwise(e - 2 * (F.col("_hi") - e)), long | short)


def channel_fade(bars: DataFrame, span: int = 22, width: float = 0.05, gap: int = 5) -> DataFrame:
    """Touches of a channel round the mean, shallower than the touch before and at least ``gap`` bars after it, that
    close nearer: trade back to the mean, stop half the penetration beyond."""
    m = B.ema(bars, "close", [span]).withColumn("mean", F.col(f"ema_{span}"))
    m = m.withColumns({"_lo": F.col("low") < F.col("mean") * (1 - width), "_hi": F.col("high") > F.col("mean") * (1 + width)})
    m = B.previous_event(m, "_lo", ["i", "low", "close"]).withColumnsRenamed({"prev_i": "li", "prev_low": "ll", "prev_close": "lc"})
    m = B.previous_event(m, "_hi", ["i", "high", "close"]).withColumnsRenamed({"prev_i": "hi_i", "prev_high": "hh", "prev_close": "hc"})
    long = F.col("_lo") & (F.col("i") - F.col("li") >= gap) & (F.col("low") > F.col("ll")) & (F.col("close") > F.col("lc"))
    short = F.col("_hi") & (F.col("i") - F.col("hi_i") >= gap) & (F.col("high") < F.col("hh")) & (F.col("close") < F.col("hc"))
    lower, upper = F.col("mean") * (1 - width), F.col("mean") * (1 + width)
    stop = F.when(long, F.col("low") - (lower - F.col("low")) / 2).otherwise(F.col("high") + (F.col("high") - upper) / 2)
    return _signals(m, F.when(long, "long").otherwise("short"), F.col("close"), stop, F.col("mean"), F.coalesce(long, F.lit(False)) | F.coalesce(short, F.lit(False)))


def ema_divergence(bars: DataFrame, span: int = 22, sep: int = 5, lookback: int = 40, confirm: int = 3) -> DataFrame:
    """Two lows (highs) within ``lookback`` bars, the later one lower (higher) with a higher (lower) histogram, and the
    histogram turning within ``confirm`` bars: target the farther of the mean and twice the risk."""
    w = Window.partitionBy("symbol").orderBy("i")
    m = B.local_extrema(B.ema(B.macd_hist(bars), "close", [span]))
    m = B.previous_event(m, "is_low", ["i", "low", "macd_hist"]).withColumnsRenamed({"prev_i": "li", "prev_low": "ll", "prev_macd_hist": "lh"})
    m = B.previous_event(m, "is_high", ["i", "high", "macd_hist"]).withColumnsRenamed({"prev_i": "hi_i", "prev_high": "hh", "prev_macd_hist": "hm"})
    turn = lambda up: F.coalesce(*[F.when((F.lead("macd_hist", j).over(w) > F.lead("macd_hist", j - 1).over(w)) if up else (F.lead("macd_hist", j).over(w) < F.lead("macd_hist", j - 1).over(w)), F.lit(j)) for j in range(1, confirm + 1)])
    near = lambda c: (F.col("i") - F.col(c)).between(sep, lookback)
    long = F.col("is_low") & near("li") & (F.col("low") < F.col("ll")) & (F.col("macd_hist") > F.col("lh"))
    short = F.col("is_high") & near("hi_i") & (F.col("high") > F.col("hh")) & (F.col("macd_hist") < F.col("hm"))
    long, short = F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False))
    warm = F.col("i") >= max(span, 26, lookback) + sep + confirm
    m = m.withColumns({"_long": long & warm, "_short": short & warm & ~long}).withColumn("_j", F.when(F.col("_long"), turn(True)).when(F.col("_short"), turn(False)))
    m = m.withColumn("_e", F.coalesce(*[F.when(F.col("_j") == j, F.lead("close", j).over(w)) for j in range(1, confirm + 1)]))
    e, mean = F.col("_e"), F.col(f"ema_{span}")
    stop = F.when(F.col("_long"), F.col("low")).otherwise(F.col("high"))
    target = F.when(F.col("_long"), F.greatest(mean, e + 2 * (e - stop))).otherwise(F.least(mean, e - 2 * (stop - e)))
    return _signals(m, F.when(F.col("_long"), "long").otherwise("short"), e, stop, target, F.col("_j").isNotNull(), F.col("i") + F.col("_j"))


def triple_screen(short_bars: DataFrame, long_bars: DataFrame, trend_span: int = 26, fast: int = 13, low: float = 30.0) -> DataFrame:
    """The slow series' trend, as of each fast bar's open, agrees with an oversold (overbought) oscillator: enter beyond
    the bar before, stop at the last five lows (highs), target two risks beyond the fast mean."""
    from .asof import align_timeframes

    w = Window.partitionBy("symbol").orderBy("i")
    slow = B.ema(long_bars, "close", [trend_span])
    slow = slow.withColumn("trend", F.signum(F.col(f"ema_{trend_span}") - F.lag(f"ema_{trend_span}").over(w))).where("trend is not null").select("symbol", "t", "trend")
    b = align_timeframes(B.stochastic_k(B.ema(short_bars, "close", [fast])), slow, ["symbol"], "t", "trend")
    f = w.rowsBetween(-5, -1)
    b = b.withColumns({"_lo": F.min("low").over(f), "_hi": F.max("high").over(f), "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w)})
    long, short = (F.col("stoch_k") < low) & (F.col("long_trend") > 0), (F.col("stoch_k") > 100 - low) & (F.col("long_trend") < 0)
    mean = F.col(f"ema_{fast}")
    stop = F.when(long, F.col("_lo")).otherwise(F.col("_hi"))
    return _signals(b, F.when(long, "long").otherwise("short"), F.when(long, F.col("_ph") * 1.0001).otherwise(F.col("_pl") * 0.9999), stop, F.when(long, mean + 2 * (mean - stop)).otherwise(mean - 2 * (stop - mean)), (F.col("i") >= 5) & (long | short))


def fresh_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("i").alias("i"))
    return signals.join(last, ["symbol", "i"], "left_semi")


def entry_fill(signals: DataFrame, bars: DataFrame, risk: float = 0.02, min_rr: float = 2.0) -> DataFrame:
    """Signals whose entry lies in reach of their bar, whose reward is enough, and whose stake is within the value."""
    b = bars.select("symbol", "i", F.col("high").alias("_h"), F.col("low").alias("_l"))
    d = F.abs(F.col("entry") - F.col("stop"))
    reach = F.when(F.col("direction") == "long", F.col("_h") >= F.col("entry")).otherwise(F.col("_l") <= F.col("entry"))
    ok = (d >= 1e-8) & (F.abs(F.col("target") - F.col("entry")) >= min_rr * d) & (F.lit(risk) * F.col("entry") / F.nullif(d, F.lit(0.0)) <= 1)
    return signals.join(b, ["symbol", "i"]).where(reach & ok).drop("_h", "_l")


def _nodes(bars: DataFrame) -> list[DataFrame]:
    """The tree over each symbol's bars: level k has nodes of ``FAN`` children of level k - 1 (bars are children of level 0),
    each child with its number, least low and greatest high; all children of the last level are in one node."""
    child = F.struct(F.col("_c").alias("c"), "low", "high")
    below = bars.select("symbol", F.col("i").alias("_c"), "low", "high")
    levels = []
    for k in range(LEVELS):
        node = F.floor(F.col("_c") / FAN).cast("long") if k < LEVELS - 1 else F.lit(0).cast("long")
        levels.append(below.groupBy("symbol", node.alias("_node")).agg(F.array_sort(F.collect_list(child)).alias("_kids"), F.min("low").alias("low"), F.max("high").alias("high")))
        below = levels[-1].select("symbol", F.col("_node").alias("_c"), "low", "high")
    return levels


def barrier_label(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Each signal with its exit: the first later bar that reaches the stop or target (the stop if both), else the last
    bar's close, ``end_of_data``. Equal rows are one signal.

    The search goes over a tree of least lows and greatest highs: ``FAN`` bars, as many blocks of bars, and so on. A
    leaf carries the children of the nodes above it, so one join tells a signal whether its exit is among the bars of its
    block, or in which later block of which level; from there each level down is a join with the children of one node. A
    signal looks at ``FAN`` children a level, however long the series, and the joins' keys are single nodes.
    """
    long = F.col("direction") == "long"
    under, over = F.when(long, F.col("stop")).otherwise(F.col("target")), F.when(long, F.col("target")).otherwise(F.col("stop"))
    reached = lambda x: (x["low"] <= F.col("_under")) | (x["high"] >= F.col("_over"))
    levels = _nodes(bars)
    last = bars.groupBy("symbol").agg(F.max("i").alias("_end"), F.max_by("close", "i").alias("_close"))
    leaf = levels[0].select("symbol", F.col("_node").alias("_n0"), F.col("_kids").alias("_k0"))
    for k in range(1, LEVELS):
        above = F.floor(F.col(f"_n{k - 1}") / FAN).cast("long") if k < LEVELS - 1 else F.lit(0).cast("long")
        leaf = leaf.withColumn(f"_n{k}", above).join(levels[k].select("symbol", F.col("_node").alias(f"_n{k}"), F.col("_kids").alias(f"_k{k}")), ["symbol", f"_n{k}"])
    leaf = leaf.join(last, "symbol").drop(*[f"_n{k}" for k in range(1, LEVELS)])
    own, tasks = signals.columns, int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the search is more work than the bytes of its signals show: a number keeps their tasks from being merged
    s = signals.withColumns({"_n0": F.floor(F.col("i") / FAN).cast("long"), "_under": under, "_over": over}).repartition(tasks, "symbol", "_n0").join(leaf.hint("merge"), ["symbol", "_n0"])
    beyond = lambda at: lambda x: (x["c"] > at) & reached(x)
    at, found = F.col("i"), []
    for k in range(LEVELS):
        # the first later child of this level; only the first level that has one counts
        x = F.get(F.filter(f"_k{k}", beyond(at)), F.lit(0))
        found.append(F.when(x.isNotNull(), F.struct(F.lit(k).alias("level"), x.alias("x"))))
        at = F.floor(at / FAN).cast("long")
    hit = s.withColumn("_hit", F.coalesce(*found))
    s = hit.select(*own, "_n0", "_under", "_over", "_end", "_close", F.col("_hit.level").alias("_level"), F.col("_hit.x").alias("_x")).distinct().drop("_n0")
    for k in range(LEVELS - 1, 0, -1):
        down = F.col("_level") == k
        kids = levels[k - 1].select("symbol", F.col("_node"), F.col("_kids"))
        # signals with nothing to look up keep keys of their own
        s = s.withColumn("_node", F.when(down, F.col("_x.c")).otherwise(-1 - F.col("i"))).join(kids, ["symbol", "_node"], "left")
        s = s.withColumns({"_x": F.when(down, F.get(F.filter("_kids", reached), F.lit(0))).otherwise(F.col("_x")), "_level": F.when(down, k - 1).otherwise(F.col("_level"))}).drop("_node", "_kids")
    stopped = F.when(long, F.col("_x.low") <= F.col("stop")).otherwise(F.col("_x.high") >= F.col("stop"))
    kind = F.when(F.col("_x").isNull(), "end_of_data").when(stopped, "stop").otherwise("target")
    price = F.when(F.col("_x").isNull(), F.col("_close")).when(stopped, F.col("stop")).otherwise(F.col("target"))
    return s.select(*own, F.coalesce("_x.c", "_end").alias("exit_i"), price.alias("exit_price"), kind.alias("reason"))


def trade_costs(labelled: DataFrame, fee: float = 0.00045, slip: float = 0.0005, nav: float = 10_000.0, risk: float = 0.02) -> DataFrame:
    """Units at a fixed share of risk, and gross, cost and net of each trade."""
    units = F.lit(nav * risk) / F.abs(F.col("entry") - F.col("stop"))
    gross = units * F.when(F.col("direction") == "long", F.col("exit_price") - F.col("entry")).otherwise(F.col("entry") - F.col("exit_price"))
    cost = units * (F.col("entry") + F.col("exit_price")) * (fee + slip)
    return labelled.withColumns({"units": units, "gross": gross, "cost": cost, "net": gross - cost})


_ORDER = ("i", "direction", "entry", "stop", "target")


def _fold(labelled: DataFrame, by: list[str], begin, step, added: str) -> DataFrame:
    """The rows that ``step(state, row)`` takes, with the values it gives for the columns ``added``.

    Each group's rows come in order, in Arrow batches of a partition that is sorted by group; ``begin`` gives the state
    at a group's first row. A group is never held: what a task keeps is one state and one batch.
    """
    import pandas as pd

    keys, own = list(by), labelled.columns
    line = labelled.repartition(*keys).sortWithinPartitions(*keys, *[c for c in _ORDER if c in own and c not in keys])
    names = [a.split()[0] for a in added.split(",") if a.strip()]

    def run(batches):
        now, state = None, None
        for pdf in batches:
            kept, made = [], []
            for k, (key, row) in enumerate(zip(zip(*[pdf[c] for c in keys], strict=True), pdf.itertuples(index=False), strict=True)):
                if key != now:
                    now, state = key, begin()
                values = step(state, row)
                if values is not None:
                    kept.append(k)
                    made.append(values)
            out = pdf.iloc[kept].copy()
            for j, n in enumerate(names):
                out[n] = pd.Series([m[j] for m in made], index=out.index, dtype="int64" if n.endswith("bars") else "float64")
            yield out

    kinds = {c: t for c, t in labelled.dtypes} | dict(a.split() for a in added.split(",") if a.strip())
    return line.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def non_overlap(labelled: DataFrame, by: list[str] = ("symbol",)) -> DataFrame:
    """The trades that a book of one position at a time takes: a signal at or before the exit of the last taken trade is
    skipped. A fold over each group's signals in order (never its bars)."""

    def step(state, row):
        if row.i <= state["free"]:
            return None
        state["free"] = row.exit_i
        return ()

    return _fold(labelled, by, lambda: {"free": -1}, step, "")


def simulate(labelled: DataFrame, by: list[str] = ("symbol",), nav0: float = 10_000.0, risk: float = 0.02, floor: float = 5_000.0, ceiling: float = 1_000_000.0, breaker: float = 0.06, fee: float = 0.00045, slip: float = 0.0005, month: str = "month") -> DataFrame:
    """The trades that one book for each group takes from labelled signals, with units, gross, cost, net and its value
    before and after.

    One fold over a group's signals in order decides breaker, overlap and compounding together: a month that has lost
    ``breaker`` of its first value takes nothing more, and what it does not take blocks no later signal; a signal at or
    before the last exit is skipped; risk is a share of the value (at most ``ceiling``), a stake over the value is
    skipped; a value under ``floor`` ends the run. ``month`` is that of the signal's bar. The labels were found in
    parallel before; only this recursion goes through a group in order.
    """

    def step(s, row):
        if s["dead"]:
            return None
        if getattr(row, month) != s["month"]:
            s |= {"month": getattr(row, month), "base": s["nav"], "halted": False}
        if s["halted"] or row.i <= s["free"]:
            return None
        nav, up = s["nav"], row.direction == "long"
        value = min(nav, ceiling)
        units = value * risk / abs(row.entry - row.stop)
        if units * row.entry > value:
            return None
        gross = units * ((row.exit_price - row.entry) if up else (row.entry - row.exit_price))
        cost = units * (row.entry + row.exit_price) * (fee + slip)
        after = max(0.0, min(nav + gross - cost, ceiling))
        s |= {"nav": after, "free": row.exit_i, "halted": s["base"] > 0 and (s["base"] - after) / s["base"] >= breaker, "dead": after < floor}
        return units, gross, cost, gross - cost, value, after, row.exit_i - row.i

    begin = lambda: {"nav": nav0, "month": None, "base": nav0, "halted": False, "free": -1, "dead": False}
    return _fold(labelled, by, begin, step, "units double, gross double, cost double, net double, nav_before double, nav double, hold_bars long")


def trade_stats(trades: DataFrame, bars: DataFrame, by: list[str] = ("symbol",), nav0: float = 10_000.0) -> DataFrame:
    """By group of simulated trades: count, profit factor (gross; null without a loss), win rate, means, returns, drawdown
    in value and in bars, and the Sharpe ratio of net over value before, made annual by the symbol's median bar and
    the mean hold (0 with fewer than two trades or no deviation)."""
    w = Window.partitionBy(*by).orderBy("i", "direction")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    v = trades.withColumn("_peak", F.greatest(F.lit(nav0), F.max("nav").over(before)))
    v = v.withColumn("_new", F.col("nav") >= F.col("_peak")).withColumns({"_dd": F.when(~F.col("_new"), (F.col("_peak") - F.col("nav")) / F.col("_peak")).otherwise(0.0), "_from": F.coalesce(F.last(F.when(F.col("_new"), F.col("exit_i")), ignorenulls=True).over(upto), F.lit(0))})
    ret = F.when(F.col("nav_before") > 0, F.col("net") / F.col("nav_before"))
    g = v.groupBy(*by).agg(
        F.count("*").alias("n_trades"), F.sum(F.greatest("gross", F.lit(0.0))).alias("_up"), F.sum(F.greatest(-F.col("gross"), F.lit(0.0))).alias("_down"), F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg("net").alias("avg_pnl"), F.avg("hold_bars").alias("avg_hold"), F.max_by("nav", F.struct("i", "direction")).alias("nav_final"), F.greatest(F.lit(nav0), F.max("nav")).alias("nav_peak"), F.max("_dd").alias("max_dd"),
        F.max(F.when(F.col("_new"), F.lit(0)).otherwise(F.col("exit_i") - F.col("_from"))).cast("long").alias("longest_dd"), F.avg(ret).alias("_mean"), F.stddev_pop(ret).alias("_sd"), F.count(ret).alias("_rets"),
    )
    step = bars.withColumn("_d", F.col("t") - F.lag("t").over(Window.partitionBy("symbol").orderBy("i"))).groupBy("symbol").agg(F.percentile("_d", F.lit(0.5)).alias("_bar"))
    g = g.join(F.broadcast(step) if list(by) == ["symbol"] else step, "symbol", "left")  # a row for each symbol
    per_year = F.when(F.col("_bar") > 0, 365 * 86_400e6 / F.col("_bar")).otherwise(2190.0)
    sharpe = F.when((F.col("_rets") >= 2) & (F.col("_sd") >= 1e-10), F.col("_mean") / F.col("_sd") * F.sqrt(per_year / F.greatest("avg_hold", F.lit(1.0)))).otherwise(0.0)
    out = g.withColumns({"profit_factor": F.col("_up") / F.nullif("_down", F.lit(0.0)), "total_return": F.col("nav_final") - nav0, "pct_return": (F.col("nav_final") - nav0) / nav0, "sharpe": sharpe})
    return out.drop("_up", "_down", "_mean", "_sd", "_rets", "_bar")


def monthly_returns(trades: DataFrame, bars: DataFrame, by: list[str] = ("symbol",)) -> DataFrame:
    """By group and month of the exit bar (``yyyy-MM``, UTC): the net profit."""
    t = bars.select("symbol", F.col("i").alias("exit_i"), F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("exit_month"))
    return trades.join(t, ["symbol", "exit_i"]).groupBy(*by, "exit_month").agg(F.sum("net").alias("net"))


def evaluate(trades: DataFrame, bars: DataFrame, by: list[str] = ("symbol",), nav0: float = 10_000.0, floor: float = 5_000.0, min_trades: int = 20, min_factor: float = 1.3) -> DataFrame:
    """``trade_stats`` with a status and score: catastrophic if the value ends under ``floor``, rejected with fewer than
    ``min_trades`` trades or a profit factor of at most ``min_factor``, else scored."""
    g = trade_stats(trades, bars, by, nav0)
    thin = F.coalesce(F.col("profit_factor"), F.lit(float("inf"))) <= min_factor
    g = g.withColumn("status", F.when(F.col("nav_final") < floor, "catastrophic").when((F.col("n_trades") < min_trades) | thin, "rejected").otherwise("scored"))
    return g.withColumn("score", F.when(F.col("status") == "scored", S.score("pct_return", "max_dd", "n_trades")).when(F.col("status") == "catastrophic", -1000.0))


def replay_report(trades: DataFrame, by: list[str] = ("symbol",), bar_days: float = 1.0) -> DataFrame:
    """By group of simulated trades with their ``funding``: count, gross, fees, funding, net without and with it, the Sharpe
    ratio, final value and drawdown of both (returns over the first value, annual by the mean hold; the worse drawdown).

    Values and their peaks are running totals by blocks of bars.
    """
    keys, block = list(by), F.floor(F.col("i") / B.SCAN)
    first = trades.groupBy(*keys).agg(F.min_by("nav_before", "i").alias("_v0"))
    t = trades.withColumn("_funded", F.col("net") - F.col("funding")).join(first, keys)
    t = B.running(t, {"_a": ("sum", "net"), "_b": ("sum", "_funded")}, keys, ["i"], block)
    t = t.withColumns({c: F.col(c) + F.col("_v0") for c in ("_a", "_b")})
    t = B.running(t, {"_pa": ("max", "_a"), "_pb": ("max", "_b")}, keys, ["i"], block)
    fall = lambda v, p: (F.greatest(p, "_v0") - F.col(v)) / F.greatest(p, "_v0")
    g = t.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("gross").alias("gross"), F.sum("cost").alias("fees"), F.sum("funding").alias("funding"), F.sum("net").alias("net"), F.sum("_funded").alias("net_funded"), F.first("_v0").alias("_v0"), F.avg("hold_bars").alias("_hold"),
        *[x for n, c in (("", "net"), ("_funded", "_funded")) for x in (F.avg(F.col(c) / F.col("_v0")).alias(f"_m{n}"), F.stddev_pop(F.col(c) / F.col("_v0")).alias(f"_s{n}"))], F.max(F.greatest(fall("_a", "_pa"), fall("_b", "_pb"), F.lit(0.0))).alias("max_dd"))
    year = F.sqrt(365 / F.greatest(F.col("_hold") * bar_days, F.lit(1e-6)))
    sharpe = lambda n: F.when((F.col("trades") >= 2) & (F.col(f"_s{n}") > 0), F.col(f"_m{n}") / F.col(f"_s{n}") * year).otherwise(0.0)
    g = g.withColumns({"sharpe": sharpe(""), "sharpe_funded": sharpe("_funded"), "final_nav": F.col("_v0") + F.col("net"), "final_nav_funded": F.col("_v0") + F.col("net_funded")})
    return g.drop("_v0", "_hold", "_m", "_s", "_m_funded", "_s_funded")


def replay_totals(report: DataFrame, mean_sharpe: float = 1.0, median_sharpe: float = 0.5, drawdown: float = 0.25) -> DataFrame:
    """One row over the groups of a replay (few: one a symbol): sums, funding in percent of the net's size, median and mean
    Sharpe ratio with funding, worst drawdown, and whether all three criteria hold."""
    g = report.agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in ("gross", "fees", "funding", "net", "net_funded")], F.median("sharpe_funded").alias("median_sharpe"), F.avg("sharpe_funded").alias("mean_sharpe"), F.max("max_dd").alias("max_dd"))
    go = (F.col("mean_sharpe") >= mean_sharpe) & (F.col("median_sharpe") >= median_sharpe) & (F.col("max_dd") <= drawdown)
    return g.withColumns({"funding_pct": F.coalesce(F.col("funding") / F.nullif(F.abs("net"), F.lit(0.0)) * 100, F.lit(0.0)), "go": go})


def by_month(rows: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals with ``month``, that of their bar (``yyyy-MM``, UTC)."""
    m = bars.select("symbol", "i", F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("month"))
    return rows.join(m, ["symbol", "i"])


def run_book(signals: DataFrame, bars: DataFrame, by: list[str] = ("symbol",)) -> DataFrame:
    """Signals to simulated trades: fills, labels, months and the fold."""
    return simulate(by_month(barrier_label(entry_fill(signals, bars), bars), bars), by)


def walk_forward(signals: DataFrame, bars: DataFrame, k: int = 5, min_trades: int = 20) -> DataFrame:
    """Each of ``k`` consecutive folds of a symbol's bars evaluated by itself: a book that starts anew and exits that never
    leave the fold. (symbol, fold, the columns of ``evaluate``)"""
    f = B.equal_slices(bars, k, ["symbol"], "i")
    key = F.concat_ws("/", "symbol", "slice")
    folds = f.select(key.alias("symbol"), "i", "t", "low", "high", "close")
    named = signals.join(f.select("symbol", "i", "slice"), ["symbol", "i"]).withColumn("symbol", key).drop("slice")
    out = evaluate(run_book(named, folds), folds, min_trades=min_trades)
    return out.withColumns({"fold": F.substring_index("symbol", "/", -1).cast("int"), "symbol": F.regexp_replace("symbol", "/[0-9]+$", "")})


def status_rollup(results: DataFrame, by: list[str]) -> DataFrame:
    """Any catastrophic run makes the group so; none scored: rejected; else the mean, sum and maximum of the scored."""
    scored = F.col("status") == "scored"
    g = results.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(scored).alias("scored"), F.bool_or(F.col("status") == "catastrophic").alias("_c"), F.avg(F.when(scored, F.col("score"))).alias("mean"), F.max(F.when(scored, F.col("score"))).alias("best"))
    status = F.when(F.col("_c"), "catastrophic").when(F.col("scored") == 0, "rejected").otherwise("scored")
    return g.withColumn("status", status).withColumn("mean", F.when(F.col("_c"), -1000.0).otherwise(F.col("mean"))).drop("_c")


def fold_rollup(results: DataFrame, by: list[str]) -> DataFrame:
    scored = F.col("status") == "scored"
    g = results.groupBy(*by).agg(F.count_if(scored).alias("scored"), F.avg(F.when(scored, F.col("score"))).alias("mean"), F.stddev_pop(F.when(scored, F.col("score"))).alias("_s"), F.min(F.when(scored, F.col("score")).when(F.col("status") == "catastrophic", -1000.0).otherwise(-9999.0)).alias("worst"), F.count("*").alias("folds"))
    return g.withColumns({"sigma": F.when(F.col("scored") >= 2, F.col("_s")).otherwise(0.0), "consistent": F.col("scored") == F.col("folds")}).drop("_s")


def coverage_summary(runs: DataFrame) -> DataFrame:
    tf = F.coalesce(F.get_json_object("config", "$.timeframe"), F.get_json_object("config", "$.short_tf"))
    g = runs.withColumn("timeframe", tf).where("timeframe is not null")
    return g.groupBy("template", "timeframe").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "scored").alias("scored"), F.max(F.when(F.col("status") == "scored", F.col("score"))).alias("best"))


def search_report(runs: DataFrame, by: list[str] = ("template",), top: int = 10) -> DataFrame:
    """By group: runs, scored, rate, best, upper median and mean of the best ``top`` scores."""
    s = runs.withColumn("_s", F.when(F.col("status") == "scored", F.col("score")))
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("_s"), "id")
    n = F.count("_s").over(Window.partitionBy(*by))
    r = s.withColumns({"_r": F.row_number().over(w), "_n": n})
    # the upper median counts from the least: place n - n div 2 from the top
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.count("_s").alias("scored"), (F.count("_s") / F.count("*")).alias("rate"), F.max("_s").alias("best"), F.max(F.when(F.col("_r") == F.col("_n") - F.floor(F.col("_n") / 2), F.col("_s"))).alias("median"), F.avg(F.when(F.col("_r") <= top, F.col("_s"))).alias("top_mean"))


def top_configs(runs: DataFrame, n: int, by: list[str] = ("template",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return runs.where("status = 'scored'").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def last_n_runs(runs: DataFrame, n: int, exclude_errors: bool = False) -> DataFrame:
    r = runs.where("status <> 'error'") if exclude_errors else runs
    return r.orderBy(F.desc("id")).limit(n)


def stagnation(runs: DataFrame, n: int) -> DataFrame:
    """One row: the last ``n`` templates, newest first, and whether there are as many and all are one."""
    last = last_n_runs(runs, n).agg(F.sort_array(F.collect_list(F.struct("id", "template")), asc=False).alias("_l"))
    names = F.transform("_l", lambda x: x["template"])
    return last.select(names.alias("templates"), ((F.size("_l") == n) & (F.size(F.array_distinct(names)) == 1)).alias("stagnant"))


def duplicate_configs(runs: DataFrame, window: int = 10) -> DataFrame:
    """Runs whose (template, config, cohort) occurs among the ``window`` runs before them, by id."""
    key = F.xxhash64("template", "config", "cohort")
    k = runs.withColumn("_k", key)
    w = Window.partitionBy("_k").orderBy("id")
    return k.withColumn("previous", F.lag("id").over(w)).where(F.col("id") - F.col("previous") <= window).select("id", "previous")


def retention_report(in_sample: DataFrame, folds: DataFrame, by: list[str], folds_pass: int = 4, least: float = 0.7) -> DataFrame:
    f = folds.where("status = 'scored'").groupBy(*by).agg(F.count("*").alias("folds_scored"), F.avg("score").alias("fold_mean"))
    j = in_sample.join(f, by, "left").withColumn("retention", S.retention("fold_mean", "score"))
    return j.withColumn("survives", F.coalesce((F.col("folds_scored") >= folds_pass) & (F.col("retention") >= least), F.lit(False)))


def cross_configs(configs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every configuration with every symbol. ``configs`` are tried by hand or by a search, so few: they are exploded out of
    one array row, not joined."""
    one = configs.agg(F.collect_list(F.struct(*configs.columns)).alias("_c"))
    return symbols.select("symbol").distinct().join(F.broadcast(one), F.lit(True)).select("symbol", F.explode("_c").alias("_x")).select("symbol", "_x.*")


#: The furthest bar ahead of its own that a configuration may look at.
AHEAD = 10
#: Templates that take their parameters from columns: their parameters, with the default of each.
PARAMETERS: dict[str, dict[str, dict]] = {
    "false_breakout": {"lookback": {"type": "int", "low": 2, "high": 500, "default": 30}, "min_width": {"type": "double", "low": 0, "default": 0.05}, "confirm": {"type": "int", "low": 1, "high": AHEAD, "default": 3}, "min_rr": {"type": "double", "low": 0, "default": 2.0}},
    "kangaroo_tail": {"context": {"type": "int", "low": 2, "high": 500, "default": 10}, "multiple": {"type": "double", "low": 1, "default": 2.0}, "target": {"type": "double", "low": 0, "default": 1.0}, "lag": {"type": "int", "low": 1, "high": AHEAD, "default": 1}, "min_rr": {"type": "double", "low": 0, "default": 2.0}},
    "channel_fade": {"span": {"type": "int", "low": 1, "high": 500, "default": 22}, "width": {"type": "double", "low": 0, "high": 1, "default": 0.05}, "gap": {"type": "int", "low": 1, "default": 5}, "min_rr": {"type": "double", "low": 0, "default": 2.0}},
}


def checked_configs(configs: DataFrame) -> DataFrame:
    """``configs`` (config_id, template, params: a map of strings) with ``errors``, by the parameters of each template."""
    errors = None
    for name, rules in PARAMETERS.items():
        own = parameter_errors({k: {**r, "optional": True} for k, r in rules.items()}, column="params")
        errors = F.when(F.col("template") == name, own) if errors is None else errors.when(F.col("template") == name, own)
    return configs.withColumn("errors", errors.otherwise(F.array(F.lit("template: choice"))))


def _of_template(configs: DataFrame, name: str) -> DataFrame:
    """The configurations of one template: config_id and a column for each parameter."""
    value = lambda k, r: F.coalesce(F.try_element_at("params", F.lit(k)).try_cast(r["type"]), F.lit(r["default"]).cast(r["type"])).alias(k)
    return configs.where(F.col("template") == name).select("config_id", *[value(k, r) for k, r in PARAMETERS[name].items()])


def _with_lengths(bars: DataFrame, configs: DataFrame, length: str) -> DataFrame:
    """Every bar with every distinct value of a parameter: the values, no more than there are configurations, are
    exploded out of one array row."""
    one = configs.agg(F.sort_array(F.collect_set(length)).alias("_all"))
    return bars.join(F.broadcast(one), F.lit(True)).withColumn(length, F.explode("_all")).drop("_all")


def _with_ahead(bars: DataFrame) -> DataFrame:
    """Bars with the next ``AHEAD`` of their symbol, their heights and their neighbours' heights, and the last number."""
    w = Window.partitionBy("symbol").orderBy("i")
    b = bars.withColumns({"_ahead": F.collect_list(F.struct("close", "low", "high")).over(w.rowsBetween(1, AHEAD)), "_last": F.max("i").over(Window.partitionBy("symbol")), "_h": F.col("high") - F.col("low")})
    return b.withColumns({"_p": F.lag("_h").over(w), "_n": F.lead("_h").over(w)})


def _configured(rows: DataFrame, direction, entry, stop, target, when, at) -> DataFrame:
    out = rows.where(when).select("config_id", "symbol", at.alias("i"), direction.alias("direction"), entry.alias("entry"), stop.alias("stop"), target.alias("target"), "min_rr")
    return out.where(S.signal_ok("direction", "entry", "stop", "target", F.col("min_rr"))).drop("min_rr")


def false_breakouts(bars: DataFrame, configs: DataFrame) -> DataFrame:
    """``false_breakout`` of every configuration: ranges once for each distinct ``lookback``, bars outside them with the
    configurations of that lookback."""
    c = _of_template(configs, "false_breakout")
    r = B.rolling_by(_with_lengths(_with_ahead(bars), c, "lookback"), "lookback", {"support": ("min", "low"), "resistance": ("max", "high")})
    r = r.where("close < support or close > resistance").join(c, "lookback")
    long = F.col("close") < F.col("support")
    near = F.slice("_ahead", F.lit(1), F.col("confirm"))
    back = F.transform(near, lambda x: F.when(long, x["close"] > F.col("support")).otherwise(x["close"] < F.col("resistance")))
    j = F.array_position(back, True).cast("int")
    r = r.withColumn("_j", j).where("_j > 0")
    since = F.slice("_ahead", F.lit(1), F.col("_j"))
    low, high = F.least("low", F.array_min(F.transform(since, lambda x: x["low"]))), F.greatest("high", F.array_max(F.transform(since, lambda x: x["high"])))
    wide = (F.col("resistance") - F.col("support")) / ((F.col("resistance") + F.col("support")) / 2) >= F.col("min_width")
    long = F.col("close") < F.col("support")
    entry = F.get("_ahead", F.col("_j") - 1)["close"]
    return _configured(r, F.when(long, "long").otherwise("short"), entry, F.when(long, low).otherwise(high), F.when(long, F.col("resistance")).otherwise(F.col("support")), wide & (F.col("i") <= F.col("_last") - F.col("confirm")), F.col("i") + F.col("_j"))


def kangaroo_tails(bars: DataFrame, configs: DataFrame) -> DataFrame:
    """``kangaroo_tail`` of every configuration: mean heights once for each distinct ``context``."""
    c = _of_template(configs, "kangaroo_tail")
    r = B.rolling_by(_with_lengths(_with_ahead(bars), c, "context"), "context", {"_sum": ("sum", "_h")}).join(c, "context")
    least = F.col("multiple") * F.col("_sum") / F.col("context")
    mid = (F.col("high") + F.col("low")) / 2
    tall = (F.col("_h") >= least) & (F.col("_p") < least) & (F.col("_n") < least) & (F.col("i") >= F.col("context") + 1) & (F.col("i") <= F.col("_last") - F.col("lag") - 1)
    up, down = F.least("open", "close") >= mid, F.greatest("open", "close") <= mid
    e = F.get("_ahead", F.col("lag") - 1)["close"]
    return _configured(r, F.when(up, "long").otherwise("short"), e, mid, F.when(up, e + F.col("target") * F.col("_h")).otherwise(e - F.col("target") * F.col("_h")), tall & (up | down), F.col("i") + F.col("lag"))


def channel_fades(bars: DataFrame, configs: DataFrame) -> DataFrame:
    """``channel_fade`` of every configuration: means once for each distinct ``span``; only bars that touch a channel go on."""
    c = _of_template(configs, "channel_fade")
    m = B.affine_means(_with_lengths(bars, c, "span"), {"mean": (F.col("close"), 2 / (F.col("span") + 1))}, ["symbol", "span"], "i").join(c, "span")
    lower, upper = F.col("mean") * (1 - F.col("width")), F.col("mean") * (1 + F.col("width"))
    m = m.withColumn("_side", F.explode(F.array_compact(F.array(F.when(F.col("low") < lower, "long"), F.when(F.col("high") > upper, "short")))))
    w = Window.partitionBy("config_id", "symbol", "_side").orderBy("i")
    m = m.withColumn("_was", F.lag(F.struct("i", "low", "high", "close")).over(w))
    long = F.col("_side") == "long"
    shallow = F.when(long, (F.col("low") > F.col("_was.low")) & (F.col("close") > F.col("_was.close"))).otherwise((F.col("high") < F.col("_was.high")) & (F.col("close") < F.col("_was.close")))
    m = m.where((F.col("i") - F.col("_was.i") >= F.col("gap")) & shallow)
    # a bar that fades both sides is a long one
    m = m.withColumn("_first", F.row_number().over(Window.partitionBy("config_id", "symbol", "i").orderBy("_side"))).where("_first = 1")
    stop = F.when(long, F.col("low") - (lower - F.col("low")) / 2).otherwise(F.col("high") + (F.col("high") - upper) / 2)
    return _configured(m, F.col("_side"), F.col("close"), stop, F.col("mean"), F.lit(True), F.col("i"))


#: Templates over a relation of configurations.
CONFIGURED = {"false_breakout": false_breakouts, "kangaroo_tail": kangaroo_tails, "channel_fade": channel_fades}


def sweep(bars: DataFrame, configs: DataFrame, min_trades: int = 5) -> DataFrame:
    """Every configuration (config_id, template, params) over every symbol: (config_id, symbol, the columns of ``evaluate``,
    reason), one row for each pair.

    Configurations are a relation, so one plan holds any number of them: each template takes its parameters from
    columns, and windows are shared by distinct lengths. A configuration with errors is not run: status ``error``, its
    errors the reason. A pair without a trade is ``rejected``.
    """
    checked = checked_configs(configs)
    good = checked.where(F.size("errors") == 0)
    signals = None
    for fn in CONFIGURED.values():
        found = fn(bars, good)
        signals = found if signals is None else signals.unionByName(found)
    by = ["config_id", "symbol"]
    ev = evaluate(run_book(signals, bars, by), bars, by, min_trades=min_trades)
    all_pairs = cross_configs(checked.select("config_id", "template", "errors"), bars)
    out = all_pairs.join(ev, by, "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0)))
    wrong = F.size("errors") > 0
    out = out.withColumn("status", F.when(wrong, "error").otherwise(F.coalesce("status", F.lit("rejected"))))
    reason = F.when(wrong, F.array_join("errors", "; ")).when(F.col("status") == "catastrophic", "value under the floor").when(F.col("status") == "rejected", F.when(F.col("n_trades") < min_trades, "too few trades").otherwise("profit factor"))
    return out.withColumn("reason", reason).drop("errors")


def holdout(rows: DataFrame, bars: DataFrame, days: int) -> DataFrame:
    """Rows in the last ``days`` of each symbol's bars."""
    last = bars.groupBy("symbol").agg(F.max("t").alias("_z"))
    return rows.join(last, "symbol").where(F.col("t") >= F.col("_z") - days * 86_400_000_000).drop("_z")


#: Templates by name: functions of bars to signals.
TEMPLATES = {"false_breakout": false_breakout, "kangaroo_tail": kangaroo_tail, "impulse_system": impulse_system, "channel_fade": channel_fade, "ema_divergence": ema_divergence}


def register_template(name: str, fn) -> None:
    TEMPLATES[name] = fn


def from_pandas_template(fn):
    """A template from a function of one symbol's bars (pandas, in order) to (i, direction, entry, stop, target) rows."""

    def run(bars: DataFrame) -> DataFrame:
        def one(pdf):
            out = fn(pdf.sort_values("i"))
            return out.assign(symbol=pdf["symbol"].iloc[0])[["symbol", "i", "direction", "entry", "stop", "target"]]

        return bars.groupBy("symbol").applyInPandas(one, "symbol string, i long, direction string, entry double, stop double, target double")

    return run


def template_table_function(fn):
    """A template from a function of one symbol's bars (pandas, in order) and parameters, as a function that SQL calls on a
    table: ``SELECT * FROM name(TABLE(bars), MAP('lookback', '20'))``.

    The function asks for its table by symbol in order of ``i``, so Spark shuffles and sorts the bars and each symbol is
    one call. Parameters are a map of strings. To be registered by ``spark.udtf.register``.
    """
    from pyspark.sql.functions import AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    class Signals:
        @staticmethod
        def analyze(table, params=None):
            names = [f.name for f in table.dataType.fields]
            missing = [c for c in ("symbol", "i", "open", "high", "low", "close") if c not in names]
            if missing:
                raise ValueError(f"bars without {', '.join(missing)}")
            schema = StructType()
            for name, kind in (("symbol", StringType()), ("i", LongType()), ("direction", StringType()), ("entry", DoubleType()), ("stop", DoubleType()), ("target", DoubleType())):
                schema = schema.add(name, kind)
            return AnalyzeResult(schema, partitionBy=[PartitioningColumn("symbol")], orderBy=[OrderingColumn("i")])

        def __init__(self):
            self.rows, self.params = [], {}

        def eval(self, row, params=None):
            self.rows.append((row["symbol"], row["i"], row["open"], row["high"], row["low"], row["close"]))
            self.params = params or {}

        def terminate(self):
            import pandas as pd

            bars = pd.DataFrame(self.rows, columns=["symbol", "i", "open", "high", "low", "close"])
            for r in fn(bars, self.params).itertuples(index=False):
                yield bars["symbol"].iloc[0], int(r.i), r.direction, float(r.entry), float(r.stop), float(r.target)

    return udtf(Signals)


def breakout_frame(bars, params):
    """``false_breakout`` of one symbol as a plug-in: a function of a pandas frame in order of ``i`` and parameters."""
    import numpy as np

    n, width, confirm, rr = int(params.get("lookback", 30)), float(params.get("min_width", 0.05)), int(params.get("confirm", 3)), float(params.get("min_rr", 2.0))
    low, high, close = (bars[c].to_numpy() for c in ("low", "high", "close"))
    support, resistance = bars["low"].shift(1).rolling(n).min().to_numpy(), bars["high"].shift(1).rolling(n).max().to_numpy()
    out = []
    for k in np.flatnonzero(((close < support) | (close > resistance)) & ((resistance - support) / ((resistance + support) / 2) >= width)):
        up = close[k] < support[k]
        j = next((j for j in range(k + 1, k + confirm + 1) if k + confirm < len(close) and (close[j] > support[k] if up else close[j] < resistance[k])), None)
        if j is None:
            continue
        e, stop, target = close[j], (low[k : j + 1].min() if up else high[k : j + 1].max()), (resistance[k] if up else support[k])
        if (stop < e < target if up else target < e < stop) and min(e, stop, target) > 0 and abs(target - e) >= rr * abs(e - stop):
            out.append((bars["i"].iloc[k] + j - k, "long" if up else "short", e, stop, target))
    import pandas as pd

    return pd.DataFrame(out, columns=["i", "direction", "entry", "stop", "target"])


def parameter_errors(schema: dict[str, dict], ordered: list[tuple[str, str]] = (), column: str = "params"):
    """The errors of a map of strings, as an array: ``<name>: missing``, ``unknown``, ``type``, ``choice``, ``range`` or
    ``<a> >= <b>``; see ``validate_configs``."""
    value = lambda k: F.try_element_at(column, F.lit(k))
    unknown = F.transform(F.array_except(F.map_keys(column), F.array(*[F.lit(k) for k in schema])), lambda k: F.concat(k, F.lit(": unknown")))
    tests = []
    for k, rule in schema.items():
        v = value(k)
        kind = rule.get("type", "string")
        typed = v if kind == "string" else v.try_cast(kind)
        test = F.when(v.isNull(), F.lit(None) if rule.get("optional") else F.lit(f"{k}: missing")).when(typed.isNull(), f"{k}: type")
        if "choices" in rule:
            test = test.when(~v.isin([str(c) for c in rule["choices"]]), f"{k}: choice")
        if "low" in rule:
            test = test.when(typed < rule["low"], f"{k}: range")
        if "high" in rule:
            test = test.when(typed > rule["high"], f"{k}: range")
        tests.append(test)
    tests += [F.when(value(a).try_cast("double") >= value(b).try_cast("double"), f"{a} >= {b}") for a, b in ordered]
    return F.concat(F.array_compact(F.array(*tests)), F.array_sort(unknown))


def validate_configs(configs: DataFrame, schema: dict[str, dict], ordered: list[tuple[str, str]] = (), column: str = "params") -> DataFrame:
    """``configs`` with ``errors``, from a map of strings in ``column``: ``<name>: missing``, ``unknown``, ``type``, ``choice``,
    ``range`` or ``<a> >= <b>``.

    ``schema`` names each parameter's ``type`` (int, double, boolean or string), and maybe ``choices``, ``low`` and
    ``high``; a parameter with ``optional`` may be missing. ``ordered`` lists pairs of which the first must be the lesser.
    """
    return configs.withColumn("errors", parameter_errors(schema, ordered, column))
