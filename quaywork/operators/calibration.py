"""Probability calibration of resolved markets, and the studies built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .asof import asof_with_fallback, restrict_to


def resolved(markets: DataFrame, min_volume: int = 10) -> DataFrame:
    return markets.where(F.col("result").isin("yes", "no") & (F.col("volume") >= min_volume) & (F.col("closed") > F.col("opened")))


def pit_prices(trades: DataFrame, markets: DataFrame, min_volume: int = 10, max_offset: float = 0.25, fallback: str = "none") -> DataFrame:
    """Markets with the price of the last trade at or before their mid-life, if that is near enough to it."""
    m = resolved(markets, min_volume).withColumn("mid", S.midlife("opened", "closed"))
    t = restrict_to(trades, m, ["ticker"]).select("ticker", F.col("t").alias("trade_t"), "yes_price", "trade_id")
    j = asof_with_fallback(m, t, ["ticker"], "mid", "trade_t", fallback, "trade_id")
    offset = S.time_offset_frac("trade_t", "mid", "opened", "closed")
    return j.withColumns({"offset_frac": offset, "cents": S.price_to_cents("yes_price"), "category": S.categorize("event_ticker")}).where(offset <= max_offset)


def calibration_bins(pit: DataFrame, lo: int = 1, hi: int = 99, min_n: int = 10) -> DataFrame:
    """5-cent bins over all markets and by category, in one pass of grouping sets: counts, rates, interval, edge, side."""
    p = pit.where(F.col("cents").between(lo, hi)).withColumn("bin_low", S.price_bin_5c("cents"))
    g = p.select("category", "bin_low", F.when(F.col("result") == "yes", 1).otherwise(0).alias("y"), "volume").groupingSets([[F.col("category"), F.col("bin_low")], [F.col("bin_low")]], "category", "bin_low").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("yes_count"), F.sum("volume").cast("long").alias("sum_volume"))
    return summarize_bins(g.withColumn("scope", F.coalesce("category", F.lit("aggregate"))), min_n)


def summarize_bins(g: DataFrame, min_n: int) -> DataFrame:
    implied, actual = (F.col("bin_low") + 2.5) / 100, F.col("yes_count") / F.col("n")
    ci = S.wilson_ci("yes_count", "n")
    return g.select(
        "scope", "bin_low", (F.col("bin_low") + 5).alias("bin_high"), "n", "yes_count", (F.col("sum_volume") / F.col("n")).alias("avg_volume"), actual.alias("actual_rate"),
        ci["low"].alias("ci_low"), ci["high"].alias("ci_high"), S.fee_adjusted_edge(implied, actual).alias("fee_adj_edge"), S.bin_tradeable("n", implied, actual, min_n).alias("side"),
    )


def train_curves(pit: DataFrame, cutoff: int, min_n: int = 10) -> DataFrame:
    """The bins of markets that closed before ``cutoff``; none is left out for its size."""
    return calibration_bins(pit.where(F.col("closed") < cutoff), min_n=min_n)


def calibration_accuracy(traded: DataFrame, curves: DataFrame) -> DataFrame:
    """By bin of traded rows: n, their share of yes, the curves' aggregate rate, and the gap between the two in points."""
    g = traded.groupBy("bin_low").agg(F.count("*").alias("n"), F.avg(F.when(F.col("result") == "yes", 1.0).otherwise(0.0)).alias("rate"))
    agg = curves.where("scope = 'aggregate'").select("bin_low", F.col("actual_rate").alias("predicted"))
    return g.join(agg, "bin_low", "left").withColumn("gap_pp", (F.col("rate") - F.col("predicted")) * 100)


def scan_candidates(markets: DataFrame, books: DataFrame, curves: DataFrame, min_edge_pp: float = 5.0, categories: list[str] | None = None, on: list[str] = ("ticker",), min_n: int = 1) -> DataFrame:
    """Markets with an order book, each side at the price it can be traded at: those whose bin's side is that side and
    whose edge is enough, the better side where both are."""
    from .book import best_side

    m = markets.withColumn("category", S.categorize("event_ticker"))
    m = m if categories is None else m.where(F.col("category").isin(categories))
    j = m.join(books, list(on)).withColumn("_x", S.executable_prices("yes", "no"))
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(f"_x.{k}").alias("price")) for k in ("sell_yes", "buy_yes")])
    s = j.select(*on, "category", F.explode(sides).alias("s")).select(*on, "category", "s.side", "s.price").where("price > 0 and price < 1").withColumn("cents", S.price_to_cents("price"))
    c = bin_lookup(s, curves, min_n, "live").where((F.col("trade_side") == F.col("side")) & (F.col("edge_pp") >= min_edge_pp))
    return best_side(c.withColumn("edge", F.col("edge_pp")).select(*on, "category", "side", "price", "implied", "actual", "edge"), list(on), ["category", "price", "implied", "actual"])


def time_split(df: DataFrame, time: str, frac: float = 0.7) -> DataFrame:
    """One row, ``cutoff``: the time of row floor(frac * rows) in order of time (that row's number counts from 0).

    Works on the counts of each time, and within them by days, so no window holds all rows.
    """
    counts = df.groupBy(time).agg(F.count("*").alias("c"))
    day = (F.col(time) / 86_400_000_000).cast("long")
    days = counts.groupBy(day.alias("d")).agg(F.sum("c").alias("dc"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    base = days.select("d", F.coalesce(F.sum("dc").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("d").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("d", day).join(base, "d").select(time, (F.col("base") + F.sum("c").over(w)).alias("upto"))
    total = df.agg(F.floor(F.count("*") * F.lit(frac)).alias("at"))
    return ends.join(F.broadcast(total), F.col("upto") > F.col("at")).agg(F.min(time).alias("cutoff"))


def bin_lookup(rows: DataFrame, bins: DataFrame, min_n: int = 50, mode: str = "batch") -> DataFrame:
    """``rows`` (category, cents) with the calibration of their bin: ``implied``, ``actual``, ``edge_pp`` and ``side``.

    ``batch``: a category without such a bin (of ``min_n`` rows) falls through to the aggregate; ``live``: only a
    category without any bins does.
    """
    b = bins.where(F.col("n") >= min_n).select("scope", "bin_low", "actual_rate")
    own = b.select(F.col("scope").alias("category"), "bin_low", F.col("actual_rate").alias("own"))
    agg = b.where("scope = 'aggregate'").select("bin_low", F.col("actual_rate").alias("agg"))
    r = rows.withColumn("bin_low", S.price_bin_5c("cents"))
    j = r.join(own, ["category", "bin_low"], "left").join(agg, "bin_low", "left")
    if mode == "live":
        have = b.select(F.col("scope").alias("category"), F.lit(True).alias("has")).distinct()
        j = j.join(have, "category", "left").withColumn("agg", F.when(F.col("has").isNull(), F.col("agg"))).drop("has")
    mid = (F.col("bin_low") + 2.5) / 100
    actual = F.coalesce("own", "agg")
    return j.withColumns({"implied": mid, "actual": actual, "edge_pp": F.abs(mid - actual) * 100, "trade_side": F.when(actual < mid, "sell_yes").otherwise("buy_yes")}).where(actual.isNotNull()).drop("own", "agg")


def bet_returns(traded: DataFrame) -> DataFrame:
    """Rows with ``ret``, the return on what each bet risks."""
    return traded.withColumn("ret", S.per_bet_return("trade_side", F.col("cents") / 100, "result"))


def sigma_table(returns: DataFrame, min_n: int = 5, pseudo: float = 200.0) -> DataFrame:
    """Returns by (category, side, bin), pooled by (category, side), and over all: n, mean, deviation, and the bins'
    deviation shrunk to the pool's."""
    r = returns.select("category", F.col("trade_side").alias("side"), "bin_low", "ret")
    g = r.groupingSets([[F.col("category"), F.col("side"), F.col("bin_low")], [F.col("category"), F.col("side")], []], "category", "side", "bin_low").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sigma"))
    level = F.when(F.col("bin_low").isNotNull(), "bin").when(F.col("category").isNotNull(), "pool").otherwise("aggregate")
    g = g.withColumn("level", level).where((level != "bin") | (F.col("n") >= min_n))
    pool = g.where("level = 'pool'").select("category", "side", F.col("sigma").alias("pool_sigma"))
    j = g.join(pool, ["category", "side"], "left")
    shrunk = F.sqrt((F.col("n") * F.pow("sigma", F.lit(2)) + pseudo * F.pow("pool_sigma", F.lit(2))) / (F.col("n") + pseudo))
    return j.withColumn("shrunk", F.when(F.col("level") == "bin", shrunk).otherwise(F.col("sigma"))).drop("pool_sigma")


def sigma_lookup(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (category, side, bin_low) with ``sigma`` of their bin, else their pool, else all; and which ``level``."""
    t = table.select("level", "category", "side", "bin_low", "shrunk").where("shrunk is not null")
    a = t.where("level = 'bin'").select("category", "side", "bin_low", F.col("shrunk").alias("s1"))
    b = t.where("level = 'pool'").select("category", "side", F.col("shrunk").alias("s2"))
    c = t.where("level = 'aggregate'").select(F.col("shrunk").alias("s3"))
    j = rows.join(a, ["category", "side", "bin_low"], "left").join(b, ["category", "side"], "left").join(F.broadcast(c), F.lit(True), "left")
    return j.withColumns({"sigma": F.coalesce("s1", "s2", "s3"), "sigma_level": F.when(F.col("s1").isNotNull(), "bin").when(F.col("s2").isNotNull(), "pool").when(F.col("s3").isNotNull(), "aggregate")}).drop("s1", "s2", "s3")


def return_strata(returns: DataFrame, min_bin_n: int = 10) -> DataFrame:
    """n, win rate, mean, deviation and Sharpe ratio of returns over all, by side, category, and side and bin."""
    r = returns.select("category", F.col("trade_side").alias("side"), "bin_low", "ret")
    sets = [[], [F.col("side")], [F.col("category")], [F.col("side"), F.col("bin_low")]]
    g = r.groupingSets(sets, "category", "side", "bin_low").agg(F.count("*").alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sigma"))
    g = g.where(F.col("bin_low").isNull() | (F.col("n") >= min_bin_n))
    sharpe = F.col("mean") / F.nullif("sigma", F.lit(0.0))
    return g.withColumn("sharpe", sharpe).withColumns({f"n_{int(c * 100)}": S.n_for_confidence("sharpe", z) for c, z in ((0.9, 1.2816), (0.95, 1.6449), (0.99, 2.3263))})


def flat_backtest(traded: DataFrame, nav: float = 10_000.0, min_edge_pp: float = 2.0) -> DataFrame:
    """By day of close: trades, profit, and the value of a book that bets on its initial value, with its drawdown."""
    risk = S.kelly_risk("trade_side", "cents", "edge_pp", F.lit(nav))
    won = S.per_bet_return("trade_side", F.col("cents") / 100, "result")
    d = traded.where(F.col("edge_pp") >= min_edge_pp).select((F.col("closed") / 86_400_000_000).cast("long").alias("day"), (risk * won).alias("pnl"))
    g = d.groupBy("day").agg(F.count("*").alias("trades"), F.sum("pnl").alias("pnl"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    v = g.withColumn("nav", F.lit(nav) + F.sum("pnl").over(w))
    peak = F.greatest(F.lit(nav), F.max("nav").over(w))
    return v.withColumn("drawdown", (peak - F.col("nav")) / peak)


def category_results(traded: DataFrame) -> DataFrame:
    r = bet_returns(traded)
    return r.groupBy("category", "trade_side").agg(F.count("*").alias("trades"), F.sum("ret").alias("total"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("edge_pp").alias("mean_edge"))


def checks(summary: DataFrame, criteria: dict[str, tuple[str, float]]) -> DataFrame:
    """One row of figures as (name, value, passed) rows, by criteria such as ``{"sharpe": (">", 1.0)}``."""
    tests = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v}
    rows = [F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value"), F.coalesce(tests[op](F.col(k), F.lit(v)), F.lit(False)).alias("passed")) for k, (op, v) in criteria.items()]
    return summary.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
