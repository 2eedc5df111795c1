"""Position books: summaries, exposures, daily states, settlement, closing-line value and screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.paths import kept
from .bars import rolling_by, running
from .selection import exact_quantiles

DAY = 86_400_000_000


def _day(c: str) -> Column:
    return F.floor(F.col(c) / DAY).cast("long")


def pnl_cents() -> Column:
    """Profit of a position in whole cents, 0 while open or void."""
    return F.when(F.col("status") == "closed", S.binary_pnl("side", "result", "reward_cents", "risk_cents", F.lit(0))).otherwise(0).cast("long")


def category_breakdown(p: DataFrame) -> DataFrame:
    o, c = F.col("status") == "open", F.col("status") == "closed"
    pnl = pnl_cents()
    return p.groupBy("category").agg(
        F.count_if(o).alias("open"), F.sum(F.when(o, F.col("risk_cents")).otherwise(0)).alias("locked"), F.sum(F.when(o, F.col("reward_cents")).otherwise(0)).alias("upside"), F.avg(F.when(o, F.col("edge_pp"))).alias("avg_edge"),
        F.count_if(c).alias("closed"), F.count_if(c & (pnl > 0)).alias("wins"), F.count_if(c & (pnl <= 0)).alias("losses"), F.sum(pnl).alias("pnl"), F.count_if(F.col("status") == "voided").alias("voided"),
    )


def portfolio_summary(p: DataFrame, initial_cents: int, today: int, by: list[str] = ()) -> DataFrame:
    """Value, cash, locked risk, open count, trades entered today, and realised profit, by ``by``."""
    o = F.col("status") == "open"
    realized, locked = F.sum(pnl_cents()), F.sum(F.when(o, F.col("risk_cents")).otherwise(0))
    return p.groupBy(*by).agg((F.lit(initial_cents) + realized).alias("nav"), (F.lit(initial_cents) + realized - locked).alias("cash"), locked.alias("locked"), F.count_if(o).alias("open"), F.count_if(_day("entered") == today).alias("trades_today"), realized.alias("realized"))


def exposures(p: DataFrame) -> DataFrame:
    """Open risk and positions by event, by side, by series and by ticker, in one pass; ``scope`` names the grouping."""
    o = p.where("status = 'open'")
    sets = [[F.col(c)] for c in ("event_ticker", "side", "series", "ticker")]
    g = o.groupingSets(sets, "event_ticker", "side", "series", "ticker").agg(F.sum("risk_cents").alias("risk"), F.count("*").alias("positions"))
    scope = F.when(F.col("event_ticker").isNotNull(), "event").when(F.col("side").isNotNull(), "side").when(F.col("series").isNotNull(), "series").otherwise("ticker")
    return g.select(scope.alias("scope"), F.coalesce("event_ticker", "side", "series", "ticker").alias("key"), "risk", "positions")


def daily_deltas(p: DataFrame) -> DataFrame:
    entry = p.select(_day("entered").alias("day"), F.lit(1).alias("opened"), F.lit(0).alias("ended"), F.col("risk_cents").alias("locked"), F.lit(0).cast("long").alias("pnl"))
    gone = p.where("status <> 'open'").select(_day("closes").alias("day"), F.lit(0).alias("opened"), F.lit(1).alias("ended"), (-F.col("risk_cents")).alias("locked"), pnl_cents().alias("pnl"))
    return entry.union(gone).groupBy("day").agg(*[F.sum(c).cast("long").alias(c) for c in ("opened", "ended", "locked", "pnl")])


def daily_snapshots(p: DataFrame, initial_cents: int) -> DataFrame:
    """Per day with entries or exits: value, locked risk, open positions, and the day's entries and profit."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    d = daily_deltas(p)
    run = lambda c: F.sum(c).over(w)
    return d.select("day", (F.lit(initial_cents) + run("pnl")).alias("nav"), run("locked").alias("locked"), (run("opened") - run("ended")).alias("open"), F.col("opened").alias("trades"), F.col("pnl").alias("realized"))


def open_interest_curve(p: DataFrame) -> DataFrame:
    """Positions and risk open on each day, from entry to close whatever the status."""
    both = p.select(_day("entered").alias("day"), F.lit(1).alias("n"), F.col("risk_cents").alias("risk")).union(p.select(_day("closes"), F.lit(-1), -F.col("risk_cents")))
    g = both.groupBy("day").agg(F.sum("n").alias("n"), F.sum("risk").alias("risk"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    return g.select("day", F.sum("n").over(w).alias("open"), F.sum("risk").over(w).alias("risk"))


def cum_pnl(p: DataFrame, by: list[str] = ("category",)) -> DataFrame:
    """Running profit of closed positions in order of close time, then id, scanned by the day of the close."""
    closed = p.where("status = 'closed'").select(*by, "id", "closes", pnl_cents().alias("_pnl"))
    return running(closed, {"cum_pnl": ("sum", "_pnl")}, list(by), ["closes", "id"], _day("closes")).drop("_pnl")


def closed_book_summary(p: DataFrame) -> DataFrame:
    x = pnl_cents()
    return p.where("status = 'closed'").agg(F.count("*").alias("closed"), F.count_if(x > 0).alias("wins"), F.count_if(x <= 0).alias("losses"), F.sum(x).alias("pnl"))


def settle(p: DataFrame, markets: DataFrame) -> DataFrame:
    """Open positions with their market's state: resolved with profit, void, still open, or missing."""
    m = markets.select("ticker", F.col("status").alias("m_status"), F.col("result").alias("m_result"))
    j = p.where("status = 'open'").join(m, "ticker", "left")
    state = F.when(F.col("m_status").isNull(), "missing").otherwise(S.market_state("m_status", "m_result"))
    pnl = F.when(state == "resolved", S.binary_pnl("side", "m_result", "reward_cents", "risk_cents", F.lit(0))).otherwise(0).cast("long")
    return j.select("id", "ticker", "category", state.alias("state"), pnl.alias("pnl"))


def daily_topk(c: DataFrame, k: int) -> DataFrame:
    """The ``k`` candidates of most edge of each entry day; ties by ticker, then id."""
    w = Window.partitionBy("day").orderBy(F.desc("edge_pp"), "ticker", "id")
    return c.withColumn("day", _day("entered")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def admission_screen(c: DataFrame, per_day: int, event_cap_cents: int) -> DataFrame:
    """The day's best candidates whose event's risk so far that day, theirs included, is within its cap."""
    w = Window.partitionBy("day", "event_ticker").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return daily_topk(c, per_day).withColumn("event_risk", F.sum("risk_cents").over(w)).where(F.col("event_risk") <= event_cap_cents)


def rolling_quality(c: DataFrame, n: int = 100, by: list[str] = ("category",)) -> DataFrame:
    """Whether a candidate's edge reaches the mean of the ``n`` before it of its group (true for the first).

    A group's rows are numbered by a running count over the days of entry; sums of the rows before come from blocks of
    ``n`` numbers. No window spans a group.
    """
    keys = list(by)
    r = running(c, {"_r": ("sum", F.lit(1))}, keys, ["entered", "id"], _day("entered")).withColumns({"_r": F.col("_r") - 1, "_n": F.lit(n), "_one": F.when(F.col("edge_pp").isNotNull(), 1)})
    r = rolling_by(r, "_n", {"_sum": ("sum", "edge_pp"), "_count": ("sum", "_one")}, keys, "_r", partial=True)
    mean = F.col("_sum") / F.nullif(F.col("_count"), F.lit(0))
    r = r.withColumns({"prior_mean": mean, "admit": F.coalesce(F.col("edge_pp") >= mean, F.lit(True))})
    return r.drop("_r", "_n", "_one", "_sum", "_count")


def top_quantile(df: DataFrame, column: str, q: float = 0.9) -> DataFrame:
    """Rows whose value reaches the exact quantile of all."""
    cut = exact_quantiles(df, [], column, {"_q": q})
    return df.join(F.broadcast(cut), F.col(column) >= F.col("_q")).drop("_q")  # one row


def clv(lines: DataFrame) -> DataFrame:
    gain = S.clv_pp("side", "entry_price", "line")
    return lines.withColumns({"clv": gain, "beat": gain > 0})


def clv_summary(rows: DataFrame) -> DataFrame:
    """Closing-line value over all, by status, side and category: n, mean, exact median, deviation, share that beat it."""
    of = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    scopes = F.array(of("all", F.lit("all")), *[of(c, F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in ("status", "side", "category")])
    d = kept(rows.select("clv", "beat", "status", "side", "category")).select("clv", "beat", F.explode(scopes).alias("_x")).select("clv", "beat", "_x.*")
    g = d.groupBy("scope", "key").agg(F.count("*").alias("n"), F.avg("clv").alias("mean"), F.coalesce(F.stddev_samp("clv"), F.lit(0.0)).alias("sigma"), F.avg(F.when(F.col("beat"), 1.0).otherwise(0.0)).alias("beat_rate"))
    return g.join(exact_quantiles(d, ["scope", "key"], "clv", {"median": 0.5}), ["scope", "key"], "left").select("scope", "key", "n", "mean", "median", "sigma", "beat_rate")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    g = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "value").limit(top) if top else g


def best_side(sides: DataFrame, by: list[str], carry: list[str] = ()) -> DataFrame:
    """The side of the larger edge for each market, with its values of ``carry``; selling on ties."""
    best = F.max_by(F.struct("side", "edge", *carry), F.struct("edge", (F.col("side") == "sell_yes").cast("int")))
    return sides.groupBy(*by).agg(best.alias("x")).select(*by, "x.*")


def shadow_replay(shadow: DataFrame, markets: DataFrame) -> DataFrame:
    """By reason: rejected rows whose market has resolved, and the profit they would have made."""
    m = markets.where(F.col("result").isin("yes", "no")).select("ticker", F.col("result").alias("m_result"))
    j = shadow.join(m, "ticker")
    return j.groupBy("reason").agg(F.count("*").alias("n"), F.sum(S.binary_pnl("side", "m_result", "reward_cents", "risk_cents", F.lit(0))).cast("long").alias("pnl"))


def screen_candidates(c: DataFrame, now: int, lo: float = 0.25, hi: float = 0.55, price_lo: float = 0.1, price_hi: float = 0.9) -> DataFrame:
    """Candidates with ``verdict``: eligible, or the first rule that they fail."""
    frac = S.life_fraction(F.lit(now), "entered", "closes")
    price = F.col("entry_price")
    verdict = F.when(price < price_lo, "price_low").when(price > price_hi, "price_high").otherwise(S.life_gate(frac, lo, hi))
    return c.withColumn("verdict", verdict)


def rank_by_quality(c: DataFrame, cap: int, by: list[str], quality: Column) -> DataFrame:
    """The ``cap`` candidates of most quality of each group; ties by id."""
    w = Window.partitionBy(*by).orderBy(quality.desc(), "id")
    return c.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
