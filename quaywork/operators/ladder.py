"""Strike ladders: normalisation, divergence between two distributions, regressions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.paths import kept
from .selection import exact_quantiles


def normalize_ladder(l: DataFrame, value: str = "mass") -> DataFrame:  # noqa: E741
    """Shares of each (event, t) over its strikes, null where they sum to nothing; strikes there, and completeness."""
    snap, event = Window.partitionBy("event", "t"), Window.partitionBy("event")
    total = F.sum(value).over(snap)
    d = l.withColumns({"p": F.when(total > 0, F.col(value) / total), "strikes": F.count("*").over(snap)})
    return d.withColumn("completeness", F.col("strikes") / F.max("strikes").over(event))


def events_by_count(l: DataFrame, lo: int, hi: int | None = None) -> DataFrame:
    g = l.groupBy("event").agg(F.sum("n").alias("trades"))
    return g.where(F.col("trades") >= lo) if hi is None else g.where((F.col("trades") >= lo) & (F.col("trades") < hi))


def snapshot_metrics(panel: DataFrame) -> DataFrame:
    """By (event, t) of a panel with p and q: largest and mean gap, divergence, and buckets."""
    gap = S.abs_gap("p", "q")
    return panel.groupBy("event", "t").agg(F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.sum(S.kl_term("p", "q")).alias("kl"), F.count("*").alias("buckets"))


def ols(df: DataFrame, x: str, y: str, by: list[str] = (), min_n: int = 30) -> DataFrame:
    """Least squares of ``y`` on ``x`` by group in one pass: n, slope, intercept, t of the slope, R²; null under ``min_n``."""
    g = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    ok = F.col("n") >= min_n
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.pow("b", F.lit(2)) * F.col("sxx"))
    t = F.col("b") / F.nullif(F.sqrt(rss / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif("sxx", F.lit(0.0))), F.lit(0.0))
    return g.select(*by, "n", F.when(ok, F.col("b")).alias("slope"), F.when(ok, F.col("a")).alias("intercept"), F.when(ok, t).alias("t_stat"), F.when(ok, F.col("r2")).alias("r2"))


def fold_stats(snap: DataFrame, fold: str, horizon: int, tau: float = 0.03) -> DataFrame:
    """By fold: n, share of gaps over ``tau``, their median and 90th percentile, mean divergence, and mean reversion of
    the gap to its value one ``horizon`` later."""
    from .asof import shifted_self_join

    later = shifted_self_join(snap.select("event", "t", "max_gap"), ["event"], "t", "max_gap", horizon).select("event", "t", (F.col("later") - F.col("max_gap")).alias("change"))
    j = kept(snap.join(later, ["event", "t"]).select(fold, "max_gap", "kl", "change"))
    g = j.groupBy(fold).agg(F.count("*").alias("n"), F.avg(F.when(F.col("max_gap") > tau, 1.0).otherwise(0.0)).alias("over"), F.avg("kl").alias("mean_kl"), F.count("change").alias("pairs"), F.regr_slope("change", "max_gap").alias("beta"))
    g = g.join(exact_quantiles(j, [fold], "max_gap", {"median": 0.5, "p90": 0.9}), fold, "left")
    return g.withColumn("half_life", S.half_life("beta"))


def signed_gap_table(panel: DataFrame, position: str) -> DataFrame:
    """By relative position: n, mean signed gap, deviation, median and t."""
    d = kept(panel.select(F.col(position).alias("position"), (F.col("p") - F.col("q")).alias("gap")))
    g = d.groupBy("position").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.stddev_samp("gap").alias("sigma")).join(exact_quantiles(d, ["position"], "gap", {"median": 0.5}), "position", "left")
    return g.withColumn("t_stat", F.col("mean") / F.nullif(F.col("sigma") / F.sqrt("n"), F.lit(0.0)))


def gap_by_decile(snap: DataFrame, span: DataFrame) -> DataFrame:
    """By decile of each event's life: mean and median gap, mean divergence."""
    j = kept(snap.join(span, "event").select("max_gap", "kl", S.life_decile(S.life_fraction("t", "opened", "closed")).alias("decile")))
    g = j.groupBy("decile").agg(F.count("*").alias("n"), F.avg("max_gap").alias("mean_gap"), F.avg("kl").alias("mean_kl"))
    return g.join(exact_quantiles(j, ["decile"], "max_gap", {"median_gap": 0.5}), "decile", "left")


def implied_mean(l: DataFrame, value: str = "p") -> DataFrame:
    """Expected strike of each (event, t) from chances of exceeding strikes: capped to fall, differenced to masses at
    the middles between strikes, the tails half a step out. Null with fewer than two strikes."""
    w = Window.partitionBy("event", "t").orderBy("strike")
    d = l.withColumn("above", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumns({"next_strike": F.lead("strike").over(w), "next_above": F.lead("above").over(w), "first": F.row_number().over(w) == 1})
    step = F.median(F.col("next_strike") - F.col("strike"))
    g = d.groupBy("event", "t").agg(
        F.count("*").alias("strikes"), step.alias("step"), F.sum((F.col("above") - F.col("next_above")) * (F.col("strike") + F.col("next_strike")) / 2).alias("inner"),
        F.max(F.when(F.col("first"), F.struct("strike", "above"))).alias("lo"), F.max(F.when(F.col("next_strike").isNull(), F.struct("strike", "above"))).alias("hi"),
    )
    mean = F.col("inner") + (1 - F.col("lo.above")) * (F.col("lo.strike") - F.col("step") / 2) + F.col("hi.above") * (F.col("hi.strike") + F.col("step") / 2)
    return g.select("event", "t", "strikes", F.when(F.col("strikes") >= 2, mean).alias("implied_mean"))


def event_study(snap: DataFrame, x: str, y: str, min_n: int = 30) -> DataFrame:
    """Regressions over all, by event, and over all with ``y`` dealt anew among the rows; ``label`` names each."""
    from .asof import null_shuffle

    each = ols(snap, x, y, ["event"], min_n).withColumnRenamed("event", "label")
    whole = ols(snap.withColumn("label", F.lit("all")), x, y, ["label"], min_n)
    dealt = null_shuffle(snap.select("event", "t", x, y), ["t", "event"], F.md5(F.concat_ws("|", "event", F.col("t").cast("string"))), [y])
    return each.unionByName(whole).unionByName(ols(dealt.withColumn("label", F.lit("shuffled")), x, y, ["label"], min_n))


def _first_at_least(values, test, most: int = 32):
    """The number of leading ``values`` (sorted) before the first for which ``test`` holds, by halving."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = test(F.get(values, mid))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(up, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(up, mid).otherwise(s["hi"]).alias("hi")))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + F.lit(1))).cast("int"))
    return F.aggregate(steps, start, half, lambda s: s["lo"])


def empirical_bucket_prob(panel: DataFrame, bars: DataFrame, lookback_us: int = 30 * 86_400_000_000, horizon: int = 25, min_n: int = 30, no_lookahead: bool = False) -> DataFrame:
    """``panel`` (event, t, symbol, spot, lo, hi) with ``q``: the share of the symbol's returns over ``horizon`` bars, those
    that begin in the ``lookback_us`` before t, that take the spot into the bucket; snapshots with fewer than ``min_n``
    returns are left out, and shares are scaled to 1 over a snapshot's buckets (null where none is hit). Equal rows of
    ``panel`` are one bucket.

    Returns that begin just before t end after it; ``no_lookahead`` takes only those that have ended by then. A symbol's
    returns lie in sorted blocks by day. A bucket meets the blocks of its days one by one: of a day that lies within its
    time whole, two ranks are found by halving; the few days at the edges are filtered; counts are summed over days. No
    row holds more than a day's returns.
    """
    day = 86_400_000_000
    w = Window.partitionBy("symbol").orderBy("i")
    end = F.lead("t", horizon).over(w)
    r = bars.select("symbol", "t", end.alias("z"), (F.lead("close", horizon).over(w) / F.col("close") - 1).alias("r")).where("r is not null")
    days = r.groupBy("symbol", F.floor(F.col("t") / day).alias("d")).agg(
        F.sort_array(F.collect_list(F.struct("r", F.col("t").alias("rt"), "z"))).alias("_rs"), F.min("t").alias("_from"), F.max("t").alias("_upto"), F.max("z").alias("_ended"))
    days = days.withColumn("_sorted", F.transform("_rs", lambda x: x["r"]))
    buckets = panel.select(F.struct(*panel.columns).alias("_b"), "t", "symbol", "spot", "lo", "hi").distinct()
    spread = buckets.withColumn("d", F.explode(F.sequence(F.floor((F.col("t") - lookback_us) / day), F.floor(F.col("t") / day)))).join(days, ["symbol", "d"])
    whole = (F.col("_from") >= F.col("t") - lookback_us) & (F.col("_upto") < F.col("t")) & (F.col("spot") >= 0) & ((F.col("_ended") <= F.col("t")) if no_lookahead else F.lit(True))
    inside = lambda x: (x["rt"] >= F.col("t") - lookback_us) & (x["rt"] < F.col("t")) & ((x["z"] <= F.col("t")) if no_lookahead else F.lit(True))
    price = lambda x: F.col("spot") * (1 + x)
    hits = lambda xs: F.size(F.filter(xs, lambda x: (price(x["r"]) >= F.col("lo")) & (price(x["r"]) < F.col("hi"))))
    ranks = F.greatest(F.lit(0), _first_at_least(F.col("_sorted"), lambda x: price(x) >= F.col("hi")) - _first_at_least(F.col("_sorted"), lambda x: price(x) >= F.col("lo")))
    own = F.filter("_rs", inside)
    d = spread.select("_b", F.when(whole, F.size("_sorted")).otherwise(F.size(own)).alias("_n"), F.when(whole, ranks).otherwise(hits(own)).alias("_hits"))
    j = d.groupBy("_b").agg(F.sum("_n").alias("samples"), F.sum("_hits").alias("_hits")).where(F.col("samples") >= min_n)
    j = j.select("_b.*", "samples", (F.col("_hits") / F.col("samples")).alias("_q"))
    total = F.sum("_q").over(Window.partitionBy("event", "t"))
    return j.withColumn("q", F.col("_q") / F.nullif(total, F.lit(0.0))).drop("_q")


def universe_compare(panel: DataFrame, l: DataFrame, bands: dict[str, tuple[int, int | None]], horizon: int, base: str) -> DataFrame:  # noqa: E741
    """The gaps of events in bands of trade count: snapshots, median gap, its ratio to band ``base``'s, 90th percentile, and the
    gap's reversion over ``horizon``."""
    from .asof import restrict_to

    parts = [restrict_to(panel, events_by_count(l, lo, hi), ["event"]).withColumn("band", F.lit(name)) for name, (lo, hi) in bands.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    snaps = both.groupBy("band", "event", "t").agg(F.max(S.abs_gap("p", "q")).alias("max_gap"))
    later = snaps.select("band", "event", (F.col("t") - horizon).alias("t"), F.col("max_gap").alias("later"))
    j = kept(snaps.join(later, ["band", "event", "t"], "left").select("band", "max_gap", (F.col("later") - F.col("max_gap")).alias("change")))
    g = j.groupBy("band").agg(F.count("*").alias("n"), F.regr_slope("change", "max_gap").alias("beta")).join(exact_quantiles(j, ["band"], "max_gap", {"median": 0.5, "p90": 0.9}), "band", "left")
    first = g.where(F.col("band") == base).select(F.col("median").alias("_m"))  # one row
    return g.join(F.broadcast(first), F.lit(True), "left").withColumn("ratio", F.col("median") / F.nullif("_m", F.lit(0.0))).drop("_m")
