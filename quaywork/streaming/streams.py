"""Structured Streaming counterparts: each gives a streaming DataFrame, or writes with its own checkpoint.

Streams with timers (``stream_barriers``, ``stream_freshness``, ``stream_settle``) keep state in RocksDB: a session sets
``spark.sql.streaming.stateStore.providerClass`` to its provider. Their results do not depend on how rows fall into
batches, as long as none comes later than the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import calibration as C
from ..sources import ingest
from . import machines

DAY_US = 86_400_000_000
#: Keys of one hash are one lane of state: what calls to the state store cost does not grow with the keys.
LANES = 4096


def _lane(key: str, lanes: int):
    return F.pmod(F.xxhash64(key), F.lit(lanes)).alias("lane")


def _started(df: DataFrame, each: Callable[[DataFrame, int], object], checkpoint: str):
    return df.writeStream.foreachBatch(lambda b, n: each(b, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_trades(trades: DataFrame, root: str, checkpoint: str, delay: str = "1 hour"):
    """Trades without repeats of an id within ``delay``, merged by batches into a table by day; a batch that runs twice
    changes nothing."""
    once = trades.withWatermark("created_time", delay).dropDuplicatesWithinWatermark(["trade_id"]).withColumn("date", F.to_date("created_time"))
    return _started(once, lambda b, _: ingest.upsert_partitioned(b, root, ["trade_id"], "date"), checkpoint)


def stream_l2(snapshots: DataFrame, root: str, checkpoint: str, levels: int = 10):
    flat = ingest.flatten_l2(snapshots, levels).withColumn("date", F.to_date("ts"))
    return flat.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).partitionBy("date").trigger(availableNow=True).start()


def stream_bars(ticks: DataFrame, step: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Bars of each symbol's windows; ticks later than ``delay`` are left out."""
    w = F.window("ts", step)
    g = ticks.withWatermark("ts", delay).groupBy(w, "symbol").agg(F.min_by("price", F.struct("ts", "id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "id")).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trades"))
    return g.select(F.col("window.start").alias("start"), "symbol", "open", "high", "low", "close", "volume", "trades")


def stream_candidates(books: DataFrame, markets: DataFrame, curves: DataFrame, root: str, checkpoint: str, sigmas: DataFrame | None = None, on: list[str] = ("ticker",), min_edge_pp: float = 5.0, min_n: int = 1):
    """Order books as they come, joined with the static markets, calibration curves and deviations: the better side of each
    book that has enough edge, written by batches.

    A batch is a folder of its own, so one that runs twice replaces what it wrote.
    """

    def scan(b: DataFrame, n: int) -> None:
        found = C.scan_candidates(markets, b, curves, min_edge_pp, on=list(on), min_n=min_n)
        if sigmas is not None:
            found = C.sigma_lookup(found.withColumn("bin_low", S.price_bin_5c(S.price_to_cents("price"))), sigmas)
        found.write.mode("overwrite").parquet(f"{root}/batch={n}")

    return _started(books, scan, checkpoint)


def stream_settle(updates: DataFrame, positions: DataFrame, delay: str = "1 hour", keep_us: int = 30 * DAY_US, lanes: int = LANES) -> DataFrame:
    """(id, ticker, state, pnl, revision) of positions as their markets end, both sides as streams.

    Markets are dealt to ``lanes``; a lane is one key of the state store. Of a market its last final update by time is
    held (``updates``: ticker, ts, status, result) and its positions (``positions``: id, ticker, entered_at, side,
    reward_cents, risk_cents), whichever comes first and however long between. A position that was entered by the time of
    that update is resolved, with its profit, or void; a later update that says otherwise gives a row of the next
    ``revision``. What is settled is kept for such corrections, for ``keep_us`` after the last row of the market; what is
    not is kept as long as it takes. Rows may have a time of arrival, ``seen_at`` (else it is that of the batch): the
    watermark and timers go by it, so old positions and updates are not late.
    """
    seen = lambda d: F.col("seen_at") if "seen_at" in d.columns else F.current_timestamp()
    u = updates.select("ticker", seen(updates).alias("at"), F.unix_micros("ts").alias("us"), F.lit(None).cast("string").alias("id"), S.market_state("status", "result").alias("a"), F.lower("result").alias("b"), F.lit(0).cast("long").alias("reward"), F.lit(0).cast("long").alias("risk")).where("a <> 'open'")
    p = positions.select("ticker", seen(positions).alias("at"), F.unix_micros("entered_at").alias("us"), F.col("id").cast("string").alias("id"), F.col("side").alias("a"), F.lit("").alias("b"), F.col("reward_cents").cast("long").alias("reward"), F.col("risk_cents").cast("long").alias("risk"))
    both = u.unionByName(p).withWatermark("at", delay).select("*", F.unix_micros("at").alias("seen"), _lane("ticker", lanes))
    return both.groupBy("lane").transformWithStateInPandas(machines.Settlement(keep_us), "id long, ticker string, state string, pnl long, revision int", "append", "eventTime")


def stream_quote_snapshots(quotes: DataFrame, root: str, checkpoint: str):
    return quotes.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_shadow(rejections: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first rejection by time of each ticker and day (of equal times that of the least values), once the day is over."""
    own = [c for c in rejections.columns if c != "ticker"]
    first = rejections.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "ticker").agg(F.min(F.struct("ts", *[c for c in own if c != "ts"])).alias("_x"))
    return first.select("ticker", F.to_date("window.start").alias("reject_date"), *[F.col("_x")[c].alias(c) for c in own])


def stream_barriers(bars: DataFrame, positions: DataFrame, ends: DataFrame | None = None, delay: str = "1 hour", expire_us: int | None = None) -> DataFrame:
    """(id, symbol, ts, price, reason): exits of open positions as bars pass; the stop wins ties.

    All are streams: bars (symbol, ts, high, low, close), positions (id, symbol, ts, direction, stop, target) and maybe
    ``ends`` (symbol, ts) of series. A symbol is one key; its rows wait, whatever their order, until the watermark has
    passed them, and a timer then takes them in order of time. A position is held against the bars after its ``ts``; with
    ``expire_us`` it ends so long after it (``expired``, at the last close), and at its series' end as ``end_of_data``.
    State is what waits and what is open, and nothing of a symbol that has ended.
    """
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    parts = [
        bars.select("symbol", "ts", F.lit("b").alias("kind"), *none("long", "id"), *none("boolean", "up"), F.col("high").alias("x"), F.col("low").alias("y"), F.col("close").alias("z")),
        positions.select("symbol", "ts", F.lit("p").alias("kind"), "id", (F.col("direction") == "long").alias("up"), F.col("stop").alias("x"), F.col("target").alias("y"), *none("double", "z")),
    ]
    if ends is not None:
        parts.append(ends.select("symbol", "ts", F.lit("z").alias("kind"), *none("long", "id"), *none("boolean", "up"), *none("double", "x", "y", "z")))
    events = parts[0]
    for p in parts[1:]:
        events = events.unionByName(p)
    timed = events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy("symbol").transformWithStateInPandas(machines.Exits(expire_us), "id long, symbol string, us long, price double, reason string", "append", "eventTime")
    return out.select("id", "symbol", F.timestamp_micros("us").alias("ts"), "price", "reason")


def stream_freshness(bars: DataFrame, universe: DataFrame | None = None, stale_us: int = 8 * 3_600_000_000, very_us: int = 7 * DAY_US, delay: str = "1 hour", lanes: int = LANES) -> DataFrame:
    """(symbol, last_ts, state, at): a row whenever a symbol has been silent for ``stale_us`` (``stale``) and ``very_us``
    (``very_stale``), and when it comes back (``fresh``).

    ``universe`` (symbol, since) is the state that the stream begins with: a symbol that never has a bar is ``stale`` from
    ``since`` on, ``last_ts`` null. Of a symbol its last time is held, and the times that wait for the watermark; symbols
    are dealt to ``lanes``, of which each is one key with one value and one timer.
    """
    first = None if universe is None else universe.select("symbol", F.unix_micros("since").alias("us"), _lane("symbol", lanes)).groupBy("lane")
    timed = bars.select("symbol", "ts").withWatermark("ts", delay).select("symbol", F.unix_micros("ts").alias("us"), "ts", _lane("symbol", lanes))
    out = timed.groupBy("lane").transformWithStateInPandas(machines.Silence(stale_us, very_us), "symbol string, last_us long, state string, at_us long", "append", "eventTime", first)
    return out.select("symbol", F.timestamp_micros("last_us").alias("last_ts"), "state", F.timestamp_micros("at_us").alias("at"))


def stream_daily_snapshot(events: DataFrame, root: str, checkpoint: str):
    """The last snapshot of each day, merged by batches into a table by month."""
    dated = events.withColumns({"date": F.to_date("ts"), "month": F.date_format("ts", "yyyy-MM")})
    return _started(dated, lambda b, _: ingest.upsert_partitioned(b, root, ["date", "book"], "month", "last", "ts"), checkpoint)
