"""Queries of streams: each writes rows of the tables as a source, runs its stream over them with ``availableNow``, and
reads what the stream has written. Their twins are the batch forms."""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import book as K
from ..operators import calibration as C
from ..operators import outcomes as O
from ..sources.adapters import PREFIXES, with_relations
from ..sources.paths import kept, new_path
from ..streaming import streams
from .more import _BOOKS, _books
from .registry import _HELD, _SLOTS, DAY, HOUR, ORACLE_SQL, _held, _slots, query
from .tables import _CANDIDATES
from .trading import _SIG, _labels, _sig, breakout_sql, chain

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(df: DataFrame, parts: list | None = None) -> DataFrame:
    """``df`` written to a folder and read as a stream; with ``parts`` (conditions) their rows come one after the other."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "source")
    for p in parts or [None]:
        (df if p is None else df.where(p).coalesce(1)).write.mode("append").parquet(path)
    reader = spark.readStream.schema(df.schema)
    return (reader.option("maxFilesPerTrigger", 1) if parts else reader).parquet(path)


@contextmanager
def _rocks(spark: SparkSession):
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        yield
    finally:
        spark.conf.set(ROCKS[0], before)


def emitted(stream: DataFrame) -> DataFrame:
    """What a stream gives, from the folder that it is written to."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, "emitted"), new_path(spark, "checkpoint")
    with _rocks(spark):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def finished(start) -> None:
    """Runs a stream that writes for itself, to its end."""
    start.awaitTermination()


def _ts(t: DataFrame) -> DataFrame:
    return t.withColumn("ts", F.timestamp_micros("t"))


def _mark(df: DataFrame, ts: int, **values) -> DataFrame:
    """``df`` with one more row, of a time that lets the watermark pass all others."""
    one = df.sparkSession.range(1).select(*[F.timestamp_micros(F.lit(ts)).alias(c) if c == "ts" else F.lit(values.get(c)).cast(k).alias(c) for c, k in df.dtypes])
    return df.unionByName(one)


# --- ingest ---------------------------------------------------------------------------------------------------------


def _j01(t: DataFrame) -> DataFrame:
    rows = t.select("trade_id", "ticker", "n", F.timestamp_micros("t").alias("created_time"))
    root = new_path(t.sparkSession, "trades")
    finished(streams.stream_trades(source(rows.union(rows.where("trade_id % 3 = 0"))), root, new_path(t.sparkSession, "checkpoint")))
    return t.sparkSession.read.parquet(root).select("trade_id", "ticker", "n")


query("j01_stream_trades", "SELECT trade_id, ticker, n FROM trades", ("trades",))(_j01)


def _j02(t: DataFrame) -> DataFrame:
    side = lambda c: F.transform(c, lambda x: F.struct(x["price"].cast("string").alias("px"), x["size"].cast("string").alias("sz")))
    books = _books(t).select("user_id", "slot", F.timestamp_micros(F.lit(1704067200000000) + F.col("slot") * 10 * DAY).alias("ts"), F.array(side("yes"), F.array(F.struct(F.lit("1").alias("px"), F.lit("1").alias("sz")))).alias("levels"))
    root = new_path(t.sparkSession, "l2")
    finished(streams.stream_l2(source(books), root, new_path(t.sparkSession, "checkpoint"), 3))
    return t.sparkSession.read.parquet(root).select("user_id", "slot", "bid_px_0", "bid_px_1", "mid", "spread")


query("j02_stream_l2", f"SELECT user_id, slot, y[1] AS bid_px_0, y[2] AS bid_px_1, (y[1] + 1) / 2 AS mid, 1 - y[1] AS spread FROM {_BOOKS} b", ("trades",))(_j02)


def _j03(t: DataFrame) -> DataFrame:
    ticks = _ts(t).select(F.col("trade_id").alias("id"), F.col("ticker").alias("symbol"), "ts", F.col("yes_price").alias("price"), F.col("n").alias("size"))
    last = t.agg(F.max("t")).first()[0]
    bars = emitted(streams.stream_bars(source(_mark(ticks, last + 2 * DAY, symbol="~")), "6 hours"))
    return bars.where("symbol <> '~'").withColumn("start", F.unix_micros("start"))


query("j03_stream_bars", f"SELECT ticker AS symbol, t // {6 * HOUR} * {6 * HOUR} AS start, arg_min(yes_price, (t, trade_id)) AS open, max(yes_price) AS high, min(yes_price) AS low, arg_max(yes_price, (t, trade_id)) AS close, CAST(sum(n) AS BIGINT) AS volume, count(*) AS trades FROM trades GROUP BY 1, 2", ("trades",))(_j03)


def _j04(t: DataFrame, m: DataFrame) -> DataFrame:
    spark, markets = t.sparkSession, kept(m)
    curves = kept(C.calibration_bins(C.pit_prices(t, markets)))
    root = new_path(spark, "candidates")
    finished(streams.stream_candidates(source(_books(t)), markets, curves, root, new_path(spark, "checkpoint"), on=["user_id", "slot"]))
    return spark.read.parquet(root).join(markets.select("user_id", "slot", "ticker"), ["user_id", "slot"]).select("ticker", "slot", "side", "edge")


query("j04_stream_candidates", None, ("trades", "markets"))(_j04)
ORACLE_SQL["j04_stream_candidates"] = with_relations("", "trades", "markets").rstrip() + _CANDIDATES

# --- positions ------------------------------------------------------------------------------------------------------


def _j05(b: DataFrame) -> DataFrame:
    """Every bar opens a position; it leaves at the stop or target, or at its series' end."""
    b = kept(b)
    last = b.agg(F.max("t")).first()[0]
    bars = _ts(b).select("symbol", "ts", "high", "low", "close")
    positions = _sig(b).join(b.select("symbol", "i", "t"), ["symbol", "i"]).select(F.col("i").alias("id"), "symbol", F.timestamp_micros("t").alias("ts"), "direction", "stop", "target")
    ends = _mark(b.select("symbol").distinct().withColumn("ts", F.timestamp_micros(F.lit(last + DAY))), last + 2 * DAY, symbol="~")
    out = emitted(streams.stream_barriers(source(bars), source(positions), source(ends)))
    return out.withColumn("ts", F.unix_micros("ts"))


_EXITS = "SELECT l.i AS id, l.symbol, b.t AS ts, l.exit_price AS price, l.reason FROM lab l JOIN bars b ON b.symbol = l.symbol AND b.i = l.exit_i"


query("j05_stream_barriers", None, ("bars",))(_j05)
ORACLE_SQL["j05_stream_barriers"] = chain(("bars",), [_SIG, *_labels("lab", "sig")], _EXITS)


def _j06(p: DataFrame, m: DataFrame) -> DataFrame:
    """Markets that first end one way, and an hour later the other way; the last revision of each position."""
    markets = _slots(m)
    update = lambda d, us, result: d.select("ticker", F.timestamp_micros(us).alias("ts"), "status", result.alias("result"))
    early = update(markets.where("user_id % 4 = 0"), F.col("closed") - HOUR, F.when(F.col("user_id") % 8 == 0, "").when(F.col("result") == "yes", "no").otherwise("yes"))
    updates = early.union(update(markets, F.col("closed"), F.col("result")))
    positions = _held(p).where("status = 'open'").select("id", "ticker", F.timestamp_micros("entered").alias("entered_at"), "side", "reward_cents", "risk_cents")
    seen = F.timestamp_micros(F.lit(1704067200000000)).alias("seen_at")
    out = emitted(streams.stream_settle(source(updates.select("*", seen)), source(positions.select("*", seen))))
    return out.groupBy("id", "ticker").agg(F.max_by(F.struct("state", "pnl"), "revision").alias("_x")).select("id", "ticker", "_x.state", "_x.pnl")


query("j06_stream_settle", f"""SELECT p.id, p.ticker, 'resolved' AS state, CAST(CASE WHEN (p.side = 'sell_yes' AND m.result = 'no') OR (p.side = 'buy_yes' AND m.result = 'yes') THEN reward_cents ELSE -risk_cents END AS BIGINT) AS pnl
 FROM (SELECT * REPLACE ({_HELD} AS ticker) FROM positions WHERE status = 'open') p JOIN {_SLOTS} m ON p.ticker = m.ticker WHERE m.status = 'settled'""", ("positions", "markets"))(_j06)


def _j07(p: DataFrame, t: DataFrame) -> DataFrame:
    root = new_path(t.sparkSession, "quotes")
    finished(streams.stream_quote_snapshots(source(t), root, new_path(t.sparkSession, "checkpoint")))
    held = p.withColumns({"ticker": F.concat(F.lit("T"), (F.col("id") % 150).cast("string")), "closes": F.lit(1704067200000000) + F.col("id") % 700 * HOUR})
    return A.snapshot_closing_lines(held, t.sparkSession.read.parquet(root), S.mid_from_quote("no_price", "yes_price", "yes_price"), "trade_id").select("id", "line")


query("j07_stream_quotes", None, ("positions", "trades"))(_j07)
ORACLE_SQL["j07_stream_quotes"] = ORACLE_SQL["c15_snapshot_closing_line"]


def _j08(t: DataFrame) -> DataFrame:
    last = t.agg(F.max("t")).first()[0]
    rows = _ts(t).select("ticker", "ts", "trade_id")
    return emitted(streams.stream_shadow(source(_mark(rows, last + 5 * DAY, ticker="~")))).where("ticker <> '~'").select("ticker", F.unix_date("reject_date").alias("day"), "trade_id")


query("j08_stream_shadow", f"SELECT ticker, CAST(t // {DAY} AS INTEGER) AS day, arg_min(trade_id, (t, trade_id)) AS trade_id FROM trades GROUP BY 1, 2", ("trades",))(_j08)


def _j09(t: DataFrame) -> DataFrame:
    """Tickers of which some never trade, a day after the last trade."""
    t = kept(t)
    first, last = t.agg(F.min("t"), F.max("t")).first()
    universe = t.select(F.col("ticker").alias("symbol")).distinct().withColumn("since", F.timestamp_micros(F.lit(first)))
    seen = _ts(t).where("user_id % 7 <> 0").select(F.col("ticker").alias("symbol"), "ts")
    said = emitted(streams.stream_freshness(source(_mark(seen, last + DAY + HOUR, symbol="~")), universe, 30 * HOUR, 2 * DAY))
    latest = said.groupBy("symbol").agg(F.max_by(F.struct("state", "last_ts"), F.struct("at", "state")).alias("_x"))
    return universe.join(latest, "symbol", "left").select("symbol", F.coalesce("_x.state", F.lit("fresh")).alias("state"))


query("j09_stream_freshness", f"""SELECT symbol, CASE WHEN l IS NULL THEN 'stale' WHEN now - l > {2 * DAY} THEN 'very_stale' WHEN now - l > {30 * HOUR} THEN 'stale' ELSE 'fresh' END AS state
 FROM (SELECT ticker AS symbol, max(CASE WHEN user_id % 7 <> 0 THEN t END) AS l, (SELECT max(t) + {DAY} FROM trades) AS now FROM trades GROUP BY ticker) x""", ("trades",))(_j09)


def _j10(p: DataFrame) -> DataFrame:
    """Each day's snapshot of a book comes twice, first with what is wrong at noon."""
    days = kept(K.daily_snapshots(p, 1_000_000))
    at = lambda h: F.timestamp_micros(F.col("day") * DAY + h * HOUR)
    noon = days.select(F.lit("book").alias("book"), at(12).alias("ts"), "day", (F.col("nav") - 7).alias("nav"), "open")
    events = noon.unionByName(days.select(F.lit("book").alias("book"), at(23).alias("ts"), "day", "nav", "open"))
    root = new_path(p.sparkSession, "daily")
    finished(streams.stream_daily_snapshot(source(events), root, new_path(p.sparkSession, "checkpoint")))
    return p.sparkSession.read.parquet(root).select("day", "nav", "open")


query("j10_stream_daily", None, ("positions",))(_j10)
ORACLE_SQL["j10_stream_daily"] = "SELECT day, nav, open FROM (" + ORACLE_SQL["d11_daily_snapshots"] + ") d"


# --- plug-ins, SQL text and scalars over any numbers ------------------------------------------------------------------


def _k01(b: DataFrame) -> DataFrame:
    """A template registered as a table function, and called from SQL."""
    spark = b.sparkSession
    spark.udtf.register("breakout_signals", O.template_table_function(O.breakout_frame))
    return spark.sql("SELECT * FROM breakout_signals(TABLE({bars}), MAP('lookback', '30'))", bars=b)


query("k01_template_function", breakout_sql(), ("bars",))(_k01)


def _k03(m: DataFrame) -> DataFrame:
    """The generated CASE as part of a statement of its own."""
    return m.sparkSession.sql(f"SELECT {S.category_sql('event_ticker')} AS category, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM {{m}} GROUP BY 1", m=m)


#: The category of each of the prefixes of ``adapters.PREFIXES``.
_KIND = dict(zip(PREFIXES, ("sports", "sports", "crypto", "crypto", "financial", "financial", "weather", "economics", "economics", "politics", "politics", "other"), strict=True))
_VALUES = ", ".join(f"('{p}', '{c}')" for p, c in _KIND.items())
query("k03_category_sql", f"SELECT c AS category, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM markets JOIN (VALUES {_VALUES}) v(p, c) ON split_part(event_ticker, '-', 1) = p GROUP BY 1", ("markets",))(_k03)
_ERF = ", ".join(f"({k}, CAST('{math.erf((k - 49) / 12)!r}' AS DOUBLE))" for k in range(1, 99))
query("k04_erf", f"SELECT id, v.y AS erf FROM positions JOIN (VALUES {_ERF}) v(k, y) ON v.k = 1 + id % 98", ("positions",))(lambda p: p.select("id", S.erf((F.col("id") % 98 - 48) / 12).alias("erf")))
