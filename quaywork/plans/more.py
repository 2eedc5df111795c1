"""Further registered queries: ingest on payloads made from the tables, more scalar functions, joins and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import bars as B
from ..operators import book as K
from ..operators import calibration as C
from ..operators import ladder as L
from ..operators import outcomes as O
from ..sources import ingest as I
from ..sources.paths import new_path
from .registry import _PNL, DAY, HOUR, _panel, _slow, query, scalar, traded_query

# --- ingest ---------------------------------------------------------------------------------------------------------

_CENTS = "CAST(round_even(yes_price * 100, 0) AS BIGINT)"


def _raw_trades(t):
    return t.select(F.to_json(F.struct(F.col("trade_id").cast("string").alias("trade_id"), "ticker", F.when(F.col("trade_id") % 2 == 0, F.col("n")).alias("count"), (F.col("n") + 0.2).cast("string").alias("count_fp"), F.rint(F.col("yes_price") * 100).cast("long").cast("string").alias("yes_price"), F.when(F.col("trade_id") % 5 != 0, F.timestamp_micros("t").cast("string")).alias("created_time"))).alias("raw"))


query("a08_normalize_trades", f"SELECT CAST(trade_id AS STRING) AS trade_id, n AS count, CASE WHEN {_CENTS} > 1 THEN {_CENTS} / 100e0 ELSE CAST({_CENTS} AS DOUBLE) END AS yes_price FROM trades WHERE trade_id % 5 <> 0", ("trades",))(lambda t: I.normalize_trades(_raw_trades(t))[0].select("trade_id", "count", "yes_price"))
query("a04_candles_object", "SELECT symbol, t // 1000 * 1000 AS t, open, close, volume FROM bars", ("bars",))(lambda b: I.normalize_candles(b.select("symbol", F.to_json(F.struct((F.col("t") / 1000).cast("long").alias("t"), *[F.col(c).cast("string").alias(c[0]) for c in ("open", "high", "low", "close", "volume")])).alias("raw"))).select("symbol", "t", "open", "close", "volume"))
query("a05_candles_array", "SELECT symbol, t, open, close, volume FROM bars", ("bars",))(lambda b: I.normalize_candles(b.groupBy("symbol").agg(F.to_json(F.collect_list(F.array((F.col("t") / 1_000_000).cast("double"), "low", "high", "open", "close", "volume"))).alias("raw")), "array").select("symbol", "t", "open", "close", "volume"))
query("a06_funding", "SELECT symbol AS coin, t, rate / 1e5 AS funding_rate FROM funding", ("funding",))(lambda f: I.normalize_funding(f.select(F.to_json(F.struct((F.col("t") / 1000).cast("long").alias("time"), F.col("symbol").alias("coin"), (F.col("rate") / 1e5).cast("string").alias("fundingRate"))).alias("raw"))).select("coin", "t", "funding_rate"))
query("a07_normalize_markets", "SELECT ticker, event_ticker, split_part(event_ticker, '-', 1) AS series_ticker, status, result, volume, 0.46e0 AS yes_bid FROM markets", ("markets",))(
    lambda m: I.normalize_markets(m.select(F.to_json(F.struct("ticker", "event_ticker", F.upper("status").alias("status"), "result", F.when(F.col("slot") == 0, F.col("volume")).alias("volume"), F.col("volume").cast("double").cast("string").alias("volume_fp"), F.lit(45).alias("yes_bid"), F.lit("0.46").alias("yes_bid_dollars"))).alias("raw"))).select("ticker", "event_ticker", "series_ticker", "status", "result", "volume", "yes_bid")
)
query("a11_normalize_events", "SELECT event_ticker, CASE WHEN slot = 0 THEN 'title' ELSE 'sub' END AS title FROM markets", ("markets",))(lambda m: I.normalize_events(m.select(F.to_json(F.struct("event_ticker", F.when(F.col("slot") == 0, "title").otherwise("").alias("title"), F.lit("sub").alias("sub_title"))).alias("raw"))).select("event_ticker", "title"))
query("a17_watermarks", "SELECT ticker, trade_id AS last_id, t AS last_t FROM trades QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY t DESC, trade_id DESC) = 1", ("trades",))(I.watermarks)
query("a18_new_since", "SELECT t.trade_id FROM trades t JOIN (SELECT ticker, trade_id AS last_id, t AS last_t FROM trades WHERE trade_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY t DESC, trade_id DESC) = 1) w ON t.ticker = w.ticker AND t.t >= w.last_t AND t.trade_id <> w.last_id", ("trades",))(lambda t: I.new_since(t, I.watermarks(t.where("trade_id % 2 = 0"))).select("trade_id"))
query("a19_backfill_worklist", f"SELECT ticker, slot, tier FROM (SELECT *, split_part(event_ticker, '-', 1) AS series, CASE WHEN closed < 1704067200000000 + {15 * DAY} THEN 'historical' ELSE 'live' END AS tier FROM markets WHERE status = 'settled' AND closed < 1704067200000000 + {25 * DAY} AND user_id % 5 <> 0) m QUALIFY dense_rank() OVER (PARTITION BY series ORDER BY closed, event_ticker) <= 9", ("markets",))(lambda m: I.backfill_worklist(m, m.where("user_id % 5 = 0"), 1704067200000000 + 15 * DAY, 1704067200000000 + 25 * DAY, 9).select("ticker", "slot", "tier"))
query("a20_ingest_summary", "SELECT series, count(DISTINCT event_ticker) AS events, count(*) AS markets, count(n) AS with_trades, CAST(sum(coalesce(n, 0)) AS BIGINT) AS trades FROM (SELECT DISTINCT split_part(event_ticker, '-', 1) AS series, event_ticker, ticker FROM markets) m LEFT JOIN (SELECT ticker, count(*) AS n FROM trades WHERE trade_id % 3 = 0 GROUP BY ticker) t USING (ticker) GROUP BY series", ("markets", "trades"))(lambda m, t: I.ingest_summary(m, t.where("trade_id % 3 = 0")))
query("a21_freshness", f"SELECT symbol, last_t, CASE WHEN last_t IS NULL THEN 'stale' WHEN 1000000000000000 - last_t > {7 * DAY} THEN 'very_stale' WHEN 1000000000000000 - last_t > {2 * DAY} THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT DISTINCT symbol FROM bars) u LEFT JOIN (SELECT symbol, max(t) AS last_t FROM bars WHERE symbol <> 'Brand#11' GROUP BY symbol) l USING (symbol)", ("bars",))(lambda b: I.freshness(b.where("symbol <> 'Brand#11'"), b, DAY, 1_000_000_000_000_000))
query("a22_load_current", "SELECT symbol, t, rate FROM funding WHERE t = (SELECT max(t) FROM funding)", ("funding",))(lambda f: I.load_current(f, "t").select("symbol", "t", "rate"))


def _versions(f):
    """Three versions, the first saved anew; the current one and that by name."""
    spark, root = f.sparkSession, new_path(f.sparkSession, "calibrations")
    for name, part in (("a", 0), ("b", 1), ("a", 2), ("c", 3)):
        I.save_version(f.where(F.col("rate") % 4 == part), root, name)
    return I.load_version(spark, root).withColumn("version", F.lit("current")).union(I.load_version(spark, root, "a").withColumn("version", F.lit("a")))


query("a22_versions_by_name", "SELECT symbol, t, rate, CASE WHEN rate % 4 = 3 THEN 'current' ELSE 'a' END AS version FROM funding WHERE rate % 4 IN (2, 3)", ("funding",))(_versions)
query("a25_parse_ticks", "SELECT user_id AS file, id AS line, CAST(fold AS INTEGER) AS entered, max(CASE WHEN id % 3 = 0 THEN id END) OVER (PARTITION BY user_id ORDER BY id) AS seen FROM runs QUALIFY id % 3 <> 0", ("runs",))(
    lambda r: I.parse_ticks(r.select(F.col("user_id").alias("file"), F.col("id").alias("line"), F.when(F.col("id") % 3 == 0, F.concat(F.date_format(F.timestamp_seconds("id"), "yyyy-MM-dd HH:mm:ss"), F.lit(" tick"))).otherwise(F.concat(F.lit("entered="), F.col("fold").cast("string"), F.lit(" rejected=1"))).alias("value"))).select("file", "line", "entered", F.unix_timestamp("at").alias("seen"))
)

# --- scalar functions --------------------------------------------------------------------------------------------------

scalar("b09_parse_price", "positions", "id", lambda: {"price": S.parse_price(F.concat((F.col("edge_pp") * 6).cast("string"), F.when(F.col("id") % 4 == 0, "x").otherwise("")))}, "CASE WHEN id % 4 = 0 THEN NULL WHEN edge_pp * 6 > 1 THEN least(1e0, edge_pp * 6 / 100e0) ELSE CAST(edge_pp * 6 AS DOUBLE) END AS price")
scalar("b10_bucket_range", "positions", "id", lambda: {"mid": S.parse_bucket_range(F.concat(F.lit("$1,"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" to 2,500.5")))["mid"]}, "(1000 + id % 1000 + 2500.5e0) / 2 AS mid")
scalar("b11_threshold", "positions", "id", lambda: {"threshold": S.parse_threshold(F.concat(F.when(F.col("id") % 3 == 0, "Above ").otherwise("Below "), F.col("edge_pp").cast("string"), F.lit(".25%")))}, "CASE WHEN id % 3 = 0 THEN edge_pp + 0.25e0 END AS threshold")
scalar("b15_time_offset_frac", "positions", "id", lambda: {"frac": S.time_offset_frac(F.col("entered") + 3 * HOUR, "entered", "entered", "closes")}, f"{3 * HOUR} / CAST(closes - entered AS DOUBLE) AS frac")
scalar("b20_half_life", "positions", "id", lambda: {"hours": S.half_life(F.col("entry_price") * -1.5)}, "CASE WHEN 1 - entry_price * 1.5e0 > 0 AND 1 - entry_price * 1.5e0 < 1 THEN ln(0.5e0) / ln(1 - entry_price * 1.5e0) END AS hours")
scalar("b21_rel_position", "positions", "id", lambda: {"pos": S.rel_position("risk_cents", "reward_cents", F.lit(4.0))}, "CAST(round_even((risk_cents - reward_cents) / 4e0, 0) AS INTEGER) AS pos")
scalar("b30_signal_ok", "positions", "id", lambda: {"ok": S.signal_ok(F.when(F.col("side") == "sell_yes", "short").otherwise("long"), F.lit(50.0), "risk_cents", F.col("reward_cents") * 4.0)}, "CASE WHEN side = 'sell_yes' THEN reward_cents * 4e0 < 50 AND 50 < risk_cents ELSE risk_cents < 50 AND 50 < reward_cents * 4e0 END AND abs(reward_cents * 4e0 - 50) >= 2 * abs(50 - risk_cents) AS ok")
_it = lambda: S.iron_triangle_size("entry_price", F.lit(2.0), F.lit(10000.0))
scalar("b31_iron_triangle", "positions", "id", lambda: {"units": _it()["units"], "risk": _it()["risk"]}, "200e0 / abs(entry_price - 2) AS units, 200e0 AS risk")
_pp = lambda: S.perp_close_pnl(F.when(F.col("side") == "sell_yes", "short").otherwise("long"), F.lit(3.0), "entry_price", F.lit(0.6), F.lit(0.01))
scalar("b32_perp_close_pnl", "positions", "id", lambda: {"gross": _pp()["gross"], "net": _pp()["net"]}, "CASE WHEN side = 'sell_yes' THEN 3 * (entry_price - 0.6e0) ELSE 3 * (0.6e0 - entry_price) END AS gross, CASE WHEN side = 'sell_yes' THEN 3 * (entry_price - 0.6e0) ELSE 3 * (0.6e0 - entry_price) END - 3 * (entry_price + 0.6e0) * (0.00045e0 + 0.0005e0) - 0.01e0 AS net")
scalar("b34_n_for_confidence", "positions", "id", lambda: {"n": S.n_for_confidence(F.col("entry_price") - 0.5)}, "CASE WHEN entry_price - 0.5e0 > 0 THEN CAST(ceil((1.6449e0 / (entry_price - 0.5e0)) * (1.6449e0 / (entry_price - 0.5e0))) AS BIGINT) END AS n")
scalar("b36_ticker_norm", "positions", "id", lambda: {"coin": S.coin_of(F.concat("ticker", F.lit("-PERP"))), "perp": S.perp_name(F.concat("ticker", F.lit("_PERP")))}, "ticker AS coin, concat(ticker, '_PERP') AS perp")
scalar("b38_roi", "positions", "id", lambda: {"roi": S.roi_pct("risk_cents", "reward_cents"), "kept": S.retention("risk_cents", "edge_pp")}, "(risk_cents / CAST(reward_cents AS DOUBLE) - 1) * 100 AS roi, risk_cents / CAST(nullif(edge_pp, 0) AS DOUBLE) AS kept")
_BOOKS = "(SELECT user_id, slot, list(yes_price ORDER BY yes_price DESC, trade_id) AS y FROM (SELECT *, (t - 1704067200000000) // 864000000000 AS slot FROM trades) x GROUP BY user_id, slot)"


def _books(t):
    slot = F.floor((F.col("t") - 1704067200000000) / (10 * DAY)).cast("long")
    g = t.groupBy("user_id", slot.alias("slot")).agg(F.sort_array(F.collect_list(F.struct((-F.col("yes_price")).alias("o"), "trade_id", F.col("yes_price").alias("price"), F.lit(1).alias("size")))).alias("y"))
    return g.select("user_id", "slot", F.transform("y", lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))).alias("yes"), F.expr("transform(array(y[0]), x -> named_struct('price', x.price / 2, 'size', x.size))").alias("no"))


query("b22_executable_prices", f"SELECT user_id, slot, y[1] AS sell_yes, 1 - y[1] / 2 AS buy_yes FROM {_BOOKS} b", ("trades",))(lambda t: _books(t).select("user_id", "slot", S.executable_prices("yes", "no").alias("x")).select("user_id", "slot", "x.sell_yes", "x.buy_yes"))
query("a10_flatten_l2", f"SELECT user_id, slot, y[1] AS bid_px_0, y[2] AS bid_px_1, (y[1] + 1) / 2 AS mid, 1 - y[1] AS spread FROM {_BOOKS} b", ("trades",))(
    lambda t: I.flatten_l2(_books(t).select("user_id", "slot", F.array(F.transform("yes", lambda x: F.struct(x["price"].cast("string").alias("px"), x["size"].cast("string").alias("sz"))), F.array(F.struct(F.lit("1").alias("px"), F.lit("1").alias("sz")))).alias("levels")), 3).select("user_id", "slot", "bid_px_0", "bid_px_1", "mid", "spread")
)

# --- joins and reports ---------------------------------------------------------------------------------------------------

query("c05_align_timeframes", """SELECT b.symbol, b.i, coalesce(w.v, 0) AS long_v FROM bars b ASOF LEFT JOIN (SELECT symbol, min(t) AS wt, arg_max(close, t) AS v FROM (SELECT *, t // 604800000000 AS w FROM bars) x GROUP BY symbol, w) w ON b.symbol = w.symbol AND b.t >= w.wt""", ("bars",))(lambda b: A.align_timeframes(b, _slow(b).withColumn("v", F.col("close")).select("symbol", "t", "v"), ["symbol"], "t", "v").select("symbol", "i", "long_v"))
query("c16_coalesced_sources", """SELECT p.id, coalesce(q.mid, t.yes_price) AS line, CASE WHEN q.mid IS NOT NULL THEN 'quote' ELSE 'trade' END AS line_source FROM (SELECT id, concat('T', CAST(id % 150 AS STRING)) AS tk, 1704067200000000 + id % 700 * 3600000000 AS at FROM positions) p
 ASOF LEFT JOIN (SELECT *, CASE WHEN no_price > 0 AND no_price < 2 AND yes_price > 0 AND yes_price < 1 AND yes_price >= no_price / 2 THEN (no_price / 2 + yes_price) / 2 END AS mid FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id DESC) = 1) q ON p.tk = q.ticker AND p.at >= q.t
 ASOF LEFT JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id DESC) = 1) t ON p.tk = t.ticker AND p.at >= t.t WHERE coalesce(q.mid, t.yes_price) IS NOT NULL""", ("positions", "trades"))(
    lambda p, t: A.closing_lines(p.withColumns({"ticker": F.concat(F.lit("T"), (F.col("id") % 150).cast("string")), "closes": F.lit(1704067200000000) + F.col("id") % 700 * HOUR}), t, t, S.mid_from_quote(F.col("no_price") / 2, "yes_price", F.lit(None).cast("double")), "trade_id").select("id", "line", "line_source")
)
query("c21_positions_with_market", "SELECT p.id, p.slot, m.volume FROM (SELECT id, concat('T', CAST(id % 200 AS STRING)) AS tk, id % 3 AS slot FROM positions) p LEFT JOIN markets m ON p.tk = m.ticker AND p.slot = m.slot", ("positions", "markets"))(lambda p, m: p.select("id", F.concat(F.lit("T"), (F.col("id") % 200).cast("string")).alias("ticker"), (F.col("id") % 3).alias("slot")).join(m, ["ticker", "slot"], "left").select("id", "slot", "volume"))
query("d04_checks", f"SELECT name, value, passed FROM (SELECT 'wins' AS name, CAST(count(*) FILTER (p > 0) AS DOUBLE) AS value, count(*) FILTER (p > 0) > 100 AS passed FROM (SELECT {_PNL} AS p FROM positions WHERE status = 'closed') x UNION ALL SELECT 'pnl', CAST(sum(p) AS DOUBLE), sum(p) > 0 FROM (SELECT {_PNL} AS p FROM positions WHERE status = 'closed') y) z", ("positions",))(lambda p: C.checks(K.closed_book_summary(p), {"wins": (">", 100), "pnl": (">", 0)}))
query("d31_cell_report", "SELECT template, cohort, count(*) AS n, count(s) AS scored, max(s) AS best FROM (SELECT *, CASE WHEN status = 'scored' THEN score END AS s FROM runs) x GROUP BY template, cohort", ("runs",))(lambda r: O.search_report(r, ["template", "cohort"]).select("template", "cohort", "n", "scored", "best"))
query("d35_strategy_kpis", f"SELECT side AS strategy, CAST(1000000 + sum(CASE WHEN status = 'closed' THEN {_PNL} ELSE 0 END) AS BIGINT) AS nav, count(*) FILTER (status = 'open') AS open FROM positions GROUP BY side", ("positions",))(lambda p: K.portfolio_summary(p, 1_000_000, 0, ["side"]).select(F.col("side").alias("strategy"), "nav", "open"))
query("f03_rank_by_quality", "SELECT category, id FROM positions WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY category ORDER BY edge_pp / risk_cents DESC, id) <= 20", ("positions",))(lambda p: K.rank_by_quality(p.where("status = 'open'"), 20, ["category"], F.col("edge_pp") / F.col("risk_cents")).select("category", "id"))
query("f06_best_side", "SELECT ticker, side, edge FROM (SELECT ticker, side, max(edge_pp) AS edge FROM positions GROUP BY ticker, side) x QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY edge DESC, side DESC) = 1", ("positions",))(lambda p: K.best_side(p.groupBy("ticker", "side").agg(F.max("edge_pp").alias("edge")), ["ticker"]))
query("g02_distinct_by", "SELECT ticker, trade_id FROM trades QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY t, trade_id) = 1", ("trades",))(lambda t: I.merged(t.limit(0).withColumn("o", F.struct(-F.col("t"), -F.col("trade_id"))), t.withColumn("o", F.struct(-F.col("t"), -F.col("trade_id"))), ["ticker"], "last", "o").select("ticker", "trade_id"))
query("i11_holdout_trades", "SELECT symbol, i FROM bars JOIN (SELECT symbol, max(t) AS z FROM bars GROUP BY symbol) m USING (symbol) WHERE t >= z - 86400000000 * 90", ("bars",))(lambda b: O.holdout(b, b, 90).select("symbol", "i"))
query("d26_max_drawdown", "SELECT symbol, max((peak - close) / peak) AS max_dd FROM (SELECT symbol, close, max(close) OVER (PARTITION BY symbol ORDER BY i) AS peak FROM bars) x GROUP BY symbol", ("bars",))(lambda b: B.max_drawdown(b))
query("c19_join_returns", "SELECT b.symbol, b.t, r.v AS fwd_ret FROM bars b LEFT JOIN (SELECT symbol, t, lead(close) OVER (PARTITION BY symbol ORDER BY i) / close - 1 AS v FROM bars) r ON b.symbol = r.symbol AND b.t = r.t", ("bars",))(lambda b: b.select("symbol", "t").join(B.forward_return(b).select("symbol", "t", "fwd_ret"), ["symbol", "t"], "left"))
query("c20_markets_in_categories", f"SELECT ticker, slot FROM markets WHERE {S.category_sql('event_ticker')} IN ('sports', 'crypto')", ("markets",))(lambda m: A.restrict_to(m, m.where(S.categorize("event_ticker").isin("sports", "crypto")).select("event_ticker").distinct(), ["event_ticker"]).select("ticker", "slot"))
