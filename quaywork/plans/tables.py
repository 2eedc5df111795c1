"""Queries that write tables and read them back, and those over whole markets, books and ladders that need more than one
operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import calibration as C
from ..operators import ladder as L
from ..operators import outcomes as O
from ..sources import ingest as I
from ..sources.adapters import with_relations
from ..sources.paths import new_path
from .more import _BOOKS, _books
from .registry import _BINS, _PANEL, _PIT, DAY, ORACLE_SQL, _panel, query

# --- written and read back -----------------------------------------------------------------------------------------

T0 = 1704067200000000


def _written(first, second, upsert):
    """The table after an upsert of ``first`` and then of ``second``."""
    root = new_path(first.sparkSession, "table")
    upsert(first, root)
    upsert(second, root)
    return first.sparkSession.read.option("mergeSchema", "true").parquet(root)


def _day(d, column="t"):
    return d.withColumn("day", F.floor((F.col(column) - T0) / (10 * DAY)).cast("int"))


#: The first batch has a column that the second lacks, and the other way round; every trade is in one of them, a sixth in both.
query("a12_upsert_trades", """SELECT trade_id, n, a, b FROM (SELECT trade_id, n, n * 2 AS a, NULL AS b, 0 AS s FROM trades WHERE trade_id % 3 <> 0 UNION ALL SELECT trade_id, n + 100, NULL, n * 3, 1 FROM trades WHERE trade_id % 3 = 0 OR trade_id % 4 = 0) u QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY s) = 1""", ("trades",))(
    lambda t: _written(_day(t).where("trade_id % 3 <> 0").selectExpr("trade_id", "n", "n * 2 AS a", "day"), _day(t).where("trade_id % 3 = 0 OR trade_id % 4 = 0").selectExpr("trade_id", "n + 100 AS n", "n * 3 AS b", "day"), lambda d, root: I.upsert_partitioned(d, root, ["trade_id"], "day")).select("trade_id", "n", "a", "b")
)
query("a13_upsert_markets", "SELECT ticker, slot, volume FROM markets QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY closed DESC) = 1", ("markets",))(
    lambda m: _written(m.where("slot < 2").withColumn("part", F.lit(0)), m.where("slot >= 1").withColumn("part", F.lit(0)), lambda d, root: I.upsert_partitioned(d, root, ["ticker"], "part", "last", "closed")).select("ticker", "slot", "volume")
)
query("a14_upsert_events", "SELECT event_ticker, slot, pulled_at FROM (SELECT event_ticker, slot, user_id AS pulled_at FROM markets UNION ALL SELECT event_ticker, slot, user_id + 7 FROM markets WHERE user_id % 2 = 0) u QUALIFY row_number() OVER (PARTITION BY event_ticker, slot ORDER BY pulled_at DESC) = 1", ("markets",))(
    lambda m: _written(m.selectExpr("event_ticker", "slot AS date", "user_id AS pulled_at"), m.where("user_id % 2 = 0").selectExpr("event_ticker", "slot AS date", "user_id + 7 AS pulled_at"), I.upsert_events).select("event_ticker", F.col("date").cast("long").alias("slot"), "pulled_at")
)
query("a15_append_dedup", "SELECT symbol, t, close FROM bars WHERE i % 3 <> 0 UNION ALL SELECT symbol, t, close + 1 FROM bars WHERE i % 3 = 0", ("bars",))(
    lambda b: _written(b.where("i % 3 <> 0").select("symbol", "t", "close"), b.select("symbol", "t", (F.col("close") + 1).alias("close")), lambda d, root: I.append_dedup(d, root, ["t"], "symbol")).select("symbol", "t", "close")
)


def _shadow(t):
    rows = t.select("ticker", F.timestamp_micros("t").alias("ts"), "trade_id").withColumn("reject_date", F.to_date("ts"))
    root = new_path(t.sparkSession, "shadow")
    first = rows.where("trade_id % 2 = 0").dropDuplicates(["ticker", "reject_date"])
    I.upsert_shadow(first, root)
    return I.upsert_shadow(rows, root)


query("a16_upsert_shadow", "SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (NOT early) AS BIGINT) AS added FROM (SELECT ticker, t // 86400000000 AS d, bool_or(trade_id % 2 = 0) AS early FROM trades GROUP BY 1, 2) x WHERE d IN (SELECT t // 86400000000 FROM trades)", ("trades",))(_shadow)


def _appended(r):
    root = new_path(r.sparkSession, "runs")
    for part in (0, 1):
        I.append_runs(r.where(F.col("id") % 2 == part).select(F.lit(part).alias("part"), "template", "status", F.col("id").alias("run")), root)
    return r.sparkSession.read.parquet(root).groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("ids"))


query("a24_append_runs", "SELECT CAST(id % 2 AS INTEGER) AS part, count(*) AS n, CASE WHEN id % 2 = 0 THEN 1 ELSE 1 + (SELECT count(*) FROM runs WHERE id % 2 = 0) END AS low, CASE WHEN id % 2 = 0 THEN count(*) ELSE (SELECT count(*) FROM runs) END AS high, count(*) AS ids FROM runs GROUP BY id % 2", ("runs",))(_appended)


def _tree(d, part, sort):
    root = new_path(d.sparkSession, "tree")
    I.sink_parquet(d, root, part, sort)
    return d.sparkSession, root


def _text(d, kind):
    path = new_path(d.sparkSession, kind)
    I.sink_text(d, path, kind)
    r = d.sparkSession.read.schema(d.schema)
    return r.option("header", True).option("nullValue", "\\N").csv(path) if kind == "csv" else r.json(path)


def _dated(t):
    return t.withColumn("date", F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd"))


query("a01_scan_partitioned", "SELECT trade_id, ticker, n FROM trades WHERE strftime(make_timestamp(t), '%Y-%m-%d') IN ('2024-01-05', '2024-01-20')", ("trades",))(
    lambda t: (lambda s, root: I.read_partitioned(s, root, "date", ["2024-01-05", "2024-01-20"], ["trade_id", "ticker", "n"]))(*_tree(_dated(t), ["date"], ["ticker", "t"]))
)
query("a02_read_bars", "SELECT symbol, i, open, high, low, close FROM bars WHERE symbol IN ('Brand#11', 'Brand#23')", ("bars",))(lambda b: (lambda s, root: I.read_bars(s, root, ["Brand#11", "Brand#23"], "1d"))(*_tree(b.withColumn("interval", F.lit("1d")), ["symbol"], ["i"])).select("symbol", "i", "open", "high", "low", "close"))
query("a03_read_funding", "SELECT symbol AS coin, t, rate / 1e5 AS funding_rate FROM funding WHERE symbol IN ('C1', 'C7', 'none')", ("funding",))(lambda f: (lambda s, root: I.read_funding(s, root, ["C1", "C7", "none"]))(*_tree(f.select(F.col("symbol").alias("coin"), "t", (F.col("rate") / 1e5).alias("funding_rate")), ["coin"], ["t"])))
query("a26_sink_parquet", "SELECT category, id, edge_pp FROM positions", ("positions",))(lambda p: (lambda s, root: s.read.parquet(root))(*_tree(p.select("category", "id", "edge_pp"), ["category"], ["id"])))
_OUT = "SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN '' ELSE concat(category, ',\"', ticker) END AS note, entry_price FROM positions"
_notes = lambda p: p.select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 0, "").otherwise(F.concat("category", F.lit(',"'), "ticker")).alias("note"), "entry_price")
query("a27_sink_csv", _OUT, ("positions",))(lambda p: _text(_notes(p), "csv"))
query("a27_sink_json", _OUT, ("positions",))(lambda p: _text(_notes(p), "json"))
query("a09_normalize_orderbook", f"SELECT user_id, slot, len(y) AS bids, y[1] AS best, 1 AS asks FROM {_BOOKS} b", ("trades",))(
    lambda t: (lambda o: o.select(F.split("ticker", "/")[0].cast("long").alias("user_id"), F.split("ticker", "/")[1].cast("long").alias("slot"), F.size("yes").cast("long").alias("bids"), F.get("yes", F.lit(0))["price"].alias("best"), F.size("no").alias("asks")))(
        I.normalize_orderbooks(_books(t).select(F.to_json(F.struct(F.concat_ws("/", "user_id", "slot").alias("ticker"), F.concat(F.transform("yes", lambda x: F.array(x["price"].cast("string"), F.lit("3"))), F.array(F.array(F.lit("x"), F.lit("1")), F.array(F.lit("0.5"), F.lit("0")))).alias("yes"), F.array(F.array(F.lit("0.5"), F.lit("2"))).alias("no"))).alias("raw")))
    )
)
query("a23_cohorts", "SELECT DISTINCT cohort, concat('U', CAST(user_id AS STRING), '-PERP') AS symbol FROM runs", ("runs",))(lambda r: I.read_cohorts(r.groupBy("cohort").agg(F.collect_set(F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("_PERP"))).alias("s")).select(F.to_json(F.create_map("cohort", "s")).alias("raw"))))
query("k02_register_view", "SELECT category, count(*) AS n FROM positions GROUP BY category", ("positions",))(lambda p: I.register_view(p, "quaywork_positions").sparkSession.sql("SELECT category, count(*) AS n FROM quaywork_positions GROUP BY category"))
query("f07_ordered", "SELECT id, category, edge_pp FROM positions ORDER BY category, edge_pp, id", ("positions",))(lambda p: I.ordered(p.select("id", "category", "edge_pp"), ["category", "edge_pp", "id"]))

# --- sets, configurations -----------------------------------------------------------------------------------------

query("g01_union_by_name", "SELECT ticker, t, n, NULL AS slot FROM trades UNION ALL SELECT ticker, opened, NULL, slot FROM markets", ("trades", "markets"))(lambda t, m: I.union_by_name(t.select("ticker", "t", "n"), m.select("slot", F.col("opened").alias("t"), "ticker")))
query("g03_missing_fields", "SELECT id, CASE user_id % 3 WHEN 0 THEN 'high,low' WHEN 1 THEN 'low' ELSE '' END AS missing FROM runs", ("runs",))(lambda r: r.select("id", F.array_join(I.missing_fields(["close", "high", "low"], F.when(F.col("user_id") % 3 == 0, F.array(F.lit("close"), F.lit("x"))).when(F.col("user_id") % 3 == 1, F.array(F.lit("close"), F.lit("high"))).otherwise(F.array(F.lit("low"), F.lit("high"), F.lit("close")))), ",").alias("missing")))
query("c18_cross_configs", "SELECT k, lookback, symbol FROM (SELECT k, 20 + 5 * k AS lookback FROM range(6) t(k)) c, (SELECT DISTINCT symbol FROM bars) s", ("bars",))(lambda b: O.cross_configs(b.sparkSession.range(6).select(F.col("id").alias("k"), (F.col("id") * 5 + 20).alias("lookback")), b).select("k", "lookback", "symbol"))
_PARAMS = {"template": {"choices": ["click", "view", "purchase"]}, "fast": {"type": "int", "low": 2, "high": 50}, "slow": {"type": "int", "low": 2, "high": 200}, "width": {"type": "double", "low": 0.0, "high": 1.0, "optional": True}}


def _params(r):
    pairs = [("template", F.col("template")), ("fast", F.when(F.col("id") % 7 == 0, "x").otherwise((F.col("id") % 60).cast("string"))), ("slow", F.when(F.col("id") % 5 != 0, (F.col("user_id") % 80).cast("string"))), ("width", F.when(F.col("id") % 2 == 0, F.lit("1.5"))), ("zeal", F.when(F.col("id") % 11 == 0, F.lit("1")))]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull())
    return r.select("id", F.map_from_entries(entries).alias("params"))


query("b35_validate_configs", """SELECT id, concat_ws(';', CASE WHEN template NOT IN ('click', 'view', 'purchase') THEN 'template: choice' END, CASE WHEN id % 7 = 0 THEN 'fast: type' WHEN id % 60 < 2 OR id % 60 > 50 THEN 'fast: range' END,
 CASE WHEN id % 5 = 0 THEN 'slow: missing' WHEN user_id % 80 < 2 THEN 'slow: range' END, CASE WHEN id % 2 = 0 THEN 'width: range' END, CASE WHEN id % 7 <> 0 AND id % 5 <> 0 AND id % 60 >= user_id % 80 THEN 'fast >= slow' END, CASE WHEN id % 11 = 0 THEN 'zeal: unknown' END) AS errors FROM runs""", ("runs",))(
    lambda r: O.validate_configs(_params(r), _PARAMS, [("fast", "slow")]).select("id", F.array_join("errors", ";").alias("errors"))
)

# --- calibration by time, candidates ---------------------------------------------------------------------------------

_CUT = T0 + 15 * DAY
_TRAIN = _BINS.replace("cents BETWEEN 1 AND 99", f"cents BETWEEN 1 AND 99 AND closed < {_CUT}")
query("d02_train_curves", f"SELECT scope, bin_low, n, yes_count, actual_rate, side FROM ({_TRAIN}) c", ("trades", "markets"))(lambda t, m: C.train_curves(C.pit_prices(t, m), _CUT).select("scope", "bin_low", "n", "yes_count", "actual_rate", "side"))
query("b08_bin_tradeable", f"SELECT scope, bin_low, CASE WHEN n >= 100 AND abs(actual_rate - i) * 100 >= 3 AND fee_adj_edge > 0 THEN CASE WHEN actual_rate < i THEN 'sell_yes' WHEN actual_rate > i THEN 'buy_yes' ELSE '' END ELSE '' END AS side FROM (SELECT *, (bin_low + 2.5e0) / 100 AS i FROM ({_BINS}) b) c", ("trades", "markets"))(lambda t, m: C.calibration_bins(C.pit_prices(t, m)).select("scope", "bin_low", S.bin_tradeable("n", (F.col("bin_low") + 2.5) / 100, "actual_rate").alias("side")))
_TESTED = f"""WITH_ curves AS ({_TRAIN}),
 traded AS (SELECT * FROM (SELECT q.*, coalesce(o.actual_rate, a.actual_rate) AS actual FROM (SELECT *, CAST(floor(cents / 5) * 5 AS INTEGER) AS bin_low FROM ({_PIT}) p WHERE closed >= {_CUT}) q LEFT JOIN (SELECT * FROM curves WHERE n >= 5) o ON o.scope = q.category AND o.bin_low = q.bin_low LEFT JOIN (SELECT * FROM curves WHERE n >= 5 AND scope = 'aggregate') a ON a.bin_low = q.bin_low) z WHERE actual IS NOT NULL)
 SELECT bin_low, n, rate, actual_rate AS predicted, (rate - actual_rate) * 100 AS gap_pp FROM (SELECT bin_low, count(*) AS n, count(*) FILTER (result = 'yes') / CAST(count(*) AS DOUBLE) AS rate FROM traded GROUP BY bin_low) g LEFT JOIN (SELECT bin_low, actual_rate FROM curves WHERE scope = 'aggregate') c USING (bin_low)"""


def _accuracy(t, m):
    pit = C.pit_prices(t, m)
    curves = C.train_curves(pit, _CUT)
    return C.calibration_accuracy(C.bin_lookup(pit.where(F.col("closed") >= _CUT), curves, 5), curves)


query("d03_calibration_accuracy", None, ("trades", "markets"))(_accuracy)
ORACLE_SQL["d03_calibration_accuracy"] = with_relations("", "trades", "markets").rstrip() + "," + _TESTED.removeprefix("WITH_")
_CANDIDATES = f""", curves AS ({_BINS}), sides AS (SELECT m.ticker, m.slot, {S.category_sql("m.event_ticker")} AS category, x.side, x.price FROM markets m JOIN {_BOOKS} b ON m.user_id = b.user_id AND m.slot = b.slot, LATERAL (SELECT 'sell_yes' AS side, b.y[1] AS price UNION ALL SELECT 'buy_yes', 1 - b.y[1] / 2) x WHERE x.price > 0 AND x.price < 1),
 found AS (SELECT s.*, abs(i - actual) * 100 AS edge, CASE WHEN actual < i THEN 'sell_yes' ELSE 'buy_yes' END AS own FROM (SELECT s.*, (s.bin_low + 2.5e0) / 100 AS i, CASE WHEN h.scope IS NULL THEN a.actual_rate ELSE o.actual_rate END AS actual FROM (SELECT *, CAST(floor(CAST(round_even(price * 100, 0) AS INTEGER) / 5) * 5 AS INTEGER) AS bin_low FROM sides) s
 LEFT JOIN curves o ON o.scope = s.category AND o.bin_low = s.bin_low LEFT JOIN curves a ON a.scope = 'aggregate' AND a.bin_low = s.bin_low LEFT JOIN (SELECT DISTINCT scope FROM curves) h ON h.scope = s.category) s WHERE actual IS NOT NULL)
 SELECT ticker, slot, side, edge FROM found WHERE own = side AND edge >= 5 QUALIFY row_number() OVER (PARTITION BY ticker, slot ORDER BY edge DESC, side DESC) = 1"""
query("i15_scan_candidates", None, ("trades", "markets"))(lambda t, m: C.scan_candidates(m, _books(t), C.calibration_bins(C.pit_prices(t, m)), on=["user_id", "slot"]).join(m.select("user_id", "slot", "ticker"), ["user_id", "slot"]).select("ticker", "slot", "side", "edge"))
ORACLE_SQL["i15_scan_candidates"] = with_relations("", "trades", "markets").rstrip() + _CANDIDATES
_AT = f"(SELECT id, concat('T', CAST(id % 150 AS STRING)) AS tk, {T0} + id % 700 * 3600000000 AS at FROM positions)"
query("c15_snapshot_closing_line", f"SELECT p.id, CASE WHEN q.no_price > 0 AND q.no_price < 1 AND q.yes_price > 0 AND q.yes_price < 1 AND q.yes_price >= q.no_price THEN (q.no_price + q.yes_price) / 2 WHEN q.yes_price > 0 AND q.yes_price < 1 THEN q.yes_price END AS line FROM {_AT} p ASOF JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id DESC) = 1) q ON p.tk = q.ticker AND p.at >= q.t WHERE line IS NOT NULL", ("positions", "trades"))(
    lambda p, t: A.snapshot_closing_lines(p.withColumns({"ticker": F.concat(F.lit("T"), (F.col("id") % 150).cast("string")), "closes": F.lit(T0) + F.col("id") % 700 * 3_600_000_000}), t, S.mid_from_quote("no_price", "yes_price", "yes_price"), "trade_id").select("id", "line")
)
_N = "(CASE WHEN abs({0}) > 5.2 THEN sign({0}) ELSE 1.1283791670955126e0 * {0} * exp(-{0} * {0}) * " + "list_reduce(list_prepend(1e0, list_transform(range(96, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda s, k: 1 + s * 2 * {0} * {0} / (2 * k + 1))" + " END)"
_Z = "(ln({0} / 100e0) / (0.8e0 * sqrt(id % 9 / 12e0)) / 1.4142135623730951e0)"
query("b18_lognormal_bucket_prob", f"SELECT id, CASE WHEN id % 9 > 0 THEN (hi - lo) / 2 END AS prob FROM (SELECT id, {_N.format('a')} AS lo, {_N.format('b')} AS hi FROM (SELECT id, CASE WHEN id % 9 > 0 THEN {_Z.format('(80 + id % 30)')} END AS a, CASE WHEN id % 9 > 0 THEN {_Z.format('(90 + id % 30)')} END AS b FROM positions) x) y", ("positions",))(lambda p: p.select("id", S.lognormal_bucket_prob(80 + F.col("id") % 30, 90 + F.col("id") % 30, F.lit(100.0), F.lit(0.8), F.col("id") % 9 / 12).alias("prob")))

# --- studies ------------------------------------------------------------------------------------------------------------

_LADDERED = f"(SELECT l.event, l.t, l.strike, b.close * (0.6e0 + 0.1e0 * l.strike) AS lo, b.close * (0.7e0 + 0.1e0 * l.strike) AS hi, b.close AS spot FROM ladder l ASOF JOIN bars b ON l.event = b.symbol AND l.t >= b.t)"
_RETURNS = "(SELECT symbol, t, lead(t, 2) OVER w AS z, lead(close, 2) OVER w / close - 1 AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i))"


def _bucket_panel(l, b):  # noqa: E741
    j = A.asof_join(l.select(F.col("event").alias("symbol"), "event", "t", "strike"), b.select("symbol", F.col("t").alias("bt"), F.col("close").alias("spot")), ["symbol"], "t", "bt")
    return j.select("event", "t", "symbol", "strike", "spot", (F.col("spot") * (0.6 + 0.1 * F.col("strike"))).alias("lo"), (F.col("spot") * (0.7 + 0.1 * F.col("strike"))).alias("hi"))


for _name, _past in (("d20_empirical_bucket_prob", False), ("d20_without_lookahead", True)):
    query(_name, f"""SELECT event, t, strike, samples, q0 / nullif(sum(q0) OVER (PARTITION BY event, t), 0) AS q FROM (SELECT p.event, p.t, p.strike, count(*) AS samples, count(*) FILTER (p.spot * (1 + r.r) >= p.lo AND p.spot * (1 + r.r) < p.hi) / CAST(count(*) AS DOUBLE) AS q0
 FROM {_LADDERED} p JOIN {_RETURNS} r ON r.symbol = p.event AND r.t >= p.t - {30 * DAY} AND r.t < p.t AND r.r IS NOT NULL{" AND r.z <= p.t" if _past else ""} GROUP BY p.event, p.t, p.strike HAVING count(*) >= 8) x""", ("ladder", "bars"))(lambda l, b, past=_past: L.empirical_bucket_prob(_bucket_panel(l, b), b, horizon=2, min_n=8, no_lookahead=past).select("event", "t", "strike", "samples", "q"))  # fmt: skip
_BAND = "(SELECT event, CASE WHEN sum(n) < {0} THEN 'few' ELSE 'many' END AS band FROM ladder GROUP BY event)"
query("d21_universe_compare", f"""SELECT band, n, median, p90, beta, median / nullif(max(CASE WHEN band = 'many' THEN median END) OVER (), 0) AS ratio FROM (SELECT band, count(*) AS n, median(max_gap) AS median, quantile_cont(max_gap, 0.9) AS p90, regr_slope(change, max_gap) AS beta FROM (
 SELECT a.*, b.max_gap - a.max_gap AS change FROM (SELECT * FROM snaps) a LEFT JOIN snaps b ON a.event = b.event AND b.t = a.t + {30 * DAY}) x GROUP BY band) y""", ("ladder",))(lambda l: L.universe_compare(_panel(l), l, {"few": (1, 2400), "many": (2400, None)}, 30 * DAY, "many"))  # fmt: skip
ORACLE_SQL["d21_universe_compare"] = with_relations("", "ladder").rstrip() + f", snaps AS (SELECT d.band, x.event, x.t, max(abs(p - q)) AS max_gap FROM {_PANEL} x JOIN {_BAND.format(2400)} d USING (event) GROUP BY d.band, x.event, x.t)\n" + ORACLE_SQL["d21_universe_compare"].split("\nSELECT band", 1)[1].join(["SELECT band", ""])
