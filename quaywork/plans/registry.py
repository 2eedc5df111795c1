
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import bars as B
from ..operators import book as K
from ..operators import calibration as C
from ..operators import ladder as L
from ..operators import outcomes as O
from ..sources.adapters import read, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400_000_000
HOUR = 3_600_000_000


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()):
    """Registers a function of relations (one argument for each of ``uses``)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[read(spark, sf_dir, r) for r in uses])
        if sql:
            ORACLE_SQL[name] = with_relations(sql, *uses)
        return f

    return add


def scalar(name: str, relation: str, keys: str, columns: Callable[[], dict], sql: str) -> None:
    """Registers scalar functions over a relation's rows; ``columns`` is called when a session is there."""
    query(name, f"SELECT {keys}, {sql} FROM {relation}", (relation,))(lambda d: d.select(*[k.strip() for k in keys.split(",")], *[c.alias(n) for n, c in columns().items()]))


# --- scalar functions --------------------------------------------------------------------------------------------

scalar("b01_categorize", "markets", "ticker, slot", lambda: {"category": S.categorize("event_ticker"), "by_prefix": S.categorize("event_ticker", "prefix")}, f"{S.category_sql('event_ticker')} AS category, {S.category_sql('event_ticker', precedence='prefix')} AS by_prefix")
scalar("b02_midlife", "markets", "ticker, slot", lambda: {"mid": S.midlife("opened", "closed")}, "(opened + closed) // 2 AS mid")
scalar("b03_price_to_cents", "trades", "trade_id", lambda: {"cents": S.price_to_cents("yes_price")}, "CAST(round_even(yes_price * 100, 0) AS INTEGER) AS cents")
scalar("b04_price_bins", "trades", "trade_id", lambda: {"bin_cents": S.price_bin_5c(S.price_to_cents("yes_price")), "bin_frac": S.price_bin_frac("yes_price")}, "CAST(floor(CAST(round_even(yes_price * 100, 0) AS INTEGER) / 5) * 5 AS INTEGER) AS bin_cents, least(95, CAST(floor(floor(yes_price * 100) / 5) * 5 AS INTEGER)) AS bin_frac")
scalar("b05_fee_adjusted_edge", "trades", "trade_id", lambda: {"edge": S.fee_adjusted_edge("yes_price", F.lit(0.5))}, "abs(0.5e0 - yes_price) - 0.14e0 * yes_price * (1 - yes_price) AS edge")
scalar("b06_trade_side", "trades", "trade_id", lambda: {"side": S.trade_side("yes_price", F.lit(0.5))}, "CASE WHEN 0.5e0 < yes_price THEN 'sell_yes' WHEN 0.5e0 > yes_price THEN 'buy_yes' ELSE '' END AS side")
scalar("b12_series", "markets", "ticker, slot", lambda: {"series": S.series_of("event_ticker"), "subseries": S.subseries_of("event_ticker")}, "split_part(event_ticker, '-', 1) AS series, regexp_replace(event_ticker, '-[^-]*$', '') AS subseries")
scalar("b14_market_state", "markets", "ticker, slot", lambda: {"state": S.market_state("status", "result")}, "CASE WHEN status = 'settled' AND result IN ('yes', 'no') THEN 'resolved' WHEN status = 'settled' THEN 'void' ELSE 'open' END AS state")
scalar("b16_life_gate", "positions", "id", lambda: {"decile": S.life_decile(S.life_fraction(F.col("entered") + 12 * DAY, "entered", "closes")), "gate": S.life_gate(S.life_fraction(F.col("entered") + 12 * DAY, "entered", "closes"))}, f"least(9, CAST(floor({12 * DAY}e0 / (closes - entered) * 10) AS INTEGER)) AS decile, CASE WHEN {12 * DAY}e0 / (closes - entered) < 0.25 THEN 'frac_lt_0.25' WHEN {12 * DAY}e0 / (closes - entered) > 0.55 THEN 'frac_gt_0.55' ELSE 'eligible' END AS gate")
scalar("b19_gaps", "trades", "trade_id", lambda: {"gap": S.abs_gap("yes_price", "no_price"), "kl": S.kl_term("yes_price", "no_price")}, "abs(yes_price - no_price) AS gap, CASE WHEN yes_price > 1e-12 THEN yes_price * ln((yes_price + 1e-12) / (no_price + 1e-12)) ELSE 0e0 END AS kl")
scalar("b23_mid_from_quote", "trades", "trade_id", lambda: {"mid": S.mid_from_quote("no_price", "yes_price", F.col("yes_price"))}, "CASE WHEN no_price > 0 AND no_price < 1 AND yes_price > 0 AND yes_price < 1 AND yes_price >= no_price THEN (no_price + yes_price) / 2 WHEN yes_price > 0 AND yes_price < 1 THEN yes_price END AS mid")
scalar("b25_kelly_risk", "positions", "id", lambda: {"risk": S.kelly_risk("side", F.rint(F.col("entry_price") * 100), "edge_pp", F.lit(10000.0))}, """greatest(0e0, least((CASE WHEN side = 'sell_yes' THEN (round(entry_price * 100) / 100e0 - greatest(0.01e0, least(0.99e0, round(entry_price * 100) / 100e0 - edge_pp / 100e0))) / (round(entry_price * 100) / 100e0)
 ELSE (greatest(0.01e0, least(0.99e0, round(entry_price * 100) / 100e0 + edge_pp / 100e0)) - round(entry_price * 100) / 100e0) / (1 - round(entry_price * 100) / 100e0) END) * 0.25e0 * 10000e0, 0.01e0 * 10000e0)) AS risk""")
scalar("b26_equal_sigma_size", "positions", "id", lambda: {"size": S.equal_sigma_size((F.col("edge_pp") - 2) / 10, F.lit(10000.0))}, "CASE WHEN (edge_pp - 2) / 10e0 <= 0 THEN 0e0 ELSE least(0.02e0 * 10000e0 / ((edge_pp - 2) / 10e0 * sqrt(150e0)), 0.01e0 * 10000e0) END AS size")
_rr = lambda: S.risk_reward("side", "entry_price", "risk_cents")
scalar("b27_risk_reward", "positions", "id", lambda: {k: _rr()[k] for k in ("contracts", "risk", "reward")}, """greatest(1, CAST(floor(risk_cents / (CASE WHEN side = 'sell_yes' THEN 1 - entry_price ELSE entry_price END)) AS INTEGER)) AS contracts,
 greatest(1, CAST(floor(risk_cents / (CASE WHEN side = 'sell_yes' THEN 1 - entry_price ELSE entry_price END)) AS INTEGER)) * (CASE WHEN side = 'sell_yes' THEN 1 - entry_price ELSE entry_price END) AS risk,
 greatest(1, CAST(floor(risk_cents / (CASE WHEN side = 'sell_yes' THEN 1 - entry_price ELSE entry_price END)) AS INTEGER)) * (CASE WHEN side = 'sell_yes' THEN entry_price ELSE 1 - entry_price END) AS reward""")
_PNL = "CASE WHEN (side = 'sell_yes' AND result = 'no') OR (side = 'buy_yes' AND result = 'yes') THEN reward_cents ELSE -risk_cents END"
scalar("b28_binary_pnl", "positions", "id", lambda: {"pnl": S.binary_pnl("side", "result", "reward_cents", "risk_cents", F.lit(0)).cast("long")}, f"CAST({_PNL} AS BIGINT) AS pnl")
scalar("b29_per_bet_return", "positions", "id", lambda: {"ret": S.per_bet_return("side", "entry_price", "result")}, "CASE WHEN side = 'sell_yes' AND result = 'no' THEN entry_price / (1 - entry_price) WHEN side = 'buy_yes' AND result = 'yes' THEN (1 - entry_price) / entry_price ELSE -1e0 END AS ret")
scalar("b33_score", "positions", "id", lambda: {"score": S.score("entry_price", F.col("edge_pp") / 50, "risk_cents")}, "200 * entry_price - (CASE WHEN edge_pp / 50e0 > 0.2 THEN ((edge_pp / 50e0 - 0.2e0) / 0.1e0) * ((edge_pp / 50e0 - 0.2e0) / 0.1e0) * 200 ELSE 0 END) - (CASE WHEN risk_cents < 20 THEN 10e0 * (20 - risk_cents) ELSE 0 END) AS score")
scalar("b37_hours_to_expiry", "positions", "id", lambda: {"hours": S.hours_to_expiry("closes", F.lit(900_000_000_000_000))}, "(closes - 900000000000000) / 3.6e9 AS hours")
query("b07_wilson_ci", "SELECT *, greatest(0e0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) AS low FROM (SELECT category, count(*) AS n, count(*) FILTER (result = 'yes') / CAST(count(*) AS DOUBLE) AS p FROM positions GROUP BY category) x", ("positions",))(
    lambda p: p.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "yes").alias("k")).select("category", "n", (F.col("k") / F.col("n")).alias("p"), S.wilson_ci("k", "n")["low"].alias("low"))
)
_ERF_SQL = "(CASE WHEN abs(x) > 5.2 THEN sign(x) * 1e0 ELSE 1.1283791670955126e0 * x * exp(-x * x) * (" + "1e0 + (2 * x * x) / " .join([""] + [f"{2 * k + 1}e0 * (" for k in range(1, 96 + 1)]).removeprefix("") + "1e0" + ")" * 96 + ") END)"
query("b17_normal_cdf", f"SELECT id, 0.5e0 * (1 + {_ERF_SQL}) AS cdf FROM (SELECT id, (entry_price * 8 - 4) / 1.4142135623730951e0 AS x FROM positions) z", ("positions",))(lambda p: p.select("id", S.normal_cdf(F.col("entry_price") * 8 - 4).alias("cdf")))

# --- joins ----------------------------------------------------------------------------------------------------------

_RESOLVED = f"SELECT *, (opened + closed) // 2 AS mid, {S.category_sql('event_ticker')} AS category FROM markets WHERE result IN ('yes', 'no') AND volume >= 10 AND closed > opened"
_LAST = "SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id DESC) = 1"
_PIT = f"""SELECT *, CAST(round_even(yes_price * 100, 0) AS INTEGER) AS cents FROM (
 SELECT m.*, t.t AS trade_t, t.yes_price, t.trade_id, abs(t.t - m.mid) / CAST(m.closed - m.opened AS DOUBLE) AS offset_frac FROM ({_RESOLVED}) m ASOF JOIN ({_LAST}) t ON m.ticker = t.ticker AND m.mid >= t.t) j WHERE offset_frac <= 0.25"""
query("b13_resolved_filter", "SELECT ticker, slot, volume FROM markets WHERE result IN ('yes', 'no') AND volume >= 10 AND closed > opened", ("markets",))(lambda m: C.resolved(m).select("ticker", "slot", "volume"))
query("c01_asof_join", f"SELECT ticker, slot, trade_id, cents, offset_frac FROM ({_PIT}) p", ("trades", "markets"))(lambda t, m: C.pit_prices(t, m).select("ticker", "slot", "trade_id", "cents", "offset_frac"))
query("c02_asof_left", f"SELECT m.ticker, m.slot, t.trade_id FROM markets m ASOF LEFT JOIN ({_LAST}) t ON m.ticker = t.ticker AND m.opened >= t.t", ("trades", "markets"))(
    lambda t, m: A.asof_join(m, t.select("ticker", F.col("t").alias("tt"), "trade_id"), ["ticker"], "opened", "tt", "left", "trade_id", slice_us=5 * DAY).select("ticker", "slot", "trade_id")
)
query("c03_asof_global", "SELECT id, t.trade_id FROM (SELECT id, 1704067200000000 + id % 700 * 3600000000 AS at FROM positions) p ASOF LEFT JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY t ORDER BY trade_id DESC) = 1) t ON p.at >= t.t", ("positions", "trades"))(
    lambda p, t: A.asof_join_global(p.select("id", (F.lit(1704067200000000) + F.col("id") % 700 * HOUR).alias("at")), t.select("t", "trade_id"), "at", "t", tie="trade_id").select("id", "trade_id")
)
query("c04_asof_fallback", f"""SELECT m.ticker, m.slot, coalesce(b.trade_id, f.trade_id) AS trade_id FROM markets m
 ASOF LEFT JOIN ({_LAST}) b ON m.ticker = b.ticker AND m.opened >= b.t
 ASOF LEFT JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t ORDER BY trade_id) = 1) f ON m.ticker = f.ticker AND m.opened < f.t WHERE coalesce(b.trade_id, f.trade_id) IS NOT NULL""", ("trades", "markets"))(
    lambda t, m: A.asof_with_fallback(m, t.select("ticker", F.col("t").alias("tt"), "trade_id"), ["ticker"], "opened", "tt", "forward", "trade_id").select("ticker", "slot", "trade_id")
)
query("c06_semi_join", "SELECT trade_id FROM trades WHERE ticker IN (SELECT ticker FROM markets WHERE result = 'yes' AND volume >= 25)", ("trades", "markets"))(lambda t, m: A.restrict_to(t, m.where("result = 'yes' AND volume >= 25"), ["ticker"]).select("trade_id"))
query("c07_anti_join", "SELECT trade_id FROM trades WHERE ticker NOT IN (SELECT ticker FROM markets WHERE result = 'yes' AND volume >= 25)", ("trades", "markets"))(lambda t, m: A.exclude_known(t, m.where("result = 'yes' AND volume >= 25"), ["ticker"]).select("trade_id"))
query("c09_shifted_self_join", "SELECT a.symbol, a.t, b.rate AS later FROM funding a LEFT JOIN funding b ON a.symbol = b.symbol AND b.t = a.t + 3600000000", ("funding",))(lambda f: A.shifted_self_join(f, ["symbol"], "t", "rate", HOUR).select("symbol", "t", "later"))
query("c12_snapshot_grid", f"SELECT ticker, slot, unnest(range(((opened + {6 * HOUR} - 1) // {6 * HOUR}) * {6 * HOUR}, closed + 1, {6 * HOUR})) AS t FROM markets", ("markets",))(lambda m: A.snapshot_grid(m, "opened", "closed", 6 * HOUR).select("ticker", "slot", "t"))
_IV = f"(SELECT id, concat('C', CAST(id % 10 AS STRING)) AS symbol, 1704067200000000 + id % 600 * {HOUR} AS a, 1704067200000000 + (id % 600 + id % 37) * {HOUR} AS z FROM positions)"
query("c13_interval_sum", f"SELECT v.id, CAST(coalesce(sum(f.rate), 0) AS BIGINT) AS total FROM {_IV} v LEFT JOIN funding f ON v.symbol = f.symbol AND f.t >= v.a AND f.t < v.z GROUP BY v.id", ("positions", "funding"))(
    lambda p, f: A.interval_sum_join(p.select("id", F.concat(F.lit("C"), (F.col("id") % 10).cast("string")).alias("symbol"), (F.lit(1704067200000000) + F.col("id") % 600 * HOUR).alias("a"), (F.lit(1704067200000000) + (F.col("id") % 600 + F.col("id") % 37) * HOUR).alias("z")), f, ["symbol"], "a", "z", "t", "rate").select("id", F.col("total").cast("long").alias("total"))
)
_POS_T = "(SELECT *, concat('T', CAST(id % 150 AS STRING)) AS tk, 1704067200000000 + id % 700 * 3600000000 AS at FROM positions)"
query("c14_closing_lines", f"SELECT p.id, t.yes_price AS line, 'trade' AS line_source FROM {_POS_T} p ASOF JOIN ({_LAST}) t ON p.tk = t.ticker AND p.at >= t.t", ("positions", "trades"))(
    lambda p, t: A.closing_lines(p.withColumns({"ticker": F.concat(F.lit("T"), (F.col("id") % 150).cast("string")), "closes": F.lit(1704067200000000) + F.col("id") % 700 * HOUR}), t, None).select("id", "line", "line_source")
)
query("c17_null_shuffle", """WITH a AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM positions), b AS (SELECT edge_pp, row_number() OVER (ORDER BY CAST(id * 7919 % 10007 AS DOUBLE), id) AS r FROM positions) SELECT a.id, b.edge_pp FROM a JOIN b ON a.r = b.r""".replace("WITH a AS", ", a AS", 1), ("positions",))(
    lambda p: A.null_shuffle(p.select("id", "edge_pp"), ["id"], (F.col("id") * 7919 % 10007).cast("double"), ["edge_pp"])
)
ORACLE_SQL["c17_null_shuffle"] = ORACLE_SQL["c17_null_shuffle"].replace(")\n, a AS", "),\n a AS")

# --- calibration ----------------------------------------------------------------------------------------------------

_BINS = f"""SELECT scope, bin_low, bin_low + 5 AS bin_high, n, yes_count, sum_volume / CAST(n AS DOUBLE) AS avg_volume, k / n AS actual_rate,
 greatest(0e0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) AS ci_low,
 least(1e0, (k / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n)) AS ci_high,
 abs(k / n - i) - 0.14e0 * i * (1 - i) AS fee_adj_edge,
 CASE WHEN n >= 10 AND abs(k / n - i) * 100 >= 3 AND abs(k / n - i) - 0.14e0 * i * (1 - i) > 0 THEN CASE WHEN k / n < i THEN 'sell_yes' WHEN k / n > i THEN 'buy_yes' ELSE '' END ELSE '' END AS side FROM (
 SELECT coalesce(category, 'aggregate') AS scope, bin_low, (bin_low + 2.5e0) / 100e0 AS i, count(*) AS n, CAST(count(*) FILTER (result = 'yes') AS DOUBLE) AS k, count(*) FILTER (result = 'yes') AS yes_count, CAST(sum(volume) AS BIGINT) AS sum_volume
 FROM (SELECT *, CAST(floor(cents / 5) * 5 AS INTEGER) AS bin_low FROM ({_PIT}) p WHERE cents BETWEEN 1 AND 99) q GROUP BY GROUPING SETS ((category, bin_low), (bin_low))) g"""


def _bins(t, m):
    return C.calibration_bins(C.pit_prices(t, m))


query("d01_calibration_bins", _BINS, ("trades", "markets"))(_bins)
query("e01_time_split", "SELECT closes AS cutoff FROM positions ORDER BY closes LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.7e0) AS BIGINT) FROM positions)", ("positions",))(lambda p: C.time_split(p, "closes"))
_CURVES = f"curves AS ({_BINS})"
_TRADED = """traded AS (SELECT * FROM (SELECT q.*, (q.bin_low + 2.5e0) / 100 AS implied, coalesce(o.actual_rate, a.actual_rate) AS actual,
 abs((q.bin_low + 2.5e0) / 100 - coalesce(o.actual_rate, a.actual_rate)) * 100 AS edge_pp, CASE WHEN coalesce(o.actual_rate, a.actual_rate) < (q.bin_low + 2.5e0) / 100 THEN 'sell_yes' ELSE 'buy_yes' END AS trade_side
 FROM (SELECT *, CAST(floor(cents / 5) * 5 AS INTEGER) AS bin_low FROM (%s) p) q LEFT JOIN (SELECT * FROM curves WHERE n >= 5) o ON o.scope = q.category AND o.bin_low = q.bin_low LEFT JOIN (SELECT * FROM curves WHERE n >= 5 AND scope = 'aggregate') a ON a.bin_low = q.bin_low) z WHERE actual IS NOT NULL)""" % _PIT


def _traded(t, m):
    pit = C.pit_prices(t, m)
    return C.bin_lookup(pit, C.calibration_bins(pit), min_n=5)


def traded_query(name: str, sql: str | None):
    def add(f):
        query(name, None, ("trades", "markets"))(lambda t, m: f(_traded(t, m)))
        if sql:
            ORACLE_SQL[name] = with_relations("", "trades", "markets").rstrip() + f",\n{_CURVES},\n{_TRADED}\n{sql}"
        return f

    return add


_RET = "CASE WHEN (trade_side = 'sell_yes' AND result = 'no') THEN (cents / 100e0) / nullif(1 - cents / 100e0, 0) WHEN (trade_side <> 'sell_yes' AND result = 'yes') THEN (1 - cents / 100e0) / nullif(cents / 100e0, 0) ELSE -1e0 END"
traded_query("c10_bin_lookup", "SELECT ticker, slot, implied, actual, edge_pp, trade_side FROM traded")(lambda x: x.select("ticker", "slot", "implied", "actual", "edge_pp", "trade_side"))
traded_query("d06_return_strata", f"""SELECT category, side, bin_low, n, win_rate, mean, sigma FROM (SELECT category, trade_side AS side, bin_low, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(ret) AS mean, stddev_samp(ret) AS sigma FROM (SELECT *, {_RET} AS ret FROM traded) r
 GROUP BY GROUPING SETS ((), (trade_side), (category), (trade_side, bin_low))) g WHERE bin_low IS NULL OR n >= 10""")(lambda x: C.return_strata(C.bet_returns(x)).select("category", "side", "bin_low", "n", "win_rate", "mean", "sigma"))
traded_query("d05_sigma_table", f"""SELECT g.level, g.category, g.side, g.bin_low, g.n, g.mean, g.sigma, CASE WHEN g.level = 'bin' THEN sqrt((g.n * g.sigma * g.sigma + 200 * p.sigma * p.sigma) / (g.n + 200)) ELSE g.sigma END AS shrunk FROM (
 SELECT CASE WHEN bin_low IS NOT NULL THEN 'bin' WHEN category IS NOT NULL THEN 'pool' ELSE 'aggregate' END AS level, category, trade_side AS side, bin_low, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sigma FROM (SELECT *, {_RET} AS ret FROM traded) r GROUP BY GROUPING SETS ((category, trade_side, bin_low), (category, trade_side), ())) g
 LEFT JOIN (SELECT category, trade_side AS side, stddev_samp({_RET}) AS sigma FROM traded GROUP BY category, trade_side) p ON g.category = p.category AND g.side = p.side WHERE g.level <> 'bin' OR g.n >= 5""")(lambda x: C.sigma_table(C.bet_returns(x)).select("level", "category", "side", "bin_low", "n", "mean", "sigma", "shrunk"))
traded_query("d36_category_results", f"SELECT category, trade_side, count(*) AS trades, sum({_RET}) AS total, avg(CASE WHEN {_RET} > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(edge_pp) AS mean_edge FROM traded GROUP BY category, trade_side")(C.category_results)

# --- books ----------------------------------------------------------------------------------------------------------

_BOOK = f"(SELECT *, CAST(CASE WHEN status = 'closed' THEN {_PNL} ELSE 0 END AS BIGINT) AS pnl, entered // {DAY} AS eday, closes // {DAY} AS cday FROM positions)"
query("d08_category_breakdown", f"""SELECT category, count(*) FILTER (status = 'open') AS open, CAST(sum(CASE WHEN status = 'open' THEN risk_cents ELSE 0 END) AS BIGINT) AS locked, CAST(sum(CASE WHEN status = 'open' THEN reward_cents ELSE 0 END) AS BIGINT) AS upside, avg(CASE WHEN status = 'open' THEN edge_pp END) AS avg_edge,
 count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (status = 'closed' AND pnl > 0) AS wins, count(*) FILTER (status = 'closed' AND pnl <= 0) AS losses, CAST(sum(pnl) AS BIGINT) AS pnl, count(*) FILTER (status = 'voided') AS voided FROM {_BOOK} b GROUP BY category""", ("positions",))(K.category_breakdown)
query("d09_portfolio_summary", f"""SELECT category, CAST(1000000 + sum(pnl) AS BIGINT) AS nav, CAST(1000000 + sum(pnl) - sum(CASE WHEN status = 'open' THEN risk_cents ELSE 0 END) AS BIGINT) AS cash, CAST(sum(CASE WHEN status = 'open' THEN risk_cents ELSE 0 END) AS BIGINT) AS locked, count(*) FILTER (status = 'open') AS open, count(*) FILTER (eday = 10000) AS trades_today, CAST(sum(pnl) AS BIGINT) AS realized FROM {_BOOK} b GROUP BY category""", ("positions",))(lambda p: K.portfolio_summary(p, 1_000_000, 10_000, ["category"]))
query("d10_exposures", """SELECT CASE WHEN event_ticker IS NOT NULL THEN 'event' WHEN side IS NOT NULL THEN 'side' WHEN series IS NOT NULL THEN 'series' ELSE 'ticker' END AS scope, coalesce(event_ticker, side, series, ticker) AS key, CAST(sum(risk_cents) AS BIGINT) AS risk, count(*) AS positions
 FROM positions WHERE status = 'open' GROUP BY GROUPING SETS ((event_ticker), (side), (series), (ticker))""", ("positions",))(K.exposures)
query("d11_daily_snapshots", f"""SELECT day, CAST(1000000 + sum(p) OVER w AS BIGINT) AS nav, CAST(sum(l) OVER w AS BIGINT) AS locked, CAST(sum(o - e) OVER w AS BIGINT) AS open, CAST(o AS BIGINT) AS trades, CAST(p AS BIGINT) AS realized FROM (SELECT day, sum(o) AS o, sum(e) AS e, sum(l) AS l, sum(p) AS p FROM (
 SELECT eday AS day, 1 AS o, 0 AS e, risk_cents AS l, 0 AS p FROM {_BOOK} a UNION ALL SELECT cday, 0, 1, -risk_cents, pnl FROM {_BOOK} b WHERE status <> 'open') u GROUP BY day) g WINDOW w AS (ORDER BY day)""", ("positions",))(lambda p: K.daily_snapshots(p, 1_000_000))
query("i13_open_interest", f"SELECT day, CAST(sum(n) OVER w AS BIGINT) AS open, CAST(sum(r) OVER w AS BIGINT) AS risk FROM (SELECT day, sum(n) AS n, sum(r) AS r FROM (SELECT eday AS day, 1 AS n, risk_cents AS r FROM {_BOOK} a UNION ALL SELECT cday, -1, -risk_cents FROM {_BOOK} b) u GROUP BY day) g WINDOW w AS (ORDER BY day)", ("positions",))(K.open_interest_curve)
query("e11_cum_pnl", f"SELECT category, id, closes, CAST(sum(pnl) OVER (PARTITION BY category ORDER BY closes, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_pnl FROM {_BOOK} b WHERE status = 'closed'", ("positions",))(K.cum_pnl)
query("d37_closed_book", f"SELECT count(*) AS closed, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl <= 0) AS losses, CAST(sum(pnl) AS BIGINT) AS pnl FROM {_BOOK} b WHERE status = 'closed'", ("positions",))(K.closed_book_summary)
_TOPK = f"SELECT *, entered // {DAY} AS day, row_number() OVER (PARTITION BY entered // {DAY} ORDER BY edge_pp DESC, ticker, id) AS place FROM positions QUALIFY place <= 3"
query("f04_daily_topk", f"SELECT day, place, id, edge_pp FROM ({_TOPK}) x", ("positions",))(lambda p: K.daily_topk(p, 3).select("day", "place", "id", "edge_pp"))
query("i14_admission_screen", f"SELECT day, id, event_risk FROM (SELECT *, CAST(sum(risk_cents) OVER (PARTITION BY day, event_ticker ORDER BY place ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_risk FROM ({_TOPK}) x) y WHERE event_risk <= 60", ("positions",))(lambda p: K.admission_screen(p, 3, 60).select("day", "id", "event_risk"))
query("i19_rolling_quality", "SELECT id, avg(edge_pp) OVER w AS prior_mean, coalesce(edge_pp >= avg(edge_pp) OVER w, true) AS admit FROM positions WINDOW w AS (PARTITION BY category ORDER BY entered, id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)", ("positions",))(lambda p: K.rolling_quality(p).select("id", "prior_mean", "admit"))
query("f05_top_quantile", "SELECT id, risk_cents FROM positions WHERE risk_cents >= (SELECT quantile_cont(risk_cents, 0.9) FROM positions)", ("positions",))(lambda p: K.top_quantile(p, "risk_cents").select("id", "risk_cents"))
query("d34_value_counts", "SELECT series AS value, count(*) AS n FROM positions GROUP BY series", ("positions",))(lambda p: K.value_counts(p, "series"))
query("i16_screen_candidates", f"""SELECT id, CASE WHEN entry_price < 0.1 THEN 'price_low' WHEN entry_price > 0.9 THEN 'price_high' WHEN (entered // {DAY} * {DAY} + 0e0 + {10 * DAY} - entered) / (closes - entered) < 0.25 THEN 'frac_lt_0.25' WHEN (entered // {DAY} * {DAY} + 0e0 + {10 * DAY} - entered) / (closes - entered) > 0.55 THEN 'frac_gt_0.55' ELSE 'eligible' END AS verdict FROM positions""", ("positions",))(
    lambda p: K.screen_candidates(p.withColumns({"closes": F.col("closes") - F.col("entered"), "entered": F.col("entered") % DAY * 0}), 10 * DAY).select("id", "verdict")
)
_CLV = f"SELECT p.id, p.status, p.side, p.category, CASE WHEN p.side = 'sell_yes' THEN (p.entry_price - t.yes_price) * 100 ELSE (t.yes_price - p.entry_price) * 100 END AS clv FROM {_POS_T} p ASOF JOIN ({_LAST}) t ON p.tk = t.ticker AND p.at >= t.t"


def _clv(p, t):
    return K.clv(A.closing_lines(p.withColumns({"ticker": F.concat(F.lit("T"), (F.col("id") % 150).cast("string")), "closes": F.lit(1704067200000000) + F.col("id") % 700 * HOUR}), t, None))


query("b24_clv", f"SELECT id, clv FROM ({_CLV}) c", ("positions", "trades"))(lambda p, t: _clv(p, t).select("id", "clv"))
query("d07_clv_summary", f"""SELECT CASE WHEN status IS NOT NULL THEN 'status' WHEN side IS NOT NULL THEN 'side' WHEN category IS NOT NULL THEN 'category' ELSE 'all' END AS scope, coalesce(status, side, category, 'all') AS key, count(*) AS n, avg(clv) AS mean, median(clv) AS median, coalesce(stddev_samp(clv), 0) AS sigma, avg(CASE WHEN clv > 0 THEN 1e0 ELSE 0e0 END) AS beat_rate FROM ({_CLV}) c GROUP BY GROUPING SETS ((), (status), (side), (category))""", ("positions", "trades"))(lambda p, t: K.clv_summary(_clv(p, t)))
_HELD = "concat('T', CAST(id % 200 AS STRING), '-', CAST(id % 3 AS STRING))"
_SLOTS = "(SELECT * REPLACE (concat(ticker, '-', CAST(slot AS STRING)) AS ticker) FROM markets)"


def _held(p):
    """Positions in the market of one slot each."""
    return p.withColumn("ticker", F.concat(F.lit("T"), (F.col("id") % 200).cast("string"), F.lit("-"), (F.col("id") % 3).cast("string")))


def _slots(m):
    return m.withColumn("ticker", F.concat("ticker", F.lit("-"), F.col("slot").cast("string")))


query("i18_settle", f"""SELECT p.id, p.ticker, p.category, CASE WHEN m.status IS NULL THEN 'missing' WHEN m.status = 'settled' THEN 'resolved' ELSE 'open' END AS state, CAST(CASE WHEN m.status = 'settled' THEN CASE WHEN (p.side = 'sell_yes' AND m.result = 'no') OR (p.side = 'buy_yes' AND m.result = 'yes') THEN reward_cents ELSE -risk_cents END ELSE 0 END AS BIGINT) AS pnl
 FROM (SELECT * REPLACE ({_HELD} AS ticker) FROM positions WHERE status = 'open') p LEFT JOIN {_SLOTS} m ON p.ticker = m.ticker""", ("positions", "markets"))(lambda p, m: K.settle(_held(p), _slots(m)))
query("i17_shadow_replay", f"""SELECT reason, count(*) AS n, CAST(sum(CASE WHEN (side = 'sell_yes' AND m.result = 'no') OR (side = 'buy_yes' AND m.result = 'yes') THEN reward_cents ELSE -risk_cents END) AS BIGINT) AS pnl FROM (SELECT *, {_HELD} AS tk, CASE WHEN id % 5 = 0 THEN 'cap' ELSE 'price' END AS reason FROM positions WHERE status = 'voided') p JOIN {_SLOTS} m ON p.tk = m.ticker GROUP BY reason""", ("positions", "markets"))(
    lambda p, m: K.shadow_replay(_held(p.where("status = 'voided'")).withColumn("reason", F.when(F.col("id") % 5 == 0, "cap").otherwise("price")), _slots(m))
)

# --- bars -----------------------------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY i)"
query("a02_bars", "SELECT symbol, i, open, high, low, close FROM bars", ("bars",))(lambda b: b.select("symbol", "i", "open", "high", "low", "close"))
query("e03_stochastic_k", "SELECT symbol, i, CASE WHEN n = 14 THEN (close - lo) / nullif(hi - lo, 0) * 100 END AS stoch_k FROM (SELECT *, min(low) OVER f AS lo, max(high) OVER f AS hi, count(*) OVER f AS n FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)) x", ("bars",))(lambda b: B.stochastic_k(b).select("symbol", "i", "stoch_k"))
query("e04_rsi", """SELECT symbol, i, CASE WHEN n = 14 THEN 100 - 100 / (1 + u / nullif(l, 0)) END AS rsi FROM (SELECT symbol, i, avg(greatest(d, 0)) OVER f AS u, avg(greatest(-d, 0)) OVER f AS l, count(d) OVER f AS n FROM (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY i) AS d FROM bars) x WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)) y""", ("bars",))(lambda b: B.rsi(b).select("symbol", "i", "rsi"))
query("e08_log_return", f"SELECT symbol, i, ln(close / lag(close) OVER w) AS log_ret FROM bars {_W}", ("bars",))(lambda b: B.log_return(b).select("symbol", "i", "log_ret"))
query("e09_forward_return", f"SELECT symbol, i, lead(close, 3) OVER w / close - 1 AS fwd_ret FROM bars {_W}", ("bars",))(lambda b: B.forward_return(b, 3).select("symbol", "i", "fwd_ret"))
query("e12_drawdown", f"SELECT symbol, i, max(close) OVER w AS peak, (max(close) OVER w - close) / max(close) OVER w AS drawdown FROM bars {_W}", ("bars",))(lambda b: B.drawdown_series(b).select("symbol", "i", "peak", "drawdown"))
query("e13_cum_min", f"SELECT symbol, i, min(low) OVER w AS cum_min FROM bars {_W}", ("bars",))(lambda b: B.cum_min(b, "low", ["symbol"], "i").select("symbol", "i", "cum_min"))
query("e14_equal_slices", "SELECT symbol, i, CAST(least(i // (count(*) OVER (PARTITION BY symbol) // 7), 6) AS INTEGER) AS slice FROM bars", ("bars",))(lambda b: B.equal_slices(b, 7, ["symbol"], "i").select("symbol", "i", "slice"))
query("e15_local_extrema", "SELECT symbol, i, n = 5 AND low = lo AS is_low, n = 5 AND high = hi AS is_high FROM (SELECT *, min(low) OVER f AS lo, max(high) OVER f AS hi, count(*) OVER f AS n FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) x", ("bars",))(lambda b: B.local_extrema(b).select("symbol", "i", "is_low", "is_high"))
query("e19_rolling_range", "SELECT symbol, i, CASE WHEN n = 30 THEN lo END AS support, CASE WHEN n = 30 THEN hi END AS resistance FROM (SELECT *, min(low) OVER f AS lo, max(high) OVER f AS hi, count(*) OVER f AS n FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) x", ("bars",))(lambda b: B.rolling_range(b, 30).select("symbol", "i", "support", "resistance"))
_UP = "(SELECT *, close > open AS up FROM bars)"
query("e16_runs", f"SELECT symbol, i, CAST(run AS INTEGER) AS run, min(i) OVER v AS run_start, min(low) OVER v AS run_low FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(up) OVER w IS NOT DISTINCT FROM up AND lag(i) OVER w IS NOT NULL THEN 0 ELSE 1 END AS c FROM {_UP} a {_W}) x) y WINDOW v AS (PARTITION BY symbol, run ORDER BY i)", ("bars",))(lambda b: B.runs(b.withColumn("up", F.col("close") > F.col("open")), "up").select("symbol", "i", "run", "run_start", "run_low"))
query("e17_previous_event", f"SELECT symbol, i, last_value(CASE WHEN up THEN i END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_i FROM {_UP} a", ("bars",))(lambda b: B.previous_event(b.withColumn("up", F.col("close") > F.col("open")), "up", ["i"]).select("symbol", "i", "prev_i"))
query("e18_first_confirm", f"SELECT symbol, i, CASE WHEN lead(close, 1) OVER w > close THEN 1 WHEN lead(close, 2) OVER w > close THEN 2 WHEN lead(close, 3) OVER w > close THEN 3 END AS confirm FROM bars {_W}", ("bars",))(lambda b: B.first_confirm(b, 3, lambda c: c > F.col("close")).select("symbol", "i", "confirm"))
query("e10_resample_last", f"SELECT s.ticker, s.step_t, g.last FROM (SELECT ticker, unnest(range(min(t // {6 * HOUR}) * {6 * HOUR}, max(t // {6 * HOUR}) * {6 * HOUR} + 1, {6 * HOUR})) AS step_t FROM trades GROUP BY ticker) s LEFT JOIN (SELECT ticker, t // {6 * HOUR} * {6 * HOUR} AS step_t, yes_price AS last FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, t // {6 * HOUR} ORDER BY t DESC, trade_id DESC) = 1) g USING (ticker, step_t)", ("trades",))(lambda t: B.resample_last(t, 6 * HOUR, ["ticker"], "t", "yes_price", "trade_id"))
query("d23_coin_profile", """SELECT symbol, count(*) AS bars, stddev_samp(r) * sqrt(365e0) AS vol, avg(abs(r)) AS mean_abs, max(dd) AS max_dd FROM (SELECT symbol, close / lag(close) OVER w - 1 AS r, (max(close) OVER w - close) / max(close) OVER w AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)) x GROUP BY symbol HAVING count(*) >= 30""", ("bars",))(lambda b: B.coin_profile(b).drop("autocorr"))

# --- ladders ----------------------------------------------------------------------------------------------------------

_PANEL = "(SELECT event, t, strike, CAST(mass AS DOUBLE) / sum(mass) OVER (PARTITION BY event, t) AS p, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY event, t) AS q FROM ladder)"


def _panel(l):  # noqa: E741
    p = L.normalize_ladder(l, "mass").select("event", "t", "strike", "p")
    return p.join(L.normalize_ladder(l, "n").select("event", "t", "strike", F.col("p").alias("q")), ["event", "t", "strike"])


query("d12_normalize_ladder", "SELECT *, strikes / CAST(max(strikes) OVER (PARTITION BY event) AS DOUBLE) AS completeness FROM (SELECT event, t, strike, CAST(mass AS DOUBLE) / sum(mass) OVER (PARTITION BY event, t) AS p, count(*) OVER (PARTITION BY event, t) AS strikes FROM ladder) x", ("ladder",))(lambda l: L.normalize_ladder(l).select("event", "t", "strike", "p", "strikes", "completeness"))
query("d13_events_by_count", "SELECT event, CAST(sum(n) AS BIGINT) AS trades FROM ladder GROUP BY event HAVING sum(n) >= 500", ("ladder",))(lambda l: L.events_by_count(l, 500))
query("c08_join_panels", f"SELECT event, t, strike, p, q FROM {_PANEL} x", ("ladder",))(_panel)
_SNAP = f"(SELECT event, t, max(abs(p - q)) AS max_gap, avg(abs(p - q)) AS mean_gap, sum(CASE WHEN p > 1e-12 THEN p * ln((p + 1e-12) / (q + 1e-12)) ELSE 0 END) AS kl, count(*) AS buckets FROM {_PANEL} x GROUP BY event, t)"
query("d14_snapshot_metrics", f"SELECT * FROM {_SNAP} s", ("ladder",))(lambda l: L.snapshot_metrics(_panel(l)))
query("d15_fold_stats", f"""SELECT fold, count(*) AS n, avg(CASE WHEN max_gap > 0.03 THEN 1e0 ELSE 0e0 END) AS over, median(max_gap) AS median, quantile_cont(max_gap, 0.9) AS p90, avg(kl) AS mean_kl, count(change) AS pairs FROM (SELECT a.*, b.max_gap - a.max_gap AS change, a.t // {30 * DAY} % 3 AS fold FROM {_SNAP} a LEFT JOIN {_SNAP} b ON a.event = b.event AND b.t = a.t + {30 * DAY}) x GROUP BY fold""", ("ladder",))(lambda l: L.fold_stats(L.snapshot_metrics(_panel(l)).withColumn("fold", (F.col("t") / (30 * DAY)).cast("long") % 3), "fold", 30 * DAY).drop("beta", "half_life"))
query("d16_ols", f"SELECT event, n, slope, intercept, slope / nullif(sqrt(greatest(0, syy - slope * slope * sxx) / nullif(n - 2, 0) / nullif(sxx, 0)), 0) AS t_stat, r2 FROM (SELECT event, count(*) AS n, regr_slope(kl, max_gap) AS slope, regr_intercept(kl, max_gap) AS intercept, regr_r2(kl, max_gap) AS r2, regr_sxx(kl, max_gap) AS sxx, regr_syy(kl, max_gap) AS syy FROM {_SNAP} s GROUP BY event) x", ("ladder",))(lambda l: L.ols(L.snapshot_metrics(_panel(l)), "max_gap", "kl", ["event"], 3))
query("d18_signed_gap", f"SELECT strike AS position, count(*) AS n, avg(p - q) AS mean, stddev_samp(p - q) AS sigma, median(p - q) AS median FROM {_PANEL} x GROUP BY strike", ("ladder",))(lambda l: L.signed_gap_table(_panel(l), "strike").drop("t_stat"))
query("d19_gap_by_decile", f"SELECT decile, count(*) AS n, avg(max_gap) AS mean_gap, median(max_gap) AS median_gap, avg(kl) AS mean_kl FROM (SELECT s.*, least(9, CAST(floor((s.t - o) / CAST(c - o AS DOUBLE) * 10) AS INTEGER)) AS decile FROM {_SNAP} s JOIN (SELECT event, min(t) AS o, max(t) AS c FROM ladder GROUP BY event) e USING (event)) x GROUP BY decile", ("ladder",))(lambda l: L.gap_by_decile(L.snapshot_metrics(_panel(l)), l.groupBy("event").agg(F.min("t").alias("opened"), F.max("t").alias("closed"))))

# --- runs, signals and outcomes ------------------------------------------------------------------------------------------

_TF = "json_extract_string(config, '$.timeframe')"
query("d29_coverage", f"SELECT template, {_TF} AS timeframe, count(*) AS attempts, count(*) FILTER (status = 'scored') AS scored, max(CASE WHEN status = 'scored' THEN score END) AS best FROM runs GROUP BY 1, 2", ("runs",))(O.coverage_summary)
query("d27_status_rollup", "SELECT template, cohort, count(*) AS n, count(*) FILTER (status = 'scored') AS scored, CASE WHEN bool_or(status = 'catastrophic') THEN -1000e0 ELSE avg(CASE WHEN status = 'scored' THEN score END) END AS mean, max(CASE WHEN status = 'scored' THEN score END) AS best, CASE WHEN bool_or(status = 'catastrophic') THEN 'catastrophic' WHEN count(*) FILTER (status = 'scored') = 0 THEN 'rejected' ELSE 'scored' END AS status FROM runs GROUP BY template, cohort", ("runs",))(lambda r: O.status_rollup(r, ["template", "cohort"]))
query("d28_fold_rollup", "SELECT template, user_id, count(*) FILTER (status = 'scored') AS scored, avg(CASE WHEN status = 'scored' THEN score END) AS mean, min(CASE WHEN status = 'scored' THEN score WHEN status = 'catastrophic' THEN -1000 ELSE -9999 END) AS worst, count(*) AS folds, CASE WHEN count(*) FILTER (status = 'scored') >= 2 THEN stddev_pop(CASE WHEN status = 'scored' THEN score END) ELSE 0 END AS sigma, count(*) FILTER (status = 'scored') = count(*) AS consistent FROM runs GROUP BY template, user_id", ("runs",))(lambda r: O.fold_rollup(r, ["template", "user_id"]))
query("d30_search_report", "SELECT template, count(*) AS n, count(s) AS scored, count(s) / CAST(count(*) AS DOUBLE) AS rate, max(s) AS best, max(CASE WHEN r = m - m // 2 THEN s END) AS median, avg(CASE WHEN r <= 10 THEN s END) AS top_mean FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY s DESC NULLS LAST, id) AS r, count(s) OVER (PARTITION BY template) AS m FROM (SELECT *, CASE WHEN status = 'scored' THEN score END AS s FROM runs) x) y GROUP BY template", ("runs",))(O.search_report)
query("f01_top_configs", "SELECT template, place, id, score FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY score DESC, id) AS place FROM runs WHERE status = 'scored') x WHERE place <= 5", ("runs",))(lambda r: O.top_configs(r, 5).select("template", "place", "id", "score"))
query("f02_stagnation", "SELECT to_json(list(template ORDER BY id DESC)) AS templates, count(*) = 12 AND count(DISTINCT template) = 1 AS stagnant FROM (SELECT * FROM runs ORDER BY id DESC LIMIT 12) x", ("runs",))(lambda r: O.stagnation(r, 12).select(F.to_json("templates").alias("templates"), "stagnant"))
query("f02_last_n_runs", "SELECT id, template, status FROM runs WHERE status <> 'error' ORDER BY id DESC LIMIT 25", ("runs",))(lambda r: O.last_n_runs(r, 25, True).select("id", "template", "status"))
query("g04_duplicate_configs", "SELECT id, previous FROM (SELECT id, lag(id) OVER (PARTITION BY template, config, cohort ORDER BY id) AS previous FROM runs) x WHERE id - previous <= 10", ("runs",))(O.duplicate_configs)
query("i09_retention", "SELECT i.template, i.cohort, f.folds_scored, f.fold_mean / nullif(i.score, 0) AS retention FROM (SELECT template, cohort, max(score) AS score FROM runs WHERE status = 'scored' GROUP BY 1, 2) i LEFT JOIN (SELECT template, cohort, count(*) AS folds_scored, avg(score) AS fold_mean FROM runs WHERE status = 'scored' GROUP BY 1, 2) f USING (template, cohort)", ("runs",))(lambda r: O.retention_report(r.where("status = 'scored'").groupBy("template", "cohort").agg(F.max("score").alias("score")), r, ["template", "cohort"]).select("template", "cohort", "folds_scored", "retention"))


def _slow(b):
    """Weekly bars."""
    from pyspark.sql import Window

    w = b.withColumn("_w", F.floor(F.col("t") / (7 * DAY))).groupBy("symbol", "_w").agg(F.min("t").alias("t"), F.max_by("close", "t").alias("close"))
    return w.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("t")).cast("long") - 1).drop("_w")


from . import trading  # noqa: E402, F401  signals, labels and books
from . import more  # noqa: E402, F401  registers the rest
from . import tables  # noqa: E402, F401  written tables, candidates and studies
from . import flows  # noqa: E402, F401  streams
