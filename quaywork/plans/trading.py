"""Queries over bars: recursive means, signals, labels, simulated books and their reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof as A
from ..operators import bars as B
from ..operators import calibration as C
from ..operators import ladder as L
from ..operators import outcomes as O
from ..sources.adapters import with_relations
from ..sources.paths import kept
from .registry import _CURVES, _RET, _SNAP, _TRADED, DAY, ORACLE_SQL, QUERIES, _panel, _slow, query, traded_query


def chain(uses: tuple[str, ...], parts: list[tuple[str, str]], last: str) -> str:
    """SQL with recursive parts after the relations."""
    head = with_relations("", *uses).rstrip().replace("WITH ", "WITH RECURSIVE ", 1)
    return head + "".join(f",\n{n} AS ({t})" for n, t in parts) + "\n" + last


def chained(name: str, uses: tuple[str, ...], parts: list[tuple[str, str]], last: str, keep: bool = False):
    """Registers a query with a twin of several parts; with ``keep`` its relations are written once and read from there, as
    it would find them as tables."""

    def add(f):
        query(name, None, uses)((lambda *tables: f(*[kept(t) for t in tables])) if keep else f)
        ORACLE_SQL[name] = chain(uses, parts, last)
        return f

    return add


# --- recursive means --------------------------------------------------------------------------------------------------

#: All exponential means that the templates use, bar by bar: fast and slow, their difference's, and two of the close.
_MEANS = (
    "e",
    """SELECT symbol, i, t, open, high, low, close, volume, close AS e12, close AS e26, close AS e13, close AS e22, 0e0 AS s9 FROM bars WHERE i = 0
 UNION ALL SELECT symbol, i, t, open, high, low, close, volume, e12, e26, e13, e22, s9 + (e12 - e26 - s9) * 0.2e0 FROM (SELECT b.symbol, b.i, b.t, b.open, b.high, b.low, b.close, b.volume,
 e.e12 + (b.close - e.e12) * 2e0 / 13 AS e12, e.e26 + (b.close - e.e26) * 2e0 / 27 AS e26, e.e13 + (b.close - e.e13) * 2e0 / 14 AS e13, e.e22 + (b.close - e.e22) * 2e0 / 23 AS e22, e.s9 FROM e JOIN bars b ON b.symbol = e.symbol AND b.i = e.i + 1) x""",
)
chained("e02_ema", ("bars",), [_MEANS], "SELECT symbol, i, e12 AS ema_12, e26 AS ema_26 FROM e")(lambda b: B.ema(b, "close", [12, 26]).select("symbol", "i", "ema_12", "ema_26"))
chained("e06_macd_hist", ("bars",), [_MEANS], "SELECT symbol, i, e12 - e26 - s9 AS macd_hist FROM e", keep=True)(lambda b: B.macd_hist(b).select("symbol", "i", "macd_hist"))
_FORCE = [
    ("f", "SELECT symbol, i, (close - lag(close) OVER (PARTITION BY symbol ORDER BY i)) * volume AS x FROM bars"),
    ("e", "SELECT symbol, i, x AS v FROM f WHERE i = 1 UNION ALL SELECT f.symbol, f.i, e.v + (f.x - e.v) * 2e0 / 3 FROM e JOIN f ON f.symbol = e.symbol AND f.i = e.i + 1"),
]
chained("e05_force_index", ("bars",), _FORCE, "SELECT symbol, i, v AS force_index FROM bars LEFT JOIN e USING (symbol, i)")(lambda b: B.force_index(b).select("symbol", "i", "force_index"))
query("e07_ewma_vol", """SELECT symbol, i, CASE WHEN i >= 48 AND n >= 24 THEN sqrt(s / w * 8760e0) END AS sigma FROM (SELECT a.symbol, a.i, count(b.r) AS n, sum(b.r * b.r * pow(0.94e0, a.i - b.i)) AS s, sum(pow(0.94e0, a.i - b.i)) FILTER (b.r IS NOT NULL) AS w
 FROM bars a LEFT JOIN (SELECT symbol, i, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY i)) AS r FROM bars) b ON b.symbol = a.symbol AND b.i BETWEEN a.i - 47 AND a.i GROUP BY a.symbol, a.i) x""", ("bars",))(lambda b: B.ewma_vol(b).select("symbol", "i", "sigma"))  # fmt: skip
_PROFILE = """(SELECT symbol, stddev_samp(r) * sqrt(365e0) AS vol FROM (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY i) - 1 AS r FROM bars) x GROUP BY symbol HAVING count(*) >= 30)"""
query("d24_cohort_summary", f"""SELECT cohort, count(*) AS n, min(vol) AS vol_lo, list_sort(list(vol))[count(*) // 2 + 1] AS vol_med, max(vol) AS vol_hi FROM (SELECT vol, CAST(CASE WHEN n // 5 = 0 THEN 4 ELSE least(r // nullif(n // 5, 0), 4) END AS INTEGER) AS cohort
 FROM (SELECT vol, count(*) OVER () AS n, row_number() OVER (ORDER BY vol) - 1 AS r FROM {_PROFILE} p) y) z GROUP BY cohort""", ("bars",))(lambda b: B.cohort_summary(B.coin_profile(b)))  # fmt: skip

# --- signals ----------------------------------------------------------------------------------------------------------

_OK = "entry > 0 AND stop > 0 AND target > 0 AND CASE WHEN direction = 'long' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END AND abs(target - entry) >= 2e0 * abs(entry - stop)"
_COLS = "symbol, i, direction, entry, stop, target"


def breakout_sql(lookback: int = 30, width: float = 0.05) -> str:
    at = lambda test: " ".join(f"WHEN {test.format(c=f'c{j}')} THEN {j}" for j in (1, 2, 3))
    return f"""SELECT {_COLS} FROM (SELECT symbol, i + j AS i, CASE WHEN down THEN 'long' ELSE 'short' END AS direction, CASE j WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS entry,
 CASE WHEN down THEN CASE j WHEN 1 THEN least(low, l1) WHEN 2 THEN least(low, l1, l2) ELSE least(low, l1, l2, l3) END ELSE CASE j WHEN 1 THEN greatest(high, h1) WHEN 2 THEN greatest(high, h1, h2) ELSE greatest(high, h1, h2, h3) END END AS stop,
 CASE WHEN down THEN resistance ELSE support END AS target FROM (SELECT *, close < support AS down, CASE WHEN close < support THEN CASE {at("{c} > support")} END WHEN close > resistance THEN CASE {at("{c} < resistance")} END END AS j FROM (
 SELECT *, CASE WHEN n = {lookback} THEN lo END AS support, CASE WHEN n = {lookback} THEN hi END AS resistance FROM (SELECT *, min(low) OVER f AS lo, max(high) OVER f AS hi, count(*) OVER f AS n, max(i) OVER (PARTITION BY symbol) AS z,
 {", ".join(f"lead({c}, {j}) OVER w AS {c[0]}{j}" for c in ("close", "low", "high") for j in (1, 2, 3))} FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING), w AS (PARTITION BY symbol ORDER BY i)) a) b
 WHERE (resistance - support) / ((resistance + support) / 2) >= {width}e0 AND i <= z - 3) c WHERE j IS NOT NULL) d WHERE {_OK}"""


query("h02_false_breakout", breakout_sql(), ("bars",))(lambda b: O.false_breakout(b))
query("h05_kangaroo_tail", f"""SELECT {_COLS} FROM (SELECT symbol, i + 1 AS i, CASE WHEN up THEN 'long' ELSE 'short' END AS direction, e AS entry, mid AS stop, CASE WHEN up THEN e + h ELSE e - h END AS target FROM (SELECT *, least(open, close) >= mid AS up, greatest(open, close) <= mid AS down FROM (
 SELECT *, avg(h) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS m, lag(h) OVER w AS p, lead(h) OVER w AS n, lead(close) OVER w AS e, max(i) OVER (PARTITION BY symbol) AS z FROM (SELECT *, high - low AS h, (high + low) / 2 AS mid FROM bars) a WINDOW w AS (PARTITION BY symbol ORDER BY i)) b) c
 WHERE h >= 2e0 * m AND p < 2e0 * m AND n < 2e0 * m AND i >= 11 AND i <= z - 2 AND (up OR down)) d WHERE {_OK}""", ("bars",))(lambda b: O.kangaroo_tail(b))  # fmt: skip
_IMPULSE = [
    _MEANS,
    ("m", "SELECT *, e12 - e26 - s9 AS h FROM e"),
    ("g", "SELECT *, CASE WHEN e13 > lag(e13) OVER w AND h > lag(h) OVER w THEN 'green' WHEN e13 < lag(e13) OVER w AND h < lag(h) OVER w THEN 'red' ELSE 'blue' END AS colour FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i)"),
    ("r", "SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(colour) OVER (PARTITION BY symbol ORDER BY i) = colour THEN 0 ELSE 1 END AS c FROM g WHERE i >= 48) x"),
    ("v", "SELECT *, min(low) OVER q AS lo, max(high) OVER q AS hi FROM r WINDOW q AS (PARTITION BY symbol, run ORDER BY i)"),
    ("k", "SELECT *, lag(colour) OVER w AS pc, lag(lo) OVER w AS pl, lag(hi) OVER w AS ph FROM v WINDOW w AS (PARTITION BY symbol ORDER BY i)"),
    ("o", "SELECT symbol, i, CASE WHEN pc = 'red' AND colour <> 'red' THEN 'long' ELSE 'short' END AS direction, close AS entry, CASE WHEN pc = 'red' AND colour <> 'red' THEN pl ELSE ph END AS stop, CASE WHEN pc = 'red' AND colour <> 'red' THEN close + 2 * (close - pl) ELSE close - 2 * (ph - close) END AS target FROM k WHERE (pc = 'red' AND colour <> 'red') OR (pc = 'green' AND colour <> 'green')"),
]
chained("h03_impulse_system", ("bars",), _IMPULSE, f"SELECT {_COLS} FROM o WHERE {_OK}", keep=True)(lambda b: O.impulse_system(b))
_PREV = "last_value(CASE WHEN {f} THEN {c} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_prev = lambda f, c: _PREV.format(f=f, c=c)
_FADE = [
    _MEANS,
    ("m", "SELECT *, e22 * 0.95e0 AS lower, e22 * 1.05e0 AS upper, low < e22 * (1 - 0.05e0) AS lo, high > e22 * (1 + 0.05e0) AS hi FROM e"),
    ("p", f"SELECT *, {_prev('lo', 'i')} AS li, {_prev('lo', 'low')} AS ll, {_prev('lo', 'close')} AS lc, {_prev('hi', 'i')} AS hi_i, {_prev('hi', 'high')} AS hh, {_prev('hi', 'close')} AS hc FROM m"),
    ("q", "SELECT *, coalesce(lo AND i - li >= 5 AND low > ll AND close > lc, false) AS l, coalesce(hi AND i - hi_i >= 5 AND high < hh AND close < hc, false) AS s FROM p"),
    ("o", "SELECT symbol, i, CASE WHEN l THEN 'long' ELSE 'short' END AS direction, close AS entry, CASE WHEN l THEN low - (lower - low) / 2 ELSE high + (high - upper) / 2 END AS stop, e22 AS target FROM q WHERE l OR s"),
]
chained("h04_channel_fade", ("bars",), _FADE, f"SELECT {_COLS} FROM o WHERE {_OK}", keep=True)(lambda b: O.channel_fade(b))
_DIVERGE = [
    _MEANS,
    ("m", "SELECT *, e12 - e26 - s9 AS h, count(*) OVER f = 5 AND low = min(low) OVER f AS is_low, count(*) OVER f = 5 AND high = max(high) OVER f AS is_high FROM e WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    ("p", f"SELECT *, {_prev('is_low', 'i')} AS li, {_prev('is_low', 'low')} AS ll, {_prev('is_low', 'h')} AS lh, {_prev('is_high', 'i')} AS hi_i, {_prev('is_high', 'high')} AS hh, {_prev('is_high', 'h')} AS hm, {', '.join(f'lead(h, {j}) OVER w AS h{j}, lead(close, {j}) OVER w AS c{j}' for j in (1, 2, 3))} FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i)"),
    ("q", "SELECT *, coalesce(is_low AND i - li BETWEEN 5 AND 40 AND low < ll AND h > lh, false) AND i >= 48 AS l, coalesce(is_high AND i - hi_i BETWEEN 5 AND 40 AND high > hh AND h < hm, false) AND i >= 48 AS s0 FROM p"),
    ("j", "SELECT *, CASE WHEN l THEN CASE WHEN h1 > h THEN 1 WHEN h2 > h1 THEN 2 WHEN h3 > h2 THEN 3 END WHEN s0 THEN CASE WHEN h1 < h THEN 1 WHEN h2 < h1 THEN 2 WHEN h3 < h2 THEN 3 END END AS k FROM q"),
    ("n", "SELECT *, CASE k WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 END AS x, CASE WHEN l THEN low ELSE high END AS y FROM j WHERE k IS NOT NULL"),
    ("o", "SELECT symbol, i + k AS i, CASE WHEN l THEN 'long' ELSE 'short' END AS direction, x AS entry, y AS stop, CASE WHEN l THEN greatest(e22, x + 2 * (x - y)) ELSE least(e22, x - 2 * (y - x)) END AS target FROM n"),
]
chained("h06_ema_divergence", ("bars",), _DIVERGE, f"SELECT {_COLS} FROM o WHERE {_OK}", keep=True)(lambda b: O.ema_divergence(b))
_SCREEN = [
    _MEANS,
    ("wk", "SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM (SELECT symbol, min(t) AS t, arg_max(close, t) AS close FROM bars GROUP BY symbol, t // 604800000000) x"),
    ("we", "SELECT symbol, i, t, close AS v FROM wk WHERE i = 0 UNION ALL SELECT k.symbol, k.i, k.t, we.v + (k.close - we.v) * 2e0 / 27 FROM we JOIN wk k ON k.symbol = we.symbol AND k.i = we.i + 1"),
    ("tr", "SELECT symbol, t AS wt, CAST(sign(v - lag(v) OVER (PARTITION BY symbol ORDER BY i)) AS DOUBLE) AS trend FROM we QUALIFY trend IS NOT NULL"),
    ("b", "SELECT e.*, coalesce(tr.trend, 0e0) AS long_trend FROM e ASOF LEFT JOIN tr ON e.symbol = tr.symbol AND e.t >= tr.wt"),
    ("k", "SELECT *, CASE WHEN count(*) OVER f = 14 THEN (close - min(low) OVER f) / nullif(max(high) OVER f - min(low) OVER f, 0) * 100 END AS sk, min(low) OVER g AS lo, max(high) OVER g AS hi, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM b WINDOW f AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING), g AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w AS (PARTITION BY symbol ORDER BY i)"),
    ("o", "SELECT symbol, i, CASE WHEN l THEN 'long' ELSE 'short' END AS direction, CASE WHEN l THEN ph * 1.0001e0 ELSE pl * 0.9999e0 END AS entry, CASE WHEN l THEN lo ELSE hi END AS stop, CASE WHEN l THEN e13 + 2 * (e13 - lo) ELSE e13 - 2 * (hi - e13) END AS target FROM (SELECT *, sk < 30 AND long_trend > 0 AS l, sk > 70 AND long_trend < 0 AS s FROM k WHERE i >= 5) x WHERE l OR s"),
]
chained("h01_triple_screen", ("bars",), _SCREEN, f"SELECT {_COLS} FROM o WHERE {_OK}", keep=True)(lambda b: O.triple_screen(b, _slow(b)))

# --- labels and books -----------------------------------------------------------------------------------------------

#: A signal from every bar.
_SIG = ("sig", "SELECT symbol, i, CASE WHEN close >= open THEN 'long' ELSE 'short' END AS direction, close AS entry, CASE WHEN close >= open THEN close * 0.9e0 ELSE close * 1.1e0 END AS stop, CASE WHEN close >= open THEN close * 1.25e0 ELSE close * 0.75e0 END AS target FROM bars")


def _sig(b):
    up, c = F.col("close") >= F.col("open"), F.col("close")
    return b.select("symbol", "i", F.when(up, "long").otherwise("short").alias("direction"), c.alias("entry"), F.when(up, c * 0.9).otherwise(c * 1.1).alias("stop"), F.when(up, c * 1.25).otherwise(c * 0.75).alias("target"))


def _filled(sig: str = "sig", bars: str = "bars", key: str = "") -> str:
    return f"SELECT {key}s.symbol, s.i, s.direction, s.entry, s.stop, s.target FROM {sig} s JOIN {bars} b ON b.symbol = s.symbol AND b.i = s.i WHERE CASE WHEN s.direction = 'long' THEN b.high >= s.entry ELSE b.low <= s.entry END AND abs(s.entry - s.stop) >= 1e-8 AND abs(s.target - s.entry) >= 2e0 * abs(s.entry - s.stop) AND 0.02e0 * s.entry / abs(s.entry - s.stop) <= 1"


def _labels(name: str, source: str, bars: str = "bars", key: str = "") -> list[tuple[str, str]]:
    """Parts that label the signals of ``source``; ``key`` is a further column of theirs, and a comma."""
    stop = "CASE WHEN s.direction = 'long' THEN b.low <= s.stop ELSE b.high >= s.stop END"
    won = "CASE WHEN s.direction = 'long' THEN b.high >= s.target ELSE b.low <= s.target END"
    own = f"{key}symbol, i, direction, entry, stop, target"
    return [
        (f"{name}_s", f"SELECT DISTINCT {own} FROM {source}"),
        (f"{name}_h", f"SELECT {', '.join('s.' + c.strip() for c in own.split(','))}, min(b.i) AS j FROM {name}_s s JOIN {bars} b ON b.symbol = s.symbol AND b.i > s.i AND ({stop} OR {won}) GROUP BY ALL"),
        (f"{name}_z", f"SELECT symbol, max(i) AS z, arg_max(close, i) AS zc FROM {bars} GROUP BY symbol"),
        (name, f"SELECT s.*, coalesce(h.j, z.z) AS exit_i, CASE WHEN h.j IS NULL THEN z.zc WHEN {stop} THEN s.stop ELSE s.target END AS exit_price, CASE WHEN h.j IS NULL THEN 'end_of_data' WHEN {stop} THEN 'stop' ELSE 'target' END AS reason, strftime(make_timestamp(m.t), '%Y-%m') AS month FROM {name}_s s LEFT JOIN {name}_h h USING ({own}) LEFT JOIN {bars} b ON b.symbol = s.symbol AND b.i = h.j JOIN {name}_z z ON z.symbol = s.symbol JOIN {bars} m ON m.symbol = s.symbol AND m.i = s.i"),
    ]


def _book(labels: str, key: str = "") -> list[tuple[str, str]]:
    """Parts that fold the labelled signals: one step for each signal of a book, all books side by side."""
    on = f"l.symbol = s.symbol{' AND l.config_id = s.config_id' if key else ''}"
    k = f"{key}symbol"
    l_key = "l.config_id, " if key else ""
    return [
        ("line", f"SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY i, direction, entry, stop, target) AS k FROM {labels}"),
        ("fold", f"""SELECT DISTINCT {k}, CAST(0 AS BIGINT) AS k, 10000e0 AS nav, CAST(NULL AS VARCHAR) AS month, 10000e0 AS base, false AS halted, CAST(-1 AS BIGINT) AS free, false AS dead, false AS taken, 0e0 AS value, 0e0 AS units, 0e0 AS gross, 0e0 AS cost FROM line
 UNION ALL SELECT {k}, k, CASE WHEN taken THEN after ELSE nav END, month, base, halted OR (taken AND (base - after) / base >= 0.06e0), CASE WHEN taken THEN exit_i ELSE free END, dead OR (taken AND after < 5000), taken, value, units, gross, cost FROM (
 SELECT *, greatest(0e0, least(nav + gross - cost, 1000000e0)) AS after, NOT dead AND NOT halted AND i > free AND units * entry <= value AS taken FROM (
 SELECT *, units * CASE WHEN direction = 'long' THEN exit_price - entry ELSE entry - exit_price END AS gross, units * (entry + exit_price) * (0.00045e0 + 0.0005e0) AS cost FROM (
 SELECT *, value * 0.02e0 / abs(entry - stop) AS units FROM (SELECT {l_key}l.symbol, l.k, l.i, l.direction, l.entry, l.stop, l.exit_i, l.exit_price, l.month, s.nav, s.dead, s.free, least(s.nav, 1000000e0) AS value,
 CASE WHEN l.month IS DISTINCT FROM s.month THEN s.nav ELSE s.base END AS base, CASE WHEN l.month IS DISTINCT FROM s.month THEN false ELSE s.halted END AS halted FROM fold s JOIN line l ON {on} AND l.k = s.k + 1) a) b) c) d"""),
        ("sim", f"SELECT l.* EXCLUDE (k), s.units, s.gross, s.cost, s.gross - s.cost AS net, s.value AS nav_before, s.nav, l.exit_i - l.i AS hold_bars FROM fold s JOIN line l ON {on} AND l.k = s.k WHERE s.taken"),
    ]


def _stats(key: str = "", bars: str = "bars", name: str = "stats") -> list[tuple[str, str]]:
    k = f"{key}symbol"
    return [
        (f"{name}_p", f"SELECT *, greatest(10000e0, max(nav) OVER (PARTITION BY {k} ORDER BY i, direction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS peak FROM sim"),
        (f"{name}_d", f"SELECT *, CASE WHEN nav < peak THEN (peak - nav) / peak ELSE 0 END AS dd, coalesce(last_value(CASE WHEN nav >= peak THEN exit_i END IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY i, direction ROWS UNBOUNDED PRECEDING), 0) AS since FROM {name}_p"),
        (f"{name}_b", f"SELECT symbol, quantile_cont(d, 0.5) AS bar FROM (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY i) AS d FROM {bars}) x GROUP BY symbol"),
        (name, f"""SELECT *, nav_final - 10000 AS total_return, (nav_final - 10000) / 10000 AS pct_return, CASE WHEN rets >= 2 AND sd >= 1e-10 THEN mean / sd * sqrt((CASE WHEN bar > 0 THEN 31536000000000e0 / bar ELSE 2190 END) / greatest(avg_hold, 1)) ELSE 0 END AS sharpe FROM (
 SELECT {k}, count(*) AS n_trades, sum(greatest(gross, 0)) / nullif(sum(greatest(-gross, 0)), 0) AS profit_factor, avg(CASE WHEN net > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(net) AS avg_pnl, avg(hold_bars) AS avg_hold, arg_max(nav, i) AS nav_final, greatest(10000e0, max(nav)) AS nav_peak, max(dd) AS max_dd,
 CAST(max(CASE WHEN nav >= peak THEN 0 ELSE exit_i - since END) AS BIGINT) AS longest_dd, avg(net / nav_before) AS mean, stddev_pop(net / nav_before) AS sd, count(*) AS rets FROM {name}_d GROUP BY {k}) g LEFT JOIN {name}_b USING (symbol)"""),
    ]


def _evaluated(stats: str = "stats", min_trades: int = 20) -> str:
    status = f"CASE WHEN nav_final < 5000 THEN 'catastrophic' WHEN n_trades < {min_trades} OR coalesce(profit_factor, 'infinity'::DOUBLE) <= 1.3e0 THEN 'rejected' ELSE 'scored' END"
    score = "200 * pct_return - (CASE WHEN max_dd > 0.2 THEN ((max_dd - 0.2e0) / 0.1e0) * ((max_dd - 0.2e0) / 0.1e0) * 200 ELSE 0 END) - (CASE WHEN n_trades < 20 THEN 10e0 * (20 - n_trades) ELSE 0 END)"
    return f"SELECT *, CASE status WHEN 'scored' THEN {score} WHEN 'catastrophic' THEN -1000e0 END AS score FROM (SELECT *, {status} AS status FROM {stats}) x"


_FILL = ("fill", _filled())
_BASE = [_SIG, _FILL, *_labels("lab", "fill")]
_RUN = [*_BASE, *_book("lab")]
_STAT_COLS = ["n_trades", "profit_factor", "win_rate", "avg_pnl", "avg_hold", "nav_final", "nav_peak", "max_dd", "longest_dd", "total_return", "pct_return", "sharpe"]
_EVAL = [*_STAT_COLS, "status", "score"]


def _run(b):
    return O.run_book(_sig(b), b)


chained("i01_entry_fill", ("bars",), [_SIG, _FILL], "SELECT symbol, i, direction FROM fill", keep=True)(lambda b: O.entry_fill(_sig(b), b).select("symbol", "i", "direction"))
chained("i02_barrier_label", ("bars",), [_SIG, *_labels("lab", "sig")], "SELECT symbol, i, direction, exit_i, exit_price, reason FROM lab", keep=True)(lambda b: O.barrier_label(_sig(b), b).select("symbol", "i", "direction", "exit_i", "exit_price", "reason"))
_COST = "SELECT symbol, i, units, units * d AS gross, units * (entry + exit_price) * 0.00095e0 AS cost, units * d - units * (entry + exit_price) * 0.00095e0 AS net, exit_i FROM (SELECT *, 200e0 / abs(entry - stop) AS units, CASE WHEN direction = 'long' THEN exit_price - entry ELSE entry - exit_price END AS d FROM lab) x"
chained("i04_trade_costs", ("bars",), [*_BASE, ("cost", _COST)], "SELECT symbol, i, units, gross, cost, net FROM cost", keep=True)(lambda b: O.trade_costs(O.barrier_label(O.entry_fill(_sig(b), b), b)).select("symbol", "i", "units", "gross", "cost", "net"))
_FREE = [
    ("line", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i, direction, entry, stop, target) AS k FROM lab"),
    ("fold", "SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS free, false AS taken FROM line UNION ALL SELECT l.symbol, l.k, CASE WHEN l.i > s.free THEN l.exit_i ELSE s.free END, l.i > s.free FROM fold s JOIN line l ON l.symbol = s.symbol AND l.k = s.k + 1"),
]
chained("i03_non_overlap", ("bars",), [*_BASE, *_FREE], "SELECT l.symbol, l.i, l.direction, l.exit_i, l.reason FROM fold s JOIN line l USING (symbol, k) WHERE s.taken", keep=True)(lambda b: O.non_overlap(O.barrier_label(O.entry_fill(_sig(b), b), b)).select("symbol", "i", "direction", "exit_i", "reason"))
chained("i05_nav_fold", ("bars",), _RUN, "SELECT symbol, i, exit_i, month, units, gross, cost, net, nav_before, nav, hold_bars FROM sim", keep=True)(lambda b: _run(b).select("symbol", "i", "exit_i", "month", "units", "gross", "cost", "net", "nav_before", "nav", "hold_bars"))
chained("d25_trade_stats", ("bars",), [*_RUN, *_stats()], f"SELECT symbol, {', '.join(_STAT_COLS)} FROM stats", keep=True)(lambda b: O.trade_stats(_run(b), b).select("symbol", *_STAT_COLS))
chained("d25_monthly_returns", ("bars",), _RUN, "SELECT s.symbol, strftime(make_timestamp(b.t), '%Y-%m') AS exit_month, sum(s.net) AS net FROM sim s JOIN bars b ON b.symbol = s.symbol AND b.i = s.exit_i GROUP BY 1, 2", keep=True)(lambda b: O.monthly_returns(_run(b), b))
chained("i06_evaluate", ("bars",), [*_RUN, *_stats(), ("ev", _evaluated())], f"SELECT symbol, {', '.join(_EVAL)} FROM ev", keep=True)(lambda b: O.evaluate(_run(b), b).select("symbol", *_EVAL))
_FOLDS = [
    _SIG,
    ("sl", "SELECT symbol, i, CAST(least(i // (count(*) OVER (PARTITION BY symbol) // 5), 4) AS INTEGER) AS slice FROM bars"),
    ("fb", "SELECT concat(b.symbol, '/', sl.slice) AS symbol, b.i, b.t, b.low, b.high, b.close FROM bars b JOIN sl USING (symbol, i)"),
    ("fs", "SELECT concat(s.symbol, '/', sl.slice) AS symbol, s.i, s.direction, s.entry, s.stop, s.target FROM sig s JOIN sl USING (symbol, i)"),
    ("fill", _filled("fs", "fb")), *_labels("lab", "fill", "fb"), *_book("lab"), *_stats("", "fb"), ("ev", _evaluated()),
]
chained("i07_walk_forward", ("bars",), _FOLDS, f"SELECT split_part(symbol, '/', 1) AS symbol, CAST(split_part(symbol, '/', 2) AS INTEGER) AS fold, {', '.join(_EVAL)} FROM ev", keep=True)(lambda b: O.walk_forward(_sig(b), b).select("symbol", "fold", *_EVAL))
N_CONFIGS = 100


def _params(k: int) -> tuple[str, dict]:
    """Configuration ``k``: its template, and its parameters."""
    m = k // 3
    if k % 3 == 0:
        return "false_breakout", {"lookback": 15 + 5 * (m % 4), "min_width": (2 + m % 5) / 100, "confirm": 1 + m % 3, "min_rr": 2 + (m % 2) / 2}
    if k % 3 == 1:
        return "kangaroo_tail", {"context": 5 + 5 * (m % 3), "multiple": 1.5 + m % 3 / 4, "target": 1 + m % 2, "lag": 1 + m % 3, "min_rr": 1 + m % 2}
    return "channel_fade", {"span": 10 + 4 * (m % 4), "width": (2 + m % 4) / 100, "gap": 3 + m % 5, "min_rr": 2}


def _configs(spark):
    rows = [(k, *_params(k)) for k in range(N_CONFIGS)] + [(N_CONFIGS, "false_breakout", {"confirm": 11, "depth": 1})]
    return spark.createDataFrame([(k, t, {n: str(x) for n, x in p.items()}) for k, t, p in rows], "config_id long, template string, params map<string, string>")


_AHEAD = ", ".join(f"lead({c}, {j}) OVER w AS {c[0]}{j}" for c in ("close", "low", "high") for j in (1, 2, 3))
_BACK = " ".join(f"WHEN confirm >= {j} AND CASE WHEN close < support THEN c{j} > support ELSE c{j} < resistance END THEN {j}" for j in (1, 2, 3))
_RR = _OK.replace("2e0 * abs(entry - stop)", "min_rr * abs(entry - stop)")
_CFG = [
    ("cfg", f"SELECT CAST(k AS BIGINT) AS config_id, CAST(k // 3 AS INTEGER) AS m, CAST(k % 3 AS INTEGER) AS kind FROM range({N_CONFIGS}) t(k)"),
    ("brk", "SELECT config_id, 15 + 5 * (m % 4) AS lookback, (2 + m % 5) / 100e0 AS min_width, 1 + m % 3 AS confirm, 2 + (m % 2) / 2e0 AS min_rr FROM cfg WHERE kind = 0"),
    ("tail", "SELECT config_id, 5 + 5 * (m % 3) AS context, 1.5e0 + (m % 3) / 4e0 AS multiple, 1 + m % 2 AS goal, 1 + m % 3 AS lag, 1 + m % 2 AS min_rr FROM cfg WHERE kind = 1"),
    ("fade", "SELECT config_id, 10 + 4 * (m % 4) AS span, (2 + m % 4) / 100e0 AS width, 3 + m % 5 AS gap, 2 AS min_rr FROM cfg WHERE kind = 2"),
    ("near", f"SELECT *, high - low AS h, max(i) OVER (PARTITION BY symbol) AS z, lag(high - low) OVER w AS hp, lead(high - low) OVER w AS hn, {_AHEAD} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i)"),
    ("ranges", "SELECT n.*, l.lookback, CASE WHEN i >= lookback THEN min(low) OVER f END AS support, CASE WHEN i >= lookback THEN max(high) OVER f END AS resistance FROM near n, (SELECT DISTINCT lookback FROM brk) l WINDOW f AS (PARTITION BY symbol, lookback ORDER BY i ROWS BETWEEN lookback PRECEDING AND 1 PRECEDING)"),
    ("out1", f"""SELECT config_id, symbol, i + j AS i, CASE WHEN close < support THEN 'long' ELSE 'short' END AS direction, CASE j WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS entry,
 CASE WHEN close < support THEN CASE j WHEN 1 THEN least(low, l1) WHEN 2 THEN least(low, l1, l2) ELSE least(low, l1, l2, l3) END ELSE CASE j WHEN 1 THEN greatest(high, h1) WHEN 2 THEN greatest(high, h1, h2) ELSE greatest(high, h1, h2, h3) END END AS stop,
 CASE WHEN close < support THEN resistance ELSE support END AS target, min_rr FROM (SELECT *, CASE {_BACK} END AS j FROM ranges JOIN brk USING (lookback) WHERE (close < support OR close > resistance) AND (resistance - support) / ((resistance + support) / 2) >= min_width AND i <= z - confirm) x WHERE j IS NOT NULL"""),
    ("heights", "SELECT n.*, l.context, avg(h) OVER (PARTITION BY symbol, context ORDER BY i ROWS BETWEEN context PRECEDING AND 1 PRECEDING) AS mh FROM near n, (SELECT DISTINCT context FROM tail) l"),
    ("out2", """SELECT config_id, symbol, i + lag AS i, CASE WHEN up THEN 'long' ELSE 'short' END AS direction, e AS entry, mid AS stop, CASE WHEN up THEN e + goal * h ELSE e - goal * h END AS target, min_rr FROM (SELECT *, (high + low) / 2 AS mid, CASE lag WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS e, least(open, close) >= (high + low) / 2 AS up, greatest(open, close) <= (high + low) / 2 AS down
 FROM heights JOIN tail USING (context)) x WHERE h >= multiple * mh AND hp < multiple * mh AND hn < multiple * mh AND i >= context + 1 AND i <= z - lag - 1 AND (up OR down)"""),
    ("means", "SELECT b.symbol, b.i, b.low, b.high, b.close, l.span, b.close AS mean FROM bars b, (SELECT DISTINCT span FROM fade) l WHERE b.i = 0 UNION ALL SELECT b.symbol, b.i, b.low, b.high, b.close, m.span, m.mean + (b.close - m.mean) * 2e0 / (m.span + 1) FROM means m JOIN bars b ON b.symbol = m.symbol AND b.i = m.i + 1"),
    ("sides", "SELECT m.*, config_id, width, gap, min_rr, side FROM means m JOIN fade USING (span), (VALUES ('long'), ('short')) v(side) WHERE CASE side WHEN 'long' THEN low < mean * (1 - width) ELSE high > mean * (1 + width) END"),
    ("prior", "SELECT *, lag(i) OVER w AS pi, lag(low) OVER w AS pl, lag(high) OVER w AS ph, lag(close) OVER w AS pc FROM sides WINDOW w AS (PARTITION BY config_id, symbol, side ORDER BY i)"),
    ("out3", "SELECT config_id, symbol, i, side AS direction, close AS entry, CASE side WHEN 'long' THEN low - (mean * (1 - width) - low) / 2 ELSE high + (high - mean * (1 + width)) / 2 END AS stop, mean AS target, min_rr FROM prior WHERE i - pi >= gap AND CASE side WHEN 'long' THEN low > pl AND close > pc ELSE high < ph AND close < pc END QUALIFY row_number() OVER (PARTITION BY config_id, symbol, i ORDER BY side) = 1"),
    ("sig", f"SELECT config_id, symbol, i, direction, entry, stop, target FROM (SELECT * FROM out1 UNION ALL SELECT * FROM out2 UNION ALL SELECT * FROM out3) x WHERE {_RR}"),
]
_SWEEP = [*_CFG, ("fill", _filled(key="s.config_id, ")), *_labels("lab", "fill", key="config_id, "), *_book("lab", "config_id, "), *_stats("config_id, "), ("ev", _evaluated(min_trades=5))]
_PAIRS = f"""SELECT c.config_id, c.template, s.symbol, coalesce(e.n_trades, 0) AS n_trades, {", ".join("e." + c for c in _STAT_COLS[1:])}, e.score, CASE WHEN c.bad THEN 'error' ELSE coalesce(e.status, 'rejected') END AS status,
 CASE WHEN c.bad THEN 'confirm: range; depth: unknown' WHEN e.status = 'catastrophic' THEN 'value under the floor' WHEN coalesce(e.status, 'rejected') = 'rejected' THEN CASE WHEN coalesce(e.n_trades, 0) < 5 THEN 'too few trades' ELSE 'profit factor' END END AS reason
 FROM (SELECT config_id, CASE kind WHEN 0 THEN 'false_breakout' WHEN 1 THEN 'kangaroo_tail' ELSE 'channel_fade' END AS template, false AS bad FROM cfg UNION ALL SELECT {N_CONFIGS}, 'false_breakout', true) c CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN ev e ON e.config_id = c.config_id AND e.symbol = s.symbol"""
chained("i08_sweep", ("bars",), _SWEEP, _PAIRS, keep=True)(lambda b: O.sweep(b, _configs(b.sparkSession)).select("config_id", "template", "symbol", *_EVAL, "reason"))
chained("h07_fresh_signals", ("bars",), [_SIG], f"SELECT {_COLS} FROM sig JOIN (SELECT symbol, max(i) AS i FROM bars GROUP BY symbol) z USING (symbol, i)")(lambda b: O.fresh_signals(_sig(b), b))
_FUND = "(SELECT concat('Brand#1', substr(symbol, 2, 1)) AS symbol, t // 86400000000 - 19700 AS k, rate FROM funding)"
chained("i10_funding_adjust", ("bars", "funding"), [*_BASE, ("cost", _COST)], f"SELECT c.symbol, c.i AS a, c.exit_i AS z, c.net, CAST(coalesce(sum(f.rate), 0) AS BIGINT) AS funding FROM cost c LEFT JOIN {_FUND} f ON f.symbol = c.symbol AND f.k >= c.i AND f.k < c.exit_i GROUP BY c.symbol, c.i, c.exit_i, c.net", keep=True)(
    lambda b, f: A.interval_sum_join(O.trade_costs(O.barrier_label(O.entry_fill(_sig(b), b), b)).select("symbol", F.col("i").alias("a"), F.col("exit_i").alias("z"), "net"), f.select(F.concat(F.lit("Brand#1"), F.substring("symbol", 2, 1)).alias("symbol"), (F.floor(F.col("t") / DAY) - 19700).cast("long").alias("k"), "rate"), ["symbol"], "a", "z", "k", "rate", "funding").withColumn("funding", F.col("funding").cast("long"))
)
chained("d32_cross_coin_report", ("bars",), [*_RUN, *_stats(), ("ev", _evaluated(min_trades=5))], "SELECT 'base' AS config, count(*) FILTER (status = 'scored') AS scored, avg(CASE WHEN status = 'scored' THEN score END) AS mean, min(CASE WHEN status = 'scored' THEN score WHEN status = 'catastrophic' THEN -1000 ELSE -9999 END) AS worst, count(*) AS folds, CASE WHEN count(*) FILTER (status = 'scored') >= 2 THEN stddev_pop(CASE WHEN status = 'scored' THEN score END) ELSE 0 END AS sigma, count(*) FILTER (status = 'scored') = count(*) AS consistent FROM ev", keep=True)(lambda b: O.fold_rollup(O.evaluate(_run(b), b, min_trades=5).withColumn("config", F.lit("base")), ["config"]))
_FUNDED = [
    *_RUN,
    ("fd", f"SELECT s.symbol, s.i, s.gross, s.cost, s.net, s.nav_before, s.hold_bars, s.units * s.entry * coalesce(sum(f.rate), 0) / 1e6 * CASE WHEN s.direction = 'long' THEN 1 ELSE -1 END AS funding FROM sim s LEFT JOIN {_FUND} f ON f.symbol = s.symbol AND f.k >= s.i AND f.k < s.exit_i GROUP BY s.symbol, s.i, s.gross, s.cost, s.net, s.nav_before, s.hold_bars, s.units, s.entry, s.direction"),
    ("nv", "SELECT *, first_value(nav_before) OVER w AS v0, first_value(nav_before) OVER w + sum(net) OVER w AS va, first_value(nav_before) OVER w + sum(net - funding) OVER w AS vb FROM fd WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"),
    ("pk", "SELECT *, greatest(v0, max(va) OVER w) AS pa, greatest(v0, max(vb) OVER w) AS pb FROM nv WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"),
    ("rp", """SELECT symbol, trades, gross, fees, funding, net, net_funded, max_dd, v0 + net AS final_nav, v0 + net_funded AS final_nav_funded, CASE WHEN trades >= 2 AND sa > 0 THEN ma / sa * y ELSE 0 END AS sharpe, CASE WHEN trades >= 2 AND sb > 0 THEN mb / sb * y ELSE 0 END AS sharpe_funded FROM (
 SELECT symbol, count(*) AS trades, sum(gross) AS gross, sum(cost) AS fees, sum(funding) AS funding, sum(net) AS net, sum(net - funding) AS net_funded, max(greatest(0, (pa - va) / pa, (pb - vb) / pb)) AS max_dd, any_value(v0) AS v0, avg(net / v0) AS ma, stddev_pop(net / v0) AS sa, avg((net - funding) / v0) AS mb, stddev_pop((net - funding) / v0) AS sb, sqrt(365 / greatest(avg(hold_bars), 1e-6)) AS y FROM pk GROUP BY symbol) x"""),
]


def _replayed(b, f):
    ticks = f.select(F.concat(F.lit("Brand#1"), F.substring("symbol", 2, 1)).alias("symbol"), (F.floor(F.col("t") / DAY) - 19700).cast("long").alias("k"), "rate")
    paid = A.interval_sum_join(_run(b), ticks, ["symbol"], "i", "exit_i", "k", "rate", "rates")
    return O.replay_report(paid.withColumn("funding", F.col("units") * F.col("entry") * F.col("rates") / 1e6 * F.when(F.col("direction") == "long", 1).otherwise(-1)))


chained("d33_replay_report", ("bars", "funding"), _FUNDED, "SELECT * FROM rp", keep=True)(_replayed)
chained("d33_replay_totals", ("bars", "funding"), _FUNDED, "SELECT *, coalesce(funding / nullif(abs(net), 0) * 100, 0) AS funding_pct, mean_sharpe >= 1 AND median_sharpe >= 0.5 AND max_dd <= 0.25 AS go FROM (SELECT count(*) AS groups, sum(gross) AS gross, sum(fees) AS fees, sum(funding) AS funding, sum(net) AS net, sum(net_funded) AS net_funded, median(sharpe_funded) AS median_sharpe, avg(sharpe_funded) AS mean_sharpe, max(max_dd) AS max_dd FROM rp) x", keep=True)(lambda b, f: O.replay_totals(_replayed(b, f)))

# --- ladders and lookups without a twin before -----------------------------------------------------------------------

query("d22_implied_mean", """SELECT event, t, count(*) AS strikes, CASE WHEN count(*) >= 2 THEN sum((above - na) * (strike + ns) / 2e0) + (1 - arg_min(above, strike)) * (min(strike) - median(ns - strike) / 2) + arg_max(above, strike) * (max(strike) + median(ns - strike) / 2) END AS implied_mean FROM (
 SELECT *, lead(strike) OVER w AS ns, lead(above) OVER w AS na FROM (SELECT event, t, strike, min(CAST(mass AS DOUBLE) / total) OVER (PARTITION BY event, t ORDER BY strike) AS above FROM (SELECT *, sum(mass) OVER (PARTITION BY event, t) AS total FROM ladder) x) y WINDOW w AS (PARTITION BY event, t ORDER BY strike)) z GROUP BY event, t""", ("ladder",))(lambda l: L.implied_mean(L.normalize_ladder(l)))  # fmt: skip
_OLS = "count(*) AS n, CASE WHEN count(*) >= 3 THEN regr_slope(kl, max_gap) END AS slope, CASE WHEN count(*) >= 3 THEN regr_intercept(kl, max_gap) END AS intercept, CASE WHEN count(*) >= 3 THEN regr_r2(kl, max_gap) END AS r2"
query("d17_event_study", f"SELECT event AS label, {_OLS} FROM {_SNAP} s GROUP BY event UNION ALL SELECT 'all', {_OLS} FROM {_SNAP} s UNION ALL SELECT 'shuffled', {_OLS} FROM (SELECT a.max_gap, b.kl FROM (SELECT max_gap, row_number() OVER (ORDER BY t, event) AS r FROM {_SNAP} s) a JOIN (SELECT kl, row_number() OVER (ORDER BY md5(concat(event, '|', CAST(t AS VARCHAR))), t, event) AS r FROM {_SNAP} s) b USING (r)) x", ("ladder",))(lambda l: L.event_study(L.snapshot_metrics(_panel(l)), "max_gap", "kl", 3).drop("t_stat"))
_SIGMA = f"""sg AS (SELECT category, trade_side AS side, bin_low, count(*) AS n, stddev_samp({_RET}) AS s FROM traded GROUP BY GROUPING SETS ((category, trade_side, bin_low), (category, trade_side), ())),
 sb AS (SELECT b.category, b.side, b.bin_low, sqrt((b.n * b.s * b.s + 200 * p.s * p.s) / (b.n + 200)) AS s FROM sg b JOIN sg p ON p.bin_low IS NULL AND p.category = b.category AND p.side = b.side WHERE b.bin_low IS NOT NULL AND b.n >= 5)"""
traded_query("c11_sigma_lookup", None)(lambda x: C.sigma_lookup(x.withColumn("side", F.col("trade_side")), C.sigma_table(C.bet_returns(x))).select("ticker", "slot", "sigma", "sigma_level"))
_HEAD = with_relations("", "trades", "markets").rstrip() + f",\n{_CURVES},\n{_TRADED}"
ORACLE_SQL["c11_sigma_lookup"] = f"""{_HEAD},\n{_SIGMA} SELECT t.ticker, t.slot, coalesce(b.s, p.s, a.s) AS sigma, CASE WHEN b.s IS NOT NULL THEN 'bin' WHEN p.s IS NOT NULL THEN 'pool' WHEN a.s IS NOT NULL THEN 'aggregate' END AS sigma_level FROM traded t
 LEFT JOIN sb b ON b.category = t.category AND b.side = t.trade_side AND b.bin_low = t.bin_low LEFT JOIN sg p ON p.bin_low IS NULL AND p.category = t.category AND p.side = t.trade_side LEFT JOIN sg a ON a.category IS NULL AND a.side IS NULL"""
traded_query("i12_flat_backtest", None)(lambda x: C.flat_backtest(x))
_P = "(cents / 100e0)"
_KELLY = f"greatest(0e0, least((CASE WHEN trade_side = 'sell_yes' THEN ({_P} - greatest(0.01e0, least(0.99e0, {_P} - edge_pp / 100e0))) / nullif({_P}, 0) ELSE (greatest(0.01e0, least(0.99e0, {_P} + edge_pp / 100e0)) - {_P}) / nullif(1 - {_P}, 0) END) * 0.25e0 * 10000e0, 100e0))"
ORACLE_SQL["i12_flat_backtest"] = f"""{_HEAD} SELECT day, trades, pnl, nav, (greatest(10000e0, max(nav) OVER w) - nav) / greatest(10000e0, max(nav) OVER w) AS drawdown FROM (SELECT *, 10000e0 + sum(pnl) OVER (ORDER BY day) AS nav FROM (SELECT closed // {DAY} AS day, count(*) AS trades, sum({_KELLY} * {_RET}) AS pnl FROM traded WHERE edge_pp >= 2 GROUP BY 1) x) y WINDOW w AS (ORDER BY day)"""
