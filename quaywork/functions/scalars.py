"""Scalar functions of event contracts and positions, as Spark columns.

Every function takes columns (or values, which become literals) and gives a column; nulls propagate unless a
docstring says otherwise, and no result is NaN.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The taxonomy of event tickers, prefixes and substrings by category.
CATEGORIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "sports": (("KXMVESPORTS", "KXMVENFL", "KXMVENBA", "KXNCAA", "KXNFLGAME", "KXNFL", "KXNBA"), ()),
    "crypto": (("KXBTC", "KXETH", "KXDOGE", "KXXRP", "KXSOL", "KXSHIBA"), ()),
    "financial": (("KXNASDAQ", "KXINX", "NASDAQ", "INX"), ("USDJPY", "EURUSD")),
    "weather": (("KXCITIES", "HIGH", "LOW"), ()),
    "economics": (("CPI", "FED", "KXFED", "GDP"), ()),
    "politics": (("PRES", "SENATE", "HOUSE", "KXGOV", "KXMAYOR"), ()),
}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _starts(c: Column, words) -> Column:
    return F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: c.startswith(w)), True)


def _holds(c: Column, words) -> Column:
    return F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: c.contains(w)), True)


def categorize(ticker, precedence: str = "sql", taxonomy=CATEGORIES) -> Column:
    """Category of a ticker, ``other`` where none fits or the ticker is null. ``sql`` tests a category's prefixes and
    substrings before the next category; ``prefix`` tests the prefixes of all first."""
    c, tests = F.coalesce(_c(ticker), F.lit("")), []
    for name, (prefixes, parts) in taxonomy.items():
        tests.append((0, name, _starts(c, prefixes)))
        if parts:
            tests.append((1, name, _holds(c, parts)))
    if precedence == "prefix":
        tests.sort(key=lambda t: t[0])
    out = F.when(tests[0][2], tests[0][1])
    for _, name, test in tests[1:]:
        out = out.when(test, name)
    return out.otherwise("other")


def category_sql(column: str, taxonomy=CATEGORIES, precedence: str = "sql") -> str:
    """The same taxonomy as the text of a CASE expression, for SQL."""
    starts = [(name, [f"{column} LIKE '{p}%'" for p in prefixes]) for name, (prefixes, _) in taxonomy.items()]
    holds = [(name, [f"{column} LIKE '%{p}%'" for p in parts]) for name, (_, parts) in taxonomy.items()]
    both = starts + holds if precedence == "prefix" else [(name, a + b) for (name, a), (_, b) in zip(starts, holds, strict=True)]
    whens = [f"WHEN {' OR '.join(tests)} THEN '{name}'" for name, tests in both if tests]
    return "CASE " + " ".join(whens) + " ELSE 'other' END"


def midlife(opened, closed) -> Column:
    """Half-way between two times in microseconds, rounded down."""
    return (F.floor((_c(opened) + _c(closed)) / F.lit(2))).cast("long")


def price_to_cents(p) -> Column:
    """A price in cents, halves to even."""
    return F.rint(_c(p) * 100).cast("int")


def price_bin_5c(cents) -> Column:
    return (F.floor(_c(cents) / 5) * 5).cast("int")


def price_bin_frac(p) -> Column:
    """The 5-cent bin of a fraction, 95 at most, cents truncated."""
    return F.least(F.lit(95), (F.floor(F.floor(_c(p) * 100) / 5) * 5).cast("int"))


def fee_adjusted_edge(implied, actual, fee: float = 0.07) -> Column:
    i, a = _c(implied), _c(actual)
    return F.abs(a - i) - F.lit(2 * fee) * i * (1 - i)


def trade_side(implied, actual) -> Column:
    i, a = _c(implied), _c(actual)
    return F.when(a < i, "sell_yes").when(a > i, "buy_yes").otherwise("")


def wilson_ci(k, n, z: float = 1.96) -> Column:
    """Struct (low, high) of the score interval, clamped to [0, 1]; (0, 0) where n is 0."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    m = F.nullif(n, F.lit(0.0))
    p, zz = k / m, z * z
    centre = (p + zz / (2 * m)) / (1 + zz / m)
    half = z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / (1 + zz / m)
    return F.struct(F.coalesce(F.greatest(F.lit(0.0), centre - half), F.lit(0.0)).alias("low"), F.when(m.isNull(), 0.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("high"))


def bin_tradeable(n, implied, actual, min_n: int = 100, min_dev_pp: float = 3.0) -> Column:
    """The side to trade in a bin of enough rows, deviation and edge after fees; else an empty string."""
    i, a = _c(implied), _c(actual)
    ok = (_c(n) >= min_n) & (F.abs(a - i) * 100 >= min_dev_pp) & (fee_adjusted_edge(i, a) > 0)
    return F.when(ok, trade_side(i, a)).otherwise("")


def parse_price(raw, scale_cents: bool = True) -> Column:
    """A price in [0, 1] from text; above 1 it counts as cents if ``scale_cents``. Null if it is no number."""
    v = F.trim(_c(raw).cast("string")).try_cast("double")
    v = F.when(~F.isnan(v), v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / 100).otherwise(v) if scale_cents else v)) + F.when(v.isNull(), F.lit(None).cast("double")).otherwise(0.0)


def parse_bucket_range(text) -> Column:
    """Struct (lower, upper, mid) of a ``$1,000 to 1,999.99`` label, null where there is none."""
    pattern = r"\$([\d,]+(?:\.\d+)?)\s*to\s*\$?([\d,]+(?:\.\d+)?)"
    part = lambda k: F.replace(F.regexp_extract(_c(text), pattern, k), F.lit(","), F.lit("")).try_cast("double")
    lo, hi = part(1), part(2)
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lower"), hi.alias("upper"), ((lo + hi) / 2).alias("mid")))


def parse_threshold(text) -> Column:
    """The number of an ``Above 4.25%`` label, null where there is none."""
    return F.regexp_extract(_c(text), r"Above\s+(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def series_of(event_ticker) -> Column:
    return F.split_part(_c(event_ticker), F.lit("-"), F.lit(1))


def subseries_of(event_ticker) -> Column:
    return F.regexp_replace(_c(event_ticker), r"-[^-]*$", "")


def market_state(status, result) -> Column:
    """``resolved`` with a yes or no result, ``void`` if settled without one, else ``open``."""
    s, r = F.lower(_c(status)), F.lower(_c(result))
    settled = s.isin("settled", "finalized", "determined")
    return F.when(settled & r.isin("yes", "no"), "resolved").when(settled, "void").otherwise("open")


def time_offset_frac(trade_time, pit_time, opened, closed) -> Column:
    """Distance of a trade from a point in time as a share of the market's life; null for a life of no length."""
    return F.abs(_c(trade_time) - _c(pit_time)) / F.nullif(_c(closed) - _c(opened), F.lit(0))


def life_fraction(t, opened, closed) -> Column:
    return (_c(t) - _c(opened)) / F.nullif(_c(closed) - _c(opened), F.lit(0))


def life_decile(frac) -> Column:
    return F.least(F.lit(9), F.floor(_c(frac) * 10).cast("int"))


def life_gate(frac, lo: float = 0.25, hi: float = 0.55) -> Column:
    """``eligible``, or why not."""
    f = _c(frac)
    return F.when(f < lo, f"frac_lt_{lo:g}").when(f > hi, f"frac_gt_{hi:g}").otherwise("eligible")


#: The error function up to ERF_END in stretches of ERF_STEP, each a polynomial through ERF_DEGREE + 1 of its values.
ERF_STEP, ERF_END, ERF_DEGREE = 0.5, 6.0, 14


@functools.cache
def _erf_polynomials() -> list[list[float]]:
    """By stretch the coefficients in the distance from its middle over half its length, the highest first."""
    half = ERF_STEP / 2
    middles = [half + ERF_STEP * k for k in range(int(ERF_END / ERF_STEP))]
    fit = lambda m: np.polynomial.chebyshev.Chebyshev.interpolate(lambda u: np.array([math.erf(m + half * x) for x in u]), ERF_DEGREE)
    return [fit(m).convert(kind=np.polynomial.Polynomial).coef[::-1].tolist() for m in middles]


def erf(x) -> Column:
    """The error function to about 1e-15: a polynomial for each stretch, evaluated by nested products; ±1 beyond 6."""
    x = _c(x)
    stretch = F.least(F.floor(F.abs(x) / ERF_STEP), F.lit(ERF_END / ERF_STEP - 1)).cast("int")
    u = (F.abs(x) - (stretch + 0.5) * ERF_STEP) / (ERF_STEP / 2)
    by_power = list(zip(*_erf_polynomials(), strict=True))
    coefficient = lambda k: F.get(F.array(*[F.lit(c) for c in by_power[k]]), stretch)
    total = coefficient(0)
    for k in range(1, ERF_DEGREE + 1):
        total = total * u + coefficient(k)
    return F.when(F.abs(x) >= ERF_END, F.signum(x)).otherwise(F.signum(x) * total)


def normal_cdf(z) -> Column:
    return 0.5 * (1 + erf(_c(z) / math.sqrt(2)))


def lognormal_bucket_prob(lo, hi, spot, sigma, years) -> Column:
    """Chance that a driftless lognormal price ends between two strikes; null where volatility or time is not positive."""
    sd = F.nullif(_c(sigma) * F.sqrt(_c(years)), F.lit(0.0))
    z = lambda k: F.ln(_c(k) / _c(spot)) / sd
    return normal_cdf(z(hi)) - normal_cdf(z(lo))


def abs_gap(p, q) -> Column:
    return F.abs(_c(p) - _c(q))


def kl_term(p, q, eps: float = 1e-12) -> Column:
    p, q = _c(p), _c(q)
    return F.when(p > eps, p * F.ln((p + eps) / (q + eps))).otherwise(0.0)


def half_life(beta, horizon_h: float = 1) -> Column:
    """Hours to half a gap under mean reversion ``beta``; null unless 0 < 1 + beta < 1."""
    phi = 1 + _c(beta)
    return F.when((phi > 0) & (phi < 1), math.log(0.5) / F.ln(phi) * horizon_h)


def rel_position(mid, spot, width) -> Column:
    return F.rint((_c(mid) - _c(spot)) / F.nullif(_c(width), F.lit(0.0))).cast("int")


def executable_prices(yes, no) -> Column:
    """Struct of the prices and sizes one can trade at: selling yes at the best yes bid, buying yes at 1 - best no bid."""
    y, n = F.get(_c(yes), F.lit(0)), F.get(_c(no), F.lit(0))
    return F.struct(y["price"].alias("sell_yes"), (1 - n["price"]).alias("buy_yes"), F.coalesce(y["size"], F.lit(0)).alias("sell_size"), F.coalesce(n["size"], F.lit(0)).alias("buy_size"))


def mid_from_quote(bid, ask, last) -> Column:
    b, a, x = _c(bid), _c(ask), _c(last)
    inside = lambda p: (p > 0) & (p < 1)
    return F.when(inside(b) & inside(a) & (a >= b), (b + a) / 2).when(inside(x), x)


def clv_pp(side, entry, line) -> Column:
    """Closing-line gain in percentage points: positive where the line moved the position's way."""
    return F.when(_c(side) == "sell_yes", (_c(entry) - _c(line)) * 100).when(_c(side) == "buy_yes", (_c(line) - _c(entry)) * 100)


def kelly_risk(side, price_cents, edge_pp, nav, fraction: float = 0.25, cap: float = 0.01) -> Column:
    """Money at risk by fractional Kelly, at most ``cap`` of ``nav``, never negative."""
    p = _c(price_cents) / 100
    e = _c(edge_pp) / 100
    sell = _c(side) == "sell_yes"
    true = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.when(sell, p - e).otherwise(p + e)))
    full = F.when(sell, (p - true) / F.nullif(p, F.lit(0.0))).otherwise((true - p) / F.nullif(1 - p, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(full * fraction * _c(nav), F.lit(cap) * _c(nav)))


def equal_sigma_size(sigma, nav, target: float = 0.02, n_target: int = 150, cap: float = 0.01) -> Column:
    s = _c(sigma)
    return F.when(s <= 0, 0.0).otherwise(F.least(F.lit(target) * _c(nav) / (F.when(s > 0, s) * math.sqrt(n_target)), F.lit(cap) * _c(nav)))


def risk_reward(side, price, budget, fee: float = 0.07) -> Column:
    """Struct of what a contract risks and can win, whole contracts (one at least), and the position's risk, reward and fees."""
    p, sell = _c(price), _c(side) == "sell_yes"
    risk, reward = F.when(sell, 1 - p).otherwise(p), F.when(sell, p).otherwise(1 - p)
    n = F.greatest(F.lit(1), F.floor(_c(budget) / F.nullif(risk, F.lit(0.0))).cast("int"))
    return F.struct(risk.alias("risk_each"), reward.alias("reward_each"), n.alias("contracts"), (n * risk).alias("risk"), (n * reward).alias("reward"), (F.lit(2 * fee) * p * (1 - p) * n).alias("fees"))


def binary_pnl(side, result, reward, risk, fees) -> Column:
    """Profit at settlement net of fees; 0 if void (no yes or no result)."""
    r = F.lower(_c(result))
    won = ((_c(side) == "sell_yes") & (r == "no")) | ((_c(side) == "buy_yes") & (r == "yes"))
    return F.when(~F.coalesce(r.isin("yes", "no"), F.lit(False)), 0.0).when(won, _c(reward) - _c(fees)).otherwise(-_c(risk) - _c(fees))


def per_bet_return(side, price, result) -> Column:
    p, sell = _c(price), _c(side) == "sell_yes"
    risk, reward = F.when(sell, 1 - p).otherwise(p), F.when(sell, p).otherwise(1 - p)
    won = (sell & (_c(result) == "no")) | (~sell & (_c(result) == "yes"))
    return F.when(won, reward / F.nullif(risk, F.lit(0.0))).otherwise(-1.0)


def signal_ok(direction, entry, stop, target, min_rr: float = 2.0) -> Column:
    """Whether prices are positive, in order, and reward is at least ``min_rr`` times the risk."""
    e, s, t = _c(entry), _c(stop), _c(target)
    order = F.when(_c(direction) == "long", (s < e) & (e < t)).otherwise((t < e) & (e < s))
    return F.coalesce((e > 0) & (s > 0) & (t > 0) & order & (F.abs(t - e) >= min_rr * F.abs(e - s)), F.lit(False))


def iron_triangle_size(entry, stop, nav, risk: float = 0.02, cap: float = 0.05) -> Column:
    """Struct (units, risk): money at risk is the lesser of two shares of ``nav``, units that over the stop distance."""
    money = F.least(F.lit(risk) * _c(nav), F.lit(cap) * _c(nav))
    return F.struct((money / F.nullif(F.abs(_c(entry) - _c(stop)), F.lit(0.0))).alias("units"), money.alias("risk"))


def perp_close_pnl(direction, units, entry, exit, funding, fee: float = 0.00045, slip: float = 0.0005) -> Column:
    u, a, b = _c(units), _c(entry), _c(exit)
    gross = F.when(_c(direction) == "long", u * (b - a)).otherwise(u * (a - b))
    fees = u * (a + b) * (fee + slip)
    return F.struct(gross.alias("gross"), fees.alias("fees"), (gross - fees - _c(funding)).alias("net"))


def score(pct_return, max_dd, n_trades) -> Column:
    r, d, n = _c(pct_return), _c(max_dd), _c(n_trades)
    deep = (d - 0.2) / 0.1
    return 200 * r - F.when(d > 0.2, deep * deep * 200).otherwise(0.0) - F.when(n < 20, 10.0 * (20 - n)).otherwise(0.0)


def n_for_confidence(sharpe, z: float = 1.6449) -> Column:
    """Trades needed to be sure of a positive mean; null where the ratio is not positive."""
    s = _c(sharpe)
    return F.when(s > 0, F.ceil((z / F.when(s > 0, s)) * (z / F.when(s > 0, s))).cast("long"))


def coin_of(symbol) -> Column:
    return F.regexp_replace(_c(symbol), r"[-_]PERP$", "")


def perp_name(symbol) -> Column:
    return F.concat(F.replace(coin_of(symbol), F.lit("-"), F.lit("_")), F.lit("_PERP"))


def hours_to_expiry(expected_close, now) -> Column:
    """Hours between two times in microseconds."""
    return (_c(expected_close) - _c(now)) / 3.6e9


def roi_pct(nav, initial) -> Column:
    return (_c(nav) / F.nullif(_c(initial), F.lit(0.0)) - 1) * 100


def retention(holdout, in_sample) -> Column:
    return _c(holdout) / F.nullif(_c(in_sample), F.lit(0.0))
