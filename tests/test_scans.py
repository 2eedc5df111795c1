"""Scans, searches and selections by block against plain forms, on long series and groups that hold most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quaywork.operators import bars as B
from quaywork.operators import book, ladder
from quaywork.operators import outcomes as O
from quaywork.operators.selection import ACCURACY, exact_quantiles


def series(sizes: dict[str, int], seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for s, n in sizes.items():
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        parts.append(pd.DataFrame({"symbol": s, "i": np.arange(n), "t": np.arange(n) * 3_600_000_000, "open": close * (1 + rng.normal(0, 0.003, n)), "close": close, "volume": rng.integers(1, 99, n).astype(float)}))
        parts[-1]["high"] = parts[-1][["open", "close"]].max(axis=1) * 1.003
        parts[-1]["low"] = parts[-1][["open", "close"]].min(axis=1) * np.where(rng.random(n) < 0.05, 0.97, 0.997)
    return pd.concat(parts, ignore_index=True)


# --- exponential means ------------------------------------------------------------------------------------------------


def test_affine_means_equal_plain_recursion(spark):
    p = series({"a": 1, "b": 64, "c": 65, "d": 40_000, "e": 300})
    p["close"] *= np.where(np.arange(len(p)) % 7 == 0, -1, 1)  # signs change
    p.loc[(p.symbol == "e") & (p.i < 70), "close"] = np.nan
    d = spark.createDataFrame(p).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = B.ema(d, "close", [1, 2, 12, 200]).toPandas().sort_values(["symbol", "i"]).reset_index(drop=True)
    for span in (1, 2, 12, 200):
        want = p.groupby("symbol").close.transform(lambda x, s=span: x.ewm(span=s, adjust=False).mean())
        assert (got[f"ema_{span}"].isna() == want.isna()).all() and np.nanmax(np.abs(got[f"ema_{span}"] - want)) < 1e-9
    assert "MapInPandas" not in B.macd_hist(d)._jdf.queryExecution().executedPlan().toString()


def test_affine_means_take_spans_from_columns(spark):
    p = series({"a": 500, "b": 90})
    d = spark.createDataFrame(p).withColumn("span", F.explode(F.array(F.lit(3), F.lit(40))))
    got = B.affine_means(d, {"mean": (F.col("close"), 2 / (F.col("span") + 1))}, ["symbol", "span"], "i").toPandas()
    for (s, n), own in got.groupby(["symbol", "span"]):
        own = own.sort_values("i")
        assert np.abs(own["mean"] - own.close.ewm(span=n, adjust=False).mean()).max() < 1e-9
    assert B.ema(d.limit(0), "close", [5], ["symbol", "span"]).count() == 0


# --- exits ------------------------------------------------------------------------------------------------------------


def first_exit(low, high, close, s):
    lo, hi = (s.stop, s.target) if s.direction == "long" else (s.target, s.stop)
    k = s.i + 1
    hit = np.flatnonzero((low[k:] <= lo) | (high[k:] >= hi))
    if not len(hit):
        return len(low) - 1, close[-1], "end_of_data"
    j = k + int(hit[0])
    stopped = low[j] <= s.stop if s.direction == "long" else high[j] >= s.stop
    return j, (s.stop if stopped else s.target), ("stop" if stopped else "target")


def test_exits_over_a_million_bars(spark):
    p = series({"long": 1_000_000, "short": 130, "one": 1}, 3)
    d = spark.createDataFrame(p[["symbol", "i", "low", "high", "close"]])
    rng = np.random.default_rng(4)
    rows = []
    for s, n in (("long", 1_000_000), ("short", 130), ("one", 1)):
        close = p[p.symbol == s].close.to_numpy()
        for i in [*rng.integers(0, n, 150 if n > 1 else 1).tolist(), n - 1, 0]:
            for width in (0.01, 0.1, 0.6, 5.0) if n > 1 else (0.1,):  # exits in the next bars, blocks of blocks away, never
                for up in (True, False):
                    e = float(close[i])
                    rows.append((s, int(i), "long" if up else "short", e, e * (1 - min(width, 0.99)) if up else e * (1 + width), e * (1 + width) if up else e * (1 - min(width, 0.99))))
    rows = list(dict.fromkeys(rows)) + rows[:3]  # equal rows are one signal
    signals = spark.createDataFrame(rows, "symbol string, i long, direction string, entry double, stop double, target double")
    got = O.barrier_label(signals, d).toPandas()
    assert len(got) == len(set(rows))
    by = {s: (x.low.to_numpy(), x.high.to_numpy(), x.close.to_numpy()) for s, x in p.groupby("symbol")}
    far = 0
    for r in got.itertuples():
        assert (r.exit_i, r.exit_price, r.reason) == first_exit(*by[r.symbol], r)
        far += r.exit_i // O.FAN**2 > r.i // O.FAN**2 and r.reason != "end_of_data"
    assert far > 50 and set(got.reason) == {"stop", "target", "end_of_data"}


def test_books_are_folds_in_order_whatever_the_batches(spark):
    rng = np.random.default_rng(5)
    rows = []
    for s in ("a", "b", "c"):
        for i in rng.integers(0, 5000, 900 if s == "a" else 40).tolist():
            rows.append((s, int(i), "long", 100.0, 99.0, 103.0, int(i + rng.integers(1, 9)), float(rng.choice([99.0, 103.0])), "stop", f"2024-{1 + i // 500:02d}"))
    d = spark.createDataFrame(rows, "symbol string, i long, direction string, entry double, stop double, target double, exit_i long, exit_price double, reason string, month string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found.append((sorted(map(tuple, O.non_overlap(d).collect())), sorted(map(tuple, O.simulate(d).collect()))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found[0] == found[1]
    for s in "abc":
        free, want = -1, 0
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], *r[2:6])):
            if r[1] > free:
                want, free = want + 1, r[6]
        assert abs(sum(r[0] == s for r in found[0][0]) - want) <= (s == "a") * want * 0.1  # rows of one bar are in any order


# --- sweeps -----------------------------------------------------------------------------------------------------------


def configs(spark, n):
    rows = [(k, *(("false_breakout", {"lookback": str(10 + k % 7), "confirm": str(1 + k % 4)}) if k % 2 else ("kangaroo_tail", {"context": str(5 + k % 5), "lag": str(1 + k % 2), "min_rr": "1.0"}))) for k in range(n)]
    return spark.createDataFrame(rows, "config_id long, template string, params map<string, string>")


def test_configured_templates_equal_single_ones(spark):
    d = spark.createDataFrame(series({"a": 900, "b": 400, "c": 3})).cache()
    key = lambda df: sorted((r.symbol, r.i, r.direction, round(r.entry, 9), round(r.stop, 9), round(r.target, 9)) for r in df.collect())
    cs = spark.createDataFrame([(1, "false_breakout", {"lookback": "12", "min_width": "0.01", "confirm": "2"}), (2, "false_breakout", {"lookback": "40"}), (3, "kangaroo_tail", {"multiple": "1.2", "min_rr": "0.5", "context": "6"}), (4, "channel_fade", {"span": "9", "width": "0.01", "gap": "3"})], "config_id long, template string, params map<string, string>")
    breakouts = O.false_breakouts(d, cs)
    assert key(breakouts.where("config_id = 1")) == key(O.false_breakout(d, 12, 0.01, 2)) != []
    assert key(breakouts.where("config_id = 2")) == key(O.false_breakout(d, 40))
    assert key(O.kangaroo_tails(d, cs)) == key(O.kangaroo_tail(d, 6, 1.2, min_rr=0.5)) != []
    assert key(O.channel_fades(d, cs)) == key(O.channel_fade(d, 9, 0.01, 3)) != []


def test_sweep_has_one_plan_for_any_number_of_configurations(spark):
    d = spark.createDataFrame(series({"a": 300, "b": 200}))
    size = lambda n: len(O.sweep(d, configs(spark, n).withColumn("params", F.col("params")))._jdf.queryExecution().analyzed().toString().split("\n"))
    assert size(4) == size(6000)
    out = O.sweep(d, configs(spark, 20).union(spark.createDataFrame([(99, "nothing", {}), (100, "kangaroo_tail", {"lag": "11", "x": "1"})], "config_id long, template string, params map<string, string>"))).toPandas()
    assert len(out) == 22 * 2 and set(out[out.config_id >= 99].status) == {"error"}
    assert set(out[out.config_id == 100].reason) == {"lag: range; x: unknown"} and set(out[out.config_id == 99].reason) == {"template: choice"}
    assert out[out.status == "rejected"].reason.isin(["too few trades", "profit factor"]).all() and (out.n_trades > 0).any()


def test_rolling_by_equals_frames(spark):
    d = spark.createDataFrame(series({"a": 400, "b": 9})).withColumn("n", F.explode(F.array(F.lit(1), F.lit(7), F.lit(100))))
    got = B.rolling_by(d, "n", {"lo": ("min", "low"), "hi": ("max", "high"), "sum": ("sum", "volume")})
    some = B.rolling_by(d, "n", {"sum": ("sum", "volume")}, partial=True).toPandas().set_index(["symbol", "n", "i"])["sum"]
    for (s, n), own in got.toPandas().groupby(["symbol", "n"]):
        own = own.sort_values("i").reset_index(drop=True)
        for name, c, f in (("lo", "low", "min"), ("hi", "high", "max"), ("sum", "volume", "sum")):
            want = getattr(own[c].shift(1).rolling(n), f)()
            assert np.allclose(own[name], want, equal_nan=True)
        want = own.volume.shift(1).rolling(n, min_periods=1).sum()
        assert np.allclose(some.loc[(s, n)].sort_index(), want, equal_nan=True)


# --- prefix scans and selection -----------------------------------------------------------------------------------------


def positions(spark, n=6000):
    """One category holds nine rows in ten."""
    rng = np.random.default_rng(8)
    day = 86_400_000_000
    rows = [(k, "hot" if k % 10 else None if k % 3 else "cold", int(rng.integers(0, 40)) * day + int(rng.integers(0, 5)), int(rng.integers(0, 40)) * day, ["closed", "open"][k % 2], ["sell_yes", "buy_yes"][k % 3 > 0], ["yes", "no"][k % 5 > 1], int(rng.integers(1, 50)), int(rng.integers(1, 50)), int(rng.integers(0, 30)) if k % 50 else None) for k in range(n)]
    return spark.createDataFrame(rows, "id long, category string, closes long, entered long, status string, side string, result string, risk_cents long, reward_cents long, edge_pp long")


def test_scans_of_hot_groups_equal_windows(spark):
    p = positions(spark)
    w = Window.partitionBy("category").orderBy("closes", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = p.where("status = 'closed'").select("category", "id", "closes", F.sum(book.pnl_cents()).over(w).alias("cum_pnl"))
    assert sorted(map(str, want.collect())) == sorted(map(str, book.cum_pnl(p).collect()))
    w = Window.partitionBy("category").orderBy("entered", "id").rowsBetween(-100, -1)
    want = {r.id: r.m for r in p.select("id", F.avg("edge_pp").over(w).alias("m")).collect()}
    got = {r.id: (r.prior_mean, r.admit, r.edge_pp) for r in book.rolling_quality(p).collect()}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert (m is None) == (got[k][0] is None) and (m is None or abs(m - got[k][0]) < 1e-9)
        assert got[k][1] == (True if m is None or got[k][2] is None else got[k][2] >= got[k][0])


def test_drawdowns_by_block(spark):
    p = series({"a": 3 * B.SCAN + 17, "b": 5, "c": 1})
    d = spark.createDataFrame(p)
    got = B.drawdown_series(d).toPandas().sort_values(["symbol", "i"]).reset_index(drop=True)
    peak = p.groupby("symbol").close.cummax()
    assert np.array_equal(got.peak, peak) and np.allclose(got.drawdown, (peak - p.close) / peak)
    worst = {r.symbol: r.max_dd for r in B.max_drawdown(d).collect()}
    assert worst == pytest.approx(((peak - p.close) / peak).groupby(p.symbol).max().to_dict())
    least = B.cum_min(d, "low", ["symbol"], "i").toPandas().sort_values(["symbol", "i"]).reset_index(drop=True)
    assert np.array_equal(least.cum_min, p.groupby("symbol").low.cummin())


@pytest.mark.parametrize("column", ["v", "ties"])
def test_quantiles_are_exact(spark, column):
    sizes = [1, 2, 3, 10, 319, ACCURACY - 1, ACCURACY, 5 * ACCURACY]
    d = spark.createDataFrame([(g, n) for g, n in enumerate(sizes)], "g int, n int").select("g", F.explode(F.sequence(F.lit(1), "n")).alias("k")).repartition(7)
    h = F.pmod(F.xxhash64("g", "k"), F.lit(1_000_003))
    d = d.select("g", ((h - 500_000) * F.pow(F.lit(10.0), h % 13 - 6)).alias("v"), (h % 5).cast("double").alias("ties"))
    d = d.union(spark.createDataFrame([(0, None, float("nan")), (50, None, None)], "g int, v double, ties double")).cache()
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0, "f": 0.99999}
    good = d.where(f"{column} is not null and not isnan({column})")
    plain = [F.percentile(column, F.lit(q)).alias(n) for n, q in qs.items()]
    close = lambda a, b: len(a) == len(b) and all(np.isclose(x, y, rtol=1e-12, atol=0) for x, y in zip(a, b, strict=True))
    got, want = ({r.g: tuple(r)[1:] for r in x.collect()} for x in (exact_quantiles(d, ["g"], column, qs), good.groupBy("g").agg(*plain)))
    assert got.keys() == want.keys() and all(close(got[g], want[g]) for g in want)
    assert close(tuple(exact_quantiles(d, [], column, qs).first()), tuple(good.agg(*plain).first()))
    assert exact_quantiles(d.limit(0), [], column, qs).count() == 0


def test_bucket_shares_equal_plain(spark):
    p = series({"a": 24 * 60, "b": 24 * 3})
    d = spark.createDataFrame(p)
    hour = 3_600_000_000
    panel = [(s, t * hour + 7, s, 100.0, lo, lo + 1.5) for s in "ab" for t in (10, 71, 500, 900, 1439) for lo in (96.0, 97.5, 99.0, 100.5, 102.0)]
    x = spark.createDataFrame(panel, "event string, t long, symbol string, spot double, lo double, hi double")
    for past in (False, True):
        got = {(r.event, r.t, r.lo): (r.samples, r.q) for r in ladder.empirical_bucket_prob(x, d, 5 * 24 * hour, 25, 30, past).collect()}
        want = {}
        for s, t, _, spot, lo, hi in panel:
            own = p[p.symbol == s].reset_index(drop=True)
            r = own.close.shift(-25) / own.close - 1
            ok = r.notna() & (own.t >= t - 5 * 24 * hour) & (own.t < t) & ((own.t + 25 * hour <= t) if past else True)
            if ok.sum() >= 30:
                want[s, t, lo] = (int(ok.sum()), float(((spot * (1 + r[ok]) >= lo) & (spot * (1 + r[ok]) < hi)).sum() / ok.sum()))
        assert got.keys() == want.keys() and len(want) > 10
        for (s, t, lo), (n, share) in want.items():
            total = sum(v[1] for k, v in want.items() if k[:2] == (s, t))
            assert got[s, t, lo][0] == n
            assert got[s, t, lo][1] == pytest.approx(share / total) if total else got[s, t, lo][1] is None
