"""Operators without a SQL twin, against plain loops on small data."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaywork.functions import scalars as S
from quaywork.operators import asof, bars, outcomes
from quaywork.sources.adapters import read

SF = "/root/testdata/sf0.001"


def test_erf(spark):
    xs = [x / 10 for x in range(-70, 71)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", S.erf("x").alias("y")).collect()
    assert all(abs(r.y - math.erf(r.x)) < 1e-12 for r in got)


@pytest.mark.parametrize("n,k,low,high", [(0, 0, 0.0, 0.0), (100, 100, 0.963, 1.0)])
def test_wilson(spark, n, k, low, high):
    r = spark.range(1).select(S.wilson_ci(F.lit(k), F.lit(n)).alias("x")).first().x
    assert r.low == pytest.approx(low, abs=1e-3) and r.high == pytest.approx(high, abs=1e-3)


def test_parse_price_and_labels(spark):
    rows = [("0.25",), ("25",), ("250",), ("",), (None,), ("x",)]
    d = spark.createDataFrame(rows, "raw string")
    assert [r[0] for r in d.select(S.parse_price("raw")).collect()] == [0.25, 0.25, 1.0, None, None, None]
    t = spark.createDataFrame([("$1,000 to 1,999.5",), ("Above 4.25%",), (None,)], "s string")
    got = t.select(S.parse_bucket_range("s").alias("b"), S.parse_threshold("s").alias("t")).collect()
    assert got[0].b.mid == 1499.75 and got[1].t == 4.25 and got[2].b is None


def test_asof_slices_equal_plain(spark):
    t = read(spark, SF, "trades")
    m = read(spark, SF, "markets")
    r = t.select("ticker", F.col("t").alias("tt"), "trade_id")
    plain = asof.asof_join(m, r, ["ticker"], "opened", "tt", "left", "trade_id")
    sliced = asof.asof_join(m, r, ["ticker"], "opened", "tt", "left", "trade_id", slice_us=86_400_000_000)
    key = ["ticker", "slot", "trade_id"]
    assert sorted(map(str, plain.select(key).collect())) == sorted(map(str, sliced.select(key).collect()))


def test_asof_nulls_and_empty(spark):
    left = spark.createDataFrame([("a", 5), ("a", None), (None, 5), ("b", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 9, 3)], "k string, rt long, id long")
    got = {(r.k, r.t): r.id for r in asof.asof_join(left, right, ["k"], "t", "rt", "left", "id").collect()}
    assert got[("a", 5)] == 2 and got[("a", None)] is None and got[("b", 1)] is None
    assert asof.asof_join(left, right.limit(0), ["k"], "t", "rt").count() == 0


def test_ema_is_recursive_mean(spark):
    b = read(spark, SF, "bars").where("symbol = 'Brand#11'")
    got = bars.ema(b, "close", [12]).toPandas().sort_values("i")
    assert (got["close"].ewm(span=12, adjust=False).mean() - got["ema_12"]).abs().max() < 1e-9


def test_barrier_stop_wins_ties(spark):
    b = spark.createDataFrame([("x", i, 101.0, 99.0, 100.0) for i in range(200)] + [("x", 200, 115.0, 93.0, 100.0), ("x", 201, 101.0, 99.0, 100.0)], "symbol string, i long, high double, low double, close double")
    s = spark.createDataFrame([("x", 0, "long", 100.0, 95.0, 110.0), ("x", 201, "long", 100.0, 95.0, 110.0)], "symbol string, i long, direction string, entry double, stop double, target double")
    got = {r.i: (r.exit_i, r.exit_price, r.reason) for r in outcomes.barrier_label(s, b).collect()}
    assert got == {0: (200, 95.0, "stop"), 201: (201, 100.0, "end_of_data")}


def test_non_overlap_skips(spark):
    t = spark.createDataFrame([("x", 1, "long", 5), ("x", 5, "long", 7), ("x", 6, "long", 9), ("y", 2, "long", 3)], "symbol string, i long, direction string, exit_i long")
    assert sorted((r.symbol, r.i) for r in outcomes.non_overlap(t).collect()) == [("x", 1), ("x", 6), ("y", 2)]


def test_pandas_template(spark):
    run = outcomes.from_pandas_template(lambda p: pd.DataFrame({"i": [int(p["i"].max())], "direction": ["long"], "entry": [10.0], "stop": [9.0], "target": [13.0]}))
    b = read(spark, SF, "bars")
    assert run(b).count() == b.select("symbol").distinct().count()


def test_asof_ties_of_any_type(spark):
    left = spark.createDataFrame([("a", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "t-10"), ("a", 5, "t-9"), ("a", 6, "t-2"), ("a", 6, "t-1")], "k string, rt long, id string")
    assert asof.asof_join(left, right, ["k"], "t", "rt", "left", "id").first().id == "t-9"
    assert asof.asof_join(left, right, ["k"], "t", "rt", "left", "id", slice_us=2).first().id == "t-9"
    assert asof.asof_join(left, right, ["k"], "t", "rt", "left", "id", forward=True).first().id == "t-1"


def test_global_rank_of_any_type(spark):
    rows = [("b", 1), (None, 2), ("a", 3), ("a", 1), ("hot", 0)] + [("hot", k) for k in range(1, 400)]
    d = spark.createDataFrame(rows, "s string, n int")
    got = sorted((r["rank"], r.s, r.n) for r in asof.global_rank(d, [F.col("s"), F.col("n")]).collect())
    assert [g[1:] for g in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])) and [g[0] for g in got] == list(range(len(rows)))


def book(spark, rows, **kw):
    cols = "symbol string, i long, direction string, entry double, stop double, target double, exit_i long, exit_price double, month string"
    return sorted(outcomes.simulate(spark.createDataFrame(rows, cols), fee=0.0, slip=0.0, **kw).collect(), key=lambda r: r.i)


def test_book_breaker_overlap_and_floor(spark):
    lose = lambda i, out, m: ("x", i, "long", 100.0, 90.0, 130.0, out, 90.0, m)
    # three losses of 2 % reach the breaker of a month; the month after begins anew
    rows = [lose(1, 2, "a"), lose(3, 4, "a"), lose(5, 6, "a"), lose(7, 60, "a"), lose(8, 9, "b"), lose(9, 10, "b"), lose(10, 11, "b")]
    got = book(spark, rows, breaker=0.05)
    assert [r.i for r in got] == [1, 3, 5, 8, 10]  # 7 is halted and so blocks nothing, 9 overlaps
    assert got[2].nav == pytest.approx(10_000 * 0.98**3) and got[0].units == pytest.approx(20.0)
    deep = [lose(k, k, f"m{k}") for k in range(100)]
    assert book(spark, deep, floor=9_000.0)[-1].nav < 9_000 and len(book(spark, deep, floor=9_000.0)) == 6
