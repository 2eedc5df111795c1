"""Normalisation, idempotent upserts, and streams against their batch forms."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaywork.plans.registry import flows
from quaywork.sources import ingest
from quaywork.streaming import streams


def raw(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")


def test_candles(spark):
    a = ingest.normalize_candles(raw(spark, [{"t": 1000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "9", "n": 3}, {"t": None}])).collect()
    assert [(r.t, r.close, r.trades) for r in a] == [(1_000_000, 1.5, 3)]
    b = ingest.normalize_candles(spark.createDataFrame([("[[2,1,4,2,3,7],[1,1,4,2,3,7]]",), ("x",)], "raw string"), "array").collect()
    assert sorted((r.t, r.low, r.high, r.open, r.close) for r in b) == [(1_000_000, 1.0, 4.0, 2.0, 3.0), (2_000_000, 1.0, 4.0, 2.0, 3.0)]


def test_markets_trades_books(spark):
    m = ingest.normalize_markets(raw(spark, [{"ticker": "A", "event_ticker": "KXBTC-1", "yes_bid": 45, "yes_bid_dollars": "0.46", "last_price": "50", "volume_fp": "7.0", "title": "", "yes_sub_title": "T"}])).first()
    assert (m.series_ticker, m.yes_bid, m.last_price, m.volume, m.title) == ("KXBTC", 0.46, 0.5, 7, "T")
    good, bad = ingest.normalize_trades(raw(spark, [{"trade_id": "1", "ticker": "A", "count_fp": "2.6", "yes_price": 30, "created_time": "2024-01-01T00:00:00Z"}, {"trade_id": "2", "ticker": "B"}]), spark.createDataFrame([("A", "E")], "ticker string, event_ticker string"))
    g = good.first()
    assert (g["count"], g.yes_price, g.event_ticker) == (3, 0.3, "E") and bad.count() == 1
    o = ingest.normalize_orderbooks(raw(spark, [{"ticker": "A", "yes": [["0.4", "5"], ["0.3", "0"], ["x", "1"]]}])).first()
    assert [(x.price, x.size) for x in o.yes] == [(0.4, 5)] and o.no == []


def test_flatten_l2(spark):
    d = spark.sql("SELECT 'c' AS coin, array(array(struct('10' AS px, '1' AS sz, 1 AS n)), array(struct('12' AS px, '2' AS sz, 1 AS n))) AS levels")
    r = ingest.flatten_l2(d, 3).first()
    assert (r.mid, r.spread, r.bid_px_1) == (11.0, 2.0, None) and len(r) == 1 + 12 + 3


def trade_rows(spark, rows):
    return spark.createDataFrame([(i, p, dt.datetime(2024, 1, d)) for i, p, d in rows], "trade_id string, price double, created_time timestamp").withColumn("date", F.to_date("created_time"))


def test_upsert_keeps_first_and_is_idempotent(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    ingest.upsert_partitioned(trade_rows(spark, [("a", 1.0, 1), ("b", 2.0, 2)]), root, ["trade_id"], "date").collect()
    for _ in range(2):
        ingest.upsert_partitioned(trade_rows(spark, [("a", 9.0, 1), ("c", 3.0, 2)]), root, ["trade_id"], "date").collect()
    assert sorted((r.trade_id, r.price) for r in spark.read.parquet(root).collect()) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]
    ingest.upsert_partitioned(trade_rows(spark, [("a", 9.0, 1)]), root, ["trade_id"], "date", "last", "created_time").collect()
    assert spark.read.parquet(root).where("trade_id = 'a'").first().price == 9.0


def test_watermarks(spark):
    t = spark.createDataFrame([("1", "A", 1), ("2", "A", 5), ("3", "B", 2)], "trade_id string, ticker string, t long")
    w = ingest.watermarks(t)
    new = spark.createDataFrame([("2", "A", 5), ("4", "A", 5), ("5", "A", 4), ("6", "C", 9)], "trade_id string, ticker string, t long")
    assert [r.trade_id for r in ingest.new_since(new, w).collect()] == ["4"]


def test_ticks(spark):
    lines = ["2024-01-01 00:00:01 start", "entered=2 rejected=3 candidates=7 resolved=1 voided=0", "noise"]
    d = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "file string, line int, value string")
    r = ingest.parse_ticks(d).collect()
    assert len(r) == 1 and (r[0].at, r[0].entered, r[0].shadow) == ("2024-01-01 00:00:01", 2, None)


def test_stream_trades_and_bars(spark, tmp_path):
    src = f"file://{tmp_path}/src"
    rows = [("a", 1.0, 1), ("a", 1.0, 1), ("b", 2.0, 2)]
    trade_rows(spark, rows).drop("date").write.parquet(src)
    stream = spark.readStream.schema("trade_id string, price double, created_time timestamp").parquet(src)
    streams.stream_trades(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.trade_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]


def streamed(spark, tmp_path, name, schema, rows):
    src = f"file://{tmp_path}/{name}"
    spark.createDataFrame(rows, schema).write.parquet(src)
    return spark.readStream.schema(schema).parquet(src)


def run(spark, tmp_path, stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}").collect()


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(flows.ROCKS[0])
    spark.conf.set(*flows.ROCKS)
    yield
    spark.conf.set(flows.ROCKS[0], before)


def day(d, h=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d - 1, hours=h)


def arrivals(spark, tmp_path, name, schema, batches):
    """A stream of batches, in their order."""
    src = f"file://{tmp_path}/{name}"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


BARS = [("x", day(1), 101.0, 99.0, 100.0), ("x", day(2), 115.0, 93.0, 100.0), ("x", day(3), 120.0, 90.0, 104.0), ("y", day(2), 10.0, 9.0, 9.5), ("y", day(6), 10.0, 9.0, 9.25)]
POSITIONS = [(1, "x", day(1), "long", 95.0, 110.0), (2, "x", day(1), "short", 130.0, 91.0), (3, "x", day(2), "long", 95.0, 119.0), (4, "y", day(1), "long", 1.0, 20.0), (5, "z", day(1), "long", 1.0, 2.0)]
ENDS = [("y", day(7)), ("~", day(40))]
EXITS = [(1, day(2), 95.0, "stop"), (2, day(3), 91.0, "target"), (3, day(3), 95.0, "stop"), (4, day(6), 9.25, "end_of_data")]


@pytest.mark.parametrize("split", ["one", "each", "positions last", "bars backwards"])
def test_stream_barriers_in_any_batches(spark, tmp_path, rocks, split):
    """Rows of a batch, and rows of up to the delay before, may come in any order."""
    bars = {"one": [BARS], "each": [[b] for b in sorted(BARS, key=lambda b: b[1])], "positions last": [BARS], "bars backwards": [[b] for b in BARS[::-1]]}[split]
    positions = {"one": [POSITIONS], "each": [[p] for p in POSITIONS], "positions last": [[p] for p in POSITIONS[::-1]], "bars backwards": [POSITIONS]}[split]
    b = arrivals(spark, tmp_path, "b", "symbol string, ts timestamp, high double, low double, close double", bars)
    p = arrivals(spark, tmp_path, "p", "id long, symbol string, ts timestamp, direction string, stop double, target double", positions)
    e = arrivals(spark, tmp_path, "e", "symbol string, ts timestamp", [ENDS[1:]] if split == "x" else [ENDS])
    got = run(spark, tmp_path, streams.stream_barriers(b, p, e, delay="60 days"), "none_yet") if split == "one" else []
    assert got == []  # nothing is decided before the watermark has passed it
    late = arrivals(spark, tmp_path, "e2", "symbol string, ts timestamp", [ENDS[:1], *[[("~", day(1))]] * 6, [("~", day(99))]])
    got = run(spark, tmp_path, streams.stream_barriers(b, p, late, delay="20 days"), f"exits_{split.replace(' ', '_')}")
    assert sorted((r.id, r.ts, r.price, r.reason) for r in got) == EXITS


def test_stream_barriers_expire(spark, tmp_path, rocks):
    b = arrivals(spark, tmp_path, "b", "symbol string, ts timestamp, high double, low double, close double", [BARS + [("~", day(40), 1.0, 1.0, 1.0)]])
    p = arrivals(spark, tmp_path, "p", "id long, symbol string, ts timestamp, direction string, stop double, target double", [POSITIONS])
    got = run(spark, tmp_path, streams.stream_barriers(b, p, expire_us=4 * 86_400_000_000), "expired")
    assert sorted((r.id, r.ts, r.price, r.reason) for r in got) == [*EXITS[:3], (4, day(5), 9.5, "expired"), (5, day(5), None, "expired")]


@pytest.mark.parametrize("split", [False, True])
def test_stream_freshness(spark, tmp_path, rocks, split):
    hour = lambda h: day(1, h)
    rows = [("a", hour(0)), ("b", hour(0)), ("a", hour(3)), ("b", hour(10)), ("b", hour(20)), ("c", hour(39)), ("b", hour(40)), ("~", hour(45))]
    bars = arrivals(spark, tmp_path, "f", "symbol string, ts timestamp", [[r] for r in rows] if split else [rows])
    universe = spark.createDataFrame([(s, hour(0)) for s in ("a", "b", "c", "never")], "symbol string, since timestamp")
    got = run(spark, tmp_path, streams.stream_freshness(bars, universe, 8 * 3_600_000_000, 30 * 3_600_000_000), f"fresh_{split}")
    said = sorted((r.symbol, r.at, r.state, r.last_ts) for r in got)
    assert said == [
        ("a", hour(11), "stale", hour(3)), ("a", hour(33), "very_stale", hour(3)), ("b", hour(8), "stale", hour(0)), ("b", hour(10), "fresh", hour(10)), ("b", hour(18), "stale", hour(10)), ("b", hour(20), "fresh", hour(20)), ("b", hour(28), "stale", hour(20)), ("b", hour(40), "fresh", hour(40)), ("c", hour(8), "stale", None), ("c", hour(39), "fresh", hour(39)), ("never", hour(8), "stale", None),
    ]


def test_stream_bars_shadow(spark, tmp_path):
    ticks = [(k, "x", dt.datetime(2024, 1, 1, 0, k), float(k % 7), 1) for k in range(40)] + [(99, "x", dt.datetime(2024, 1, 2), 1.0, 1)]
    got = run(spark, tmp_path, streams.stream_bars(streamed(spark, tmp_path, "t", "id long, symbol string, ts timestamp, price double, size long", ticks)), "bars15")
    assert sorted((r.start.minute, r.open, r.close, r.trades) for r in got) == [(0, 0.0, 0.0, 15), (15, 1.0, 1.0, 15), (30, 2.0, 4.0, 10)]
    rows = [[("k", day(1, 2), 2)], [("k", day(1, 1), 1), ("k", day(2, 6), 30)], [("k", day(9), 99)]]  # the first by time comes second
    got = run(spark, tmp_path, streams.stream_shadow(arrivals(spark, tmp_path, "s", "ticker string, ts timestamp, n int", rows)), "shadowed")
    assert sorted((r.reject_date.day, r.n) for r in got) == [(1, 1), (2, 30)]


@pytest.mark.parametrize("order", [0, 1, 2])
def test_stream_settle_in_any_order(spark, tmp_path, rocks, order):
    u, p = "ticker string, ts timestamp, status string, result string", "id long, ticker string, entered_at timestamp, side string, reward_cents long, risk_cents long"
    ups = [("A", day(2), "active", ""), ("A", day(300), "settled", "no"), ("B", day(3), "settled", ""), ("A", day(301), "settled", "yes"), ("C", day(5), "settled", "yes")]
    held = [(1, "A", day(1), "sell_yes", 30, 70), (2, "A", day(400), "sell_yes", 30, 70), (3, "B", day(1), "buy_yes", 30, 70), (4, "C", day(-900), "buy_yes", 30, 70), (5, "D", day(1), "buy_yes", 30, 70)]
    ups, held = ([ups], [held]) if order == 0 else ([[x] for x in (ups if order == 1 else ups[::-1])], [[x] for x in (held if order == 1 else held[::-1])])
    got = run(spark, tmp_path, streams.stream_settle(arrivals(spark, tmp_path, "u", u, ups), arrivals(spark, tmp_path, "h", p, held)), f"settled_{order}")
    last = {r.id: r for r in sorted(got, key=lambda r: r.revision)}
    assert {k: (r.ticker, r.state, r.pnl) for k, r in last.items()} == {1: ("A", "resolved", -70), 3: ("B", "void", 0), 4: ("C", "resolved", 30)}
    if order == 1:
        assert [(r.pnl, r.revision) for r in sorted(got, key=lambda r: r.revision) if r.id == 1] == [(30, 0), (-70, 1)]


def test_stream_l2_candidates_settle_snapshots(spark, tmp_path):
    at = lambda name: (f"file://{tmp_path}/out-{name}", f"file://{tmp_path}/cp-out-{name}")
    step = lambda px: [(px, "1", 1)]
    books = streamed(spark, tmp_path, "l2", "coin string, ts timestamp, levels array<array<struct<px string, sz string, n int>>>", [("a", day(1), [step("10"), step("12")]), ("a", day(2), [step("20"), []])])
    assert streams.stream_l2(books, *at("l2")).awaitTermination(120)
    got = spark.read.parquet(at("l2")[0]).collect()
    assert sorted((r.date.day, r.mid, r.spread) for r in got if r.mid) == [(1, 11.0, 2.0)] and len(got) == 2
    level = lambda x: [(x, 1)]
    books_of = streamed(spark, tmp_path, "q", "ticker string, yes array<struct<price double, size int>>, no array<struct<price double, size int>>", [("a", level(0.42), level(0.01)), ("b", level(0.02), level(0.07)), ("c", level(0.41), level(0.01))])
    markets = spark.createDataFrame([("a", "KXBTC-1"), ("b", "KXBTC-2"), ("c", "ZZ-1")], "ticker string, event_ticker string")
    curves = spark.createDataFrame([("crypto", 40, 60, 0.30), ("aggregate", 40, 60, 0.41), ("crypto", 90, 60, 0.99)], "scope string, bin_low int, n long, actual_rate double")
    sigmas = spark.createDataFrame([("bin", "crypto", "sell_yes", 40, 0.5), ("aggregate", None, None, None, 0.9)], "level string, category string, side string, bin_low int, shrunk double")
    assert streams.stream_candidates(books_of, markets, curves, *at("candidates"), sigmas=sigmas).awaitTermination(120)
    found = spark.read.parquet(at("candidates")[0]).collect()
    assert sorted((r.ticker, r.side, round(r.edge, 6), r.sigma) for r in found) == [("a", "sell_yes", 12.5, 0.5), ("b", "buy_yes", 6.5, 0.9)]
    quotes = streamed(spark, tmp_path, "qs", "event_ticker string, yes_price double", [("KXBTC-1", 0.42), ("KXBTC-2", 0.93), ("ZZ-1", 0.41)])
    assert streams.stream_quote_snapshots(quotes, *at("quotes")).awaitTermination(120)
    assert spark.read.parquet(at("quotes")[0]).count() == 3
    events = streamed(spark, tmp_path, "d", "book string, ts timestamp, nav long", [("p", day(1, 3), 5), ("p", day(1, 9), 7), ("p", day(2), 8)])
    assert streams.stream_daily_snapshot(events, *at("daily")).awaitTermination(120)
    assert sorted((r.ts.day, r.nav) for r in spark.read.parquet(at("daily")[0]).collect()) == [(1, 7), (2, 8)]


def test_upsert_keeps_columns_and_other_errors(spark, tmp_path):
    root = f"file://{tmp_path}/u"
    old = spark.createDataFrame([("a", 1, "x", "p"), ("b", 2, "y", "p")], "k string, n int, note string, part string")
    got = ingest.upsert_partitioned(old, root, ["k"], "part").collect()
    assert [(r.rows, r.added) for r in got] == [(2, 2)]
    got = ingest.upsert_partitioned(spark.createDataFrame([("b", 9, 0.5, "p"), ("c", 3, 0.7, "p")], "k string, n int, extra double, part string"), root, ["k"], "part").collect()
    assert [(r.rows, r.added) for r in got] == [(3, 1)]
    rows = {r.k: (r.n, r.note, r.extra) for r in spark.read.option("mergeSchema", "true").parquet(root).collect()}
    assert rows == {"a": (1, "x", None), "b": (2, "y", None), "c": (3, None, 0.7)}
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.parquet").write_text("not parquet")
    import pytest

    with pytest.raises(Exception, match="(?i)parquet|footer"):
        ingest.upsert_partitioned(old, f"file://{bad}", ["k"], "part")
    assert (bad / "x.parquet").exists()


def state_rows(spark, stream, tmp_path, name):
    """What the stream gives, and the most keys that its state has held."""
    q = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/{name}").collect(), max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])


def test_symbols_share_lanes_of_state(spark, tmp_path, rocks):
    """State of few lanes, however many keys; each key is told as if it were alone."""
    names = [f"s{k}" for k in range(30)]
    bars = [[(s, day(1, k % 5)) for k, s in enumerate(names)], [(s, day(3)) for s in names[::3]], [("~", day(9))]]
    universe = spark.createDataFrame([(s, day(1)) for s in [*names, "never"]], "symbol string, since timestamp")
    got, n = state_rows(spark, streams.stream_freshness(arrivals(spark, tmp_path, "lb", "symbol string, ts timestamp", bars), universe, 86_400_000_000, 2 * 86_400_000_000 + 1, lanes=3), tmp_path, "lf")
    want = [("never", day(2), "stale", None)]
    for k, s in enumerate(names):
        at = [day(1, k % 5), day(3)] if k % 3 == 0 else [day(1, k % 5)]
        for t in at:
            want += [(s, t, "fresh", t)] * (t == day(3)) + [(s, t + dt.timedelta(days=1), "stale", t)]
        want.append((s, at[-1] + dt.timedelta(days=2, microseconds=1), "very_stale", at[-1]))
    assert sorted((r.symbol, r.at, r.state, r.last_ts or dt.datetime.min) for r in got) == sorted((s, a, w, t or dt.datetime.min) for s, a, w, t in want)
    assert n <= 3 * 3  # values, and timers in two orders


def test_markets_share_lanes_of_state(spark, tmp_path, rocks):
    names, big = [f"s{k}" for k in range(30)], 2**60 + 1
    u = [[(s, day(2), "settled", "no") for s in names], [(s, day(3), "settled", "yes") for s in names[::2]]]
    p = [[(big + k, s, day(1), "sell_yes", 30, 70) for k, s in enumerate(names)]]
    ups = arrivals(spark, tmp_path, "lu", "ticker string, ts timestamp, status string, result string", u)
    held = arrivals(spark, tmp_path, "lp", "id long, ticker string, entered_at timestamp, side string, reward_cents long, risk_cents long", p)
    got, n = state_rows(spark, streams.stream_settle(ups, held, lanes=3), tmp_path, "ls")
    assert sorted((r.id, r.revision, r.pnl) for r in got) == sorted([(big + k, 0, 30) for k in range(30)] + [(big + k, 1, -70) for k in range(0, 30, 2)])
    assert n <= 3 * 3
