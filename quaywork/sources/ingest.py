"""Normalisation of raw payloads and idempotent ingest into partitioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .paths import exists, kept, remove


def _json(name: str, path: str | None = None):
    return F.get_json_object(name, f"$.{path}") if path else F.col(name)


def normalize_candles(df: DataFrame, kind: str = "object", column: str = "raw") -> DataFrame:
    """Bars of candle payloads: objects ``{t,o,h,l,c,v,n}`` (strings, milliseconds) or rows of numbers ``[time, low,
    high, open, close, volume]`` in an array (seconds). Rows that do not parse are left out."""
    if kind == "object":
        g = lambda k: _json(column, k).try_cast("double")
        out = df.select(*[c for c in df.columns if c != column], (_json(column, "t").try_cast("long") * 1000).alias("t"), g("o").alias("open"), g("h").alias("high"), g("l").alias("low"), g("c").alias("close"), g("v").alias("volume"), _json(column, "n").try_cast("long").alias("trades"))
        return out.where("t is not null and close is not null")
    rows = df.withColumn("_r", F.explode(F.from_json(column, "array<array<double>>")))
    at = lambda k: F.get("_r", F.lit(k))
    out = rows.select(*[c for c in df.columns if c != column], (at(0) * 1_000_000).cast("long").alias("t"), at(3).alias("open"), at(2).alias("high"), at(1).alias("low"), at(4).alias("close"), at(5).alias("volume"))
    return out.where("t is not null and close is not null")


def normalize_funding(df: DataFrame, column: str = "raw") -> DataFrame:
    return df.select((_json(column, "time").try_cast("long") * 1000).alias("t"), _json(column, "coin").alias("coin"), _json(column, "fundingRate").try_cast("double").alias("funding_rate"), _json(column, "premium").try_cast("double").alias("premium")).where("t is not null")


def normalize_markets(df: DataFrame, column: str = "raw") -> DataFrame:
    """Market rows: dollar fields before cents, whole volume before its text form, series from the event's ticker, title
    before the subtitle."""
    j = lambda k: _json(column, k)
    price = lambda k: F.coalesce(S.parse_price(j(f"{k}_dollars"), False), S.parse_price(j(k)))
    return df.select(
        j("ticker").alias("ticker"), j("event_ticker").alias("event_ticker"), F.coalesce(j("series_ticker"), S.series_of(j("event_ticker"))).alias("series_ticker"), F.coalesce(F.nullif(j("title"), F.lit("")), j("yes_sub_title")).alias("title"),
        F.lower(j("status")).alias("status"), F.lower(j("result")).alias("result"), price("yes_bid").alias("yes_bid"), price("yes_ask").alias("yes_ask"), price("last_price").alias("last_price"),
        F.coalesce(j("volume").try_cast("long"), F.rint(j("volume_fp").try_cast("double")).cast("long")).alias("volume"), j("open_time").try_cast("timestamp").alias("open_time"), j("close_time").try_cast("timestamp").alias("close_time"),
    )


def normalize_trades(df: DataFrame, markets: DataFrame | None = None, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Trade rows with their event's ticker ('' if unknown), and the rows without a creation time, set aside."""
    j = lambda k: _json(column, k)
    t = df.select(
        j("trade_id").alias("trade_id"), j("ticker").alias("ticker"), F.coalesce(j("count").try_cast("long"), F.rint(j("count_fp").try_cast("double")).cast("long")).alias("count"),
        F.coalesce(S.parse_price(j("yes_price_dollars"), False), S.parse_price(j("yes_price"))).alias("yes_price"), F.coalesce(S.parse_price(j("no_price_dollars"), False), S.parse_price(j("no_price"))).alias("no_price"),
        j("taker_side").alias("taker_side"), j("created_time").try_cast("timestamp").alias("created_time"), F.col(column),
    )
    good = t.where("created_time is not null").drop(column)
    if markets is not None:
        m = markets.groupBy("ticker").agg(F.max("event_ticker").alias("event_ticker"))
        good = good.join(m, "ticker", "left").withColumn("event_ticker", F.coalesce("event_ticker", F.lit("")))
    return good, t.where("created_time is null").select(column)


def normalize_orderbooks(df: DataFrame, column: str = "raw") -> DataFrame:
    """Levels of each side in order; levels that do not parse or have no size are left out."""
    side = lambda k: F.filter(F.transform(F.from_json(_json(column, k), "array<array<string>>"), lambda x: F.struct(S.parse_price(F.get(x, F.lit(0))).alias("price"), F.get(x, F.lit(1)).try_cast("int").alias("size"))), lambda x: x["price"].isNotNull() & (x["size"] > 0))
    return df.select(_json(column, "ticker").alias("ticker"), F.coalesce(side("yes"), F.array()).alias("yes"), F.coalesce(side("no"), F.array()).alias("no"))


def flatten_l2(df: DataFrame, n_levels: int = 10, levels: str = "levels") -> DataFrame:
    """An array of two sides of (px, sz, n) levels as columns by level, and the mid, spread and its share."""
    px = lambda s, k, f: F.get(F.get(levels, F.lit(s)), F.lit(k))[f].try_cast("double")
    cols = {f"{name}_{f}_{k}": px(s, k, f) for s, name in ((0, "bid"), (1, "ask")) for k in range(n_levels) for f in ("px", "sz")}
    out = df.select(*[c for c in df.columns if c != levels], *[c.alias(n) for n, c in cols.items()])
    mid = (F.col("bid_px_0") + F.col("ask_px_0")) / 2
    return out.withColumns({"mid": mid, "spread": F.col("ask_px_0") - F.col("bid_px_0"), "spread_pct": (F.col("ask_px_0") - F.col("bid_px_0")) / F.nullif(mid, F.lit(0.0))})


def normalize_events(df: DataFrame, column: str = "raw") -> DataFrame:
    j = lambda k: _json(column, k)
    return df.select(j("event_ticker").alias("event_ticker"), j("series_ticker").alias("series_ticker"), F.coalesce(F.nullif(j("title"), F.lit("")), j("sub_title")).alias("title"), j("category").alias("category"), j("status").alias("status"), F.col(column).alias("raw_json"))


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "first", order: str | None = None) -> DataFrame:
    """One row for each key of both tables: the existing one (``first``), or that of the greatest ``order`` (``last``)."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    by = [F.col("_src"), F.xxhash64(*new.columns)] if keep == "first" else [F.desc(order), F.desc("_src"), F.xxhash64(*new.columns)]
    w = Window.partitionBy(*keys).orderBy(*by)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_src")


def upsert_partitioned(new: DataFrame, root: str, keys: list[str], part: str, keep: str = "first", order: str | None = None) -> DataFrame:
    """Merges ``new`` into the table at ``root`` by ``keys`` within each partition, rewriting only the partitions it touches;
    (``part``, rows, added).

    The partitions are read by a pruned scan and merged into a staging folder of this run's own, then swapped in by
    dynamic overwrite. Columns that only the table or only ``new`` has stay, null where a row lacks them. A run that
    fails leaves each partition as it was or merged, and a repeat makes up for the rest. One writer at a time.
    """
    spark = new.sparkSession
    days = [r[0] for r in new.select(part).distinct().collect()]  # the partitions touched
    there = exists(spark, root)
    old = spark.read.option("mergeSchema", "true").parquet(root).where(F.col(part).isin(days)) if there else new.limit(0)
    if there:  # a partition's values are read by what they look like
        old = old.withColumn(part, F.col(part).cast(new.schema[part].dataType))
    staged = f"{root.rstrip('/')}__staged_{uuid.uuid4().hex}"
    merged(old, new, list(dict.fromkeys([part, *keys])), keep, order).write.parquet(staged)
    before = kept(old.groupBy(part).agg(F.count("*").alias("_before")))
    ready = spark.read.parquet(staged)
    ready.repartition(part).sortWithinPartitions(part, *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(root)
    counts = kept(ready.groupBy(part).agg(F.count("*").alias("rows")))
    remove(spark, staged)
    return counts.join(before, part, "left").select(part, "rows", (F.col("rows") - F.coalesce("_before", F.lit(0))).alias("added"))


def upsert_events(new: DataFrame, root: str, part: str = "date", order: str = "pulled_at") -> DataFrame:
    """The latest pull of each event in its day."""
    return upsert_partitioned(new, root, ["event_ticker"], part, "last", order)


def append_dedup(new: DataFrame, root: str, keys: list[str], part: str) -> DataFrame:
    """Rows of a series that the table lacks; existing ones win."""
    return upsert_partitioned(new, root, keys, part)


def upsert_shadow(new: DataFrame, root: str) -> DataFrame:
    """Rejections, the first seen of a ticker and day; one row: total, added."""
    dated = new if "reject_date" in new.columns else new.withColumn("reject_date", F.to_date("ts"))
    return upsert_partitioned(dated, root, ["ticker"], "reject_date").agg(F.sum("rows").alias("total"), F.sum("added").alias("added"))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of tables by column name; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def missing_fields(required, present):
    """A column of the names in ``required`` that the array ``present`` lacks, in order. Either may be a list of names."""
    col = lambda x: F.array(*[F.lit(v) for v in x]) if isinstance(x, (list, tuple)) else F.col(x) if isinstance(x, str) else x
    return F.array_sort(F.array_except(col(required), col(present)))


def ordered(df: DataFrame, cols: list[str], within: bool = False) -> DataFrame:
    """Rows in order of ``cols``, over all or ``within`` each partition, for panels that are the same each time."""
    return df.sortWithinPartitions(*cols) if within else df.orderBy(*cols)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Makes ``df`` known to SQL by ``name``, and gives it."""
    df.createOrReplaceTempView(name)
    return df


def read_partitioned(spark: SparkSession, root: str, part: str = "date", values: list | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table by partitions: only those of ``values`` are listed and read, and only ``columns``."""
    d = spark.read.parquet(root)
    d = d if values is None else d.where(F.col(part).isin(list(values)))
    return d if columns is None else d.select(*columns)


def read_bars(spark: SparkSession, root: str, symbols: list[str] | None = None, interval: str | None = None) -> DataFrame:
    """Bars of a tree by symbol (and interval), in the columns that the indicators use."""
    d = read_partitioned(spark, root, "symbol", symbols)
    return d if interval is None else d.where(F.col("interval") == interval)


def read_funding(spark: SparkSession, root: str, coins: list[str] | None = None) -> DataFrame:
    """Funding ticks by coin; a coin that is not there gives no rows."""
    return read_partitioned(spark, root, "coin", coins, ["coin", "t", "funding_rate"])


def sink_parquet(df: DataFrame, root: str, part: list[str], sort: list[str], mode: str = "overwrite") -> None:
    """A tree by partitions, a file for each, rows in order, so that later scans prune by file and by row group."""
    df.repartition(*part).sortWithinPartitions(*part, *sort).write.mode(mode).partitionBy(*part).parquet(root)


def sink_text(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """CSV with a header, or a JSON object on each line; nulls stay apart from empty texts."""
    w = df.write.mode(mode)
    w.option("header", True).option("nullValue", "\\N").csv(path) if kind == "csv" else w.option("ignoreNullFields", False).json(path)


def watermarks(trades: DataFrame) -> DataFrame:
    return trades.groupBy("ticker").agg(F.max_by("trade_id", F.struct("t", "trade_id")).alias("last_id"), F.max("t").alias("last_t"))


def new_since(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Trades at or after their ticker's mark but for the marked one; tickers without a mark are left out."""
    return trades.join(marks, "ticker").where("t >= last_t and trade_id <> last_id").select(*trades.columns)


def backfill_worklist(markets: DataFrame, marks: DataFrame, cutoff: int, close_before: int, max_events: int) -> DataFrame:
    """Settled markets that close before a time and have no mark, labelled by a cutoff, so many events by series."""
    m = markets.where((F.col("status") == "settled") & (F.col("closed") < close_before)).join(marks.select("ticker"), "ticker", "left_anti")
    m = m.withColumns({"series": S.series_of("event_ticker"), "tier": F.when(F.col("closed") < cutoff, "historical").otherwise("live")})
    w = Window.partitionBy("series").orderBy("closed", "event_ticker")
    return m.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= max_events).drop("_r")


def ingest_summary(markets: DataFrame, trades: DataFrame) -> DataFrame:
    t = trades.groupBy("ticker").agg(F.count("*").alias("n"))
    m = markets.select(S.series_of("event_ticker").alias("series"), "event_ticker", "ticker").distinct().join(t, "ticker", "left")
    return m.groupBy("series").agg(F.countDistinct("event_ticker").alias("events"), F.count("*").alias("markets"), F.count("n").alias("with_trades"), F.sum(F.coalesce("n", F.lit(0))).alias("trades"))


def freshness(bars: DataFrame, universe: DataFrame, bar_us: int, now: int, very: int = 7 * 86_400_000_000) -> DataFrame:
    last = bars.groupBy("symbol").agg(F.max("t").alias("last_t"))
    age = F.lit(now) - F.col("last_t")
    state = F.when(F.col("last_t").isNull(), "stale").when(age > very, "very_stale").when(age > 2 * bar_us, "stale").otherwise("fresh")
    return universe.select("symbol").distinct().join(last, "symbol", "left").withColumn("state", state)


def load_current(versions: DataFrame, at: str = "built_at") -> DataFrame:
    """The rows of the newest version of an append-only table."""
    return versions.join(F.broadcast(versions.agg(F.max(at).alias(at))), at)


def save_version(df: DataFrame, root: str, name: str) -> None:
    """Writes a version under a name and then points to it: whoever reads sees the old version or the whole new one. A name
    that is saved again is replaced; one writer at a time."""
    spark = df.sparkSession
    path = f"{root}/versions/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    pointer = f"{root}/pointers"
    n = spark.read.parquet(pointer).agg(F.max("n")).first()[0] + 1 if exists(spark, pointer) else 0
    spark.createDataFrame([(n, name, path)], "n long, name string, path string").coalesce(1).write.mode("append").parquet(pointer)


def load_version(spark: SparkSession, root: str, name: str | None = None) -> DataFrame:
    """The version last saved under ``name``, or the current one: that last saved at all."""
    pointer = f"{root}/pointers"
    found = spark.read.parquet(pointer).where(F.lit(True) if name is None else F.col("name") == name).agg(F.max_by("path", "n")).first()[0] if exists(spark, pointer) else None
    if found is None:
        raise FileNotFoundError(f"no version {name or 'at all'} in {root}")
    return spark.read.parquet(found)


def read_cohorts(df: DataFrame, column: str = "raw") -> DataFrame:
    m = df.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("cohort", "symbols"))
    return m.select("cohort", F.explode("symbols").alias("symbol")).withColumn("symbol", F.regexp_replace("symbol", "_PERP$", "-PERP"))


def parse_ticks(lines: DataFrame, order: str = "line", text: str = "value", by: list[str] = ("file",)) -> DataFrame:
    """Tick lines of logs (``entered=2 rejected=3 ...``) with the time of the last line before that has one."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stamp = F.regexp_extract(text, r"(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d)", 1)
    d = lines.withColumn("at", F.last(F.nullif(stamp, F.lit("")), ignorenulls=True).over(w))
    num = lambda k: F.regexp_extract(text, rf"\b{k}=(\d+)", 1).try_cast("int")
    return d.select(*by, order, "at", *[num(k).alias(k) for k in ("entered", "rejected", "candidates", "resolved", "voided", "shadow")]).where("entered is not null")


def append_runs(df: DataFrame, root: str) -> None:
    """Appends rows with ids that go on from the greatest one there. One writer at a time."""
    from ..operators.asof import global_rank

    spark = df.sparkSession
    top = (spark.read.parquet(root).agg(F.max("id")).first()[0] or 0) if exists(spark, root) else 0
    global_rank(df, [F.xxhash64(*df.columns), *[F.col(c) for c in df.columns]]).withColumn("id", F.col("rank") + top + 1).drop("rank").write.mode("append").parquet(root)
