"""Relations of event markets, bars, funding, positions and runs, made from the driver's tables.

Each relation is a template of SQL that Spark and other engines both run; ``{us(x)}`` and the like stand for the few
functions whose names differ. Times are microseconds since 1970 as long integers, arithmetic is exact, and rows have
one order everywhere (time, then id).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Event prefixes by user, one or more for each category.
PREFIXES = ("KXNFL", "KXNBA", "KXBTC", "KXETH", "KXINX", "KXUSDJPY", "HIGHNY", "CPI", "KXFED", "PRES", "KXMAYOR", "ZZOTHER")
DAY = 86_400_000_000
_PREFIX = "CASE user_id % 12 " + " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PREFIXES)) + " END"

RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": (
        ("events",),
        """SELECT event_id AS trade_id, concat('T', CAST(user_id AS STRING)) AS ticker, user_id, {us(ts)} AS t,
        value / (value + 50) AS yes_price, 1 - value / (value + 50) AS no_price, CAST(1 + event_id % 10 AS BIGINT) AS n,
        CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS taker_side FROM {events}""",
    ),
    "markets": (
        ("events",),
        f"""SELECT concat('T', CAST(user_id AS STRING)) AS ticker, user_id, slot, concat({_PREFIX}, '-', CAST(slot AS STRING), '-', CAST(user_id AS STRING)) AS event_ticker,
        1704067200000000 + slot * {10 * DAY} AS opened, 1704067200000000 + (slot + 1) * {10 * DAY} AS closed, CAST(count(*) AS BIGINT) AS volume,
        CASE WHEN sum(event_id) % 2 = 0 THEN 'yes' ELSE 'no' END AS result, CASE WHEN sum(event_id) % 10 = 0 THEN 'active' ELSE 'settled' END AS status
        FROM (SELECT *, CAST(floor(({{us(ts)}} - 1704067200000000) / {10 * DAY}e0) AS BIGINT) AS slot FROM {{events}}) e GROUP BY user_id, slot""",
    ),
    "bars": (
        ("lineitem", "part"),
        f"""SELECT symbol, t, CAST(row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS BIGINT) AS i, open, high, low, close, volume FROM (
        SELECT symbol, t, max(CASE WHEN a = 1 THEN price END) AS open, max(price) AS high, min(price) AS low, max(CASE WHEN z = 1 THEN price END) AS close, sum(qty) AS volume FROM (
        SELECT p_brand AS symbol, {{us(l_shipdate)}} AS t, l_extendedprice / l_quantity AS price, l_quantity AS qty,
        row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS a,
        row_number() OVER (PARTITION BY p_brand, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS z
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey) x GROUP BY symbol, t) y""",
    ),
    "funding": (
        ("events",),
        """SELECT concat('C', CAST(user_id % 10 AS STRING)) AS symbol, CAST(floor({us(ts)} / 3600000000e0) AS BIGINT) * 3600000000 AS t,
        CAST(sum(event_id % 21 - 10) AS BIGINT) AS rate FROM {events} GROUP BY 1, 2""",
    ),
    "positions": (
        ("orders",),
        f"""SELECT o_orderkey AS id, concat('M', CAST(o_orderkey % 997 AS STRING)) AS ticker, concat('E', CAST(o_orderkey % 97 AS STRING)) AS event_ticker,
        concat('S', CAST(o_orderkey % 13 AS STRING)) AS series, CASE o_custkey % 7 WHEN 0 THEN 'sports' WHEN 1 THEN 'crypto' WHEN 2 THEN 'financial' WHEN 3 THEN 'weather' WHEN 4 THEN 'economics' WHEN 5 THEN 'politics' ELSE 'other' END AS category,
        CASE WHEN o_orderkey % 2 = 0 THEN 'sell_yes' ELSE 'buy_yes' END AS side, (1 + o_orderkey % 98) / 100e0 AS entry_price,
        CAST(1 + o_orderkey % 50 AS BIGINT) AS risk_cents, CAST(1 + o_custkey % 40 AS BIGINT) AS reward_cents, CAST(o_orderkey % 23 AS BIGINT) AS edge_pp,
        {{us(o_orderdate)}} AS entered, {{us(o_orderdate)}} + (1 + o_orderkey % 30) * {DAY} AS closes,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'voided' END AS status,
        CASE WHEN o_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS result FROM {{orders}}""",
    ),
    "runs": (
        ("events",),
        """SELECT event_id AS id, event_type AS template, CASE event_id % 4 WHEN 0 THEN 'scored' WHEN 1 THEN 'rejected' WHEN 2 THEN 'catastrophic' ELSE 'error' END AS status,
        value AS score, concat('{{"timeframe":"', CASE user_id % 3 WHEN 0 THEN '1h' WHEN 1 THEN '4h' ELSE '1d' END, '"}}') AS config, user_id, concat('K', CAST(user_id % 5 AS STRING)) AS cohort, user_id % 6 AS fold FROM {events}""",
    ),
    "ladder": (
        ("lineitem", "part"),
        f"""SELECT p_brand AS event, CAST(floor({{us(l_shipdate)}} / {30 * DAY}e0) AS BIGINT) * {30 * DAY} AS t, CAST(p_size % 8 AS INT) AS strike,
        CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS mass FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    ),
}

_ENGINES = {
    "spark": {"us": lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))"},
    "duckdb": {"us": lambda x: f"epoch_us({x})"},
}


def render(template: str, engine: str, tables: dict[str, str] | None = None) -> str:
    """A template as ``engine``'s SQL."""
    out = re.sub(r"\{us\((\w+)\)\}", lambda m: _ENGINES[engine]["us"](m[1]), template)
    for name, value in (tables or {}).items():
        out = out.replace("{" + name + "}", value)
    return out.replace("{{", "{").replace("}}", "}")


def with_relations(sql: str, *names: str) -> str:
    """``sql`` for the oracle, after the relations that it names."""
    parts = []
    for n in names:
        tables, template = RELATIONS[n]
        parts.append(f"{n} AS ({render(template, 'duckdb', {t: t for t in tables})})")
    return "WITH " + ",\n".join(parts) + "\n" + sql


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation over the tables in ``sf_dir``."""
    tables, template = RELATIONS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    text = render(template, "spark").replace('{"timeframe', '{{"timeframe').replace("\"}'", "\"}}'")
    return spark.sql(text, **frames)
