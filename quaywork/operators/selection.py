"""Exact quantiles of large groups: ranks are narrowed to a range by a sketch, counted, and only that range is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import kept

#: Ranks of the sketch are right to n / ACCURACY; the range it leaves is cut into PARTS.
ACCURACY, PARTS = 20_000, 1_024


def exact_quantiles(df: DataFrame, by: list[str], column: str | Column, quantiles: dict[str, float]) -> DataFrame:
    """(by, one column for each of ``quantiles``): exact, interpolated between neighbours as ``percentile`` does.

    A sketch of each group gives two values that enclose a rank. One count by value (all values below are one, all
    above are left out) says how far within them the rank lies; the range is cut into equal parts, and only the part
    that holds the rank is sorted. All are sums before any shuffle, so a group that holds all rows is spread over all
    tasks. What is sorted is some hundred-thousandth of a group, or fewer where values are equal. A sketch that does
    not enclose its rank ends the job rather than give a wrong value. What a sketch gives depends on the order in which
    its parts arrive, so it is made once and written down, as are the counts. Null and NaN values and rows with a null in ``by`` are
    left out; a group of
    them alone gives no row. Without ``by`` there is one row, or none.
    """
    keys = list(by) or ["_all"]
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    d = df.select(*by, *([] if by else [F.lit(0).alias("_all")]), v.alias("_v")).where("_v is not null and not isnan(_v)")
    slack = 4 / ACCURACY
    edges = [(max(0.0, q - slack), min(1.0, q + slack)) for q in quantiles.values()]
    asked = sorted({x for pair in edges for x in pair})
    sketch = F.percentile_approx("_v", asked, ACCURACY)
    g = d.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_s"))
    at = lambda x: F.element_at("_s", asked.index(x) + 1)
    few = F.col("_n") < ACCURACY  # there a rank's neighbour may lie beyond the slack
    wanted = [F.struct(F.lit(k).alias("q"), F.when(few, F.col("_min")).otherwise(at(lo)).alias("lo"), F.when(few, F.col("_max")).otherwise(at(hi)).alias("hi"), ((F.col("_n") - 1) * F.lit(float(q))).alias("place")) for k, (q, (lo, hi)) in enumerate(zip(quantiles.values(), edges, strict=True))]
    g = kept(g.select(*keys, F.array(*wanted).alias("_w")))
    rows = d.join(g if by else F.broadcast(g), keys)  # without groups, g is one row
    rows = rows.select(*keys, "_v", F.explode("_w").alias("_w")).where("_v <= _w.hi")
    own = [*keys, "_w"]
    counted = rows.groupBy(*own, F.when(F.col("_v") >= F.col("_w.lo"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    width = F.nullif(F.col("_w.hi") - F.col("_w.lo"), F.lit(0.0))
    part = F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(F.least(F.floor((F.col("_v") - F.col("_w.lo")) / width * PARTS), F.lit(PARTS)), F.lit(0)))
    counted = kept(counted.withColumn("_part", part.cast("int")))
    a, b = F.floor("_w.place"), F.ceil("_w.place")
    over = Window.partitionBy(*own).orderBy("_part")
    parts = counted.groupBy(*own, "_part").agg(F.sum("_c").alias("_m")).withColumn("_before", F.sum("_m").over(over) - F.col("_m"))
    parts = parts.where((F.col("_before") <= b) & (F.col("_before") + F.col("_m") > a)).drop("_m")
    held = counted.join(parts, [*own, "_part"])
    upto = F.sum("_c").over(Window.partitionBy(*own, "_part").orderBy("_v")) + F.col("_before")
    held = held.withColumn("_upto", upto)
    holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
    value = lambda r: F.max(F.when(holds(r), F.when(F.col("_v").isNull(), F.raise_error(F.lit("a sketch does not enclose its rank")).cast("double")).otherwise(F.col("_v"))))
    both = held.groupBy(*own).agg(value(a).alias("_x"), value(b).alias("_y"))
    result = F.when(a == b, F.col("_x")).otherwise((b - F.col("_w.place")) * F.col("_x") + (F.col("_w.place") - a) * F.col("_y"))
    result = F.when(F.col("_x").isNull() | F.col("_y").isNull(), F.raise_error(F.lit("a sketch does not enclose its rank")).cast("double")).otherwise(result)
    out = both.select(*keys, F.col("_w.q").alias("_q"), result.alias("_r")).groupBy(*keys)
    return out.agg(*[F.max(F.when(F.col("_q") == k, F.col("_r"))).alias(n) for k, n in enumerate(quantiles)]).drop("_all")
