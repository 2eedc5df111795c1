"""Exact quantiles from sketches that come out otherwise each time they are made."""

import numpy as np
from pyspark.sql import functions as F

from quaywork.operators import selection


def test_quantiles_where_a_sketch_depends_on_order(spark, monkeypatch):
    """Parts of a sketch arrive in any order on several executors; here its edges differ at each evaluation."""
    real, by_chance = F.percentile_approx, F.reflect(F.lit("java.lang.Math"), F.lit("random")).cast("double")

    def wider(column, asked, accuracy):
        s = real(column, asked, accuracy)
        return F.array(F.element_at(s, 1) - by_chance, F.element_at(s, 2) + by_chance)

    monkeypatch.setattr(selection.F, "percentile_approx", wider)
    v = np.random.default_rng(4).normal(0, 100, 60_000)
    d = spark.createDataFrame([(int(k % 2), float(x)) for k, x in enumerate(v)], "g long, v double").localCheckpoint()
    # as on large tables, where no side of the join is small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = {r.g: r.median for r in selection.exact_quantiles(d, ["g"], "v", {"median": 0.5}).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(got) == {0, 1}
    assert all(np.isclose(got[g], np.quantile(v[g::2], 0.5), rtol=1e-12) for g in (0, 1))
