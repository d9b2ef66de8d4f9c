import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qoslattice.functions import selection

STEPS = [i / 20 for i in range(21)]


@pytest.mark.parametrize("parts", [256, 3])
def test_quantiles_equal_percentile(spark, monkeypatch, parts):
    monkeypatch.setattr(selection, "PARTS", parts)
    rng = random.Random(1)
    groups = {
        "even": [float(i) for i in range(1000)], "skewed": [99 + rng.random() ** 9 for _ in range(3000)], "ties": [rng.choice([1.0, 1.0, 1.0, 2.5, None]) for _ in range(2000)],
        "one": [7.0], "two": [1.0, 2.0], None: [-5.0, 0.0, 5.0, None], "nulls": [None, None], "same": [3.0] * 50, "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-9, 9) for _ in range(500)],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r["g"], round(r["q"], 6)): r["v"] for r in selection.exact_quantiles(rows, ["g"], "v", STEPS).collect()}
    want = {r["g"]: r["p"] for r in rows.groupBy("g").agg(F.percentile("v", STEPS).alias("p")).collect() if r["p"]}
    assert set(got) == {(g, round(q, 6)) for g in want for q in STEPS}
    for g, points in want.items():
        assert np.allclose([got[(g, round(q, 6))] for q in STEPS], points, rtol=1e-12, atol=0)
    assert selection.exact_quantiles(rows.limit(0), ["g"], "v", [0.5]).count() == 0


def test_no_part_holds_a_group(spark):
    rows = spark.range(100_000).select(F.lit("m").alias("g"), F.sqrt("id").alias("v"))
    cuts = rows.groupBy("g").agg(F.percentile_approx("v", [i / selection.PARTS for i in range(1, selection.PARTS)], 10 * selection.PARTS).alias("c"))
    sizes = rows.join(cuts, "g").groupBy(F.size(F.filter("c", lambda c: c < F.col("v")))).count().agg(F.max("count")).first()[0]
    assert sizes < 100_000 / selection.PARTS * 3
