"""Quantiles by counting against percentile(), through many rounds and in one."""
import math
import random

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import markets, quantiles, variance

AT = [0.0, 0.005, 0.25, 0.5, 0.99, 0.995, 1.0]


def same(a, b):
    return (a is None and b is None) or a == b or (math.isnan(a) and math.isnan(b))


def columns():
    r = random.Random(5)
    n = 3000
    return {
        "heavy": [r.choice((-1, 1)) * math.exp(r.gauss(0, 40)) for _ in range(n)],
        "ties": [r.choice((0.0, -0.0, 0.5, 1.0)) if r.random() < 0.9 else r.random() for _ in range(n)],
        "wild": [r.choice((None, math.nan, math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, r.random())) for _ in range(n)],
        "near": [1.0 + r.randint(0, 50) * 2.0**-52 for _ in range(n)],
        "tiny": [r.randint(0, 9) * 5e-324 for _ in range(n)],
        "none": [None] * n,
        "one": [None] * (n - 1) + [3.5],
    }


@pytest.mark.parametrize(("bins", "few"), [(4, 0), (7, 40), (4096, 65536)])
def test_equal_to_percentile(spark, bins, few):
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"`{c}` double" for c in data)).repartition(5).withColumn("column", F.lit(1)).withColumn("x", F.lit(2.0))
    got = quantiles.exact(df, {c: AT for c in data}, bins, few)
    for c in data:
        want = df.agg(F.percentile(c, F.array(*map(F.lit, AT)))).first()[0] or [None] * len(AT)
        assert all(same(a, b) for a, b in zip(got[c], want, strict=True)), (c, got[c], want)


def test_of_integers_and_of_no_rows(spark):
    df = spark.range(101).withColumn("id", F.col("id") % 10)
    assert quantiles.exact(df, {"id": [0.5, 0.1]}, 2, 0) == {"id": [df.agg(F.percentile("id", F.lit(p))).first()[0] for p in (0.5, 0.1)]}
    assert quantiles.exact(df.filter("false"), {"id": [0.5]}) == {"id": [None]}


def test_operators_on_no_rows(spark):
    empty = spark.createDataFrame([], "key string, ts_days double, z double, lam double")
    assert variance.winsorised(empty).count() == 0
    assert markets.quartiles(empty, "z").collect() == [(0, None, None, None)]
