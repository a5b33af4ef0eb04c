"""Edge cases of expressions and of the store."""
import math
from statistics import NormalDist

from pyspark.sql import functions as F

from oddsmill.functions import grid, normal
from oddsmill.operators import markets, venues
from oddsmill.sources import store


def test_normal(spark):
    xs = [1e-6, 1e-4, 0.01, 0.075, 0.3, 0.5, 0.7, 0.99, 0.9999]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal.probit(F.col("x")).alias("z"), normal.cdf((F.col("x") - 0.5) * 16).alias("c")).collect()
    for r in rows:
        assert abs(r.z - NormalDist().inv_cdf(r.x)) < 1e-12
        assert abs(r.c - 0.5 * math.erfc(-(r.x - 0.5) * 16 / math.sqrt(2))) < 1e-15


def test_grid(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.049, 2.9), (0.5, 100.0), (0.999, 1e6), (1.0, 0.2)], "p double, tau double")
    got = rows.select(grid.price_bucket(F.col("p")), grid.tau_band(F.col("tau"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (4, 5), (8, 5), (8, 0)]
    ticks = spark.createDataFrame([(0.2, 0.025), (0.2, 0.035), (0.8, 0.02)], "p double, dp double").select(grid.folded_ticks(F.col("p"), F.col("dp"), 0.01)).collect()
    assert [r[0] for r in ticks] == [2, 4, -2]


def test_upsert_is_idempotent(spark, tmp_path):
    at = "timestamp '2024-01-01 00:00:00'"
    old = spark.sql(f"SELECT 'v' venue, '60m' freq, 'a' key, {at} ts, 0.4D close UNION ALL SELECT 'v', '60m', 'b', {at}, 0.5D")
    new = spark.sql(f"SELECT 'v' venue, '60m' freq, 'a' key, {at} ts, 0.6D close, double('NaN') volume")
    path = str(tmp_path / "bars")
    store.upsert_bars(spark, path, old, str(tmp_path / "s1"))
    for k in range(2):
        store.upsert_bars(spark, path, new, str(tmp_path / f"s{k + 2}"))
    got = sorted((r.key, r.close, r.volume) for r in store.read(spark, path, store.BARS).collect())
    assert got == [("a", 0.6, None), ("b", 0.5, None)]


def test_missing_store_is_typed_and_empty(spark, tmp_path):
    store.register_views(spark, str(tmp_path / "none"), str(tmp_path / "nothing"))
    assert spark.sql("SELECT key, close FROM bars").count() == 0
    assert dict(spark.table("catalog").dtypes)["closed"] == "boolean"


def test_adjusted_rand_of_equal_labels_is_one(spark):
    rows = spark.createDataFrame([(str(k), k % 3, k % 3) for k in range(12)], "key string, a int, b int")
    assert markets.adjusted_rand(rows, "a", "b").first().ari == 1.0


def test_zero_gap(spark):
    rows = spark.sql("SELECT id % 4 AS pair_id, timestamp_seconds(id * 86400) AS ts, 0.5D AS p_k, 0.5D AS p_pm FROM range(40)")
    got = venues.gap_stats(rows).first()
    assert (got.mean_abs, got.share_wide, got.ar1) == (0.0, 0.0, None)
