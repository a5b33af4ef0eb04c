"""No test market of a race is left out."""
from pyspark.sql import functions as F

from oddsmill.operators import panel
from oddsmill.plans import registry


def test_all_test_markets_are_scored(spark, monkeypatch):
    """1,500 test markets of a fold were kept."""
    catalog = spark.range(8000).select(F.col("id").cast("string").alias("key"), F.timestamp_seconds(F.col("id") * 5000).alias("end"))
    seen = []
    monkeypatch.setattr(registry.forecasts, "race", lambda markets, parts, *a, **how: seen.append(parts))

    class Tables:
        def catalog(self):
            return catalog

        def markets(self):
            return None

    registry._race(Tables())
    got = {(r.fold, r.part): r.n for r in seen[0].groupBy("fold", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "train"): 4000, (0, "test"): 2000, (1, "train"): 6000, (1, "test"): 2000}
    assert panel.folds(catalog, most_test=7).filter("part = 'test'").count() == 14
