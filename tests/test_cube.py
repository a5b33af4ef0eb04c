"""The cube's statistics are those of the moves."""
import math

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import cube, panel, regimes, variance
from oddsmill.plans.market import View

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def moves(spark):
    return View(spark, DATA).restless().persist()


@pytest.fixture(scope="module")
def summed(moves):
    return cube.moments(moves)


def same(got, expected, *keys):
    assert got.columns == expected.columns
    got, expected = (sorted(df.collect(), key=lambda r: [r[k] for k in keys]) for df in (got, expected))
    assert len(got) == len(expected) > 0
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-11), (a, b)


@pytest.mark.parametrize(
    ("name", "keys", "more"),
    [("local_slopes", (), ()), ("local_ratios", ("bucket",), ()), ("power_cells", ("qi", "ti"), (14, 6, 3)), ("kurtosis_by_bucket", ("bucket",), (2,)), ("rate_by_price", ("bin",), (0.5, 1))],
)
def test_as_over_moves(moves, summed, name, keys, more):
    direct = (None, *more) if name == "power_cells" else more
    same(getattr(cube, name)(summed, *more), getattr(variance, name)(moves, *direct), *keys)


def test_map(moves, summed):
    fit = regimes.bulk_fit(moves, 3)
    same(cube.map_cells(summed, 2, 3, pairs=2), regimes.map_cells(moves, fit, 2, pairs=2), "pi", "ti")


def test_cube_has_a_row_a_price_and_day(moves, summed):
    assert summed.agg(F.sum("n")).first()[0] == moves.count()
    assert summed.count() == moves.select("p", "tau").distinct().count()


def test_one_read_of_the_panel(spark, tmp_path):
    """What follows from the cube reads its table alone."""
    out = cube.map_cells(cube.moments(View(spark, DATA).moves()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "cube-" in plan


def test_no_moves_and_constant_ones(spark):
    schema = "key string, ts_days double, p double, dp double, dp2 double, dt double, tau double"
    none = panel.standardised(spark.createDataFrame([], schema).withColumn("v_gauss", F.lit(0.01)))
    empty = cube.moments(none)
    assert empty.count() == cube.map_cells(empty).count() == cube.power_cells(empty).count() == 0
    assert cube.local_slopes(empty).first().n is None
    rows = [("k", float(d), 0.5, 0.1, 0.1 * 0.1, 1.0, 8.0) for d in range(40)]
    one = cube.moments(panel.standardised(spark.createDataFrame(rows, schema).withColumn("v_gauss", F.lit(0.03))))
    cell = cube.map_cells(one, least=1, fit_least=1).first()
    assert (cell.n, cell.n_mkts, cell.kurt_z, cell.ratio_fit) == (40, 1, None, None)
