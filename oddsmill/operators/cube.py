"""A cube of moments: sums of moves by price and days left, from one read of the panel.

Prices lie on ticks and days left are few, so the cube has as many rows as there are different (price, days left),
however many markets and moves. It is summed map-side, written once, and local slopes, ratios, power fits, kurtosis,
rates by price and the regime map are sums over its rows, exact as those over the moves.
"""
from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import cdf
from oddsmill.operators.panel import with_cells
from oddsmill.operators.regimes import BULK, STILL, judged
from oddsmill.operators.variance import acf, budget_slope, power_fit, ratio, winsorised
from oddsmill.sources.appended import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moments(moves: DataFrame) -> DataFrame:
    """The cube of standardised moves, written: a row for each (p, tau).

    t<a>y<b> are sums of dt**a * dp2**b, y and yy those of dp2 / dt and its square, z1 to z4 those of powers of z. A key
    counts at its first move in each cell of the map, so that new_keys add up to the cell's different keys. The windows
    are by key, as the panel's own: they share its shuffle.
    """
    w = Window.partitionBy("key").orderBy("ts_days")
    rows = with_cells(moves).withColumn("dp_next", F.lead("dp").over(w)).withColumn("dt_next", F.lead("dt").over(w))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "pi", "ti").orderBy("ts_days")))
    t, s, z = F.col("dt"), F.col("dp2"), F.col("z")
    paired = t.between(0.9, 1.1) & F.col("dt_next").between(0.9, 1.1)  # neighbouring daily moves
    still = 2 * cdf(F.lit(STILL) / F.sqrt(F.greatest("v_gauss", F.lit(1e-12)))) - 1
    sums = {
        "t1y0": t, "t0y1": s, "t1y1": t * s, "t2y0": t * t, "t4y0": t * t * t * t, "t2y2": t * t * s * s, "t3y1": t * t * t * s,
        "y": s / t, "yy": s / t * (s / t), "z1": z, "z2": z * z, "z3": z * z * z, "z4": z * z * z * z,
        "still": (F.abs("dp") < STILL).cast("double"), "still_exp": still, "new_keys": (F.col("nth") == 1).cast("long"),
        "pairs": F.when(paired, 1).otherwise(0), "bipower": F.when(paired, F.abs(F.col("dp") * F.col("dp_next"))), "paired2": F.when(paired, s),
    }
    return written(rows.groupBy("p", "tau").agg(F.count("*").alias("n"), *(F.sum(v).alias(k) for k, v in sums.items())), "cube")


def within(cube: DataFrame, low: float, high: float) -> DataFrame:
    return cube.filter((F.col("p") >= low) & (F.col("p") < high))


def local_slopes(cube: DataFrame) -> DataFrame:
    """As variance.local_slopes: a rate is its value for one day times dt."""
    out = []
    for name, r in grid.rates(F.col("p"), F.lit(1.0), F.col("tau")).items():
        xx, b = F.sum(r * r * F.col("t2y0")), ratio(F.sum(r * F.col("t1y1")), F.sum(r * r * F.col("t2y0")))
        scatter = F.sum(r * r * F.col("t2y2")) - 2 * b * F.sum(r * r * r * F.col("t3y1")) + b * b * F.sum(r * r * r * r * F.col("t4y0"))
        out += [b.alias(f"{name}_slope"), ratio(F.sqrt(F.greatest(scatter, F.lit(0.0))), xx).alias(f"{name}_se")]
    return cube.agg(*out, F.sum("n").alias("n"))


def local_ratios(cube: DataFrame) -> DataFrame:
    """As variance.local_ratios."""
    unit = grid.rates(F.col("p"), F.lit(1.0), F.col("tau"))
    wf = cube.agg(ratio(F.sum(unit["v_wf"] * F.col("t1y1")), F.sum(unit["v_wf"] * unit["v_wf"] * F.col("t2y0"))).alias("wf"))
    rows = cube.groupBy(grid.price_bucket(F.col("p")).alias("bucket")).agg(F.sum("n").alias("n"), F.sum("t0y1").alias("s"), *(F.sum(r * F.col("t1y0")).alias(k) for k, r in unit.items()))
    rows = rows.join(F.broadcast(wf))  # one row
    return rows.select("bucket", "n", *(ratio(F.col("s"), F.col(f"v_{k}") * (F.col("wf") if k == "wf" else F.lit(1.0))).alias(f"ratio_{k}") for k in ("binom", "gauss", "wf")))


def power_cells(cube: DataFrame, bins: int = 14, tau_bins: int = 6, least: int = 50) -> DataFrame:
    """As variance.power_cells: the quantiles of p(1-p) weigh each price by its moves."""
    rows = cube.select("tau", "n", "y", (F.col("p") * (1 - F.col("p"))).alias("pq"))
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    prices = rows.groupBy("pq").agg(F.sum("n").alias("n"), F.min("tau").alias("t0"), F.max("tau").alias("t1"))  # a row a tick
    span = prices.agg(F.array_distinct(F.percentile("pq", at, F.col("n"))).alias("edges"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    place = F.floor((F.log("tau") - F.log("t0")) / (F.log(F.col("t1") + 1) - F.log("t0")) * tau_bins + 1e-9).cast("int")
    rows = rows.join(F.broadcast(span)).withColumn("qi", F.size(F.filter("edges", lambda e: e <= F.col("pq"))) - 1).withColumn("ti", place)
    mean = lambda c: F.sum(c) / F.sum("n")
    cells = rows.groupBy("qi", "ti").agg(F.sum("n").alias("n"), mean(F.col("y")).alias("my"), mean(F.col("pq") * F.col("n")).alias("mpq"), mean(F.col("tau") * F.col("n")).alias("mtau"))
    return cells.filter((F.col("n") >= least) & (F.col("my") > 0))


def kurtosis() -> Column:
    """Excess kurtosis of z in a group of the cube's rows; null where z doesn't vary beyond rounding."""
    n = F.sum("n").cast("double")
    m, m2, m3, m4 = (F.sum(f"z{k}") / n for k in (1, 2, 3, 4))
    var = m2 - m * m
    return F.when(var > 1e-12 * m2, (m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m * m * m * m) / (var * var) - 3)


def kurtosis_by_bucket(cube: DataFrame, least: int = 30) -> DataFrame:
    """As variance.kurtosis_by_bucket."""
    return cube.groupBy(grid.price_bucket(F.col("p")).alias("bucket")).agg(F.sum("n").alias("n"), kurtosis().alias("kurt")).filter(F.col("n") >= least)


def rate_by_price(cube: DataFrame, alpha: float, least: int = 200) -> DataFrame:
    """As variance.rate_by_price."""
    f, n = F.pow("tau", F.lit(alpha)), F.sum("n")
    mean, squares = F.sum(F.col("y") * f) / n, F.sum(F.col("yy") * f * f)
    sd = F.when(n > 1, F.sqrt(F.greatest(squares - n * mean * mean, F.lit(0.0)) / (n - 1)))
    out = cube.groupBy(grid.steps(F.col("p"), grid.RATE_EDGES).alias("bin")).agg(n.alias("n"), (F.sum(F.col("p") * F.col("n")) / n).alias("mean_p"), mean.alias("rate"), (1.96 * sd / F.sqrt(n)).alias("half"))
    return out.filter(F.col("n") >= least).select("bin", "n", F.col("mean_p").alias("p"), "rate", "half")


def map_cells(cube: DataFrame, least: int = 200, fit_least: int = 50, excess: float = 0.3, kurt: float = 30.0, pairs: int = 50) -> DataFrame:
    """As regimes.map_cells, with the power family fitted to the bulk of the same cube."""
    n = F.sum("n")
    mean = lambda c: F.sum(c) / n
    cells = with_cells(cube).groupBy("pi", "ti").agg(
        n.alias("n"), F.sum("new_keys").alias("n_mkts"), mean(F.col("still")).alias("still_frac"), mean(F.col("still_exp")).alias("still_exp"), kurtosis().alias("kurt_z"),
        F.sum("t0y1").alias("s"), mean(F.col("y")).alias("my"), mean(F.col("p") * (1 - F.col("p")) * F.col("n")).alias("mpq"), mean(F.col("tau") * F.col("n")).alias("mtau"),
        *(F.sum(c).alias(c) for c in ("pairs", "bipower", "paired2")),
    ).filter(F.col("n") >= least)
    return judged(cells, power_fit(power_cells(within(cube, *BULK), least=fit_least)), excess, kurt, pairs)


def map_rows(cells: DataFrame, box: DataFrame) -> DataFrame:
    """The map's cells, each with its regime's cells and share of the budget and with the rectangle: (pi, ti, n, regime, cells, share, inside)."""
    own = Window.partitionBy("regime")
    inside = F.array_contains("p_buckets", F.col("pi")) & F.array_contains("tau_bands", F.col("ti"))
    rows = cells.join(F.broadcast(box))  # one row
    return rows.select("pi", "ti", "n", "regime", F.count("*").over(own).alias("cells"), F.sum("budget_share").over(own).alias("share"), inside.alias("inside"), "p_lo", "p_hi", "tau_lo")


def scalars(budgets: DataFrame, moves: DataFrame, least: int = 50) -> DataFrame:
    """One row: sizes, budget slope, local slopes, power fits over all and over the bulk, lag-1 autocorrelations (winsorised).

    The panel is computed once and kept on the executors' disks, parted by key, for the cube, the quantiles and the lags;
    a lost executor's part is computed again. One row comes to the driver.
    """
    named = lambda df, prefix: df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))
    moves = moves.persist(StorageLevel.DISK_ONLY)
    try:
        cube = moments(moves)
        lags = acf(winsorised(moves), ["z", "lam"], 1).drop("lag").first()
    finally:
        moves.unpersist()
    out = named(budget_slope(budgets), "budget")
    for part, prefix in ((local_slopes(cube), "local"), (power_fit(power_cells(cube, least=least)), "power"), (power_fit(power_cells(within(cube, *BULK), least=least)), "bulk")):
        out = out.join(F.broadcast(named(part, prefix)))  # one row each
    return out.withColumns({f"lag1_{c}": F.lit(x).cast("double") for c, x in lags.asDict().items()})
