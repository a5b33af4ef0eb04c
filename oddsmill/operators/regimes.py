"""Regime map, frozen-price hazard and endgame tables."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import cdf
from oddsmill.operators.panel import with_cells
from oddsmill.operators.variance import power_cells, power_fit, quantile_bin, ratio

# A move that counts as still, and the price range of the bulk power fit.
STILL, BULK = 0.005, (0.15, 0.85)


def bulk_fit(moves: DataFrame, least: int = 50, low: float = BULK[0], high: float = BULK[1]) -> DataFrame:
    return power_fit(power_cells(moves.filter((F.col("p") >= low) & (F.col("p") < high)), least=least))


def map_cells(moves: DataFrame, fit: DataFrame, least: int = 200, excess: float = 0.3, kurt: float = 30.0, pairs: int = 50) -> DataFrame:
    """Cell metrics by price bucket and time band, and the regime: 2 too still, 3 heavy-tailed, else 1.

    fit: one row (c, gamma, alpha) of the power family; ratio_fit is the mean squared move a day over what it expects
    at the cell's mean p(1-p) and tau.
    """
    w = Window.partitionBy("key").orderBy("ts_days")
    rows = with_cells(moves)
    # Pairs of neighbouring daily moves, for the share of jumps by bipower variation.
    daily = lambda c: F.col(c).between(0.9, 1.1)
    rows = rows.withColumn("dp_next", F.lead("dp").over(w)).withColumn("dt_next", F.lead("dt").over(w))
    paired = daily("dt") & daily("dt_next")
    still = 2 * cdf(F.lit(STILL) / F.sqrt(F.greatest("v_gauss", F.lit(1e-12)))) - 1
    cells = rows.groupBy("pi", "ti").agg(
        F.count("*").alias("n"), F.count_distinct("key").alias("n_mkts"),
        F.avg((F.abs("dp") < STILL).cast("double")).alias("still_frac"), F.avg(still).alias("still_exp"), F.kurtosis("z").alias("kurt_z"),
        F.sum("dp2").alias("s"), F.avg(F.col("dp2") / F.col("dt")).alias("my"), F.avg(F.col("p") * (1 - F.col("p"))).alias("mpq"), F.avg("tau").alias("mtau"),
        F.sum(F.when(paired, 1).otherwise(0)).alias("pairs"), F.sum(F.when(paired, F.abs(F.col("dp") * F.col("dp_next")))).alias("bipower"), F.sum(F.when(paired, F.col("dp2"))).alias("paired2"),
    ).filter(F.col("n") >= least)
    return judged(cells, fit, excess, kurt, pairs)


def judged(cells: DataFrame, fit: DataFrame, excess: float = 0.3, kurt: float = 30.0, pairs: int = 50) -> DataFrame:
    """Metrics and regime of cells that are summed up."""
    # greatest() would take 0 for null, where no pair moves.
    jump = F.when((F.col("pairs") >= pairs) & (F.col("paired2") > 0), F.greatest(F.lit(0.0), 1 - (math.pi / 2) * ratio(F.col("bipower"), F.col("paired2"))))
    out = cells.withColumn("excess_still", F.col("still_frac") - F.col("still_exp")).withColumn("jump_share", jump)
    expected = F.col("c") * F.pow("mpq", "gamma") / F.pow("mtau", "alpha")
    out = out.join(F.broadcast(fit.select("c", "gamma", "alpha"))).withColumn("ratio_fit", ratio(F.col("my"), expected)).withColumn("budget_share", ratio(F.col("s"), F.sum("s").over(Window.partitionBy())))
    regime = F.when(F.col("excess_still") >= excess, 2).when(F.col("kurt_z") >= kurt, 3).otherwise(1)
    return out.withColumn("regime", regime).select("pi", "ti", "n", "n_mkts", "still_frac", "excess_still", "kurt_z", "jump_share", "ratio_fit", "budget_share", "regime")


def rectangle(cells: DataFrame) -> DataFrame:
    """(p_lo, p_hi, tau_lo, p_buckets, tau_bands): edges and lists of the buckets and bands in which regime 1 has the majority.

    Buckets are judged by their cells from 7 days on, then bands by the cells of the kept buckets; nothing asks them to
    be neighbours. Without any the edges are null and the lists empty.
    """
    one = (F.col("regime") == 1).cast("double")
    good = cells.filter("ti >= 2").groupBy("pi").agg(F.avg(one).alias("s")).filter("s > 0.5").select("pi")
    bands = cells.join(F.broadcast(good), "pi").groupBy("ti").agg(F.avg(one).alias("s")).filter("s > 0.5")  # 54 cells at most
    edge = lambda edges, k: F.get(F.array(*map(F.lit, edges)), k.cast("int"))
    p, t = F.sort_array(F.collect_list("pi")).alias("p_buckets"), F.sort_array(F.collect_list("ti")).alias("tau_bands")
    both = good.agg(p, edge(grid.PRICE_EDGES, F.min("pi")).alias("p_lo"), edge(grid.PRICE_EDGES, F.max("pi") + 1).alias("p_hi"))
    return both.join(F.broadcast(bands.agg(t, edge(grid.TAU_EDGES, F.min("ti")).alias("tau_lo")))).select("p_lo", "p_hi", "tau_lo", "p_buckets", "tau_bands")


def shares(cells: DataFrame) -> DataFrame:
    return cells.groupBy("regime").agg(F.count("*").alias("cells"), F.sum("budget_share").alias("share"))


def pivoted(cells: DataFrame, value: str = "regime") -> DataFrame:
    return cells.groupBy("ti").pivot("pi", list(range(9))).agg(F.max(value)).select("ti", *(F.col(str(k)).alias(f"p{k}") for k in range(9)))


def tick_rows(raw: DataFrame, cells: DataFrame | None, unit: float, longest: float = 1.5) -> DataFrame:
    """Folded ticks of short moves in the cells of a regime: (key, di, ti, k)."""
    rows = with_cells(raw.filter(F.col("dt") <= longest))
    if cells is not None:
        rows = rows.join(F.broadcast(cells.select("pi", "ti")), ["pi", "ti"], "left_semi")
    return rows.select("key", grid.distance_bucket(F.col("p")).alias("di"), "ti", grid.folded_ticks(F.col("p"), F.col("dp"), unit).alias("k"))


def tick_histogram(ticks: DataFrame) -> DataFrame:
    """Counts of each tick by cell: all that the likelihood of a cell needs, however many moves there are."""
    return ticks.groupBy("di", "ti", "k").agg(F.count("*").alias("n"))


# Edges of the endgame's bands of days.
BANDS = (1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 30.0)


def endgame_cells(raw: DataFrame, unit: float, latest: float = 30.0, longest: float = 1.5, bins: int = 10, least: int = 100) -> DataFrame:
    """Share of moves of two ticks or more and mean squared moves by quantile bins of p(1-p) and fixed time bins (under a day: -1)."""
    rows = raw.filter((F.col("tau") <= latest) & (F.col("dt") <= longest) & (F.col("dt") > 0)).withColumn("pq", F.col("p") * (1 - F.col("p")))
    rows = rows.withColumn("move", (F.abs(F.bround(F.col("dp") / unit)) >= 2).cast("double"))
    rows = quantile_bin(rows, "pq", bins, [], "qi").withColumn("tj", grid.steps(F.col("tau"), BANDS[:-1]) - 1)
    cells = rows.groupBy("qi", "tj").agg(F.count("*").alias("n"), F.avg("pq").alias("mpq"), F.avg("tau").alias("mtau"), F.avg("move").alias("move_rate"), F.avg(F.col("dp2") / F.col("dt")).alias("tot"))
    return cells.filter(F.col("n") >= least)


def spend_profile(markets: DataFrame, raw: DataFrame, bands=(0.0, 1.0, 3.0, 7.0, 30.0)) -> DataFrame:
    """Share of lifetime variance by (low, high] days to resolution, and that of the terminal jump."""
    parts = []
    for lo, hi in zip(bands, bands[1:], strict=False):
        parts.append(F.struct(F.lit(f"({lo:g},{hi:g}]").alias("band"), F.sum(F.when((F.col("tau") > lo) & (F.col("tau") <= hi), F.col("dp2")).otherwise(0.0)).alias("s")))
    parts.append(F.struct(F.lit(f">{bands[-1]:g}").alias("band"), F.sum(F.when(F.col("tau") > bands[-1], F.col("dp2")).otherwise(0.0)).alias("s")))
    moves = raw.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    last = markets.groupBy("key").agg(F.pow(F.max("final") - F.max_by("close", "ts_days"), 2).alias("s"))
    rows = moves.unionByName(last.agg(F.lit("terminal").alias("band"), F.sum("s").alias("s")))
    return rows.select("band", ratio(F.col("s"), F.sum("s").over(Window.partitionBy())).alias("share"))


def cell_variances(raw: DataFrame, unit: float) -> DataFrame:
    """(pi, ti, n, var) of the moves by cell, unit squared where nothing moved; and over all, as cell -1, -1, for cells that are not listed."""
    var = F.var_samp("dp")
    rows = with_cells(raw)
    cells = rows.groupBy("pi", "ti").agg(F.count("*").alias("n"), F.when(var == 0, unit * unit).otherwise(var).alias("var"))
    return cells.unionByName(rows.agg(F.lit(-1).alias("pi"), F.lit(-1).alias("ti"), F.count("*").alias("n"), var.alias("var")))
