"""Variance budgets, local rates, the power family and diagnostics. Everything reduces to sums by cell, combined map-side."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import density, probit
from oddsmill.operators.quantiles import exact


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def slope_columns(x: Column, y: Column) -> tuple[Column, Column]:
    """Slope through the origin and its robust standard error, in one pass."""
    xx, xy = F.sum(x * x), F.sum(x * y)
    b = ratio(xy, xx)
    scatter = F.sum(x * x * y * y) - 2 * b * F.sum(x * x * x * y) + b * b * F.sum(x * x * x * x)
    return b, ratio(F.sqrt(F.greatest(scatter, F.lit(0.0))), xx)


def lifetime_budget(markets: DataFrame) -> DataFrame:
    """Per key: realised variance with the terminal jump, implied variance p0 (1 - p0), p0."""
    w = Window.partitionBy("key").orderBy("ts_days")
    rows = markets.withColumn("dp", F.lead("close").over(w) - F.col("close"))
    last = F.max_by("close", "ts_days")
    out = rows.groupBy("key").agg(F.sum(F.coalesce(F.col("dp") * F.col("dp"), F.lit(0.0))).alias("rv"), F.pow(F.max("final") - last, 2).alias("jump"), F.min_by("close", "ts_days").alias("p0"))
    return out.select("key", "p0", (F.col("rv") + F.col("jump")).alias("rv"), (F.col("p0") * (1 - F.col("p0"))).alias("iv"))


def budget_slope(budgets: DataFrame) -> DataFrame:
    b, se = slope_columns(F.col("iv"), F.col("rv"))
    return budgets.agg(b.alias("slope"), se.alias("se"), F.count("*").alias("n"))


def budget_by_bucket(budgets: DataFrame) -> DataFrame:
    rows = budgets.withColumn("bucket", grid.price_bucket(F.col("p0")))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), ratio(F.sum("rv"), F.sum("iv")).alias("ratio")).withColumn("label", grid.price_label(F.col("bucket")))


def mixed(x: Column) -> Column:
    """Well mixed integer below 2**31 of one below 2**31: multiplications and shifts that both engines have."""
    for shift, factor in ((16, 0x21F0AAAD), (15, 0x35A2D97D)):
        x = x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor).cast("long") % F.lit(1 << 31).cast("long")
    return x.bitwiseXOR(F.shiftright(x, 15))


# Cumulative Poisson(1) probabilities, e**-1 * sum(1 / k!), of 0 to 7.
POISSON = tuple(sum(1 / math.factorial(j) for j in range(k + 1)) / math.e for k in range(8))


def draws(units: DataFrame, cell: list[str], b: int, seed: int = 7) -> DataFrame:
    """Bootstrap sums of the units (num, den, ord: an integer of its own): each unit comes Poisson(1) times into each replicate.

    The times are a hash of seed, ord and replicate: no numbering, no join, and sums that combine map-side. Costs units
    x b rows within the tasks, so it runs on sums per key, never on moves.
    """
    u = mixed(mixed(F.pmod(F.col("ord").cast("long") + seed * 1299709, F.lit(1 << 31))) + F.col("r") * F.lit(40503).cast("long")) / float(1 << 31)
    rows = units.select(*cell, "num", "den", "ord", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(b).cast("long"))).alias("r"))
    rows = rows.withColumn("u", u).withColumn("w", grid.steps(F.col("u"), POISSON))
    return rows.groupBy(*cell, "r").agg(ratio(F.sum(F.col("w") * F.col("num")), F.sum(F.col("w") * F.col("den"))).alias("ratio"))


def bootstrap(units: DataFrame, cell: list[str], b: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of the ratio of sums in each cell; replicates without a denominator are left out."""
    ends = F.percentile("ratio", F.array(F.lit(0.025), F.lit(0.975)))
    return draws(units, cell, b, seed).groupBy(*cell).agg(ends.alias("e")).select(*cell, F.col("e")[0].alias("ci_lo"), F.col("e")[1].alias("ci_hi"))


def local_slopes(moves: DataFrame) -> DataFrame:
    """Slope and error of squared moves on each candidate rate, in one aggregation."""
    out = []
    for c in ("v_binom", "v_gauss", "v_wf"):
        b, se = slope_columns(F.col(c), F.col("dp2"))
        out += [b.alias(f"{c}_slope"), se.alias(f"{c}_se")]
    return moves.agg(*out, F.count("*").alias("n"))


def local_ratios(moves: DataFrame) -> DataFrame:
    """By price bucket, mean squared move over the mean of each rate; v_wf scaled by its own slope."""
    wf = moves.agg(ratio(F.sum(F.col("v_wf") * F.col("dp2")), F.sum(F.col("v_wf") * F.col("v_wf"))).alias("wf"))
    rows = moves.withColumn("bucket", grid.price_bucket(F.col("p"))).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("dp2").alias("s"), *(F.sum(c).alias(c) for c in ("v_binom", "v_gauss", "v_wf")))
    rows = rows.join(F.broadcast(wf))  # one row
    return rows.select("bucket", "n", ratio(F.col("s"), F.col("v_binom")).alias("ratio_binom"), ratio(F.col("s"), F.col("v_gauss")).alias("ratio_gauss"), ratio(F.col("s"), F.col("v_wf") * F.col("wf")).alias("ratio_wf"))


def quantile_bin(rows: DataFrame, value: str, bins: int, by: list[str], out: str) -> DataFrame:
    """Bin of a value between the distinct quantiles of its group; the largest value is in a bin of its own, as left-closed bins give."""
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = rows.groupBy(*by).agg(F.array_distinct(F.percentile(value, at)).alias("edges"))
    met = rows.join(F.broadcast(edges), by) if by else rows.join(F.broadcast(edges))  # an array for each group
    return met.withColumn(out, F.size(F.filter("edges", lambda e: e <= F.col(value))) - 1).drop("edges")


def solve3(s: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Weighted least squares of y on 1, a, b by Cramer's rule from sums w, wa, wb, waa, wab, wbb, wy, way, wby."""
    w, wa, wb, waa, wab, wbb, wy, way, wby = (s[k] for k in ("w", "wa", "wb", "waa", "wab", "wbb", "wy", "way", "wby"))

    def det(a, b, c, d, e, f, g, h, i):
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    full = F.nullif(det(w, wa, wb, wa, waa, wab, wb, wab, wbb), F.lit(0.0))
    return (
        det(wy, wa, wb, way, waa, wab, wby, wab, wbb) / full,
        det(w, wy, wb, wa, way, wab, wb, wby, wbb) / full,
        det(w, wa, wy, wa, waa, way, wb, wab, wby) / full,
    )


def power_cells(moves: DataFrame, by: list[str] | None = None, bins: int = 14, tau_bins: int = 6, least: int = 50) -> DataFrame:
    """Cell means of squared moves per day over quantile bins of p(1-p) and even bins of log tau, up to log(max tau + 1).

    Quantiles and span come from one aggregation; p lies on ticks, so that a group has few different p(1-p).
    """
    by = by or []
    rows = moves.select(*by, "tau", (F.col("p") * (1 - F.col("p"))).alias("pq"), (F.col("dp2") / F.col("dt")).alias("y"))
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    span = rows.groupBy(*by).agg(F.array_distinct(F.percentile("pq", at)).alias("edges"), F.min("tau").alias("t0"), F.max("tau").alias("t1"))
    rows = rows.join(F.broadcast(span), by) if by else rows.join(F.broadcast(span))  # a row for each group
    place = F.floor((F.log("tau") - F.log("t0")) / (F.log(F.col("t1") + 1) - F.log("t0")) * tau_bins + 1e-9).cast("int")
    rows = rows.withColumn("qi", F.size(F.filter("edges", lambda e: e <= F.col("pq"))) - 1).withColumn("ti", place)
    cells = rows.groupBy(*by, "qi", "ti").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("pq").alias("mpq"), F.avg("tau").alias("mtau"))
    return cells.filter((F.col("n") >= least) & (F.col("my") > 0))


def power_fit(cells: DataFrame, by: list[str] | None = None, least: int = 8) -> DataFrame:
    """c, gamma, alpha of y = c pq**gamma / tau**alpha, weights n; null under `least` cells."""
    by = by or []
    w, a, b, y = F.col("n").cast("double"), F.log("mpq"), F.log("mtau"), F.log("my")
    sums = {"w": w, "wa": w * a, "wb": w * b, "waa": w * a * a, "wab": w * a * b, "wbb": w * b * b, "wy": w * y, "way": w * a * y, "wby": w * b * y}
    got = cells.groupBy(*by).agg(*(F.sum(v).alias(k) for k, v in sums.items()), F.count("*").alias("cells"))
    c, g, t = solve3({k: F.col(k) for k in sums})
    enough = F.col("cells") >= least
    return got.select(*by, "cells", F.when(enough, F.exp(c)).alias("c"), F.when(enough, g).alias("gamma"), F.when(enough, -t).alias("alpha"))


def kurtosis_by_bucket(moves: DataFrame, least: int = 30) -> DataFrame:
    rows = moves.withColumn("bucket", grid.price_bucket(F.col("p"))).groupBy("bucket").agg(F.count("*").alias("n"), F.kurtosis("z").alias("kurt"))
    return rows.filter(F.col("n") >= least)


def winsorised(moves: DataFrame) -> DataFrame:
    """z clipped at its 0.005 and 0.995 quantiles and lam at its 0.99 quantile, over all moves."""
    ends = exact(moves, {"z": [0.005, 0.995], "lam": [0.99]})
    low, high, most = (F.lit(x).cast("double") for x in (*ends["z"], *ends["lam"]))
    return moves.withColumns({"z": F.least(F.greatest("z", low), high), "lam": F.least("lam", most)})


def acf(moves: DataFrame, columns: list[str], lags: int = 5) -> DataFrame:
    """(lag, acf_<column>): autocorrelations pooled within keys, means of keys removed; lags by row."""
    w = Window.partitionBy("key")
    rows = moves.select("key", "ts_days", *((F.col(c) - F.avg(c).over(w)).alias(f"v_{c}") for c in columns))
    rows = rows.select("*", *(F.lag(f"v_{c}", k).over(w.orderBy("ts_days")).alias(f"{c}_{k}") for c in columns for k in range(1, lags + 1)))
    one = lambda c, k: ratio(F.sum(F.col(f"v_{c}") * F.col(f"{c}_{k}")), F.sum(F.col(f"v_{c}") * F.col(f"v_{c}")))
    got = rows.agg(*(one(c, k).alias(f"{c}_{k}") for c in columns for k in range(1, lags + 1)))
    found = [F.struct(F.lit(k).alias("lag"), *(F.col(f"{c}_{k}").alias(f"acf_{c}") for c in columns)) for k in range(1, lags + 1)]
    return got.select(F.explode(F.array(*found)).alias("x")).select("x.*")


def rate_by_price(moves: DataFrame, alpha: float, least: int = 200) -> DataFrame:
    """Mean of dp2 / dt * tau ** alpha by price step of 0.05, with its 95 % half-width: (bin, n, p, rate, half), `least` moves a bin at least."""
    y = F.col("dp2") / F.col("dt") * F.pow("tau", F.lit(alpha))
    rows = moves.select("p", y.alias("y"), grid.steps(F.col("p"), grid.RATE_EDGES).alias("bin"))
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("rate"), F.stddev_samp("y").alias("sd"))
    return out.filter(F.col("n") >= least).select("bin", "n", "p", "rate", (1.96 * F.col("sd") / F.sqrt("n")).alias("half"))


def ratios_with_floor(units: DataFrame, least: int, b: int) -> DataFrame:
    """Per bucket of units (bucket, num, den, ord): n, ratio of sums and its bootstrap interval, null under `least` units."""
    out = units.groupBy("bucket").agg(F.count("*").alias("n"), ratio(F.sum("num"), F.sum("den")).alias("ratio"))
    enough = F.col("n") >= least
    out = out.join(bootstrap(units, ["bucket"], b), "bucket", "left")
    return out.select("bucket", "n", *(F.when(enough, F.col(c)).alias(c) for c in ("ratio", "ci_lo", "ci_hi")))


def level_match(cells: DataFrame, gamma: float) -> DataFrame:
    """(curve, level): factor by which each candidate curve of p meets the cells (p, rate) in geometric mean."""
    pq, z = F.col("p") * (1 - F.col("p")), probit(F.col("p"))
    curves = {"arcsin": pq, "logit": pq * pq, "probit": F.pow(density(z), 2), "power": F.pow(pq, F.lit(gamma))}
    got = cells.filter("rate > 0").agg(*(F.exp(F.avg(F.log("rate") - F.log(c))).alias(k) for k, c in curves.items()))
    return got.select(F.explode(F.array(*(F.struct(F.lit(k).alias("curve"), F.col(k).alias("level")) for k in curves))).alias("x")).select("x.*")
