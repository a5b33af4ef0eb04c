"""Maximum-likelihood fits. Spark reduces to what a likelihood needs: tick counts by cell, or a bounded sample of segments.

A fit is one small task: its input is a histogram or at most `most` steps (panel.subsample), however large the panel
is. Everything that follows from given parameters (masses, summaries, scores) is a Column expression or a map over keys.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import HART, cdf
from oddsmill.operators.regimes import BANDS
from oddsmill.operators.variance import power_fit, quantile_bin

HAZARD = ("pi0", "h", "sigma", "rho_a", "rho_t", "w_a")


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """normal.cdf over an array."""
    x = np.asarray(x, float)
    a = np.abs(x)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        low = np.exp(a * a / -2)
        parts = []
        for first, second, *rest in HART:
            y = a * first
            y += second
            for c in rest:
                y *= a
                y += c
            parts.append(y)
        parts[0] /= parts[1]
        low = low * parts[0]
        big = a >= 7.07106781186547
        if big.any():
            a = a[big]
            far = np.exp(a * a / -2) / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / math.sqrt(2 * math.pi)
            low = np.array(low)
            low[big] = np.where(a > 37, 0.0, far)
    return np.where(x > 0, 1 - low, low)


def simplex(f: Callable, start: np.ndarray, most: int, x_tol: float, f_tol: float) -> tuple[np.ndarray, float, bool]:
    """Least point of f by the downhill simplex method (Nelder and Mead 1965) from a 5 % simplex."""
    points = [np.array(start, float)]
    for k in range(len(start)):
        p = points[0].copy()
        p[k] = p[k] * 1.05 if p[k] else 0.00025
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= x_tol and max(abs(v - values[0]) for v in values[1:]) <= f_tol:
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        at = lambda t: centre + t * (points[-1] - centre)  # noqa: B023, E731
        x = at(-1.0)
        v = f(x)
        if v < values[0]:
            far = at(-2.0)
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (x, v)
        elif v < values[-2]:
            points[-1], values[-1] = x, v
        else:
            near = at(-0.5 if v < values[-1] else 0.5)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0] + 0.5 * (p - points[0]) for p in points]
                values = [values[0], *(f(p) for p in points[1:])]
    k = int(np.argmin(values))
    return points[k], values[k], False


def section(f: Callable, low: float, high: float, steps: int = 60) -> float:
    """Least point of a unimodal f by golden sections of the logarithm."""
    a, b, g = math.log(low), math.log(high), (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(math.exp(c)), f(math.exp(d))
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(math.exp(c))
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(math.exp(d))
    return math.exp((a + b) / 2)


# -- ticks of markets that mostly stand still


def tick_mass(k: Column, t: dict[str, Column]) -> Column:
    """Probability of a move of k ticks: frozen with pi0, gaps of two ticks or more with h (geometric to either side), else a rounded normal."""
    rest = F.greatest(1 - t["pi0"] - t["h"], F.lit(0.0))
    a = F.abs(k) - 2
    gap = F.when(k >= 2, t["w_a"] * (1 - t["rho_a"]) * F.pow(t["rho_a"], a)).when(k <= -2, (1 - t["w_a"]) * (1 - t["rho_t"]) * F.pow(t["rho_t"], a)).otherwise(0.0)
    return rest * (cdf((k + 0.5) / t["sigma"]) - cdf((k - 0.5) / t["sigma"])) + F.when(k == 0, t["pi0"]).otherwise(0.0) + t["h"] * gap


def masses(k: np.ndarray, pi0, h, sigma, rho_a, rho_t, w_a) -> np.ndarray:
    """tick_mass over an array; parameters are numbers or arrays."""
    a = np.maximum(np.abs(k) - 2, 0)
    gap = np.where(k >= 2, w_a * (1 - rho_a) * rho_a**a, np.where(k <= -2, (1 - w_a) * (1 - rho_t) * rho_t**a, 0.0))
    return np.maximum(1 - pi0 - h, 0.0) * (normal_cdf((k + 0.5) / sigma) - normal_cdf((k - 0.5) / sigma)) + pi0 * (k == 0) + h * gap


def masses_below(k: np.ndarray, pi0, h, sigma, rho_a, rho_t, w_a) -> np.ndarray:
    """Sum of masses() over all moves of less than k ticks: the normal and the geometric tails in closed form."""
    gap = np.where(k <= -1, (1 - w_a) * rho_t ** np.maximum(-k - 1, 0), np.where(k >= 3, 1 - w_a * rho_a ** np.maximum(k - 2, 0), 1 - w_a))
    return np.maximum(1 - pi0 - h, 0.0) * normal_cdf((k - 0.5) / sigma) + pi0 * (k > 0) + h * gap


def hazard_of(k: np.ndarray, n: np.ndarray) -> tuple[list[float], float, bool]:
    """HAZARD parameters of a tick histogram, log-likelihood an observation, whether the search ended."""
    logistic = lambda v: 1 / (1 + math.exp(-min(max(v, -500.0), 500.0)))

    def theta(u) -> list[float]:
        a, b = math.exp(min(u[0], 500.0)), math.exp(min(u[1], 500.0))
        return [a / (1 + a + b), b / (1 + a + b), math.exp(min(max(u[2], -300.0), 300.0)), *map(logistic, u[3:])]

    odds = lambda q: math.log(q / (1 - q))
    start = [math.log(0.5 / 0.45), math.log(0.05 / 0.45), 0.0, odds(0.7), odds(0.7), odds(0.5)]
    u, value, ok = simplex(lambda u: -float(n @ np.log(masses(k, *theta(u)) + 1e-300)) / n.sum(), np.array(start), 2000, 1e-4, 1e-7)
    return theta(u), -value, ok


def hazard_fits(histogram: DataFrame, least: int = 500) -> DataFrame:
    """(di, ti, n, pi0, h, sigma, rho_a, rho_t, w_a, ll_per_obs, converged) of the cells of a tick histogram (di, ti, k, n) with `least` moves."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        n = part["n"].to_numpy(float)
        if n.sum() < least:
            return pd.DataFrame(columns=names)
        theta, ll, ok = hazard_of(part["k"].to_numpy(float), n)
        return pd.DataFrame([[part["di"].iloc[0], part["ti"].iloc[0], int(n.sum()), *theta, ll, ok]], columns=names)

    names = ["di", "ti", "n", *HAZARD, "ll_per_obs", "converged"]
    rows = histogram.select(F.col("di").cast("long").alias("di"), F.col("ti").cast("long").alias("ti"), F.col("k").cast("long").alias("k"), F.col("n").cast("long").alias("n"))
    return rows.groupBy("di", "ti").applyInPandas(fit, "di long, ti long, n long, " + ", ".join(f"{c} double" for c in HAZARD) + ", ll_per_obs double, converged boolean")


def hazard_summary(fits: DataFrame, histogram: DataFrame, longest: int = 2000) -> DataFrame:
    """What the parameters say: mean gap in ticks, its share of the variance, and the model's variance over the empirical one."""

    def moment(rho: str, power: int) -> Column:
        one = lambda s, k: s + (1 - F.col(rho)) * F.pow(F.col(rho), k - 2) * F.pow(k, F.lit(float(power)))
        return F.aggregate(F.sequence(F.lit(2), F.lit(longest)), F.lit(0.0), one)

    empirical = histogram.groupBy("di", "ti").agg((F.sum(F.col("n") * F.col("k") * F.col("k")) / F.sum("n")).alias("emp"))
    rows = fits.withColumn("size", F.col("w_a") * moment("rho_a", 1) + (1 - F.col("w_a")) * moment("rho_t", 1)).withColumn("square", F.col("w_a") * moment("rho_a", 2) + (1 - F.col("w_a")) * moment("rho_t", 2))
    rows = rows.withColumn("model", F.greatest(1 - F.col("pi0") - F.col("h"), F.lit(0.0)) * F.col("sigma") * F.col("sigma") + F.col("h") * F.col("square")).join(empirical, ["di", "ti"])
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return rows.select("di", "ti", "n", "pi0", F.col("h").alias("h_day"), F.col("sigma").alias("sigma_tk"), F.col("size").alias("gap_mean_tk"), F.col("w_a").alias("w_away"), (F.col("h") * F.col("square") / zero("model")).alias("gap_var_share"), (F.col("model") / zero("emp")).alias("var_model_emp"), "ll_per_obs")


# -- the last month: how often prices move, and by how much


def latent_size(k: np.ndarray, n: np.ndarray) -> float:
    """Standard deviation in ticks of a rounded normal of which only moves of two ticks or more are seen."""

    def cost(s: float) -> float:
        seen = 2 * normal_cdf(np.array(-1.5 / s))
        return -float(n @ np.log(2 * (normal_cdf((k + 0.5) / s) - normal_cdf((k - 0.5) / s)) / max(seen, 1e-300) + 1e-300))

    return section(cost, 0.3, 200.0)


def with_arrival(cells: DataFrame, unit: float, least: int = 50) -> DataFrame:
    """cells (move_rate, movers, s) with size, the squared latent size in price, and nu, the rate of arrivals of which only visible moves are seen; null under `least` movers."""
    seen = 2 * (1 - cdf(1.5 / F.col("s")))
    enough = (F.col("movers") >= least) & F.col("s").isNotNull()
    return cells.withColumn("size", F.when(enough, F.pow(F.col("s") * unit, 2))).withColumn("nu", F.when(enough, F.least(F.col("move_rate") / seen, F.lit(1.0))))


def endgame_fits(raw: DataFrame, unit: float, latest: float = 30.0, longest: float = 1.5, bins: int = 10, least: int = 100, movers: int = 50) -> DataFrame:
    """The endgame's cells (qi, tj, n, mpq, mtau, tot, move_rate, movers, s, size, nu): s is fitted to the histogram of each cell's visible moves."""
    rows = raw.filter((F.col("tau") <= latest) & (F.col("dt") <= longest) & (F.col("dt") > 0)).withColumn("pq", F.col("p") * (1 - F.col("p")))
    rows = rows.withColumn("k", F.abs(F.bround(F.col("dp") / unit)).cast("long"))
    rows = quantile_bin(rows, "pq", bins, [], "qi").withColumn("tj", grid.steps(F.col("tau"), BANDS[:-1]) - 1)
    rows = rows.select(F.col("qi").cast("long").alias("qi"), F.col("tj").cast("long").alias("tj"), "pq", "tau", "k", (F.col("dp2") / F.col("dt")).alias("y"))
    # One aggregation by cell and tick is all that cells and fits are made from.
    ticks = rows.groupBy("qi", "tj", "k").agg(F.count("*").alias("n"), F.sum("pq").alias("pq"), F.sum("tau").alias("tau"), F.sum("y").alias("y"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        s = latent_size(part["k"].to_numpy(float), part["n"].to_numpy(float))
        return pd.DataFrame([[part["qi"].iloc[0], part["tj"].iloc[0], s]], columns=["qi", "tj", "s"])

    sizes = ticks.filter("k >= 2").select("qi", "tj", "k", "n").groupBy("qi", "tj").applyInPandas(fit, "qi long, tj long, s double")
    visible = F.sum(F.when(F.col("k") >= 2, F.col("n")).otherwise(0))
    mean = lambda c: F.sum(c) / F.sum("n")
    cells = ticks.groupBy("qi", "tj").agg(F.sum("n").alias("n_all"), mean("pq").alias("mpq"), mean("tau").alias("mtau"), mean("y").alias("tot"), (visible / F.sum("n")).alias("move_rate"), visible.alias("movers"))
    cells = cells.withColumnRenamed("n_all", "n").filter(F.col("n") >= least)
    return with_arrival(cells.join(sizes, ["qi", "tj"], "left"), unit, movers)


def endgame_laws(cells: DataFrame, least: int = 6) -> DataFrame:
    """(part, cells, a, g, b) of the power laws of arrival, size and total, and `sum`: the exponents of arrival and size added up, which should be the total's."""

    def law(name: str, column: str) -> DataFrame:
        got = power_fit(cells.filter(F.col(column) > 0).select("n", "mpq", "mtau", F.col(column).alias("my")), least=least)
        return got.select(F.lit(name).alias("part"), "cells", F.col("c").alias("a"), F.col("gamma").alias("g"), F.col("alpha").alias("b"))

    laws = law("arrival", "nu").unionByName(law("size", "size")).unionByName(law("total", "tot"))
    both = laws.filter("part <> 'total'").agg(F.lit("sum").alias("part"), F.min("cells").alias("cells"), F.lit(None).cast("double").alias("a"), F.when(F.count("g") == 2, F.sum("g")).alias("g"), F.when(F.count("b") == 2, F.sum("b")).alias("b"))
    return laws.unionByName(both)
