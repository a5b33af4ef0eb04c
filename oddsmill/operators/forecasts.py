"""Scoring of one-step forecasts of tick moves, market by market, and what the scores add up to."""
from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.functions import grid
from oddsmill.functions.normal import cdf, probit
from oddsmill.operators import states
from oddsmill.operators.cube import map_cells, moments, written
from oddsmill.operators.fits import HAZARD, hazard_fits, masses, masses_below, normal_cdf
from oddsmill.operators.panel import EDGE_CLIP, move_panel, raw_panel, segments, standardised, with_cells
from oddsmill.operators.regimes import cell_variances, rectangle, tick_histogram
from oddsmill.operators.search import Descent, Sloped, run_all
from oddsmill.operators.variance import bootstrap, ratio

# Models, and the least probability of a move.
MODELS, LEAST = ("composite_zi", "composite", "global_slv", "const_lam", "bucket", "garch"), 1e-12


# -- pooled GARCH(1, 1)


def garch_series(moves: DataFrame, by: list[str]) -> DataFrame:
    """(by..., key, x): the squared moves (key, ts_days, dp) of each key in time; a market's life bounds a row."""
    x = F.transform(F.sort_array(F.collect_list(F.struct("ts_days", "dp"))), lambda r: r["dp"] * r["dp"])
    return moves.filter("dp is not null").groupBy(*by, "key").agg(x.alias("x"))


def garch_terms(x: Column, points: list[tuple[float, float, float]]) -> Column:
    """Sum over squared moves of log variance and move over variance, one for each (w, a, b), starting at the long-run variance.

    One pass over the array carries the variances of all points.
    """
    given = F.from_json(F.lit(json.dumps([dict(zip("wab", map(float, p), strict=True)) for p in points])), "array<struct<w: double, a: double, b: double>>")  # one literal
    first = F.transform(given, lambda p: F.struct((p["w"] / F.greatest(1 - p["a"] - p["b"], F.lit(1e-6))).alias("var"), F.lit(0.0).alias("s")))

    def step(state: Column, y: Column) -> Column:
        return F.zip_with(state, given, lambda t, p: F.struct((p["w"] + p["a"] * y + p["b"] * t["var"]).alias("var"), (t["s"] + F.log(t["var"]) + y / t["var"]).alias("s")))

    return F.aggregate(x, first, step, lambda state: F.transform(state, lambda t: t["s"]))


def garch_likelihoods(series: DataFrame, points: list[tuple[float, float, float]], by: list[str]) -> DataFrame:
    """(by..., k, ll, n): Gaussian log-likelihood of all series under each of the points."""
    rows = series.select(*by, F.size("x").alias("n"), F.posexplode(garch_terms(F.col("x"), points)).alias("k", "s"))
    sums = rows.groupBy(*by, "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select(*by, F.col("k").cast("long").alias("k"), (-0.5 * (F.col("s") + F.col("n") * math.log(2 * math.pi))).alias("ll"), F.col("n").cast("long").alias("n"))


def garch_parameters(u: np.ndarray) -> tuple[float, float, float]:
    logistic = lambda v: 1 / (1 + math.exp(-min(max(v, -500.0), 500.0)))
    a = 0.999 * logistic(u[1])
    return math.exp(min(u[0], 300.0)), a, (1 - a) * 0.999 * logistic(u[2])


#: Where a search begins, and how far from there a first one may end: beyond, a likelihood is too flat to be searched from.
GARCH_START, GARCH_NEAR = np.array([math.log(1e-4), 0.0, 1.0]), np.array([12.0, 6.0, 6.0])


def garch_first(series: DataFrame, by: list[str], most: int) -> dict[tuple, tuple[np.ndarray, np.ndarray | None]]:
    """Where the search of each group ends that sees only some of its series by hash (states.FIRST moves or so), and its inverse curvature; a task each."""
    n = series.groupBy(*by).agg(F.sum(F.size("x")).alias("_n"))
    u = F.pmod(F.xxhash64("key", F.lit("first")), F.lit(1 << 30)) / float(1 << 30)
    few = series.join(F.broadcast(n), by) if by else series.join(F.broadcast(n))  # a row a group
    few = few.withColumn("_u", u).filter(F.col("_u") * F.col("_n") < states.FIRST)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_u", "key"])
        size = pdf["x"].map(len).to_numpy()
        x = np.full((len(pdf), int(size.max())), np.nan)
        for i, v in enumerate(pdf["x"]):
            x[i, : len(v)] = v
        s = Descent(GARCH_START, 1e-4)

        def values(asked: dict) -> dict:
            w, a, b = (np.array(c)[:, None] for c in zip(*map(garch_parameters, asked[0]), strict=True))
            var, total = np.repeat(w / np.maximum(1 - a - b, 1e-6), len(x), axis=1), np.zeros(len(w))
            for y in x.T:
                total += np.nansum(np.log(var) + y / var, axis=1)
                var = w + a * y + b * var
            return {0: (0.5 * total / size.sum()).tolist()}

        with np.errstate(all="ignore"):
            run_all({0: s}, values, most)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), s.x.tolist(), s.inverse.ravel().tolist(), s.fresh]], columns=[*by, "x", "inverse", "fresh"])

    kinds = dict(series.dtypes)
    got = few.groupBy(*by).applyInPandas(search, ", ".join([*(f"{c} {kinds[c]}" for c in by), "x array<double>, inverse array<double>, fresh boolean"])).collect()  # a row a group
    out = {}
    for r in got:
        x = np.where(np.isfinite(r.x), r.x, GARCH_START)
        held = np.clip(x, GARCH_START - GARCH_NEAR, GARCH_START + GARCH_NEAR)
        out[tuple(r[: len(by)])] = (held, None if r.fresh or (held != r.x).any() else states.tamed(np.array(r.inverse).reshape(len(x), -1)))
    return out


def garch_slopes(u: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood of padded series of squared moves, and its derivatives by u."""
    w, a, b = garch_parameters(u)
    rest = 1 - a - b
    var, d = np.full(len(x), w / max(rest, 1e-6)), np.zeros((3, len(x)))
    d[0], d[1:] = 1 / max(rest, 1e-6), w / rest**2 if rest > 1e-6 else 0.0
    total, slope = 0.0, np.zeros(3)
    for y in x.T:
        y = y[~np.isnan(y)]  # long ones are first
        var, d = var[: len(y)], d[:, : len(y)]
        total += float((np.log(var) + y / var).sum()) + len(y) * math.log(2 * math.pi)
        slope += d @ ((1 - y / var) / var)
        d = b * d
        d[0], d[1], d[2] = d[0] + 1, d[1] + y, d[2] + var
        var = w + a * y + b * var
    by_a, by_b = a * (1 - a / 0.999), b * (1 - b / ((1 - a) * 0.999))
    return -0.5 * total, -0.5 * np.array([slope[0] * w, slope[1] * by_a - slope[2] * b / (1 - a) * by_a, slope[2] * by_b])


def garch_sums(blocks: DataFrame, points: dict[str, np.ndarray]) -> dict[str, tuple[float, np.ndarray, int]]:
    """garch_slopes() of each part's series and the number of moves: one job, summed in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        with np.errstate(all="ignore"):
            for pdf in batches:
                for part, n, rows, data in zip(pdf["part"], pdf["n"], pdf["rows"], pdf["data"], strict=True):
                    if part in points:
                        ll, slope = garch_slopes(points[part], np.frombuffer(data).reshape(rows, -1))
                        now = sums.setdefault(part, [0.0, np.zeros(3), 0])
                        now[:] = now[0] + ll, now[1] + slope, now[2] + n
        yield pd.DataFrame([(part, ll, slope.tolist(), n) for part, (ll, slope, n) in sums.items()], columns=["part", "ll", "slope", "n"])

    out = {part: (0.0, np.zeros(3), 0) for part in points}
    for r in blocks.mapInPandas(run, "part string, ll double, slope array<double>, n long").collect():  # a row a task and group
        ll, slope, n = out[r.part]
        out[r.part] = ll + r.ll, slope + np.array(r.slope), n + r.n
    return out


def garch_blocks(series: DataFrame, by: list[str]) -> DataFrame:
    """(part, n, rows, data): padded series, states.BATCH a row at most; part tells the groups apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, own in pdf.groupby("part", sort=False):
                for b in states.padded({"z": list(own["x"])}):
                    yield pd.DataFrame([(part, int(b["size"].sum()), len(b["z"]), b["z"].tobytes())], columns=["part", "n", "rows", "data"])

    part = F.to_json(F.struct(*by)) if by else F.lit("")
    return series.select(part.alias("part"), "x").mapInPandas(run, "part string, n long, rows int, data binary")


def garch_fit(moves: DataFrame, by: list[str] | None = None, most: int = 250) -> DataFrame:
    """(by..., w, a, b, n, ll_per_obs, converged): pooled GARCH(1, 1) of all moves of each group; a round of the searches is one job over all series."""
    by, spark = by or [], moves.sparkSession
    series = garch_series(moves, by).repartition(2 * spark.sparkContext.defaultParallelism, *by, "key").persist()  # a round has these tasks
    blocks = garch_blocks(series, by).persist()
    counts = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row a group
    groups = {part: tuple(json.loads(part).get(c) for c in by) if by else () for part in counts}
    nearer = garch_first(series, by, min(most, states.FIRST_ROUNDS))
    series.unpersist()
    searches = {}
    for part, g in groups.items():
        at, inverse = nearer.get(g, (GARCH_START, None))
        searches[part] = Sloped(at, inverse=inverse)

    def values_of(asked: dict) -> dict:
        got = garch_sums(blocks, {part: u for part, (u,) in asked.items()})
        return {part: [(-ll / n, -slope / n)] for part, (ll, slope, n) in got.items()}

    run_all(searches, values_of, most)
    blocks.unpersist()
    out = [(*groups[part], *garch_parameters(s.x), counts[part], -s.value, s.converged) for part, s in searches.items()]
    kinds = [*(f"{c} {dict(moves.dtypes)[c]}" for c in by), "w double, a double, b double, n long, ll_per_obs double, converged boolean"]
    return spark.createDataFrame(out, ", ".join(kinds))


def gauss_mass(var: Column, k: Column, unit: float) -> Column:
    """Probability of a move of k ticks under a normal of this variance, LEAST at least."""
    sd = F.greatest(F.sqrt(var), F.lit(1e-9))
    return F.greatest(cdf((k + 0.5) * unit / sd) - cdf((k - 0.5) * unit / sd), F.lit(LEAST))


def gauss_masses(var: np.ndarray, k: np.ndarray, unit: float) -> np.ndarray:
    """gauss_mass over arrays."""
    sd = np.fmax(np.sqrt(var), 1e-9)
    return np.maximum(normal_cdf((k + 0.5) * unit / sd) - normal_cdf((k - 0.5) * unit / sd), LEAST)


def steps(markets: DataFrame, unit: float) -> DataFrame:
    """A row a move, with what forecasts need (and the fold, if the markets have one): key, ts_days, p, tau, pi, ti, k (ticks), kf (folded), and the segment columns z to isz of both its ends."""
    by = [c for c in ("fold",) if c in markets.columns]
    w = Window.partitionBy(*by, "key").orderBy("ts_days")
    low, high = grid.PRICE_CLIP
    clipped = F.least(F.greatest("close", F.lit(low)), F.lit(high))
    edge = lambda c: probit(F.least(F.greatest(c, F.lit(EDGE_CLIP[0])), F.lit(EDGE_CLIP[1])))
    rows = markets.withColumns({"pos": F.row_number().over(w) - 1, "left": F.greatest(F.col("t_res") - F.col("ts_days"), F.lit(1.0)), "pc": clipped, "p": F.lag("close").over(w)})
    rows = rows.withColumns({"tau": F.lag("left").over(w), "dt": F.col("ts_days") - F.lag("ts_days").over(w), "dp": F.col("close") - F.col("p")})
    k = F.bround(F.col("dp") / unit).cast("long")
    rows = with_cells(rows.withColumns({"k": k, "kf": F.when(F.col("p") <= 0.5, k).otherwise(-k)}))
    return rows.select(
        *by, "key", "ts_days", "pos", "p", "tau", "pi", "ti", "dp", "k", "kf", "dt", F.col("tau").alias("taup"), probit(F.col("pc")).alias("z"), edge(F.col("pc") - unit / 2).alias("zlo"), edge(F.col("pc") + unit / 2).alias("zhi"),
        F.coalesce(F.col("k") == 0, F.lit(False)).alias("isz"), edge(F.col("p") + (F.col("k") - 0.5) * unit).alias("blo"), edge(F.col("p") + (F.col("k") + 0.5) * unit).alias("bhi"),
    )


def with_cell_fits(rows: DataFrame, cells: DataFrame, variances: DataFrame, mixtures: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows with regime (1 where the cell is not mapped), var (of the cell, else over all) and the cell's mixture, null without one; all tables by the columns `by` too."""
    by = by or []
    on = [*by, "pi", "ti"]
    everywhere = F.broadcast(variances.filter("pi = -1").select(*by, F.col("var").alias("_var")))
    rows = rows.join(F.broadcast(cells.select(*on, "regime")), on, "left").join(F.broadcast(variances.select(*on, F.col("var").alias("_own"))), on, "left")
    rows = rows.join(F.broadcast(mixtures.select(*on, *HAZARD)), on, "left")  # 54 cells at most for each group
    rows = rows.join(everywhere, by, "left") if by else rows.join(everywhere)
    return rows.withColumns({"regime": F.coalesce("regime", F.lit(1)), "var": F.coalesce("_own", "_var")}).drop("_own", "_var")


#: The models whose parameters are fitted to segments: of regime 1's rectangle (inner) or of all prices, and in which variant.
FITTED = {"r1": ("inner", "full"), "glob": ("all", "full"), "clam": ("all", "no-sv"), "zi": ("inner", "zi")}


def scores(markets: DataFrame, unit: float, cells: DataFrame, variances: DataFrame, mixtures: DataFrame, thetas: DataFrame, garch: DataFrame, seed: int = 7) -> DataFrame:
    """(fold, key, ts_days, p, tau, regime, MODELS..., pit): logarithmic score of each move of the markets (fold, key, ...) under each model as fitted in its fold.

    All parameters are tables by fold: cells, variances, mixtures, thetas (fold, model of FITTED, c to pi0) and garch
    (w, a, b), joined to the moves; masses are worked out with the filters, array by array. The composites use state forecasts in regime 1, the cell's mixture elsewhere and the cell's normal
    without one. pit is that of composite_zi, randomised within the tick by a hash of seed, key and time. A market's
    path is filtered in one task; markets are independent.
    """

    def filtered_markets(b: dict[str, np.ndarray], given: pd.Series) -> dict[str, np.ndarray]:
        """What the state models and GARCH of a fold say of each move of padded markets."""
        out = {}
        for name in FITTED:
            mass, below = np.zeros(b["z"].shape), np.zeros(b["z"].shape)

            def told(k, prior, at, var, mass=mass, below=below):
                m, sd = len(prior), np.sqrt(var)
                f = lambda x: (prior * normal_cdf((x[:m, k, None] - at) / sd)).sum(axis=1)
                mass[:m, k], below[:m, k] = f(b["bhi"]) - f(b["blo"]), f(b["zlo"])

            theta = {c: float(given[f"{name}_{c}"]) for c in (states.INFLATED if name == "zi" else states.PLAIN)}
            states.filtered(theta, [b], seen_by=told)
            out[f"m_{name}"], out[f"f_{name}"] = mass, below
        w, a, bb = (float(given[f"garch_{c}"]) for c in "wab")
        var, now = np.zeros(b["z"].shape), w / max(1 - a - bb, 1e-6)
        for j in range(1, var.shape[1]):
            x = b["dp"][:, j]
            var[:, j], now = now, w + a * x * x + bb * now
        return {"garch": gauss_masses(var, b["k"], unit), **out}

    def scored(b: dict[str, np.ndarray], given: pd.Series) -> dict[str, np.ndarray]:
        """Scores of each move of padded markets, and the mass under its tick by composite_zi."""
        out, pi0, one, still = filtered_markets(b, given), float(given["zi_pi0"]), b["regime"] == 1, b["k"] == 0
        theta, bucket = [b[c] for c in HAZARD], gauss_masses(b["var"], b["k"], unit)
        mixed = ~np.isnan(b["pi0"])
        outside = np.where(mixed & ~one, np.maximum(masses(b["kf"], *theta), LEAST), bucket)
        zi = np.maximum((1 - pi0) * np.maximum(out["m_zi"], LEAST) + pi0 * still, LEAST)
        held = {"composite_zi": np.where(one, zi, outside), "composite": np.where(one, np.maximum(out["m_r1"], LEAST), outside), "global_slv": np.maximum(out["m_glob"], LEAST), "const_lam": np.maximum(out["m_clam"], LEAST), "bucket": bucket, "garch": out["garch"]}
        stale = np.concatenate([np.zeros((len(still), 1), bool), b["z"][:, :-1] < b["zlo"][:, 1:]], axis=1)
        normal = normal_cdf((b["k"] - 0.5) * unit / np.fmax(np.sqrt(b["var"]), 1e-9))
        low = np.where(one, (1 - pi0) * out["f_zi"] + pi0 * stale, np.where(mixed, masses_below(b["kf"], *theta), normal))
        return {**{c: np.log(x) for c, x in held.items()}, "low": low, **{c: b[c] for c in same}}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("fold", sort=False):
                columns = {c: list(own[c]) for c in paths} | {"row": [[float(i)] for i in range(len(own))]}
                for b in states.padded(columns):
                    rows = own.iloc[b.pop("row")[:, 0].astype(int)]
                    with np.errstate(all="ignore"):
                        out = scored(b, rows.iloc[0])
                    yield pd.DataFrame({"fold": rows["fold"].to_numpy(), "key": rows["key"].to_numpy(), "pos": [list(range(1, n)) for n in b["size"]], **{c: [x[1:n] for x, n in zip(out[c], b["size"], strict=True)] for c in kept}})

    same = ["ts_days", "p", "tau", "regime"]
    paths = ["z", "dt", "taup", "zlo", "zhi", "isz", "blo", "bhi", "dp", "k", "kf", "var", *same, *HAZARD]
    kept = [*same, *MODELS, "low"]
    wide = garch.select("fold", *(F.col(c).alias(f"garch_{c}") for c in "wab"))
    for name in FITTED:
        own = thetas.filter(F.col("model") == name).select("fold", *(F.col(c).alias(f"{name}_{c}") for c in states.INFLATED))
        wide = wide.join(own, "fold")
    rows = with_cell_fits(steps(markets, unit), cells, variances, mixtures, ["fold"])
    rows = rows.select("fold", "key", "pos", *(F.col(c) if c == "isz" else F.col(c).cast("double").alias(c) for c in paths))
    whole = rows.groupBy("fold", "key").agg(F.sort_array(F.collect_list(F.struct("pos", *paths))).alias("x")).select("fold", "key", *(F.col(f"x.{c}").alias(c) for c in paths))  # a row a market
    known = whole.repartition(2 * markets.sparkSession.sparkContext.defaultParallelism, "fold", "key").join(F.broadcast(wide), "fold")  # a row a fold
    got = known.mapInPandas(run, "fold int, key string, pos array<int>, " + ", ".join(f"{c} array<double>" for c in kept))
    got = got.select("fold", "key", F.inline(F.arrays_zip("pos", *kept)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"), F.lit(":"), F.col("pos"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    pit = F.least(F.greatest(F.col("low") + u * F.exp("composite_zi"), F.lit(0.0)), F.lit(1.0))
    return got.select("fold", "key", "ts_days", "p", "tau", F.col("regime").cast("int").alias("regime"), *MODELS, pit.alias("pit"))


@dataclass
class FoldFits:
    """Everything fitted to the training markets of each fold, as tables by fold; the arguments of scores()."""

    cells: DataFrame
    variances: DataFrame
    mixtures: DataFrame
    thetas: DataFrame
    garch: DataFrame


def cell_fits(markets: DataFrame, unit: float, least: int = 200, fit_least: int = 50, mixture_least: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regime map, variances by cell, and mixtures of the cells outside regime 1, of all markets: what forecasts need without any state fit."""
    raw, cells = raw_panel(markets), map_cells(moments(standardised(move_panel(markets))), least, fit_least)
    ticks = with_cells(raw).select(F.col("pi").alias("di"), "ti", grid.folded_ticks(F.col("p"), F.col("dp"), unit).alias("k"))
    other = cells.filter("regime <> 1").select(F.col("pi").alias("di"), "ti")
    mixed = hazard_fits(tick_histogram(ticks.join(F.broadcast(other), ["di", "ti"], "left_semi")), mixture_least)  # 54 cells at most
    return cells, cell_variances(raw, unit), mixed.withColumnRenamed("di", "pi")


def fold_fits(markets: DataFrame, parts: DataFrame, unit: float, folds: tuple[int, ...] = (0, 1), most: int = 400, segment: int = 8, **cell: int) -> FoldFits:
    """All models fitted to the markets that are `train` in each fold (parts: fold, key, part).

    The map's rectangle, one row a fold, comes to the driver, as segments depend on it; without a rectangle regime 1's
    models take all prices. The state fits of all folds share their rounds, and so do the GARCH fits. Markets, cells and
    segments are written, so that each is made once and no later plan repeats theirs.
    """
    markets, train = written(markets, "markets"), written(parts.filter("part = 'train'").select("fold", "key"), "train")

    def prepared(fold: int) -> tuple[list[DataFrame], DataFrame]:
        own = markets.join(train.filter(F.col("fold") == fold).select("key"), "key", "left_semi")
        tables = [written(t.withColumn("fold", F.lit(fold)), "fit") for t in cell_fits(own, unit, **cell)]
        r = rectangle(tables[0]).first()
        inner = (r.p_lo, r.p_hi, r.tau_lo) if r and r.p_lo is not None and r.tau_lo is not None else (0.0, 1.0, 0.0)
        segs = [segments(own, *box, least=segment, unit=unit).withColumns({"fold": F.lit(fold), "box": F.lit(name)}) for name, box in (("inner", inner), ("all", (0.0, 1.0, 0.0)))]
        return tables, written(segs[0].unionByName(segs[1]), "segments")

    inherited = inheritable_thread_target(markets.sparkSession)
    with ThreadPoolExecutor(len(folds) + 1) as pool:  # jobs of the folds, and GARCH's, side by side
        garch = pool.submit(inherited(garch_fit), raw_panel(markets.join(train, "key"), ["fold", "key"]), ["fold"], most)
        tables, segs = zip(*pool.map(inherited(prepared), folds), strict=True)
        every = functools.reduce(DataFrame.unionByName, segs)
        only = {(fold, box): [v for b, v in FITTED.values() if b == box] for fold in folds for box in ("inner", "all")}
        found = states.fits(every, [], most, ["fold", "box"], only)
    model = F.coalesce(*(F.when((F.col("box") == box) & (F.col("variant") == v), m) for m, (box, v) in FITTED.items()))
    thetas = found.withColumn("model", model).drop("box")
    cells, variances, mixed = (functools.reduce(DataFrame.unionByName, t) for t in zip(*tables, strict=True))
    return FoldFits(cells, variances, mixed, thetas, garch.result())


def race(markets: DataFrame, parts: DataFrame, unit: float, **how) -> DataFrame:
    """scores() of the markets that are `test` in each fold, under what was fitted to those that are `train`."""
    markets, parts = written(markets, "markets"), written(parts, "parts")
    f = fold_fits(markets, parts, unit, **how)
    test = markets.join(parts.filter("part = 'test'").select("fold", "key"), "key")
    return scores(test, unit, f.cells, f.variances, f.mixtures, f.thetas, f.garch)


def cell_scores(markets: DataFrame, unit: float, cells: DataFrame, variances: DataFrame) -> DataFrame:
    """(key, ts_days, k, regime, bucket, flat): scores of each move under its cell's normal, and under one normal for all moves."""
    none = ", ".join(["pi int", "ti int", *(f"{c} double" for c in HAZARD)])
    rows = with_cell_fits(steps(markets, unit).filter("pos > 0"), cells, variances, markets.sparkSession.createDataFrame([], none))
    flat = variances.filter("pi = -1").select(F.col("var").alias("flat"))
    score = lambda c: F.log(gauss_mass(F.col(c), F.col("k"), unit))
    return rows.join(F.broadcast(flat)).select("key", "ts_days", "k", "regime", score("var").alias("bucket"), score("flat").alias("flat"))  # one row


def summary(scored: DataFrame, models: tuple[str, ...], base: str) -> DataFrame:
    """(model, ll_per_obs, delta) over all observations: delta is the mean score less that of the base."""
    got = scored.agg(*(F.avg(m).alias(m) for m in models))
    rows = got.select(F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("ll_per_obs"), (F.col(m) - F.col(base)).alias("delta")) for m in models))).alias("x"))
    return rows.select("x.*")


def by_regime(scored: DataFrame, models: tuple[str, ...]) -> DataFrame:
    return scored.groupBy("regime").agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in models))


def delta_intervals(scored: DataFrame, models: tuple[str, ...], base: str, order: Column, b: int = 1000) -> DataFrame:
    """(model, ci_lo, ci_hi): 95 % interval of the base's mean score less the model's, whole markets drawn; order: an integer of each key."""
    own = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col(base) - F.col(m)).alias("d")) for m in models if m != base)))
    units = scored.select(order.alias("ord"), own.alias("x")).groupBy("x.model", "ord").agg(F.sum("x.d").alias("num"), F.count("*").cast("double").alias("den"))
    return bootstrap(units, ["model"], b)


def budget_integration(remaining: DataFrame) -> DataFrame:
    """Realised part of the budget table by band: starts, remaining variance over p0 (1 - p0) as a ratio of sums, share of jumps and the terminal one."""
    jumps = F.sum(F.col("jumps") + F.col("terminal"))
    spent = F.sum(F.col("small") + F.col("jumps") + F.col("terminal"))
    return remaining.groupBy("band").agg(F.count("*").alias("n"), ratio(spent, F.sum(F.col("p0") * (1 - F.col("p0")))).alias("real_ratio"), ratio(jumps, spent).alias("real_jump_share"))
