"""Fits recover what made the data; values worked out by hand from the definitions."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmill.functions.normal import probit
from oddsmill.operators import fits, forecasts, markets, mixtures, panel, regimes, search, states, variance, venues
from oddsmill.sources import store


def close(a, b, tol=1e-9):
    assert abs(a - b) <= tol, (a, b)


def test_simplex_and_section():
    x, v, ok = fits.simplex(lambda u: (u[0] - 3) ** 2 + 10 * (u[1] + 1) ** 2, np.array([0.0, 0.0]), 500, 1e-6, 1e-10)
    assert ok and abs(x[0] - 3) < 1e-3 and abs(x[1] + 1) < 1e-3 and v < 1e-6
    close(fits.section(lambda s: (math.log(s) - 1) ** 2, 0.3, 200.0), math.e, 1e-6)


def test_hazard_fit_recovers(spark):
    rng = np.random.default_rng(3)
    kind = rng.choice(3, 40_000, p=[0.5, 0.1, 0.4])
    gap = np.where(rng.random(40_000) < 0.7, 1, -1) * (1 + rng.geometric(0.3, 40_000))
    k = np.where(kind == 0, 0, np.where(kind == 1, gap, np.rint(rng.normal(0, 1.4, 40_000)).astype(int)))
    rows = pd.DataFrame({"di": 1, "ti": 2, "k": k}).groupby(["di", "ti", "k"]).size().reset_index(name="n")
    histogram = spark.createDataFrame(rows)
    found = fits.hazard_fits(histogram)
    r = found.first()
    assert r.n == 40_000 and abs(r.pi0 - 0.5) < 0.05 and abs(r.h - 0.1) < 0.03 and abs(r.sigma - 1.4) < 0.15 and abs(r.w_a - 0.7) < 0.1
    assert abs(fits.hazard_summary(found, histogram).first().var_model_emp - 1) < 0.1
    assert fits.hazard_fits(histogram, 50_000).count() == 0


def test_latent_size_recovers():
    rng = np.random.default_rng(1)
    k = np.abs(np.rint(rng.normal(0, 3.0, 50_000)))
    values, counts = np.unique(k[k >= 2], return_counts=True)
    assert abs(fits.latent_size(values, counts) - 3.0) < 0.1


def paths(n=60, steps=60, c=0.05, eta=0.05, seed=2, unit=None):
    """Segments of a random walk seen with noise: alpha 0, constant volatility."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = np.cumsum(rng.normal(0, math.sqrt(c), steps)) * 0.3
        z = x + rng.normal(0, eta, steps)
        rows += [(f"k{i}", 0, j, float(z[j]), 1.0 if j else None, 1.0 if j else None) for j in range(steps)]
    return pd.DataFrame(rows, columns=["key", "run", "pos", "z", "dt", "taup"])


def test_filter_is_kalman_without_volatility():
    """Against the textbook recursion for one series."""
    rows = paths(1, 30)
    theta = {"c": 0.004, "alpha": 0.5, "eta": 0.05, "phi": 0.0, "s": 1e-8}
    z, mean, var, ll = rows["z"].to_numpy(), rows["z"][0], 0.05**2, 0.0
    for k in range(1, 30):
        var += 0.004
        total, gap = var + 0.05**2, z[k] - mean
        ll += -0.5 * (math.log(2 * math.pi * total) + gap * gap / total)
        mean, var = mean + var / total * gap, var * (1 - var / total)
    got, n, pit = states.filtered(theta, states.batches(rows, False), True)
    close(got, ll, 1e-8)
    assert n == 29 and len(pit) == 29


def test_state_fit_recovers(spark):
    rows = paths(120, 80)
    segs = spark.createDataFrame(rows, "key string, run long, pos int, z double, dt double, taup double")
    found = {r.variant: r for r in states.nested(states.fits(segs, ["no-sv", "full"], 150), "full").collect()}
    assert abs(found["no-sv"].c / (0.05 * 0.09) - 1) < 0.2 and abs(found["no-sv"].eta - 0.05) < 0.02
    assert found["full"].d_ll == 0 and found["no-sv"].d_ll < 0.005 and found["no-sv"].lr_p > 1e-4
    theta = {c: found["no-sv"][c] for c in states.PLAIN}
    pits = states.transforms(segs, theta)
    close(pits.agg(F.sum("ll")).first()[0], found["no-sv"].ll, 1e-6)
    shares = [r.share for r in states.deciles(pits.select(F.explode("pit").alias("pit"))).collect()]
    assert len(shares) == 10 and max(shares) < 0.13
    thetas = states.fits(segs.withColumn("part", F.lit("all")), ["no-sv"], 100, ["part"])
    held = states.heldout(segs.withColumn("part", F.lit("x")), thetas.unionByName(thetas.withColumn("part", F.lit("x")).withColumn("n", F.lit(10).cast("long"))), "all", "part")
    close(held.first().ll_per_obs, thetas.first().ll_per_obs, 1e-9)


def test_zero_inflation_recovers(spark):
    """Prices on ticks that stay stale with 0.4."""
    rng = np.random.default_rng(5)
    closes = []
    for i in range(80):
        x, p = 0.0, 0.5
        for j in range(60):
            x += rng.normal(0, 0.12)
            if rng.random() > 0.4:
                p = round(0.5 * math.erfc(-x / math.sqrt(2)), 2)
            closes.append((f"k{i}", float(j), p, 1.0, 1e6))
    rows = spark.createDataFrame(closes, "key string, ts_days double, close double, final double, t_res double")
    segs = panel.segments(rows, 0.1, 0.9, 0.0, unit=0.01).withColumn("taup", F.when(F.col("taup").isNotNull(), 1.0))
    found = {r.variant: r for r in states.fits(segs, ["zi", "zi-off"], 200).collect()}
    assert abs(found["zi"].pi0 - 0.4) < 0.12 and found["zi"].ll > found["zi-off"].ll
    pits = states.transforms(segs, {c: found["zi"][c] for c in states.INFLATED}).select(F.explode("pit").alias("pit"))
    assert max(r.share for r in states.deciles(pits).collect()) < 0.14


def test_scores_are_probabilities(spark):
    """Over all moves from one state each model's masses add up to one; the gaussian ones equal their closed form."""
    rows = []
    for i in range(12):
        rng = np.random.default_rng(i)
        p = 0.5
        for j in range(25):
            rows.append((f"k{i}", float(j), round(p, 2), float(i % 2), 30.0))
            p = min(max(p + rng.normal(0, 0.03), 0.05), 0.95)
    table = spark.createDataFrame(rows, "key string, ts_days double, close double, final double, t_res double")
    raw = panel.raw_panel(table)
    cells = spark.createDataFrame([(4, 4, 1), (3, 4, 2)], "pi int, ti int, regime int")
    mixtures_ = spark.createDataFrame([(3, 4, 0.5, 0.1, 1.2, 0.6, 0.6, 0.5)], "pi int, ti int, pi0 double, h double, sigma double, rho_a double, rho_t double, w_a double")
    plain = {"c": 0.2, "alpha": 1.0, "eta": 0.02, "phi": 0.9, "s": 0.5}
    thetas = {"r1": plain, "glob": plain, "clam": {**plain, "phi": 0.0, "s": 1e-8}, "zi": {**plain, "pi0": 0.2}}
    known = spark.createDataFrame([(0, m, *(t.get(c, 0.0) for c in states.INFLATED)) for m, t in thetas.items()], "fold int, model string, " + ", ".join(f"{c} double" for c in states.INFLATED))
    fold = lambda df: df.withColumn("fold", F.lit(0))
    garch = spark.createDataFrame([(0, 1e-5, 0.1, 0.8)], "fold int, w double, a double, b double")
    got = forecasts.scores(fold(table), 0.01, fold(cells), fold(regimes.cell_variances(raw, 0.01)), fold(mixtures_), known, garch)
    found = got.collect()
    assert len(found) == 12 * 24 and all(0 <= r.pit <= 1 for r in found) and all(math.log(1e-12) - 1e-9 <= r[m] <= 1e-9 for r in found for m in forecasts.MODELS)
    assert len({r.model for r in forecasts.summary(got, forecasts.MODELS, "composite").collect()}) == 6
    masses = spark.range(-80, 81).select(F.sum(forecasts.gauss_mass(F.lit(0.0009), F.col("id"), 0.01)), F.sum(fits.tick_mass(F.col("id"), {k: F.lit(v) for k, v in zip(fits.HAZARD, (0.5, 0.1, 1.2, 0.6, 0.6, 0.5), strict=True)}))).first()
    close(masses[0], 1, 1e-6), close(masses[1], 1, 1e-6)


def test_garch_recovers(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        var = 1e-4 / (1 - 0.9)
        for j in range(150):
            x = rng.normal(0, math.sqrt(var))
            rows.append((f"k{i}", float(j), float(x)))
            var = 1e-4 + 0.15 * x * x + 0.75 * var
    moves = spark.createDataFrame(rows, "key string, ts_days double, dp double")
    got = forecasts.garch_fit(moves).first()
    assert abs(got.a - 0.15) < 0.06 and abs(got.a + got.b - 0.9) < 0.08 and got.converged and got.n == 9000
    # The recurrence, move by move.
    w, a, b = got.w, got.a, got.b
    ll = 0.0
    for i in range(60):
        var = w / (1 - a - b)
        for _, _, x in rows[i * 150 : i * 150 + 150]:
            ll -= 0.5 * (math.log(2 * math.pi * var) + x * x / var)
            var = w + a * x * x + b * var
    close(got.ll_per_obs * 9000, ll, 1e-6)
    folds = moves.withColumn("fold", F.lit(1)).unionByName(moves.filter("key < 'k3'").withColumn("fold", F.lit(2)))
    two = {r.fold: r for r in forecasts.garch_fit(folds, ["fold"]).collect()}
    close(two[1].ll_per_obs, got.ll_per_obs, 1e-5)
    assert two[2].n < 9000 and two[2].a != got.a


def em(x, k, centres, steps=300):
    """Plain EM of one mixture from hard assignment to given centres."""
    n, d = x.shape
    share = np.full((n, k), 1e-3)
    share[np.arange(n), ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)] = 1
    share /= share.sum(1, keepdims=True)
    for _ in range(steps):
        own = share.sum(0)
        mu = share.T @ x / own[:, None]
        logs = np.empty((n, k))
        for j in range(k):
            off = x - mu[j]
            cov = (share[:, j, None] * off).T @ off / own[j]
            logs[:, j] = math.log(own[j] / n) - 0.5 * (np.einsum("nd,de,ne->n", off, np.linalg.inv(cov), off) + np.linalg.slogdet(cov)[1] + d * math.log(2 * math.pi))
        row = np.logaddexp.reduce(logs, axis=1)
        share = np.exp(logs - row[:, None])
    return row.sum()


def test_all_mixtures_in_one_em(spark):
    """Against plain EM from the true centres, with repeated rows; one component in closed form."""
    rng = np.random.default_rng(8)
    centres = np.array([[-4.0, 0, 1], [4, 1, 0], [0, 6, -3]])
    x = np.concatenate([rng.normal(c, 0.7 + k / 3, (200, 3)) for k, c in enumerate(centres)])
    x = np.concatenate([x, x[:20]])
    rows = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    found = mixtures.fit_all(rows, ["a", "b", "c"], range(1, 4), 3)
    close(found[3]["ll"], em(x, 3, centres), 1e-2)
    off = x - x.mean(0)
    close(found[1]["ll"], -0.5 * len(x) * (3 * math.log(2 * math.pi) + np.linalg.slogdet(off.T @ off / len(x))[1] + 3), 1e-3)
    assert found[1]["ll"] < found[2]["ll"] < found[3]["ll"] and found[3]["n"] == len(x) and found[3]["bic"] < found[2]["bic"]
    assert mixtures.fit_all(rows.limit(0), ["a", "b", "c"]) == {}
    means = np.array(sorted(found[3]["mu"]))
    assert np.abs(means - centres[np.argsort(centres[:, 0])]).max() < 0.3


def test_descent():
    """All searches of a round in one call; Rosenbrock's valley, a flat direction, and a start at the least point."""
    f = {"valley": lambda u: (1 - u[0]) ** 2 + 100 * (u[1] - u[0] ** 2) ** 2, "flat": lambda u: (u[0] - 3) ** 2 + 1e-12 * u[1], "there": lambda u: float(u @ u)}
    searches = {"valley": search.Descent(np.array([-1.2, 1.0]), 1e-6, 1e-12), "flat": search.Descent(np.array([40.0, 5.0])), "there": search.Descent(np.zeros(3))}
    calls = []

    def values(asked):
        calls.append(set(asked))
        return {k: [f[k](u) for u in points] for k, points in asked.items()}

    rounds = search.run_all(searches, values, 200)
    assert rounds == len(calls) < 120 and all(s.converged for s in searches.values()) and calls[0] == set(f) and calls[-1] != set(f)
    assert np.abs(searches["valley"].x - 1).max() < 1e-3 and abs(searches["flat"].x[0] - 3) < 1e-3 and not searches["there"].x.any()


def test_many_parameters_are_filtered_as_one_by_one(spark):
    rows = paths(7, 20)
    parts = states.batches(rows, False)
    thetas = [{"c": c, "alpha": a, "eta": 0.05, "phi": 0.8, "s": s} for c, a, s in ((0.004, 0.5, 0.3), (0.02, 0.1, 1.0), (0.1, 1.0, 0.6))]
    many, n, _ = states.filtered_many(thetas, parts)
    for t, ll in zip(thetas, many, strict=True):
        one, m, _ = states.filtered(t, parts)
        close(one, ll, 1e-9)
        assert m == n
    segs = spark.createDataFrame(rows, "key string, run long, pos int, z double, dt double, taup double").repartition(3)
    got = states.likelihoods(states.packed(segs, [], False), {("", "full"): [*thetas, {**thetas[0], "s": 1e-9}]})["", "full"]
    for (ll, m), one in zip(got, [*many, states.filtered({**thetas[0], "s": 1e-9}, parts)[0]], strict=True):
        close(ll, one, 1e-8)
        assert m == n


def test_fold_fits_see_training_markets_only(spark):
    """Test markets with other prices change no parameter; scores are of test markets."""
    rng = np.random.default_rng(3)
    rows, keys = [], [f"k{i}" for i in range(30)]
    for i, key in enumerate(keys):
        p = 0.5
        for j in range(20):
            rows.append((key, float(j), round(p, 2), float(i % 2), 25.0))
            p = min(max(p + rng.normal(0, 0.03), 0.06), 0.94)
    schema = "key string, ts_days double, close double, final double, t_res double"
    parts = spark.createDataFrame([(f, k, "train" if i < 15 + 5 * f else "test") for f in (0, 1) for i, k in enumerate(keys)], "fold int, key string, part string")
    how = {"segment": 5, "least": 20, "fit_least": 5, "mixture_least": 50, "most": 6}
    one = forecasts.fold_fits(spark.createDataFrame(rows, schema), parts, 0.01, **how)
    changed = [(k, t, 0.9 if int(k[1:]) >= 20 and j % 2 else c, f, r) for j, (k, t, c, f, r) in enumerate(rows)]
    two = forecasts.fold_fits(spark.createDataFrame(changed, schema), parts, 0.01, **how)
    flat = lambda df, *by: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert flat(one.thetas) == flat(two.thetas) and flat(one.garch) == flat(two.garch) and flat(one.variances) == flat(two.variances)
    assert {(r.fold, r.model) for r in one.thetas.collect()} == {(f, m) for f in (0, 1) for m in forecasts.FITTED}
    table = spark.createDataFrame(rows, schema)
    scored = forecasts.scores(table.join(parts.filter("part = 'test'").select("fold", "key"), "key"), 0.01, one.cells, one.variances, one.mixtures, one.thetas, one.garch)
    assert {(r.fold, r.key) for r in scored.select("fold", "key").distinct().collect()} == {(f, k) for f in (0, 1) for i, k in enumerate(keys) if i >= 15 + 5 * f}


def test_gate(spark):
    """Two parts of unlike noise do better with a model each; a small part falls back on the whole."""
    calm, wild = paths(40, 40, eta=0.02, seed=1), paths(40, 40, c=0.6, eta=0.3, seed=2)
    wild["key"] = "w" + wild["key"]
    segs = spark.createDataFrame(pd.concat([calm, wild]), "key string, run long, pos int, z double, dt double, taup double")
    keys = [(f"{w}k{i}", i) for w in ("", "w") for i in range(40)]
    parts = spark.createDataFrame([(k, "kind", "wild" if k[0] == "w" else "few" if i < 3 else "calm") for k, i in keys], "key string, partition string, part string")
    test = spark.createDataFrame([(k, i % 3 == 0) for k, i in keys], "key string, is_test boolean")
    got = {(r.partition, r.part): r for r in states.gate(segs, parts, test, most=60, least=300).collect()}
    assert got["global", None].n == got["kind", None].n == got["global", "all"].n and got["kind", None].ll_per_obs > got["global", None].ll_per_obs + 0.1
    assert got["kind", "wild"].own and got["kind", "calm"].own and not got["kind", "few"].own
    # The whole's parameters on the small part's segments.
    whole = states.fits(segs.join(test.filter("not is_test"), "key").drop("is_test"), ["full"], 60).first()
    few = segs.join(test.filter("is_test"), "key").filter("key = 'k0'").toPandas()
    ll, n, _ = states.filtered({c: whole[c] for c in states.PLAIN}, states.batches(few, False))
    close(got["kind", "few"].ll_per_obs, ll / n, 1e-3)


def test_aligned_by_hand(spark):
    """Venue k's bars are stamped where they begin, pm's are points at their label."""
    from datetime import datetime

    at = lambda d, h=0: datetime(2024, 3, d, h)
    bars = spark.createDataFrame([("k", at(1, 5), 0.1), ("k", at(2, 5), 0.2), ("k", at(3, 5), 0.3), ("k", at(3, 6), 0.35), ("p", at(2), 0.5), ("p", at(3), 0.6), ("p", at(4), 0.7), ("p", at(5), 0.8)], "key string, ts timestamp, close double")
    pairs = spark.createDataFrame([(0, "k", "p")], "pair_id int, k_key string, pm_key string")
    got = [(r.ts, r.p_k, r.p_pm) for r in venues.aligned(pairs, bars).orderBy("ts").collect()]
    assert got == [(at(2), 0.1, 0.5), (at(3), 0.2, 0.6), (at(4), 0.35, 0.7)]
    hours = spark.createDataFrame([("k", at(1, h), h / 10) for h in range(4)] + [("p", at(1, h), 0.5 + h / 100) for h in range(5)], "key string, ts timestamp, close double")
    assert [(r.ts.hour, r.p_k) for r in venues.aligned(pairs, hours, "hour").orderBy("ts").collect()] == [(1, 0.0), (2, 0.1), (3, 0.2), (4, 0.3)]


def test_jump_share_of_cells_that_do_not_move(spark):
    rows = [(f"k{i}", float(j), 0.5, 0.0, 0.0, 1.0, 20.0) for i in range(4) for j in range(20)]
    moves = panel.standardised(spark.createDataFrame(rows, "key string, ts_days double, p double, dp double, dp2 double, dt double, tau double").withColumn("v_gauss", F.lit(0.01)))
    fit = spark.createDataFrame([(1.0, 1.0, 1.0)], "c double, gamma double, alpha double")
    (cell,) = regimes.map_cells(moves, fit, least=20, pairs=50).collect()
    assert cell.n == 80 and cell.jump_share is None and cell.regime == 2


def test_mixture_selection(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal((-4, 0), 1, (400, 2)), rng.normal((4, 1), 0.5, (400, 2))])
    rows = spark.createDataFrame([(str(k), float(a), float(b)) for k, (a, b) in enumerate(x)], "key string, a double, b double")
    split = panel.random_split(rows)
    model, table = mixtures.held_out(split, ["a", "b"], F.col("is_test"), range(1, 4), 2)
    assert model["k"] == 2 and [r.k for r in table.collect() if r.chosen] == [2]
    labels = [r.cluster for r in mixtures.scored(rows, model, ["a", "b"]).orderBy(F.col("key").cast("int")).collect()]
    assert len(set(labels[:400])) == len(set(labels[400:])) == 1 and labels[0] != labels[-1]
    one = mixtures.scored(rows.limit(1), {"w": [1.0], "mu": [[0.0, 0.0]], "cov": [[[1.0, 0.0], [0.0, 1.0]]]}, ["a", "b"]).first()
    close(one.ll, -math.log(2 * math.pi) - (one.a**2 + one.b**2) / 2)


# -- definitions, worked out by hand


def test_segments_by_hand(spark):
    """z is the probit of every close, not a standardised move; the run is broken by a gap of over 3 days and by leaving the rectangle."""
    days = [0, 1, 2, 3, 7, 8, 9, 10]
    rows = spark.createDataFrame([("a", float(d), 0.4 if d != 9 else 0.9, 1.0, 10.0) for d in days], "key string, ts_days double, close double, final double, t_res double")
    got = panel.segments(rows, 0.3, 0.85, 1.0, least=2).orderBy("run", "pos").collect()
    assert [(r.pos, r.dt, r.taup) for r in got] == [(0, None, None), (1, 1.0, 10.0), (2, 1.0, 9.0), (3, 1.0, 8.0), (0, None, None), (1, 1.0, 3.0)]
    close(got[0].z, spark.range(1).select(probit(F.lit(0.4))).first()[0])


def test_power_bins_by_hand(spark):
    """Six even bins of log tau up to log(max + 1): with tau from 1 to 63 the edges are 1, 2, 4, ... 64."""
    rows = spark.createDataFrame([(0.5, 0.01, 1.0, float(t)) for t in (1, 2, 3, 4, 7, 8, 16, 33, 63) for _ in range(2)], "p double, dp2 double, dt double, tau double")
    got = {r.ti: r.n for r in variance.power_cells(rows, least=1).collect()}
    assert got == {0: 2, 1: 4, 2: 4, 3: 2, 4: 2, 5: 4}


def test_map_ratio_by_hand(spark):
    """Mean squared move a day over c pq**gamma / tau**alpha at the cell's means."""
    rows = [("k", float(d), 0.5, 0.1 if d % 2 else -0.1, 0.01, 1.0, 8.0) for d in range(4)]
    moves = panel.standardised(spark.createDataFrame(rows, "key string, ts_days double, p double, dp double, dp2 double, dt double, tau double").withColumn("v_gauss", F.lit(0.01)))
    fit = spark.createDataFrame([(2.0, 1.0, 0.5)], "c double, gamma double, alpha double")
    got = regimes.map_cells(moves, fit, least=1, pairs=1).first()
    close(got.ratio_fit, 0.01 / (2.0 * 0.25 / math.sqrt(8)))
    assert got.regime == 1 and got.jump_share == 0.0 and got.budget_share == 1.0


def test_paired_power_by_hand(spark):
    """Rows that start at a level under 1e-6 don't enter the quantiles."""
    rows = [(1, d, 0.0 if d < 3 else 0.1 * (d % 5 + 1), 0.5) for d in range(12)]
    got = venues.paired_power(spark.createDataFrame(rows, "pair_id long, ts long, p_k double, p_pm double"), "p_k").first()
    assert got.n_obs == 8


def test_intraday_jumps_by_hand(spark):
    """1 - pi / 2 * sum |m1 m2| / sum m1**2 over moves whose successor is an hour on."""
    rows = [("k", t, m, m, 0.5, n, n, n is not None) for t, (m, n) in enumerate([(0.1, -0.2), (-0.2, 0.3), (0.3, None)])]
    got = markets.intraday(spark.createDataFrame(rows, "key string, ts int, dp double, dm double, p_prev double, dp_next double, dm_next double, ok_next boolean")).filter("bucket = -1").first()
    close(got.jump_share_mid, 1 - math.pi / 2 * (0.02 + 0.06) / (0.01 + 0.04))


def test_fingerprints_by_hand(spark):
    closes = [0.5, 0.6, 0.6, 0.4]
    table = spark.createDataFrame([("a", float(d), p, 1.0, 3.0) for d, p in enumerate(closes)], "key string, ts_days double, close double, final double, t_res double")
    r = markets.fingerprints(panel.raw_panel(table), table).first()
    close(r.still, 1 / 3), close(r.p_range, 0.1), close(r.log_tres, math.log(3)), close(r.log_mdt, math.log(1 + 1e-12))
    close(r.f1, 0.01 / 0.05, 1e-6), close(r.f2, 0.0), close(r.f4, 0.04 / 0.05, 1e-6)
    close(r.lump, math.log((0.04 + 1e-12) / (0.05 / 3 + 1e-12)), 1e-9), close(r.spend_lr, math.log((0.05 + 1e-12) / (0.25 + 1e-12)), 1e-9)
    assert r.ar1 == 0.0 and "terminal" not in r.asDict() and set(markets.CLUSTER_FEATURES + markets.DESCRIPTIONS) <= set(r.asDict())


def test_bootstrap_is_as_wide_as_resampling(spark):
    rng = np.random.default_rng(1)
    a = rng.exponential(size=(8, 300, 2))
    rows = [(c, float(a[c, i, 0]), float(a[c, i, 1]), i) for c in range(8) for i in range(300)]
    got = variance.bootstrap(spark.createDataFrame(rows, "cell int, num double, den double, ord long"), ["cell"]).collect()
    widths = []
    for c in range(8):
        q = a[c][rng.integers(0, 300, (1000, 300))].sum(1)
        widths.append(np.diff(np.quantile(q[:, 0] / q[:, 1], [0.025, 0.975]))[0])
    assert abs(np.mean([r.ci_hi - r.ci_lo for r in got]) / np.mean(widths) - 1) < 0.1


def test_legacy_bars_and_sinks(spark, tmp_path):
    for venue, key, extra in (("v1", "a", "close"), ("v2", "b", "bid")):
        spark.sql(f"SELECT timestamp '2024-01-01' ts, 0.5D {extra}").coalesce(1).write.parquet(str(tmp_path / "raw" / key))
        part = next((tmp_path / "raw" / key).glob("*.parquet"))
        (tmp_path / "bars" / venue / "60m").mkdir(parents=True)
        part.rename(tmp_path / "bars" / venue / "60m" / f"{key}.parquet")
    got = sorted((r.venue, r.freq, r.key, r.close, r.bid) for r in store.legacy_bars(spark, str(tmp_path / "bars")).collect())
    assert got == [("v1", "60m", "a", 0.5, None), ("v2", "60m", "b", None, 0.5)]
    store.write_results({"x": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out/x")).count() == 3


@pytest.mark.parametrize("form", ["brackets", "ladder"])
def test_strips_by_hand(spark, form):
    if form == "brackets":
        rows = [("between", 1.0, 2.0, 0.3), ("between", 2.0, 3.0, 0.4), ("between", 3.0, 4.0, 0.1), ("greater", 4.0, None, 0.1), ("less", None, 1.0, 0.05)]
        wanted = {(0.0, 1.0, 0.05), (1.0, 2.0, 0.3), (2.0, 3.0, 0.4), (3.0, 4.0, 0.1), (4.0, 5.0, 0.1)}
    else:
        rows = [("greater", float(k), None, p) for k, p in enumerate((0.9, 0.95, 0.5, 0.5, 0.2))]
        wanted = {(-1.0, 0.0, 0.1), (0.0, 1.0, 0.0), (1.0, 2.0, 0.4), (2.0, 3.0, 0.0), (3.0, 4.0, 0.3), (4.0, 5.0, 0.2)}
    table = spark.createDataFrame([("e", 1, *r) for r in rows], "event string, ts int, strike_type string, fs double, cs double, close double")
    assert {(r.lo, r.hi, round(r.prob, 9)) for r in markets.strip_bins(table).collect()} == wanted
