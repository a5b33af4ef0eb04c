"""State fits search by derivatives that come with the likelihood."""
import numpy as np
import pytest

from oddsmill.operators import forecasts, search, states


def ticks(n: int, steps: int, seed: int = 0) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        level, x, z = 0.0, np.zeros(steps), [0.0]
        for j in range(1, steps):
            level = 0.8 * level + rng.normal(0, 0.5)
            x[j] = x[j - 1] + rng.normal(0, 0.3) * np.exp(level / 2)
            z.append(float(np.round(x[j], 1)) if rng.random() > 0.4 else z[-1])
        rows += [(f"k{i}", 0, j, v, 1.0 if j else None, float(steps - j + 1) if j else None, v - 0.05, v + 0.05, bool(j and z[j - 1] == v)) for j, v in enumerate(z)]
    return rows


SCHEMA = "key string, run long, pos int, z double, dt double, taup double, zlo double, zhi double, isz boolean"


@pytest.mark.parametrize("theta", [{"phi": 0.7, "s": 0.8, "pi0": 0.2}, {"phi": 0.7, "s": 0.8, "pi0": 0.0}, {"phi": -0.4, "s": 1.2}, {"phi": 0.0, "s": 1e-8}])
def test_slopes_are_those_of_the_likelihood(spark, theta):
    theta = {"c": 0.3, "alpha": 0.6, "eta": 0.08, **theta}
    parts = states.batches(spark.createDataFrame(ticks(9, 12), SCHEMA).toPandas(), "pi0" in theta)
    names = [c for c in (states.INFLATED if "pi0" in theta else states.PLAIN) if not (c in ("phi", "s") and theta["s"] < 1e-6)]
    ll, slope, n = states.slopes(theta, names, parts)
    assert n == 9 * 11 and abs(ll - states.filtered(theta, parts)[0]) < 1e-9
    for c, got in zip(names, slope, strict=True):
        low, high = (states.filtered({**theta, c: theta[c] + h}, parts)[0] for h in (-1e-5, 1e-5))
        assert abs(got - (high - low) / 2e-5) < 1e-4 * (1 + abs(got))


def test_a_small_part_needs_no_rounds_and_a_large_one_ends_there_too(spark, monkeypatch):
    """points of a round were twenty a search, and rounds were needed whatever the part's size."""
    segs = spark.createDataFrame(ticks(60, 40), SCHEMA)
    rounds, asked = states.sloped_likelihoods, []
    monkeypatch.setattr(states, "sloped_likelihoods", lambda rows, thetas: asked.append(thetas) or rounds(rows, thetas))
    whole = states.fits(segs, ["zi"], 200).first()
    assert not asked and whole.converged and whole.n == 60 * 39
    monkeypatch.setattr(states, "FIRST", 600)
    part = states.fits(segs, ["zi"], 200).first()
    assert 0 < len(asked) < 60 and part.converged and part.n == whole.n and abs(part.ll_per_obs - whole.ll_per_obs) < 1e-5


def test_search_by_gradients():
    valley = lambda u: ((1 - u[0]) ** 2 + 100 * (u[1] - u[0] ** 2) ** 2, np.array([-2 * (1 - u[0]) - 400 * u[0] * (u[1] - u[0] ** 2), 200 * (u[1] - u[0] ** 2)]))
    steep = lambda u: (float(np.exp(u[0]) - 2 * u[0]), np.array([np.exp(u[0]) - 2]))
    lost = lambda u: (np.inf, np.zeros(1))
    f = {"valley": valley, "steep": steep, "lost": lost}
    searches = {"valley": search.Sloped(np.array([-1.2, 1.0]), 1e-6, 1e-12), "steep": search.Sloped(np.array([6.0])), "lost": search.Sloped(np.array([1.0]))}
    rounds = search.run_all(searches, lambda asked: {k: [f[k](u) for u in points] for k, points in asked.items()}, 200)
    assert rounds < 100 and all(s.converged for s in searches.values())
    assert np.abs(searches["valley"].x - 1).max() < 1e-3 and abs(searches["steep"].x[0] - np.log(2)) < 1e-4


def test_garch_slopes_are_those_of_the_likelihood(spark):
    rng = np.random.default_rng(2)
    size = np.array([9, 9, 6, 3])
    x = np.where(np.arange(9)[None, :] < size[:, None], rng.random((4, 9)) * 1e-3, np.nan)
    u = np.array([-8.0, -1.0, 0.5])
    ll, slope = forecasts.garch_slopes(u, x)
    for k, got in enumerate(slope):
        high, low = (forecasts.garch_slopes(u + h * np.eye(3)[k], x)[0] for h in (1e-5, -1e-5))
        assert abs(got - (high - low) / 2e-5) < 1e-4 * (1 + abs(got))
    series = spark.createDataFrame([([float(v) for v in row[:n]],) for row, n in zip(x, size, strict=True)], "x array<double>")
    known = forecasts.garch_likelihoods(series, [forecasts.garch_parameters(u)], []).first()
    assert known.n == size.sum() and abs(known.ll - ll) < 1e-9


def test_steps_grow_where_a_parameter_has_no_least_point():
    """a search that gained a little for ever ended after all of its rounds."""
    flat = lambda u: (1e3 / (1e4 + u[0]) if u[0] > 0 else 0.1 - u[0], np.array([-1e3 / (1e4 + u[0]) ** 2 if u[0] > 0 else -1.0]))
    s = search.Sloped(np.array([1.0]), 1e-12, 1e-6, np.array([[1e9]]))
    assert search.run_all({0: s}, lambda asked: {0: [flat(asked[0][0])]}, 200) < 60 and s.converged and s.value < 0.05
