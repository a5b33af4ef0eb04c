"""Mixtures of normals with full covariances over market features.

All mixtures, every number of components and every start, are fitted together: seeds by k-means||, then steps of EM of
which each is one aggregation of sufficient statistics over the rows. Each mixture's first steps see some of the rows, in
a task of its own, so that few are left over all rows. Densities of a given mixture are Column expressions.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of k-means||, and candidates drawn a round for each component.
ROUNDS, OVERSAMPLE = 4, 2
#: Share of a row that each of the other components gets in the first step.
SMOOTH = 1e-3
#: Rows that a mixture's first steps see.
FIRST = 4096


def log_densities(x: np.ndarray, model: dict) -> np.ndarray:
    """Logarithm of weight and density of each component (columns) at each row of x; covariances are made positive by growing multiples of the unit matrix."""
    out = np.empty((len(x), len(model["w"])))
    for j, (w, mu, cov) in enumerate(zip(model["w"], model["mu"], model["cov"], strict=True)):
        cov, d = np.array(cov), x.shape[1]
        more = 1e-8 * max(np.trace(cov) / d, 1e-12)
        for _ in range(8):
            try:
                low = np.linalg.cholesky(cov + more * np.eye(d))
                break
            except np.linalg.LinAlgError:
                more *= 100
        else:
            raise np.linalg.LinAlgError("no positive covariance")
        far = np.linalg.solve(low, (x - np.array(mu)).T)
        out[:, j] = math.log(w) - 0.5 * (d * math.log(2 * math.pi) + (far * far).sum(axis=0)) - np.log(np.diag(low)).sum()
    return out


def rows_summed(features: DataFrame, columns: list[str], work) -> dict[int, np.ndarray]:
    """Sums over all rows of what `work` gives for a matrix of them, arrays by number; summed in the tasks, then by number and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for k, v in work(pdf[columns].to_numpy(float)).items():
                    sums[k] = sums[k] + v if k in sums else v
        yield pd.DataFrame([(k, TaskContext.get().partitionId(), v.tobytes()) for k, v in sums.items()], columns=["k", "t", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["k"].iloc[0], sum(np.frombuffer(v) for v in pdf.sort_values("t")["v"]).tobytes())], columns=["k", "v"])

    parts = features.select(*columns).mapInPandas(run, "k int, t int, v binary").repartition(features.sparkSession.sparkContext.defaultParallelism, "k")
    return {r.k: np.frombuffer(r.v).copy() for r in parts.groupBy("k").applyInPandas(add, "k int, v binary").collect()}  # a row an array


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)


def seeds(features: DataFrame, columns: list[str], most: int, starts: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate centres of each start and their weights, by k-means|| (Bahmani et al. 2012): draws by hash, in proportion to squared distance.

    The candidates, some ROUNDS * OVERSAMPLE * most for a start, are what the driver holds.
    """
    x = F.array(*columns)
    u = lambda s, r: (F.pmod(F.xxhash64(*columns, F.lit(f"{seed}:{s}:{r}")), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    first = features.select(*(F.min_by(x, F.struct(u(s, "first"), x)).alias(f"x{s}") for s in range(starts))).first()
    found = [np.array([first[f"x{s}"]], float) for s in range(starts)]
    for r in range(ROUNDS):
        near = lambda x, s, found=tuple(found): distances(x, found[s]).min(axis=1)
        sums = rows_summed(features, columns, lambda x, near=near: {s: np.array([near(x, s).sum()]) for s in range(starts)})
        total = [float(sums[s][0]) for s in range(starts)]

        def draw(batches: Iterator[pd.DataFrame], near=near, total=total) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[columns].to_numpy(float)
                for s in range(starts):
                    own = np.flatnonzero(pdf[f"u{s}"].to_numpy() * total[s] < OVERSAMPLE * most * near(x, s)) if len(x) else ()
                    if len(own):
                        yield pd.DataFrame({"s": [s] * len(own), "x": [x[k].tolist() for k in own]})

        rows = features.select(*columns, *(u(s, r).alias(f"u{s}") for s in range(starts)))
        for row in rows.mapInPandas(draw, "s int, x array<double>").distinct().orderBy("s", "x").collect():
            found[row.s] = np.vstack([found[row.s], row.x])
    counts = rows_summed(features, columns, lambda x: {s: np.bincount(distances(x, c).argmin(axis=1), minlength=len(c)).astype(float) for s, c in enumerate(found)})
    return [(c, counts[s]) for s, c in enumerate(found)]


def chosen_centres(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates, by k-means++."""
    out = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    while len(out) < k:
        d = weights * distances(candidates, np.array(out)).min(axis=1)
        out.append(candidates[rng.choice(len(candidates), p=d / d.sum())] if d.sum() > 0 else out[0])
    return np.array(out)


def sufficient(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Weights, sums and products of rows by their shares in each component, one after another."""
    products = np.stack([(x * own[:, None]).T @ x for own in share.T])
    return np.concatenate([share.sum(axis=0), (share.T @ x).ravel(), products.ravel()])


def expected_under(x: np.ndarray, models: dict[int, dict]) -> dict[int, np.ndarray]:
    """Log-likelihood of the rows under each mixture, and what its next one is made from."""
    out = {}
    for i, m in models.items():
        logs = log_densities(x, m)
        top = logs.max(axis=1, keepdims=True)
        own = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
        out[i] = np.concatenate([[own.sum()], sufficient(x, np.exp(logs - own))])
    return out


def maximised(sums: np.ndarray, k: int, d: int, n: int) -> dict:
    own = sums[:k] + 1e-10
    mu = sums[k : k + k * d].reshape(k, d) / own[:, None]
    cov = sums[k + k * d :].reshape(k, d, d) / own[:, None, None] - mu[:, :, None] * mu[:, None, :]
    return {"k": k, "w": (own / n).tolist(), "mu": mu.tolist(), "cov": cov.tolist()}


def fit_all(features: DataFrame, columns: list[str], ks=range(1, 9), starts: int = 4, seed: int = 7, most: int = 300, tol: float = 1e-7) -> dict[int, dict]:
    """The likeliest of `starts` mixtures for each number of components: weights, means, covariances, ll (summed), n, bic.

    A step is one aggregation for all mixtures that have not settled (a gain under tol a row after ten steps); the driver
    holds their parameters. Rows with equal values count as often as they occur. None without rows.
    """
    rows, d = features.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna(), len(columns)
    rows = rows.repartition(2 * features.sparkSession.sparkContext.defaultParallelism, *columns).sortWithinPartitions(*columns).withColumn("_i", F.monotonically_increasing_id()).persist()  # a step has these tasks
    n = rows.count()
    if not n:
        rows.unpersist()
        return {}
    found, ks = seeds(rows, columns, max(ks), starts, seed), list(ks)
    names = [(k, s) for k in ks for s in range(starts if k > 1 else 1)]
    centres = {i: chosen_centres(*found[s], k, np.random.default_rng([seed, k, s])) for i, (k, s) in enumerate(names)}

    def first(x: np.ndarray, some=None) -> dict[int, np.ndarray]:
        out = {}
        for i in centres if some is None else some:
            share = np.full((len(x), len(centres[i])), SMOOTH)
            share[np.arange(len(x)), distances(x, centres[i]).argmin(axis=1)] = 1.0
            out[i] = sufficient(x, share / share.sum(axis=1, keepdims=True))
        return out

    def own_steps(pdf: pd.DataFrame) -> pd.DataFrame:
        """A mixture's steps over some rows; none where they are too few for it."""
        i, x = int(pdf["i"].iloc[0]), pdf.sort_values("_i")[columns].to_numpy(float)
        k, last = names[i][0], -math.inf
        try:
            model = maximised(first(x, [i])[i], k, d, len(x))
            for step in range(most):
                v = expected_under(x, {i: model})[i]
                if not np.isfinite(v).all():
                    raise FloatingPointError
                if step > 10 and v[0] - last < tol * len(x):
                    break
                last, model = v[0], maximised(v[1:], k, d, len(x))
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            return pd.DataFrame(columns=["i", "v", "n"])
        return pd.DataFrame([(i, v[1:].tobytes(), len(x))], columns=["i", "v", "n"])

    u = F.pmod(F.xxhash64("_i", F.lit(f"{seed}:few")), F.lit(1 << 30)) / float(1 << 30)
    few = rows.filter(u * n < FIRST).withColumn("i", F.explode(F.lit(list(range(len(names))))))  # FIRST rows or so a mixture
    nearer = few.repartition(len(names), "i").groupBy("i").applyInPandas(own_steps, "i int, v binary, n long").collect()  # a row a mixture
    models = {r.i: maximised(np.frombuffer(r.v), names[r.i][0], d, r.n) for r in nearer}
    if missing := [i for i in centres if i not in models]:
        models |= {i: maximised(v, names[i][0], d, n) for i, v in rows_summed(rows, columns, lambda x: first(x, missing)).items()}
    last, live = dict.fromkeys(models, -math.inf), set(models)
    for step in range(most):
        now = {i: models[i] for i in sorted(live)}

        for i, v in rows_summed(rows, columns, lambda x, now=now: expected_under(x, now)).items():
            models[i]["ll"] = float(v[0])
            if step > 10 and v[0] - last[i] < tol * n or step == most - 1:
                live.discard(i)
            else:
                last[i] = v[0]
                models[i] = maximised(v[1:], names[i][0], d, n) | {"ll": float(v[0])}
        if not live:
            break
    rows.unpersist()
    out: dict[int, dict] = {}
    for i, (k, _) in enumerate(names):
        if k not in out or models[i]["ll"] > out[k]["ll"]:
            free = (k - 1) + k * d + k * d * (d + 1) // 2
            out[k] = models[i] | {"n": n, "bic": -2 * models[i]["ll"] + free * math.log(max(n, 1))}
    return out


def densities(model: dict, columns: list[str]) -> list[Column]:
    """Logarithm of weight and density of each component."""
    out = []
    for w, mu, cov in zip(model["w"], model["mu"], model["cov"], strict=True):
        inverse, (_, det) = np.linalg.inv(np.array(cov)), np.linalg.slogdet(np.array(cov))
        off = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mu, strict=True)]
        form = sum((F.lit(float(inverse[i, j])) * off[i] * off[j] for i in range(len(off)) for j in range(len(off))), F.lit(0.0))
        out.append(F.lit(math.log(w) - 0.5 * (len(off) * math.log(2 * math.pi) + float(det))) - 0.5 * form)
    return out


def scored(features: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """features with ll, the logarithm of the mixture's density (by the largest term, which cannot overflow), and cluster, the likeliest component (the first of equal ones)."""
    rows = features.withColumn("_d", F.array(*densities(model, columns))).withColumn("_m", F.array_max("_d"))
    ll = F.col("_m") + F.log(F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m"))))
    return rows.withColumn("ll", ll).withColumn("cluster", (F.array_position("_d", F.col("_m")) - 1).cast("int")).drop("_d", "_m")


def select(table: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """table (k, heldout_ll, ...) with chosen: the smallest k whose held-out score is within a tolerance of the best."""
    best = table.agg(F.max("heldout_ll").alias("_best"))
    rows = table.join(F.broadcast(best))  # one row
    fair = F.when(F.col("heldout_ll") >= F.col("_best") - tolerance, F.col("k"))
    least = rows.agg(F.min(fair).alias("_k"))
    return rows.join(F.broadcast(least)).withColumn("chosen", F.col("k") == F.col("_k")).drop("_best", "_k")


def held_out(features: DataFrame, columns: list[str], is_test: Column, ks=range(1, 9), starts: int = 4, seed: int = 7) -> tuple[dict, DataFrame]:
    """The chosen mixture, and (k, train_ll, heldout_ll, bic, chosen): fits on the rows that are no test, scores a row on those that are, all mixtures in one job."""
    spark, models = features.sparkSession, fit_all(features.filter(~is_test), columns, ks, starts, seed)
    test = features.filter(is_test)

    def scored_rows(x: np.ndarray) -> dict[int, np.ndarray]:
        return {k: np.array([len(x), np.logaddexp.reduce(log_densities(x, m), axis=1).sum()]) for k, m in models.items()}

    sums = rows_summed(test.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna(), columns, scored_rows)
    rows = [(k, m["ll"] / m["n"], float(sums[k][1] / sums[k][0]) if k in sums else None, m["bic"]) for k, m in models.items()]
    table = select(spark.createDataFrame(rows, "k int, train_ll double, heldout_ll double, bic double"))
    best = table.filter("chosen").first()
    return models[best.k] if best else {}, table
