"""Source divergence, language-model scores and whitening against brute force, with nulls, ties, repeats and clashing columns."""
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from oddsmill.llm import divergence, katz, queries, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# -- op11


def brute_audit(rows, least, top):
    """(lang, source, part, item, value, rank) by definition, in whole numbers."""
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))) for lang, source, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(w for _, _, c in own for w in c)
        kept = sorted(w for w, n in held.items() if n >= least)
        counts = defaultdict(Counter)
        for _, s, c in own:
            counts[s].update({w: n for w, n in c.items() if w in set(kept)})
            counts[s] += Counter()
        p = lambda c: {w: 1 + 1000000000 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        shares, whole = {s: p(c) for s, c in counts.items()}, p(sum(counts.values(), Counter()))
        for s in counts:
            far = [(o, sum(abs(shares[s][w] - shares[o][w]) for w in kept)) for o in counts if o != s]
            more = [(w, shares[s][w] - whole[w]) for w in kept if counts[s][w] and shares[s][w] > whole[w]]
            for part, found in (("pair", far), ("term", more)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, w, v, k) for k, (w, v) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def sources(seed=1, n=80):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "Beta", "été", "ÉTÉ", "x1y", "don't", "日本", "zz", "q"]
    rows = [("en", None, None), (None, None, "alone here"), ("fr", "only", "seul seul"), ("en", "empty", ""), ("de", "a", "eins"), ("de", "b", "zwei"), ("en", "a", "zz " * 3000)]
    for _ in range(n):
        rows.append((("en", "fr")[int(rng.integers(4) == 0)], ["a", "b", "c", None][rng.integers(4)], "\n ".join(rng.choice(vocabulary, rng.integers(0, 12)))))
    return rows + rows[20:26]


@pytest.mark.parametrize(("parts", "step_bytes"), [(1, 1 << 23), (5, 1), (3, 100)])
def test_divergence(spark, monkeypatch, parts, step_bytes):
    rows = sources()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(parts)
    got = divergence.audit(docs, least=4, top=3, step_bytes=step_bytes).collect()
    assert sorted(map(tuple, got)) == brute_audit(rows, 4, 3)
    assert ("de", "a", "pair", "b", 0, 1) in {tuple(r) for r in got}


def test_divergence_of_nothing(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(none).count() == 0


def test_partial_distances_do_not_depend_on_what_a_task_holds(monkeypatch):
    """More sources than a task may hold distances of: rows by matrix, with the same sums."""
    rng = np.random.default_rng(2)
    every = [f"s{k}" for k in range(7)]
    rows = [("en", f"t{k}", (own := sorted(rng.choice(every, 3, replace=False))), rng.integers(1, 9, 3).tolist(), every, [100 + k for k in range(7)], 40) for k in range(40)]
    names = ["lang", "term", "sources", "counts", "every", "totals", "v"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(7)], names=names)

    def sums():
        out = Counter()
        for b in divergence.pairs(iter([batch.slice(0, 15), batch.slice(15)])):
            for x in b.to_pylist():
                out[x["source"], x["item"]] += x["value"]
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "DENSE", 20)
    assert sums() == whole and len(whole) == 42


def test_shares_are_exact():
    n = np.array([0, 5, 10**9, 9 * 10**12], np.int64)
    total = np.array([7, 8, 3 * 10**9 + 1, 8 * 10**15], np.int64)
    assert divergence.share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]


# -- op12


def brute_katz(texts, k=5):
    """Scores by definition: texts is a list of (held, tokens); also the probabilities of every word after every context."""
    one, two = Counter(), Counter()
    for held, w in texts:
        if not held:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n = sum(one.values())

    def factors(c):
        having = Counter(c.values())
        f = [having[r] for r in range(1, k + 2)]
        turing = lambda f: [((r + 1) * f[r] / f[r - 1] / r - (a := (k + 1) * f[k] / f[0])) / (1 - a) for r in range(1, k + 1)]
        fine = lambda d: all(0 < x < 1 for x in d)
        d = turing(f) if all(f) else [2.0]
        if not fine(d) and sum(x > 0 for x in f) > 1:
            xy = [(math.log(r), math.log(x)) for r, x in enumerate(f, 1) if x]
            mx, my = (sum(v) / len(xy) for v in zip(*xy, strict=True))
            slope = sum((x - mx) * (y - my) for x, y in xy) / sum((x - mx) ** 2 for x, _ in xy)
            d = turing([r**slope for r in range(1, k + 2)]) if slope < -1 else [2.0]
        d = d if fine(d) else [(r - 0.5) / r for r in range(1, k + 1)]
        return lambda r: d[r - 1] if r <= k else 1.0

    d1, d2 = factors(one), factors(two)
    total = n + all(c > k for c in one.values())
    p1 = {w: d1(c) * c / total for w, c in one.items()}
    unknown = 1 - sum(p1.values()) if one else 1.0
    p2, weight = {}, {}
    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    for h, found in after.items():
        bottom = sum(found.values()) + all(c > k for c in found.values())
        p2[h] = {w: d2(c) * c / bottom for w, c in found.items()}
        weight[h] = (1 - sum(p2[h].values())) / (1 - sum(p1[w] for w in found))
    p = lambda h, w: p2.get(h, {}).get(w, weight.get(h, 1.0) * p1.get(w, unknown))
    for h in list(after)[:50]:
        assert abs(sum(p(h, w) for w in one) + weight[h] * unknown - 1) < 1e-9
    score = [sum(math.log10(p(h, w)) for h, w in zip([None, *t[:-1]], t, strict=True)) for _, t in texts]
    base = [sum(math.log10((one[w] + 0.1) / (n + 0.1 * (len(one) + 1))) for w in t) for _, t in texts]
    return [(held, len(t), sum(one[w] > 0 for w in t), b, s) for (held, t), b, s in zip(texts, base, score, strict=True)], n, p


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1.0, abs(b))


def written(seed=0, n=150, frequent=True):
    rng = np.random.default_rng(seed)
    words = ["the", "The", "a", "dog", "cat", "été", "日本", "x\x01y", *(f"rare{k}" for k in range(40))]
    weights = np.array([20, 5, 12, 6, 6, 3, 2, 1, *([0.3] * 40)])
    rows = [(0, None, False), (1, "", True), (None, "the end", False), (3, "the " * 5000, False), (4, "unheard words only", True), (5, "\t\n\x0b", False)]
    for i in range(n):
        rows.append((i % 100, " ".join(rng.choice(words, rng.integers(0, 20), p=weights / weights.sum())), bool(rng.integers(5) == 0)))
    return rows + rows[30:34] + [(7, "always same pair " * 9, False)]


@pytest.mark.parametrize(("parts", "options"), [(1, {}), (4, {"step_bytes": 1, "bucket": 50, "hot": 1}), (3, {"step_bytes": 300, "bucket": 500, "hot": 20})])
def test_katz(spark, parts, options):
    from pyspark.sql import functions as F

    rows = written()
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, out boolean, n int, step string").repartition(parts)
    wanted, n, p = brute_katz([(r[2], [*WORD.findall(lower(r[1])), ""]) for r in rows])
    model = katz.train(docs, F.col("out"), **options)
    assert model.one.tokens == n
    got = sorted((tuple(r) for r in model.scores().collect()), key=lambda r: (str(r[0]), r[1], r[2], r[3], r[5]))
    wanted = sorted(((r[0], *w) for r, w in zip(rows, wanted, strict=True)), key=lambda r: (str(r[0]), r[1], r[2], r[3], r[5]))
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted, strict=True):
        assert a[:4] == b[:4] and close(a[4], b[4]) and close(a[5], b[5])
    word = {r.id: r.word for r in model.vocabulary().collect()} | {katz.START: None}
    pairs = model.bigrams().collect()
    assert len({(r.h, r.w) for r in pairs}) == len(pairs) and all(close(10**r.log10_p, p(word[r.h], word[r.w])) for r in pairs)


def test_katz_in_pieces(spark):
    """Buckets of many pieces give the same texts the same scores, and a bucket's memory is that of its types and one piece."""
    import tracemalloc

    from pyspark.sql import functions as F

    docs = spark.createDataFrame(written(), "doc_id long, text string, out boolean").repartition(5)
    scores = [sorted(map(str, katz.train(docs, F.col("out"), step_bytes=40, bucket=500, **more).scores().collect())) for more in ({}, {"piece": 1}, {"piece": 200})]
    assert scores[0] == scores[1] == scores[2]

    rng, rows, n = np.random.default_rng(3), [], 0
    ids, counts = np.arange(3000) * 7, np.arange(3000, 0, -1)
    for step in range(40):
        codes = rng.integers(0, 60, 50_000)
        sizes = np.full(500, 100)
        ((_, blob),) = katz.pairs(codes, sizes, ids, counts, 1000, 1e9, 1)
        rows.append((step, katz.pack(rng.integers(0, 2, 500)), blob))
        n += len(codes)
    one = katz.Unigrams.of(n, 3000, [5, 4, 3, 2, 1, 1])
    tracemalloc.start()
    katz.table_row(0, rows, 1e9, one)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * n  # 55 bytes a token where all steps are sorted at once


def test_katz_without_training_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, katz.train(docs, F.lit(True)).scores().collect())) == [(1, True, 3, 0, 0.0, 0.0), (2, True, 1, 0, 0.0, 0.0)]
    assert katz.train(docs.limit(0), F.lit(False)).scores().count() == 0


def test_discounts():
    for having in ([100, 40, 20, 12, 8, 6], [5, 0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0], [10, 10, 10, 10, 10, 10], [9, 1, 8, 0, 0, 3]):
        d = katz.discounts(having)
        assert d[0] == 0 and d[-1] == 1 and ((d[1:-1] > 0) & (d[1:-1] < 1)).all()


def test_op12(spark):
    rows = queries.queries()["op12_katz_scores"](spark, SF)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    wanted, n, _ = brute_katz([(zlib.crc32(str(i).encode()) % 10 == 0, [*WORD.findall(lower(t)), ""]) for i, t in texts.items()])
    wanted = dict(zip(texts, wanted, strict=True))
    got = rows.collect()
    assert len(got) == len(texts)
    for r in got:
        own = wanted[r.doc_id]
        assert tuple(r)[1:5] == (*own[:3], n) and close(r.base_score, own[3]) and close(r.score, own[4])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # likelier than by the base


# -- op13


@pytest.mark.parametrize("n", [1, 2, 3, 17, 40])
def test_eigen(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a @ a.T, a + a.T, np.diag(np.arange(n, dtype=float)), np.eye(n), np.zeros((n, n)), np.ones((n, n)), np.outer(a[0], a[0])):
        e, q = whitening.eigen(m)
        size = max(1.0, np.abs(m).max()) * n
        assert np.abs(e - np.linalg.eigvalsh(m)[::-1]).max() < 1e-13 * size and np.abs(q.T @ q - np.eye(n)).max() < 1e-13 * n
        assert np.abs(q @ np.diag(e) @ q.T - m).max() < 1e-13 * size


def test_moments_merge():
    x = np.random.default_rng(0).normal(1e6, 1, (500, 4))
    parts = [whitening.Moments.empty(4) for _ in range(4)]
    for k, row in enumerate(x[:499]):
        parts[k % 3].add(row)
    parts[3].add(x[499])
    whole = whitening.Moments.empty(4)
    for p in parts:
        whole.merge(p)
    assert whole.n == 500 and np.allclose(whole.covariance(), np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


def brute_whitened(vectors, k=16):
    x = np.floor(64 * np.array(vectors)).astype(np.int64) + 1000000
    distinct = np.unique(x, axis=0)
    n, s = len(distinct), distinct.sum(axis=0)
    e, q = np.linalg.eigh(np.cov((distinct - 1000000).T.astype(float), bias=True).reshape(len(s), -1))
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x], (x - s / n) @ q / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(np.cov(distinct.T.astype(float), bias=True).reshape(len(s), -1))


def test_whitening(spark):
    rng = np.random.default_rng(5)
    good = (rng.normal(size=(90, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32).tolist()
    good += [good[3]] * 30
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (500, None), (501, [1.0, None] * 10), (502, [math.nan] * 20), (503, [math.inf] * 20), (504, []), (505, [1.0]), (506, [1.0])]
    docs = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<float>, x int, component string").repartition(5)
    got = whitening.whiten(docs).collect()
    n, deviation, w, share = brute_whitened([np.array(v, np.float32).astype(float) for v in [*good, good[0]]])
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == 121 * 16 and got[0].identity_error < 1e-12 and {r.n for r in got} == {n}
    for c in range(16):
        own = np.array([by[i, c + 1].whitened for i in [*range(120), None]])
        assert min(np.abs(own - w[:, c]).max(), np.abs(own + w[:, c]).max()) < 1e-8 and abs(by[0, c + 1].explained - share[c]) < 1e-9
    assert [by[i, 1].deviation for i in [*range(120), None]] == deviation


def test_whitening_of_few_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(make([(1, [0.0, 1.0, 2.0]), (2, [3.0, 1.0, 2.0]), (3, [3.0, 1.0, 2.0])])).collect()
    first = [r for r in got if r.component == 1]
    assert len(got) == 9 and all(r.whitened is None and r.explained == 0 for r in got if r.component > 1)
    assert sorted(abs(r.whitened) for r in first) == pytest.approx([1, 1, 1]) and {r.explained for r in first} == {1.0} and {r.deviation for r in first} == {192**2}
    (one,) = whitening.whiten(make([(1, [5.0])])).collect()
    assert (one.component, one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 1, 0, None, None, None)
    assert whitening.whiten(make([])).count() == whitening.whiten(make([(1, None)])).count() == 0
    far = whitening.whiten(make([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])).collect()
    assert len(far) == 6 and any(r.deviation is None for r in far)


def test_op13(spark):
    rows = queries.queries()["op13_whitening"](spark, SF)
    assert dict(rows.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    n, deviation, w, share = brute_whitened([np.array(v, np.float32).astype(float) for _, v in vectors])
    got = {(r.vec_id, r.component): r for r in rows.collect()}
    assert len(got) == 16 * len(vectors)
    for c in range(16):
        own = np.array([got[i, c + 1].whitened for i, _ in vectors])
        assert min(np.abs(own - w[:, c]).max(), np.abs(own + w[:, c]).max()) < 1e-8
    assert [got[i, 1].deviation for i, _ in vectors] == deviation and all(r.n == n and r.identity_error < 1e-10 for r in got.values())
