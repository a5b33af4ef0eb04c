"""Source divergence audit: how far the sources of a language are apart in their use of terms.

Tasks sort the terms of a step of texts by (lang, term, source, document) and scan the runs for document frequencies and
counts; what is left of a run, one row a source, is dealt by (lang, term), sorted by (lang, term, source) and scanned
once more, across the steps. Frequent terms meet in one task as a row a step and source, not as their occurrences. The
kept terms stay as a table of runs; a last scan emits partial distances of pairs of sources, and the terms that
stand out.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import lowered, materialise, slices

LEAST_DOCUMENTS, SMOOTH, UNIT, TERMS = 30, 5, 1_000_000_000, 50
#: Bytes of text sorted at a time, entries of a matrix of terms by sources, and of partial distances held by a task.
STEP_BYTES, DENSE, HELD = 1 << 23, 1 << 20, 1 << 22
#: Bytes that terms are made of: letters, and all bytes of characters outside ASCII.
IN_TERM = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def runs_of(b: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, term, source, docs, n) of a step: its terms sorted by lang, term, source and document, and scanned."""
    found, doc = lowered(b.column("t"), IN_TERM)
    code = found.dictionary_encode()
    lang, source = b.column("lang").dictionary_encode(), b.column("source").dictionary_encode()
    sides = (lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy())[doc]
    group = code.indices.to_numpy().astype(np.int64) * (len(lang.dictionary) * len(source.dictionary)) + sides
    order = np.argsort(group, kind="stable")  # documents ascend already
    group, doc = group[order], doc[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    own = new.copy()
    own[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    n, docs = np.diff(at, append=len(group)), np.add.reduceat(own.astype(np.int64), at) if len(at) else at
    rest = group[at] % (len(lang.dictionary) * len(source.dictionary))
    take = lambda a, k: a.dictionary.take(pa.array(k))
    return pa.RecordBatch.from_arrays([take(lang, rest // len(source.dictionary)), take(code, group[at] // (len(lang.dictionary) * len(source.dictionary))), take(source, rest % len(source.dictionary)), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=["lang", "term", "source", "docs", "n"])


RUNS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def changes(b: pa.RecordBatch, *columns: str) -> np.ndarray:
    """Whether each row differs from the one before in some of the columns."""
    new = np.zeros(b.num_rows, bool)
    for c in columns:
        new[1:] |= pc.not_equal(b.column(c)[1:], b.column(c)[:-1]).to_numpy(zero_copy_only=False)
    new[:1] = True
    return new


def scanned(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang, term and source: one a run of lang and term in `least` documents, (lang, term, sources, counts)."""

    def kept(b: pa.RecordBatch, run: np.ndarray) -> pa.RecordBatch:
        """b holds whole runs, which start where `run` is."""
        docs = np.add.reduceat(b.column("docs").to_numpy(), np.flatnonzero(run))
        on = (docs >= least)[np.cumsum(run) - 1]
        b, run = b.filter(pa.array(on)), run[on]
        part = run | changes(b, "source")
        at = np.flatnonzero(part)
        n = np.add.reduceat(b.column("n").to_numpy(), at) if len(at) else np.zeros(0, np.int64)
        first = np.flatnonzero(run)
        bounds = pa.array(np.append(np.flatnonzero(run[at]), len(at)), pa.int32())
        take = lambda c, k: b.column(c).take(pa.array(k))
        return pa.RecordBatch.from_arrays([take("lang", first), take("term", first), pa.ListArray.from_arrays(bounds, take("source", at)), pa.ListArray.from_arrays(bounds, pa.array(n))], schema=RUNS)

    open_ = None
    for b in batches:
        if not b.num_rows:
            continue
        if open_ is not None:
            b = pa.Table.from_batches([open_, b]).combine_chunks().to_batches()[0]
        run = changes(b, "lang", "term")
        last = int(np.flatnonzero(run)[-1])  # this run may go on
        if last:
            yield kept(b.slice(0, last), run[:last])
        open_ = b.slice(last)
    if open_ is not None:
        yield kept(open_, changes(open_, "lang", "term"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) in whole numbers, by long division in three digits of a thousand: exact for totals under 9e15."""
    q, r = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        r = r * 1000
        q, r = q * 1000 + r // total, r % total
    return 1 + q


class Dense:
    """Runs of one language as matrices of terms by all of the language's sources, DENSE entries at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        self.batches = batches

    def __iter__(self) -> Iterator[tuple[str, list[str], list[str], np.ndarray, np.ndarray, np.ndarray]]:
        """(lang, all sources, terms, counts, shares of the sources, shares of the language)."""
        now, group, names, rows = None, None, [], []
        for b in self.batches:
            for lang, term, sources, counts, every, totals, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if lang != now or (len(rows) + 1) * len(every) > DENSE:
                    if rows:
                        yield self.matrix(now, group, names, rows)
                    names, rows = [], []
                if lang != now:
                    now, group = lang, (every, {s: k for k, s in enumerate(every)}, np.array(totals, np.int64), v)
                names.append(term)
                rows.append(([group[1][s] for s in sources], counts))
        if rows:
            yield self.matrix(now, group, names, rows)

    @staticmethod
    def matrix(lang: str, group: tuple, names: list[str], rows: list) -> tuple:
        every, _, totals, v = group
        c = np.zeros((len(rows), len(every)), np.int64)
        for k, (at, n) in enumerate(rows):
            c[k, at] = n
        whole = share(c.sum(axis=1) + SMOOTH, totals.sum() + SMOOTH * v)
        return lang, every, names, c, share(c + SMOOTH, totals + SMOOTH * v), whole


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): partial distances, added up by language as long as a task holds HELD of them at most."""
    held: dict[str, tuple[list[str], np.ndarray]] = {}

    def rows(lang: str, every: list[str], a: int, total: np.ndarray) -> pa.RecordBatch:
        others = np.delete(np.arange(len(every)), a)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([every[a]] * len(others), pa.string()), pa.array(every, pa.string()).take(pa.array(others)), pa.array(total[others])], names=["lang", "source", "item", "value"])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (every, total) in held.items():
            yield from (rows(lang, every, a, x) for a, x in enumerate(total))
        held.clear()

    for lang, every, _, _, p, _ in Dense(batches):
        far = (np.abs(p - p[:, [a]]).sum(axis=0) for a in range(len(every)))
        if len(every) ** 2 > HELD:
            yield from (rows(lang, every, a, x) for a, x in enumerate(far))
            continue
        if lang not in held:
            if sum(x.size for _, x in held.values()) + len(every) ** 2 > HELD:
                yield from flush()
            held[lang] = every, np.zeros((len(every),) * 2, np.int64)
        for a, x in enumerate(far):
            held[lang][1][a] += x
    yield from flush()


def outstanding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): terms that a source uses, and more than its language does."""
    for lang, every, names, c, p, q in Dense(batches):
        term, source = np.nonzero((c > 0) & (p > q[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(term), pa.string()), pa.array(every, pa.string()).take(pa.array(source)), pa.array(names, pa.string()).take(pa.array(term)), pa.array(p[term, source] - q[term])], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TERMS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each source from the others of its language (part pair), and the terms in which it exceeds its language (part term, `top` at most).

    Every row is a document, repeated rows too. Null texts, languages and sources are empty; texts without terms count
    their group. A language without kept terms has pairs at distance 0, one with a single source has none. Equal values
    rank by item. An empty table gives an empty one; other columns are ignored.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(runs_of, slices(batches, "t", step_bytes))

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("t"))
    found = rows.mapInArrow(first, "lang string, term string, source string, docs long, n long")
    dealt = found.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = materialise(dealt.mapInArrow(lambda b: scanned(b, least), "lang string, term string, sources array<string>, counts array<long>"), "divergence-runs")
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("one")).join(totals, ["lang", "source"], "left")
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    langs = langs.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    langs = materialise(langs.select("lang", F.col("x.source").alias("every"), F.col("x.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v")), "divergence-langs")
    # A row a language, joined as its size allows.
    whole = kept.join(langs, "lang").select("lang", "term", "sources", "counts", "every", "totals", "v")
    out = "lang string, source string, item string, value long"
    none = langs.select("lang", F.explode("every").alias("source"), "every").select("lang", "source", F.explode("every").alias("item"), F.lit(0).cast("long").alias("value")).filter("source <> item")
    far = whole.mapInArrow(pairs, out).unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    far = far.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit("pair"))
    best = whole.mapInArrow(outstanding, out).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return far.unionByName(best).select("lang", "source", "part", "item", "value", "rank")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: every source of every language."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
