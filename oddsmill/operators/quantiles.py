"""Exact quantiles by counting: no task and no driver holds the different values, as those of percentile() do."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Intervals that a round cuts each span into, and how many values are few enough to be fetched in the last one.
BINS, FEW = 4096, 1 << 16


@dataclass(frozen=True)
class Span:
    """The values of a column from lo to hi, both of which occur: `n` of them, after `before` smaller ones."""

    column: int
    lo: float
    hi: float
    before: int
    n: int

    def holds(self, rank: int) -> bool:
        return self.before <= rank < self.before + self.n


def _cut(rows: DataFrame, spans: list[Span], bins: int) -> list[Span]:
    """Each span's parts that hold values, in one job. Halves, so that no difference overflows."""
    part, which = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, s in enumerate(spans):
        inside = (F.col("column") == s.column) & F.col("x").between(s.lo, s.hi)
        lo, wide = s.lo / 2, s.hi / 2 - s.lo / 2
        at = F.least(F.floor((F.col("x") / 2 - lo) / wide * bins), F.lit(bins - 1)) if wide > 0 else F.when(F.col("x") > s.lo, 1).otherwise(0)
        part, which = F.when(inside, at).otherwise(part), F.when(inside, i).otherwise(which)
    got = rows.select(which.alias("i"), part.alias("part"), "x").filter("i is not null").groupBy("i", "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    out, before = [], [s.before for s in spans]
    for r in sorted(got.collect(), key=lambda r: (r.i, r.part)):  # at most `bins` rows a span
        out.append(Span(spans[r.i].column, r.lo, r.hi, before[r.i], r.n))
        before[r.i] += r.n
    return out


def exact(df: DataFrame, wanted: dict[str, list[float]], bins: int = BINS, few: int = FEW) -> dict[str, list[float | None]]:
    """The quantiles of numeric columns over all rows, equal to those of percentile(): interpolated between neighbours.

    Every round counts the values by interval of the spans in which wanted ranks still lie, for all columns in one job,
    with sums combined before the shuffle, and keeps the intervals that hold the ranks; most distributions take two.
    Nulls don't count, NaN is above infinity, a column without values gives null. The columns are kept on the executors'
    disks meanwhile and computed again where an executor is lost.
    """
    names = list(wanted)
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(names))))
    rows = df.select(values.alias("v")).select("v.column", (F.col("v.x") + F.lit(0.0)).alias("x")).filter("x is not null").persist(StorageLevel.DISK_ONLY)
    try:
        real = F.when(~F.isnan("x") & (F.abs("x") != math.inf), F.col("x"))
        ends = rows.groupBy("column").agg(
            F.sum((F.col("x") == -math.inf).cast("long")).alias("low"), F.count(real).alias("n"), F.min(real).alias("lo"), F.max(real).alias("hi"),
            F.sum((F.col("x") == math.inf).cast("long")).alias("high"), F.sum(F.isnan("x").cast("long")).alias("none"),
        )
        spans: dict[int, list[Span]] = {}
        totals = dict.fromkeys(range(len(names)), 0)
        for r in ends.collect():  # a row a column
            totals[r.column] = r.low + r.n + r.high + r.none
            found = [(-math.inf, -math.inf, r.low), (r.lo, r.hi, r.n), (math.inf, math.inf, r.high), (math.nan, math.nan, r.none)]
            spans[r.column] = [Span(r.column, lo, hi, sum(x[2] for x in found[:k]), n) for k, (lo, hi, n) in enumerate(found) if n]
        ranks = {(i, k) for i, c in enumerate(names) if totals[i] for p in wanted[c] for k in (math.floor((totals[i] - 1) * p), math.ceil((totals[i] - 1) * p))}
        found = {(i, k): next(s for s in spans[i] if s.holds(k)) for i, k in ranks}
        while wide := list(dict.fromkeys(s for s in found.values() if s.lo < s.hi)):
            if sum(s.n for s in wide) <= few:
                pick = F.lit(False)
                for s in wide:
                    pick = pick | ((F.col("column") == s.column) & F.col("x").between(s.lo, s.hi))
                runs: dict[int, list] = {}
                for r in sorted(rows.filter(pick).groupBy("column", "x").count().collect()):
                    runs.setdefault(r.column, []).append(r)
                parts = []
                for s in wide:
                    before = s.before
                    for r in (r for r in runs[s.column] if s.lo <= r.x <= s.hi):
                        parts.append(Span(s.column, r.x, r.x, before, r["count"]))
                        before += r["count"]
            else:
                parts = _cut(rows, wide, bins)
            found = {(i, k): next(t for t in parts if t.column == i and t.holds(k)) if s.lo < s.hi else s for (i, k), s in found.items()}
    finally:
        rows.unpersist()

    def one(i: int, p: float) -> float | None:
        if not totals[i]:
            return None
        at = (totals[i] - 1) * p
        lo, hi = math.floor(at), math.ceil(at)
        a, b = found[i, lo].lo, found[i, hi].lo
        return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b

    return {c: [one(i, p) for p in wanted[c]] for i, c in enumerate(names)}
