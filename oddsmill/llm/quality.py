"""Quality rules: an ordered list of threshold conjunctions learned from labels, applied as one Spark conditional expression.

Sequential covering: a rule for low quality is grown condition by condition by information gain on two thirds of the
rows, pruned on the other third, and kept if it is precise there; the rows that it covers go, and the next is learned.
Learning takes a bounded sample of labelled rows (`sample`); statistics and verdicts cover every row.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmill.llm.common import lean, schema_of, slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_lines", "n_distinct_words"]
#: What rules may test: shares of the counts, so that they hold for texts of any length.
RATIOS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_share": ("n_exclaim", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Rows that teach the rules at most; precision that a rule needs on the pruning rows, and low-quality rows that it covers there at least.
SAMPLE, PRECISION, COVER = 20_000, 0.95, 5
#: Conditions of a rule, rules of a list, thresholds tried for a feature.
CONDITIONS, RULES, CUTS = 4, 24, 64


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words in windows of `width` (a power of two) whose words occur in two windows or more."""
    if len(ids) <= width:
        return 0
    step = 1
    while step < width:  # ranks of windows of twice the width from pairs of ranks: exact
        ids = np.unique(ids[:-step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)[1]
        step *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(ids) + width, np.int64)
    edge[: len(ids)] += again
    edge[width:] -= again
    return int((np.cumsum(edge) > 0).sum())


def counted(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text."""
    t = text or ""
    words = t.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    lines, dups, full = set(), 0, 0
    for line in t.split("\n"):
        if line.strip(SPACES):
            full += 1
            dups += line in lines
            lines.add(line)
    upper = sum(map(str.isupper, t)) if not t.isascii() else len(t) - len(t.translate(NO_UPPER))
    return len(words), len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), dups, repeated_words(ids), upper, t.count("!"), full, len(seen)


NO_UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


def statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and COUNTS (long) of every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = np.array([counted(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0)) for k, (a, b) in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self, prefix: str = "") -> Column:
        x = F.col(prefix + self.feature)
        return x > F.lit(self.cut) if self.above else x <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.holds(x)
    return hit


def grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions added while one raises FOIL's information gain."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    for _ in range(CONDITIONS):
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        best, base = (1e-9, None), np.log2(p / (p + n))
        for name, values in x.items():
            for cut in np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS))):
                above = inside & (values > cut)
                p1, n1 = int(bad[above].sum()), int((~bad[above]).sum())
                for up, pp, nn in ((True, p1, n1), (False, p - p1, n - n1)):
                    if pp and pp + nn < p + n:
                        gain = pp * (np.log2(pp / (pp + nn)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(name, up, float(cut)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, float]:
    hit = covers(rule, x, len(bad))
    p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
    return (p - n) / max(1, p + n), p, p / max(1, p + n)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7) -> list[Rule]:
    """Ordered rules for rows that are bad; none if there are too few to learn from."""
    order = np.random.default_rng(seed).permutation(len(bad))
    third = np.zeros(len(bad), bool)
    third[order[: len(bad) // 3]] = True
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < RULES and bad[left & ~third].any():
        at = [{k: v[left & s] for k, v in x.items()} for s in (~third, third)]
        rule = grow(at[0], bad[left & ~third])
        if not rule:
            break
        held = at[1], bad[left & third]
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, *held)[0])
        _, p, precision = worth(rule, *held)
        if precision < PRECISION or p < COVER:
            break
        rules.append(rule)
        left &= ~covers(rule, x, len(bad))
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """False for rows that a rule covers, in order; true for the others."""
    out = F.lit(True)
    for rule in reversed(rules):
        hit = F.lit(True)
        for c in rule:
            hit = hit & c.column(prefix)
        out = F.when(hit, F.lit(False)).otherwise(out)
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled ids, the first by a hash of the id; labels that are null teach nothing.

    Of rows with one id the first by its statistics teaches, so that no more than `sample` rows reach the driver.
    """
    taught = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taught = taught.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id").select("doc_id", "text")
    one = statistics(own).groupBy("doc_id").agg(F.min(F.struct(*COUNTS)).alias("s")).select("doc_id", "s.*")
    rows = ratios(one).join(taught, "doc_id").orderBy("doc_id").select("quality", *RATIOS).toPandas()
    return learn({k: rows[k].to_numpy(float) for k in RATIOS}, rows["quality"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Statistics of every row, base_failed and kept. Texts of fewer than 20 words or with over 30 % repeated words fail."""
    stats = ratios(statistics(docs, text, doc_id))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judged(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", *COUNTS[5:])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    Null and empty texts have no words and go. Repeated rows and rows with one or no doc_id are judged one by one. An
    empty table gives an empty one; all columns are kept, whatever their names.
    """
    rules = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_quality_text"):
            rows = np.array([counted(t) for t in b.column(b.num_columns - 1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=[*names, *own])

    # The rows travel with their statistics, so that no join by doc_id is needed.
    names, own = docs.columns, [f"_quality_{c}" for c in COUNTS]
    with_text = docs.select("*", F.col("text").cast("string").alias("_quality_text"))
    stats = with_text.mapInArrow(lean(run), schema_of(docs, names, **{c: T.LongType() for c in own}))
    value = {c: F.col(f"_quality_{c}") for c in COUNTS}
    shares = {f"_quality_{k}": F.when(value[b] > 0, value[a] / value[b]).otherwise(F.lit(0.0)) for k, (a, b) in RATIOS.items()}
    stats = stats.withColumns(shares)
    passed = (value["n_words"] >= 20) & (100 * value["n_repeat_words"] <= 30 * value["n_words"]) & verdict(rules, "_quality_")
    return stats.filter(passed).select(*names)
