"""What near-dedup shuffles, that marks lose no row, and how much text a worker encodes at a time."""
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from oddsmill.llm import bpe, common, mixing, simhash  # noqa: E402


def shuffled(spark) -> int:
    """Bytes that the application has written to shuffles so far."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def texts(n: int, words: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return [" ".join(f"{rng.getrandbits(48):x}" for _ in range(words)) for _ in range(n)]


def test_near_dedup_shuffles_few_texts(spark, tmp_path):
    """Texts without near copies are neither candidates nor dropped, so they aren't shuffled."""
    own = texts(150, 1000, 1)
    rows = [(k, t) for k, t in enumerate(own)] + [(1000, own[3]), (1001, own[4] + " more")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    before = shuffled(spark)
    got = {r.doc_id for r in simhash.stage(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()}
    assert got == set(range(150))
    assert shuffled(spark) - before < sum(map(len, own)) / 4


@pytest.mark.parametrize("bits", [6, 8, 24])
def test_marks_lose_nothing(spark, monkeypatch, bits):
    """Rows that share a mark with repeated or dropped ones are kept, whatever the size of the table of marks."""
    monkeypatch.setattr(common, "MARKS", bits)
    own = texts(60, 40, 2)
    rows = [(k, t) for k, t in enumerate(own)] + [(100 + k, own[k]) for k in range(20)] + [(k, own[k]) for k in range(10, 30)] + [(None, own[0]), (None, own[0]), (7, own[50])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in simhash.stage(spark, table, "").collect()), key=str)
    assert got == sorted([(k, own[k]) for k in range(60) if k != 50] + [(7, own[50]), (None, own[0]), (None, own[0])], key=str)


def test_marks(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 10)
    some = spark.range(300).select(F.col("id").alias("a"), (F.col("id") * 7).alias("b"))
    marked = common.marks(some.filter("a % 3 = 0"), ["a", "b"])
    assert marked.count() <= 1 << 4
    found = {r.a: r._marked for r in common.with_mark(some, marked, ["a", "b"]).collect()}
    assert len(found) == 300 and all(found[a] for a in range(0, 300, 3)) and not all(found.values())


def test_mixing_joins_texts_alike_at_every_size(spark):
    rows = spark.createDataFrame([(k, f"some words of {k}", "s") for k in range(20)], "doc_id long, text string, source string")
    plan = mixing.stage(spark, rows, "")._jdf.queryExecution().executedPlan().toString()
    (join,) = (x for x in plan.splitlines() if "Join" in x and "_mix_doc_id" in x)
    assert "SortMergeJoin" in join


def test_bpe_encodes_little_text_at_a_time():
    """A slice's different chunks and their ids are held as Python objects."""
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10_000] * 600)], names=["t"])
    parts = list(common.slices(iter([batch]), "t", bpe.SLICE_BYTES))
    assert sum(p.num_rows for p in parts) == 600
    assert max(pc.sum(pc.binary_length(p.column(0))).as_py() for p in parts) < (1 << 20) + 10_001
