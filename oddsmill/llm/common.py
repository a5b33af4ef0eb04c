"""Pieces shared by the corpus operators: scratch storage, words, connected components."""
from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A word is a maximal run of characters other than space and U+0009 to U+000D.
WORD_CHARS = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_CHARS)
#: Bytes of words so defined (all bytes of characters outside ASCII among them), and bytes with A-Z in lower case.
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Bytes of texts that a task holds as Python objects at a time.
TEXT_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of a text column (null: none), some `size` at a time and a row at least."""
    for b in batches:
        bound = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                yield b.slice(lo, hi - lo)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that leaves its worker no free memory: workers outlive their stage, and what they keep adds to the next one's."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return task


def lowered(text: pa.Array, inside: np.ndarray, table: np.ndarray | None = LOWER) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of the bytes that are `inside`, in lower case (or by another table, None: as they are), of texts without nulls one after another, and the place of each one's text."""
    raw, offsets = flat(text)
    on = inside[raw]
    starts = on.copy()
    starts[1:] &= ~on[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = on[first]  # a run ends with its text
    begin, kept = np.flatnonzero(starts), np.cumsum(on, dtype=np.int32)
    places = np.concatenate((kept[begin] - 1, kept[-1:] if len(kept) else [0])).astype(np.int32)
    own = raw[on]
    out = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(places.tobytes()), pa.py_buffer((own if table is None else table[own]).tobytes())])
    return out, np.searchsorted(offsets, begin, "right") - 1


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts (or binary values) without nulls, and the place at which each starts, with the end of all."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(packed: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each code stands for, one after another, and how many each has: packed[k] holds the unsigned 32-bit numbers of code k."""
    values = np.frombuffer(b"".join(packed), "<u4")
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    n = sizes[code]
    ends = np.cumsum(n)
    places = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - n), n)
    places += np.arange(len(places))
    return values[places], n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; executors can't read the driver's folders")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        base = spark.sparkContext.getCheckpointDir()
    base = re.sub(r"\Afile:(?!//)", "file://", base)
    return base if "://" in base else f"file://{base}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder as Parquet and read that back: cuts lineage, and gives the planner real sizes."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys are marked in 1 << MARKS bits, 64 a row: a table of fixed size whatever the input, so that it may be broadcast.
MARKS = 24


def marks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(_mark, _bits): the keys' bits."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << MARKS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return df.select(F.floor(place / 64).alias("_mark"), bit.alias("bit")).groupBy("_mark").agg(F.bit_or("bit").alias("_bits"))


def with_mark(df: DataFrame, marked: DataFrame, keys: list[str]) -> DataFrame:
    """df with `_marked`: false where the row's key is none of the marked ones for certain, true for those and some others."""
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << MARKS))
    out = df.withColumn("_mark", F.floor(place / 64)).join(F.broadcast(marked), "_mark", "left")
    return out.withColumn("_marked", F.coalesce(F.getbit("_bits", place % 64), F.lit(0)) == 1).drop("_mark", "_bits")


def schema_of(df: DataFrame, columns: list[str], **more: DataType) -> StructType:
    """Schema of some columns, and further ones of the given types."""
    return StructType([*(df.schema[c] for c in columns), *(StructField(c, t) for c, t in more.items())])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Component of every node of an undirected graph.

    edges: (src, dst) bigint. Returns (node, component), component being the smallest node that can be reached;
    nodes without an edge to another node do not appear. Alternates large-star and small-star steps (Kiveris et al.
    2014), each an aggregation and an equi-join, until the edge set no longer changes; a star's hub is only ever
    aggregated with map-side combine or joined, so that adaptive skew handling can split it.
    """
    shared_dir(edges.sparkSession)

    def pairs(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = pairs(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))).checkpoint()
    seen = mark(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = pairs(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = pairs(small.unionByName(least.select("u", F.col("m").alias("v")))).checkpoint()
        before, seen = seen, mark(now)
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point in {rounds} rounds")
    node = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return node.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
