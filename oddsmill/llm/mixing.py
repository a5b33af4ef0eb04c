"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Slots carry the points of a golden-ratio sequence, which fall on sources through the cumulative target shares; the
r-th slot of a source takes the r-th block of its shuffled text, blocks of a source holding equally many words, and
begins again after the last. A source of any size is spread over hash buckets wherever rows must be in order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import WORD_CHARS, materialise

#: Weights by the sources' order, repeating; times that a text may be taken at most; words of a block at most; slots that a source should have at least.
WEIGHTS, REPEATS, BLOCK, SLOTS = (5, 2, 1), 3, 4096, 256
#: Slots ranked together, bins of the cumulative shares, hash digits that spread a source.
CHUNK, BINS, DIGITS = 1 << 16, 1024, 3
#: Sources sent to every task at most; more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def sized(docs: DataFrame, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc_id, source, size, k): words of every row, and the key by which the source's rows are shuffled."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD_CHARS)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("k"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """Per source: sid (its place by code point, null last), source_size, target, and its blocks and share of the slots.

    Targets are the weights' shares of all words, none above REPEATS times its source. What a capped source leaves
    goes to the others by weight: with sources in the order of cap to weight, the level at which that ends is the
    largest of what is left to each and those after it.
    """
    everywhere = Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(everywhere) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", REPEATS * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rest = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("level", rest / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(Window.partitionBy()) * F.col("weight")))
    s = s.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("target") / SLOTS))).cast("long"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    s = s.withColumn("wanted", F.col("target") / F.col("block"))
    total = F.sum("wanted").over(Window.partitionBy())
    s = s.withColumn("hi", F.sum("wanted").over(everywhere) / F.nullif(total, F.lit(0.0)))
    return s.withColumn("lo", F.coalesce(F.lag("hi").over(everywhere), F.lit(0.0))).withColumn("slots", F.round(total).cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """(sid, block_no, uses): how often the slots take each block."""
    spark = sources.sparkSession
    n = sources.agg(F.max("slots")).first()[0] or 0
    # Golden-ratio (Weyl) sequence in integers: exact at any length.
    u = ((F.col("id") % F.lit(1 << 31)) * F.lit(2654435769) % F.lit(1 << 32)) / F.lit(float(1 << 32))
    slots = spark.range(n).select("id", u.alias("u")).withColumn("bin", F.floor(F.col("u") * BINS))
    spans = sources.filter("lo < hi").select("sid", "lo", "hi", "blocks", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("bin"))
    drawn = slots.join(spans, "bin").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    drawn = drawn.select("sid", "blocks", "id", F.floor(F.col("id") / CHUNK).alias("chunk"))
    before = drawn.groupBy("sid", "chunk").count()
    before = before.withColumn("before", F.sum("count").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("count")).drop("count")
    ranked = drawn.join(before, ["sid", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("id")) - 1)
    taken = ranked.filter(F.col("rank") < REPEATS * F.col("blocks"))
    return taken.groupBy("sid", (F.col("rank") % F.col("blocks")).alias("block_no")).agg(F.count("*").alias("uses"))


def mix(docs: DataFrame, seed: int = 7, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words that the mix takes of it, repeats counted).

    Null texts have no words; a null source is a source, the last. Rows without words are returned with taken 0.
    Repeated rows are drawn like others. The order within a source is by MD5 of the seed and doc_id, then by doc_id
    and size, so that reruns agree.
    """
    rows = materialise(sized(docs, seed, text, doc_id, source), "mix-sizes")
    sources = materialise(targets(rows), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    own = small(sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "block"))
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("bucket", F.substring("k", 1, DIGITS))
    full = rows.filter("size > 0")
    before = full.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    before = before.withColumn("before", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words")).drop("words")
    within = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = full.join(before, ["sid", "bucket"]).withColumn("end", F.col("before") + within).withColumn("start", F.col("end") - F.col("size"))
    first, last = F.floor(F.col("start") / F.col("block")), F.floor((F.col("end") - 1) / F.col("block"))
    pieces = placed.withColumn("block_no", F.explode(F.sequence(first, last)))
    words = F.least(F.col("end"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    columns = ["sid", "start", "doc_id", "source", "size", "source_size", "target"]
    met = pieces.select(*columns, "block_no", words.alias("words")).join(schedule(sources), ["sid", "block_no"], "left")
    taken = met.groupBy(*columns).agg(F.sum(F.col("words") * F.coalesce("uses", F.lit(0))).cast("long").alias("taken")).drop("sid", "start")
    return taken.unionByName(rows.filter("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def copies(mixed: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, copies) of mix()'s rows: whole copies, the rounding of each carried to the next of its source.

    Copies of a source, in the order of the MD5 of seed and doc_id, add up to taken / size to within half a copy at
    every place; so its words come near its target however few documents it has. Shares are counted in millionths, by
    source and bucket first, so that a large source is no single task's.
    """
    k = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    share = F.floor(F.col("taken") * 1_000_000 / F.col("size")).cast("long")
    rows = mixed.filter("size > 0").select("doc_id", "source", "size", share.alias("share"), k.alias("k")).withColumn("bucket", F.substring("k", 1, DIGITS))
    rows = rows.withColumn("named", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    before = rows.groupBy("named", "bucket").agg(F.sum("share").alias("own"))
    before = before.withColumn("before", F.sum("own").over(Window.partitionBy("named").orderBy("bucket")) - F.col("own")).drop("own")
    within = F.sum("share").over(Window.partitionBy("named", "bucket").orderBy("k", "doc_id", "size", "share").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(before, ["named", "bucket"]).withColumn("end", F.col("before") + within)
    whole = lambda c: F.floor((c + 500_000) / 1_000_000)
    return rows.select("doc_id", "source", "size", (whole(F.col("end")) - whole(F.col("end") - F.col("share"))).cast("int").alias("copies"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, in whole copies (0 to 3).

    Documents without words are not taken. Rows with one doc_id (null is one too) come as often as the most taken of
    them. An empty table gives an empty one; all columns are kept.
    """
    most = copies(materialise(mix(docs), "mix-taken")).groupBy("doc_id").agg(F.max("copies").alias("_mix_copies"))
    most = most.filter("_mix_copies > 0").withColumnRenamed("doc_id", "_mix_doc_id")
    some = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD_CHARS)) > 0
    # By shuffle at every size, as both sides grow with the documents: else small inputs alone are joined by broadcast.
    rows = docs.filter(some).join(most.hint("shuffle_merge"), F.col("doc_id").eqNullSafe(F.col("_mix_doc_id")))
    return rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns)
