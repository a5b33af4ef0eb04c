"""Near duplicates by SimHash: exact comparison of fingerprint tiles, with population counts ruling tile pairs out.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Fingerprints are laid out in
cells by the population counts of their quarters; the counts of two fingerprints at Hamming distance d differ by d
at most in total, so only cells within the radius are paired, and each pair of tiles is compared exactly with numpy.
The cells are at most 17**4 whatever the corpus, so their list may be broadcast.

near_duplicates() takes all links within the radius. similar() takes them as candidates only: within each class of
candidates, pairs are confirmed by the exact Jaccard similarity of their shingles before they link anything.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsmill.llm.common import connected_components, lean, marks, materialise, slices, with_mark

SEED = 42
#: Shingles whose bits are counted at a time.
STEP = 1 << 15
#: Fingerprints of a tile, on average.
TILE = 256
#: Fingerprints of a cell that one block of a cell pair takes on each side.
BLOCK = 1 << 15
#: Shingles and texts of a class of candidates that one task takes on each side.
CLASS_SHINGLES, CLASS_TEXTS = 1 << 21, 1 << 12


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text with A-Z in lower case; the whole sequence if it has fewer words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(s, SEED) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))), np.uint64, len(w) - words + 1)


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), STEP):
        bits = np.unpackbits(h[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Independent 64-bit hashes from 64-bit hashes: the k-th step of SplitMix64."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def set_key(h: np.ndarray) -> int:
    """Signed 64-bit digest of a set of hashes in ascending order."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 3, parts: int = 1, distinct: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, th: hash of the text, fp array<long> of `parts` words of 64 bits, n distinct shingles or 0 if repeats count, key: their digest or 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows, n, keys = [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t, words)
                if distinct:
                    h = np.unique(h)
                rows.append(np.array([majority(mixed(h, k)) for k in range(parts)], np.uint64).view(np.int64))
                n.append(len(h) if distinct else 0)
                keys.append(set_key(h) if distinct else 0)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, parts), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, pa.array(n, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "th", "fp", "n", "key"])

    return with_hash(docs, text, doc_id).mapInArrow(lean(run), "doc_id long, th long, fp array<long>, n long, key long")


def popcount_cells(radius: int):
    """Cell of a fingerprint by the population counts of its quarters, and the offsets to the cells within the radius."""
    fp = F.col("fp")[0]
    cell = sum((F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(F.lit(65535).cast("long"))).cast("long") + 32) * 128**q for q in range(4))
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return cell, sorted(x for x in (sum(d * 128**q for q, d in enumerate(s)) for s in steps) if x >= 0)


def size_cells(similarity: float):
    """Cell of a document by the logarithm of its number of shingles: at this Jaccard similarity cells are equal or adjacent."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(-float(np.log(similarity)))).cast("long"), [0, 1]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def compare(a: np.ndarray, b: np.ndarray, radius: int, first: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at `least` to `radius` differing bits, and at most `first` in the first word. a, b: (n, parts)."""
    found, rows = [], max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, :1] ^ b[None, :, 0]) <= first
        i, j = np.nonzero(near)
        bits = np.bitwise_count(a[at + i] ^ b[j]).sum(axis=1, dtype=np.int64)
        keep = (bits >= least) & (bits <= radius)
        found.append((at + i[keep], j[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def tile_links(batches: Iterator[pa.RecordBatch], parts: int, radius: int, first: int, least: int = 1) -> Iterator[pa.RecordBatch]:
    """For rows (target tile, fingerprints and ids of a tile near it, those of the target): links that span, as (src, dst)."""

    def column(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
        x = b.column(k)
        return x.offsets.to_numpy(), x.values.to_numpy()

    for b in batches:
        groups: dict[tuple, list[int]] = {}
        for r, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            groups.setdefault(key, []).append(r)
        (ao, av), (io, iv), (bo, bv), (jo, jv) = (column(b, k) for k in (2, 3, 4, 5))
        src, dst = [], []
        for rows in groups.values():
            x = np.concatenate([av[ao[r] : ao[r + 1]] for r in rows]).view(np.uint64).reshape(-1, parts)
            xi = np.concatenate([iv[io[r] : io[r + 1]] for r in rows])
            y, yi = bv[bo[rows[0]] : bo[rows[0] + 1]].view(np.uint64).reshape(-1, parts), jv[jo[rows[0]] : jo[rows[0] + 1]]
            i, j = compare(x, y, radius, first, least)
            if len(i):
                ids, nodes = np.unique(np.concatenate([xi[i], yi[j]]), return_inverse=True)
                label = forest(nodes[: len(i)], nodes[len(i) :], len(ids))
                own = np.flatnonzero(label != np.arange(len(ids)))
                src.append(ids[own])
                dst.append(ids[label[own]])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src), pa.int64()), pa.array(np.concatenate(dst), pa.int64())], names=["src", "dst"])


def links(fps: DataFrame, radius: int, first: int | None = None, parts: int = 1, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Representatives (fp, n, least: the smallest id with that fingerprint, node: a number) and a spanning set of the links between nodes.

    Texts with one fingerprint are one representative; with a similarity they must also have the same key, its column then.
    similarity: lays cells by shingle counts (for radii at which population counts rule nothing out), else by population counts.
    """
    own = ["key"] if similarity else []
    # Numbers are given once, as the table is written; ids would not do, as different texts may have the same.
    least = F.min(F.struct("doc_id", "th")) if similarity else F.min("doc_id")
    reps = fps.filter("doc_id is not null").groupBy("fp", *own).agg(least.alias("least"), F.min("n").alias("n"))
    reps = materialise(reps.withColumn("node", F.monotonically_increasing_id()), "simhash-reps")
    cell, offsets = size_cells(similarity) if similarity else popcount_cells(radius)
    reps = reps.withColumn("cell", cell)
    cells = reps.groupBy("cell").agg(F.ceil(F.count("*") / TILE).alias("tiles"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    tiles = reps.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    tiles = tiles.groupBy("cell", "tile", "blocks").agg(F.collect_list(F.struct("fp", "node")).alias("x"))
    tiles = materialise(tiles.select("cell", "tile", "blocks", F.flatten("x.fp").alias("fps"), F.col("x.node").alias("ids")), "simhash-tiles")
    # A cell pair is met in blocks x blocks groups of tiles: block i of the one, with those of other cells near the target, and
    # block j of the target. The target's tiles are copied for each i of the largest cell near it.
    off = F.explode(F.array(*(F.lit(x).cast("long") for x in offsets))).alias("off")
    most = cells.select("cell", "blocks", off).groupBy((F.col("cell") + F.col("off")).alias("target")).agg(F.max("blocks").alias("most"))
    near = tiles.select("cell", "tile", (F.col("tile") % F.col("blocks")).alias("i"), off, "fps", "ids")
    near = near.withColumn("target", F.col("cell") + F.col("off")).join(F.broadcast(cells.select(F.col("cell").alias("target"), F.col("blocks").alias("other"))), "target")
    near = near.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other") - 1))).select("target", "j", "i", "off", F.col("tile").alias("from"), "fps", "ids")
    there = tiles.withColumn("target", F.col("cell")).join(F.broadcast(most), "target").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)))
    there = there.select("target", (F.col("tile") % F.col("blocks")).alias("j"), "i", "tile", F.col("fps").alias("fps2"), F.col("ids").alias("ids2"))
    met = near.join(there, ["target", "j", "i"]).filter("off <> 0 or from <= tile")
    run = lambda batches: tile_links(batches, parts, radius, radius if first is None else first, 0 if similarity else 1)
    edges = met.select("target", "tile", "fps", "ids", "fps2", "ids2").mapInArrow(lean(run), "src long, dst long")
    return reps.select("fp", *own, "least", "node", "n"), edges


def classed(reps: DataFrame, components: DataFrame) -> DataFrame:
    """reps with `first`, the smallest `least` of all nodes of their component."""
    of = reps.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = of.groupBy("component").agg(F.min("least").alias("first"))
    return of.join(first, "component").drop("component")


def confirm(fps: np.ndarray, sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray | None, radius: int, similarity: float) -> np.ndarray:
    """Class of each text: the smallest index it reaches over pairs within the radius with a Jaccard similarity of at least `similarity`.

    Pairs of one side are left out if sides are given, and so are pairs that are in one class by then.
    """
    size = np.array([len(x) for x in sets], np.int64)
    vocabulary, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(codes, np.cumsum(size)[:-1])
    label, mark = np.unique(nodes, return_index=True)[1][np.unique(nodes, return_inverse=True)[1]], np.zeros(len(vocabulary), bool)
    for i in range(len(sets) - 1):
        maybe = label[i + 1 :] != label[i]
        if side is not None:
            maybe &= side[i + 1 :] != side[i]
        js = i + 1 + np.flatnonzero(maybe & (np.minimum(size[i + 1 :], size[i]) >= similarity * np.maximum(size[i + 1 :], size[i]) - 1e-9))
        if len(js):
            js = js[np.bitwise_count(fps[js] ^ fps[i]).sum(axis=1, dtype=np.int64) <= radius]
        if not len(js):
            continue
        mark[sets[i]] = True
        common = np.add.reduceat(mark[np.concatenate([sets[j] for j in js])], np.concatenate(([0], np.cumsum(size[js])[:-1])), dtype=np.int64)
        mark[sets[i]] = False
        for j in js[common >= similarity * (size[i] + size[js] - common) - 1e-9]:
            x, y = sorted((label[i], label[j]))
            if x != y:
                label[label == y] = x
    return label


def confirmed(docs: DataFrame, reps: DataFrame, classes: DataFrame, words: int, radius: int, parts: int, similarity: float, text: str, doc_id: str) -> DataFrame:
    """Links (src, dst) that span what `confirm` links within the classes (node, component) of candidates.

    A class of many shingles is cut into blocks, each pair of which is a group of rows of its own.
    """
    of = reps.filter("n > 0").join(classes, "node").groupBy("component").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    blocks = of.filter("texts > 1").select("component", F.greatest(F.ceil(F.col("n") / CLASS_SHINGLES), F.ceil(F.col("texts") / CLASS_TEXTS)).alias("blocks"))
    members = classes.join(blocks, "component").join(reps.select("node", "least"), "node").select("node", "component", "blocks", "least.*")
    members, key = materialise(members, "simhash-members"), ["doc_id", "th"]
    # Most texts have no class of candidates and are passed over where they are read. The others are joined by shuffle at
    # every size, as members grow with the documents; equal rows then meet without another.
    rows = with_mark(with_hash(docs, text, doc_id), marks(members, key), key).filter("_marked").drop("_marked")
    rows = rows.join(members.hint("shuffle_merge"), key).dropDuplicates(key)
    rows = rows.select(F.col("node").alias("doc_id"), "text", "component", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, words)) for t in part.column(1).to_pylist()]
            fp = [np.array([majority(mixed(h, k)) for k in range(parts)], np.uint64).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fp, pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["doc_id", "component", "blocks", "own", "fp", "h"])

    sets = rows.mapInArrow(lean(shingled), "doc_id long, component long, blocks long, own long, fp binary, h binary").filter("octet_length(h) > 0")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = sets.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "fp", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            fps = np.frombuffer(b"".join(x[2] for x in held), np.uint64).reshape(-1, parts)
            nodes = np.array([x[1] for x in held], np.int64)
            side = None if now[1] == now[2] else np.array([x[0] for x in held])
            label = confirm(fps, [np.frombuffer(x[3], np.uint64) for x in held], nodes, side, radius, similarity)
            own = np.flatnonzero(nodes != nodes[label])
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["src", "dst"])

        for b in batches:
            for part in (b.slice(k, 100) for k in range(0, b.num_rows, 100)):
                for c, i, j, *row in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if (c, i, j) != now:
                        if len(held) > 1:
                            yield done()
                        now, held = (c, i, j), []
                    held.append(row)
        if len(held) > 1:
            yield done()

    return met.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(lean(run), "src long, dst long")


def with_hash(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, th: hash of the text, text); an id and a text hash stand for a row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(t).alias("th"), t.alias("text"))


def similar(docs: DataFrame, words: int = 5, radius: int = 72, parts: int = 4, first: int = 24, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, th, component_id, first_th) by chains of texts with a Jaccard similarity of their shingles of `similarity` or more.

    component_id and first_th are the smallest (doc_id, th) of the class, th being the hash of a text (null as empty).
    Rows with a null doc_id are left out; texts without words are equal.
    """
    fps = materialise(fingerprints(docs, words, parts, True, text, doc_id).filter("doc_id is not null"), "simhash-fps")
    reps, edges = links(fps, radius, first, parts, similarity)
    candidates = materialise(connected_components(edges), "simhash-candidates")
    edges = materialise(confirmed(docs, reps, candidates, words, radius, parts, similarity, text, doc_id), "simhash-confirmed")
    classes = classed(reps, connected_components(edges)).select("fp", "key", F.col("first.doc_id").alias("component_id"), F.col("first.th").alias("first_th"))
    return fps.select("doc_id", "th", "fp", "key").join(classes, ["fp", "key"]).select("doc_id", "th", "component_id", "first_th")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): one row per input row, component_id being the smallest doc_id of its class.

    Null and empty texts have fingerprint zero, which links like any other. Rows with a null doc_id are returned with
    their fingerprint and the class of that fingerprint, if another row has it, else null. Repeated rows are returned
    as often as they come. Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, words, text=text, doc_id=doc_id), "simhash-fps")
    reps, edges = links(fps, radius)
    classes = classed(reps, connected_components(edges)).select("fp", F.col("first").alias("component_id"))
    return fps.select("doc_id", "fp").join(classes, "fp", "left")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: fingerprint and class of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: near copies by five-word shingles at a similarity of 0.8 or more; the smallest doc_id of each group stays.

    256 bits: at Jaccard 0.8 about 39 differ (standard deviation under 6; up to 48 of texts with four or five shingles),
    of unrelated texts 128 (8). Candidates differ in at most 72 of the 256 and 24 of the first 64; their exact
    similarity decides. Of each group the row with the smallest doc_id stays, of several with that id the one with the
    smallest text hash, of equal rows one. Rows with a null doc_id all stay. Null and empty texts are equal; an empty
    table gives an empty one. All columns are kept.
    """
    own = ["_simhash_id", "_simhash_th"]
    first = ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("first_th"))).alias("first")
    judged = similar(docs).select(F.col("doc_id").alias(own[0]), F.col("th").alias(own[1]), first)
    judged = materialise(judged.groupBy(*own).agg(F.bool_or("first").alias("first"), F.count("*").alias("n")), "simhash-judged")
    rows = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))), strict=True)))
    # A row that is neither dropped nor repeated stays where it is; only the others, and what shares their marks, are shuffled.
    rows = with_mark(rows.filter(F.col(own[0]).isNotNull()), marks(judged.filter("not first or n > 1"), own), own)
    again = rows.filter("_marked").join(judged.filter("first").hint("shuffle_merge"), own, "left_semi").dropDuplicates(own)
    return rows.filter("not _marked").unionByName(again).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
