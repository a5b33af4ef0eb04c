"""Language-model scoring: a bigram model by Katz backoff, learned from some documents and evaluated on all of them.

Good-Turing discounts (Katz 1987) come from the counts of counts up to DISCOUNTED; backoff weights are computed from the
discounted counts of each context and the unigram probabilities of the words seen after it, so that every context's
probabilities, that of an unknown word included, add up to one.

Texts are read once. Tasks code the words of a step of texts by a dictionary of the step and leave the codes in the
shared folder; the dictionaries are dealt by word, packed, and get their words' numbers and counts, which return to the
steps. The pairs of neighbouring words go, packed too, to the bucket of their context, with the documents that hold
them: there the counts of a pair, its context and all tokens to be scored meet. A bucket is a row of a table: the pairs
and their counts, then the tokens, in pieces that are sorted and scored one at a time. Buckets hold some BUCKET tokens. A context with over 1 / HOT of the training tokens
is dealt out by pair, and what its backoff weight needs is added up beside; there are HOT such contexts at most, and
the start.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from oddsmill.llm import files
from oddsmill.llm.common import IN_WORD, lowered, materialise, scratch, slices

DISCOUNTED, HOT, BUCKET, STEP_BYTES = 5, 1000, 4_000_000, 1 << 24
#: Unpacked bytes of pairs that a task sorts at a time.
PIECE_BYTES = 1 << 21
#: The end of a text as a token (no word is empty), and the number of its start as a context.
END, START = "", -1
#: Added to counts in the base score; units of a logarithm in which tokens are added up, exactly and in any order.
BASE, UNITS = 0.1, float(1 << 36)


# -- the model


def discounts(having: list[int]) -> np.ndarray:
    """Factors of counts 0 to DISCOUNTED, and 1 for those above; having[r - 1] is the number of types with count r, up to DISCOUNTED + 1.

    Katz's form of the Good-Turing estimate. Where any of its factors is not between 0 and 1, as repeated texts can make
    it, the numbers of types are first smoothed by a line in logarithms (Gale and Sampson 1995). Where that does not
    fall faster than 1 / r, or under two counts occur, r counts as r - 1/2.
    """
    n, k = np.array(having, float), DISCOUNTED
    r = np.arange(1, k + 2)

    def turing(n: np.ndarray) -> np.ndarray:
        over = (k + 1) * n[k] / n[0]
        return (r[1:] * n[1:] / n[:-1] / r[:-1] - over) / (1 - over)

    with np.errstate(divide="ignore", invalid="ignore"):
        d = turing(n)
        if not ((d > 0) & (d < 1)).all() and (n > 0).sum() > 1:
            slope, at = np.polyfit(np.log(r[n > 0]), np.log(n[n > 0]), 1)
            d = turing(np.exp(at) * r**slope) if slope < -1 else d
    if not ((d > 0) & (d < 1)).all():
        d = (r[:-1] - 0.5) / r[:-1]
    return np.array([0.0, *d, 1.0])


def factor(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, DISCOUNTED + 1)]


@dataclass
class Unigrams:
    """Tokens and types of the training texts, and the discounts of their counts."""

    tokens: int
    types: int
    d: np.ndarray
    unseen: float
    #: One more where no count is discounted, so that an unknown word has a share.
    total: int

    @classmethod
    def of(cls, tokens: int, types: int, having: list[int]) -> Unigrams:
        d = discounts(having)
        kept = sum((r + 1) * n * (1 - d[r + 1]) for r, n in enumerate(having[:DISCOUNTED]))
        return cls(tokens, types, d, kept / tokens if kept else 1 / (tokens + 1), tokens + (not kept))

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, factor(self.d, count) * count / self.total, self.unseen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + BASE) / (self.tokens + BASE * (self.types + 1)))


def backoff(total: np.ndarray, left: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominator and backoff weight of contexts with `total` tokens, `left` of them by discounts, and the unigram probability of the words seen.

    Where nothing is left the denominator is one larger. A context that training lacks leaves all to the unigrams.
    """
    more = np.where((left <= 0) & (total > 0), 1.0, 0.0)
    bottom = np.maximum(total + more, 1.0)
    return bottom, np.where(total > 0, (left + more) / bottom / np.maximum(1 - seen, 1e-300), 1.0)


# -- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each in the least type that holds it, byte by byte of the numbers, compressed."""
    out = []
    for a in arrays:
        kind = next(k for k in ("u1", "u2", "u4", "i8") if not len(a) or k == "i8" or (a.min() >= 0 and a.max() <= np.iinfo(k).max))
        own = a.astype(f"<{kind}")
        out.append(struct.pack("<2sq", kind.encode(), len(a)) + own.view(np.uint8).reshape(len(a), own.itemsize).T.tobytes())
    raw = b"".join(out)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sq", raw, at)
        width = int(kind[1:])
        own = np.frombuffer(raw, np.uint8, n * width, at + 10).reshape(width, n)
        out.append(np.ascontiguousarray(own.T).view(f"<{kind.decode()}").ravel())
        at += 10 + n * width
    return out


def starts_of(key: np.ndarray | pa.Array) -> np.ndarray:
    """Places at which a sorted key changes."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1] if isinstance(key, np.ndarray) else pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


# -- steps of texts


def coded(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Dictionary of the texts' tokens, their codes one text after another, and tokens by text. Code 0 is the end."""
    words, doc = lowered(text, IN_WORD)
    code = words.dictionary_encode()
    sizes = np.bincount(doc, minlength=len(text)) + 1
    codes = np.zeros(int(sizes.sum()), np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = code.indices.to_numpy() + 1
    return pa.concat_arrays([pa.array([END], pa.string()), code.dictionary]), codes, sizes


def packed_words(words: pa.Array, counts: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """A dictionary by bucket of its words: codes, counts, lengths and bytes."""
    bucket = np.fromiter((zlib.crc32(w.encode()) % parts for w in words.to_pylist()), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")
    at = starts_of(bucket[order])
    out = []
    for code in np.split(order, at[1:]):
        own = words.take(pa.array(code))
        size = pc.binary_length(own).to_numpy().astype(np.int64)
        out.append((int(bucket[code[0]]), pack(code, counts[code], size, np.frombuffer(own.buffers()[2] or b"", np.uint8)[: size.sum()])))
    return out


def unpacked_words(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    code, n, size, raw = unpack(blob)
    places = np.concatenate(([0], np.cumsum(size.astype(np.int64)))).astype(np.int32)
    return code, n, pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw.tobytes())])


#: Columns of the two tables between texts and buckets. Rows are of several kinds, null in what is not theirs.
STEPS = {"step": pa.int64(), "bucket": pa.int32(), "words": pa.binary(), "path": pa.string(), "ids": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int64())}
WORDS = {
    **{c: STEPS[c] for c in ("step", "path", "ids", "held", "sizes")}, "known": pa.binary(), "having": pa.list_(pa.int64()), "types": pa.int64(), "tokens": pa.int64(),
    "vocabulary": pa.list_(pa.struct([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64())])),
}


def rows_of(kinds: dict[str, pa.DataType], n: int, **columns) -> pa.RecordBatch:
    made = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[c]) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def schema(kinds: dict[str, pa.DataType]):
    return from_arrow_schema(pa.schema(list(kinds.items())))


def one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def encoded(rows: DataFrame, step_bytes: int, parts: int) -> DataFrame:
    """Steps of the rows (id, held, t): one row of what they hold, path leading to the codes, and one a bucket of their words with the training counts.

    Steps are numbered by task and place, so that a task run again makes the same ones; the codes go to a new file each time.
    """
    folder = scratch(rows.sparkSession, "katz-codes")
    files.make_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(slices(batches, "t", step_bytes)):
            step = TaskContext.get().partitionId() << 32 | k
            words, codes, sizes = coded(b.column("t"))
            learned = ~b.column("held").to_numpy(zero_copy_only=False)
            counts = np.bincount(codes[np.repeat(learned, sizes)], minlength=len(words))
            path = files.new_name(folder, "step", ".bin")
            with files.write_stream(path) as f:
                f.write(pack(codes))
            yield rows_of(STEPS, 1, step=[step], bucket=[step % parts], path=[path], ids=one_list(b.column("id").cast(pa.int64())), held=one_list(b.column("held")), sizes=one_list(pa.array(sizes, pa.int64())))
            packed = packed_words(words, counts, parts)
            yield rows_of(STEPS, len(packed), step=[step] * len(packed), bucket=[x for x, _ in packed], words=[x for _, x in packed])

    return rows.mapInArrow(run, schema(STEPS))


def numbered(steps: DataFrame, parts: int) -> DataFrame:
    """Rows of steps as they were; the numbers and training counts of the words of each step, packed (known); and the vocabulary, with the number of its types by count, types and training tokens."""

    def bucket_rows(bucket: int, own: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = [unpacked_words(blob) for _, blob in own]
        code = pa.chunked_array([w for _, _, w in found]).combine_chunks().dictionary_encode()
        at, words = code.indices.to_numpy(), code.dictionary
        n = np.bincount(at, np.concatenate([x for _, x, _ in found]), len(words)).astype(np.int64)
        number = np.arange(len(words)) * parts + bucket
        for (step, _), (codes, _, _), places in zip(own, found, np.split(at, np.cumsum([len(w) for _, _, w in found])[:-1]), strict=True):
            order = np.argsort(places)
            places = places[order]
            yield rows_of(WORDS, 1, step=[step], known=[pack(codes[order], np.diff(number[places], prepend=0), n[places])])
        having = np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        vocabulary = pa.StructArray.from_arrays([pa.array(number), words, pa.array(n)], names=["id", "word", "n"])
        yield rows_of(WORDS, 1, having=one_list(pa.array(having, pa.int64())), types=[int((n > 0).sum())], tokens=[int(n.sum())], vocabulary=one_list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for b in batches:
            whole = b.filter(pc.is_valid(b.column("path")))
            yield rows_of(WORDS, whole.num_rows, **{c: whole.column(c) for c in ("step", "path", "ids", "held", "sizes")})
            for bucket, step, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "step", "words")), strict=True):
                if blob is not None:
                    if bucket != now and own:
                        yield from bucket_rows(now, own)
                        own = []
                    now = bucket
                    own.append((step, blob))
        if own:
            yield from bucket_rows(now, own)

    dealt = steps.repartition(parts, "bucket").sortWithinPartitions("bucket", "step")
    return materialise(dealt.mapInArrow(run, schema(WORDS)), "katz-words")


def pairs(codes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, documents: int, hot_from: float, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed pairs) of a step: contexts with their counts and runs, words with their counts, falling, and by pair and document the word, the document and how often."""
    ends = np.cumsum(sizes) - 1
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    before[1:] += 1
    before[ends + 1 - sizes] = 0  # the start
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    key = before * len(ids) + codes
    order = np.argsort(key, kind="stable")  # documents ascend already
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times, key, doc = np.diff(at, append=len(key)).astype(np.int32), key[at], doc[at]
    h, w = (key // len(ids)).astype(np.int32), (key % len(ids)).astype(np.int32)
    h_ids, h_counts = np.concatenate(([START], ids)), np.concatenate(([documents], counts))
    bucket = h_ids[h].astype(np.uint64)
    hot = h_counts[h] >= hot_from
    mixed = (bucket[hot] * np.uint64(0x9E3779B97F4A7C15) + ids[w[hot]].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    bucket[hot] = mixed ^ (mixed >> np.uint64(32))
    bucket = (bucket % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, h, w, doc, times = bucket[order], h[order], w[order], doc[order], times[order]
    at = starts_of(bucket)
    for lo, hi in zip(at, [*at[1:], len(bucket)], strict=True):
        hs, runs = np.unique(h[lo:hi], return_counts=True)
        ws, place = np.unique(w[lo:hi], return_inverse=True)
        falling = np.argsort(-counts[ws], kind="stable")
        rank = np.empty(len(ws), np.int64)
        rank[falling] = np.arange(len(ws))
        ws = ws[falling]
        yield int(bucket[lo]), pack(h_ids[hs] - START, h_counts[hs], runs, ids[ws], np.diff(counts[ws][::-1], prepend=0), rank[place], doc[lo:hi], times[lo:hi])


def dealt(steps: DataFrame, words: DataFrame, documents: int, hot_from: float, buckets: int, one: Unigrams) -> DataFrame:
    """(bucket, step, held, pairs), every row of a bucket in one task; and a row a step with held null, whose pairs are the known tokens and base score of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                with files.read_stream(b.column("path")[k].as_py()) as f:
                    (codes,) = unpack(f.read())
                known = [unpack(x) for x in b.column("known")[k].as_py()]
                code = np.concatenate([x for x, _, _ in known])
                ids, counts = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
                ids[code], counts[code] = np.concatenate([np.cumsum(x.astype(np.int64)) for _, x, _ in known]), np.concatenate([x for _, _, x in known])
                held = pack(b.column("held").slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.uint8))
                sizes = b.column("sizes").slice(k, 1).flatten().to_numpy()
                starts = np.cumsum(sizes) - sizes
                base = np.add.reduceat(one.base(counts)[codes], starts)
                own = pack(np.add.reduceat((counts > 0)[codes], starts, dtype=np.int64), base.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("step")[k].as_py() % buckets], pa.int32()), b.column("step").slice(k, 1), pa.nulls(1, pa.binary()), pa.array([own], pa.binary())], names=["bucket", "step", "held", "pairs"])
                for bucket, own in pairs(codes, sizes, ids, counts, documents, hot_from, buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), b.column("step").slice(k, 1), pa.array([held], pa.binary()), pa.array([own], pa.binary())], names=["bucket", "step", "held", "pairs"])

    known = words.filter("known is not null").groupBy("step").agg(F.collect_list("known").alias("known"))  # a row a bucket of words
    both = steps.select("step", "path", "held", "sizes").join(known, "step").select("step", "path", "held", "sizes", "known")
    return both.mapInArrow(run, "bucket int, step long, held binary, pairs binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "step")


# -- buckets


@dataclass
class Piece:
    """Pairs of some steps of a bucket: contexts and words with their counts, by pair the places of both and the training count, and the packed tokens."""

    h: np.ndarray
    h_n: np.ndarray
    w: np.ndarray
    w_n: np.ndarray
    context: np.ndarray
    word: np.ndarray
    count: np.ndarray
    tokens: bytes

    @classmethod
    def of(cls, rows: list[tuple]) -> Piece:
        parts = [(step, unpack(held)[0].astype(bool), *unpack(blob)) for step, held, blob in rows]
        joined = lambda k, kind=np.int64: np.concatenate([p[k].astype(kind) for p in parts])
        h, h_place, h_back = np.unique(joined(2) + START, return_index=True, return_inverse=True)
        w, w_place, w_back = np.unique(joined(5), return_index=True, return_inverse=True)
        h_n, w_n = joined(3)[h_place], np.concatenate([np.cumsum(p[6].astype(np.int64))[::-1] for p in parts])[w_place]
        cut = lambda back, k: np.split(back, np.cumsum([len(p[k]) for p in parts])[:-1])
        key = np.concatenate([np.repeat(hb, p[4]) * len(w) + wb[p[7]] for p, hb, wb in zip(parts, cut(h_back, 2), cut(w_back, 5), strict=True)])
        times = joined(9, np.int32)
        learned = np.concatenate([np.where(p[1][p[8]], 0, p[9]) for p in parts])
        docs = [np.unique(p[8], return_inverse=True) for p in parts]
        sizes = np.array([len(d) for d, _ in docs])
        doc = np.concatenate([(back + at).astype(np.int32) for (_, back), at in zip(docs, np.cumsum(sizes) - sizes, strict=True)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = starts_of(key)
        count = np.add.reduceat(learned[order], at, dtype=np.int64)
        tokens = pack(np.diff(at, append=len(key)), doc[order], times[order], np.array([p[0] for p in parts], np.int64), sizes, np.concatenate([d for d, _ in docs]))
        return cls(h, h_n, w, w_n, (key[at] // len(w)).astype(np.int32), (key[at] % len(w)).astype(np.int32), count, tokens)


def table_row(bucket: int, rows: list[tuple], hot_from: float, one: Unigrams, piece: int = PIECE_BYTES) -> pa.RecordBatch:
    """A bucket's row: types by count, hot contexts, the packed types, and the tokens by piece, with the places of the piece's types.

    Steps are unpacked some `piece` bytes at a time, so that a task holds the types of its bucket and the tokens of one piece.
    """
    bound = np.cumsum([struct.unpack_from("<q", blob)[0] for _, _, blob in rows]) // piece
    cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), len(rows)]
    found = [Piece.of(rows[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    h, h_place, h_back = np.unique(np.concatenate([p.h for p in found]), return_index=True, return_inverse=True)
    w, w_place, w_back = np.unique(np.concatenate([p.w for p in found]), return_index=True, return_inverse=True)
    h_n, w_n = np.concatenate([p.h_n for p in found])[h_place], np.concatenate([p.w_n for p in found])[w_place]
    cut = lambda back, sizes: np.split(back, np.cumsum(sizes)[:-1])
    keys = [hb[p.context] * len(w) + wb[p.word] for p, hb, wb in zip(found, cut(h_back, [len(p.h) for p in found]), cut(w_back, [len(p.w) for p in found]), strict=True)]
    key = np.unique(np.concatenate(keys)) if len(keys) > 1 else keys[0]
    count, tokens = np.zeros(len(key), np.int64), []
    for p, own in zip(found, keys, strict=True):
        place = np.searchsorted(key, own)
        count[place] += p.count
        tokens.append({"types": pack(np.diff(place, prepend=0)), "rows": p.tokens})
    context, word = (key // len(w)).astype(np.int32), (key % len(w)).astype(np.int32)
    having = np.bincount(np.minimum(count, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
    # What hot contexts have here: types of each discounted count, and unigram probability seen.
    crowded = np.flatnonzero(h_n >= hot_from)
    hot = []
    for c in crowded.tolist():
        lo, hi = np.searchsorted(context, [c, c + 1])
        own = count[lo:hi]
        hot.append({"h": int(h[c]), "total": int(h_n[c]), "having": [int((own == r).sum()) for r in range(1, DISCOUNTED + 1)], "seen": float(one.probability(w_n[word[lo:hi]])[own > 0].sum())})
    types = pack(h - START, np.bincount(context, minlength=len(h)), np.diff(w, prepend=0), w_n, word, count)
    return rows_of(TABLE, 1, bucket=[bucket], having=[having.tolist()], hot=[hot], types=[types], tokens=[tokens])


TABLE = {
    "bucket": pa.int32(), "having": pa.list_(pa.int64()), "hot": pa.list_(pa.struct([("h", pa.int64()), ("total", pa.int64()), ("having", pa.list_(pa.int64())), ("seen", pa.float64())])), "types": pa.binary(), "tokens": pa.list_(pa.struct([("types", pa.binary()), ("rows", pa.binary())])), "step": pa.int64(), "base": pa.binary(),
}


def tabled(rows: DataFrame, hot_from: float, one: Unigrams, piece: int = PIECE_BYTES) -> DataFrame:
    """The table of pairs (bucket, having, hot, types, tokens), a row a bucket, and what texts have by step (step, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for b in batches:
            for k in range(b.num_rows):
                bucket, step, held, blob = (b.column(c)[k].as_py() for c in range(4))
                if held is None:
                    yield rows_of(TABLE, 1, step=[step], base=[blob])
                    continue
                if bucket != now and own:
                    yield table_row(now, own, hot_from, one, piece)
                    own = []
                now = bucket
                own.append((step, held, blob))
        if own:
            yield table_row(now, own, hot_from, one, piece)

    return materialise(rows.mapInArrow(run, schema(TABLE)), "katz-pairs")


@dataclass
class Types:
    """The pairs of a bucket: contexts, each one's number of pairs, words and their counts, and by pair the word's place and the training count."""

    h: np.ndarray
    context: np.ndarray
    w: np.ndarray
    w_n: np.ndarray
    word: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, blob: bytes) -> Types:
        h, runs, w, w_n, word, count = unpack(blob)
        whole = [x.astype(np.int64) for x in (h, w, w_n, count)]
        return cls(whole[0] + START, np.repeat(np.arange(len(h), dtype=np.int32), runs), np.cumsum(whole[1]), whole[2], word, whole[3])


def logarithms(types: Types, one: Unigrams, d: np.ndarray, hot: dict[int, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 probability of each type of a bucket, and the denominators and backoff weights of its contexts.

    A pair that training has is its discounted share of the context; another is the context's backoff weight times the
    word's unigram probability.
    """
    p, n, h, context = one.probability(types.w_n)[types.word], types.count, types.h, types.context
    sums = lambda x: np.bincount(context, x, len(h))
    bottom, weight = backoff(sums(n), sums((1 - factor(d, n)) * n), sums(np.where(n > 0, p, 0.0)))
    for k in np.flatnonzero(np.isin(h, list(hot))).tolist():
        bottom[k], weight[k] = hot[int(h[k])]
    return np.log10(np.where(n > 0, factor(d, n) * n / bottom[context], weight[context] * p)), bottom, weight


@dataclass
class Model:
    """Tables (steps of texts, words, pairs by bucket) and constants (of the unigrams, discounts of pairs, denominators and weights of hot contexts)."""

    one: Unigrams
    d: np.ndarray
    hot: dict[int, tuple[float, float]]
    steps: DataFrame
    words: DataFrame
    table: DataFrame

    def vocabulary(self) -> DataFrame:
        """(id, word, n) of all words, those that training lacks with n = 0."""
        return self.words.select(F.inline("vocabulary"))

    def bigrams(self) -> DataFrame:
        """(h, w, n, log10_p, log10_weight): numbers of both words, training count, probability, and the context's backoff weight."""
        one, d, hot = self.one, self.d, self.hot

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for blob in b.column(0).to_pylist():
                    t = Types.of(blob)
                    p, _, weight = logarithms(t, one, d, hot)
                    on = t.count > 0
                    context = t.context[on]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (t.h[context], t.w[t.word[on]], t.count[on], p[on], np.log10(weight[context]))], names=["h", "w", "n", "log10_p", "log10_weight"])

        return self.table.filter("types is not null").select("types").mapInArrow(run, "h long, w long, n long, log10_p double, log10_weight double")

    def scores(self) -> DataFrame:
        """(id, held, n_tokens, n_known, base_score, score) of every text."""
        one, d, hot = self.one, self.d, self.hot

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What each bucket adds to the texts of a step, in whole UNITS."""
            for b in batches:
                for k in range(b.num_rows):
                    p = -logarithms(Types.of(b.column(0)[k].as_py()), one, d, hot)[0]
                    for piece in b.column(1)[k]:
                        (at,), (runs, doc, times, step, sizes, place) = unpack(piece["types"].as_py()), unpack(piece["rows"].as_py())
                        own = np.repeat(p[np.cumsum(at, dtype=np.int64)], runs)
                        own = np.bincount(doc, np.rint(own * times * UNITS), len(place)).astype(np.int64)
                        ends = np.cumsum(sizes.astype(np.int64))
                        yield pa.RecordBatch.from_arrays([pa.array(step.astype(np.int64)), pa.array([pack(place[e - n : e], own[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], names=["step", "part"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    ids, held, sizes = (b.column(c).slice(k, 1).flatten() for c in range(3))
                    known, base = unpack(b.column(3)[k].as_py())
                    score = np.zeros(len(sizes), np.int64)
                    for x in b.column(4)[k].as_py():
                        place, own = unpack(x)
                        score[place] += own.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([ids, held, sizes, pa.array(known.astype(np.int64)), pa.array(base.astype(np.int64).view(float)), pa.array(0.0 - score / UNITS)], names=["id", "held", "n_tokens", "n_known", "base_score", "score"])

        sums = self.table.filter("types is not null").select("types", "tokens").mapInArrow(parts, "step long, part binary").groupBy("step").agg(F.collect_list("part").alias("parts"))  # a row a bucket
        base = self.table.filter("base is not null").select("step", "base")
        rows = self.steps.select("step", "ids", "held", "sizes").join(base, "step").join(sums, "step").select("ids", "held", "sizes", "base", "parts")
        return rows.mapInArrow(whole, "id long, held boolean, n_tokens long, n_known long, base_score double, score double")


def train(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id", step_bytes: int = STEP_BYTES, bucket: int = BUCKET, hot: int = HOT, piece: int = PIECE_BYTES) -> Model:
    """A model of the texts that are not held, with all texts coded by it.

    Null and empty texts are the end alone. Every row is a text, repeated rows too; `held` null counts as held, ids may be
    null. Without training texts every word is unknown and has probability 1. Other columns are ignored; step_bytes,
    bucket, hot and piece change the way, not the result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(held, F.lit(True)).alias("held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = numbered(encoded(rows, step_bytes, parts), parts)
    steps = words.filter("path is not null")
    got = words.agg(F.sum("types"), F.sum("tokens"), *(F.sum(F.get("having", F.lit(k))) for k in range(DISCOUNTED + 1))).first()
    count = lambda x, c: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + c(y))
    documents, tokens = (x or 0 for x in steps.agg(F.sum(count("held", lambda x: F.when(x, 0).otherwise(1))), F.sum(count("sizes", lambda x: x))).first())
    one = Unigrams.of(got[1] or 0, got[0] or 0, [x or 0 for x in got[2:]])
    hot_from = max(one.tokens / hot, 1)
    buckets = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-tokens // bucket))
    table = tabled(dealt(steps, words, documents, hot_from, buckets, one), hot_from, one, piece)
    having = table.agg(*(F.sum(F.get("having", F.lit(k))) for k in range(DISCOUNTED + 1))).first()
    d = discounts([x or 0 for x in having])
    x = table.select(F.explode("hot").alias("x")).select("x.*")
    rows = x.groupBy("h").agg(F.max("total").alias("total"), F.sum("seen").alias("seen"), *(F.sum(F.get("having", F.lit(k))).alias(f"n{k + 1}") for k in range(DISCOUNTED))).collect()  # `hot` rows and one more at most
    weights = {}
    for r in rows:
        left = sum(k * r[f"n{k}"] * (1 - d[k]) for k in range(1, DISCOUNTED + 1))
        bottom, weight = backoff(np.array([r.total]), np.array([left]), np.array([r.seen]))
        weights[r.h] = (float(bottom[0]), float(weight[0]))
    return Model(one, d, weights, steps, words, table)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document, learned from those of which a tenth by a checksum of the id is held out."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    model = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), held)
    rows = model.scores().withColumn("train_tokens", F.lit(model.one.tokens).cast("long"))
    return rows.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
