"""Byte-level BPE: a minimal perfect hash resolves pre-tokens that are in the vocabulary, a heap over linked bytes the rest.

The vocabulary's tables are a fixed size whatever the corpus (about 3 MB for 50,000 tokens), so they are broadcast.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmill.llm.common import IN_WORD, flat, lean, schema_of, slices, spread

M64 = (1 << 64) - 1
#: A pattern none of whose matches goes on over white space after other characters, so that a text can be cut before each run of it.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts whose chunks are looked up together, each different one once.
SLICE_BYTES = 1 << 20
#: Last bytes of white space outside ASCII, and those that come before them; control characters that are white space.
LAST, PENULTIMATE = (np.isin(np.arange(256), x) for x in ([*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF], [0xC2, 0x9A, 0x80, 0x81]))
CONTROL = np.isin(np.arange(256), range(0x1C, 0x20))
#: Pre-tokens remembered by a task, and by a worker that only digests, and the longest of them in characters.
MEMO, WORKER_MEMO, MEMO_CHARS = 1 << 18, 600_000, 64


class Vocabulary:
    """Token bytes to ids through a minimal perfect hash (hash and displace), ids to token bytes through a list."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        n = len(ranks)
        self.buckets, self.size = max(1, n // 3), n
        self.shift = [0] * self.buckets
        self.keys: list[bytes] = [b""] * n
        self.ids = [-1] * n
        self.bytes = {i: t for t, i in ranks.items()}
        self.recent: dict[bytes, int] = {}
        groups: list[list[tuple[int, bytes]]] = [[] for _ in range(self.buckets)]
        for t in ranks:
            h = xxhash.xxh3_128_intdigest(t)
            groups[(h & M64) % self.buckets].append((h >> 64, t))
        taken = bytearray(n)
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            if not groups[b]:
                break
            d = 0
            while True:
                slots = {self.slot(h, d) for h, _ in groups[b]}
                if len(slots) == len(groups[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for h, t in groups[b]:
                s = self.slot(h, d)
                taken[s], self.keys[s], self.ids[s] = 1, t, ranks[t]

    def slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
        return ((x * 0xD6E8FEB86659FD93 & M64) >> 32) % self.size

    def find(self, token: bytes) -> int:
        """Id of a token, -1 if there is none."""
        h = xxhash.xxh3_128_intdigest(token)
        s = self.slot(h >> 64, self.shift[(h & M64) % self.buckets])
        return self.ids[s] if self.keys[s] == token else -1

    def rank(self, piece: bytes) -> int:
        """As find, remembering what it found: the pieces that merges try recur."""
        r = self.recent.get(piece)
        if r is None:
            if len(self.recent) > MEMO:
                self.recent.clear()
            r = self.recent[piece] = self.find(piece)
        return r

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that is no token: the pair of lowest rank, leftmost first, merges until none is a token."""
        n, find = len(piece), self.rank
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))  # the symbol at i is piece[i:end[i]]; end 0: gone
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[i], end[j] = to, 0
            if to < n:
                left[to] = i
                if (r := find(piece[i : end[to]])) >= 0:
                    heapq.heappush(heap, (r, i, end[to]))
            if (k := left[i]) >= 0 and (r := find(piece[k:to])) >= 0:
                heapq.heappush(heap, (r, k, to))
        out, i = [], 0
        while i < n:
            out.append(find(piece[i : end[i]]))
            i = end[i]
        return tuple(out)

    def encode(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8")
        i = self.find(raw)
        return (i,) if i >= 0 else self.merge(raw)


def load(path: str) -> Vocabulary:
    """From a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})


def chunked(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts without nulls, cut before runs of ASCII white space that other characters precede, and the chunks of each text."""
    raw, offsets = flat(text)
    on = IN_WORD[raw]
    cut = np.flatnonzero(on[:-1] & ~on[1:]) + 1
    before = raw[cut - 1]
    suspect = LAST[before] & PENULTIMATE[raw[np.maximum(cut - 2, 0)]] | CONTROL[before]  # may be white space too: no cut
    new = np.zeros(len(raw), bool)
    new[cut[~suspect]] = True
    new[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(new)
    places = np.append(starts, len(raw)).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw.tobytes())])
    return chunks, np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=len(text))


class Encoder:
    """Texts to ids within a task."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, most: int = MEMO) -> None:
        self.vocabulary, self.split, self.wordwise, self.memo, self.most = vocabulary, regex.compile(pattern).findall, pattern == WORDWISE, {}, most

    def packed(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers."""
        memo, found = self.memo, []
        for t in self.split(text):
            x = memo.get(t)
            if x is None:
                own = self.vocabulary.encode(t)
                x = struct.pack(f"<{len(own)}I", *own)
                if len(t) <= MEMO_CHARS:
                    memo[t] = x
            found.append(x)
        return b"".join(found)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), "<u4").tolist()

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without nulls, one text after another, and how many each has. A different chunk is looked up once."""
        chunks, by_text = chunked(text) if self.wordwise else (text, np.ones(len(text), np.int64))
        code = chunks.dictionary_encode()
        found = list(map(self.packed, code.dictionary.to_pylist()))
        if len(self.memo) > self.most:
            self.memo.clear()
        ids, n = spread(found, code.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(by_text)]
        return ids.astype(np.int32), np.diff(ends, prepend=0)


WORKER: dict[str, Encoder] = {}


def worker_encoder(vocabulary: Vocabulary, pattern: str) -> Encoder:
    """The worker's own, so that tasks after the first find their pre-tokens encoded."""
    if pattern not in WORKER or WORKER[pattern].vocabulary.bytes != vocabulary.bytes:
        WORKER.clear()
        WORKER[pattern] = Encoder(vocabulary, pattern, WORKER_MEMO)
    return WORKER[pattern]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns of docs with the text's ids (array<int>) added or replaced; null and empty texts have none.

    `vocabulary` is the rank file's path on the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = [c for c in docs.columns if c != ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for part in slices(batches, "_bpe_text", SLICE_BYTES):
            own, n = encoder.batch(part.column(len(rest)))
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.ListArray.from_arrays(pa.array(offsets), pa.array(own))], names=[*rest, ids])

    kept = docs.select(*(F.col(f"`{c}`") for c in rest), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_bpe_text"))
    return kept.mapInArrow(lean(run), schema_of(docs, rest, **{ids: T.ArrayType(T.IntegerType())}))


def joined(values: pa.Array, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, list[int]]:
    """The ids' values one after another, and the places at which `ends` of the ids lie."""
    taken = values.take(pa.array(ids))
    _, offsets, raw = taken.buffers()
    return memoryview(raw or b""), np.frombuffer(offsets, np.int32)[ends].tolist() if len(ids) else [0] * len(ends)


def digests(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row the number of ids, the SHA-256 of the ids (decimal, comma-joined) and of the bytes that they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        known = encoder.vocabulary.bytes
        all_ids = range(max(known, default=-1) + 1)
        decimal, token = pa.array([f"{i},".encode() for i in all_ids], pa.binary()), pa.array([known.get(i) for i in all_ids], pa.binary())
        for b in slices(batches, "text", 8 * SLICE_BYTES):
            ids, n = encoder.batch(b.column(1))
            ends = np.concatenate(([0], np.cumsum(n)))
            raw, at = joined(decimal, ids, ends)
            own = [hashlib.sha256(raw[lo : max(lo, hi - 1)]).hexdigest() for lo, hi in zip(at, at[1:], strict=False)]  # without the last comma
            raw, at = joined(token, ids, ends)
            back = [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All rows and columns of tokens with the bytes that their ids stand for; no ids give empty bytes, unknown ids an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = [c for c in tokens.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.bytes
        for b in batches:
            own = pa.array([b"".join(known[i] for i in x or ()) for x in b.column(len(rest)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], own], names=[*rest, out])

    kept = tokens.select(*(F.col(f"`{c}`") for c in rest), F.col(ids).cast("array<int>").alias("_bpe_ids"))
    return kept.mapInArrow(run, schema_of(tokens, rest, **{out: T.BinaryType()}))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document encoded and decoded."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, source, ids and their number for every row; null and empty texts have no ids, repeated rows stay."""
    import public_tokenizers

    out = encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")
