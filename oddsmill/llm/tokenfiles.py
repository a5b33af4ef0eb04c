"""Token-id files: ids in ascending doc_id order, range-coded in independent, checksummed blocks.

A file: MAGIC; a header (JSON: vocabulary size, order-0 frequencies' length) and the frequencies, zlib-packed; blocks,
each with its number of ids, coded length and CRC-32 of the ids; a table of (doc_id, number of ids), zlib-packed with
a CRC-32; and the table's offset. A task writes one file or more, each of FILE_IDS ids or so, and holds one at a time.
"""
from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm import files, rangecoder
from oddsmill.llm.common import IN_WORD, flat, materialise, scratch, slices, spread

MAGIC = b"OMTOK002"
#: Ids after which a file is closed, text bytes that a task encodes, pieces whose ids a worker remembers, blocks coded at a time.
FILE_IDS, TASK_BYTES, MEMO, LANES = 9_000_000, 20 << 20, 600_000, 8192
#: Bytes of texts whose pieces are looked up together, each different one once.
SLICE_BYTES = 8 << 20
#: Pieces of letters that reach the tokenizer in one string.
TOGETHER = 64
NO_ID = -(1 << 63)  # stands for a null doc_id in a file's table
#: Kinds of bytes: of ASCII, letters 1, digits 2, marks 3, apostrophes 4; white space 5; what else may be in a word 0.
KIND = np.array([5 if not w else 4 if b == 39 else 3 if 33 <= b <= 126 else 0 for b, w in enumerate(IN_WORD.tolist())], np.uint8)
KIND[[*range(65, 91), *range(97, 123)]], KIND[48:58] = 1, 2
#: Whether a piece starts at the second of two bytes of these kinds (first << 3 | second): after white space, or between two
#: ASCII characters at a change between letters, digits and marks, and around each digit, where the pre-tokeniser cuts
#: too; never between an apostrophe and a letter, which may be a contraction.
STARTS = np.zeros(64, bool)
STARTS[[5 << 3 | k for k in range(5)]] = True
STARTS[[i << 3 | j for i, j in [(1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (4, 2)]]] = True


def pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces of texts without nulls, one text after another, and the place of each one's text."""
    raw, offsets = flat(text)
    kind = KIND[raw]
    on = kind != 5
    starts = on.copy()
    starts[1:] = STARTS[kind[:-1] << 3 | kind[1:]]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = on[first]  # a piece ends with its text
    begin, kept = np.flatnonzero(starts), np.cumsum(on, dtype=np.int32)
    places = np.concatenate((kept[begin] - 1, kept[-1:] if len(kept) else [0])).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(raw[on].tobytes())])
    return out, np.searchsorted(offsets, begin, "right") - 1


class Tokens:
    """Ids of texts by a tokenizers file whose pre-tokeniser never crosses ASCII white space: piece by piece, each different one once in a slice.

    Texts are cut into pieces that the pre-tokeniser separates as well, and only new ones reach the tokenizer. A
    text that may hold an added token, such as <|endoftext|>, is encoded whole: the ids are the library's own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Added tokens stand for themselves wherever their text is, across white space and pieces; any case, as a normaliser may change it.
        added = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added), re.IGNORECASE) if added else None
        self.size = self.tokenizer.get_vocab_size()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.final = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(self.size)])  # ids that end a pre-token
        self.memo: dict[bytes, bytes] = {}  # ids of pieces met of late
        self.older: dict[bytes, bytes] = {}  # and of those before

    def learn(self, new: list[bytes]) -> None:
        """Encode new pieces: those of letters many at a time, as each holds a pre-token or more, so that equal numbers mean one each."""
        texts = [x.decode("utf-8", "replace") for x in new]
        words, alone = [], []
        for k, w in enumerate(texts):
            (words if w.isalpha() else alone).append(k)
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = ((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()
            if len(ends) != len(g):
                alone += g
                continue
            packed = ids.tobytes()
            self.memo.update(zip([new[k] for k in g], [packed[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], strict=True))
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False), strict=True):
            i = e.ids
            self.memo[new[k]] = struct.pack(f"<{len(i)}I", *i)

    def ids(self, texts: list[bytes], end: int) -> list[bytes]:
        """Ids of each text (UTF-8) and the end id, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO // 2:  # pieces that recur stay
            self.older, self.memo = self.memo, {}
        collecting = gc.isenabled()
        gc.disable()  # nothing below is cyclic, and each collection would go through the memo
        try:
            return self._ids(texts, end)
        finally:
            if collecting:
                gc.enable()

    def _ids(self, texts: list[bytes], end: int) -> list[bytes]:
        whole = {k for k, t in enumerate(texts) if self.added and self.added.search(t)}
        cut, doc = pieces(pa.array([b"" if k in whole else t for k, t in enumerate(texts)], pa.binary()))
        code = cut.dictionary_encode()
        different = code.dictionary.to_pylist()
        found = list(map(self.memo.get, different))
        for k in [k for k, x in enumerate(found) if x is None]:
            if (x := self.older.get(different[k])) is not None:
                found[k] = self.memo[different[k]] = x
        missing = [k for k, x in enumerate(found) if x is None]
        for at in range(0, len(missing), 20_000):
            self.learn([different[k] for k in missing[at : at + 20_000]])
        for k in missing:
            found[k] = self.memo[different[k]]
        ids, n = spread(found, code.indices.to_numpy())
        ends = np.cumsum(np.bincount(doc, n, len(texts)).astype(np.int64)) * 4
        last, raw = struct.pack("<I", end), ids.tobytes()
        out = [raw[lo:hi] + last for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
        for k in whole:
            ids = self.tokenizer.encode(texts[k].decode("utf-8", "replace"), add_special_tokens=False).ids
            out[k] = struct.pack(f"<{len(ids)}I", *ids) + last
        return out


WORKER: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """The worker's own, so that tasks after the first find their pieces encoded."""
    if path not in WORKER:
        WORKER.clear()
        WORKER[path] = Tokens(path)
    return WORKER[path]


def write_file(uri: str, docs: list[tuple[int | None, bytes]], vocabulary: int) -> int:
    """Write documents' ids; returns their number. A vocabulary that the coder cannot hold is refused."""
    if vocabulary > rangecoder.LIMIT:
        raise ValueError(f"{vocabulary} ids; the coder takes {rangecoder.LIMIT} at most")
    ids = np.frombuffer(b"".join(x for _, x in docs), "<i4")
    freq = rangecoder.frequencies(np.bincount(ids, minlength=vocabulary))
    with files.write_stream(uri) as out:
        packed = zlib.compress(freq.astype("<u4").tobytes(), 6)
        head = MAGIC + struct.pack("<IIII", vocabulary, rangecoder.BLOCK, len(packed), zlib.crc32(packed)) + packed
        out.write(head)
        at, blocks = len(head), [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)]
        for k in range(0, len(blocks), LANES):
            some = blocks[k : k + LANES]
            for b, coded in zip(some, rangecoder.encode(some, freq), strict=True):
                out.write(struct.pack("<III", len(b), len(coded), zlib.crc32(b.astype("<u4").tobytes())) + coded)
                at += 12 + len(coded)
        table = np.array([(NO_ID if i is None else i, len(x) // 4) for i, x in docs], "<i8").tobytes()
        packed = zlib.compress(table, 6)
        out.write(struct.pack("<II", len(packed), zlib.crc32(packed)) + packed + struct.pack("<Q", at) + MAGIC)
    return len(ids)


def read_file(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in the file's order; a checksum that does not hold is an error."""
    with files.read_file(uri) as source:
        raw = source.read()
    if raw[: len(MAGIC)] != MAGIC or raw[-len(MAGIC) :] != MAGIC:
        raise ValueError(f"{uri} is no token file")
    _, _, size, crc = struct.unpack_from("<IIII", raw, 8)
    packed = raw[24 : 24 + size]
    if zlib.crc32(packed) != crc:
        raise ValueError(f"{uri}: checksum of the frequencies")
    freq = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    (end,) = struct.unpack_from("<Q", raw, len(raw) - 16)
    size, crc = struct.unpack_from("<II", raw, end)
    packed = raw[end + 8 : end + 8 + size]
    if zlib.crc32(packed) != crc:
        raise ValueError(f"{uri}: checksum of the documents")
    table = np.frombuffer(zlib.decompress(packed), "<i8").reshape(-1, 2).tolist()

    def groups() -> Iterator[np.ndarray]:
        at, found = 24 + struct.unpack_from("<I", raw, 16)[0], []
        while at < end or found:
            if at < end:
                n, length, crc = struct.unpack_from("<III", raw, at)
                found.append((n, raw[at + 12 : at + 12 + length], crc))
                at += 12 + length
            if found and (at >= end or len(found) == LANES):
                blocks = rangecoder.decode([c for _, c, _ in found], [n for n, _, _ in found], freq)
                for b, (_, _, crc) in zip(blocks, found, strict=True):
                    if zlib.crc32(b.astype("<u4").tobytes()) != crc:
                        raise ValueError(f"{uri}: checksum of a block")
                yield np.concatenate(blocks)
                found = []

    source, held = groups(), np.zeros(0, np.int32)
    for doc, n in table:
        while len(held) < n:
            held = np.concatenate([held, next(source)])
        yield (None if doc == NO_ID else doc), held[:n]
        held = held[n:]


def write(docs: DataFrame, uri: str, tokenizer: str, end: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write all documents' ids under uri in ascending doc_id order; (place, path, n_docs, n_ids), in order by place.

    Null texts count as empty and hold the end id alone. Null doc_ids come first; equal ones are in the order of their
    texts. `tokenizer` is the file's path, the same on all machines.
    """
    files.make_dir(uri)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    n = max(1, (rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0) // TASK_BYTES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), tokens(tokenizer)
        held: list[tuple[int | None, bytes]] = []
        size, place = 0, 0

        def close() -> pa.RecordBatch:
            path = files.new_name(uri, f"tokens-{part:06d}-{place:04d}", ".bin")
            count = write_file(path, held, own.size)
            return pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + place], pa.int64()), pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([count], pa.int64())], names=["place", "path", "n_docs", "n_ids"])

        for some in slices(batches, "t", SLICE_BYTES):
            for i, x in zip(some.column(0).to_pylist(), own.ids(some.column(1).cast(pa.binary()).to_pylist(), end), strict=True):
                held.append((i, x))
                size += len(x) // 4
                if size >= FILE_IDS:
                    yield close()
                    held, size, place = [], 0, place + 1
        if held:
            yield close()

    ordered = rows.repartitionByRange(int(n), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "t")
    return materialise(ordered.mapInArrow(run, "place long, path string, n_docs long, n_ids long"), "token-manifest")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files, start being the ids of all before it."""
    n = max(1, manifest.count())
    before = F.sum("n_ids").over(Window.orderBy("place")) - F.col("n_ids")  # a row for each file
    listed = manifest.select("path", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out: list[tuple] = []

                def batch() -> pa.RecordBatch:
                    columns = list(zip(*out, strict=True)) or [()] * (4 + with_ids)
                    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.list_(pa.int32())) for c in columns[4:])], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

                for doc, ids in read_file(path):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids] if with_ids else [])))
                    start += len(ids)
                    if len(out) == 2000:
                        yield batch()
                        out = []
                yield batch()

    return listed.coalesce(1).repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document as it comes back from the token files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(write(docs, scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2))
