"""Baseline JPEG columns: Huffman-coded scans are decoded in numpy to DC-only luminance thumbnails.

The DC coefficient of a block is its mean, so the thumbnail has a pixel for each 8 x 8 block. Blocks of restart
intervals and of images with the same tables are decoded in lockstep: a look-up of 16 bits gives a block whose AC part
is empty at once, and a scalar path takes the others. Any bytes can be kept as the blocks' means (flat blocks with a
DC quantiser of 8 hold 8-bit values exactly), so a payload comes back whole from its thumbnail.
"""
from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmill.llm.common import schema_of

#: Samples of a payload's row, rows of an image at most (a side has 65,535 pixels at most), payload bytes coded at a time.
ROW, MAX_ROWS, GROUP = 192, 8191, 1 << 19

# The luminance DC table of the JPEG standard (code counts by length, symbols).
DC_COUNTS, DC_SYMBOLS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
#: Flat blocks need no AC symbol but the end of block: one bit.
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)


def codes(counts, symbols) -> Iterator[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    code, k = 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            yield symbols[k], code, length
            code, k = code + 1, k + 1
        code <<= 1


def lookup(counts, symbols) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that 16 bits begin with; length 0: none."""
    size, value = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for symbol, code, length in codes(counts, symbols):
        at = slice(code << (16 - length), (code + 1) << (16 - length))
        size[at], value[at] = length, symbol
    return size, value


def flat_blocks(dc, ac) -> tuple[np.ndarray, np.ndarray]:
    """Bits of a whole block and DC difference for 16 bits that hold it with no AC coefficient; bits 0 where they don't."""
    bits = np.arange(1 << 16)
    size, s = dc
    used = size + s
    fits = (size > 0) & (used < 16)
    raw = np.where(fits, (bits >> np.clip(16 - used, 0, 16)) & ((1 << s) - 1), 0)
    diff = np.where((s > 0) & (raw < (1 << np.maximum(s - 1, 0))), raw - (1 << s) + 1, raw)
    rest = (bits << np.where(fits, used, 0)) & 0xFFFF
    fits &= (ac[0][rest] > 0) & (ac[1][rest] == 0) & (used + ac[0][rest] <= 16)
    return np.where(fits, used + ac[0][rest], 0), diff


def _encoding() -> tuple[np.ndarray, np.ndarray]:
    """Code of a flat block and its length by DC difference + 255."""
    table = {s: (c, n) for s, c, n in codes(DC_COUNTS, DC_SYMBOLS)}
    code, size = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        c, n = table[s]
        code[d + 255] = ((c << s) | (d if d >= 0 else d + (1 << s) - 1)) << 1
        size[d + 255] = n + s + 1
    return code, size


CODE, SIZE = _encoding()


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def head(rows: int) -> bytes:
    """Markers up to the scan of a one-component image, ROW blocks wide, restarted after every row of blocks."""
    return b"".join((
        b"\xff\xd8",
        segment(0xDB, b"\0" + bytes([8] * 64)),
        segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)),
        segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS)),
        segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS)),
        segment(0xDD, struct.pack(">H", ROW)),
        segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def coded_rows(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each row of samples (n, ROW), stuffed, without restart markers."""
    d = samples.astype(np.int64)
    d[:, 1:] -= samples[:, :-1]
    d[:, 0] -= 128
    d += 255
    size, code = SIZE[d], CODE[d]
    ends = np.cumsum(size, axis=1)
    length = (ends[:, -1] + 7) >> 3
    start = np.cumsum(length) - length
    at = (start[:, None] << 3) + ends - size
    code <<= 24 - size - (at & 7)
    at >>= 3
    at, code = at.ravel(), code.ravel()
    total = int(length.sum())
    out = np.bincount(at, code >> 16, total + 3)
    out[1:] += np.bincount(at, (code >> 8) & 255, total + 2)
    out[2:] += np.bincount(at, code & 255, total + 1)
    pad = (length << 3) - ends[:, -1]
    out[start + length - 1] += (1 << pad) - 1
    raw = out[:total].astype(np.uint8).tobytes()
    return [raw[s:e].replace(b"\xff", b"\xff\x00") for s, e in zip(start.tolist(), (start + length).tolist(), strict=True)]


RESTART = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def image(rows: list[bytes]) -> bytes:
    body = [x for k, r in enumerate(rows) for x in (r, RESTART[k % 8])][:-1]
    return head(len(rows)) + b"".join(body) + b"\xff\xd9"


def padded(data: bytes) -> bytes:
    """Data with spaces appended up to a positive multiple of ROW."""
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def store(payloads: list[bytes]) -> list[bytes]:
    """JPEG bytes of each payload (its length a positive multiple of ROW); one image, or several in a row for a long one."""
    out: list[list[bytes]] = [[] for _ in payloads]
    rows = [r for r, p in enumerate(payloads) for _ in range(len(p) // ROW)]
    data, done = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW), 0
    while done < len(data):
        part = data[done : done + GROUP // ROW]
        for r, coded in zip(rows[done : done + len(part)], coded_rows(part), strict=True):
            out[r].append(coded)
        done += len(part)
    return [b"".join(image(x[k : k + MAX_ROWS]) for k in range(0, len(x), MAX_ROWS)) for x in out]


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quantiser: int
    blocks: np.ndarray | None = None


@dataclass
class Scan:
    pattern: list[tuple[Component, int, int]]  # a component's block and its place within the unit, unit by unit
    tables: list[tuple]  # (DC, AC) definitions by block of the pattern
    across: int
    units: int
    intervals: list[bytes]
    restart: int


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)

    def thumbnail(self) -> np.ndarray:
        """Luminance means of the blocks, 8 bits."""
        y = self.components[0]
        q = int(self.quantisers[y.quantiser][0])
        most_h, most_v = max(c.h for c in self.components), max(c.v for c in self.components)
        high, wide = -(-self.height * y.v // (8 * most_v)), -(-self.width * y.h // (8 * most_h))
        return np.clip((y.blocks[:high, :wide] * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)


MARK = re.compile(rb"\xff+([^\x00\xff])", re.DOTALL)
SPLIT = re.compile(rb"\xff+[\xd0-\xd7]")


def parse(data: bytes) -> list[Image]:
    """Images in data, one after the other, with their scans' intervals unstuffed; progressive and 12-bit ones are an error."""
    images: list[Image] = []
    huffman: dict[int, tuple] = {}
    restart, at, now = 0, 0, None
    while m := MARK.match(data, at):
        kind, at = m[1][0], m.end()
        if kind == 0xD8:
            now, restart, huffman = Image(), 0, {}
            images.append(now)
            continue
        if kind == 0xD9:
            continue
        if now is None:
            raise ValueError("no JPEG")
        (length,) = struct.unpack_from(">H", data, at)
        body, at = data[at + 2 : at + length], at + length
        if kind == 0xDB:
            while body:
                wide, ident = body[0] >> 4, body[0] & 15
                now.quantisers[ident] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                body = body[129 if wide else 65 :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (tuple(body[1:17]), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            bits, now.height, now.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError(f"{bits} bits a sample")
            now.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_h, most_v = max(c.h for c in now.components), max(c.v for c in now.components)
            across, down = -(-now.width // (8 * most_h)), -(-now.height // (8 * most_v))
            for c in now.components:
                c.blocks = np.zeros((down * c.v, across * c.h), np.int64)
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError(f"frame type {kind:#x} is not baseline")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif kind == 0xDA:
            by_id = {c.ident: c for c in now.components}
            chosen = [(by_id[body[1 + 2 * k]], body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)) for k in range(body[0])]
            most_h, most_v = max(c.h for c in now.components), max(c.v for c in now.components)
            if len(chosen) == 1:  # a unit is a block
                c, dc, ac = chosen[0]
                across, down = -(-now.width * c.h // (8 * most_h)), -(-now.height * c.v // (8 * most_v))
                pattern, tables = [(c, 0, 0)], [(huffman[dc], huffman[ac])]
            else:
                across, down = -(-now.width // (8 * most_h)), -(-now.height // (8 * most_v))
                pattern = [(c, y, x) for c, _, _ in chosen for y in range(c.v) for x in range(c.h)]
                tables = [(huffman[dc], huffman[ac]) for c, dc, ac in chosen for _ in range(c.v * c.h)]
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and (end + 1 < len(data)) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7 or data[end + 1] == 0xFF):
                end += 2 if data[end + 1] != 0xFF else 1
            if end < 0:
                end = len(data)
            parts = SPLIT.split(data[at:end]) if restart else [data[at:end]]
            now.scans.append(Scan(pattern, tables, across, across * down, [p.replace(b"\xff\x00", b"\xff") for p in parts], restart or across * down))
            at = end
    return images


def scalar_block(buf: np.ndarray, bit: int, dc, ac) -> tuple[int, int]:
    """Bits of a block and its DC difference, code by code."""

    def peek(at: int) -> int:
        b = at >> 3
        return (int(buf[b]) << 16 | int(buf[b + 1]) << 8 | int(buf[b + 2])) >> (8 - (at & 7)) & 0xFFFF

    first, bits = bit, peek(bit)
    if not dc[0][bits]:
        raise ValueError("no Huffman code")
    s = int(dc[1][bits])
    bit += int(dc[0][bits])
    raw = peek(bit) >> (16 - s) if s else 0
    diff = raw - (1 << s) + 1 if s and raw < 1 << (s - 1) else raw
    bit, k = bit + s, 1
    while k < 64:
        bits = peek(bit)
        if not ac[0][bits]:
            raise ValueError("no Huffman code")
        run, s = divmod(int(ac[1][bits]), 16)
        bit += int(ac[0][bits]) + s
        if not s and run < 15:
            break
        k += run + 1
    return bit - first, diff


TABLES: dict[tuple, tuple] = {}


def tables_of(definition: tuple) -> tuple:
    if definition not in TABLES:
        if len(TABLES) > 64:
            TABLES.clear()
        dc, ac = lookup(*definition[0]), lookup(*definition[1])
        TABLES[definition] = (dc, ac, *flat_blocks(dc, ac))
    return TABLES[definition]


def decode(scans: list[Scan]) -> None:
    """Fill the blocks of scans with the same pattern of tables; their intervals run in lockstep."""
    lanes = [(s, k, min(s.restart, s.units - k * s.restart)) for s in scans for k in range(-(-s.units // s.restart))]
    lanes.sort(key=lambda x: -x[2])
    data = [s.intervals[k] if k < len(s.intervals) else b"" for s, k, _ in lanes]
    sizes = np.array([len(d) + 4 for d in data])
    buf = np.frombuffer(b"".join(d + b"\xff\xff\xff\xff" for d in data) + b"\xff" * 8, np.uint8)
    window = (buf[:-2].astype(np.int32) << 16) | (buf[1:-1].astype(np.int32) << 8) | buf[2:]
    bit = (np.cumsum(sizes) - sizes) << 3
    limit = bit + ((sizes + 4) << 3)
    counts = np.array([n for _, _, n in lanes])
    width = len(scans[0].pattern)
    distinct = list(dict.fromkeys(c.ident for c, _, _ in scans[0].pattern))
    order = [distinct.index(c.ident) for c, _, _ in scans[0].pattern]
    own = [tables_of(t) for t in scans[0].tables]
    last = np.zeros((max(order) + 1, len(lanes)), np.int64)
    found = np.zeros((width, int(counts[0]), len(lanes)), np.int32)
    for unit in range(int(counts[0])):
        n = int(np.searchsorted(-counts, -unit, "left")) if counts[-1] <= unit else len(lanes)
        for b in range(width):
            dc, ac, size, diff = own[b]
            at = bit[:n]
            bits = (window[at >> 3] >> (8 - (at & 7))) & 0xFFFF
            used, step = size[bits], diff[bits]
            if not used.all():
                for lane in np.flatnonzero(used == 0).tolist():
                    used[lane], step[lane] = scalar_block(buf, int(at[lane]), dc, ac)
            bit[:n] += used
            if (bit[:n] > limit[:n]).any():
                raise ValueError("scan ends early")
            last[order[b], :n] += step
            found[b, unit, :n] = last[order[b], :n]
    for lane, (s, k, n) in enumerate(lanes):
        unit = np.arange(k * s.restart, k * s.restart + n)
        for b, (c, y, x) in enumerate(s.pattern):
            v, h = (c.v, c.h) if width > 1 else (1, 1)
            c.blocks[unit // s.across * v + y, unit % s.across * h + x] = found[b, :n, lane]


def thumbnails(media: list[bytes | None]) -> list[list[tuple[int, int, np.ndarray]]]:
    """(width, height, luminance thumbnail) of each image in each value; none for null."""
    images = [parse(m) if m else [] for m in media]
    groups: dict[tuple, list[Scan]] = {}
    for own in images:
        for im in own:
            for s in im.scans:
                groups.setdefault((tuple(s.tables), tuple(c.ident for c, _, _ in s.pattern)), []).append(s)
    for scans in groups.values():
        part, size = [], 0
        for s in scans:
            part.append(s)
            size += s.units * len(s.pattern)
            if size >= GROUP:
                decode(part)
                part, size = [], 0
        if part:
            decode(part)
    return [[(im.width, im.height, im.thumbnail()) for im in own] for own in images]


#: What damaged bytes raise while they are parsed or decoded.
DAMAGE = (ValueError, IndexError, KeyError, AttributeError, OverflowError, MemoryError, struct.error)


def readable(media: list[bytes | None]) -> tuple[list[list[tuple[int, int, np.ndarray]]], list[str | None]]:
    """thumbnails() of each value, and what is wrong with it: a value that is no baseline JPEG has none and spoils no other."""
    try:
        own = thumbnails(media)
    except DAMAGE as e:
        if len(media) == 1:
            return [[]], [f"{type(e).__name__}: {e}"]
        parts = [readable([m]) for m in media]
        return [x[0] for x, _ in parts], [e[0] for _, e in parts]
    return own, ["ValueError: no JPEG" if m is not None and not x else None for m, x in zip(media, own, strict=True)]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: whether a cell of an 8 x 8 grid (all its samples averaged) is lighter than their mean; under 8 rows or columns repeat."""
    cells = thumb
    for axis, n in enumerate(thumb.shape):
        edges = (np.arange(8) * n) // 8
        share = np.maximum(1, np.diff([*edges, n]))
        cells = np.add.reduceat(cells, edges, axis=axis, dtype=np.float64) / (share[:, None] if axis == 0 else share)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def batched(values: list[bytes], most: int = 4 * GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of values of about `most` bytes each, one value at least."""
    start, size = 0, 0
    for k, v in enumerate(values):
        size += len(v)
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(values):
        yield start, len(values)


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes as the block means of baseline JPEG; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            for s, e in batched(raw):
                media = store([padded(x) for x in raw[s:e]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array([len(x) for x in raw[s:e]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


IMAGES = T.ArrayType(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("hash", T.StringType())]))


def described(rows: DataFrame, media: str = "media") -> DataFrame:
    """All rows and columns with images array<struct<width, height, hash>>, samples (the thumbnails' bytes) and error of a JPEG column.

    A null has no images, null samples and no error. Bytes that are no baseline JPEG, or damaged ones, have null images,
    null samples and the reason in error, and the other rows are not affected. Columns named as these are replaced.
    """
    names = [c for c in rows.columns if c not in ("images", "samples", "error")]
    at = names.index(media)
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("hash", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(at).to_pylist()
            for s, e in batched([v or b"" for v in values]):
                own, wrong = readable(values[s:e])
                images = pa.array([None if x else [{"width": w, "height": h, "hash": thumbnail_hash(t)} for w, h, t in i] for i, x in zip(own, wrong, strict=True)], kind)
                samples = pa.array([b"".join(t.tobytes() for _, _, t in i) if v is not None and not x else None for i, v, x in zip(own, values[s:e], wrong, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(s, e - s) for c in b.columns), images, samples, pa.array(wrong, pa.string())], names=[*names, "images", "samples", "error"])

    return rows.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema_of(rows, names, images=IMAGES, samples=T.BinaryType(), error=T.StringType()))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: payload digests and thumbnail features of every document, from the stored JPEG."""
    rows = described(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    tail = F.substring("samples", -16, 16)
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("images", lambda x: F.concat_ws(":", F.concat_ws("x", x.width, x.height), x.hash)), ",").alias("feature"),
    )
