"""Adaptive context-mixing range coder for token ids, in numpy: many independent blocks are coded in lockstep.

Orders 2 and 1 each predict an id: the one that followed the two ids, or the one, before most lately (hashed tables
with a confidence each, which one miss lowers before a second replaces the id). The two confidences, whether the
predictions agree and whether the last one was right choose adaptive probabilities that order 2 is right, and that
order 1 is where order 2 is not. What neither predicts is coded by order 0, a frequency table given with the data. A block starts from empty tables and fixed
probabilities, so each can be decoded alone. Ids are below LIMIT.
"""
from __future__ import annotations

import numpy as np

#: Ids of a block; bits of the order-2 and order-1 tables; sum of the order-0 frequencies as a power of two; ids.
BLOCK, BITS2, BITS1, SUM, LIMIT = 2048, 11, 10, 20, 1 << 16
#: Shift by which a probability, of 1 << 16, moves to what came; contexts of a block.
RATE, CONTEXTS = 5, 64
U = np.uint64
B16, B32, LOW32 = U(16), U(32), U((1 << 32) - 1)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Order-0 frequencies of the ids with a count, at least 1 each, summing to 1 << SUM."""
    total = int(counts.sum())
    out = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * ((1 << SUM) - len(counts)) // max(1, total)), 0)
    out[int(np.argmax(out))] += (1 << SUM) - int(out.sum())
    return out


class Model:
    """Tables of `lanes` blocks; predict() then update(), once an id."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2, self.base = lane << BITS1, lane << BITS2, lane * CONTEXTS
        self.one = np.zeros(lanes << BITS1, np.int32)  # confidence << 16 | id
        self.two = np.zeros(lanes << BITS2, np.int32)
        # Start: the more confident, the likelier; an order 1 that agrees with a wrong order 2 is wrong too.
        start, c = np.array([1 << 11, 1 << 14, 3 << 13, 7 << 12]), np.arange(CONTEXTS)
        self.odds2, self.odds1 = np.tile(start[c >> 2 & 3], lanes), np.tile(np.where(c >> 4 & 1, 128, start[c & 3]), lanes)
        self.last, self.before, self.right = (np.zeros(lanes, np.int64) for _ in range(3))

    def predict(self, n: int) -> tuple[np.ndarray, ...]:
        """Ids of orders 2 and 1, and their probabilities of 1 << 16."""
        h = self.last[:n] * 0x9E3779B1 & 0xFFFFFFFF
        self.at1 = (h >> (32 - BITS1)) + self.base1[:n]
        self.at2 = ((h + self.before[:n] & 0xFFFFFFFF) >> (32 - BITS2)) + self.base2[:n]
        self.before[:n] = h * 0x2C1B3C6D & 0xFFFFFFFF
        self.own1, self.own2 = self.one.take(self.at1), self.two.take(self.at2)
        p2, p1 = self.own2 & 0xFFFF, self.own1 & 0xFFFF
        self.row = ((self.own2 >> 16) << 2) + (self.own1 >> 16) + ((p2 == p1) * np.int32(16) + self.right[:n]) + self.base[:n]
        self.c2, self.c1 = self.odds2.take(self.row), self.odds1.take(self.row)
        return p2, p1, self.c2.view(U), self.c1.view(U)

    def update(self, n: int, ids: np.ndarray, is2: np.ndarray, is1: np.ndarray, p1: np.ndarray) -> None:
        self.odds2[self.row] = self.c2 + ((np.where(is2, 65400, 136) - self.c2) >> RATE)
        self.odds1[self.row] = self.c1 + ((np.where(is1, 65400, np.where(is2, self.c1, 136)) - self.c1) >> RATE)  # unasked where order 2 is right
        self.right[:n] = is2 * np.int32(32)
        for table, at, own, hit in ((self.two, self.at2, self.own2, is2), (self.one, self.at1, self.own1, p1 == ids)):
            table[at] = np.where(hit, np.minimum(own + 0x10000, ids | 0x30000), np.where(own >= 0x10000, own - 0x10000, ids))
        self.last[:n] = ids


def settle(low: np.ndarray, span: np.ndarray, emit) -> None:
    """Shift out 32 bits where the interval is narrow; it is cut at a boundary of 32 bits if it holds one, so that they are settled."""
    ready = np.flatnonzero(span <= LOW32)
    if len(ready):
        l, s = low[ready], span[ready]
        cut = (l ^ (l + s)) >> B32 != 0
        s[cut] = (~l[cut] + U(1)) & LOW32
        emit(ready, l)
        low[ready], span[ready] = l << B32, s << B32


def active(sizes: np.ndarray, t: int) -> int:
    return len(sizes) if sizes[-1] > t else int(np.searchsorted(-sizes, -t, "left"))


def encode(blocks: list[np.ndarray], freq: np.ndarray) -> list[bytes]:
    """Coded bytes of each block; blocks have BLOCK ids at most, and come longest first. freq: order 0, over all ids."""
    lanes, sizes = len(blocks), np.array([len(b) for b in blocks])
    steps = int(sizes[0]) if lanes else 0
    ids = np.zeros((steps, lanes), np.int32)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    edge, width = (np.cumsum(freq) - freq).astype(U), freq.astype(U)
    model = Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, ~U(0))
    out, used = np.zeros((lanes, 2 * steps + 4), np.uint32), np.zeros(lanes, np.int64)

    def emit(ready, l):
        out[ready, used[ready]] = (l >> B32).astype(np.uint32)
        used[ready] += 1

    with np.errstate(over="ignore"):
        for t in range(steps):
            n = active(sizes, t)
            x, l, s = ids[t, :n], low[:n], span[:n]
            p2, p1, odds2, odds1 = model.predict(n)
            is2 = x == p2
            is1 = (x == p1) & ~is2
            two = (s >> B16) * odds2
            rest = s - two
            one = (rest >> B16) * odds1
            l += np.where(is2, U(0), np.where(is1, two, two + one))
            s[:] = np.where(is2, two, np.where(is1, one, rest - one))
            none = np.flatnonzero(~(is2 | is1))
            part, own = s[none] >> U(SUM), x[none]
            l[none] += part * edge[own]
            s[none] = part * width[own]
            settle(l, s, emit)
            model.update(n, x, is2, is1, p1)
        for k in range(2):
            out[np.arange(lanes), used + k] = (low >> U(32 - 32 * k) & LOW32).astype(np.uint32)
    return [out[k, : used[k] + 2].astype(">u4").tobytes() for k in range(lanes)]


def decode(coded: list[bytes], sizes: list[int], freq: np.ndarray) -> list[np.ndarray]:
    """Blocks from their coded bytes and sizes, longest first."""
    lanes, count = len(coded), np.array(sizes)
    steps = int(count[0]) if lanes else 0
    data = np.zeros((lanes, max((len(c) // 4 for c in coded), default=0) + 4), U)
    for k, c in enumerate(coded):
        data[k, : len(c) // 4] = np.frombuffer(c, ">u4")
    ends = np.cumsum(freq)
    edge, width = (ends - freq).astype(U), freq.astype(U)
    place = np.repeat(np.arange(len(freq), dtype=np.int32), freq)  # the id at each of the 1 << SUM places
    model = Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, ~U(0))
    code = data[:, 0] << B32 | data[:, 1]
    used, most = np.full(lanes, 2), data.shape[1] - 1
    ids = np.zeros((steps, lanes), np.int32)

    def emit(ready, l):
        code[ready] = (code[ready] << B32) | data[ready, np.minimum(used[ready], most)]
        used[ready] += 1

    with np.errstate(over="ignore"):
        for t in range(steps):
            n = active(count, t)
            l, s = low[:n], span[:n]
            p2, p1, odds2, odds1 = model.predict(n)
            two = (s >> B16) * odds2
            rest = s - two
            one = (rest >> B16) * odds1
            both, gap = two + one, code[:n] - l
            is2 = gap < two
            is1 = (gap < both) & ~is2
            x = np.where(is2, p2, p1)
            l += np.where(is2, U(0), np.where(is1, two, both))
            s[:] = np.where(is2, two, np.where(is1, one, rest - one))
            none = np.flatnonzero(~(is2 | is1))
            part = np.maximum(s[none] >> U(SUM), U(1))
            own = place[np.minimum((gap[none] - both[none]) // part, U((1 << SUM) - 1)).astype(np.int64)]
            x[none] = own
            l[none] += part * edge[own]
            s[none] = part * width[own]
            settle(l, s, emit)
            ids[t, :n] = x
            model.update(n, x, is2, is1, p1)
    return [ids[: sizes[k], k] for k in range(lanes)]
