"""Repeated passages: suffix automata of reference shards, matching statistics of the documents streamed through them.

Every document is reference for those with larger ids, so the reference is the corpus itself and no automaton of it
can be broadcast. It is cut into shards instead, and only what can match a shard is sent to it: every window of WINDOW
words belongs to the shard of its anchor (the least hash of the GRAM-word sequences in it), which equal windows share.
A first pass counts the anchors; a second ships the runs of windows whose anchor occurs more than once, with their
words and once only, to the shard of the anchor, in ascending doc_id order. There each run is matched against the
automaton of those from smaller ids, then added to it unless the automaton knew all of its windows.

Anchors in more than HOT documents would make large shards. Their windows are compared by the 128-bit digest of their
words instead: the least doc_id of each digest is aggregated, in the tasks that read the texts first. All other removals are decided by words; hashes
route, and tell apart rows with one doc_id (by the 64-bit hash of their text).

Repeated anchors are known to all tasks as a bitmap with BITS_AN_ANCHOR bits each, up to BITS in all. A corpus with
more of them ships all runs and drops those of other anchors by a semi join in the same shuffle.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import materialise

WINDOW, GRAM = 13, 7
#: Bits of an anchor bitmap at most (16 MB), and for each anchor; documents of an anchor that is hot.
BITS, BITS_AN_ANCHOR, HOT = 1 << 27, 16, 4000
#: Words of a broadcast reference at most (a word takes some 600 bytes in an automaton) and of one of its shards.
REFERENCE_WORDS, SHARD_WORDS = 400_000, 100_000
#: Bytes of text that a task takes at a time, hot windows that it combines before they are shuffled.
STEP_BYTES, COMBINE = 1 << 19, 1 << 18
#: Hot windows up to so many are sent to every task (24 bytes each), more are joined by shuffle.
HOT_WINDOWS = 1 << 18
BYTE_HASH, PLACE_HASH = (np.random.default_rng(k).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for k, n in ((1, 256), (2, 1024)))
BYTE_HASH[32] = 0  # the space behind a word: the last word of a part has none


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return mixed(out)


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each of the words [start, end) of a byte buffer: a sum over its bytes, weighted by their places; of the word alone, wherever it stands."""
    out = np.zeros(len(start), np.uint64)
    cuts = [*np.unique(np.searchsorted(start, np.arange(0, len(buffer), STEP_BYTES // 2))).tolist(), len(start)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            at = start[lo:hi] - start[lo]
            part = buffer[start[lo] : end[hi - 1]]
            place = np.arange(len(part)) - np.repeat(at, np.diff(at, append=len(part)))
            out[lo:hi] = np.add.reduceat(BYTE_HASH[part] * PLACE_HASH[place & 1023], at)
    return mixed(out)


class Words:
    """The words of several texts, one space between them, and what is known of the window that starts at each."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        texts = [b" ".join(t.split()) for t in texts]
        counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.buffer, self.window = b" ".join(t for t in texts if t), window
        self.start = np.cumsum(counts) - counts  # first word of each text
        raw = np.frombuffer(self.buffer, np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.begin, self.end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        n = max(0, int(counts.sum()) - window + 1)
        self.doc = np.repeat(np.arange(len(texts)), counts)[:n]
        self.inside = np.arange(n) + window <= (self.start + counts)[self.doc]
        self.anchor = np.zeros(n, np.uint64)
        if n:
            g = rolled(word_hashes(raw, self.begin, self.end), min(GRAM, window))
            self.anchor[:] = g[:n]
            for k in range(1, len(g) - n + 1):
                np.minimum(self.anchor, g[k : k + n], out=self.anchor)

    def passages(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """The words of the windows that start at `first` to `last`."""
        return [self.buffer[x:y] for x, y in zip(self.begin[first].tolist(), self.end[last + self.window - 1].tolist(), strict=True)]

    def anchors(self) -> np.ndarray:
        """Anchors of the windows, once a text."""
        at = np.flatnonzero(self.inside)
        a, d = self.anchor[at], self.doc[at]
        if len(at):
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))
            a, d = a[new], d[new]
            order = np.lexsort((a, d))
            a, d = a[order], d[order]
            a = a[np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))]
        return a

    def runs(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the runs of windows `on` with one anchor in one text."""
        at = np.flatnonzero(on)
        cut = np.flatnonzero((np.diff(at) != 1) | (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (self.doc[at[1:]] != self.doc[at[:-1]])) + 1
        return (at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]) if len(at) else (at, at)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def state(self, length: int, link: int, out: dict) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def clone(self, p: int, w, q: int) -> int:
        c = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: Iterable) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self.clone(last, w, q)
                continue
            p, now = last, self.state(self.length[last] + 1, 0, {})
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[now] = q if self.length[q] == self.length[p] + 1 else self.clone(p, w, q)
            last = now

    def statistics(self, words: Iterable) -> Iterator[int]:
        """At each word, how many words up to it match somewhere."""
        v = n = 0
        for w in words:
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            to = self.next[v].get(w)
            v, n = (to, n + 1) if to is not None else (0, 0)
            yield n

    def known(self, words: list, window: int) -> tuple[list[list[int]], int]:
        """Maximal [start, end) that windows found in the automaton cover, and the number of those windows."""
        out: list[list[int]] = []
        found = 0
        for k, n in enumerate(self.statistics(words), 1):
            if n >= window:
                found += 1
                if out and out[-1][1] >= k - window:
                    out[-1][1] = k
                else:
                    out.append([k - window, k])
        return out, found

    def spans(self, words: list, window: int) -> list[list[int]]:
        return self.known(words, window)[0]


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """Bit array with the bits of column slot set: a fixed size, whatever the number of rows."""
    out = np.zeros(bits >> 6, np.int64)
    words = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("b"))
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out.view(np.uint8)


def is_set(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    slot = anchor & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Shard:
    """Passages of one anchor by ascending document: what those of earlier documents cover of each."""

    def __init__(self, window: int) -> None:
        self.window, self.automaton = window, Automaton()
        self.whole: set[bytes] = set()  # passages of earlier documents: an equal one is known whole
        self.waiting: list[tuple[bytes, int]] = []  # those that the automaton lacks, with the number of windows it knew
        self.doc, self.new = None, {}

    def take(self, doc: int, passage: bytes) -> list[list[int]]:
        if doc != self.doc:
            self.waiting += self.new.items()
            self.whole.update(self.new)
            self.doc, self.new = doc, {}
        if passage in self.whole:
            return [[0, passage.count(b" ") + 1]]
        covered, found = [], 0
        if self.whole:
            for p, n in self.waiting:
                words = p.split(b" ")
                # Windows that overlap may cover all words while others between them are new.
                if n < len(words) - self.window + 1:
                    self.automaton.add(words)
            self.waiting = []
            covered, found = self.automaton.known(passage.split(b" "), self.window)
        self.new[passage] = found
        return covered


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "passage" else pa.int64()) for n, c in columns.items()], names=list(columns))


def steps(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc_id, th, t) of a bounded number of rows at a time."""
    for b in batches:
        ids, hashes = b.column(0).to_numpy(), b.column(1).to_numpy()
        text = b.column(2).cast(pa.binary())
        bound = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), len(text)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield ids[lo:hi], hashes[lo:hi], text.slice(lo, hi - lo).to_pylist()


def slots(seen: DataFrame, bits: int) -> np.ndarray:
    return bitmap(seen.select(F.col("anchor").bitwiseAND(F.lit(bits - 1)).alias("slot")), bits)


def removals(docs: DataFrame, window: int = WINDOW, bits: int = BITS, hot: int = HOT, hot_windows: int = HOT_WINDOWS, step_bytes: int = STEP_BYTES) -> DataFrame:
    """(doc_id, th: hash of the text, spans: array of (s, e), [s, e) in words, apart and ascending) of the documents that lose words."""
    spark = docs.sparkSession

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in steps(batches, step_bytes):
            yield table(anchor=Words(texts, window).anchors().view(np.int64))

    rows = docs.filter("doc_id is not null and t is not null").select("doc_id", "th", "t")
    seen = rows.mapInArrow(anchor_rows, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    seen = materialise(seen.filter("n > 1"), "substring-anchors")
    n, crowds = seen.agg(F.count("*"), F.count(F.when(F.col("n") > hot, 1))).first()
    size = lambda k: min(bits, 1 << max(10, (k * BITS_AN_ANCHOR).bit_length()))
    listed = n * BITS_AN_ANCHOR <= 4 * bits
    common = spark.sparkContext.broadcast(slots(seen, size(n)) if listed else None)
    crowded = spark.sparkContext.broadcast(slots(seen.filter(F.col("n") > hot), size(crowds)) if crowds else None)

    def places(own: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose anchor may be repeated and is not hot, and those whose anchor is."""
        on = own.inside if common.value is None else own.inside & is_set(common.value, own.anchor)
        full = np.zeros(len(on), bool) if crowded.value is None else on & is_set(crowded.value, own.anchor)
        return on & ~full, full

    def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in steps(batches, step_bytes):
            own = Words(texts, window)
            first, last = own.runs(places(own)[0])
            doc = own.doc[first]
            yield table(anchor=own.anchor[first].view(np.int64), doc_id=ids[doc], th=hashes[doc], s=first - own.start[doc], passage=own.passages(first, last))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Shard(window)
        for b in batches:
            out: list[tuple] = []
            for anchor, doc, th, s, passage in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if anchor != now:
                    now, own = anchor, Shard(window)
                out += [(doc, th, s + x, s + y) for x, y in own.take(doc, passage)]
            yield table(**dict(zip(("doc_id", "th", "s", "e"), list(zip(*out, strict=True)) or [()] * 4, strict=True)))

    found = rows.mapInArrow(passage_rows, "anchor long, doc_id long, th long, s long, passage binary")
    if not listed:
        found = found.join(seen.select("anchor").hint("shuffle_merge"), "anchor", "left_semi")
    sharded = found.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    spans = sharded.mapInArrow(shards, "doc_id long, th long, s long, e long")
    if crowds:
        spans = spans.unionByName(hot_spans(rows, places, window, hot_windows, step_bytes))
    return islands(spans)


def digests(own: Words, at: np.ndarray) -> list[bytes]:
    return list(map(xxhash.xxh3_128_digest, own.passages(at, at)))


def halves(found: Iterable[bytes]) -> np.ndarray:
    """Two signed 64-bit integers of each digest."""
    return np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)


def hot_spans(rows: DataFrame, places, window: int, most: int, step_bytes: int) -> DataFrame:
    """(doc_id, th, s, e) of the windows with a hot anchor whose digest a smaller doc_id has too."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and largest doc_id of each digest that the task meets."""
        low, high = {}, {}

        def flush() -> pa.RecordBatch:
            h = halves(low)
            out = table(hi=h[:, 0], lo=h[:, 1], first=list(low.values()), last=list(high.values()))
            low.clear()
            high.clear()
            return out

        for ids, _, texts in steps(batches, step_bytes):
            own = Words(texts, window)
            at = np.flatnonzero(places(own)[1])
            for d, i in zip(digests(own, at), ids[own.doc[at]].tolist(), strict=True):
                if i < low.setdefault(d, i):
                    low[d] = i
                if i > high.setdefault(d, i):
                    high[d] = i
            if len(low) > COMBINE:
                yield flush()
        yield flush()

    first = rows.mapInArrow(combined, "hi long, lo long, first long, last long").groupBy("hi", "lo").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    first = materialise(first.filter("first < last").select("hi", "lo", "first"), "substring-hot")
    n = first.count()
    got = first.toArrow() if n <= most else None
    known = rows.sparkSession.sparkContext.broadcast(got and dict(zip((np.stack([got.column(c).to_numpy() for c in ("hi", "lo")], axis=1).astype(">i8").view("V16").ravel().tolist()), got.column("first").to_pylist(), strict=True)))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The places whose window a smaller doc_id has."""
        for ids, hashes, texts in steps(batches, step_bytes):
            own = Words(texts, window)
            at = np.flatnonzero(places(own)[1])
            doc = ids[own.doc[at]]
            least = np.array([known.value.get(d, i) for d, i in zip(digests(own, at), doc.tolist(), strict=True)], np.int64)
            on = np.zeros(len(own.doc), bool)
            on[at[least < doc]] = True
            begin, end = own.runs(on)
            d = own.doc[begin]
            yield table(doc_id=ids[d], th=hashes[d], s=begin - own.start[d], e=end + window - own.start[d])

    def all_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in steps(batches, step_bytes):
            own = Words(texts, window)
            at = np.flatnonzero(places(own)[1])
            h, d = halves(digests(own, at)), own.doc[at]
            yield table(hi=h[:, 0], lo=h[:, 1], doc_id=ids[d], th=hashes[d], s=at - own.start[d])

    if n <= most:
        return rows.mapInArrow(spans, "doc_id long, th long, s long, e long")
    met = rows.mapInArrow(all_places, "hi long, lo long, doc_id long, th long, s long").join(first, ["hi", "lo"]).filter("doc_id > first")
    return met.select("doc_id", "th", "s", (F.col("s") + window).alias("e"))


def islands(spans: DataFrame) -> DataFrame:
    """(doc_id, th, spans) with overlapping and touching spans merged."""
    w = Window.partitionBy("doc_id", "th").orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce(F.col("s") > top, F.lit(True)).cast("int"))
    rows = rows.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy("doc_id", "th", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def kept_words(text: str | None, spans: list[tuple[int, int]] | None) -> tuple[int, int, bytes]:
    """Number of words, of those removed, and the kept ones joined by spaces."""
    words = split(text)
    if not spans:
        return len(words), 0, b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s for s, _ in spans], 1)
    np.add.at(edge, [e for _, e in spans], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


def with_pairs(b: pa.RecordBatch) -> Iterator[tuple]:
    """(text, spans) of the rows of with_spans()."""
    spans = ([(x["s"], x["e"]) for x in s] if s else None for s in b.column(2).to_pylist())
    return zip(b.column(1).to_pylist(), spans, strict=True)


def with_spans(docs: DataFrame, text: str, doc_id: str, window: int, **route: int) -> DataFrame:
    """docs' ids and texts with their removed spans (null: none)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.col(text).cast("string").alias("t"))
    spans = materialise(removals(rows, window, **route), "substring-spans")
    # By shuffle at every size: the spans grow with the documents.
    return rows.join(spans.hint("shuffle_merge"), ["doc_id", "th"], "left").select("doc_id", "t", "spans")


def deduplicate(docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", **route: int) -> DataFrame:
    """(doc_id, n_words, n_removed, text): each text without the words of windows that a smaller doc_id also has.

    Null and empty texts have no words. A null doc_id loses nothing and takes nothing from others; rows with equal
    doc_id do not count as smaller to each other. Kept words are joined by one space. An empty table gives an empty
    one; other columns are ignored. `route` (bits, hot, hot_windows, step_bytes of removals()) changes the way, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept_words(t, s) for t, s in with_pairs(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode("utf-8", "surrogatepass") for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return with_spans(docs, text, doc_id, window, **route).mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def remove_known(docs: DataFrame, reference: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As deduplicate, but against the texts of a small reference: its shards' automata are broadcast.

    The reference is counted first; over REFERENCE_WORDS words it is refused.
    """
    known = reference.select(F.col(text).cast("string").alias("t")).filter("t is not null")
    n = known.agg(F.sum(F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if n > REFERENCE_WORDS:
        raise ValueError(f"the reference has {n} words; automata are broadcast for {REFERENCE_WORDS} at most")
    shards, size = [Automaton()], 0
    for r in known.toLocalIterator():
        words = split(r.t)
        if size + len(words) > SHARD_WORDS and size:
            shards.append(Automaton())
            size = 0
        shards[-1].add(words)
        size += len(words)
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                words = split(t)
                out.append(kept_words(t, [s for a in shared for s in a.value.spans(words, window)]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].decode("utf-8", "surrogatepass") for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: what is left of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kept_words(t, s) for t, s in with_pairs(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_spans(docs, "text", "doc_id", WINDOW).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
