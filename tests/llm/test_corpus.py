"""The corpus operators against brute-force versions, on small tables with nulls, empty and repeated rows and clashing columns."""
import base64
import hashlib
import math
import os
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from oddsmill.llm import bpe, common, jpeg, licenses, mixing, pii, quality, rangecoder, simhash, substrings, tokenfiles, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k * k % 997}" for k in range(4000))
SHARED = " ".join(f"shared{k}" for k in range(60))
TEXTS = {
    1: "The quick brown fox jumps over the lazy dog. " * 3,
    2: "The quick brown fox jumps over the lazy dog. " * 3,
    3: None,
    4: "",
    5: LONG,
    6: SHARED + " tail one",
    7: "head two " + SHARED,
    8: "Write to a.b@mail.example.com or +1 (555) 010-9999 now, 10.0.0.300 and 10.0.0.30 and 4111 1111 1111 1111.",
    9: "É ßtraße\n\n　x\ty 'll 123 !!!  \n",
    10: LONG.replace("w4 ", "other ", 1),
    11: "intro words here. Released under the MIT License. This work is licensed under the GNU General Public License, version 3.",
}
ROWS = [(i, t, "en", None if i == 9 else f"s{i % 3}", len(t or ""), "h", "k", i) for i, t in TEXTS.items()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, k string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*ROWS, ROWS[0]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def distance(a, b):
    return (a ^ b).bit_count()


def test_simhash(spark, docs, none):
    def fingerprint(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fingerprint(t) for i, t in TEXTS.items()}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if distance(fps[a], fps[b]) <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS) + 1
    assert {r.doc_id: (r.fp[0] & (1 << 64) - 1, r.component_id) for r in got} == {i: (fps[i], root[i]) for i in fps}
    assert root[2] == 1 and root[4] == 3
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_cells_in_many_blocks(spark, monkeypatch):
    """Cells cut into several blocks of several tiles link what one block does."""
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(62, rng.integers(0, 7), replace=False)) for b in base for _ in range(30)})
    table = spark.createDataFrame([(k, [x], 1) for k, x in enumerate(fps)], "doc_id long, fp array<long>, n long")

    def roots(pairs):
        root = list(range(len(fps)))

        def top(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            root[b] = a
        return [top(a) for a in range(len(fps))]

    expected = roots((a, b) for a in range(len(fps)) for b in range(a) if distance(fps[a], fps[b]) <= 3)
    assert 1 < len(set(expected)) < len(fps)
    for tile, block in ((256, 1 << 15), (2, 4), (1, 1), (3, 7)):
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "BLOCK", block)
        reps, edges = simhash.links(table, 3)
        ids = {r.node: r.least for r in reps.collect()}
        assert roots((ids[r.src], ids[r.dst]) for r in edges.collect()) == expected


def test_compare_is_exact():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, (300, 1), dtype=np.uint64)) ^ np.uint64(1)
    i, j = simhash.compare(a, b, 3, 3)
    expected = {(x, y) for x in range(300) for y in range(300) if 1 <= distance(int(a[x, 0]), int(b[y, 0])) <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 103), (103, 101), (7, 7)] + [(200, 200 + k) for k in range(1, 50)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 103: 100} | {200 + k: 200 for k in range(50)}


def test_near_dedup_stage(spark, docs):
    kept = sorted(r.doc_id for r in simhash.stage(spark, docs, "").collect())
    assert 1 in kept and 2 not in kept and 5 in kept and 10 not in kept and {6, 8, 11} <= set(kept) and 7 not in kept


@pytest.mark.parametrize("parts", [1, 5])
def test_near_dedup_with_repeated_ids(spark, parts):
    """Texts with one id are judged by themselves, in any order of rows; equal rows, null ids, no rows, clashing columns."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, a, 0), (5, b, 1), (2, b, 2), (7, a + " more", 3), (7, c, 4), (7, c, 4), (None, a, 5), (9, None, 6), (8, "", 7)]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "doc_id long, text string, n long").repartition(parts)
        got = sorted((tuple(r)[:2] for r in simhash.stage(spark, table, "").collect()), key=str)
        assert got == sorted([(5, a), (2, b), (7, c), (None, a), (8, "")], key=str)
    near = {(r.doc_id, r.fp[0], r.component_id) for r in simhash.near_duplicates(table).collect()}
    assert {x for i, _, x in near if i == 5} == {2, 5} and len(near) == 8
    assert simhash.stage(spark, table.limit(0), "").count() == 0


def test_near_dedup_stage_is_exact(spark):
    """Pairs below and above 0.8 by one shingle set each: of n words, a pair shares `same` at its start."""
    rows, expected, at = [], set(), 0
    for target in (0.5, 0.65, 0.7, 0.79, 0.81, 0.9):
        for k in range(15):
            n = 300
            same = round(2 * target * n / (1 + target))  # shingles in common, of n each
            first = [f"p{at}w{x}" for x in range(n + 4)]
            second = first[: same + 4] + [f"p{at}v{x}" for x in range(n - same)]
            rows += [(at, " ".join(first), "s"), (at + 1, " ".join(second), "s")]
            expected |= {at} if target > 0.8 else {at, at + 1}
            at += 2
    rows += [(at, "a b c d e f g h", "s"), (at + 1, "a b c d e f g h i", "s"), (at + 2, "", "s"), (at + 3, None, "s"), (None, "a b c d e f g h", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, key string")
    assert {r.doc_id for r in simhash.stage(spark, table, "").collect()} == expected | {at, at + 2, None}


def test_confirm_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLASS_TEXTS", 5)
    base = [f"w{x}" for x in range(400)]
    rows = [(k, " ".join(base[:k * 8] + [f"o{k}"] + base[k * 8 + 1 :])) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.similar(table).collect()} == {0}


def test_bpe(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN)
    got = {r.doc_id: (list(r.ids), bytes(r.bytes)) for r in bpe.decode(tokens, path).collect()}
    assert got == {i: (known.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS.items()}
    assert bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0
    encoder = bpe.Encoder(bpe.load(path), public_tokenizers.PATTERN)
    for t in ("a" * 20000, "ab" * 3000, "<|endoftext|>", "\x1c\x85 　"):
        assert encoder.ids(t) == known.encode_ordinary(t)


ODD = ["", " ", "  a", "a  b", "a \u00a0 b", "é x", "\u00a0 x", "x\u3000 y", "x\x1c y \x1f  z", "x\x85 y", "\u2028 a\u1680 b\u205f c", "don't  'll\n\n\tgo ", "a\x0b\x0cb", "à \u0089 à  à ", "…\u200a …", "日本 語 ", "!? ?!  ##"]


def test_bpe_batches():
    """Chunks are cut where the pattern cuts too, and each is encoded once."""
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for pattern in (public_tokenizers.PATTERN, public_tokenizers.PATTERN + "|x"):
        encoder, asked = bpe.Encoder(bpe.load(path), pattern), []
        assert encoder.wordwise == (pattern == public_tokenizers.PATTERN)
        encoder.split = lambda t, f=encoder.split, asked=asked: asked.append(t) or f(t)
        texts = [*ODD, " ".join(ODD), "again and again" * 3, "again and again" * 3, *("".join(rnd) for k in range(300) for rnd in [random.Random(k).choices("ab 'é\u00a0\u3000\x1c\x85\n\t#1\u0089", k=k % 23)])]
        ids, n = encoder.batch(pa.array(["", *texts])[1:])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [known.encode_ordinary(t) for t in texts]
        assert len(asked) == len(set(asked))


def test_bpe_digests(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(bpe.load(path), public_tokenizers.PATTERN)
    rows = [*enumerate([*ODD, None]), (3, "same id")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, public_tokenizers.PATTERN).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    wanted = [(i, len(x := encoder.ids(t)), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_token_file_pieces():
    """A worker remembers pieces, not the chunks made of them, and texts of any white space keep their ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known, own = Tokenizer.from_file(path), tokenfiles.Tokens(path)
    texts = [*ODD, "one, two; three.", "one; two, three!", "<|endoftext|> one,"]
    for t, got in zip(texts, own.ids([t.encode() for t in texts], 2), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*known.encode(t, add_special_tokens=False).ids, 2], t
    assert not {b"one,", b"one;", b"two,", b"two;", b"three.", b"three!"} & set(own.memo)


def test_minimal_perfect_hash():
    words = {f"token{k}".encode(): k for k in range(3000)}
    v = bpe.Vocabulary(words)
    assert sorted(v.ids) == list(range(3000)) and all(v.find(w) == k for w, k in words.items()) and v.find(b"none") == -1


def identifiers(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[ -]", "", m[0])]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_identifiers():
    rng = np.random.default_rng(5)
    for _ in range(20000):
        t = "".join(rng.choice(list("a1@.-+ (%)25"), rng.integers(1, 40)))
        assert pii.identifiers(t) == identifiers(t), t


def test_pii(spark, docs, none):
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    for i, t in TEXTS.items():
        own = ",".join(f"{k}:{s}:{e}" for k, s, e in identifiers(t or ""))
        assert got[i].spans == own and got[i].base_sha256 == hashlib.sha256(own.encode()).hexdigest()
    assert (got[8].n_email, got[8].n_ip, got[8].n_card, got[8].n_phone) == (1, 1, 1, 1)
    assert pii.spans(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(k, f"note {k} by Zorblax Quint mailbox zq@corp.example.com in week{k}", "") for k in range(6)]
    rows += [(100 + k, f"plain text number {k} by somebody in week{k} with many note words", "") for k in range(300)]
    rows += [(900, None, ""), (901, "ZORBLAX again", "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, _t string")
    clean = {r.doc_id: r.text for r in pii.sanitise(table).collect()}
    assert "orblax" not in clean[0] and "zq@" not in clean[0] and "[EMAIL]" in clean[0] and "note 0 by" in clean[0]
    assert "ZORBLAX" not in clean[901] and clean[900] is None and clean[100] == rows[6][1]


def test_terms_of_parts_and_of_few_contexts(spark):
    """What a domain's many addresses share goes; so does what stands twice beside a rare identifier, but once is no evidence."""
    rows = [(k, f"word{'abcdefgh'[k]} Corpname person{k}@corp.example.com wrote") for k in range(8)]
    rows += [(20, "first twiceseen +1 (555) 010-9999 oncea"), (21, "second twiceseen +1 (555) 010-9999 onceb"), (22, "third lonely 10.1.2.3 oncec")]
    rows += [(100 + k, f"other text {k} at mail{k % 7}@example.org with common words") for k in range(12000)]  # 12.35 bits need 10,450
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Corpname" not in got[k] and "wrote" not in got[k] for k in range(8)) and "worda" in got[0]
    assert "twiceseen" not in got[20] + got[21] and "first" in got[20] and "oncea" in got[20] and "lonely" in got[22]
    assert got[100] == "other text 0 at [EMAIL] with common words"


def test_disclosing_terms_brute_force(spark):
    rng = random.Random(5)
    people = [f"{a}.{b}@{c}.example.com" for a, b, c in zip("pqrst" * 8, "uvwxyzkl" * 5, ["one", "two", "two", "six"] * 10, strict=True)]
    people += [f"10.0.{k % 3}.{k}" for k in range(10)] + [f"+1 (555) 010-{1000 + k % 4}" for k in range(9)]
    word = lambda n: "".join(chr(97 + int(d)) for d in f"{n:04d}")
    texts = []
    for _ in range(3000):
        w = [word(rng.randrange(4000)) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.2:
            k = rng.randrange(len(people))
            w[rng.randrange(len(w)) :] = [word(5000 + k), people[k], *[word(6000 + k % 4)] * (rng.random() < 0.9)]
        texts.append(" ".join(w))
    texts += texts[:100]
    letter = pii.letters(spark)
    terms = lambda t: {x for x in re.split("[^a-z]+", t.lower()) if len(x) >= pii.TERM_LETTERS}
    holds, beside, contexts, docs_of = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in set(texts):
        for x in terms(t):
            docs_of[x].add(t)
        for names, near in pii.contexts(t, letter):
            for e in names:
                holds[e].add(t)
                for x in terms(near):
                    beside[e, x].add(t)
                    contexts[e, x].add(near)
    want = {}
    for (e, x), d in beside.items():
        content = math.log2(len(texts) / len(holds[e]))
        p, k = len(d) / len(docs_of[x]), min(len(d), len(contexts[e, x]))
        whole = e.split(":")[0] in pii.KINDS and len(contexts[e, x]) >= pii.SUPPORT
        if not whole:
            if k < 2:
                continue
            n = k / p
            p = (p + pii.Z**2 / 2 / n - pii.Z * math.sqrt(p * (1 - p) / n + (pii.Z / 2 / n) ** 2)) / (1 + pii.Z**2 / n)
        if (ratio := 1 + math.log2(p) / content) >= pii.DISCLOSE:
            want[x] = max(want.get(x, 0), ratio)
    rows = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(4)
    got = {r.term: r.ratio for r in pii.disclosing_terms(rows)[0].collect()}
    assert len(want) > 10 and got == pytest.approx(want)


def test_letters_are_those_of_sql(spark):
    letter = re.compile(pii.letters(spark))
    rows = spark.createDataFrame([(c, f"x{chr(c)}y") for c in range(0x34000) if not 0xD800 <= c < 0xE000], "c long, t string")
    for r in rows.select("c", (F.size(F.split("t", r"\P{L}+")) == 1).alias("one"), F.lower("t").alias("low")).toLocalIterator():
        assert (letter.fullmatch(chr(r.c)) is not None) == r.one, hex(r.c)
        assert not r.one or r.low == f"x{chr(r.c)}y".lower(), hex(r.c)


def test_terms_beside_marks_that_are_no_letters(spark, none):
    """A term is found where superscripts, fractions and letter numerals stand beside it; repeated rows, empty tables."""
    rows = [(k, f"{x} Zorblax a.b@mail.example.com wrote {'pqrstu'[k]}ly") for k, x in enumerate(["one", "two", "three", "four"])]
    rows += [(9, "Zorblax\u00b2 and \u2167Zorblax and zorblax\u00bd."), (9, "Zorblax\u00b2 and \u2167Zorblax and zorblax\u00bd."), (10, None), (11, "")]
    rows += [(20 + k, f"filler text number {k} here") for k in range(80)]
    got = [(r.doc_id, r.text) for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert not [t for _, t in got if t and "zorblax" in t.lower()] and sum(i == 9 for i, _ in got) == 2
    assert {i: t for i, t in got}[10] is None and {i: t for i, t in got}[11] == ""
    assert pii.sanitise(none).count() == 0 and pii.spans(none).count() == 0


def test_quality(spark, docs, none):
    def counted(t):
        w, seen, dups = WORD.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dups += line in seen
                seen.add(line)
        n, cover = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if n[tuple(w[k : k + 8])] > 1:
                cover.update(range(k, k + 8))
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, len(cover)

    got = {r.doc_id: tuple(r)[1:6] for r in quality.statistics(docs).collect()}
    assert got == {i: counted(t) for i, t in TEXTS.items()}
    t = "a b c d e f g h " * 4 + "x\nx\n\n \nx"
    assert quality.counted(t)[:5] == counted(t)
    assert quality.statistics(none).count() == 0


def test_rules():
    rng = np.random.default_rng(1)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.4)) | (x["b"] > 0.9)
    rules = quality.learn(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality.covers(rule, x, 3000)
    assert (hit == bad).mean() > 0.97 and bad[hit].mean() > 0.95
    assert quality.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_quality_stage_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.train(docs.filter("doc_id % 2 = 0"), labels)
    out = quality.judged(docs.filter("doc_id % 2 = 1"), rules).join(labels, "doc_id").filter("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True]
    assert n.get((0, False), 0) >= 2 * n.get((0, True), 0)


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) + 1 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert {r.doc_id: r["size"] for r in got} == {i: len(WORD.findall(t or "")) for i, t in TEXTS.items()}
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rows in by.values():
        assert rows[0].target <= 3 * rows[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(4, 0.05 * rows[0].target)
    assert abs(sum(rows[0].target for rows in by.values()) - sum(r["size"] for r in got)) < 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_mixing_in_whole_copies(spark, none):
    """Totals of small and large sources come near what mix() takes; rows without words, repeated and null ids, empty tables."""
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 60))), f"s{min(k % 40, 4)}", k) for k in range(1500)] + [(None, "x y", "s0", 0), (7, "x y", "s0", 1), (8, None, "s1", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long")
    wanted = {r.source: (r.t, r.most) for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("t"), F.max("size").alias("most")).collect()}
    got = mixing.stage(spark, table, "")
    assert got.columns == table.columns
    words = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    for source, (taken, most) in wanted.items():
        assert abs(words.get(source, 0) - taken) <= max(0.08 * taken, 3 * most), (source, words.get(source), taken)
    assert got.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 6 and mixing.stage(spark, none, "").count() == 0


def test_warc(spark, none):
    big = "<p>" + "x" * 1200 + "</p>"
    pages = [(1, "http://a/1", big, 0), (2, "http://a/2\r\nX: y", big, 0), (5, None, big, 0), (3, "u", None, 0), (4, "u", "short", 0), (6, "u", "short", 0), (7, "u", "é\r\n\r\nWARC/1.1" * 200, 0), (None, "u", "no id", 0)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, payload int")
    got = {r.record_id[12:-1]: (r.type, r.refers_to and r.refers_to[12:-1], r.payload_bytes, r.payload_digest) for r in warc.round_trip(table).collect()}
    for i, _, html, _ in pages:
        raw = (html or "").encode()
        again = i in (1, 2)
        assert got["null" if i is None else str(i)] == ("revisit" if again else "response", "5" if again else None, len(raw), hashlib.sha1(raw).hexdigest()) or i is None
    assert warc.round_trip(table.limit(0)).count() == 0


def test_truncated_archive():
    raw = warc.record(1, None, b"body", hashlib.sha1(b"body").hexdigest(), None)
    assert len(list(warc.records(iter([raw[:10], raw[10:] + raw])))) == 2
    with pytest.raises(ValueError):
        list(warc.records(iter([raw + raw[:50]])))


def test_jpeg(spark, docs, none):
    got = {r.doc_id: r for r in jpeg.described(jpeg.stored(docs)).collect()}
    for i, t in TEXTS.items():
        raw = (t or "").encode()
        assert bytes(got[i].samples) == jpeg.padded(raw) and got[i].n_bytes == len(raw)
    assert got[1].media == got[2].media and got[1].images == got[2].images
    assert jpeg.described(jpeg.stored(none)).count() == 0
    noise = np.random.default_rng(0).integers(0, 256, 192 * 9000, dtype=np.uint8).tobytes()
    assert b"".join(x[2].tobytes() for x in jpeg.thumbnails(jpeg.store([noise]))[0]) == noise


def test_thumbnail_hash_sees_all_rows():
    a = np.zeros((800, 192), np.uint8)
    b = a.copy()
    b[1:100, :24] = 255  # between the rows at multiples of 100
    assert jpeg.thumbnail_hash(a) != jpeg.thumbnail_hash(b) == "80" + "00" * 7
    for shape in ((1, 1), (3, 192), (1, 5), (9, 7)):
        t = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
        cells = np.array([[t[k * shape[0] // 8 : max((k + 1) * shape[0] // 8, k * shape[0] // 8 + 1), j * shape[1] // 8 : max((j + 1) * shape[1] // 8, j * shape[1] // 8 + 1)].mean() for j in range(8)] for k in range(8)])
        assert jpeg.thumbnail_hash(t) == np.packbits(cells > cells.mean()).tobytes().hex()


def test_damaged_media(spark):
    whole = jpeg.store([jpeg.padded(b"some text " * 50)])[0]
    rows = [(0, whole), (1, b"garbage"), (2, whole[:11]), (3, None), (4, whole[: len(whole) // 2]), (5, b""), (6, whole)]
    got = {r.k: r for r in jpeg.described(spark.createDataFrame(rows, "k int, media binary").coalesce(1)).collect()}
    assert got[0].images == got[6].images and got[0].error is None and len(got[0].images) == 1
    assert all(got[k].images is None and got[k].samples is None and got[k].error for k in (1, 2, 5))
    assert got[3].images == [] and got[3].samples is None and got[3].error is None


def test_jpeg_with_ac_coefficients_and_colour():
    """Two components, 2 x 1 and 1 x 1, AC symbols in the stream, no restarts."""
    dc = {s: (c, n) for s, c, n in jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS)}
    ac_counts, ac_symbols = (0, 3) + (0,) * 14, (0x00, 0x12, 0xF0)
    ac = {s: (c, n) for s, c, n in jpeg.codes(ac_counts, ac_symbols)}
    rng = np.random.default_rng(2)
    bits, last, luma = "", {0: 0, 1: 0}, []
    for _unit in range(4):
        for comp in (0, 0, 1):
            value = int(rng.integers(-100, 100))
            d, last[comp] = value - last[comp], value
            s = abs(d).bit_length()
            bits += f"{dc[s][0]:0{dc[s][1]}b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
            for symbol in ((0xF0, 0x12, 0x12, 0x00) if rng.random() < 0.5 else (0x00,)):
                bits += f"{ac[symbol][0]:0{ac[symbol][1]}b}" + ("10" if symbol == 0x12 else "")
            if comp == 0:
                luma.append(value)
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    whole = b"\xff\xd8" + jpeg.segment(0xDB, b"\0" + bytes([8] * 64)) + jpeg.segment(0xC0, struct.pack(">BHHB", 8, 16, 32, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    whole += jpeg.segment(0xC4, b"\x00" + bytes(jpeg.DC_COUNTS) + bytes(jpeg.DC_SYMBOLS)) + jpeg.segment(0xC4, b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    whole += jpeg.segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + data + b"\xff\xd9"
    ((_, _, thumb),) = jpeg.thumbnails([whole])[0]
    assert thumb.shape == (2, 4)
    assert (thumb == np.array([luma[0:4], luma[4:8]]) + 128).all()


def test_substrings(spark, docs, none):
    words = {i: (t or "").encode().split() for i, t in TEXTS.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.deduplicate(docs).collect()}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        assert got[i] == (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    assert got[2][1] == len(words[2]) and got[7][1] == 60
    assert substrings.deduplicate(none).count() == 0


def test_windows_between_covering_ones(spark):
    """Document 3 is covered by windows of 1 and 2, and yet the first to hold the window of document 4."""
    w = [f"w{k}" for k in range(15)]
    texts = {1: w[0:13], 2: w[2:15], 3: w, 4: w[1:14]}
    for order in (w, w[7:8] + w[:7] + w[8:]):  # wherever the anchor is
        at = {x: k for k, x in enumerate(order)}
        rows = spark.createDataFrame([(i, " ".join(f"v{at[x]}" for x in t)) for i, t in texts.items()], "doc_id long, text string")
        assert {r.doc_id: r.n_removed for r in substrings.deduplicate(rows).collect()} == {1: 0, 2: 0, 3: 15, 4: 13}
    own = substrings.Shard(13)
    assert [own.take(i, " ".join(t).encode()) for i, t in texts.items()] == [[], [], [[0, 15]], [[0, 13]]]


def brute_windows(rows, window):
    """(doc_id, words, words removed, kept text) by definition."""
    split = [(i, (t or "").split(" ") if t else []) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("route", [{}, {"hot": 1}, {"hot": 3, "hot_windows": 0}, {"bits": 64}, {"bits": 64, "hot": 2}])
def test_substrings_of_few_words(spark, route):
    """Small vocabularies, stitched passages, repeated and null ids, by all routes."""
    rng = np.random.default_rng(7)
    vocabulary = ["a", "b", "c", "dé", "e"]
    pool = [[str(x) for x in rng.choice(vocabulary, 30)] for _ in range(6)]
    rows = [(None, " ".join(pool[0])), (5, None), (5, "")]
    for i in range(120):
        text = []
        for _ in range(rng.integers(1, 4)):
            p, at = pool[rng.integers(6)], rng.integers(0, 12)
            text += p[at : at + rng.integers(5, 19)] + [f"own{i}"] * int(rng.integers(0, 2))
        rows.append((int(rng.integers(0, 90)), " ".join(text)))
    rows += rows[40:50]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.deduplicate(docs, **route).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_windows(rows, 13)


def test_word_hashes_see_the_word_alone(monkeypatch):
    """Wherever a word stands, at the end of a part too."""
    rng = np.random.default_rng(3)
    words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 9)).astype(np.uint8)) for _ in range(300)]
    for size in (2, 10, 64, 1 << 19):
        monkeypatch.setattr(substrings, "STEP_BYTES", size)
        found = {}
        for joined in (words, words[::-1], *([w] for w in words)):
            end = np.cumsum([len(w) + 1 for w in joined]) - 1
            h = substrings.word_hashes(np.frombuffer(b" ".join(joined), np.uint8), end - [len(w) for w in joined], end)
            for w, x in zip(joined, h.tolist(), strict=True):
                assert found.setdefault(w, x) == x
        assert len(set(found.values())) == len(found)


@pytest.mark.parametrize(("parts", "records", "step_bytes"), [(1, 1, 1), (1, 10_000, 64), (3, 3, 1 << 19), (8, 1, 200), (8, 10_000, 1 << 19), (3, 10_000, 1)])
def test_substrings_whatever_the_partitions(spark, parts, records, step_bytes):
    rng = np.random.default_rng(parts)
    pool = [[f"w{x}" for x in rng.integers(0, 500, 40)] for _ in range(8)]
    rows = []
    for i in range(200):
        p, at = pool[rng.integers(8)], rng.integers(0, 20)
        rows.append((i, " ".join([f"own{i}"] * int(rng.integers(0, 3)) + p[at : at + rng.integers(10, 20)] + [f"end{i}"] * int(rng.integers(0, 2)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        for hot in (substrings.HOT, 5):
            got = substrings.deduplicate(docs, hot=hot, step_bytes=step_bytes).collect()
            assert sorted((tuple(r) for r in got), key=str) == brute_windows(rows, 13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_automaton():
    rng = np.random.default_rng(4)
    for _ in range(200):
        known = ["".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(4)]
        a = substrings.Automaton()
        for k in known:
            a.add(k)
        t = "".join(rng.choice(list("abc"), 20))
        for end, n in enumerate(a.statistics(t), 1):
            assert n == max((m for m in range(end + 1) if any(t[end - m : end] in k for k in known)), default=0)


def test_remove_known(spark, docs):
    reference = docs.filter("doc_id = 6").select("doc_id", "text")
    got = {r.doc_id: r.n_removed for r in substrings.remove_known(docs, reference).collect()}
    assert got[7] == 60 and got[6] == 62 and got[5] == 0


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    unique = docs.dropDuplicates(["doc_id"])
    manifest = tokenfiles.write(unique, common.scratch(spark, "tokens"), path, 2)
    got = {r.doc_id: r for r in tokenfiles.read(manifest, with_ids=True).collect()}
    start = 0
    for i in sorted(TEXTS):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        assert list(got[i].ids) == ids and got[i].start == start and got[i].ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    assert tokenfiles.read(tokenfiles.write(none, common.scratch(spark, "tokens"), path, 2)).count() == 0


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known, own = Tokenizer.from_file(path), tokenfiles.Tokens(path)
    texts = ["one <|endoftext|> two", "a<|startoftext|>b<|endoftext|>", "<|endoftext|>\u0338 c", "X <|ENDOFTEXT|> y", "<| endoftext |> plain", "<|endoftext|", "", " one  two "]
    assert known.encode(texts[0], add_special_tokens=False).ids == [637, 49407, 1237]
    for t, got in zip(texts, own.ids([t.encode() for t in texts], 2), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*known.encode(t, add_special_tokens=False).ids, 2], t


def test_range_coder():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(9000, int), rng.integers(0, 49408, 9000), rng.zipf(1.3, 9000) % 500, np.array([7])):
        freq = rangecoder.frequencies(np.bincount(ids, minlength=49408))
        blocks = [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)]
        back = rangecoder.decode(rangecoder.encode(blocks, freq), [len(b) for b in blocks], freq)
        assert (np.concatenate(back) == ids).all()


def test_licenses(spark, docs, none):
    got = {(r.doc_id, r.license): (r.containment, r.start_word) for r in licenses.scan(docs).collect()}
    assert got == {(11, "MIT"): (1.0, 3), (11, "GPL-3.0"): (1.0, 8)}
    near = spark.createDataFrame([(1, "this work is licensed under the gnu general public license version 3 x"), (2, "work is licensed under the gnu general public license version 3"), (3, "licensed under the gnu")], "doc_id long, text string")
    assert {r.doc_id: r.containment for r in licenses.scan(near).collect()} == {1: 1.0, 2: 0.875}
    assert licenses.scan(none).count() == 0


def test_short_and_usual_licenses(spark):
    """The five licence lines of the tables, and headers within other words."""
    lines = {
        "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
        "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "All-rights-reserved": "All rights reserved.",
    }
    lines |= {k: licenses.TEMPLATES[k] for k in ("MPL-2.0", "ISC", "Unlicense", "BSD-source")}
    rows = [(k, f"one two {t} three") for k, t in enumerate(lines.values())] + [(100, "all rights"), (101, "All rights. Reserved all rights reserved"), (102, "all the rights reserved")]
    got = {(r.doc_id, r.license): (r.containment, r.start_word, r.n_windows) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(k, x) for k, x in enumerate(lines)} <= set(got) and all(got[k, x][:2] == (1.0, 2) for k, x in enumerate(lines))
    assert {k: v for k, v in got.items() if k[0] >= 100} == {(101, "All-rights-reserved"): (1.0, 0, 2)}
    only = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), {"own": "All rights reserved"}).collect()
    assert sorted(r.doc_id for r in only) == [4, 101]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = common.materialise(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns or name == "bpe_encoding"
        seen.append(docs.count())
    assert 0 < seen[1] < seen[0] < 200 and seen[2] == seen[1] and seen[4] == seen[3] > 0
    assert docs.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_token_files_with_equal_and_null_ids_and_damage(spark, tmp_path):
    """Null ids first, equal ids in the order of their texts; a changed byte is an error, never other ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(2, "b words"), (None, "none"), (2, "a words"), (2, "a words"), (1, None)]
    manifest = tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/tokens", path, 2)
    got = tokenfiles.read(manifest, with_ids=True).orderBy("start").collect()
    own = tokenfiles.Tokens(path)
    wanted = [np.frombuffer(x, "<u4").tolist() for x in own.ids([b"none", b"", b"a words", b"a words", b"b words"], 2)]
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 2] and [list(r.ids) for r in got] == wanted
    uri = f"file://{tmp_path}/one.bin"
    tokenfiles.write_file(uri, [(1, own.ids([LONG.encode()], 2)[0])], own.size)
    raw = (tmp_path / "one.bin").read_bytes()
    whole = [(i, x.tolist()) for i, x in tokenfiles.read_file(uri)]
    rng = np.random.default_rng(2)
    for at in rng.integers(0, len(raw), 60).tolist():
        (tmp_path / "bad.bin").write_bytes(raw[:at] + bytes([raw[at] ^ 1 << int(rng.integers(8))]) + raw[at + 1 :])
        try:
            assert [(i, x.tolist()) for i, x in tokenfiles.read_file(f"file://{tmp_path}/bad.bin")] == whole
        except (ValueError, struct.error, zlib.error, MemoryError, StopIteration, OverflowError, IndexError):
            pass
    with pytest.raises(ValueError):
        tokenfiles.write_file(uri, [], 1 << 17)


def test_session_without_checkpoint_folder(tmp_path):
    """One folder for all of a local session, and checkpoints work."""
    code = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); " \
        "from oddsmill.llm import common as c; e = s.createDataFrame([(1, 2), (2, 3)], 'src long, dst long'); " \
        "print(c.shared_dir(s) == c.shared_dir(s), c.shared_dir(s)[:8], sorted(map(tuple, c.connected_components(e).collect())))"
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=True)
    assert "True file:/// [(1, 1), (2, 1), (3, 1)]" in out.stdout
