"""Every registered corpus query over the whole smallest tables, columns and types included, against brute force or its SQL."""
import hashlib
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import tiktoken
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from oddsmill.llm import jpeg, licenses, pii, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def run(spark, name, **types):
    """Rows of a query by doc_id, its first columns being of the contract's names and types."""
    got = queries.queries()[name](spark, SF)
    assert dict(got.dtypes[: len(types)]) == types
    rows = got.collect()
    return rows


def hexed(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == columns
    wanted = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + " FROM expected").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(wanted, key=str)


def test_op6_on_more_documents(spark):
    """On sf0.01 texts lie in several Arrow batches and steps."""
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    wanted = c.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.SUBSTRING_SQL})").fetchall()
    got = queries.queries()["op6_substring_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def brute_identifiers(t):
    """The four patterns as they are written in the contract."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_op1(spark, texts):
    rows = run(spark, "op1_pii", doc_id="bigint", n_email="bigint", n_ip="bigint", n_card="bigint", n_phone="bigint", base_sha256="string", spans="string")
    assert len(rows) == len(texts)
    for r in rows:
        own = brute_identifiers(texts[r.doc_id])
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in own) for k in pii.KINDS)
        assert r.base_sha256 == hexed(shown) and r.spans.startswith(shown)


def test_op3(spark, texts):
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, "op3_byte_bpe", doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id])
        assert tuple(r)[1:] == (len(ids), hexed(",".join(map(str, ids))), hexed(texts[r.doc_id]))


def test_op4(spark, texts):
    def fingerprint(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if root[a] > root[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a], changed = root[b], True
    rows = run(spark, "op4_simhash", doc_id="bigint", fingerprint="string", component_id="bigint")
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: (f"{f:016x}", root[i]) for i, f in fps.items()} and len(rows) == len(texts)


def test_op5(spark, texts):
    rows = run(spark, "op5_media", doc_id="bigint", n_bytes="bigint", payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string")
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        (media,) = jpeg.store([payload])
        (images,) = jpeg.thumbnails([media])
        feature = ",".join(f"{w}x{h}:{jpeg.thumbnail_hash(t)}" for w, h, t in images)
        wanted = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        assert tuple(r)[1:] == wanted and b"".join(t.tobytes() for _, _, t in images) == payload


def test_op7(spark, con, texts):
    def counts(t):
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        twice = {k + x for k, g in enumerate(grams) if grams.count(g) > 1 for x in range(8)} if len(set(grams)) < len(grams) else set()
        lines, seen, again = t.split("\n"), set(), 0
        for x in lines:
            again += bool(WORD.search(x)) and x in seen
            seen.add(x)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(twice)

    rows = run(spark, "op7_quality_rules", doc_id="bigint", n_words="bigint", word_chars="bigint", n_symbols="bigint", n_dup_lines="bigint", n_repeat_words="bigint", base_failed="boolean", kept="boolean")
    assert len(rows) == len(texts)
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    for r in rows:
        own = counts(texts[r.doc_id])
        assert tuple(r)[1:6] == own and r.base_failed == (own[0] < 20 or 100 * own[4] > 30 * own[0]) and not (r.kept and r.base_failed)
    kept = {q: np.mean([r.kept for r in rows if labels.get(r.doc_id) == q]) for q in (0, 1)}
    assert kept[1] > 0.9 and kept[0] < kept[1] - 0.3


def test_op9(spark, texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: tuple(r)[1:4] for r in run(spark, "op9_token_files", doc_id="bigint", start="bigint", n_tokens="bigint", ids_crc32="bigint")}
    start = 0
    for i in sorted(texts):
        ids = np.array([*known.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert rows[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_op10(spark, texts):
    """Every window of every text against every template, without hashes."""
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    shingles = lambda w: [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
    wanted = set()
    for i, t in texts.items():
        w = words(t)
        own = shingles(w)
        for name, text in licenses.TEMPLATES.items():
            whole = words(text)
            if len(whole) < 5:
                hit = [k for k in range(len(w)) if w[k : k + len(whole)] == whole]
                wanted |= {(i, name, 1.0, hit[0], len(hit))} if hit else set()
                continue
            target = set(shingles(whole))
            if not target & set(own):
                continue
            shares = [len(target & set(own[k : k + len(target)])) / len(target) for k in range(len(w))]
            passed = [(-x, k) for k, x in enumerate(shares) if x >= 0.8]
            if passed:
                wanted.add((i, name, -min(passed)[0], min(passed)[1], len(passed)))
    got = {(r.doc_id, r.license, r.containment, r.start_word) for r in queries.queries()["op10_license_scan"](spark, SF).collect()}
    assert got == {x[:4] for x in wanted} and got
