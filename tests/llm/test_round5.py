"""Findings of the third round's second check: what the pipeline's workers hold, and op9's pieces."""
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("xxhash")

from oddsmill.llm import common, pii, quality, simhash, tokenfiles  # noqa: E402


def anonymous_mb() -> float:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_tasks_leave_their_worker_no_free_memory():
    kept = []

    def run(batches):
        held = [np.ones(10_000) for _ in range(2000)]
        kept.append(np.ones(10_000))  # lies above, so that the allocator can't simply lower the heap's end
        yield from batches
        del held

    before = anonymous_mb()
    list(common.lean(run)(iter([])))
    assert anonymous_mb() - before < 60


def test_slices_take_null_texts():
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * 700_000, None, "y" * 700_000, None])], names=["t"])
    parts = list(common.slices(iter([batch]), "t"))
    assert [p.num_rows for p in parts] == [3, 2]


def test_stages_take_little_text_at_a_time(spark):
    """Null, empty and long texts go through the stages that cut batches; what comes out doesn't depend on the cuts."""
    words = [f"word{k % 997}x{k % 89}" for k in range(60_000)]
    rows = [(1, None), (2, ""), (3, " ".join(words)), (4, "mail a.b@example.org now"), (5, " ".join(words[::-1])), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.n_words for r in quality.statistics(docs).collect()} == {1: 0, 2: 0, 3: 60_000, 4: 3, 5: 60_000, 6: 0}
    got = {r.doc_id: r.fp[0] for r in simhash.fingerprints(docs).collect()}
    assert len(got) == 6 and got[1] == got[2] == got[6] == 0
    assert {r.doc_id: r.n_email for r in pii.spans(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def cut_by_pattern(word: bytes) -> list[bytes]:
    """Pieces of a word, a character class at a time: the rule in words."""
    out = [word[:1]]
    for a, b in zip(word, word[1:], strict=False):
        kind = ["letter" if chr(c).isalpha() else "digit" if chr(c).isdigit() else "mark" if 33 <= c <= 126 else "" for c in (a, b) if c < 128]
        apart = len(kind) == 2 and all(kind) and (kind[0] != kind[1] or kind[0] == "digit") and not (a == ord("'") and kind[1] == "letter")
        if apart:
            out.append(b"")
        out[-1] += bytes([b])
    return out


def test_pieces_of_texts():
    rng = np.random.default_rng(5)
    alphabet = ["a", "Z", "7", "0", "'", "!", "-", "~", "é", "ß", "ſ", "中", "\x01", "\x7f", " ", "\n", "\t"]
    own = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 40, 400)] + ["", "  ", "don't 3'4 'tis", "x"]
    got, doc = tokenfiles.pieces(pa.array([t.encode() for t in own], pa.binary()))
    expected = [(k, p) for k, t in enumerate(own) for w in t.encode().split() for p in cut_by_pattern(w)]
    assert list(zip(doc.tolist(), got.to_pylist(), strict=True)) == expected


def test_ids_are_the_librarys_whatever_is_forgotten(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = tokenfiles.Tokens(path), Tokenizer.from_file(path)
    monkeypatch.setattr(tokenfiles, "MEMO", 40)
    rng = np.random.default_rng(6)
    alphabet = ["a", "b", "Th", "e", "7", "'", "'s", "!", "é", "É", "H̱", "ſ", "中", " ", " ", "\n", "\x1c", "\xa0", "<|endoftext|>"]
    for _ in range(12):
        some = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(0, 60, 40)]
        got = own.ids([t.encode() for t in some], 2)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in some]
        assert len(own.memo) + len(own.older) < 2500


def test_bytes_that_are_no_utf8_have_ids():
    """Before, a piece was remembered by its decoded text, and not found by its bytes."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    own = tokenfiles.Tokens(public_tokenizers.path("word_bpe_49k.json"))
    (got,) = own.ids([b"one \xff\xfe two"], 2)
    assert np.frombuffer(got, "<u4").tolist() == [*own.tokenizer.encode("one �� two", add_special_tokens=False).ids, 2]
