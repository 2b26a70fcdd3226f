"""The registered queries themselves, with their own parameters, against brute force on the smallest tables."""

import re
import unicodedata
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from weft.llm.queries import queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def digest(data: bytes) -> str:
    return sha256(data).hexdigest()


def test_op1_suffix_dedup(spark, texts):
    raw = {d: (r.text or "").encode() for d, r in texts.items()}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    want = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), digest(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries()["op1_suffix_dedup"](spark, SF).collect()} == want
    assert any(w[1] for w in want.values())


def test_op2_substring_dedup(spark, texts):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for d, r in texts.items()}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(tuple(words[d][i : i + 50]), d)
    want = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        want[d] = (len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries()["op2_substring_dedup"](spark, SF).collect()} == want


def test_op7_langid(spark, texts):
    """Held-out rows by the contract's remainder, labels of the learned set, und without letters, and nearly all held-out labels right."""
    got = {r.doc_id: r for r in queries()["op7_langid"](spark, SF).collect()}
    assert got.keys() == texts.keys() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    learned = {r.lang for d, r in texts.items() if r.lang is not None and r.text is not None and crc32(str(d).encode()) % 3 != 1}
    letters = {d for d, r in texts.items() if any(unicodedata.category(c)[0] == "L" for c in r.text or "")}
    assert all((r.lang_pred in learned) if d in letters else r.lang_pred == "und" for d, r in got.items())
    judged = [d for d in letters if got[d].held_out and texts[d].lang is not None]
    assert len(judged) > 30 and sum(got[d].lang_pred == texts[d].lang for d in judged) >= 0.97 * len(judged)


def test_op8_licences(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r.doc_id: r for r in queries()["op8_licences"](spark, SF).collect()}
    for d, row in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (row.text or "").translate(LOWER))
        places = defaultdict(list)
        for phrase, label in phrases.items():
            p = phrase.split()
            places[label] += [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        every = [i for at in places.values() for i in at]
        labels = sorted(label for label, at in places.items() if at)
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | ({""} if not labels else set()) and 0 <= r.score <= 1
