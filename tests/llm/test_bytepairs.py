"""Byte-level BPE against tiktoken, exact round trips, offsets and split characters."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from barline.llm import bytepairs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SIGNS = ["'s", "'ll", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "B", "é", "1", "２", "²", "!", "?", "…", "漢", "字", "😀", "́", " ", " ", "\x85", "\x1c", "\r\n", "'d", "x", "'ve", "<|endoftext|>", "한", "͸", "_", "\U0001f468‍\U0001f469"]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts() -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, 40))) for _ in range(3_000)]


def test_digests(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, None, "y"), (7, "", "y"), (7, "", "y"), (-1, "long text 12 " * 200_000 + "'", "z")]
    out = bytepairs.byte_pair_digests(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), PATH, PATTERN).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    key = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, out), key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert bytepairs.byte_pair_digests(spark.createDataFrame([], "doc_id bigint, text string"), PATH, PATTERN).collect() == []


def test_round_trip_and_offsets(spark, library):
    rows = list(enumerate([*texts()[:500], None]))
    coded = bytepairs.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, PATTERN)
    shown = {r.doc_id: r for r in bytepairs.decode_documents(coded, PATH, PATTERN).collect()}
    for r in coded.collect():
        text = rows[r.doc_id][1] or ""
        assert r.ids == library.encode_ordinary(text) and shown[r.doc_id].text == text and bytes(shown[r.doc_id].bytes) == text.encode()
        assert len(r.ids) == len(r.starts) == len(r.ends)
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            token = library.decode_single_token_bytes(i)
            assert token in text[a:b].encode() and len(text[a:b]) <= len(token)  # the characters that the token's bytes touch


def test_split_characters(spark, library):
    ids = library.encode_ordinary("😀")
    assert len(ids) > 1
    rows = [(1, ids), (2, ids[:1]), (3, ids[1:] + library.encode_ordinary("a")), (4, []), (5, None)]
    out = {r.doc_id: r for r in bytepairs.decode_documents(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"), PATH, PATTERN).collect()}
    assert out[1].text == "😀" and "�" in out[2].text and out[3].text.endswith("a")
    assert bytes(out[2].bytes) + bytes(out[3].bytes) == "😀a".encode()
    assert out[4].text == out[5].text == ""


def test_kinds_are_asked_once_and_a_full_table_starts_anew(monkeypatch, library):
    own = bytepairs.BytePairs(PATH, PATTERN)
    monkeypatch.setattr(bytepairs, "KNOWN_PIECES", 10)
    for t in texts()[:50]:
        ids, at = own.encode(pa.array([t, None, t]))
        assert ids.tolist() == library.encode_ordinary(t) * 2 and at[1] == at[2]


def test_a_difference_fails(monkeypatch):
    own = bytepairs.BytePairs(PATH, PATTERN)
    own.check = type("Other", (), {"encode_ordinary": staticmethod(lambda x: [0])})()
    with pytest.raises(ValueError, match="tiktoken"):
        own.encode(pa.array(["some text"]))
