import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from barline.llm.pieces import Pieces, decode_documents, encode_documents, piece_digests

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_and_decoded_texts_equal_the_library():
    rng = random.Random(2)
    parts = ["a", "the", "The ", " ", "  ", "   ", "\n", "\n ", "▁", "x▁y", "é", "漢", "😀", "\t", "\x00", "\x01", "1", "<s>", "<0x0A>", "�", "longword" * 12, " word", "\r\n", "\xa0", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(3000)]
    count, ids, shown = Pieces(PATH).read(texts)
    expected = [LIBRARY.encode(t) for t in texts]
    assert ids == [",".join(map(str, x)) for x in expected] and count == list(map(len, expected))
    assert shown == [LIBRARY.decode(x) for x in expected]


def test_a_difference_from_the_library_fails():
    own = Pieces(PATH)
    own.table.made = own.table.made[::-1]
    with pytest.raises(ValueError):
        own.read(["some ordinary words"])


def test_frames(docs):
    df = docs([(1, None), (2, ""), (3, "Some words.\nMore"), (3, "Some words.\nMore"), (None, "x" * 200_000)])
    rows = piece_digests(df, PATH).collect()
    by = {r.doc_id: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 5 and (by[1].n_tokens, by[1].ids_sha256, by[2].decoded_sha256) == (0, nothing, nothing)
    ids = LIBRARY.encode("x" * 200_000)
    assert by[None].n_tokens == len(ids) and by[None].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode_documents(encode_documents(df, PATH), PATH).collect()}
    assert back == {1: "", 2: "", 3: "Some words.\nMore", None: "x" * 200_000}
    assert piece_digests(df.limit(0), PATH).collect() == []
