import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barline.llm.packing import pack_documents, pack_pieces, plan_packing
from barline.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_ids_equal_the_library():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "É", "H̱", " ", "\n", "\xa0", "\x1c", "\x85", "'s", "don't", "'re", "'", "1", "23", "!", "漢", "İ", "ß", "<|endoftext|>", "\x00", "😀", "½", "a" * 70, "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    own = WordIds(PATH).packed(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_places_every_piece_once_and_close_to_best_fit():
    rng = np.random.default_rng(5)
    for n in (1, 30, 1500):
        lengths = np.sort(np.minimum(512, 1 + rng.lognormal(4, 1, n).astype(np.int64)))
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        plan = plan_packing(counts, 512)
        rank = np.concatenate([np.arange(counts[k]) for k in sorted(counts)])
        sequence, place = plan.locate(lengths, rank)
        order = np.lexsort((place, sequence))
        s, p, m = sequence[order], place[order], lengths[order]
        first = np.append(True, s[1:] != s[:-1])
        assert (p[first] == 0).all() and (p[~first] == (p + m)[:-1][~first[1:]]).all() and (p + m).max() <= 512
        assert plan.sequences == first.sum() <= best_fit_decreasing(lengths.tolist(), 512)
    assert plan_packing({}, 512).sequences == 0


def counted(lengths):
    return dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))


def test_plan_is_never_worse_than_best_fit_nor_below_its_bound():
    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 513, 4000), rng.integers(125, 251, 4000), rng.integers(175, 350, 4000), np.append(rng.integers(1, 40, 2000), rng.integers(150, 513, 2000)), np.repeat([171, 100, 250, 50], [3000, 1000, 500, 700])):
        plan = plan_packing(counted(lengths), 512)
        assert max(plan.bound, lengths.sum() / 512) - 1e-6 <= plan.sequences <= best_fit_decreasing(lengths.tolist(), 512)


def test_program_finds_the_perfect_packing_of_few_lengths():
    n = 400  # 1100 + 474 + 474 and 900 + 900 + 248 are full; best-fit decreasing pairs 1100 with 900
    plan = plan_packing({1100: n, 900: n, 474: 2 * n, 248: n // 2}, 2048)
    assert plan.sequences == n + n // 2 and abs(plan.bound - plan.sequences) < 1e-6
    assert best_fit_decreasing([1100] * n + [900] * n + [474] * 2 * n + [248] * (n // 2), 2048) > plan.sequences


def test_documents_to_sequences(docs, spark):
    texts = [(1, None), (2, ""), (3, "word " * 5000), (4, "some text"), (4, "some text"), (5, "x " * 2047), (6, "x " * 2048)]
    rows = pack_documents(docs(texts), PATH, with_ids=True).collect()
    library = Tokenizer.from_file(PATH)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 2048
    for doc, text in dict(texts).items():
        own = sorted((r.piece, r.start, r.ids) for r in rows if r.doc_id == doc)
        if doc != 4:
            assert [i for x in own for i in x[2]] == [*library.encode(text or "", add_special_tokens=False).ids, 0]
            assert all(len(x[2]) == 2048 for x in own[:-1]) and [x[1] for x in own] == [2048 * k for k in range(len(own))]
    assert sum(r.doc_id == 4 for r in rows) == 2 and sum(r.doc_id == 6 for r in rows) == 2
    assert pack_documents(docs([]), PATH).collect() == []


def test_pack_pieces_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, "a"), (1, 0, 5, "a")], "doc_id bigint, piece int, length bigint, note string")
    rows = pack_pieces(df, capacity=5).collect()
    assert {r.sequence_id for r in rows} == {0, 1} and all(r.note == "a" for r in rows)
