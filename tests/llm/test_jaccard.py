import random
import re

import pytest

from barline.llm import jaccard
from barline.llm.components import components
from barline.llm.jaccard import drop_near_duplicates, jaccard_components

LOWER = {65 + i: 97 + i for i in range(26)}


def brute(rows):
    """(doc_id, n_shingles, component) of (doc_id, text) rows with distinct ids, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def corpus(rng):
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 6, 9, 20, 80, 300]))]
        texts.append(base)
        for _ in range(rng.randint(0, 8)):  # near copies, some of copies
            copy = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    for _ in range(25):  # documents around one passage, near the threshold
        texts.append([rng.choice(words) for _ in range(rng.randint(0, 14))] + passage + [rng.choice(words) for _ in range(rng.randint(0, 3))])
    return [(i, rng.choice([" ", "\n", "\t "]).join(t).title()) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (903, None)]


@pytest.mark.parametrize("seed,frequent,crowd,block", [(1, 64, 2, 4), (2, 3, 128, 2048), (3, 2, 1, 100)])
def test_components_equal_those_of_all_pairs(docs, monkeypatch, seed, frequent, crowd, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SEGMENT", 1 << 12)
    monkeypatch.setattr(jaccard, "GROUP", 500)
    rows = corpus(random.Random(seed))
    got = sorted(tuple(r) for r in jaccard_components(docs(rows).repartition(3)).collect())
    assert got == brute(rows)


def test_index_keys_meet_for_every_linked_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(4, 120))
        pool = np.unique(rng.integers(0, 1 << 62, 3 * n).astype(np.uint64))
        often = set(rng.choice(pool, int(len(pool) * rng.random()), replace=False).tolist())
        x = np.sort(rng.choice(pool, n, replace=False))
        drop, add = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.choice(pool, add)]))
        both = len(np.intersect1d(x, y))
        assert both <= jaccard.shared_at_most(jaccard.sketch(x), len(x), jaccard.sketch(y), len(y))
        if 100 * both >= 80 * (len(x) + len(y) - both) and not np.array_equal(x, y):
            flags = [np.array([t in often for t in z.tolist()], bool) for z in (x, y)]
            assert len(np.intersect1d(jaccard.index_keys(x, flags[0], 80), jaccard.index_keys(y, flags[1], 80)))


def test_components_of_a_long_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.set_id: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(50)}


def test_repeats_nulls_and_empties(docs):
    text = "one two three four five six seven eight nine ten"
    df = docs([(5, text), (5, text), (3, text.upper()), (None, text), (7, None), (8, "")])
    assert sorted((tuple(r) for r in jaccard_components(df).collect()), key=str) == sorted([(5, 6, 3), (5, 6, 3), (3, 6, 3), (None, 6, 3), (7, 0, 7), (8, 0, 8)], key=str)
    left = drop_near_duplicates(df)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [3, 7, 8] and left.schema == df.schema
    assert jaccard_components(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        jaccard_components(df, percent=50)


def test_one_document_of_each_group_stays(docs):
    text, other = "one two three four five six seven eight nine ten", "a b c d e f g"
    df = docs([(5, text), (3, text.upper()), (3, text.upper()), (3, other), (3, text.title()), (9, other), (None, "x y"), (None, "x y"), (4, ""), (4, ""), (None, None)])
    left = drop_near_duplicates(df.withColumnRenamed("id", "_id"))
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in left.collect()), key=str)
    assert got == sorted([(3, text), (3, other), (None, "x y"), (4, ""), (4, ""), (None, "")], key=str)
