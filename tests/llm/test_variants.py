"""Spelling variants against their definition on small tables."""

import random
import re
import zlib
from collections import Counter

from barline.llm import variants


def edits(word: str, signs: set) -> set:
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in signs} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in signs}
    return out - {word}


def by_definition(docs: list[tuple]) -> set:
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    signs = {c for w in n for c in w}
    near = {w: edits(w, signs) & n.keys() for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found(spark, docs) -> set:
    rows = variants.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    out = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    base = ["letter", "lettre", "Straße", "ÉTUDE", "étude", "aaaaaa", "information", "informations", "x" * 40]
    docs = []
    for i in range(120):
        said = []
        for _ in range(60):
            w = r.choices(base, range(len(base), 0, -1))[0]
            if r.random() < 0.4:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abé") + w[at + 1 :]])
            said.append(w)
        docs.append((r.choice([None, i, i]), r.choice([" ", "-", "9"]).join(said)))
    return docs


def test_by_definition(spark):
    docs = [*corpus(1), (5, None), (6, ""), (7, "÷÷÷÷÷ ××××× " * 4)]
    assert found(spark, docs) == by_definition(docs)


def test_crowded_chunks_are_cut_further(spark, monkeypatch):
    monkeypatch.setattr(variants, "MOST_PAIRS", 3)
    r = random.Random(2)
    stems = ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) + "ization" for _ in range(300)] + ["over" + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(300)]
    docs = [(i, " ".join(stems)) for i in range(4)]
    assert found(spark, docs) == by_definition(docs)


def test_chains_of_forms(spark):
    words = {"aaaaabbbbb"[k : k + 5]: 3 * 2**k for k in range(6)}
    docs = [(None, " ".join([w] * n)) for w, n in words.items()]
    got = found(spark, docs)
    assert got == by_definition(docs) and {x[2] for x in got} == {"bbbbb"}


def test_ties_and_slips(spark):
    docs = [(None, "words " * 3 + "wordt " * 6 + "wordr " * 6)]
    assert found(spark, docs) == by_definition(docs) and ("words", "wordr", "wordr", 3, 2, 6) in found(spark, docs)
    slips = [(i, "documents") for i in range(2_000)]
    got = found(spark, slips)
    assert got == by_definition(slips) and len(got) > 1


def test_empty_table_extra_columns(spark):
    assert found(spark, []) == set()
    rows = spark.createDataFrame([(1, "alpha alpha alpha", "q", 4)] * 2, "doc_id bigint, text string, word string, n int")
    assert [(r.word, r.n) for r in variants.spelling_variants(rows).collect()] == [("alpha", 6)]


def test_a_very_long_run(spark):
    long = "ab" * 30_000
    docs = [(None, " ".join([long] * 6)), (None, " ".join([long + "c"] * 3))]
    got = {(len(r.word), r.form and len(r.form), r.n_near) for r in variants.spelling_variants(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {(60_000, None, 1), (60_001, 60_000, 1)}
