"""The filter audit against its definition, one document and one order at a time."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from barline.llm import filters

DOCS, LABELS = "doc_id bigint, text string, source string", "doc_id bigint, quality int, toxic int"
WORD = re.compile("[^\x20\x09-\x0d]+")


def failed(text: str) -> str:
    words = WORD.findall(text)
    return (
        "A" * (len(words) < 50)
        + "B" * (100 * len(set(words)) < 65 * len(words))
        + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        + "D" * bool(re.search("[#$%&*|]", text))
    )


def by_definition(docs: list[tuple], labels: list[tuple]) -> dict:
    texts = [t or "" for _, t, _ in docs]
    least = {}
    for (i, *_), t in zip(docs, texts, strict=True):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out = {}
    for part in {s or "" for *_, s in docs}:
        own = [(i, failed(t) + "E" * (i is not None and least[t] < i)) for (i, _, s), t in zip(docs, texts, strict=True) if (s or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                earlier = sum(c in x[1] for x in own) - len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), earlier, sum(x[1] == c for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[key[1][key[2] - 1]])
    return out


def audited(spark, docs, labels) -> dict:
    rows = filters.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(out) == len(rows)
    return out


def test_every_order_by_definition(spark):
    r = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "é", "漢字", "x", "50%", "a|b", "\x1c", " "]
    texts = [r.choice([" ", "\n", "\t\v"]).join(r.choice(words if r.random() < 0.3 else [f"w{k}" for k in range(90)]) for _ in range(r.choice([0, 3, 49, 50, 51, 90]))) for _ in range(60)]
    docs = [(r.choice([None, *range(50)]), r.choice([None, "", *texts]), r.choice([None, "", "s1", "s2"])) for _ in range(150)]
    docs += [(7, "copy " * 60, "s1")] * 3 + [(3, "copy " * 60, "s2"), (None, "copy " * 60, "s3")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(40)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    assert audited(spark, docs, labels) == by_definition(docs, labels)


def test_bounds_are_exact(spark):
    at = [" ".join(f"w{k}" for k in range(50)), " ".join(["w"] * 18 + [f"x{k}" for k in range(32)] + ["y"] * 2), "A" + "b" * 19, "AA" + "b" * 37]
    docs = [(i, t, "s") for i, t in enumerate(at)]
    assert [failed(t) for t in at] == ["", "", "A", "AC"]
    assert audited(spark, docs, []) == by_definition(docs, [])


def test_empty_table_extra_columns_and_repeats(spark):
    assert audited(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "a", "s", 1, b"x")] * 2, DOCS + ", words int, text_sha256 binary")
    rows = filters.audit(docs, spark.createDataFrame([(1, 1, 0, "z")], LABELS + ", part string")).where("filter_order = 'ABCDE' AND step = 1").collect()
    assert [(r.removed, r.good_lost, r.unique_fails) for r in rows] == [(2, 2, 2)]


def test_statistics_of_a_long_text(spark):
    text = "Ünïcode WORD & " * 300_000
    (row,) = filters.text_statistics(spark.createDataFrame([(1, text, None)], DOCS)).collect()
    assert (row.words, row.distinct_words, row.chars, row.capitals, row.symbols) == (900_000, 3, len(text), 1_200_000, 300_000)
    assert bytes(row.text_sha256) == hashlib.sha256(text.encode()).digest()


@pytest.mark.parametrize("rows", [["a b a", "", "a"], ["", ""], [], ["x" * 9 + " " + "x" * 9], ["é é é", " \n", "q\x1cq q\x1cq"]])
def test_transducer_and_table(rows):
    raw = np.frombuffer("".join(rows).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x.encode()) for x in rows])]).astype(np.int64)
    told, start, end = filters.transduced(raw, at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == [w for x in rows for w in WORD.findall(x)]
    row = np.searchsorted(at, start, side="right") - 1
    fresh = filters.distinct_words(raw, start, end, row)
    assert np.bincount(row[fresh], minlength=len(rows)).tolist() == [len(set(WORD.findall(x))) for x in rows]


def test_table_survives_equal_hashes(monkeypatch):
    monkeypatch.setattr(filters, "_BASE", np.uint64(1))
    monkeypatch.setattr(filters, "_BACK", np.uint64(1))  # anagrams now share a hash
    words = ["abc", "bca", "cab", "abc", "cba", "bca"]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    start = np.arange(6) * 3
    assert filters.distinct_words(raw, start, start + 3, np.zeros(6, np.int64)).tolist() == [True, True, True, False, True, False]
