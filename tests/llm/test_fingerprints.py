import hashlib
import re

from pyspark.sql import functions as F

from barline.llm import fingerprints as FP
from barline.llm.fingerprints import _BASE, _PRIME, GRAM, WINDOW, edited_likeness, fingerprints


def places(text, spark):
    """Places that winnowing must choose, each gram's polynomial made anew from the hashes of its characters."""
    bare = re.sub(r"\s+", "", text or "")
    if not bare:
        return []
    grams = [bare[i : i + GRAM] for i in range(max(1, len(bare) - GRAM + 1))]
    of = {r.x: r.h for r in spark.createDataFrame([(x,) for x in sorted(set(bare))], "x string").selectExpr("x", "hash(x) AS h").collect()}
    hashes = [sum(of[x] * pow(_BASE, len(g) - 1 - k, _PRIME) for k, x in enumerate(g)) % _PRIME for g in grams]
    chosen = []
    for s in range(max(1, len(hashes) - WINDOW + 1)):
        window = hashes[s : s + WINDOW]
        at = s + max(k for k, h in enumerate(window) if h == min(window))
        if at not in chosen:
            chosen.append(at)
    return [f"{hashes[i]:x}@{i:x}" for i in chosen]


def test_fingerprints_equal_plain_winnowing(docs, spark):
    texts = ["", None, "a", "two words", "one two three four five", "the cat sat " * 30, "é" * 100, " ".join(f"w{i * i % 97}" for i in range(150)), "".join(chr(0x1F600 + i * i % 71) for i in range(300)), "".join(f"{i * i % 1009:x}" for i in range(2500))]
    got = {r.doc_id: r for r in fingerprints(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i].fingerprint == ",".join(places(t, spark)) and got[i].n_chars == len(t or "")


def test_a_shared_run_is_always_found(docs):
    run = " ".join(f"r{i}" for i in range(WINDOW + GRAM - 1))
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "xy")
    got = {r.doc_id: set(r.hashes) for r in fingerprints(docs([(1, f"{a} {run} {a}"), (2, f"{b} {run} {b} end")])).collect()}
    assert got[1] & got[2]


def test_edited_texts_follow_descending_ids(docs):
    rows = [(10, "abcdefghi"), (7, "xy"), (3, None), (2, "é" * 9000), (1_000_000_000_000, "top"), (7, "xy"), (None, "none")]
    got = edited_likeness(docs(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    expected = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    equal = [r.fingerprint for r in got if r.doc_id == 7]
    assert equal[0] == equal[1]
    assert edited_likeness(docs([])).collect() == []


def test_a_run_without_spaces_is_found_at_every_offset(docs):
    run = "".join(chr(0x4E00 + i * i % 7919) for i in range(71))
    other = [chr(0x3041 + i * 7 % 80) for i in range(80)]
    rows = [(k, "".join(other[:k]) + run + "".join(other[k:])) for k in range(14)] + [(20, run), (21, "x " + " ".join(run) + " y")]
    got = {r.doc_id: set(r.hashes) for r in fingerprints(docs(rows)).collect()}
    assert all(got[k] & got[20] for k in got)


def test_a_character_in_front_changes_little_and_gaps_in_ids_do_no_harm(docs):
    text = "".join(chr(97 + i * i * 7 % 26) + chr(0x4E00 + i * i % 997) for i in range(3000))
    rows = [(-6 * 10**18, text), (6 * 10**18, "x" + text), (0, ""), (1, text)]
    got = {r.doc_id: r for r in edited_likeness(docs(rows)).collect()}
    assert got[6 * 10**18].near_next > 0.95 and got[1].fingerprint == got[-6 * 10**18].fingerprint and len(got) == 4


def test_runs_of_a_hot_id_and_of_nulls_are_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(FP, "_RUN", 10)
    rows = [(7, f"hot {i}") for i in range(100)] + [(i * 10**12, f"t {i}") for i in range(60)] + [(None, f"none {i}") for i in range(40)]
    df = docs(rows).select("doc_id", "text", F.array().cast("array<bigint>").alias("w"))
    sizes = [r[1] for r in df.groupBy(FP._runs(df)).count().collect()]
    assert max(sizes) < 60
    after = {r.text: r.next_text for r in FP.next_documents(df).collect()}
    seen, at = [], "t 59"
    while at not in seen:
        seen.append(at)
        at = after[at]
    assert len(seen) == 200 == len(set(after.values()))
    by = {t: i for i, t in rows}
    own = [by[t] for t in seen]
    known = [i for i in own if i is not None]
    assert known == sorted(known, reverse=True) and own[160:] == [None] * 40


def test_spliced_equals_a_pass_of_its_own(docs):
    line = "".join(f"{i * i % 1013:x}" for i in range(2000))
    cuts = [0, 1, 5, 23, 24, 25, 47, 70, 71, 72, 95, 118, 119, 120, 200, 500]
    rows = [(i, line[7 * i : 7 * i + a] + "|" + line[3000 : 3000 + b]) for i, (a, b) in enumerate((a, b) for a in cuts for b in cuts)]
    part = lambda k: F.regexp_extract("text", r"^(.*)\|(.*)$", k)
    df = docs(rows).select(part(1).alias("a"), part(2).alias("b"))
    more = lambda x: FP.winnowed(F.concat(x, F.lit(line[5000:5300])))
    odd = df.where(FP.spliced(F.col("a"), more(F.col("a")), F.col("b"), more(F.col("b"))) != FP.winnowed(F.concat("a", "b")))
    assert odd.count() == 0


def test_windows_grow_by_pairs():
    for window in (1, 2, 3, 5, 48, 50):
        steps = FP._grown(window)
        assert 1 + sum(steps) == window and all(k <= 1 + sum(steps[:i]) for i, k in enumerate(steps))
