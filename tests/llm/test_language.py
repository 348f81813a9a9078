import random
import zlib

import numpy as np
import pyarrow as pa

from barline.llm import language as L

SYLLABLES = {"xx": ["ka", "ti", "mo", "ru"], "yy": ["sch", "ung", "ü", "eit"], "zz": ["ción", "ñ", "que", "os"]}


def text(lang, rng, words=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, text(lang := rng.choice([*SYLLABLES]), rng, rng.randint(1, 60)), lang) for i in range(n)]


def test_held_out_accuracy_and_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "src", 1) for r in rows], "doc_id bigint, text string, lang string, id string, score bigint")
    extra = spark.createDataFrame([(900, None, "xx"), (901, "", "xx"), (902, "12 + 3!", "yy"), (903, "é", None), (None, "ka ti", "xx"), (904, "—…", "zz"), (905, "katimoru " * 20_000, None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in L.identify_documents(df.select("doc_id", "text", "lang").unionByName(extra)).collect()}
    assert len(got) == len(rows) + 7
    for i in (900, 901, 902, 904):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[903].lang_pred in SYLLABLES and got[905].lang_pred == "xx" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    own = [(got[i].lang_pred == lang) for i, _, lang in rows if got[i].held_out]
    assert len(own) > 30 and sum(own) >= 0.95 * len(own)


def test_tables_give_the_network_s_responses():
    raw = [x.encode() for _, x, _ in corpus(30)]
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = L._windows(flat, at[:-1], at[1:])
    net = L.train(w, [lang for _, _, lang in corpus(30)], steps=3)
    e = net.embed[w.astype(int)]
    direct = np.concatenate([sum(e[:, j : L.LENGTH + j] @ f[j] for j in range(len(f))).max(axis=1) for f in net.filters], axis=1)
    assert np.allclose(L._pooled(w, net.tables(), net.bias.astype(np.float32)), np.maximum(direct + net.bias, 0), atol=1e-4)


def test_no_labels_and_no_rows(spark):
    kind = "doc_id bigint, text string, lang string"
    got = L.identify_documents(spark.createDataFrame([(1, "ka", None)], kind)).collect()
    assert [tuple(r) for r in got] == [(1, got[0].held_out, "und", 0.0)]
    assert L.identify_documents(spark.createDataFrame([], kind)).collect() == []


def test_every_window_of_a_long_text_counts():
    rng = random.Random(2)
    rows = corpus(120)
    raw = [t.encode() for _, t, _ in rows]
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    net = L.train(L._windows(flat, at[:-1], at[1:]), [lang for _, _, lang in rows])
    long = text("yy", rng, 30) + " " + text("zz", rng, 4000)
    best, _ = L.predict(net, pa.array([long, None, "123"]))
    assert net.languages[best[0]] == "zz" and best[1:].tolist() == [-1, -1]


def test_every_language_is_learned_and_repeated_rows_count_once(spark):
    rng = random.Random(3)
    rows = [(i, f"l{i % 70}" + text("xx", rng, 3), f"l{i % 70}") for i in range(280)] + [(1000, "ka ti mo", "l0")] * 3000
    windows, labels = L.training_windows(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(labels) == learned and len(learned) > 64
    assert len(windows) == len(labels) < 300 * L.WINDOWS
