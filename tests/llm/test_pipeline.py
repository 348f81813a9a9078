import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_language import corpus


def test_stages_follow_their_definitions(spark, tmp_path):
    rows = [(i, t, lang) for i, t, lang in corpus(150)]
    n = len(rows)
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(0, 40, 2)]  # copies
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "1234 !!", "yy"), (903, rows[5][1] + " token=abcdef123", rows[5][2]), (904, "ka ti " * 3000, "xx")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = corpus_pipeline.language_stage(spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    left = {r.doc_id: r for r in kept.collect()}
    assert {i for i, _, _ in rows} - set(left) == {900, 901, 902}

    kept = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    groups = brute([(i, r.text) for i, r in left.items()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, component in groups if i == component)

    kept = corpus_pipeline.secret_stage(spark, kept, str(tmp_path))
    texts = {r.doc_id: r.text for r in kept.collect()}
    for i, text in texts.items():
        assert text == re.sub(r"token=abcdef123", "[assign]", left[i].text)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        expected += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    for sequence in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == sequence)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "secret_scan", "best_fit_packing"]
