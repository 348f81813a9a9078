import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import topk


def brute(rows, k, every):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in whole if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("queries", [4096, 7])
def test_results_equal_brute_force(spark, monkeypatch, queries):
    for name, value in (("SAMPLE", 40), ("PIVOTS", 5), ("BLOCK", 16), ("QUERIES", queries)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    rows = [(i, [float(np.float32(c + rng.gauss(0, 0.05))) for c in rng.choice(centres)]) for i in range(400)]
    rows += [(400 + i, [0.5] * 6) for i in range(150)]  # one very common vector
    rows += [(1000, None), (1005, []), (1010, [None] * 6), (1015, [float("nan")] + [0.0] * 5), (1020, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, v string, score double")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect())
    assert got == brute(rows, 10, 5)


def test_far_annuli_are_not_expanded():
    rng = np.random.default_rng(1)
    near, far = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, (50, 4)) + 500
    q, pivots = near[:3] + 500, np.array([[0.0] * 4, [500.0] * 4])
    import pyarrow as pa

    rows = []
    for p, x in ((0, near), (1, far)):
        d = topk._distances(x, pivots)[:, p]
        rows.append((p, d.min(), d.max(), np.sqrt((x**2).sum(axis=1).max()), np.arange(50).tobytes(), x.tobytes()))
    batch = pa.RecordBatch.from_pylist([dict(zip(("pivot", "low", "high", "norm", "ids", "vectors"), r, strict=True)) for r in rows])
    best = topk.Best(np.full(3, -np.inf), 5)
    assert topk.expand(best, q, np.full(3, -1), topk._distances(q, pivots), batch) == 3


def test_few_rows_repeats_and_nothing(spark):
    kind = "vec_id bigint, embedding array<float>"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (0, [1.0, 0.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, kind), F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 1024 * 1024), (0, 2, 1, 1024 * 1024)]
    assert topk.top_k(spark.createDataFrame([], kind), F.col("vec_id") % 100 == 0).collect() == []


def test_shorter_vectors_count_as_if_zeros_followed(spark, monkeypatch):
    for name, value in (("SAMPLE", 20), ("PIVOTS", 4), ("BLOCK", 8)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([1, 3, 3, 3, 9]))]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()) == brute([(i, v + [0.0] * (9 - len(v))) for i, v in rows], 10, 5)


def test_large_components_give_exact_scores(spark):
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(-(10**6), 10**6)) + rng.choice([0, 0.5, 1 / 1024]) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0).collect()) == brute(rows, 10, 5)


def test_scores_of_any_size():
    q, v = np.array([[2.0**40, -3.0, 2.0**30]]), np.array([[2.0**12 + 1, 7.0, -(2.0**32)], [2.0**22, 5.0, 1.0]])
    assert topk.scores(q, v).tolist() == [[int(sum(int(a) * int(b) for a, b in zip(q[0], y, strict=True))) for y in v]][0:1]
    with pytest.raises(OverflowError):
        topk.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))
