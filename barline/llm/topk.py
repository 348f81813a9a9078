"""Exact search for the largest integer inner products, over a pivot-distance index.

A few pivots come from a bounded sample. Each vector is keyed by its nearest pivot and its distance to it; sorted by that
key, runs of vectors form blocks, each an annulus of its pivot with a least and a greatest distance and a greatest norm.
As |q - y| >= |d(q, p) - d(y, p)| and 2<q, y> = |q|^2 + |y|^2 - |q - y|^2, an annulus bounds every score in it. Annuli are
expanded from the greatest bound down, and a search stops at the first whose bound is below its k-th score so far. The
first such score comes from the sample. Queries are answered in blocks against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import kept, parts

#: Rows of the sample; pivots chosen from it; vectors in a block; queries answered together.
SAMPLE, PIVOTS, BLOCK, QUERIES = 4096, 32, 1024, 4096
#: Below every score.
_NONE = np.iinfo(np.int64).min


def whole_vectors(table: DataFrame, *, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component as double. Rows without an id or with null, non-finite or no components are left out.
    Lengths may differ: a shorter vector counts as if zeros followed."""
    x = F.col("v")
    v = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size(x) > 0))
    v = v.where(~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return v.select("vec_id", F.transform(x, lambda e: F.floor(e * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, the shorter ones followed by zeros."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if not len(n) or n.min() == n.max():
        return flat.reshape(len(n), n[0] if len(n) else 0)
    out = np.zeros((len(n), n.max()))
    out[np.arange(n.max()) < n[:, None]] = flat
    return out


def scores(q: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers held as doubles: in doubles while no sum can pass 2^53, then in bigints, then in
    unbounded integers, of which one that is no bigint is an error."""
    d = min(q.shape[1], vectors.shape[1])  # behind it one of the two is zero
    q, vectors = q[:, :d], vectors[:, :d]
    most = np.abs(q).max(initial=0) * np.abs(vectors).max(initial=0) * d
    if most < 1 << 53:
        return (q @ vectors.T).astype(np.int64)
    q, vectors = q.astype(np.int64), vectors.astype(np.int64)
    return q @ vectors.T if most < 1 << 62 else (q.astype(object) @ vectors.astype(object).T).astype(np.int64)


def _spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those chosen before."""
    chosen, near = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = min(x.shape[1], pivots.shape[1])
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x[:, :d] @ pivots[:, :d].T
    return np.sqrt(np.maximum(square, 0))


class Best:
    """The best (score, smaller id) of each query so far; starts at scores that k rows are known to reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, np.where(least == -np.inf, _NONE, least).astype(np.int64)
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query, ids, score = np.append(self.query, query), np.append(self.ids, ids), np.append(self.score, score)
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        own = rank < self.k
        self.query, self.ids, self.score = query[own], ids[own], score[own]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])


def expand(best: Best, q: np.ndarray, q_ids: np.ndarray, q_to_pivots: np.ndarray, blocks: pa.RecordBatch) -> int:
    """Searches the annuli of ``blocks``; returns how many (query, annulus) pairs were expanded."""
    pivot, low, high, norm = (blocks.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "low", "high", "norm"))
    d = q_to_pivots[:, pivot]
    gap = np.maximum(np.maximum(low - d, d - high), 0)
    bound = ((q**2).sum(axis=1)[:, None] + norm**2 - gap**2) / 2
    bound = np.minimum(bound, np.sqrt((q**2).sum(axis=1))[:, None] * norm) * (1 + 1e-9) + 1
    expanded = 0
    for b in np.argsort(-bound.max(axis=0), kind="stable").tolist():
        active = np.flatnonzero(bound[:, b] >= best.least)
        if not len(active):
            continue
        expanded += len(active)
        ids = np.frombuffer(blocks.column("ids")[b].as_buffer(), np.int64)
        vectors = np.frombuffer(blocks.column("vectors")[b].as_buffer(), np.float64).reshape(len(ids), -1)
        score = scores(q[active], vectors)
        row, column = np.nonzero((score >= best.least[active][:, None]) & (ids != q_ids[active][:, None]))
        best.add(active[row], ids[column], score[row, column])
    return expanded


def pivot_index(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of (vec_id, v): pivot, low, high, norm (greatest), ids, vectors. Every row is in one block; a very common vector has many blocks."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["vec_id", "v", "pivot", "distance"])

    names = ["pivot", "low", "high", "norm", "ids", "vectors"]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            pivot, d, rows = batch.column("pivot").to_numpy(), batch.column("distance").to_numpy(), []
            starts = np.flatnonzero(np.append(True, pivot[1:] != pivot[:-1])) if len(ids) else []
            for s, e in zip(starts, [*starts[1:], len(ids)], strict=True):
                for i in range(int(s), int(e), BLOCK):
                    j = min(i + BLOCK, int(e))
                    rows.append((int(pivot[i]), float(d[i:j].min()), float(d[i:j].max()), float(np.sqrt((x[i:j] ** 2).sum(axis=1).max())), ids[i:j].tobytes(), x[i:j].tobytes()))
            if rows:
                kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    keyed = vectors.mapInArrow(key, "vec_id bigint, v array<double>, pivot int, distance double")
    lined = keyed.repartitionByRange(parts(vectors.sparkSession), "pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id")
    return lined.mapInArrow(block, "pivot int, low double, high double, norm double, ids binary, vectors binary")


def top_k(table: DataFrame, is_query, *, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` (a Column) picks, its ``k`` largest inner products with other rows.

    Ties go to the smaller vec_id; a row with the query's own id is no candidate; fewer candidates give fewer rows. A
    repeated candidate row counts each time; a repeated query row is answered once for each of its vectors. Rows that
    ``whole_vectors`` leaves out take no part. Scores are exact; one beyond a bigint is an error. Each block of about QUERIES
    queries is a job of its own, whose result is written before the next begins.
    """
    spark = table.sparkSession
    vectors = kept(whole_vectors(table, id_col=id_col, vector_col=vector_col, scale=scale))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks().to_batches()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not sample:
        return empty
    seen, seen_ids = _matrix(sample[0].column("v")), sample[0].column("vec_id").to_numpy()
    pivots = _spread_out(seen, PIVOTS)
    index = kept(pivot_index(vectors, pivots))
    asked = vectors.where(is_query).dropDuplicates(["vec_id", "v"])
    n = asked.count()
    blocks = 1 + n // QUERIES
    asked = kept(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))) if blocks > 1 else asked.withColumn("block", F.lit(0))
    found = []
    for b in range(blocks):  # each holds about QUERIES queries
        own = asked.where(F.col("block") == b).select("vec_id", "v").toArrow().combine_chunks().to_batches()
        if not own:
            continue
        q, q_ids = _matrix(own[0].column("v")), own[0].column("vec_id").to_numpy()
        first = np.where(q_ids[:, None] == seen_ids, _NONE, scores(q, seen))
        least = np.sort(first, axis=1)[:, -k] if len(seen_ids) > k else np.full(len(q), _NONE)
        held = spark.sparkContext.broadcast((q, q_ids, _distances(q, pivots), least))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, q_ids, d, least = held.value
            best = Best(least, k)
            for batch in batches:
                if batch.num_rows:
                    expand(best, q, q_ids, d, batch)
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(q_ids[best.query]), pa.array(best.ids), pa.array(best.score)], ["q", "query_id", "vec_id", "score"])

        some = index.mapInArrow(search, "q bigint, query_id bigint, vec_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found.append(kept(some.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))._kept_at)
        held.destroy()
    return spark.read.schema(empty.schema).parquet(*found) if found else empty
