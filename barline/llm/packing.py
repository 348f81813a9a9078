"""Best-fit packing of token pieces into fixed-length sequences by a configuration linear program.

Only the histogram of piece lengths (at most one entry per length up to the capacity) comes to the driver. There the
program "cover every length by filled patterns, as few as possible" is solved by multiplicative weights. A length's weight,
the dual, is its share of a sequence times an exponential of how far its coverage lags behind. In each round a knapsack
dynamic program prices the best pattern at the weights; the pattern around every length that lags, if it is worth nearly
as much, is taken so far that no length gets ahead of the next round. The amounts of all rounds are the fractional solution,
and demand times weights over the best pattern's worth bounds from below what any packing needs.

The amounts are rounded down, and what they leave, in patterns that still have room or in new ones, is placed best-fit,
longest first. The program is solved again for what is left a few times; the solution with the fewest sequences is kept,
plain best-fit decreasing being one of them. The plan, some thousand runs of "pieces a..b of length l go to place o of
sequences s..", has a size that depends on the capacity alone.

The pieces find their run by their rank among pieces of equal length. Ranks come from counts of (length, salt) groups, so
that a length which holds a third of all pieces is numbered by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import kept, slices
from barline.llm.tokens import word_ids

#: Rounds of multiplicative weights, how strongly lagging raises a weight, and how far below the best a pattern may be worth.
ROUNDS, RATE, NEAR = 24, 3.0, 0.02
#: How often the program is solved for what rounding left; rows in a numbering group.
SOLVED, GROUP_ROWS = 2, 50_000


# --- the plan, from a histogram -----------------------------------------------------------------------------------


Pattern = dict[int, int]


def _price(weight: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """For each room what the best filling of it is worth, and the length that it takes next or 0; ``weight[l]`` is what a piece of length ``l`` is worth."""
    best, pick = np.zeros(capacity + 1), [0] * (capacity + 1)
    lengths = np.flatnonzero(weight > 0)
    worth = weight[lengths]
    for room, n in enumerate(np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()):
        if room:
            best[room] = best[room - 1]
        if n:
            values = worth[:n] + best[room - lengths[:n]]
            i = int(values.argmax())
            if values[i] > best[room] + 1e-12:
                best[room], pick[room] = values[i], int(lengths[i])
    return best, pick


def _filling(pick: list[int], first: int, capacity: int) -> Pattern:
    """The pattern that holds ``first`` and the best filling of the rest."""
    pattern, room = {first: 1}, capacity - first
    while room > 0:
        length = pick[room]
        if length:
            pattern[length] = pattern.get(length, 0) + 1
        room -= length or 1
    return pattern


def fractional_patterns(demand: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, float]], float]:
    """Patterns and how often each is taken, over no length's demand, and a lower bound of the sequences needed."""
    wanted, share = demand > 0, np.arange(capacity + 1) / capacity
    covered, amounts, bound = np.zeros(capacity + 1), {}, 0.0
    for n in range(1, ROUNDS + 1):
        due, most = n / ROUNDS, min(1.0, (n + 1) / ROUNDS)
        weight = np.where(wanted, share * np.exp(RATE * (due - covered)), 0)
        best, pick = _price(weight, capacity)
        bound = max(bound, float(demand @ weight) / best[capacity])
        for first in np.flatnonzero(wanted & (covered < due))[::-1].tolist():
            near = weight[first] + best[capacity - first] >= (1 - NEAR) * best[capacity]
            if covered[first] >= due or not near and n < ROUNDS:
                continue
            pattern = _filling(pick, first, capacity)
            amount = min((most - covered[length]) * demand[length] / k for length, k in pattern.items())
            if amount > 1e-9:
                for length, k in pattern.items():
                    covered[length] += amount * k / demand[length]
                key = tuple(sorted(pattern.items()))
                amounts[key] = amounts.get(key, 0.0) + amount
    return [(dict(key), x) for key, x in amounts.items()], bound


def best_fit(left: np.ndarray, capacity: int, taken: list[tuple[Pattern, int]]) -> list[tuple[Pattern, int]]:
    """``taken`` (pattern, times) and the pieces in ``left``, longest first, each in the fullest sequence that has room for it.

    Sequences filled alike are one entry, so the work depends on the number of lengths and patterns, not of pieces.
    """
    groups, rooms = [], []

    def opened(pattern: Pattern, times: int, room: int) -> None:
        if times:
            bisect.insort(rooms, (room, len(groups)))
            groups.append((pattern, times))

    for pattern, times in taken:
        opened(pattern, times, capacity - sum(length * k for length, k in pattern.items()))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            i = bisect.bisect_left(rooms, (length, -1))
            room, at = rooms.pop(i) if i < len(rooms) else (capacity, None)
            pattern, times = ({}, n) if at is None else groups[at]
            if at is not None:
                groups[at] = (pattern, 0)
            each = room // length  # that many follow one another into one sequence
            full = min(times, n // each)
            opened(pattern | {length: pattern.get(length, 0) + each}, full, room - each * length)
            n, times = n - full * each, times - full
            if n and times:  # the last of this length
                last = min(n, each)
                opened(pattern | {length: pattern.get(length, 0) + last}, 1, room - last * length)
                n, times = n - last, times - 1
            if at is not None:
                opened(pattern, times, room)
    return [x for x in groups if x[1]]


@dataclass
class Plan:
    """Runs, sorted by (length, first rank): ``times`` sequences from ``sequence`` on take the pieces at ``place``; no packing needs less than ``bound`` sequences."""

    length: np.ndarray
    rank: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    place: np.ndarray
    sequences: int
    bound: float

    def locate(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece, given its rank among the pieces of its length."""
        run = np.searchsorted(self.length << 48 | self.rank, length << 48 | rank, side="right") - 1
        k = rank - self.rank[run]
        return self.sequence[run] + k % self.times[run], self.place[run] + k // self.times[run] * length


def plan_packing(histogram: dict[int, int], capacity: int) -> Plan:
    """How to pack ``histogram[length]`` pieces of each length. Lengths lie in 1..capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken, bound = [], 0.0
    best = best_fit(left, capacity, taken)
    for _ in range(SOLVED if left.any() else 0):
        amounts, low = fractional_patterns(left, capacity)
        bound = bound or low
        whole = [(pattern, int(x + 1e-6)) for pattern, x in amounts if int(x + 1e-6)]
        for pattern, times in whole:
            for length, k in pattern.items():
                left[length] -= k * times
        taken = taken + whole
        packed = best_fit(left, capacity, taken)
        best = min(best, packed, key=lambda x: sum(times for _, times in x))
        if not whole or not left.any():
            break
    rank, runs, sequence = np.zeros(capacity + 1, np.int64), [], 0
    for pattern, times in best:
        place = 0
        for length, n in pattern.items():
            runs.append((length, int(rank[length]), times, sequence, place))
            rank[length] += n * times
            place += n * length
        sequence += times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence, bound=bound)


# --- operators ----------------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every whole text: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A text's ids are the vocabulary's without special tokens, then ``end_id``; a null text counts as empty and has one
    piece of one id. Only longer texts are cut. Repeated rows each have their own pieces; other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for whole in batches:
            for batch in slices(whole, "text", 3 << 20):
                rows = []
                for doc, raw in zip(batch.column("doc_id").to_pylist(), ids.packed([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                    raw += end
                    for k, i in enumerate(range(0, len(raw), size)):
                        own = raw[i : i + size]
                        rows.append((doc, k, i // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    spec = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, spec)


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: pieces of a sequence lie gapless from 0 and fill at most ``capacity``.

    Needs columns doc_id, piece and length (1..capacity); other columns pass through. An empty frame stays empty; equal
    rows get places of their own.
    """
    pieces = kept(pieces)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row per length at most
    plan = plan_packing(histogram, capacity)
    n = sum(histogram.values())
    salts = 1 + max(n // GROUP_ROWS, min(n // 500, 1000))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", *[c for c in ("start", "ids_crc32") if c in pieces.columns])
    ranked = salted.withColumn("_row", F.row_number().over(order)).join(base, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_row") - 1).alias("_rank"))
    width = len(pieces.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, place = plan.locate(batch.column("length").to_numpy().astype(np.int64), batch.column("_rank").to_numpy()) if batch.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(sequence, pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names[:width], "sequence_id", "offset"])

    schema = ranked.select(*pieces.columns, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).schema
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their places in packed sequences; see ``token_pieces`` and ``pack_pieces``."""
    return pack_pieces(token_pieces(docs, vocabulary, capacity=capacity, with_ids=with_ids), capacity=capacity)
