"""Audit of how text filters interact: what each of them removes in every order of application.

One pass of a table-driven transducer over the bytes of whole texts counts words, capitals, code points and symbols and marks
the spans of words, which go into a hash table whose matches are verified byte by byte. All else is sums: a document counts
only through its part, the set of filters that it fails and its labels, so 32 sums for each part answer every order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import kept, slices, utf8

#: Filters, each a bit of the set that a document fails, in this order.
FILTERS = "ABCDE"
#: Words a document needs; distinct words it needs, and capitals it may have, in percent of its words and code points.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
#: Signs that no document may hold.
SYMBOLS = b"#$%&*|"
#: Bytes of text that are read at a time.
SLICE = 2 << 20

# The transducer: classes of bytes, the state that a byte leads to, and what is told on the way.
_BLANK, _CAPITAL, _SYMBOL, _PLAIN, _TAIL = range(5)
_BETWEEN, _INSIDE = range(2)
POINT, CAPITAL, SYMBOL, BEGINS, ENDS = (1 << i for i in range(5))


def _class_of(byte: int) -> int:
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return _BLANK
    if 0x80 <= byte <= 0xBF:
        return _TAIL  # of a code point of several bytes
    return _CAPITAL if ord("A") <= byte <= ord("Z") else _SYMBOL if byte in SYMBOLS else _PLAIN


CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)
#: State after a byte, by state and class. Both rows are alike: every byte resets the automaton, so the states of all
#: places follow from one look at each byte, without a step from place to place.
NEXT = np.array([[_BETWEEN if c == _BLANK else _INSIDE for c in range(5)]] * 2, np.uint8)
#: What a byte tells, by the state before it and its class.
TOLD = np.array(
    [
        [(c != _TAIL) * POINT | (c == _CAPITAL) * CAPITAL | (c == _SYMBOL) * SYMBOL | (s == _BETWEEN and c != _BLANK) * BEGINS | (s == _INSIDE and c == _BLANK) * ENDS for c in range(5)]
        for s in (_BETWEEN, _INSIDE)
    ],
    np.uint8,
)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def transduced(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each byte tells, and where words start and end (exclusive); every row (``at``) starts between words."""
    kind = CLASS[raw]
    state = np.append(np.uint8(_BETWEEN), NEXT[_BETWEEN][kind])
    state[at[:-1]] = _BETWEEN
    told = TOLD[state[:-1], kind]
    start = np.flatnonzero(told & BEGINS)
    inside = NEXT[_BETWEEN][kind] == _INSIDE
    last = np.append(told[1:] & ENDS, np.uint8(ENDS)) > 0
    edge = at[1:-1]
    last[edge[edge > 0] - 1] = True  # a row's end is an end of its last word
    return told, start, np.flatnonzero(inside & last) + 1


def distinct_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each word whether it is the first of its row with these bytes, as a verified hash table finds it.

    Spans are hashed by a polynomial over their bytes and put into a table with linear probing; a word that meets another in
    its slot is the same only if row, length and all bytes agree, else it moves on.
    """
    n = len(start)
    first = np.zeros(n, bool)
    if not n:
        return first
    power = np.full(len(raw) + 1, _BASE)
    back = np.full(len(raw) + 1, _BACK)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1]))
    code = (total[end] - total[start]) * back[start]
    del power, back, total
    code ^= row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    bits = int(2 * n).bit_length()
    slot = (code >> np.uint64(64 - bits)).astype(np.int64)
    size = end - start
    table = np.full(1 << bits, -1, np.int32)
    left = np.arange(n)
    while len(left):
        where = slot[left]
        free = table[where] < 0
        table[where[free][::-1]] = left[free][::-1]  # the earliest word takes a free slot
        owner = table[where].astype(np.int64)
        own = owner == left
        first[left[own]] = True
        maybe = np.flatnonzero(~own & (code[owner] == code[left]) & (row[owner] == row[left]) & (size[owner] == size[left]))
        same = own
        same[maybe] = _equal(raw, start[owner[maybe]], start[left[maybe]], size[left[maybe]])
        left = left[~same]
        slot[left] = (slot[left] + 1) & (len(table) - 1)
    return first


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` bytes from ``a`` and from ``b`` agree in every byte."""
    if not len(a):
        return np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(size)])
    step = np.arange(upto[-1]) - np.repeat(upto[:-1], size)
    differ = raw[np.repeat(a, size) + step] != raw[np.repeat(b, size) + step]
    return ~np.logical_or.reduceat(differ, upto[:-1])


STATISTICS = "words bigint, distinct_words bigint, chars bigint, capitals bigint, symbols bigint, text_sha256 binary"


def text_statistics(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, part, and the counts of its whole text with its digest.

    ``part`` is the source, null as the empty string; null texts count as empty. Repeated rows and rows without an id are
    kept, an empty table gives an empty one, and columns beyond these three are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw, at = utf8(batch.column("text"))
                told, start, end = transduced(raw, at)
                at_word = np.searchsorted(start, at)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at_word))
                fresh = distinct_words(raw, start, end, row)
                count = lambda bit, told=told, at=at: np.diff(np.searchsorted(np.flatnonzero(told & bit), at))
                text, cut = memoryview(raw), at.tolist()
                columns = [np.diff(at_word), np.bincount(row[fresh], minlength=len(at) - 1), count(POINT), count(CAPITAL), count(SYMBOL)]
                digests = [hashlib.sha256(text[a:b]).digest() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("part"), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.binary())],
                    ["doc_id", "part", "words", "distinct_words", "chars", "capitals", "symbols", "text_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, part string, {STATISTICS}")


def _bits(*failed: Column) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How many documents there are of each part, set of failed filters (``failed``, a bit each) and labels (``good``, ``toxic``).

    A filter fails a document with fewer than 50 words (A), fewer than 65 distinct words in 100 (B), more than 5 capitals in
    100 code points (C), one of the symbols (D), or a text that a smaller doc_id has too (E). A document without an id has no
    smaller one and is smaller than none. Rows that share an id are documents of their own; an id is good or toxic if any of
    its label rows says so.
    """
    stats = text_statistics(docs)
    own = _bits(
        F.col("words") < LEAST_WORDS,
        100 * F.col("distinct_words") < DISTINCT_PERCENT * F.col("words"),
        100 * F.col("capitals") > CAPITAL_PERCENT * F.col("chars"),
        F.col("symbols") > 0,
    )
    # Repeated rows meet before they are sent, so that no row's copies crowd a task.
    rows = kept(stats.groupBy("doc_id", "text_sha256", "part", own.alias("own")).agg(F.count("*").alias("n")))
    first = rows.where("doc_id IS NOT NULL").groupBy("text_sha256").agg(F.min("doc_id").alias("doc_id")).withColumn("smallest", F.lit(True))
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    whole = rows.join(first, ["text_sha256", "doc_id"], "left").join(said, "doc_id", "left")
    copied = F.col("doc_id").isNotNull() & F.col("smallest").isNull()
    failed = F.col("own") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0)
    no = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    return whole.select("part", failed.alias("failed"), no("good"), no("toxic"), "n").groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, failed by this filter alone, lost, and the filter's share.

    ``shapley`` is what the step's filter removes, summed over all 120 orders. Every part has its 600 rows; an empty table
    has none. See ``text_statistics`` and ``failed_sets`` for nulls, repeated rows and ids.
    """
    sets = failed_sets(docs, labels).groupBy("part", "failed").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"), F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic")
    )
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))  # 32 at most
    steps = [
        {"filter_order": "".join(order), "step": k, "own": 1 << FILTERS.index(name), "before": sum(1 << FILTERS.index(x) for x in order[: k - 1])}
        for order in permutations(FILTERS)
        for k, name in enumerate(order, 1)
    ]
    each = parts.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, own: int, before: int>>")))

    def total(name: str, where) -> Column:
        hit = F.filter("sets", lambda x: where(x["failed"], F.col("s.own"), F.col("s.before")))
        return F.aggregate(hit, F.lit(0).cast("bigint"), lambda acc, x: acc + x[name]).alias(name)

    has = lambda x, bits: x.bitwiseAND(bits) != 0
    here = lambda x, own, before: has(x, own) & ~has(x, before)
    share = F.aggregate("sets", F.lit(0).cast("bigint"), lambda acc, x: acc + F.when(has(x["failed"], F.col("s.own")), x["n"] * (F.lit(120) / F.bit_count(x["failed"])).cast("bigint")).otherwise(0))
    return each.select(
        "part",
        "s.filter_order",
        "s.step",
        total("n", lambda x, own, before: ~has(x, own.bitwiseOR(before))).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda x, own, before: has(x, own) & has(x, before)).alias("redundant"),
        total("n", lambda x, own, before: x == own).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
