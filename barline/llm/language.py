"""Language identification by a byte convolutional network, trained in numpy on labelled text.

A window of bytes is embedded byte class by byte class; filters of several widths slide over it, the greatest response of
each filter is kept, and a softmax over those names the language. A text is cut into windows of fixed length, all of them
are read, and their probabilities are averaged by the letters in them. For prediction the embedding and the filters are
folded into tables over pairs of byte classes, so a byte costs two look-ups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import slices, utf8

#: Bytes in a window, numbers per byte class, filter widths, filters of each width.
LENGTH, SIZE, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 8
#: Bounds of the training sample: labelled documents per language, windows per document.
PER_LANGUAGE, WINDOWS = 800, 4
STEPS, BATCH, RATE = 300, 128, 0.01
#: Slots in which a language's sample is chosen first.
SLOTS = 16
UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")


def _classes() -> np.ndarray:
    """0 padding, 1-26 letters in either case, then white space, digits, other ASCII, and every byte beyond ASCII for itself in the common ranges."""
    table = np.zeros(256, np.uint8)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) - 96 if c.isalpha() else 27 if c.isspace() else 28 if c.isdigit() else 29
    table[128:192] = 30 + np.arange(64)  # continuation bytes
    table[192:] = 94 + np.minimum(np.arange(64), 7)  # lead bytes
    table[0xD0:] = 102 + (np.arange(0xD0, 256) - 0xD0) // 8
    return table


CLASS_OF = _classes()
KINDS = int(CLASS_OF.max()) + 1


@dataclass
class Network:
    """Weights; ``languages[i]`` is the label of output ``i``."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first and the second pair of four classes in a row add to each filter."""
        t = [[self.embed @ f[j] for j in range(len(f))] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(KINDS * KINDS, -1)
        zero = np.zeros_like(t[0][0])
        first = np.concatenate([pair(x[0], x[1]) for x in t], axis=1)
        second = np.concatenate([pair(x[2] if len(x) > 2 else zero, x[3] if len(x) > 3 else zero) for x in t[1:]], axis=1)
        return first.astype(np.float32), second.astype(np.float32)


def _windows(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte classes of windows from ``start``, padded behind ``end``; three more classes of padding behind each."""
    place = start[:, None] + np.arange(LENGTH + 3)
    own = place < np.minimum(end, start + LENGTH)[:, None]
    return np.where(own, CLASS_OF[raw[np.minimum(place, len(raw) - 1)]], 0)


def _pooled(windows: np.ndarray, tables, bias) -> np.ndarray:
    """The greatest response of each filter over each window."""
    first, second = tables
    w = windows.astype(np.int32)
    pair = w[:, :-1] * KINDS + w[:, 1:]
    response = first[pair[:, :LENGTH]]
    response[:, :, FILTERS:] += second[pair[:, 2 : LENGTH + 2]]
    return np.maximum(response.max(axis=1) + bias, 0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: list[str], *, steps: int = STEPS, seed: int = 0) -> Network:
    """A network for windows of byte classes (as ``_windows`` makes them) and their languages, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(x) for x in labels])
    by_class = [np.flatnonzero(target == i) for i in range(len(languages))]
    features = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.5, (KINDS, SIZE))] + [rng.normal(0, (2 / (w * SIZE)) ** 0.5, (w, SIZE, FILTERS)) for w in WIDTHS]
    p += [np.zeros(features), rng.normal(0, features**-0.5, (features, len(languages))), np.zeros(len(languages))]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    k = len(WIDTHS)
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(x, max(1, BATCH // len(languages))) for x in by_class])
        x, y = windows[rows].astype(np.int64), target[rows]
        e = p[0][x]
        n, grad = np.arange(len(x)), [np.zeros_like(a) for a in p]
        pooled, at = [], []
        for i, w in enumerate(WIDTHS):
            r = sum(e[:, j : LENGTH + j] @ p[1 + i][j] for j in range(w))
            best = r.argmax(axis=1)
            at.append(best)
            pooled.append(np.take_along_axis(r, best[:, None, :], axis=1)[:, 0])
        z = np.concatenate(pooled, axis=1) + p[k + 1]
        h = np.maximum(z, 0)
        d = _softmax(h @ p[k + 2] + p[k + 3])
        d[n, y] -= 1
        d /= len(x)
        grad[k + 2], grad[k + 3] = h.T @ d, d.sum(axis=0)
        dz = (d @ p[k + 2].T) * (z > 0)
        grad[k + 1] = dz.sum(axis=0)
        for i, w in enumerate(WIDTHS):
            g = dz[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                c = x[n[:, None], at[i] + j]
                grad[1 + i][j] = np.einsum("bfs,bf->sf", p[0][c], g)
                np.add.at(grad[0], c, g[:, :, None] * p[1 + i][j].T[None])
        grad[0][0] = 0
        for q, g, a, b in zip(p, grad, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        p[0][0] = 0
    return Network(languages, p[0], p[1 : k + 1], p[k + 1], p[k + 2], p[k + 3])


def predict(network: Network, column: pa.Array, tables=None) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of its language and the probability; -1 and 0 for a text without letters."""
    tables = tables or network.tables()
    raw, at = utf8(column)
    size = np.diff(at)
    count = -(-size // LENGTH)
    of = np.repeat(np.arange(len(size)), count)
    start = at[of] + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * LENGTH
    total = np.zeros((len(size), len(network.languages)))
    letters = np.zeros(len(size))
    bias = network.bias.astype(np.float32)
    for i in range(0, len(of), 512):
        w = _windows(raw, start[i : i + 512], at[of[i : i + 512] + 1])
        weight = (((w > 0) & (w < 27)) | (w >= 94)).sum(axis=1).astype(np.float64)
        chance = _softmax(_pooled(w, tables, bias) @ network.out + network.out_bias)
        np.add.at(total, of[i : i + 512], chance * weight[:, None])
        np.add.at(letters, of[i : i + 512], weight)
    chance = total / np.maximum(letters, 1)[:, None]
    best = chance.argmax(axis=1)
    score = np.minimum(chance[np.arange(len(size)), best], 1.0)
    texts = None
    for row in np.flatnonzero(letters >= 0).tolist():
        own = raw[at[row] : at[row + 1]]
        if letters[row] and (((own | 32) >= 97) & ((own | 32) <= 122) & (own < 128)).any():
            continue
        if letters[row]:  # bytes beyond ASCII only: are there letters among them?
            texts = texts or {}
            if any(c.isalpha() for c in own.tobytes().decode()):
                continue
        best[row], score[row] = -1, 0.0
    return best, score


def _held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Windows of a bounded sample of labelled documents that aren't held out, and their languages.

    At most PER_LANGUAGE documents of every language, the first by a hash, and at most WINDOWS windows of each, spread
    evenly over the whole text. Rows that repeat language, doc_id and text count as one document.
    """
    own = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out(F.col("doc_id")))
    own = own.select("lang", "doc_id", "text", F.xxhash64("text").alias("h"))
    order = [F.xxhash64("doc_id"), F.col("h")]
    slot = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLOTS))).orderBy(*order)  # so that no task sees more than SLOTS * PER_LANGUAGE rows of a language
    picked = own.select("lang", "doc_id", "h").distinct().withColumn("s", F.row_number().over(slot)).where(F.col("s") <= PER_LANGUAGE)
    picked = picked.select("lang", "doc_id", "h", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("r")).where(F.col("r") <= PER_LANGUAGE)
    some = own.join(F.broadcast(picked.drop("r")), ["lang", "doc_id", "h"]).dropDuplicates(["lang", "doc_id", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for i in np.unique(np.linspace(0, max(0, len(raw) - LENGTH), WINDOWS).astype(int)).tolist():
                    rows.append((lang, raw[i : i + LENGTH]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "raw"])

    rows = some.select("lang", "text").mapInArrow(run, "lang string, raw binary").toArrow().sort_by([("lang", "ascending"), ("raw", "ascending")])
    raw = [np.frombuffer(x, np.uint8) for x in rows["raw"].to_pylist()]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    flat = np.concatenate(raw) if raw else np.zeros(0, np.uint8)
    full = np.flatnonzero(np.diff(at) > 0)
    return _windows(flat, at[full], at[full + 1]) if len(full) else np.zeros((0, LENGTH + 3), np.uint8), [rows["lang"][int(i)].as_py() for i in full]


def train_on(docs: DataFrame) -> Network | None:
    """A network trained on the labelled documents of ``docs``; none if there are none."""
    windows, labels = training_windows(docs)
    return train(windows, labels) if labels else None


def identify(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, lang_pred and score, from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, and where there is no network. Repeated rows are kept;
    other columns are not read. Texts may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                if network:
                    best, score = predict(network, batch.column("text"), tables)
                else:
                    best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
                names = [network.languages[i] if i >= 0 else UNKNOWN for i in best.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify_documents(docs: DataFrame) -> DataFrame:
    """The columns of op10: trained on the rows of ``docs`` (doc_id, text, lang) that aren't held out, applied to all of them."""
    found = identify(docs, train_on(docs))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, network: Network | None, *, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least the score ``least``; the others go. Columns stay."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else None
        for whole in batches:
            for batch in slices(whole, names[at], 4 << 20):
                if network:
                    best, score = predict(network, batch.column(at), tables)
                    yield batch.filter(pa.array((best >= 0) & (score >= least)))

    return docs.mapInArrow(run, docs.schema)
