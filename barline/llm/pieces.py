"""SentencePiece encoding and decoding for merge-type models with byte fallback.

A text is laid out as the library does it: a space in front, spaces as the word mark. No piece holds a word mark behind
another sign, nor a line break, so words and line breaks are encoded each for itself. A word starts as its characters;
the agenda of adjacent pairs, ordered by the score of the piece that a pair makes, leftmost first among equals, merges the
best pair until none is left. Characters that are no piece become byte pieces. Each worker keeps a table of known words,
and in each Arrow batch all words new to it are checked against the library: a difference fails the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import slices
from barline.llm.merges import MergeTable

#: Words a worker keeps; beyond it the table starts anew, which costs time only.
KNOWN_WORDS = 500_000
MARK, _CUT = "▁", "\x01"
_SPACED = re.compile(" +[^ \n]*|\n|[^ \n]+")


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i) for i in range(n)]
        self.text = [self.library.id_to_piece(i) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in ids):
            raise ValueError("a piece joins words or lines")
        self.vocabulary = n
        symbol = {c: ids.get(c, n + ord(c)) for p in ids for c in p}
        self.symbol = {c: i for c, i in symbol.items() if i < n}
        known = symbol | ids
        merges = sorted(
            (-self.library.get_score(i), known[p[:k]], known[p[k:]], i)
            for p, i in ids.items()
            for k in range(1, len(p))
            if p[:k] in known and p[k:] in known
        )
        scores, left, right, made = (np.array(c) for c in zip(*merges, strict=True))
        self.table = MergeTable(left, right, np.unique(scores, return_inverse=True)[1], made, n + 0x110000)
        self.bytes = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.shows = [x.replace(MARK, " ") for x in self.text]
        self.known: dict[str, tuple[str, str, int]] = {}

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, each with the spaces before it, and line breaks; and where each text's words start."""
        own = []
        for text in texts:
            text = text.replace(MARK, " ")
            if "  " in text or text[:1] == " " or _CUT in text:
                own.append(None)
            else:
                own.append((" " + text).replace("\n", f"{_CUT}\n{_CUT}").replace(" ", f"{_CUT} ") if text else "")
        parts = pc.split_pattern(pa.array([x or "" for x in own], pa.large_string()), _CUT)
        flat, at = parts.flatten(), parts.offsets.to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        flat, at = flat.filter(full), np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at]
        odd = [i for i, x in enumerate(own) if x is None]
        if odd:  # runs of spaces stay with the word behind them
            found = {i: _SPACED.findall(" " + texts[i].replace(MARK, " ")) for i in odd}
            flat, upto = flat.to_pylist(), at.tolist()
            each = [found.get(i) or flat[upto[i] : upto[i + 1]] for i in range(len(texts))]
            flat, at = pa.array([w for x in each for w in x], pa.large_string()), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return flat, at

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        flat = "".join(words).replace(" ", MARK)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        own, back = np.unique(code, return_inverse=True)
        start = np.array([self.symbol.get(chr(c), self.vocabulary + c) for c in own.tolist()], np.int32)[back]
        merged, at = self.table.encode(start, at)
        if (merged >= self.vocabulary).any():  # characters without a piece
            out, count = [], np.ones(len(merged), np.int64)
            for i in np.flatnonzero(merged >= self.vocabulary).tolist():
                raw = chr(int(merged[i]) - self.vocabulary).encode()
                out.append(self.bytes[list(raw)])
                count[i] = len(raw)
            many = np.repeat(merged, count)
            many[np.repeat(merged >= self.vocabulary, count)] = np.concatenate(out)
            merged, at = many, np.concatenate([[0], np.cumsum(count)])[at]
        flat, at = merged.tolist(), at.tolist()
        return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]

    def decode_words(self, ids: list[list[int]]) -> list[str]:
        """What each run of ids says, marks as spaces; bytes that make no character become U+FFFD, one for each."""
        low, high = int(self.bytes.min()), int(self.bytes.max())
        show = self.shows
        out = []
        for each in ids:
            if min(each) > high:
                out.append("".join([show[i] for i in each]))
                continue
            said, raw = [], bytearray()
            for i in [*each, -1]:
                if low <= i <= high:
                    raw.append(i - low)
                    continue
                if raw:
                    said.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                if i >= 0:
                    said.append(show[i])
            out.append("".join(said))
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes and decodes words that aren't known yet and holds the ids against the library's."""
        ids = self.encode_words(words)
        # Line breaks, which are words of their own, keep the words apart when the library reads them in one text.
        (gap,) = self.encode_words(["\n"])
        expected = self.library.encode("\n" + "\n".join(words), num_threads=1)
        if expected != [*self.library.encode("\n", num_threads=1), *(x for i, each in enumerate(ids) for x in (gap * (i > 0) + each))]:
            raise ValueError("ids differ from the sentencepiece library's")
        self.known.update(zip(words, zip((",".join(map(str, x)) for x in ids), self.decode_words(ids), map(len, ids), strict=True), strict=True))

    def read(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Per text how many ids it has, the ids joined by commas, and what they decode to."""
        flat, at = self.words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self.learn(fresh)
        ids, shown, count = zip(*map(self.known.__getitem__, distinct), strict=True) if distinct else ([], [], [])
        upto = np.concatenate([[0], np.cumsum(np.array(count, np.int64)[coded.indices.to_numpy()])])[at]
        offsets = pa.array(at, pa.int32())

        def joined(words, gap: str) -> list[str]:
            each = pa.array(words, pa.string()).take(coded.indices)
            return pc.binary_join(pa.ListArray.from_arrays(offsets, each), gap).to_pylist()

        return np.diff(upto).tolist(), joined(ids, ","), [x[1:] for x in joined(shown, "")]


@cache
def pieces(path: str) -> Pieces:
    """One table for each worker and model."""
    return Pieces(path)


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_tokens, ids_sha256 over the decimal ids, decoded_sha256 over the decoded text.

    Null texts count as empty: no ids, and the digests of nothing. Repeated rows and rows without an id are kept; other
    columns are not read. Texts may be of any length and hold any characters.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                count, ids, shown = own.read([x or "" for x in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, shown), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and ``ids``, an array of piece ids; null texts have none. Rows as in ``piece_digests``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                _, ids, _ = own.read([x or "" for x in batch.column("text").to_pylist()])
                rows = [np.array(x.split(","), np.int32) if x else [] for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """The texts of ``encoded`` (doc_id, ids): doc_id and ``text``; no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            texts = [own.decode_words([x])[0].removeprefix(" ") if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
