"""Byte-level BPE by a file of ranks: encoding with offsets, and decoding, both with the tokenizers library.

A text is cut where the split pattern cuts it. The classes of signs that the pattern tells apart (letter, number, white
space, other) are asked of the library's own splitter, once for each code point that a worker meets, and the cuts of a whole
Arrow batch then follow from arrays of classes. Each distinct piece that a worker doesn't know yet goes to the library: its
bytes become the characters of the byte alphabet, which the ranks' merges join. All new pieces of a batch are held against the
tiktoken library; a difference fails the job. Decoding turns the characters of tokens back into bytes and puts them together
before they are read as UTF-8, as a character may be split over tokens.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from barline.llm.common import slices, utf8

#: Pieces a worker keeps; beyond it the table starts anew, which costs time only.
KNOWN_PIECES = 800_000
#: Bytes of text that are laid out at a time.
SLICE = 4 << 20
SPACE, LETTER, NUMBER, OTHER, _NEW = range(5)
#: Endings that the pattern takes together with the apostrophe before them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def alphabet() -> list[str]:
    """The character of each byte: printable Latin-1 bytes stand for themselves, the others for characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def ranks_of(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a file: a line holds a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that makes a token, by the rank of what it makes; the two parts of the earliest ranks come first."""
    found = [(r, max(ranks[t[:k]], ranks[t[k:]]), t[:k], t[k:]) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return [(a, b) for _, _, a, b in sorted(found)]


class BytePairs:
    """Encoder and decoder of one file of ranks and one split pattern."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        ranks = ranks_of(path)
        self.letters = alphabet()
        shown = {t: "".join([self.letters[b] for b in t]) for t in ranks}
        self.library = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[(shown[a], shown[b]) for a, b in merges_of(ranks)], ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.check = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.byte = {c: b for b, c in enumerate(self.letters)}
        self.token = {r: bytes([self.byte[c] for c in self.library.id_to_token(r)]) for r in ranks.values()}
        top = max(self.token) + 1
        self.decimals = pa.array([str(i) for i in range(top)], pa.large_string())
        self.tokens = pa.array([self.token.get(i) for i in range(top)], pa.large_binary())
        self.kind = np.full(0x110000, _NEW, np.uint8)
        self.known: dict[bytes, bytes] = {}

    def _kind_of(self, sign: str) -> int:
        """Its class: white space joins a line break, a letter a letter, a number a number."""
        one = lambda before: len(self.split.pre_tokenize_str(before + sign)) == 1
        return SPACE if one("\n") else LETTER if one("a") else NUMBER if one("1") else OTHER

    def kinds(self, code: np.ndarray) -> np.ndarray:
        out = self.kind[code]
        if (out == _NEW).any():
            for c in np.unique(code[out == _NEW]).tolist():
                self.kind[c] = self._kind_of(chr(c))
            out = self.kind[code]
        return out

    def cuts(self, code: np.ndarray, row_at: np.ndarray) -> np.ndarray:
        """Where pieces start in the code points of all rows; ``row_at`` says where rows start and end.

        Runs of one class are pieces, with a space before them if there is one. Of white space before another sign the last
        sign is for itself, or goes with what follows if it is a space. An apostrophe that starts a piece takes its ending.
        """
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kinds(code)
        first = np.zeros(n + 1, bool)
        first[row_at] = True
        change = np.append(True, kind[1:] != kind[:-1]) | first[:-1]
        blank = kind == SPACE
        after_space = np.append(False, code[:-1] == ord(" ")) & ~first[:-1]
        ends = np.append(change[1:], True)  # the last of its run
        start = np.where(blank, change | (ends & ~first[1:]), change & ~after_space)
        quote = np.flatnonzero((code == ord("'")) & start)
        room = row_at[np.searchsorted(row_at, quote, side="right")] - quote  # up to the row's end
        for ending in ENDINGS:
            own = quote[room > len(ending)]
            for i, c in enumerate(ending, 1):
                own = own[code[own + i] == ord(c)]
            start[own + 1] = False
            behind = own + 1 + len(ending)
            behind = behind[~first[behind]]
            start[behind[kind[behind] == LETTER]] = True
        return np.flatnonzero(start)

    def pieces(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all rows of a string column as bytes, and where each row's pieces start."""
        raw, at = utf8(column)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        row_at = np.searchsorted(lead, at)
        start = self.cuts(code, row_at)
        place = np.append(lead[start], len(raw)).astype(np.int64)
        flat = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place), pa.py_buffer(np.ascontiguousarray(raw))])
        return flat, np.searchsorted(start, row_at)

    def encode_pieces(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """The ids of all pieces in order, how many each has, and the code points of its piece that each id shows, as (start, end)."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), []
        coded = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(coded.ids, np.int32), np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words)), coded.offsets

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a run of ids; an id that the ranks don't have fails."""
        return b"".join([self.token[i] for i in ids])

    def learn(self, words: list[bytes]) -> None:
        """Encodes pieces that aren't known yet and holds their ids against tiktoken's."""
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            texts = [w.decode() for w in some]
            ids, count, _ = self.encode_pieces(texts)
            if ids.tolist() != list(chain.from_iterable(map(self.check.encode_ordinary, texts))):
                raise ValueError("ids differ from the tiktoken library's")
            packed, cut = ids.astype("<u4").tobytes(), (4 * np.concatenate([[0], np.cumsum(count)])).tolist()
            self.known.update(zip(some, [packed[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column, and where each row's ids start."""
        flat, at = self.pieces(column)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_PIECES:
            self.known.clear()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self.learn(fresh)
        each = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, first, index = np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum(size)]), coded.indices.to_numpy()
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids[np.repeat(first[index] - upto[:-1], n) + np.arange(upto[-1])], upto[at]

    def said(self, ids: np.ndarray, at: np.ndarray) -> tuple[list[str], list[bytes]]:
        """Per row the decimal ids joined by spaces, and the bytes that they decode to."""
        place, lists = pa.array(ids, pa.int64()), pa.array(at, pa.int64())
        joined = lambda of, gap: pc.binary_join(pa.LargeListArray.from_arrays(lists, of.take(place)), pa.scalar(gap, of.type)).to_pylist()
        return joined(self.decimals, " "), joined(self.tokens, b"")


@cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One table for each worker, file and pattern."""
    return BytePairs(path, pattern)


def byte_pair_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_tokens, ids_sha256 over the decimal ids joined by spaces, decoded_sha256 over the decoded bytes.

    Null texts count as empty: no ids, and the digests of nothing. Repeated rows and rows without an id are kept, an empty
    table gives an empty one, and columns beyond these two are not read. Texts may be of any length and hold any characters;
    strings of special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                flat, at = own.encode(batch.column("text"))
                ids, shown = own.said(flat, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, ``ids`` and ``starts`` and ``ends``, the code points of the text that each id shows.

    Tokens that share a character by its bytes all show that character. Null texts have no ids; rows as in
    ``byte_pair_digests``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for whole in batches:
            for batch in slices(whole, "text", SLICE >> 2):
                flat, at = own.pieces(batch.column("text"))
                coded = flat.dictionary_encode()
                words = [w.decode() for w in coded.dictionary.to_pylist()]
                size, index = np.fromiter(map(len, words), np.int64, len(words)), coded.indices.to_numpy()
                flat_ids, many, spans = own.encode_pieces(words)
                spans = np.array(spans, np.int64).reshape(-1, 2)
                first = np.concatenate([[0], np.cumsum(many)])
                n = many[index]
                upto = np.concatenate([[0], np.cumsum(n)])
                take = np.repeat(first[index] - upto[:-1], n) + np.arange(upto[-1])
                chars = np.concatenate([[0], np.cumsum(size[index])])
                base = np.repeat(chars[:-1] - np.repeat(chars[at[:-1]], np.diff(at)), n)  # of each piece in its row
                rows = pa.array(upto[at], pa.int32())
                lists = [pa.ListArray.from_arrays(rows, pa.array(x, pa.int32())) for x in (flat_ids[take], spans[take, 0] + base, spans[take, 1] + base)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` (doc_id, ids) as doc_id, ``bytes`` and ``text``; no ids, or none stated, give empty ones.

    Bytes that make no character, as a cut through a character leaves them, become U+FFFD in the text; ``bytes`` keeps them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_pairs(path, pattern)
        for batch in batches:
            raw = [own.decode(x) if x else b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary, text string")
