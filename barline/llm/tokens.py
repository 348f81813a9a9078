"""Token ids of whole texts by a word-end BPE vocabulary, as fast as a table of known units allows.

The vocabulary splits a text into units (runs of letters, single digits, runs of other signs) and merges inside each. Each
worker keeps a table from unit to packed ids; units of a batch that it doesn't know yet are merged together. Texts with marks,
characters beyond Latin-1, unusual separators or what looks like a special token go to the library whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from barline.llm.merges import MergeTable

#: Units a worker keeps; beyond it the table starts anew, which costs time only.
KNOWN_UNITS = 100_000
#: Separators on which libraries differ.
_ODD = b"\x1c\x1d\x1e\x1f"
#: Latin-1 in lower case, with white space as a space.
_FOLDED = bytes(ord(" " if chr(b).isspace() else chr(b).lower()) for b in range(256))
#: Per Latin-1 byte: 0 white space, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if chr(b).isspace() else {"L": 1, "N": 2}.get(unicodedata.category(chr(b))[0], 3) for b in range(256)], np.uint8)


class WordIds:
    """``packed(texts)``: per text its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int32)
        self.table = MergeTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2], max(vocab.values()) + 1)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        letter = [chr(b) if b in plain else chr(next(others)) for b in range(256)]
        self.inner, self.last = np.array([vocab[c] for c in letter], np.int32), np.array([vocab[c + end] for c in letter], np.int32)
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, keys: list[bytes]) -> None:
        raw = [k.decode("latin-1").encode() for k in keys]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        symbols[at[1:] - 1] = self.last[flat[at[1:] - 1]]
        merged, at = self.table.encode(symbols, at)
        packed, cuts = merged.astype("<u4").tobytes(), (4 * at).tolist()
        self.known.update(zip(keys, [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def _units(self, text: np.ndarray) -> np.ndarray:
        """Starts of the vocabulary's units in Latin-1 bytes: runs of letters, single digits, runs of others, contractions."""
        kind = _KIND[text]
        start = np.append(True, kind[1:] != kind[:-1]) | (kind == 2)
        quote = np.flatnonzero((text[:-1] == ord("'")) & start[:-1])
        for suffix in (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"):
            own = quote[quote + len(suffix) < len(text)]
            for i, c in enumerate(suffix, 1):
                own = own[text[own + i] == c]
            start[own + 1] = False
            behind = own + 1 + len(suffix)
            behind = behind[behind < len(text)]
            start[behind[kind[behind] == 1]] = True
        return np.flatnonzero(start & (kind != 0))

    def packed(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        rows, raws = [], []
        for i, text in enumerate(texts):
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                raw = None
            if raw is None or b"<|" in raw or len(raw.translate(None, _ODD)) != len(raw):
                out[i] = self._whole(text)
            elif raw:
                rows.append(i)
                raws.append(raw.translate(_FOLDED))
        if not rows:
            return out
        text = np.frombuffer(b" ".join(raws), np.uint8)
        row_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
        start = self._units(text)
        solid = _KIND[text] != 0
        place = np.append(np.cumsum(solid)[start] - 1, int(solid.sum()))  # of units, once white space is gone
        units = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(text[solid])])
        coded = units.dictionary_encode()
        index, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if len(self.known) > KNOWN_UNITS:
            self.known.clear()
        fresh = [w for w in distinct if w not in self.known]
        if fresh:
            self._learn(fresh)
        each = list(map(self.known.__getitem__, distinct))
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        ids, first = np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum(size)])
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(first[index] - upto[:-1], n) + np.arange(upto[-1])].tobytes()
        cut = (4 * upto[np.searchsorted(start, row_at)]).tolist()
        for k, i in enumerate(rows):
            out[i] = flat[cut[k] : cut[k + 1]]
        return out


@cache
def word_ids(path: str) -> WordIds:
    """One table for each worker and vocabulary."""
    return WordIds(path)
