"""Chat formatting: a template with a finite-state machine over roles turns conversations into text segments with loss flags.

The template is data: its marks, which role may follow which, where a conversation may end, and which roles' texts are
trained on. Control strings inside texts are escaped so that no text can hold a mark, and reading back undoes it.
Conversations are streamed: rows of a partition come sorted, and neither writing nor reading holds more than a batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import parts


@dataclass(frozen=True)
class Template:
    """``moves[role]`` are the roles that may come next, ``moves[None]`` those that may start; ``ends`` may come last."""

    turn_start: str = "<|im_start|>"
    role_end: str = "\n"
    turn_end: str = "<|im_end|>\n"
    moves: dict = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    trained: tuple[str, ...] = ("assistant",)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn, each with its loss flag."""
        return [(f"{self.turn_start}{escape_role(role)}{self.role_end}", False), (escape(text), role in self.trained), (self.turn_end, False)]


CHATML = Template()
_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash comes between the signs, one more where there are some."""
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and a role holds no line break."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_conversations(rows: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments of ``rows`` (conv_id, turn, role, text): conv_id, turn, place (of the turn, from 0), part, segment, loss, expected.

    ``expected`` is whether the machine allows the turn after the one before it. Turns come in order of turn, then role
    and text; nulls in role and text count as empty, a null turn comes last, null conv_ids are one conversation. Rows that
    repeat are turns of their own. Every row is formatted, expected or not. A conversation's segments are in order in one
    partition; other columns are not read.
    """
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "place": pa.int64(), "part": pa.int32(), "segment": pa.string(), "loss": pa.bool_(), "expected": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, place = object(), None, 0
        for batch in batches:
            out = []
            for c, turn, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True):
                if c != conv:
                    conv, state, place = c, None, 0
                expected = role in template.moves.get(state, ())
                out += [(c, turn, place, k, segment, loss, expected) for k, (segment, loss) in enumerate(template.segments(role, text))]
                state, place = role, place + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], [*kinds])

    own = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    own = own.repartition(parts(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
    return own.mapInArrow(run, "conv_id bigint, turn bigint, place bigint, part int, segment string, loss boolean, expected boolean")


class _Reader:
    """Reads one conversation back from its segments as they come."""

    def __init__(self, conv, template: Template):
        self.conv, self.template, self.buffer = conv, template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.last = True, None

    def add(self, segment: str, loss: bool, expected: bool) -> None:
        self.chars += len(segment)
        self.valid &= expected
        if loss:
            text = unescape(segment)
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.buffer += segment
        t = self.template
        if segment == t.turn_end:
            head, _, text = self.buffer.removeprefix(t.turn_start).removesuffix(t.turn_end).partition(t.role_end)
            if not self.buffer.startswith(t.turn_start) or t.turn_start in text or t.turn_end in text:
                raise ValueError("a turn's marks are broken")
            self.last = unescape_role(head)
            self.turns.update(f"{self.last}\n{unescape(text)}\n".encode())
            self.n_turns, self.buffer = self.n_turns + 1, ""

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in self.template.ends


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Per conversation of ``format_conversations``' output, parsed again from its text: the columns of op7 and ``valid``."""
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for c, place, part, segment, loss, expected in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "place", "part", "segment", "loss", "expected")), strict=True):
                if place == 0 and part == 0:
                    done += [reader.row()] if reader else []
                    reader = _Reader(c, template)
                reader.add(segment, loss, expected)
            if done:
                yield told(done)
        if reader:
            yield told([reader.row()])

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], [*kinds])

    return segments.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
