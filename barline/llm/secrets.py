"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are compiled to one automaton by subset construction, minimised by partition refinement
and kept as a transition array over byte classes. A scan reads every byte once, for all rules together: a batch of texts
is laid out as many lanes which step through the array side by side. Lanes are cut only behind bytes that lead every
state back to the start (a newline, for example), so cutting loses nothing, and one long text gets many lanes.

The scan yields the last byte of each match; a small reverse automaton per rule walks back to the leftmost start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import slices, utf8

try:  # the parse tree of the standard library's regular expressions
    from re import _constants as K
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_constants as K
    import sre_parse as parser


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match fails if the given group of ``pattern`` is shorter than ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed by the contract of op1; the order is the order of kinds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds with fixed public prefixes.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# --- from expressions to automata ---------------------------------------------------------------------------------


def _bytes_of(op, arg, fold: bool) -> frozenset[int]:
    if op is K.LITERAL:
        found = {arg}
    else:
        found = set()
        for o, a in arg:
            if o is K.LITERAL:
                found.add(a)
            elif o is K.RANGE:
                found.update(range(a[0], a[1] + 1))
            else:
                raise ValueError(f"not supported in a rule: {o}")
    if any(x > 127 for x in found):
        raise ValueError("rules are over ASCII")
    if fold:
        found |= {ord(f(chr(x))) for x in found for f in (str.lower, str.upper)}
    return frozenset(found)


class _Graph:
    """A graph of states with byte-set and empty moves; built forwards or, for walking back, in reverse."""

    def __init__(self, reverse: bool = False):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []
        self.reverse = reverse

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, fold: bool = False) -> int:
        for op, arg in reversed(list(tree)) if self.reverse else tree:
            end = self.state()
            if op in (K.LITERAL, K.IN):
                self.moves[start].append((_bytes_of(op, arg, fold), end))
            elif op is K.SUBPATTERN:
                self.empty[self.add(arg[3], start, fold or bool(arg[1] & re.IGNORECASE))].append(end)
            elif op is K.BRANCH:
                for branch in arg[1]:
                    head = self.state()
                    self.empty[start].append(head)
                    self.empty[self.add(branch, head, fold)].append(end)
            elif op is K.MAX_REPEAT:
                low, high, inner = arg
                at = start
                for _ in range(low):
                    at = self.add(inner, at, fold)
                if high is K.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(inner, loop, fold)].append(loop)
                    at = loop
                else:
                    for _ in range(high - low):
                        self.empty[at].append(end)
                        at = self.add(inner, at, fold)
                self.empty[at].append(end)
            else:
                raise ValueError(f"not supported in a rule: {op}")
            start = end
        return start

    def closed(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """``step[state, class_of[byte]]`` is the next state, ``accepts[state]`` a bit per rule; state 0 is the start."""

    class_of: np.ndarray
    step: np.ndarray
    accepts: np.ndarray

    @property
    def resets(self) -> np.ndarray:
        """Per byte: does it lead every state to the start?"""
        return (self.step == 0).all(axis=0)[self.class_of]


def compile_rules(rules: tuple[Rule, ...], *, anchored: bool = False, reverse: bool = False) -> Automaton:
    """One minimal automaton for all rules; not anchored, it finds matches that start anywhere."""
    graph = _Graph(reverse)
    root = graph.state()
    ends = {}
    for i, rule in enumerate(rules):
        head = graph.state()
        graph.empty[root].append(head)
        ends[graph.add(parser.parse(rule.pattern), head)] = 1 << i
    sets = {s for moves in graph.moves for s, _ in moves}
    keys = [tuple(b in s for s in sets) for b in range(256)]
    numbers = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    class_of = np.array([numbers[k] for k in keys], np.uint8)
    sample = [keys.index(k) for k in numbers]
    first = graph.closed([root])
    known, table, accepts, todo = {first: 0}, [], [], [first]
    while todo:
        now = todo.pop(0)
        accepts.append(sum({ends[s] for s in now if s in ends}))
        row = []
        for b in sample:
            to = {t for s in now for chars, t in graph.moves[s] if b in chars} | (set() if anchored else {root})
            to = graph.closed(to)
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row.append(known[to])
        table.append(row)
    step, accepts = np.array(table), np.array(accepts)
    group = np.unique(accepts, return_inverse=True)[1]
    while True:  # refine until states of a group agree on every class
        rows = np.column_stack([group, group[step]])
        _, refined = np.unique(rows, axis=0, return_inverse=True)
        refined = refined.reshape(-1)
        if refined.max() == group.max():
            break
        group = refined
    order = {g: i for i, g in enumerate(dict.fromkeys(group.tolist()))}  # the start's group gets number 0
    group = np.array([order[g] for g in group.tolist()])
    _, one = np.unique(group, return_index=True)
    return Automaton(class_of, group[step[one]].astype(np.int32), accepts[one].astype(np.int64))


@cache
def _compiled(rules: tuple[Rule, ...]):
    return compile_rules(rules), tuple(compile_rules((r,), anchored=True, reverse=True) for r in rules), tuple(re.compile(r.pattern) for r in rules)


# --- the pass over the bytes --------------------------------------------------------------------------------------


def _lanes(raw: np.ndarray, at: np.ndarray, resets: np.ndarray, length: int) -> np.ndarray:
    """Starts of lanes: each row's start, and about every ``length`` bytes the place behind a reset byte."""
    if not len(raw):
        return np.zeros(0, np.int64)
    cuts = np.flatnonzero(resets[raw]) + 1
    wanted = np.arange(length, len(raw), length)
    found = np.searchsorted(cuts, wanted)
    cuts = cuts[found[found < len(cuts)]]
    starts = np.unique(np.concatenate([at[:-1], cuts]))
    return starts[starts < len(raw)]


def match_ends(auto: Automaton, raw: np.ndarray, at: np.ndarray, lane: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places of bytes at which some rule accepts, in order, and the bits of those rules."""
    starts = _lanes(raw, at, auto.resets, lane)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(raw)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    classes = auto.class_of[raw]
    width = auto.step.shape[1]
    step = (auto.step * width).astype(np.int32).reshape(-1)
    accepts = np.zeros(len(auto.accepts) * width, bool)
    accepts[::width] = auto.accepts != 0
    state = np.zeros(len(starts), np.int32)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than each step
    places, states = [], []
    for i, n in enumerate(live.tolist()):
        now = step[state[:n] + classes[starts[:n] + i]]
        state[:n] = now
        hit = np.flatnonzero(accepts[now])
        if len(hit):
            places.append(starts[hit] + i)
            states.append(now[hit])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, states = np.concatenate(places), np.concatenate(states)
    by_place = np.argsort(places, kind="stable")
    return places[by_place], auto.accepts[states[by_place] // width]


def _leftmost(auto: Automaton, raw: bytes, end: int, low: int) -> int:
    """The leftmost start, not below ``low``, of a match that ends before ``end``; -1 if there is none."""
    state, best, i = 0, -1, end
    while i > low:
        i -= 1
        state = int(auto.step[state, auto.class_of[raw[i]]])
        if auto.accepts[state]:
            best = i
        elif state and (auto.step[state] == state).all():  # nothing leads out
            break
    return best


def spans(raw: np.ndarray, at: np.ndarray, rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per row the (start, rule, end) of its matches in code points, by start, then rule."""
    auto, back, exact = _compiled(rules)
    places, bits = match_ends(auto, raw, at)
    rows = np.searchsorted(at, places, side="right") - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    for r, rule in enumerate(rules):
        has = np.flatnonzero(bits >> r & 1)
        if not len(has):
            continue
        ends, of = places[has], rows[has]
        last = np.append((np.diff(ends) != 1) | (np.diff(of) != 0), True)  # a greedy match grows while the rule accepts
        low, before = 0, -1
        for end, row in zip((ends[last] + 1).tolist(), of[last].tolist(), strict=True):
            base = int(at[row])
            if row != before:
                text, low, before = raw[base : int(at[row + 1])].tobytes(), 0, row
            start = _leftmost(back[r], text, end - base, low)
            if start < 0:
                continue
            low = end - base
            match = exact[r].fullmatch(text[start:low].decode())
            if match and len(match.group(rule.group)) >= rule.least:
                found[row].append((start, r, low))
    for row, each in enumerate(found):
        if each:
            own = raw[at[row] : at[row + 1]]
            first = np.cumsum((own & 0xC0) != 0x80)  # code points up to and with each byte
            found[row] = sorted((int(first[s]) - 1, r, int(first[e - 1])) for s, r, e in each)
    return found


# --- operators ----------------------------------------------------------------------------------------------------


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``secrets``, an array of (kind, start, end) by start, then rule order.

    Offsets are code points, ``end`` exclusive. Null and empty texts have an empty array; repeated rows are scanned each
    for itself; other columns are not read. Texts may be of any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                found = spans(*utf8(batch.column("text")), rules)
                rows = [[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in each] for each in found]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], ["id", "secrets"])

    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, secrets array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[kind]`` (overlapping ones by the first's); ``n_chars`` follows.

    A text without secrets and a null text stay as they are, with their ``n_chars``. No row is dropped; all columns stay.
    """
    names = docs.columns
    at_text, at_chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, names[at_text], 2 << 20):
                found = spans(*utf8(batch.column(at_text)), rules)
                if any(found):
                    texts = batch.column(at_text).to_pylist()
                    chars = batch.column(at_chars).to_pylist() if at_chars is not None else None
                    for row, each in enumerate(found):
                        if each:
                            out, upto = [], 0
                            for s, r, e in each:
                                if s >= upto:
                                    out += [texts[row][upto:s], f"[{rules[r].kind}]"]
                                upto = max(upto, e)
                            texts[row] = "".join(out) + texts[row][upto:]
                            if chars:
                                chars[row] = len(texts[row])
                    columns = list(batch.columns)
                    columns[at_text] = pa.array(texts, batch.schema.field(at_text).type)
                    if chars:
                        columns[at_chars] = pa.array(chars, batch.schema.field(at_chars).type)
                    batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
                yield batch

    return docs.mapInArrow(run, docs.schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """The digest columns of op1 for ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for each in batch.column("secrets").to_pylist():
                own = [x for x in each if x["kind"] in counted]
                text = lambda found: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found)
                rows.append([*(sum(x["kind"] == k for x in own) for k in counted), hashlib.sha256(text(own).encode()).hexdigest(), text(each)])
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    counted = tuple(r.kind for r in BASE)
    return scan_secrets(docs).mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
