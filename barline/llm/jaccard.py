"""N-gram Jaccard join: which documents share most of their word shingles, and the groups that such links form.

Documents with equal sets are one node. Two sets whose likeness reaches the threshold share tokens in a prefix of each, in
one global order: rare tokens first, frequent ones after, each by hash. A rare token of a prefix is indexed alone. Frequent
tokens are dealt into classes; of those, only pairs of tokens of one class are indexed, and the prefix is extended until
its rare tokens plus, for each class, its tokens but one outnumber those in which the sets may differ. Two linked sets
then share an index key: else each token of the shorter prefix, but for one a class, would be missing in the other set.
Which tokens count as frequent changes the work, not the result.

A bitmap of four to eight bits for each token bounds how much two sets can share; pairs below the threshold by that bound
never need their sets. Every set is compared with one other set of each key first, a hub. Links join sets to components;
keys that still span several components then get all comparisons that remain. Keys with very many sets are compared in
blocks: the bitmaps first tell which sets of a pair of blocks have a partner at all, then those alone meet with their
tokens, are compared exactly, and send on links that span what they join, fewer than there are sets.

All comparisons are exact, on whole sets of shingles hashed to 64 bits. A set is named by 64 of 128 bits of its hash; the
other 64 tell whether two sets share a name, and if any do, all sets are named anew with another seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import dropped, kept, slices
from barline.llm.components import components
from barline.llm.shingles import mixed, set_name, shingle_sets

#: A token is frequent from so many sets on, as a sketch of ROWS rows of MOST counters at most counts them; counters in a segment.
FREQUENT, ROWS, MOST, SEGMENT = 64, 2, 1 << 21, 1 << 16
#: Sketches that are added up together.
ADDED = 1024
#: Postings that a task gathers before it sends them on, postings in a group, and known sets that a task remembers.
GATHERED, GROUP, SEEN = 500_000, 250_000, 200_000
#: Size classes: sets whose likeness is at least 0.8 lie in one class or in neighbours.
_RATIO = math.log(1.26)
#: Sets from which on a key's pairs are compared in blocks, sets in a block, and bits that keys are hashed to there.
CROWD, BLOCK, KEY_BITS = 16, 2048, 512
_TEXT_BYTES = 2 << 20


def _differ(n: int, percent: int) -> int:
    """Most tokens of a set of ``n`` that may be missing in a set linked with it."""
    return n - -(-percent * n // 100)


def index_keys(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set: ascending ``tokens``, and which of them are frequent."""
    n = len(tokens)
    differ = _differ(n, percent)
    if n * 100 < percent * (n + 1):
        return tokens[:0]  # only equal sets are as alike, and those are one node
    rare = tokens[~frequent]
    if len(rare) > differ:
        return mixed(rare[: differ + 1])
    keys = [mixed(rare)]
    often, need = tokens[frequent], differ + 1 - len(rare)
    size = int(math.log(n) / _RATIO)
    for tag in (size, size + 1):
        classes = max(1, int(0.2 * 1.26**tag / 4))
        kind = ((often >> np.uint64(9)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        k = kind[order]
        repeat = np.zeros(len(often), bool)  # not the first of its class
        repeat[order[1:]] = k[1:] == k[:-1]
        own = int(np.searchsorted(np.cumsum(repeat), need)) + 1  # the prefix that holds enough
        prefix, kind = often[:own], kind[:own]
        order = np.argsort(kind, kind="stable")
        prefix, kind = prefix[order], kind[order]
        for gap in range(1, len(prefix)):
            same = kind[gap:] == kind[:-gap]
            if not same.any():
                break
            keys.append(mixed(mixed(prefix[:-gap][same] + np.uint64(tag)) + prefix[gap:][same]))
    return np.concatenate(keys)


def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of a set's tokens, of 4 to 8 bits for each, 64 at least."""
    size = max(64, 1 << (4 * len(tokens) - 1).bit_length()) if len(tokens) else 64
    bits = np.zeros(size, bool)
    bits[(tokens % np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def shared_at_most(x: bytes, n_x: int, y: bytes, n_y: int) -> int:
    """A bound of how many tokens sets with these bitmaps and sizes share: a bit that only one has is a token that only one has."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(b.reshape(-1, size), axis=0) for b in (x, y))
    return min(n_x - int(np.bitwise_count(x & ~y).sum()), n_y - int(np.bitwise_count(y & ~x).sum()))


class _Seen:
    """Sets that a task has met, within bounds; forgetting one costs repeated work only."""

    def __init__(self):
        self.known: set[int] = set()

    def __call__(self, x: int) -> bool:
        if len(self.known) >= SEEN:
            self.known.clear()
        n = len(self.known)
        self.known.add(x)
        return len(self.known) == n


def _in_order(batches: Iterator[pa.RecordBatch]):
    """(batch, tokens, start and end of each row's tokens) for slices of the batches."""
    for whole in batches:
        for batch in slices(whole, "text", _TEXT_BYTES):
            tokens, at = shingle_sets(batch.column("text"))
            yield batch, tokens, at.tolist()


class Sketch:
    """Counts of hashed tokens in ROWS rows of ``width`` counters, a power of two; adding sketches adds their counts."""

    def __init__(self, width: int, counts: np.ndarray | None = None):
        self.width = width
        self.counts = np.zeros((ROWS, width), np.int64) if counts is None else counts
        self.met = int(self.counts[0].sum())

    def places(self, tokens: np.ndarray, row: int) -> np.ndarray:
        return ((tokens >> np.uint64(20 * row)) % np.uint64(self.width)).astype(np.int64)

    def add(self, tokens: np.ndarray) -> None:
        for row in range(ROWS):
            self.counts[row] += np.bincount(self.places(tokens, row), minlength=self.width)

    def frequent(self, tokens: np.ndarray) -> np.ndarray:
        """Which tokens were met FREQUENT times or more, as far as the least of their counters, less what others add to it, tells."""
        noise = self.met / self.width
        least = noise + max(FREQUENT, 6 * noise**0.5)
        found = np.ones(len(tokens), bool)
        for row in range(ROWS):
            found &= self.counts[row][self.places(tokens, row)] >= least
        return found

    def cut(self) -> list[bytes]:
        """The counters in segments of SEGMENT, each compressed."""
        flat = self.counts.reshape(-1)
        return [_packed(flat[i : i + SEGMENT]) for i in range(0, len(flat), SEGMENT)]


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes: one byte each where that is enough, else eight; how many, and the kind, stand in front."""
    small = counts.astype("u1" if counts.max(initial=0) < 256 else "<i8")
    return np.array([len(small), small.itemsize], "<i8").tobytes() + pa.compress(small.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw, "<i8", 2).tolist()
    return np.frombuffer(pa.decompress(raw[16:], n * size, codec="zstd", asbytes=True), "u1" if size == 1 else "<i8").astype(np.int64)


def shingled(docs: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, mark (a hash of its text), n_shingles, set_id, check, sketch; and each task's counts of tokens: task, segment, counts.

    Rows of the second kind have a segment number. Sets that a task meets again are counted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counted, gathered, size, task = _Seen(), Sketch(width), [], 0, TaskContext.get().partitionId()
        for batch, tokens, at in _in_order(batches):
            named, sketches = [], []
            for s, e in zip(at, at[1:], strict=False):
                named.append(set_name(tokens[s:e], seed))
                sketches.append(sketch(tokens[s:e]))
                if e - s and not seen(named[-1][0]):
                    gathered.append(tokens[s:e])
                    size += e - s
            columns = [batch.column("doc_id"), batch.column("mark"), np.diff(at), [x for x, _ in named], [x for _, x in named], sketches, *[pa.nulls(batch.num_rows)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            if size > GATHERED:
                counted.add(np.concatenate(gathered))
                gathered, size = [], 0
        if gathered:
            counted.add(np.concatenate(gathered))
        if counted.counts.any():
            cut = counted.cut()
            n = len(cut)
            columns = [*[pa.nulls(n)] * 6, pa.array([task] * n), pa.array(range(n)), pa.array(cut)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    long, raw = pa.int64(), pa.binary()
    schema = pa.schema([("doc_id", long), ("mark", long), ("n_shingles", long), ("set_id", long), ("check", long), ("sketch", raw), ("task", long), ("segment", long), ("counts", raw)])
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return some.mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, set_id bigint, check bigint, sketch binary, task bigint, segment bigint, counts binary")


def _width(docs: DataFrame) -> int:
    """Counters in a row of the sketch: about one for 256 tokens, within fixed bounds."""
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    return min(MOST, max(SEGMENT // ROWS, 1 << int(chars / 6 / 256).bit_length()))


def _summed(rows: DataFrame, width: int) -> Sketch:
    """The sketch of all tasks, added up ADDED at a time; it has a fixed size, whatever the number of documents."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py()) for x in table.column("counts"))
        return pa.table({"task": [table.column("task")[0].as_py() // ADDED], "segment": [table.column("segment")[0].as_py()], "counts": pa.array([_packed(total)], pa.binary())})

    told, counts = rows.where("segment is not null").select("task", "segment", "counts"), np.zeros(ROWS * width, np.int64)
    for _ in range(2):
        told = told.groupBy("segment", F.floor(F.col("task") / ADDED)).applyInArrow(add, "task bigint, segment bigint, counts binary")
    for r in told.collect():  # ROWS * width / SEGMENT rows for each ADDED * ADDED tasks
        own = _unpacked(r["counts"])
        counts[r["segment"] * SEGMENT : r["segment"] * SEGMENT + len(own)] += own
    return Sketch(width, counts.reshape(ROWS, width))


def _postings(docs: DataFrame, counted: Sketch, groups: int, percent: int, seed: int) -> DataFrame:
    """(key, hub, set_id): every set but one of each index key that several sets have, with one of the others as the hub.

    A task gives its own sets of a key a local hub and sends only that one on, so a key that a third of all sets have
    meets in its group with one row from each run of gathered sets.
    """
    held = docs.sparkSession.sparkContext.broadcast(counted)

    def send(gathered) -> pa.RecordBatch:
        key = np.concatenate([k for k, _ in gathered]) if gathered else np.zeros(0, np.uint64)
        own = np.repeat(np.array([s for _, s in gathered], np.int64), [len(k) for k, _ in gathered]) if gathered else np.zeros(0, np.int64)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        hub = own[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else own
        rows = []
        group = (key[first] % np.uint64(groups)).astype(np.int64)
        for mark, g, columns in ((0, group, (key[first], own[first])), (1, (own[~first] % groups), (key[~first], hub[~first], own[~first]))):
            order = np.argsort(g, kind="stable")
            cuts = np.searchsorted(g[order], np.arange(groups + 1)).tolist()
            columns = [c[order] for c in columns]
            rows += [(i, mark, *[c[a:b].tobytes() for c in columns], *[b""] * (3 - len(columns))) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        table = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(table, [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)], ["grp", "mark", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seen, gathered, size = held.value, _Seen(), [], 0
        for _, tokens, at in _in_order(batches):
            often = counted.frequent(tokens)
            for s, e in zip(at, at[1:], strict=False):
                own = set_name(tokens[s:e], seed)[0]
                if e - s and not seen(own):
                    keys = index_keys(tokens[s:e], often[s:e], percent)
                    if len(keys):
                        gathered.append((keys, own))
                        size += len(keys)
            if size > GATHERED:
                yield send(gathered)
                gathered, size = [], 0
        yield send(gathered)

    def meet(table: pa.Table) -> pa.Table:
        sent = [r for r in table.select(["mark", "a", "b", "c"]).to_pylist()]
        joined = lambda rows, name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        new, done = [r for r in sent if r["mark"] == 0], [r for r in sent if r["mark"] == 1]
        key, own = joined(new, "a", np.uint64), joined(new, "b", np.int64)
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        if len(key):
            fresh = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
            key, own = key[fresh], own[fresh]
            first = np.append(True, key[1:] != key[:-1])
            hub = own[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
            key, hub, own = key[~first], hub[~first], own[~first]
        else:
            hub = own
        columns = (np.concatenate([key, joined(done, "a", np.uint64)]).view(np.int64), np.concatenate([hub, joined(done, "b", np.int64)]), np.concatenate([own, joined(done, "c", np.int64)]))
        return pa.table(dict(zip(("key", "hub", "set_id"), columns, strict=True)))

    some = docs.select("text").mapInArrow(run, "grp int, mark int, a binary, b binary, c binary")
    out = kept(some.groupBy("grp").applyInArrow(meet, "key bigint, hub bigint, set_id bigint"))
    held.destroy()
    return out


def _sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(set_id, tokens) of the ``wanted`` sets, read again from one document of each.

    A bitmap over hashed doc_ids, of a fixed 4 MB, lets tasks skip most texts; the join makes the choice exact.
    """
    wanted = wanted.distinct()
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(-1).cast("bigint"))), F.lit(1 << 25))
    chosen = wanted.join(nodes.select("set_id", "doc_id"), "set_id").select((place(F.col("doc_id")) + 1).alias("p"))
    maps = chosen.groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = np.zeros((1 << 25) // 8 + 4096, np.uint8)
    for r in maps.collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, _Seen()

        def picked():
            for batch in batches:
                p = batch.column("p").to_numpy()
                has = bits[p >> 3] >> (p & 7).astype(np.uint8) & 1
                yield batch.filter(pa.array(has.astype(bool)))

        for _, tokens, at in _in_order(picked()):
            rows = []
            for s, e in zip(at, at[1:], strict=False):
                own = set_name(tokens[s:e], seed)[0]
                if e - s and not seen(own):
                    rows.append((own, tokens[s:e].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], ["set_id", "tokens"])

    read = docs.select("text", place(F.col("doc_id").cast("bigint")).alias("p")).mapInArrow(run, "set_id bigint, tokens binary")
    out = kept(read.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]))
    held.destroy()
    return out


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Are two sets, as ascending tokens, alike enough?"""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x"), batch.column("y"), strict=True)
            alike = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    left = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("x")), "a")
    return left.join(sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


class _Block:
    """Sets of a pair of blocks, and which of them may be alike: by block, component, keys, size and bitmap."""

    def __init__(self, table: pa.Table, percent: int):
        self.sets, self.part, self.size, self.block = (table.column(c).to_numpy() for c in ("set_id", "component", "n", "i"))
        self.apart = table.column("lo")[0].as_py() != table.column("hi")[0].as_py()
        self.percent = percent
        bits = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        width = np.array([len(b) for b in bits])
        self.widths = np.unique(width).tolist()
        self.of = {w: np.flatnonzero(width == w) for w in self.widths}
        self.bits = {w: np.stack([bits[i] for i in self.of[w]]) for w in self.widths}
        keys = table.column("keys").combine_chunks() if isinstance(table.column("keys"), pa.ChunkedArray) else table.column("keys")
        row = np.repeat(np.arange(len(self.sets)), keys.value_lengths().to_numpy())
        self.has = np.zeros((len(self.sets), KEY_BITS), np.float32)
        self.has[row, keys.flatten().to_numpy() % KEY_BITS] = 1

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows of partners that the bounds allow); each pair once."""
        for w in self.widths:
            mine, x = self.of[w], self.bits[w]
            for v in [v for v in self.widths if v >= w]:
                other = self.of[v]
                y = np.bitwise_or.reduce(self.bits[v].reshape(len(other), -1, w), axis=1)
                meets = self.has[mine] @ self.has[other].T > 0
                for k, i in enumerate(mine.tolist()):
                    fits = meets[k] & (self.part[other] != self.part[i]) & (100 * np.minimum(self.size[other], self.size[i]) >= self.percent * np.maximum(self.size[other], self.size[i]))
                    fits &= (self.block[other] != self.block[i]) if self.apart else True
                    fits &= (other > i) if v == w else True
                    j = np.flatnonzero(fits)
                    if len(j):
                        lack, extra = np.bitwise_count(x[k] & ~y[j]).sum(axis=1), np.bitwise_count(~x[k] & y[j]).sum(axis=1)
                        both = np.minimum(self.size[i] - lack, self.size[other[j]] - extra)
                        j = j[100 * both >= self.percent * (self.size[i] + self.size[other[j]] - both)]
                        if len(j):
                            yield i, other[j]


def _blocks(rest: DataFrame, crowds: DataFrame) -> DataFrame:
    """Sets of ``rest`` that share one of the ``crowds`` (key, low), once for each pair of blocks (low, blocks, lo, hi) that they meet in.

    Keys with the same smallest set hold much the same sets, so they are compared together: their distinct sets are dealt
    into blocks of about BLOCK sets.
    """
    own = rest.join(crowds, "key").groupBy("low", "set_id", "component", "n").agg(F.collect_set("key").alias("keys"))
    many = own.groupBy("low").agg((1 + F.floor(F.count("*") / BLOCK)).alias("blocks"))
    own = own.join(many, "low").withColumn("i", F.pmod(F.xxhash64("set_id"), "blocks"))
    own = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return own.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).drop("j")


_PLACE = ["low", "blocks", "lo", "hi"]


def _paired(blocks: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(low, blocks, lo, hi, set_id) of the sets that have a partner within the bounds in that pair of blocks."""

    def mark(table: pa.Table) -> pa.Table:
        some, block = np.zeros(table.num_rows, bool), _Block(table, percent)
        for i, j in block.partners():
            some[i] = True
            some[j] = True
        return table.select([*_PLACE, "set_id"]).filter(pa.array(some))

    own = blocks.join(nodes.select("set_id", "sketch"), "set_id")
    return own.groupBy(*_PLACE).applyInArrow(mark, "low bigint, blocks bigint, lo bigint, hi bigint, set_id bigint")


def _joined(blocks: DataFrame, paired: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the ``paired`` sets of each pair of blocks that join what all links there join, fewer than the sets."""

    def join(table: pa.Table) -> pa.Table:
        block = _Block(table, percent)
        tokens = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
        group, a, b = np.unique(block.part, return_inverse=True)[1], [], []  # sets of a component are joined already
        for i, partners in block.partners():
            for j in partners.tolist():
                if group[i] != group[j] and _alike(tokens[i], tokens[j], percent):
                    group[group == group[j]] = group[i]
                    a.append(block.sets[i])
                    b.append(block.sets[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    own = blocks.join(paired, [*_PLACE, "set_id"]).join(nodes.select("set_id", "sketch"), "set_id").join(sets, "set_id")
    return own.groupBy(*_PLACE).applyInArrow(join, "a bigint, b bigint")


def _spanning(postings: DataFrame, label: DataFrame) -> DataFrame:
    """``postings`` (key, set_id, ...) of keys whose sets lie in several components, with each set's component."""
    own = postings.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    open_ = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return kept(own.join(open_, "key"))


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """Per document: doc_id, mark, n_shingles and component, a number of the sets reachable by links (a document without words has none)."""
    if percent < 80:
        raise ValueError("size classes and prefixes are made for a likeness of 0.8 or more")
    width = _width(docs)
    for seed in range(64):
        rows = kept(shingled(docs, width, seed))
        nodes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.any_value("sketch").alias("sketch"), F.min("check").alias("check"), F.max("check").alias("other"))
        nodes = kept(nodes)
        if nodes.where("check <> other").isEmpty():
            break
        dropped(rows, nodes)  # two sets have one name
    counted = _summed(rows, width)
    keys = nodes.agg(F.sum(F.floor(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    postings = _postings(docs, counted, 1 + keys // GROUP, percent, seed)
    size = nodes.select("set_id", "n")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("s_a", "n_a", "s_b", "n_b"))
            fits = [100 * (m := shared_at_most(x, n, y, k)) >= percent * (n + k - m) for x, n, y, k in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits, pa.bool_()))

    def fitting(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes and bitmaps allow them to be alike enough. Sizes come first: they are small."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for c in "ba":
            pairs = pairs.join(size.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}")), c)
        pairs = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        for c in "ab":
            pairs = pairs.join(nodes.select(F.col("set_id").alias(c), F.col("sketch").alias(f"s_{c}")), c)
        return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(bounded, "a bigint, b bigint")

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    compared = kept(fitting(postings.select(F.col("hub").alias("a"), F.col("set_id").alias("b"))))
    sets = _sets_of(docs, nodes, ends(compared), seed)
    links = kept(_linked(sets, compared, percent))
    label = kept(components(links))
    dropped(sets)

    own = postings.select("key", F.explode(F.array("hub", "set_id")).alias("set_id")).distinct().join(size, "set_id")
    rest = _spanning(own, label)
    # Keys that still span components: all their pairs across components, but for those compared already.
    crowds = kept(rest.groupBy("key").agg(F.count("*").alias("many"), F.min("set_id").alias("low")).where(F.col("many") > CROWD).select("key", "low"))
    few = rest.join(crowds, "key", "left_anti")
    x, y = (few.select("key", F.col("set_id").alias(s), F.col("component").alias(f"c_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    across = x.join(y, "key").where((F.col("c_a") < F.col("c_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))).select("a", "b")
    across = kept(fitting(across).join(compared, ["a", "b"], "left_anti"))
    blocks = kept(_blocks(rest, crowds))
    paired = kept(_paired(blocks, nodes, percent))
    sets = _sets_of(docs, nodes, ends(across).unionByName(paired.select("set_id")), seed)
    more = kept(_linked(sets, across, percent).unionByName(_joined(blocks, paired, nodes, sets, percent)))
    label = kept(components(links.unionByName(more)))
    dropped(postings, compared, links, rest, crowds, across, blocks, paired, sets, more)
    told = rows.where("set_id is not null").select("doc_id", "mark", "n_shingles", "set_id").join(label, "set_id", "left")
    return told.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id")).alias("component"))


def jaccard_components(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): n_shingles, and component_id, the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their sets of five-word shingles; a text of fewer
    words is one shingle. Null texts and texts without words have n_shingles 0 and no link, not even with each other:
    their component is their own id. Equal sets share a component, repeated rows are kept, and a null doc_id never is a
    component_id unless all of a component are null. ``percent`` must be 80 or more; other columns are not read.
    """
    told = _labelled(docs, percent)
    lowest = told.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = told.join(lowest, "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group that links join: that with the smallest doc_id. Columns stay.

    A document is told by its doc_id and text: of texts with one doc_id in a group, one stays; a doc_id that stands
    in two groups is judged in each for itself; of rows that repeat both, one stays. A null doc_id comes last, so such a row
    stays only where its group has no other. Documents without words have no links and all stay.
    """
    own_id, own_mark = "_id", "_mark"
    while own_id in docs.columns or own_mark in docs.columns:
        own_id, own_mark = own_id + "_", own_mark + "_"
    told = kept(_labelled(docs, percent).where("component is not null"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = told.groupBy("component").agg(F.min(place).alias("first"))
    gone = told.join(first, "component").where(~place.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark)).distinct()
    twice = told.groupBy("doc_id", "mark").count().where("count > 1").select(F.col("doc_id").alias(own_id), F.col("mark").alias(own_mark))
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(own_id)) & (F.xxhash64(docs["text"]) == F.col(own_mark))
    left = docs.join(gone, same, "left_anti")
    if twice.isEmpty():
        return left
    # Rows that repeat a doc_id and a text with words: one of each stays.
    once = left.join(twice, same, "left_semi").withColumn(own_mark, F.xxhash64("text")).dropDuplicates(["doc_id", own_mark]).drop(own_mark)
    return left.join(twice, same, "left_anti").unionByName(once)
