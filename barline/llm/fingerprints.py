"""Document fingerprints by winnowing, in DataFrame functions only.

White space is left out; a gram of GRAM characters starts at every character (code point) that is left and is hashed. Of
every WINDOW consecutive hashes the smallest is chosen, the rightmost of equals: a hash and its place are one number (hash
above, distance of the place from the end of the range below), so the smallest number is the smallest hash at its
rightmost place. Chosen hashes are kept with their places, as place * 2^31 + hash. Any run of WINDOW + GRAM - 1
characters, white space not counted, that two texts share holds a hash which both choose, at whatever offsets it stands
and in any script.

Hashes are rolled: a character's own hash is added to a polynomial of the characters before it in a block of GRAM
characters; a gram's hash is the polynomial of the block that it starts in, less that of the characters ahead of it, rolled
on over as many characters of the next block. A character costs the same whatever GRAM is, and no list grows beyond GRAM.

A text put together from the heads of two others needs no pass of its own: what they chose holds in it but for the windows
near the seam and the end, and only those are made anew (``spliced``).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters in a gram, grams in a window.
GRAM, WINDOW = 24, 48
_PLACES = 1 << 31
#: The polynomial's modulus and base, and the base to the power at which a character leaves a gram.
_PRIME, _BASE = (1 << 31) - 1, 1_220_703_125
_LEAVES = pow(_BASE, GRAM, _PRIME)
#: Rows that are sorted together to find the next document, and most such runs.
_RUN, _RUNS = 2000, 10_000


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def bare(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def _grams(text: Column) -> Column:
    """Numbers of hash and place of every gram of a text without white space; a text of fewer characters has one gram of all of them, an empty one none."""
    zero = F.array(F.lit(0).cast("bigint"))
    rolled = lambda codes: F.aggregate(codes, zero, lambda q, x: F.array_append(q, (F.element_at(q, -1) * F.lit(_BASE) + x) % F.lit(_PRIME)))
    powers = F.array(*[F.lit(pow(_BASE, k, _PRIME)).cast("bigint") for k in range(GRAM)])
    told = lambda hash_, last: F.shiftleft(F.pmod(hash_, F.lit(_PRIME)), 31) + last

    def of_block(own: Column, after: Column, k: Column) -> Column:
        """Grams that start in a block: all of the block, less the characters ahead of the gram, and as many of the next block."""

        def of(whole: Column, last: Column) -> Column:
            return F.transform(F.slice(after, 1, GRAM), lambda x, i: told(whole * F.get(powers, i) - F.get(own, i) * F.lit(_LEAVES) + x, last - i))

        return _let(F.element_at(own, -1), lambda whole: _let(F.lit(_PLACES - 1) - k * GRAM, lambda last: of(whole, last)))

    def of_codes(codes: Column) -> Column:
        n = F.size(codes)
        heads = F.transform(F.sequence(F.lit(0), F.ceil(n / GRAM).cast("int") - 1), lambda k: rolled(F.slice(codes, k * GRAM + 1, GRAM)))
        full = F.floor(n / GRAM).cast("int")
        grams = _let(heads, lambda h: F.flatten(F.transform(F.slice(h, 1, full), lambda own, k: _let(F.coalesce(F.get(h, k + 1), zero), lambda after: of_block(own, after, k)))))
        short = F.array(told(F.element_at(rolled(codes), -1), F.lit(_PLACES - 1)))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < GRAM, short).otherwise(grams)

    characters = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))
    return _let(F.transform(characters, lambda x: F.hash(x).cast("bigint")), of_codes)


def _chosen(text: Column) -> Column:
    """The chosen hashes with their places of a text without white space."""

    def smallest(g: Column, on: int) -> Column:
        """Of each number and that ``on`` places on, the smaller; places beyond the end are null and do not count."""
        return _let(g, lambda h: F.zip_with(h, F.slice(h, on + 1, F.size(h)), lambda x, y: F.least(x, y)))

    g = _grams(text)
    for on in _grown(WINDOW):
        g = smallest(g, on)
    least = _let(g, lambda m: F.array_distinct(F.slice(m, 1, F.greatest(F.size(m) - WINDOW + 1, F.least(F.size(m), F.lit(1))))))
    place = lambda x: F.lit(_PLACES - 1) - x.bitwiseAND(F.lit(_PLACES - 1))
    return F.transform(least, lambda x: place(x) * F.lit(_PLACES) + F.shiftright(x, 31))


def winnowed(text: Column) -> Column:
    """The chosen hashes with their places, in order of place; a null text counts as empty and has none."""
    return _let(bare(F.coalesce(text, F.lit(""))), _chosen)


def _grown(window: int) -> list[int]:
    """Steps by which windows of one grow to ``window``: twice as large each time, then by what is missing."""
    steps, size = [], 1
    while size < window:
        steps.append(min(size, window - size))
        size += steps[-1]
    return steps


def spliced(head: Column, w: Column, tail: Column, tail_w: Column) -> Column:
    """What ``winnowed`` chooses in ``head`` followed by ``tail``, texts without white space.

    ``w`` is what it chooses in a text that starts with ``head``, ``tail_w`` in one that starts with ``tail``. A choice
    holds where all windows around it lie in the same part; the others are in reach of the seam or the end.
    """
    reach = (GRAM - 1) + (2 * WINDOW - 1)
    at = lambda place: F.greatest(place, F.lit(0)).cast("bigint") * F.lit(_PLACES)

    def cut(x: Column) -> Column:
        """All that depends on the lengths, once: bounds of places, and the parts that are made anew with their starts."""
        a, b = x["a"], x["b"]
        seam, end = F.greatest(a - reach, F.lit(0)), F.greatest(a + b - reach, F.lit(0))
        return F.struct(
            at(a - (GRAM - 1) - WINDOW + 1).alias("first"), at(b - (GRAM - 1) - WINDOW + 1).alias("second"), at(a).alias("shift"), at(seam).alias("seam"), at(end).alias("end"),
            F.substring(x["text"], seam + 1, a + (2 * WINDOW - 2) + GRAM - seam).alias("at_seam"), F.substring(x["text"], end + 1, a + b - end).alias("at_end"),
        )

    def join(x: Column) -> Column:
        again = lambda part, start: F.transform(_let(part, _chosen), lambda y: y + start)
        first = F.filter(w, lambda y: y < x["first"])
        second = F.transform(F.filter(tail_w, lambda y: (y >= F.lit((WINDOW - 1) * _PLACES)) & (y < x["second"])), lambda y: y + x["shift"])
        return F.sort_array(F.array_distinct(F.concat(first, again(x["at_seam"], x["seam"]), second, again(x["at_end"], x["end"]))))

    lengths = F.struct(F.char_length(head).alias("a"), F.char_length(tail).alias("b"), F.concat(head, tail).alias("text"))
    return _let(_let(lengths, cut), join)


def hashes_of(chosen: Column) -> Column:
    """The distinct hashes of what was chosen."""
    return F.array_distinct(F.transform(chosen, lambda x: x.bitwiseAND(F.lit(_PLACES - 1))))


def told(chosen: Column) -> Column:
    """A fingerprint as text: ``hash@place`` in hexadecimal digits, comma-joined, in order of place."""
    said = lambda x: F.concat(F.lower(F.hex(x.bitwiseAND(F.lit(_PLACES - 1)))), F.lit("@"), F.lower(F.hex(F.shiftright(x, 31))))
    return F.array_join(F.transform(chosen, said), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared over all hashes of two hash arrays, 0 to 1; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, fingerprint (text), hashes (distinct, for joins) of every whole text; nulls count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col), F.char_length(text).cast("bigint").alias("n_chars"), winnowed(text).alias("_w"))
    return out.select(id_col, "n_chars", told(F.col("_w")).alias("fingerprint"), hashes_of(F.col("_w")).alias("hashes"))


def _runs(docs: DataFrame) -> Column:
    """Number of the run of each of ``docs`` (doc_id, text): runs follow one another by descending doc_id, null ones last.

    Bounds are quantiles of doc_id, at most _RUNS, so that runs have about as many rows wherever ids lie. A doc_id that fills
    several runs, and the null ones, are dealt to as many by a hash of the text.
    """
    told = docs.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    runs, none = (max(1, min(x // _RUN, _RUNS)) for x in (told["n"], told["none"]))
    cuts = [k / runs for k in range(1, runs)]
    bounds = (docs.agg(F.percentile_approx("doc_id", cuts, 10 * runs)).first()[0] if cuts else None) or []
    several = {i: k for i, k in Counter(bounds).items() if k > 1}
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    block = 1 + int(len(bounds) ** 0.5)  # count the bounds below in two steps
    coarse, fine = numbers(bounds[block - 1 :: block]), numbers(bounds)
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("doc_id")))
    own = _let(below(coarse) * block, lambda k: k + below(F.slice(fine, k + 1, block)))
    parts = F.element_at(F.map_from_arrays(numbers([*several]), numbers([*several.values()])), F.col("doc_id")) if several else F.lit(None)
    deal = lambda k: F.pmod(F.xxhash64("text"), k.cast("bigint"))
    # A doc_id that is a bound is the greatest of its run, so it goes ahead of the others there.
    dealt = F.when(parts.isNull(), F.lit(2 * _RUNS - 1)).otherwise(deal(parts))
    return F.when(F.col("doc_id").isNull(), F.lit((runs + 1) * 2 * _RUNS) + deal(F.lit(none))).otherwise((F.lit(runs) - own).cast("bigint") * (2 * _RUNS) + dealt)


def next_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, w; neither text nor w null) with ``next_text`` and ``next_w`` of the next row by descending doc_id; the last row's next is the first.

    Null doc_ids come last. Rows of equal doc_id follow one another by text, or, where they fill several runs of rows, by
    a hash of the text, then the text. Each run is sorted by itself; its last row finds the first row of the next run.
    """
    lined = docs.withColumn("run", _runs(docs))
    own = sorted(r["run"] for r in lined.select("run").distinct().collect())  # a few for each of _RUNS bounds at most
    after = docs.sparkSession.createDataFrame(list(zip(own, own[1:] + own[:1], strict=True)), "run bigint, _then bigint")
    w = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    lined = lined.select("*", *[F.lead(c).over(w).alias(f"_{c}") for c in ("text", "w")], F.lag(F.lit(1)).over(w).isNull().alias("_head"))
    heads = lined.where("_head").select(F.col("run").alias("_then"), F.col("text").alias("_t"), F.col("w").alias("_f"))
    out = lined.join(after.join(heads, "_then").drop("_then"), "run")
    last = F.col("_text").isNull()  # texts are not null here
    return out.select("doc_id", "text", "w", F.when(last, F.col("_t")).otherwise(F.col("_text")).alias("next_text"), F.when(last, F.col("_f")).otherwise(F.col("_w")).alias("next_w"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """The columns of op8 for ``docs`` (doc_id, text): fingerprints of each text and of its edited text, and how alike they are.

    Null texts count as empty; the likeness of two texts without characters is 1. Repeated rows are kept; other columns
    are not read; doc_ids may be any bigints or null; an empty frame gives an empty one.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = next_documents(own.withColumn("w", winnowed(F.col("text"))))
    n = F.char_length("text")
    head = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))")
    tail = F.expr("left(next_text, cast(floor(char_length(text) / 3) as int))")
    out = own.select("doc_id", n.cast("bigint").alias("n_chars"), F.sha2(F.encode(F.concat(head, tail), "UTF-8"), 256).alias("edited_sha256"), bare(head).alias("head"), bare(tail).alias("tail"), "w", "next_w")
    out = out.withColumn("e", spliced(F.col("head"), F.col("w"), F.col("tail"), F.col("next_w")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        told(F.col("w")).alias("fingerprint"),
        told(F.col("e")).alias("edited_fingerprint"),
        likeness(hashes_of(F.col("w")), hashes_of(F.col("e"))).alias("near_edited"),
        likeness(hashes_of(F.col("w")), hashes_of(F.col("next_w"))).alias("near_next"),
    )
