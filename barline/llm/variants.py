"""Spelling variants: words one edit apart, the commoner form of each, and the root that forms lead to.

Two words one edit apart are found by asymmetric chunks. The shorter word (of two equally long ones either) is cut into two
disjoint chunks; of the longer one's positional grams those of the same sizes are taken at the places where a chunk can stand,
at most one place off. One edit leaves one of the chunks whole, so the words meet there; an edit-distance test follows. A chunk
that too many words share, such as a common ending, is not compared in full: what it leaves of its words is cut into two chunks
again, one of which the edit also spares, and so on. Words that still meet then differ in one or two signs of the alphabet
only, so a group's size is bounded by the alphabet, whatever the vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import dropped, kept

#: Runs of letters, and the least length and count of a word.
RUNS, LEAST_CHARS, LEAST_COUNT = "[A-Za-zÀ-ÿ]+", 5, 3
#: A run loses a letter where this divides the checksum of its document and itself.
SLIP = 97
#: A form occurs this many times as often as its variant at least.
COMMONER = 2
#: Comparisons that one chunk may bring; chunks beyond it are cut further. Costs time only.
MOST_PAIRS = 4_096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all documents (doc_id, text): runs of letters in lower case (A-Z only), slips applied, at least 5 code points and 3 occurrences.

    A run of a document slips where the crc32 of ``<doc_id>:<run>`` is divisible by 97: it loses its sign at crc32 modulo its
    length. Without a doc_id there is no checksum and no slip. Null texts hold no run.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.length("run")
    runs = runs.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")).alias("h"))
    gone = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), gone), F.substring("run", gone + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(low: Column, high: Column, more: Column, size: Column) -> Column:
    """What a word keeps outside the segment that an edit may be in: ``low`` to ``high`` of the chunked word, ``more`` signs longer in the other."""
    return F.xxhash64(size, low, high, F.substring("word", F.lit(1), low), F.substring("word", high + more + 1, F.length("word")))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (word, n, more, gram, size, low, high) with the segment cut in two: a row for each half that an edit may be in."""
    mid = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    halves = F.explode(F.array(F.struct("low", mid.alias("high")), F.struct(mid.alias("low"), "high")))
    rows = rows.select("word", "n", "more", "gram", "size", halves.alias("h"))
    rows = rows.select("word", "n", "more", "gram", "size", "h.low", "h.high")
    return rows.withColumn("key", _key(F.col("low"), F.col("high"), F.when(F.col("gram"), F.col("more")).otherwise(0), F.col("size")))


def near_pairs(words: DataFrame) -> DataFrame:
    """Every two of the distinct ``words`` (word, n) that differ by one inserted, deleted or replaced code point, once: a, an, b, bn.

    Works for words of two code points or more.
    """
    size = F.length("word")
    roles = F.explode(
        F.array(
            *[F.struct(F.lit(more).alias("more"), F.lit(gram).alias("gram"), (size - (more if gram else 0)).alias("size")) for gram in (False, True) for more in (0, 1)]
        )
    )
    rows = words.select("word", "n", roles.alias("r")).select("word", "n", "r.more", "r.gram", "r.size").where("size > 0")
    todo = _cut(rows.withColumns({"low": F.lit(0), "high": F.col("size")}))
    found, written = None, []
    while True:
        todo = kept(todo)
        written.append(todo)
        sides = todo.groupBy("key", "more").agg(F.count_if(~F.col("gram")).alias("chunks"), F.count_if("gram").alias("grams"))
        crowd = kept(sides.where((F.col("chunks") * F.col("grams") > MOST_PAIRS)).select("key", "more"))
        written.append(crowd)
        open_ = F.col("high") - F.col("low") > 1
        plain = todo.join(crowd, ["key", "more"], "left_anti").unionByName(todo.where(~open_).join(crowd, ["key", "more"], "left_semi"))
        one, other = plain.where("NOT gram").alias("x"), plain.where("gram").alias("y")
        met = one.join(other, (F.col("x.key") == F.col("y.key")) & (F.col("x.more") == F.col("y.more")))
        met = met.where(((F.col("x.more") == 1) | (F.col("x.word") < F.col("y.word"))) & (F.levenshtein("x.word", "y.word", 1) == 1))
        met = kept(met.select(F.col("x.word").alias("a"), F.col("x.n").alias("an"), F.col("y.word").alias("b"), F.col("y.n").alias("bn")))
        written.append(met)
        found = met if found is None else found.unionByName(met)
        crowded = todo.where(open_).join(crowd, ["key", "more"], "left_semi")
        if crowded.isEmpty():
            break
        todo = _cut(crowded.drop("key"))
    out = kept(found.distinct())  # an insertion beside its like is found from both chunks
    dropped(*written)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of ``forms`` (word, form): the last word that forms lead to.

    Each round doubles how far a word sees; as a form is at least twice as common as its word, 6 rounds are always enough.
    """
    seen = kept(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = kept(seen.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        dropped(seen)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        seen = now.select("word", "root")
        seen._kept_at = now._kept_at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (of equals the smallest in code-point order) if that n is at least twice the
    word's; root follows forms to the last and is the word itself without one. Words and slips as in ``counted_words``; an
    empty table gives an empty one, repeated rows count again, other columns are not read.
    """
    words = kept(counted_words(docs))
    pairs = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("near_n"))))
    best = pairs.select(ends.alias("e")).groupBy("e.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("e.near_n")).alias("less"), F.col("e.near").alias("near"))).alias("best"))
    known = words.join(best, "word", "left")
    common = -F.col("best.less") >= COMMONER * F.col("n")
    known = kept(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n")))
    dropped(words, pairs)
    out = known.join(roots(known.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
