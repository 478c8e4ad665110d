"""Document fingerprints by winnowing, in Spark expressions alone.

A text's words are its lower-cased runs of up to 16 non-blanks. Longer runs, and so texts without blanks, are cut where their
content says: after each of ``MARKS`` (some letters and digits, and every character of scripts that write no blanks), or else after
16 characters. So a stretch that two texts share is cut alike from its first mark on, wherever it stands. Hashes of
k words in a row are rolled up by doubling: the hash of 2n words is that of two hashes of n words. Of each
window of w such hashes the smallest is chosen, of equal ones the rightmost, and kept with its
position. So any k + w - 1 words that two texts share give them a common chosen hash, and
nothing shorter than k words does, but for texts that are shorter themselves: those have one hash of all words.

A hash and its position share 63 bits (33 and 30), so that minima are minima of numbers. A value of Spark's string type has
less than 2**30 words, so every position is its own.

Null texts count as empty; an empty or blank text has the empty fingerprint, which is like another
empty one (1) and unlike all others (0). Equal texts have equal fingerprints. Repeated rows each have a result, the next of one being the
other; an empty table gives none. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOUBLINGS = 2  # k = 4 words
WINDOW_DOUBLINGS = 3  # w = 8 hashes
POSITION_BITS = 30
POSITIONS = (1 << POSITION_BITS) - 1
LENGTH_OF_PIECE = 16
#: After what a long run is cut: vowels and two digits; and Thai to Khmer, Hangul and all scripts from the CJK radicals on.
MARKS = r"aeiou05\u0E00-\u0EFF\u1000-\u11FF\u1780-\u17FF\u2E80-\uFFFF\x{10000}-\x{10FFFF}"
PIECE = rf"(?<!\S)\S{{1,{LENGTH_OF_PIECE}}}(?!\S)|[^\s{MARKS}]{{0,{LENGTH_OF_PIECE - 1}}}[{MARKS}]|[^\s{MARKS}]{{1,{LENGTH_OF_PIECE}}}"
#: Bytes of text that one slice of the order holds; slices of each of two levels.
SLICE_BYTES = 8 << 20
SLICES = 1000
MOST_TASKS = 100_000


def _neighbours(array: str, distance: int, combine) -> Column:
    """``combine`` of each element and the one ``distance`` further on."""
    n = F.greatest(F.size(array) - distance, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 1 + distance, n), lambda a, b: combine(a, b))


def with_fingerprint(df: DataFrame, text_column: str, name: str, doublings=DOUBLINGS, window_doublings=WINDOW_DOUBLINGS) -> DataFrame:
    """``df`` with the chosen hashes in ``name``: an array of hash * 2**30 + (2**30 - 1 - position)."""
    at, hashes, few = f"_{name}_words", f"_{name}_hashes", f"_{name}_few"
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_column), F.lit(""))), F.lit(PIECE), F.lit(0))
    df = df.withColumn(at, F.transform(words, lambda w: F.xxhash64(w)))
    few_words = (F.size(at) > 0) & (F.size(at) < (1 << doublings))
    df = df.withColumn(few, F.when(few_words, F.array(F.xxhash64(F.col(at)))))
    for i in range(doublings):
        df = df.withColumn(at, _neighbours(at, 1 << i, F.xxhash64))
    placed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 61 - POSITION_BITS), POSITION_BITS) + (F.lit(POSITIONS) - i)
    df = df.withColumn(hashes, F.transform(F.coalesce(F.col(few), F.col(at)), placed))
    smallest = F.filter(F.array(F.array_min(hashes)), lambda x: x.isNotNull())
    df = df.withColumn(few, F.when(F.size(hashes) < (1 << window_doublings), smallest))
    for i in range(window_doublings):
        df = df.withColumn(hashes, _neighbours(hashes, 1 << i, F.least))
    return df.withColumn(name, F.coalesce(F.col(few), F.array_distinct(hashes))).drop(at, hashes, few)


def written(fingerprint: str | Column) -> Column:
    """A fingerprint as text: hash@position, separated by spaces."""
    one = lambda v: F.concat(
        F.lower(F.hex(F.shiftright(v, POSITION_BITS))), F.lit("@"), (F.lit(POSITIONS) - v.bitwiseAND(POSITIONS)).cast("string")
    )
    return F.array_join(F.transform(fingerprint, one), " ")


def chosen_hashes(fingerprint: str | Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, POSITION_BITS)))


def likeness(one: str, other: str) -> Column:
    """Jaccard likeness of two arrays of distinct hashes; 1 if both are empty."""
    shared = F.size(F.array_intersect(one, other))
    total = F.size(one) + F.size(other) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def _measured(docs: DataFrame, id_column: str, text_column: str):
    """How many slices ``docs`` has, and percentiles of its ids (none without ids)."""
    steps = [i / SLICES for i in range(1, SLICES)]
    found = docs.agg(
        F.sum(F.octet_length(text_column)).alias("bytes"), F.percentile_approx(id_column, steps, 10 * SLICES).alias("steps")
    ).first()
    return max(1, math.ceil((found["bytes"] or 0) / SLICE_BYTES)), found["steps"]


def with_slice(docs: DataFrame, id_column: str, text_column: str, name="_slice", measured=None) -> DataFrame:
    """``docs`` with a number that rises with the id, equal for about ``SLICE_BYTES`` of text.

    Borders are percentiles of the ids; where one level of them is too coarse, each of its slices has
    a second. So at most ``SLICES`` numbers are literals and ``SLICES`` ** 2 are broadcast. An id that is several
    percentiles has as many slices, which part its rows by the hash of their text.
    """
    slices, steps = measured or _measured(docs, id_column, text_column)
    first, second = min(slices, SLICES), math.ceil(slices / SLICES)
    borders = [steps[i * SLICES // first - 1] for i in range(1, first)] if steps else []
    part = F.xxhash64(text_column) / F.lit(2.0**64) + F.lit(0.5)

    def passed(array):
        own = F.size(F.filter(array, lambda b: b == F.col(id_column)))
        return F.size(F.filter(array, lambda b: b < F.col(id_column))) + F.least(F.floor(part * own), F.greatest(own - 1, F.lit(0)))

    number = passed(F.array(*map(F.lit, borders))) if borders else F.lit(0)
    docs = docs.withColumn(name, F.when(F.col(id_column).isNull(), F.lit(0)).otherwise(number).cast("bigint"))
    if second > 1:
        finer = [i / second for i in range(1, second)]
        inner = docs.groupBy(name).agg(F.percentile_approx(id_column, finer, 10 * SLICES).alias("_finer"))
        inner = inner.withColumnRenamed(name, "_outer")
        docs = docs.join(F.broadcast(inner), F.col(name) == F.col("_outer"), "left")
        docs = docs.withColumn(name, F.col(name) * second + F.coalesce(F.size(F.filter("_finer", lambda b: b < F.col(id_column))), F.lit(0)))
        docs = docs.drop("_outer", "_finer")
    return docs


def with_next(docs: DataFrame, values: list[str], prepare=lambda df: df) -> DataFrame:
    """Rows (doc_id, text and what ``prepare`` adds) with ``values`` of the next row in ascending order of (id, text),
    as ``next_...``; after the last comes the first.

    One shuffle deals the rows out by ranges of slices. Each slice also gets the first row of the next one that has rows.
    """
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    measured = _measured(rows, "doc_id", "text")
    placed = with_slice(rows, "doc_id", "text", measured=measured)
    heads = placed.groupBy("_slice").agg(F.min(F.struct("doc_id", "_tie")).alias("head"))  # one row a slice
    by_slice = Window.orderBy("_slice")
    everything = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_slice").over(by_slice), F.last("_slice").over(everything))
    heads = heads.select(before.alias("_before"), F.col("head.doc_id").alias("_head"), F.col("head._tie").alias("_head_tie"))
    is_head = placed["doc_id"].eqNullSafe(F.col("_head")) & (placed["_tie"] == F.col("_head_tie"))
    borrowed = placed.join(F.broadcast(heads), is_head).withColumn("_slice", F.col("_before"))
    rows = placed.withColumn("_borrowed", F.lit(False)).unionByName(
        borrowed.select(*placed.columns).withColumn("_borrowed", F.lit(True))
    )
    dealt = prepare(rows.repartitionByRange(min(measured[0], MOST_TASKS), "_slice"))
    order = Window.partitionBy("_slice").orderBy("_borrowed", "doc_id", "_tie", "text")
    following = F.lead(F.struct(*values)).over(order)
    led = dealt.withColumn("_next", following).where(~F.col("_borrowed"))
    return led.select("*", *(F.col("_next")[v].alias(f"next_{v}") for v in values)).drop("_next", "_slice", "_tie", "_borrowed")


def compare_with_next(docs: DataFrame, id_column="doc_id", text_column="text") -> DataFrame:
    """Each text's fingerprint, its edited text with its fingerprint, and likenesses.

    The edited text is the text with its last half replaced by as much of the next text's beginning.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    led = with_next(rows, ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", "fingerprint"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    led = led.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("bigint")).drop("text", "next_text")
    led = with_fingerprint(led, "edited", "edited_fingerprint")
    for name in ("fingerprint", "edited_fingerprint", "next_fingerprint"):
        led = led.withColumn(f"{name}_hashes", chosen_hashes(name))
    return led.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint_hashes", "edited_fingerprint_hashes").alias("near_edited"),
        likeness("fingerprint_hashes", "next_fingerprint_hashes").alias("near_next"),
    )
