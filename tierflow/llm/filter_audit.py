"""How quality filters overlap: what each removes in every order of them, from 32 stored states.

Each document gets a mask of the filters it fails, documents are counted by part and mask (a cell), and a
Gray code walks all subsets of filters, toggling one filter at a time. Every cell keeps a counter of the active
filters it fails; a cell whose counter leaves or comes back to zero changes the running number of survivors, so a step of the
walk costs one look at each cell. The survivors of the 32 subsets are stored, and whatever an order of filters
does at a step is a difference of two of them.

The fifth filter asks for a smaller id with the same text in the whole table. Texts are told apart by SHA-256; the smallest id of
each is found by partial minima, and looked up by (text, id), so that thousands of copies do not meet in a task.

Null texts count as empty, a null part as the empty string. A null id is larger than all others. Repeated rows
of one id and text are counted each, and none of them is a copy of the other. A document is good or toxic if any of its
labels says so. An empty table gives no rows. Only the named columns are read, so other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierflow.workspace import durable, runs_on_executors

runs_on_executors(__name__)

FILTERS = "ABCDE"
#: Blanks between words, as characters of a set.
BLANKS = r"\x20\x09-\x0D"
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 100, 80, 10, "#$%&*|"
SUMS = ["n", "good", "toxic"]
RESULT = "filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def _failures(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and the conditions A to D of each row as bits 0 to 3 of ``mask``."""
    stripped = F.regexp_replace("text", f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    listed = docs.withColumn("words", F.when(stripped != "", F.split(stripped, f"[{BLANKS}]+", -1)).otherwise(F.array().cast("array<string>")))
    words = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = [
        words < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < DISTINCT_SHARE * words,
        100 * capitals > CAPITAL_SHARE * F.length("text"),
        F.col("text").rlike(f"[{SYMBOLS}]"),
    ]
    return listed.withColumn("mask", sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))).drop("words")


def cells(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", part_column="lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of each part by the filters they fail."""
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    rows = _failures(rows.withColumn("text_key", F.unhex(F.sha2("text", 256))))
    # One short row for each id, text and part; texts stay where they are read.
    folded = durable(rows.groupBy("text_key", "doc_id", "part", "mask").agg(F.count("*").alias("copies")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    first = folded.groupBy("text_key").agg(F.min(order).alias("first")).select(F.col("text_key").alias("first_key"), F.col("first.doc_id").alias("first_id"))
    same = (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    marked = folded.join(first, same, "left").withColumn("mask", F.col("mask") + F.when(F.col("first_key").isNull(), 16).otherwise(0))
    judged = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("is_good"), F.max((F.col("toxic") == 1).cast("int")).alias("is_toxic")
    )
    joined = marked.join(judged, F.col("doc_id") == F.col("label_id"), "left")
    weighted = lambda flag, name: F.coalesce(F.sum(F.col("copies") * F.col(flag)), F.lit(0)).cast("bigint").alias(name)
    return joined.groupBy("part", "mask").agg(F.sum("copies").alias("n"), weighted("is_good", "good"), weighted("is_toxic", "toxic"))


def survivors(masks, sums):
    """What no active filter takes of ``sums`` (rows of numbers, one a cell), for each of the subsets of filters.

    Subsets are visited in the order of a Gray code; neighbours differ in one filter.
    """
    failing = [0] * len(masks)
    running = [sum(column) for column in zip(*sums)]
    states = {0: tuple(running)}
    active = 0
    for number in range(1, 1 << len(FILTERS)):
        bit = (number & -number).bit_length() - 1
        active ^= 1 << bit
        change = 1 if active >> bit & 1 else -1
        for cell, mask in enumerate(masks):
            if not mask >> bit & 1:
                continue
            before = failing[cell]
            failing[cell] += change
            if not before or not failing[cell]:
                running = [x - change * y for x, y in zip(running, sums[cell])]
        states[active] = tuple(running)
    return states


def audited(masks, sums):
    """Rows of the report: every order of the filters, every step."""
    states = survivors(masks, sums)
    everyone, full = states[0][0], (1 << len(FILTERS)) - 1
    size = len(FILTERS)
    shapley = []
    for bit in range(size):
        one, total = 1 << bit, 0
        for subset in range(full + 1):
            if not subset & one:
                before = subset.bit_count()
                total += factorial(before) * factorial(size - 1 - before) * (states[subset][0] - states[subset | one][0])
        shapley.append(total)
    rows = []
    for order in permutations(range(size)):
        name, subset = "".join(FILTERS[k] for k in order), 0
        for step, bit in enumerate(order, 1):
            before, after = states[subset], states[subset := subset | 1 << bit]
            removed = before[0] - after[0]
            rows.append((
                name, step, after[0], removed,
                everyone - states[1 << bit][0] - removed,
                states[full ^ 1 << bit][0] - states[full][0],
                before[1] - after[1], before[2] - after[2], shapley[bit],
            ))
    return rows


def audit(docs: DataFrame, labels: DataFrame, id_column="doc_id", text_column="text", part_column="lang") -> DataFrame:
    """Rows (part, filter_order, step and counts), one for each part, order of the filters and step.

    A part has at most 32 cells, which is all that a task or the walk sees of it.
    """
    names = [field.split()[0] for field in RESULT.split(", ")]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(audited(group["mask"].tolist(), list(zip(*(group[c].tolist() for c in SUMS)))), columns=names)
        found.insert(0, "part", group["part"].iloc[0])
        return found

    counted = cells(docs, labels, id_column, text_column, part_column)
    return counted.groupBy("part").applyInPandas(walk, f"part string, {RESULT}")
