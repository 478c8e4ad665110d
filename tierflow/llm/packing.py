"""Packing of documents into sequences of a fixed number of token ids.

Only documents longer than a sequence are cut; the first piece takes what is left over and
the others fill sequences. Packing looks at lengths alone, so the instance is the
number of pieces of each length: at most ``capacity`` numbers, however many documents there are.

1. Dominance reduction after Martello and Toth: for a piece of length j, a set of pieces that
   fits beside it is fixed for good if every other set that fits beside it could be exchanged for it
   without needing another sequence: j alone where nothing fits; j and the longest piece b that
   fits, where b fills the rest exactly, or at most one piece fits, or at most two fit and no two
   are longer together than b; j, a and b, the longest two that fit together, where at most two fit, a is the longest
   that fits at all and no two pieces longer than b fit (then of any two one is at most a and the other at most b).
   A rule that holds for a set goes on holding while the set's lengths last, since pieces only
   go; so it is applied as often as they last. Rounds go on until no rule applies.
2. Best fit, longest first: each length goes to the fullest sequences that have room.

The result is a list of patterns with multiplicities, a few for each length. A piece finds
its sequence by its rank among the pieces of its length.

Null texts count as empty (a single closing id); repeated rows are packed each; an empty
table gives no rows. Which of equally long pieces takes which place depends on their order in the input.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierflow.llm import byte_bpe, words
from tierflow.workspace import arrow_batches, durable, runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors("tierflow.llm.byte_bpe")
runs_on_executors(__name__)

CAPACITY = 2048
#: Bytes of an Arrow batch.
ARROW_BYTES = 1 << 23
#: What a worker keeps for this operator.
KEPT = ("byte bpe", "letter classes", "plain numbers")


class _Lengths:
    """How many pieces there are of each length, and which lengths there are."""

    def __init__(self, counts):
        self.counts = Counter({k: v for k, v in counts.items() if v > 0})
        self.sorted = sorted(self.counts)

    def take(self, lengths):
        """Take a set of pieces as often as it can be had; how often."""
        need = Counter(lengths)
        times = min(self.counts[x] // n for x, n in need.items())
        for x, n in need.items():
            self.counts[x] -= n * times
            if not self.counts[x]:
                del self.counts[x]
                del self.sorted[bisect_left(self.sorted, x)]
        return times

    def beside(self, j, most):
        """The ``most`` shortest pieces besides one of length ``j``."""
        found = []
        for x in self.sorted:
            found += [x] * min(most - len(found), self.counts[x] - (x == j))
            if len(found) == most:
                break
        return found

    def longest(self, j, room):
        """The longest piece up to ``room`` besides one of length ``j``; 0 if there is none."""
        i = bisect_right(self.sorted, room) - 1
        while i >= 0 and self.counts[self.sorted[i]] - (self.sorted[i] == j) < 1:
            i -= 1
        return self.sorted[i] if i >= 0 else 0

    def longest_pair(self, j, room):
        """(a, b), a >= b, with the largest sum up to ``room`` besides one of length ``j``; of equal sums the one
        with the largest a, (0, 0) if no two fit."""
        lengths, best = self.sorted, (0, 0)
        for high in range(bisect_right(lengths, room) - 1, -1, -1):
            a = lengths[high]
            if 2 * a <= sum(best):
                break
            if self.counts[a] == (a == j):
                continue
            # Beside a piece of length a, the longest that is left of those up to min(a, room - a).
            low = min(high, bisect_right(lengths, room - a) - 1)
            while low >= 0 and self.counts[lengths[low]] <= (lengths[low] == j) + (lengths[low] == a):
                low -= 1
            if low >= 0 and a + lengths[low] > sum(best):
                best = (a, lengths[low])
        return best

    def shortest_pair(self, j, above):
        """The two shortest pieces longer than ``above`` besides one of length ``j``, as far as there are."""
        found = []
        for x in self.sorted[bisect_right(self.sorted, above) :]:
            found += [x] * min(2 - len(found), self.counts[x] - (x == j))
            if len(found) == 2:
                break
        return found


def _dominating(lengths, j, capacity):
    """A set with ``j`` that dominates all others with it, or None."""
    room = capacity - j
    shortest = lengths.beside(j, 3)
    if not shortest or shortest[0] > room:
        return (j,)
    b = lengths.longest(j, room)
    if b == room or sum(shortest[:2]) > room or len(shortest) == 1:
        return (j, b)
    if sum(shortest) > room or len(shortest) == 2:  # at most two fit
        first, second = lengths.longest_pair(j, room)
        if b >= first + second:
            return (j, b)
        if first == b:
            longer = lengths.shortest_pair(j, second)
            if len(longer) < 2 or sum(longer) > room:
                return (j, first, second)
    return None


def reduce_dominated(counts: dict[int, int], capacity: int = CAPACITY):
    """(patterns fixed by dominance, what is left of ``counts``); a pattern is (times, lengths)."""
    lengths, fixed, changed = _Lengths(counts), [], True
    while changed:
        changed = False
        for j in reversed(list(lengths.sorted)):
            while lengths.counts[j] and (found := _dominating(lengths, j, capacity)):
                fixed.append((lengths.take(found), found))
                changed = True
    return fixed, dict(lengths.counts)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY):
    """Patterns (times, lengths with counts) by best fit, longest lengths first."""
    rooms: list[int] = []
    groups: dict[int, list] = {}

    def put(times, content, room):
        if times:
            if room not in groups:
                rooms.insert(bisect_left(rooms, room), room)
                groups[room] = []
            groups[room].append((times, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                times, content = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, times, content = capacity, left, ()
            each = room // length
            full = min(times, left // each)
            put(full, (*content, (length, each)), room - each * length)
            left -= full * each
            times -= full
            if left and times:
                put(1, (*content, (length, left)), room - left * length)
                times, left = times - 1, 0
            if content:
                put(times, content, room)
    return [group for held in groups.values() for group in held]


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY):
    """Rows (length, first rank, end rank, pieces of the length in a sequence, first sequence, offset)."""
    fixed, rest = reduce_dominated(counts, capacity)
    patterns = [(times, tuple(Counter(found).items())) for times, found in fixed] + best_fit(rest, capacity)
    ranks, sequence, rows = Counter(), 0, []
    for times, content in patterns:
        offset = 0
        for length, each in content:
            rows.append((length, ranks[length], ranks[length] + times * each, each, sequence, offset))
            ranks[length] += times * each
            offset += length * each
        sequence += times
    return rows


def _pieces(path, end_id, capacity):
    """For ``mapInArrow``: the pieces of each document, with ranks among equally long ones of the part."""

    def run(parts):
        import numpy as np

        encoder, part = byte_bpe.encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in parts:
            for first, last in words.column_batches(batch.column(1)):
                ids, bounds = encoder.encode(batch.column(1).slice(first, last - first).to_pylist())
                ids = np.insert(ids.astype("<u4"), bounds[1:], end_id)
                flat = memoryview(ids).cast("B")
                rows, numbers, starts, lengths, sums = [], [], [], [], []
                bounds = (bounds + np.arange(last - first + 1)).tolist()
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    cut = (b - a) % capacity or capacity
                    for piece, (c, d) in enumerate(zip([a, *range(a + cut, b, capacity)], range(a + cut, b + 1, capacity))):
                        rows.append(first + i)
                        numbers.append(piece)
                        starts.append(c - a)
                        lengths.append(d - c)
                        sums.append(zlib.crc32(flat[4 * c : 4 * d]))
                ranks = []
                for length in lengths:
                    ranks.append(seen[length])
                    seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, type=pa.int64())),
                        pa.array(np.full(len(rows), part, dtype=np.int32)),
                        pa.array(numbers, type=pa.int32()),
                        pa.array(starts, type=pa.int64()),
                        pa.array(lengths, type=pa.int64()),
                        pa.array(sums, type=pa.int64()),
                        pa.array(ranks, type=pa.int64()),
                    ],
                    names=["doc_id", "part", "piece", "start", "length", "ids_crc32", "rank_in_part"],
                )

    return run


def pack(docs: DataFrame, id_column="doc_id", text_column="text", vocabulary=None, end_id=0, capacity=CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    The pieces are written to the shared folder once. The driver sees the number of pieces of each length,
    at most ``capacity`` rows, and sends back the patterns' rows, which that number bounds too.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    schema = f"doc_id {kind}, part int, piece int, start bigint, length bigint, ids_crc32 bigint, rank_in_part bigint"
    run = words.released(_pieces(vocabulary or byte_bpe.default_path(), end_id, capacity), *KEPT)
    with arrow_batches(spark, ARROW_BYTES):
        pieces = durable(rows.mapInArrow(run, schema))
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        pack_lengths(counts, capacity),
        "plan_length bigint, first_rank bigint, end_rank bigint, each bigint, sequence bigint, place bigint",
    )
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    inside = (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    nth = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(plan), inside).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"),
    )
