"""Change capture on a stream: inserts, updates and deletes in any order, with keyed state and timers.

The state of a key is the version of its newest change and whether that was a deletion. Older and repeated
changes are dropped before they reach the table. A deletion leaves a tombstone in the state, so that an update that
arrives after it does not bring the row back. Its timer goes off when the watermark has passed it: from then on
older changes are too late for the stream anyway, and the tombstone goes. So the state grows
with the living keys and the deletions of the time that the watermark allows for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tierflow.operators.sinks import target_exists
from tierflow.streaming import compiled, jobs
from tierflow.workspace import runs_on_executors

runs_on_executors(__name__)

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PYTHON_OPERATOR = "transformWithStateInPySparkExec"
DELETED = "D"


def _rank(version: Sequence) -> tuple:
    """Versions compare column by column; null is older than any value."""
    return tuple((v is not None, v) if v is not None else (False,) for v in version)


def _state(version: T.StructType) -> T.StructType:
    return T.StructType([*version.fields, T.StructField("deleted", T.BooleanType())])


class NewestChange(StatefulProcessor):
    """Lets the newest change of a key through, if it is newer than what the key has.

    Streams run it as a Java class (:mod:`tierflow.streaming.compiled`), but for versions of nested types, rows that only Python
    can read, and checkpoints that began with this one.
    """

    def __init__(self, version: T.StructType, op: str, timestamp: str, keep_ms: int):
        self.version, self.op, self.timestamp, self.keep_ms = version, op, timestamp, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", _state(self.version))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Every call to the state or its timers is a round trip to the JVM, which is most of a key's cost: a new or living key takes two.
        held = self.newest.get()
        reached = _rank(held[:-1]) if held else None
        best = None
        for row in rows:
            rank = _rank([row[c] for c in self.version.names])
            if reached is None or rank > reached:
                reached, best = rank, row
        if best is not None:
            if held and held[-1]:  # only a tombstone has a timer
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            gone = best[self.op] == DELETED
            self.newest.update((*(best[c] for c in self.version.names), gone))
            if gone and best[self.timestamp] is not None:
                self.handle.registerTimer(int(best[self.timestamp].timestamp() * 1000) + self.keep_ms)
            yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.newest.get()
        if held and held[-1]:
            self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def newest_changes(
    changes: DataFrame,
    keys: Sequence[str],
    version: Sequence[str],
    timestamp: str,
    late_by: str,
    op: str = "op",
    keep_ms: int = 0,
    in_python: bool = False,
) -> DataFrame:
    """The changes of a stream that are newer than all before them of their key; the last deletion as well.

    ``version`` orders a key's changes, ``timestamp`` is their event time: an older change may not be later than a deletion by
    more than ``keep_ms``, which is how much longer a tombstone stays. Null keys are a key. ``in_python`` is for checkpoints that
    began with the processor in Python, with which Spark wants them to go on (:func:`began_in_python`).
    """
    stream = jobs.with_watermark(changes, timestamp, late_by)
    schema = stream.schema
    held = T.StructType([T.StructField(c, schema[c].dataType) for c in version])
    if not in_python and compiled.can_run(schema, held):
        return compiled.newest_changes(stream, keys, held, _state(held), op, timestamp, DELETED, keep_ms)
    processor = NewestChange(held, op, timestamp, keep_ms)
    return stream.groupBy(*keys).transformWithState(processor, schema, "Append", "EventTime")


def began_in_python(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the state at ``checkpoint`` is that of the processor in Python."""
    if not target_exists(spark, f"{checkpoint}/state/0/_metadata"):
        return False
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorName").collect()
    return any(r["operatorName"] == PYTHON_OPERATOR for r in operators)


@contextmanager
def _rocksdb(spark: SparkSession):
    """State of this kind needs the RocksDB store; the session's own choice is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def run_capture(
    changes: DataFrame,
    keys: Sequence[str],
    version: Sequence[str],
    timestamp: str,
    late_by: str,
    path: str,
    checkpoint: str,
    op: str = "op",
    buckets: int | None = None,
) -> DataFrame:
    """The table that a stream of changes (I, U and D in ``op``) leads to, kept at ``path``; returns its living rows.

    Processes all that is there and stops. Started again with the same ``checkpoint`` it goes on where it
    stopped; a micro-batch that is repeated leads to the same rows, since the table too takes the newest version.
    """
    spark = changes.sparkSession
    newest = newest_changes(changes, keys, version, timestamp, late_by, op, in_python=began_in_python(spark, checkpoint))
    with _rocksdb(spark):
        table = jobs.run_upsert(newest, keys, [f"-{c}" for c in version], path, checkpoint, buckets)
    return table.where(~F.col(op).eqNullSafe(DELETED))
