"""Token ids of documents as ORC files that can be read stripe by stripe.

The documents are put in ascending order of their id over all files (null ids first, ties by the
text's hash and the text), encoded and written, one row each: ``ids`` with a closing id, their number, and where
they start among the ids of the file's part. ORC stores integers by run-length encoding; row
indexes and a Bloom filter on the document id let a reader skip stripes and row groups.
Where a document starts among all ids follows from the parts' totals, one row a part.

Null texts count as empty and give the closing id alone; repeated rows and ids are kept, each with
its own place; an empty table gives no rows. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierflow.llm import byte_bpe, words
from tierflow.workspace import runs_on_executors

runs_on_executors("tierflow.llm.words")
runs_on_executors("tierflow.llm.byte_bpe")
runs_on_executors(__name__)

#: Small stripes let many readers share a file; a row group is what an index entry or Bloom filter speaks of.
OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encoded_parts(path, end_id):
    """For ``mapInArrow``: rows of a part in their order, with ids and their place in the part."""

    def run(parts):
        encoder, part, place = byte_bpe.encoder(path), TaskContext.get().partitionId(), 0
        import numpy as np

        for batch in parts:
            for first, last in words.column_batches(batch.column(1)):
                n = last - first
                ids, bounds = encoder.encode(batch.column(1).slice(first, n).to_pylist())
                ids = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                bounds = bounds + np.arange(n + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(np.full(n, part, dtype=np.int32)),
                        pa.array(place + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"],
                )
                place += int(bounds[-1])

    return run


def write_token_files(docs: DataFrame, path: str, id_column="doc_id", text_column="text", vocabulary=None, end_id=0) -> None:
    """Encode all ``docs`` and write them below ``path`` in ascending order of their id."""
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    files = ordered.mapInArrow(
        encoded_parts(vocabulary or byte_bpe.default_path(), end_id),
        f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids array<int>",
    )
    files.write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids); ``start`` counts all ids before the document's.

    The parts' totals are broadcast: one row for each task that wrote. Filters on ``doc_id``
    reach the files' indexes and Bloom filters.
    """
    files = spark.read.orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("base_part"), F.coalesce(F.sum("ids_in_part").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), F.col("part") == F.col("base_part"))
    return placed.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by the unsigned crc32 of their little-endian unsigned 32-bit integers."""

    def run(parts):
        import numpy as np

        for batch in parts:
            column = batch.column(batch.schema.get_field_index("ids"))
            bounds = column.offsets.to_numpy()
            flat = memoryview(np.ascontiguousarray(column.values.to_numpy().astype("<u4", copy=False))).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            kept = [c for c in range(batch.num_columns) if batch.schema.names[c] != "ids"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sums, type=pa.int64())],
                names=[*(batch.schema.names[c] for c in kept), "ids_crc32"],
            )

    fields = [f for f in tokens.schema.fields if f.name != "ids"]
    return tokens.mapInArrow(run, T.StructType([*fields, T.StructField("ids_crc32", T.LongType())]))
