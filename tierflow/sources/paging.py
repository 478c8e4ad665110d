"""Recorded pages as a Spark data source: a batch of all of them, and a stream whose offset is the wave of pages.

Responses of numbered pages are recorded as they come, in waves of so many page numbers, as Parquet below ``wave=<n>``.
The source plans partitions of some files of waves each and reads them by Arrow's file systems, so a long sequence is spread over the
cluster, small waves do not cost a task each, and a stream that starts again asks only for waves that it has not read. Where a sequence ends, at its first
empty, failed or missing page, is decided by Spark on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from tierflow.operators.sinks import balanced, target_exists
from tierflow.sources.fetch import until_gap
from tierflow.sources.payload import count_records
from tierflow.workspace import durable, runs_on_executors

runs_on_executors(__name__)

PAGES_A_WAVE = 64
#: Files are read together up to so many bytes, where they do not suffice for so many partitions up to less; one counts as
#: ``OPEN_BYTES`` more than it has.
PARTITION_BYTES, PARTITIONS, OPEN_BYTES = 16 << 20, 64, 256 << 10
SCHEMA = "request_id string, page int, status int, body string, error string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def record_pages(responses: DataFrame, path: str, pages_a_wave: int = PAGES_A_WAVE) -> None:
    """Responses (request_id, page from 1, status, body, error) appended to the recorded ones at ``path``.

    A wave is to be complete when it is written: a stream that has read it does not come back."""
    wave = F.floor((F.col("page") - 1) / pages_a_wave).cast("int").alias("wave")
    columns = [c.strip().split()[0] for c in SCHEMA.split(",")]
    balanced(responses.select(*columns, wave), "wave").write.mode("append").partitionBy("wave").parquet(path)


class WaveFile:
    def __init__(self, wave: int, path: str, size: int):
        self.wave, self.path, self.size = wave, path, size


class WaveFiles(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths[0])
        self.paths = paths


def packed(files: list[WaveFile]) -> list[WaveFiles]:
    """Files, in their order, in partitions of at most ``PARTITION_BYTES``, but for single files that have more; a partition for each
    file as long as there are few."""
    most = min(PARTITION_BYTES, sum(f.size + OPEN_BYTES for f in files) / PARTITIONS)
    parts, room = [], 0
    for file in files:
        cost = file.size + OPEN_BYTES
        if not parts or cost > room:
            parts.append([])
            room = most
        parts[-1].append(file.path)
        room -= cost
    return [WaveFiles(paths) for paths in parts]


class _Waves:
    """Files of a folder of waves, listed and read by Arrow."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("recorded pages need the path they lie at")
        self.path = options["path"]

    def _files(self):
        from pyarrow import fs

        path = "file://" + self.path[len("file:") :] if self.path.startswith("file:/") and "://" not in self.path else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(self) -> list[WaveFile]:
        from pyarrow import fs

        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        parts = [(f.path.split("/"), f) for f in found if f.is_file and f.path.endswith(".parquet")]
        named = [(next((p for p in parts[:-1] if p.startswith("wave=")), None), f.path, f.size) for parts, f in parts]
        ordered = sorted(named, key=lambda x: x[1])
        return [WaveFile(int(wave[len("wave=") :]), file, size) for wave, file, size in ordered if wave and "/_temporary/" not in file]

    def rows(self, part: WaveFiles) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        files, _ = self._files()
        kinds = {"int": pa.int32(), "string": pa.string()}
        schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])
        for path in part.paths:
            with files.open_input_file(path) as source:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=1024, columns=schema.names):
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f.name)).cast(f.type) for f in schema], schema=schema)


class _Reader(_Waves, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.pages_a_wave = int(options.get("pagesAWave", PAGES_A_WAVE))
        self.first, self.last = 1, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds of the page leave waves unread; Spark still applies every filter to the rows."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == ("page",) and value is not None:
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.first = max(self.first, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    value -= isinstance(f, LessThan)
                    self.last = value if self.last is None else min(self.last, value)
            yield f

    def partitions(self) -> list[WaveFiles]:
        first = (self.first - 1) // self.pages_a_wave
        last = None if self.last is None else (self.last - 1) // self.pages_a_wave
        return packed([f for f in self.listed() if f.wave >= first and (last is None or f.wave <= last)])

    def read(self, partition: WaveFiles | None) -> Iterator[pa.RecordBatch]:
        # A source without waves is read once, without a partition.
        return self.rows(partition) if partition is not None else iter(())


class _StreamReader(_Waves, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"wave": 0}

    def latestOffset(self) -> dict:
        return {"wave": max((f.wave + 1 for f in self.listed()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[WaveFiles]:
        return packed([f for f in self.listed() if start["wave"] <= f.wave < end["wave"]])

    def read(self, partition: WaveFiles) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class RecordedPages(DataSource):
    """Format ``recorded_pages`` with the options ``path`` and ``pagesAWave``."""

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_pages(spark: SparkSession, path: str, pages_a_wave: int = PAGES_A_WAVE) -> DataFrame:
    """All recorded pages."""
    spark.dataSource.register(RecordedPages)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("recorded_pages").option("path", path).option("pagesAWave", str(pages_a_wave)).load()


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages as waves of them arrive."""
    spark.dataSource.register(RecordedPages)
    return spark.readStream.format("recorded_pages").option("path", path).load()


def counted(pages: DataFrame) -> DataFrame:
    """``pages`` with ``n_items``, the JSON records of each body."""
    return pages.withColumn("n_items", F.when(F.col("body").isNull(), 0).otherwise(count_records(F.col("body"))))


def first_gap(pages: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Rows (request_id, gap): the first page of each request, counted on from what it has ``reached`` or from 1, that
    is empty, failed or not there."""
    held = pages.where((F.col("n_items") > 0) & F.col("error").isNull()).select("request_id", "page").distinct()
    requests = pages.select("request_id").distinct()
    if reached is None:
        starts = requests.withColumn("page", F.lit(1))
    else:
        starts = requests.join(reached, "request_id", "left").select("request_id", (F.coalesce("reached", F.lit(0)) + 1).alias("page"))
    due = starts.unionByName(held.select("request_id", (F.col("page") + 1).alias("page")))
    # Pages before the start are none of the sequence.
    open_ = due.join(held, ["request_id", "page"], "left_anti").join(starts.withColumnRenamed("page", "start"), "request_id")
    return open_.where(F.col("page") >= F.col("start")).groupBy("request_id").agg(F.min("page").alias("gap"))


def sequences(pages: DataFrame, count: Callable[[DataFrame], DataFrame] = counted) -> DataFrame:
    """Pages of each request up to its first gap."""
    known = durable(count(pages))  # read by several branches, and from its source once
    return until_gap(known, first_gap(known)).drop("n_items")


def run_sequences(
    stream: DataFrame, path: str, checkpoint: str, count: Callable[[DataFrame], DataFrame] = counted
) -> DataFrame:
    """Pages of each request up to its first gap, from a stream of waves; kept at ``path`` and returned.

    A request goes on in the next wave only where the last one left it: ``reached`` holds its last page, batch by batch.
    A batch replaces its own output, so that repeating it changes nothing. Reads all that is there and
    stops; started again with the same ``checkpoint``, it goes on.
    """
    spark = stream.sparkSession
    kept_at, reached_at = f"{path}/pages", f"{path}/reached"
    reached_schema = "request_id string, reached int, batch bigint"

    def read(at: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(at) if target_exists(spark, at) else spark.createDataFrame([], schema)

    def write(df: DataFrame, at: str, batch: int) -> None:
        written = df.withColumn("batch", F.lit(batch).cast("bigint"))
        written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(at)

    def merge(batch: DataFrame, number: int) -> None:
        known = durable(count(batch))
        before = read(reached_at, reached_schema).where(F.col("batch") < number)
        before = before.groupBy("request_id").agg(F.max("reached").alias("reached"))
        gaps = first_gap(known, before)
        started = until_gap(known, gaps).join(before, "request_id", "left")
        fresh = started.where(F.col("page") > F.coalesce("reached", F.lit(0))).select(*stream.columns)
        write(fresh, kept_at, number)
        write(gaps.select("request_id", (F.col("gap") - 1).alias("reached")), reached_at, number)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read(kept_at, f"{SCHEMA}, batch bigint").drop("batch")
