"""Erasure that rewrites only files that may hold a subject.

Beside a table of Parquet files lies an index: for each file a Bloom filter of its subjects, as bitmaps of ``BITMAP`` hash places. To erase, the
subjects' places are looked up in it; files that have none stay as they are, byte for byte. The others are written anew without the
subjects and take the old ones' place, in an order that a run which breaks off can be finished in.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tierflow.operators.sinks import erase, target_exists
from tierflow.workspace import staging_path

#: Places of one bitmap of Spark's bitmap functions, and places for each row of a file: one subject in so many is found by mistake.
BITMAP, PLACES_A_ROW = 32768, 16
INDEX, SWAPS = "_subjects", "_swaps"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _places(key: Column, bitmaps: Column) -> Column:
    """Place of a key among all of a file's ``bitmaps``."""
    return F.pmod(F.xxhash64(key), bitmaps * BITMAP)


def subject_index(df: DataFrame, key: str) -> DataFrame:
    """Rows (file, n_rows, bitmaps, bucket, bitmap) of a table as read from its files."""
    rows = df.where(F.col(key).isNotNull()).select(_file_name(F.col("_metadata.file_path")).alias("file"), F.col(key).alias("key"))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n_rows"))
    sizes = sizes.withColumn("bitmaps", F.ceil(F.col("n_rows") * PLACES_A_ROW / BITMAP))
    placed = rows.join(sizes, "file").withColumn("place", _places(F.col("key"), F.col("bitmaps")))
    bucket = F.floor(F.col("place") / BITMAP)
    return placed.groupBy("file", "n_rows", "bitmaps", bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") % BITMAP + 1)).alias("bitmap")
    )


def build_index(spark: SparkSession, path: str, key: str) -> None:
    """The index of the table at ``path``, in place of an older one."""
    subject_index(spark.read.parquet(path), key).write.mode("overwrite").parquet(f"{path}/{INDEX}")


def files_with(index: DataFrame, subjects: DataFrame, key: str) -> DataFrame:
    """Files (file) that may hold one of ``subjects``; what holds one is among them."""
    sizes = index.select("bitmaps").distinct()
    wanted = subjects.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct()
    # A subject has a place for each size of filter that there is; sizes are few, as files are of about one size.
    known = [r["bitmaps"] for r in sizes.orderBy("bitmaps").collect()]
    places = wanted.withColumn("bitmaps", F.explode(F.array(*(F.lit(n).cast("bigint") for n in known)).cast("array<bigint>")))
    places = places.withColumn("place", _places(F.col("key"), F.col("bitmaps")))
    places = places.select("bitmaps", F.floor(F.col("place") / BITMAP).alias("bucket"), (F.col("place") % BITMAP).alias("bit")).distinct()
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = index.join(places, ["bitmaps", "bucket"]).where(F.getbit(byte, F.pmod(F.col("bit"), F.lit(8)).cast("int")) == 1)
    return held.select("file").distinct()


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _swap(spark: SparkSession, path: str, old: list[str], new: list[str]) -> None:
    """Remove the old files, then show the new ones, which are hidden by their names. Does what is left to do."""
    for name in old:
        at, files = _fs(spark, f"{path}/{name}")
        files.delete(at, False)
    for name in new:
        hidden, files = _fs(spark, f"{path}/_{name}")
        if files.exists(hidden):
            files.rename(hidden, _fs(spark, f"{path}/{name}")[0])


def finish_erasures(spark: SparkSession, path: str, key: str) -> int:
    """Swaps that a run left unfinished, done; returns their number. The index is built anew if there were any."""
    if not target_exists(spark, f"{path}/{SWAPS}"):
        return 0
    swaps = spark.read.parquet(f"{path}/{SWAPS}").collect()
    for r in swaps:
        _swap(spark, path, list(r["old"]), list(r["new"]))
    if swaps:
        build_index(spark, path, key)
    at, files = _fs(spark, f"{path}/{SWAPS}")
    files.delete(at, True)
    return len(swaps)


def erase_by_file(spark: SparkSession, path: str, subjects: DataFrame, key: str) -> dict[str, int]:
    """The rows of ``subjects`` removed from the table at ``path``, of which only files that may hold them are read and replaced.

    Returns the rows erased, the files rewritten and all files. Counts come from the files rewritten. A table without an index
    gets one first. Readers that listed the table before the swap should list it again.
    """
    finish_erasures(spark, path, key)
    if not target_exists(spark, f"{path}/{INDEX}"):
        build_index(spark, path, key)
    index = spark.read.parquet(f"{path}/{INDEX}")
    n_files = len(spark.read.parquet(path).inputFiles())
    touched = sorted(r["file"] for r in files_with(index, subjects, key).collect())
    if not touched:
        return {"erased": 0, "rewritten": 0, "files": n_files}
    before = spark.read.parquet(*(f"{path}/{name}" for name in touched))
    staged = staging_path(spark, "erased")
    erase(before, subjects, key).write.parquet(staged)
    after = spark.read.schema(before.schema).parquet(staged)
    erased = before.count() - after.count()
    # A file of the rewritten ones has a name of its own; until the swap it is hidden.
    run, new = uuid.uuid4().hex[:12], []
    for i, file in enumerate(sorted(after.inputFiles())):
        name = f"part-erased-{run}-{i:05d}.parquet"
        source, files = _fs(spark, unquote(file))
        if not files.rename(source, _fs(spark, f"{path}/_{name}")[0]):
            raise RuntimeError(f"could not move {file}")
        new.append(name)
    spark.createDataFrame([(run, touched, new)], "run string, old array<string>, new array<string>").write.mode("append").parquet(f"{path}/{SWAPS}")
    # The index follows: entries of the old files go, the new ones' come.
    kept = index.join(spark.createDataFrame([(x,) for x in touched], "file string"), "file", "left_anti")
    fresh = spark.createDataFrame([], index.schema)
    _swap(spark, path, touched, new)
    if new:
        fresh = subject_index(spark.read.parquet(*(f"{path}/{name}" for name in new)), key)
    staged_index = staging_path(spark, "subjects")
    kept.unionByName(fresh).write.parquet(staged_index)
    spark.read.schema(index.schema).parquet(staged_index).write.mode("overwrite").parquet(f"{path}/{INDEX}")
    at, files = _fs(spark, f"{path}/{SWAPS}")
    files.delete(at, True)
    return {"erased": erased, "rewritten": len(touched), "files": n_files}
