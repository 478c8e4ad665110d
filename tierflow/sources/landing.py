"""Files kept byte for byte in the raw tier.

Bytes go from object to object in the executors, chunk by chunk; rows carry only what is known
about them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tierflow.workspace import runs_on_executors

runs_on_executors(__name__)

CHUNK = 8 << 20
MANIFEST = "path string, target string, n_bytes long, sha256 string"
# Opens an object for reading or writing: (path, mode "rb" or "wb") -> binary file.
Opener = Callable[[str, str], object]


def open_object(path: str, mode: str):
    """Objects by Arrow's file systems, which know local files, S3, GCS and HDFS."""
    from pyarrow import fs

    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path[len(alias) :]
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    files, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if mode == "rb":
        return files.open_input_stream(inner, compression=None)
    if isinstance(files, fs.LocalFileSystem):
        files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(inner, compression=None)


def store(chunks: Iterable[bytes], target: str, opener: Opener = open_object) -> tuple[int, str]:
    """Write chunks to an object; its size and checksum. A repeated write gives the same object."""
    size, digest = 0, hashlib.sha256()
    with opener(target, "wb") as out:
        for chunk in chunks:
            out.write(chunk)
            digest.update(chunk)
            size += len(chunk)
    return size, digest.hexdigest()


def _chunks(source) -> Iterator[bytes]:
    while chunk := source.read(CHUNK):
        yield bytes(chunk)


def chunks_of(path: str, opener: Opener = open_object) -> Iterator[bytes]:
    """An object's content, a chunk at a time."""
    with opener(path, "rb") as source:
        yield from _chunks(source)


def copy_objects(files: DataFrame, opener: Opener = open_object) -> DataFrame:
    """Each object of ``files`` (path, target) copied by a task of its own; the manifest rows. Write
    them at once: computing them again copies again."""
    schema = pa.schema([("path", pa.string()), ("target", pa.string()), ("n_bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size, digest = store(chunks_of(path, opener), target, opener)
                yield pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip((path, target, size, digest), schema.types)], schema=schema)

    tasks = max(1, min(files.count(), 10_000))
    return files.select("path", "target").repartition(tasks, "path").mapInArrow(run, MANIFEST)


def content_type(name: Column) -> Column:
    """MIME type by file extension."""
    return (
        F.when(name.endswith(".gz"), "application/gzip")
        .when(name.endswith(".csv"), "text/csv")
        .when(name.endswith(".json"), "application/json")
        .otherwise("application/octet-stream")
    )


def landing_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``files`` with content type, size and checksum; empty files are marked, not dropped."""
    return files.select(
        "*",
        content_type(F.col(path)).alias("content_type"),
        F.octet_length(content).cast("long").alias("n_bytes"),
        F.sha2(content, 256).alias("sha256"),
        (F.octet_length(content) == 0).alias("is_empty"),
    )
