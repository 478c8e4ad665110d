"""File scans. Every reader notes the source file at the scan, ahead of any shuffle."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tierflow.sources.sniff import sniff_files

SOURCE_FILE = "_source_file"
CORRUPT = "_corrupt_record"
CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def with_source_file(df: DataFrame) -> DataFrame:
    return df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def multi_line_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The JSON files at ``path`` that hold one record per line, and those that are one document over
    several lines. Each file is looked at as a whole.

    A file whose lines are all whole records is of the first kind. Any other is of the
    second if it can be read as one document; else it is of the first and has corrupt lines.
    """
    line = F.trim("value")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), line.alias("line")).where("line <> ''")
    whole = F.col("line").rlike(r"^[\[{]") & F.try_parse_json("line").isNotNull()
    kinds = lines.groupBy("file").agg(F.bool_and(whole).alias("by_line")).collect()
    by_line = [unquote(r["file"]) for r in kinds if r["by_line"]]
    others = [unquote(r["file"]) for r in kinds if not r["by_line"]]
    if not others:
        return by_line, []
    probe = spark.read.schema(f"_any string, {CORRUPT} string").option("multiLine", True).json(others)
    read = probe.select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).isNull().alias("good"), "_any")
    whole_files = read.groupBy("file").agg(F.bool_and("good").alias("good"), F.count("_any").alias("_n")).collect()
    documents = {unquote(r["file"]) for r in whole_files if r["good"]}
    return by_line + [f for f in others if f not in documents], sorted(documents)


def scan_json(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = False
) -> DataFrame:
    """JSON files. One record per line by default, which lets Spark split large files;
    ``multi_line`` reads one object or array per file, and ``None`` reads each file by its own
    layout, for which all of them are read once more."""

    def read(paths: str | list[str], several: bool) -> DataFrame:
        reader = spark.read.option("multiLine", several)
        return with_source_file((reader if schema is None else reader.schema(schema)).json(paths))

    if multi_line is not None:
        return read(path, multi_line)
    by_line, documents = multi_line_files(spark, path)
    frames = [read(paths, several) for paths, several in ((by_line, False), (documents, True)) if paths]
    if not frames:  # empty files only
        return read(path, False)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool = False,
    sep: str = ",",
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV files with a header. Without a schema the types are inferred in an extra pass."""
    reader = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("escape", '"')
    )
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return with_source_file(reader.csv(path))


def scan_csv_detected(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV files, each read with the delimiter and encoding that it is found to have."""
    dialects = sniff_files(spark, path).groupBy("delimiter", "encoding").agg(F.collect_list("path").alias("paths"))
    frames = [
        scan_csv(spark, [unquote(p) for p in d["paths"]], schema, sep=d["delimiter"], encoding=CHARSETS[d["encoding"]])
        for d in dialects.orderBy("delimiter", "encoding").collect()
    ]
    if not frames:  # empty files only
        return scan_csv(spark, path, schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_parquet(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Parquet files; ``merge_schema`` takes the union of the columns of all files."""
    return with_source_file(spark.read.option("mergeSchema", merge_schema).parquet(path))


def scan_xml(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """XML files, a record for each element ``row_tag``: attributes are columns with a leading underscore. Without a schema the types are inferred
    in an extra pass. Give namespaced tags with their prefix."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    reader = reader if schema is None else reader.schema(schema)
    return with_source_file(reader.load(path))


def scan(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType | None = None,
    multi_line: bool | None = None,
    row_tag: str | None = None,
) -> DataFrame:
    """Scan by format name. Unless told, each JSON file is read by its own layout, and CSV records end
    with their line. XML needs the tag of its records."""
    if fmt == "xml":
        if not row_tag:
            raise ValueError("XML needs a row tag")
        return scan_xml(spark, path, row_tag, schema)
    if fmt == "json":
        return scan_json(spark, path, schema, multi_line)
    if fmt == "csv":
        return scan_csv(spark, path, schema, bool(multi_line))
    if fmt == "parquet":
        return scan_parquet(spark, path)
    raise ValueError(f"unsupported format: {fmt}")


def source_format(source: str) -> str:
    return "csv" if source == "csv" else "json"


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows of a scan whose schema has a corrupt-record column."""
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, df.where(F.col(CORRUPT).isNotNull())


def empty_files(spark: SparkSession, folder: str, name_glob: str = "*") -> list[str]:
    """Paths of zero-length files directly in a folder. File scans pass over them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name_glob}")
    listed = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return [
        status.getPath().toString()
        for status in listed
        if status.isFile() and status.getLen() == 0 and status.getPath().getName()[0] not in "._"
    ]


def scan_files(spark: SparkSession, path: str, name_glob: str | None = None) -> DataFrame:
    """Whole files as bytes: ``path, modificationTime, length, content``."""
    reader = spark.read.format("binaryFile")
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)


def csv_members(spark: SparkSession, folder: str) -> DataFrame:
    """The ``*.csv`` members directly below ``folder``, as ``path`` (file bytes are not read).

    A member may be a plain file or a directory of part files. A folder without
    members raises ``FileNotFoundError``.
    """
    root = folder.rstrip("/")
    name = re.escape(root.rsplit("/", 1)[-1])
    try:
        files = scan_files(spark, f"{root}/*.csv").select("path")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no CSV files below {folder}") from error
        raise
    member = F.regexp_extract("path", rf"^.*/{name}/([^/]+[.]csv)(/.*)?$", 1)
    return files.select(F.concat(F.lit(f"{root}/"), member).alias("path")).distinct()


def scan_csv_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None = None,
    first_only: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """All CSV members of a folder, or only the one with the smallest path."""
    members = csv_members(spark, folder)
    if not first_only:
        return scan_csv(spark, f"{folder.rstrip('/')}/*.csv", schema, multi_line)
    first = members.agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise FileNotFoundError(f"no CSV files below {folder}")
    return scan_csv(spark, first, schema, multi_line)
