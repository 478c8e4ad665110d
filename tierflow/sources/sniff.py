"""Encoding, delimiter and header of CSV files, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _occurrences(text: Column, mark: str) -> Column:
    # In bytes: a line that is not UTF-8 has no characters to count.
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark)))


def _dialect(profiles: DataFrame, path: str) -> DataFrame:
    """Delimiter and header facts from the header line in ``_header``."""
    counted = profiles.select(
        path,
        "encoding",
        "_has_rows",
        _occurrences(F.col("_header"), ",").alias("_commas"),
        _occurrences(F.col("_header"), ";").alias("_semicolons"),
        _occurrences(F.col("_header"), "\t").alias("_tabs"),
    )
    commas, semicolons, tabs = F.col("_commas"), F.col("_semicolons"), F.col("_tabs")
    delimiter = (
        F.when((semicolons > commas) & (semicolons > tabs), ";")
        .when((tabs > commas) & (tabs > semicolons), "\t")
        .otherwise(",")
    )
    marks = F.when(delimiter == ";", semicolons).when(delimiter == "\t", tabs).otherwise(commas)
    return counted.select(
        path,
        "encoding",
        delimiter.alias("delimiter"),
        (marks + 1).cast("int").alias("n_columns"),
        (F.greatest(commas, semicolons, tabs) == 0).alias("no_delimiter"),
        (~F.col("_has_rows")).alias("header_only"),
    )


def sniff_csv(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Profile of each file from its whole content, which is a value of its row.

    A semicolon or TAB is the delimiter only where it is strictly the most
    frequent mark in the header line; otherwise the comma is. Files that are not
    valid UTF-8 are read as Latin-1.
    """
    data = F.col(content)
    utf8 = F.is_valid_utf8(data.cast("string"))
    text = F.when(utf8, F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))
    decoded = files.select(
        F.col(path),
        F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"),
        text.alias("_text"),
    ).withColumns(
        {"_header": F.split_part("_text", F.lit("\n"), F.lit(1)), "_has_rows": F.contains("_text", F.lit("\n"))}
    )
    return _dialect(decoded, path)


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """:func:`sniff_csv` of the files at ``path``, read line by line, so that large files are split and
    none is held as a whole."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_place"),
        F.col("value").alias("line"),
    )
    # Places rise within a block, and the header is the first line of the first one.
    profiles = lines.groupBy("path").agg(
        F.min_by("line", F.struct("_block", "_place")).alias("_header"),
        F.bool_and(F.is_valid_utf8("line")).alias("_utf8"),
        (F.count("*") > 1).alias("_has_rows"),
    )
    encoding = F.when(F.col("_utf8"), "utf-8").otherwise("latin-1").alias("encoding")
    return _dialect(profiles.select("path", encoding, "_header", "_has_rows"), "path")
