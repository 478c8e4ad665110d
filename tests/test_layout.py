from __future__ import annotations

import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tierflow.operators import layout


def test_ranks_are_counts_of_borders(spark):
    borders = [1.5, 2.0, 2.0, 7.25]
    frame = spark.createDataFrame([(x,) for x in (None, -1.0, 1.5, 1.75, 2.0, 7.0, 7.25, 9.0)], "x double")
    found = [r[0] for r in frame.select(layout.range_rank(F.col("x"), borders)).collect()]
    assert found == [0, 0, 1, 1, 3, 3, 4, 4]
    assert frame.select(layout.range_rank(F.col("x"), [])).distinct().collect()[0][0] == 0


def test_bits_are_interleaved(spark):
    frame = spark.range(64).selectExpr("id", "id % 8 AS x", "id DIV 8 AS y")
    found = frame.select("x", "y", layout.z_value([F.col("x"), F.col("y")], 3).alias("z")).collect()
    for r in found:
        bits = sum(((r["x"] >> b & 1) << 2 * b) | ((r["y"] >> b & 1) << 2 * b + 1) for b in range(3))
        assert r["z"] == bits
    assert sorted(r["z"] for r in found) == list(range(64))


@pytest.mark.parametrize("kinds", [("bigint", "timestamp_ntz"), ("string", "double", "date")])
def test_any_column_prunes(spark, tmp_path, rows, kinds):
    draw = random.Random(5)
    make = {
        "bigint": lambda: draw.randrange(10_000), "timestamp_ntz": lambda: datetime(2020, 1, 1 + draw.randrange(28), draw.randrange(24)),
        "string": lambda: "".join(draw.choices("abcdefgh", k=6)), "double": draw.random, "date": lambda: date(2000 + draw.randrange(20), 1, 1 + draw.randrange(28)),
    }
    data = [tuple(None if draw.random() < 0.01 else make[k]() for k in kinds) for _ in range(20_000)]
    names = [f"c{i}" for i in range(len(kinds))]
    df = spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    layout.z_ordered(df, names, 64).write.parquet(path := str(tmp_path / "z"))
    stored = spark.read.parquet(path)
    assert rows(stored) == rows(df)
    for k, name in enumerate(names):
        values = sorted(r[k] for r in data if r[k] is not None)
        low, high = values[len(values) * 40 // 100], values[len(values) * 42 // 100]
        opened = layout.opened_share(stored, name, low, high).first()
        assert 30 <= opened["files"] <= 160
        # A range of 2 % lies in one or two of the layers, of which a column has about the k-th root of the files.
        assert opened["opened"] <= opened["files"] * (2.2 / opened["files"] ** (1 / len(kinds)) + 0.05)


def test_one_value_fills_several_files(spark, tmp_path, rows):
    df = spark.range(4000).selectExpr("1 AS a", "'x' AS b", "id")
    layout.z_ordered(df, ["a", "b"], 8).write.parquet(path := str(tmp_path / "z"))
    sizes = [r["n_rows"] for r in layout.file_ranges(spark.read.parquet(path), ["a"]).collect()]
    assert 5 <= len(sizes) <= 9 and max(sizes) < 1000 and sum(sizes) == 4000


def test_boxes_cover_all_cells_once():
    draw = random.Random(7)
    for columns, bits in ((1, 4), (2, 3), (3, 2)):
        for _ in range(50):
            counts = {c: draw.randrange(1, 40) for c in range(1 << columns * bits) if draw.random() < 0.6}
            most = draw.randrange(1, 120)
            found = layout.boxes(counts, columns, bits, most)
            covered = [c for first, end, _ in found for c in range(first, end) if c in counts]
            assert covered == sorted(counts)
            for first, end, parts in found:
                rows = sum(counts.get(c, 0) for c in range(first, end))
                assert first % (end - first) == 0 and rows <= most * parts and (parts == 1 or end - first == 1)


def test_compaction_and_empty(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 10 AS a", "id AS b")
    df.repartition(20).write.parquet(str(tmp_path / "small"))
    assert layout.compact_z_ordered(spark, str(tmp_path / "small"), str(tmp_path / "z"), ["a", "b"], target_bytes=4000) > 1
    assert spark.read.parquet(str(tmp_path / "z")).count() == 1000
    assert layout.z_ordered(df.limit(0), ["a", "b"], 4).count() == 0


@pytest.mark.parametrize("at_once", [64, 5])
def test_a_task_writes_several_small_files_of_a_cell(spark, tmp_path, rows, monkeypatch, at_once):
    monkeypatch.setattr(layout, "TASK_FILES", at_once, raising=False)
    df = spark.range(8000).selectExpr("id % 100 AS a", "id * 7919 % 101 AS b", "id")
    df.write.parquet(source := str(tmp_path / "small"))
    n = layout.compact_z_ordered(spark, source, target := str(tmp_path / "z"), ["a", "b"], target_bytes=500, bits=1)
    stored = spark.read.parquet(target)
    assert rows(stored) == rows(df)
    held = layout.file_ranges(stored, ["a", "b"]).collect()
    # File names begin with the number of the task that wrote them.
    tasks = {os.path.basename(r["file"])[: len("part-00000")] for r in held}
    assert n == len(held) > 40 and 4 <= len(tasks) <= 4 + n / at_once
    assert max(r["n_rows"] for r in held) <= layout.SLACK * 8000 / (layout.directory_bytes(spark, source) / 500)
    # Of the four cells, each file holds rows of one.
    borders = layout.range_borders(df, ["a", "b"], 1)
    assert all((r[f"min_{c}"] >= borders[c][0]) == (r[f"max_{c}"] >= borders[c][0]) for r in held for c in "ab")


def test_a_file_that_fills_a_task_is_not_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layout, "TASK_BYTES", 1000)
    spark.range(4000).selectExpr("1 AS a", "'x' AS b", "id").write.parquet(source := str(tmp_path / "small"))
    n = layout.compact_z_ordered(spark, source, target := str(tmp_path / "z"), ["a", "b"], target_bytes=1000)
    names = [os.path.basename(f) for f in spark.read.parquet(target).inputFiles()]
    assert n == len(names) == len({f[: len("part-00000")] for f in names}) > 1
