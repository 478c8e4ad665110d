from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from tierflow.operators import sinks
from tierflow.sources import files, landing, payload, sniff
from tierflow.specs import endpoint_spec, entity_spec, scrape_spec

CSV_TEXT = 'ID,Room Type,host-name,price\n1,"a, b",x,$7\n1,"two\nlines",y,8\n,z,z,9\n'


def test_csv_with_quoted_newline(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(CSV_TEXT)
    df = files.scan_csv(spark, str(path), multi_line=True)
    assert df.count() == 3
    assert {r["Room Type"] for r in df.collect()} == {"a, b", "two\nlines", "z"}
    assert df.select(files.basename(F.col("_source_file"))).first()[0] == "a.csv"


def test_source_file_survives_a_shuffle(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"f{n}.json").write_text(json.dumps([{"id": n}, {"id": n}]))
    df = files.scan_json(spark, str(tmp_path), multi_line=True).dropDuplicates(["id"])
    found = {r["id"]: r["_source_file"].rsplit("/", 1)[-1] for r in df.collect()}
    assert found == {1: "f1.json", 2: "f2.json"}


def test_json_array_object_and_empty(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "object.json").write_text('{"id": 3}')
    (tmp_path / "empty.json").write_text("[]")
    df = files.scan_json(spark, str(tmp_path), multi_line=True)
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]


@pytest.mark.parametrize(
    "text, multi_line",
    [
        ('{"id": 1}\n{"id": 2}\n', False),
        ('[{"id": 1}, {"id": 2}]', False),
        ('[\n  {\n    "id": 1\n  },\n  {\n    "id": 2\n  }\n]', True),
        ('\n{"id":\n{"id": 1}\n{"id": 2}', False),
    ],
)
def test_layout_of_json_is_recognised(spark, tmp_path, text, multi_line):
    (tmp_path / "a.json").write_text(text)
    by_line, documents = files.multi_line_files(spark, str(tmp_path))
    assert (len(by_line), len(documents)) == ((0, 1) if multi_line else (1, 0))
    df = files.scan(spark, str(tmp_path), "json", T.StructType([T.StructField("id", T.LongType())]))
    assert sorted(r["id"] for r in df.where("id is not null").collect()) == [1, 2]


def test_truncated_json_is_quarantined(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField(files.CORRUPT, T.StringType())])
    good, bad = files.split_corrupt(files.scan_json(spark, str(tmp_path), schema))
    assert sorted(r["id"] for r in good.collect()) == [1, 3]
    assert [r[files.CORRUPT] for r in bad.collect()] == ['{"id": ']


def test_gzip_is_read_by_extension(spark, tmp_path):
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"id\n1\n2\n"))
    assert files.scan(spark, str(tmp_path / "*a.csv*"), "csv").count() == 2


def test_formats(spark):
    assert files.source_format("csv") == "csv"
    assert files.source_format("scraping") == "json"
    with pytest.raises(ValueError, match="row tag"):
        files.scan(spark, "x", "xml")
    with pytest.raises(ValueError, match="avro"):
        files.scan(spark, "x", "avro")


def test_merged_schema(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    spark.range(1).selectExpr("id", "'a' as x").write.mode("append").parquet(str(tmp_path / "t"))
    got = files.scan_parquet(spark, str(tmp_path / "t"), merge_schema=True)
    assert sorted(got.columns) == ["_source_file", "id", "x"] and got.where("x is null").count() == 1


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_parquet(spark, str(tmp_path / "none"))


def test_csv_folder(spark, tmp_path):
    folder = tmp_path / "items" / "items"
    folder.mkdir(parents=True)
    (folder / "b.csv").write_text("id\n2\n")
    (folder / "a.csv").write_text("id\n1\n")
    (folder / "c.txt").write_text("id\n3\n")
    assert sorted(r["id"] for r in files.scan_csv_folder(spark, str(folder)).collect()) == [1, 2]
    assert [r["id"] for r in files.scan_csv_folder(spark, str(folder), first_only=True).collect()] == [1]
    with pytest.raises(FileNotFoundError):
        files.scan_csv_folder(spark, str(tmp_path / "none"), first_only=True)


def test_sniff_files(spark, tmp_path):
    (tmp_path / "comma.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "semicolon.csv").write_bytes("año;b\n1;2\n".encode("latin-1"))
    (tmp_path / "tab.csv").write_text("a\tb\tc,d\n1\t2\t3\n")
    (tmp_path / "header.csv").write_text("only")
    (tmp_path / "tie.csv").write_text("a,b;c\n1\n")
    sniffed = sniff.sniff_csv(files.scan_files(spark, str(tmp_path), "*.csv"))
    found = {r["path"].rsplit("/", 1)[-1]: tuple(r)[1:] for r in sniffed.collect()}
    assert found == {
        "comma.csv": ("utf-8", ",", 3, False, False),
        "semicolon.csv": ("latin-1", ";", 2, False, False),
        "tab.csv": ("utf-8", "\t", 3, False, False),
        "header.csv": ("utf-8", ",", 1, True, True),
        "tie.csv": ("utf-8", ",", 2, False, False),
    }


def test_landing_keeps_bytes(spark, tmp_path):
    data = gzip.compress(b"id\n1\n")
    drop, target = tmp_path / "drop", str(tmp_path / "landed")
    drop.mkdir()
    (drop / "a.csv.gz").write_bytes(data)
    (drop / "b.csv").write_text("id\n")
    (drop / "c.bin").write_bytes(b"\xff\x00")
    files_found = files.scan_files(spark, str(drop)).select("path", F.concat(F.lit(f"{target}/"), files.basename(F.col("path"))).alias("target"))
    manifest = {r["target"].rsplit("/", 1)[-1]: r for r in landing.copy_objects(files_found).collect()}
    assert (tmp_path / "landed" / "a.csv.gz").read_bytes() == data
    assert manifest["c.bin"]["n_bytes"] == 2 and manifest["a.csv.gz"]["sha256"] == hashlib.sha256(data).hexdigest()
    with pytest.raises(sinks.TargetExists):
        sinks.make_way(spark, target, False)


def test_mixed_layouts_lose_nothing(spark, tmp_path):
    """Lines, documents over several lines, an indented array and twenty bad lines, in one folder."""
    (tmp_path / "lines.json").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "pretty one.json").write_text('{\n  "id": 3\n}\n')
    (tmp_path / "array.json").write_text('[\n  {"id": 4},\n  {"id": 5}\n]\n')
    (tmp_path / "bad.json").write_text("{oops\n" * 20 + "".join(f'{{"id": {i}}}\n' for i in range(10, 20)))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField(files.CORRUPT, T.StringType())])
    good, bad = files.split_corrupt(files.scan(spark, str(tmp_path), "json", schema))
    assert sorted(r["id"] for r in good.collect()) == [1, 2, 3, 4, 5, *range(10, 20)]
    assert len(bad.collect()) == 20

@pytest.mark.parametrize(
    "body, records",
    [
        ('{"data": [{"a": 1}, {"a": 2}]}', ['{"a":1}', '{"a":2}']),
        ('{"data": []}', []),
        ('{"data": {"a": 1}, "items": [3]}', ["3"]),
        ('{"data": "[1]", "results": [{"b": 1}]}', ['{"b":1}']),
        ('{"results": {}}', ['{"results":{}}']),
        ('{"items": [[1], 2]}', ["[1]", "2"]),
        ('[{"a": 1}, 5]', ['{"a":1}', "5"]),
        ("[]", []),
        ("7", ["7"]),
        ('"[1]"', ['"[1]"']),
        ('{"a":', []),
        (None, []),
    ],
)
def test_unwrap(spark, body, records):
    df = spark.createDataFrame([(1, body)], "id int, body string")
    out = payload.unwrap_payload(df).select(F.to_json("record"))
    assert [r[0] for r in out.collect()] == records
    assert df.select(payload.count_records(F.col("body"))).first()[0] == len(records)


def test_unparseable_bodies(spark):
    df = spark.createDataFrame([(1, '{"a":'), (2, "[]"), (3, None)], "id int, body string")
    assert sorted(r["id"] for r in payload.unparseable(df).collect()) == [1, 3]


def test_specs():
    assert entity_spec("nyc", "csv").positives == ("price",)
    assert entity_spec("nyc", "api").positives == ()
    assert entity_spec("anything", "csv").fmt == "csv"
    assert endpoint_spec("unknown").path == "/unknown"
    assert endpoint_spec("calendar").file
    with pytest.raises(ValueError, match="unknown"):
        scrape_spec("unknown")
